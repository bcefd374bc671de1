"""Session-level helpers: reading tables and cutting lineage in a shared folder."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once per application, so their Python workers need no installation."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    package = Path(__file__).resolve().parents[1]
    at = Path(tempfile.mkdtemp(prefix="tessera-")) / f"{package.name}.zip"
    with zipfile.ZipFile(at, "w") as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, f.relative_to(package.parent))
    spark.sparkContext.addPyFile(str(at))  # served by the driver
    _shipped.add(app)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The table `name` of a folder of Parquet files."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Deal out the rows of a scan that comes in fewer pieces than there are cores, before work that is heavy per row.

    A small table in one file would otherwise keep one core busy; a scan with more pieces passes unchanged.
    """
    if not hasattr(df, "_jdf"):  # a remote session tells nothing of its pieces
        return df
    plan = df._jdf.queryExecution()
    if "Exchange" in plan.executedPlan().toString():  # not a scan; asking it for its pieces would run it
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    pieces = plan.toRdd().getNumPartitions()
    return df.repartition(cores) if 0 < pieces < cores else df


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: `spark.checkpoint.dir`, or where that is unset one made for this session.

    The fallback is a machine-local folder, for local mode and tests only; on a cluster without the setting this raises.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    if held.isDefined():
        return held.get()
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir is not set: executors need a folder they share")
    made = tempfile.mkdtemp(prefix="tessera-")
    spark.sparkContext.setCheckpointDir(f"file://{made}")
    return f"file://{made}"


def materialize(df: DataFrame) -> DataFrame:
    """Write `df` once to the shared folder and read it back.

    Lineage ends there: a lost executor costs a re-read of files, not a recomputation, and the columnar files
    keep column pruning. The files stay until the owner of the shared folder clears it.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tessera/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
