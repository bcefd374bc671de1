"""Structured Streaming: the same audits over files as they arrive, and idempotent admission into a register."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.quality import SQL as QUALITY_SQL
from ..operators.quality import quality_counts
from ..plans.runtime import shared_dir, table
from ..sources.files import admitted


def counts_stream(spark: SparkSession, folder: str, schema, by: str, only: str = "*.parquet") -> DataFrame:
    """A streaming DataFrame of the flag counts of every Parquet file that arrives in a folder."""
    return quality_counts(spark.readStream.schema(schema).option("pathGlobFilter", only).parquet(folder), by)


def _is_file(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(at).isFile()


def counted_so_far(spark: SparkSession, folder: str, name: str, by: str) -> DataFrame:
    """Run the counts over all that is there now, and return the last state (one row per group) from a written table."""
    out = f"{shared_dir(spark)}/tessera/{uuid.uuid4().hex}"
    path, schema = f"{folder}/{name}.parquet", table(spark, folder, name).schema
    stream = counts_stream(spark, folder, schema, by, f"{name}.parquet") if _is_file(spark, path) else counts_stream(spark, path, schema, by)

    def keep(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/state")

    query = stream.writeStream.outputMode("complete").foreachBatch(keep).option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(f"{out}/state")


def admit_stream(new: DataFrame, register: str, digest: str, checkpoint: str):
    """Append records whose digest the register lacks. A batch that is run again after a failure adds nothing twice."""

    def admit(batch: DataFrame, _: int) -> None:
        there = batch.sparkSession.read.parquet(register)
        admitted(batch, there, digest).select(*there.columns).write.mode("append").parquet(register)

    return new.writeStream.foreachBatch(admit).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def late_counts(events: DataFrame, at: str, by: str, wait: str = "1 day", width: str = "1 hour") -> DataFrame:
    """Counts per time window and group of a stream; rows that come later than `wait` are left out by the watermark."""
    return events.withWatermark(at, wait).groupBy(F.window(at, width), by).agg(F.count(F.lit(1)).alias("n"))


def _arrivals(spark: SparkSession, folder: str, name: str) -> DataFrame:
    path, schema = f"{folder}/{name}.parquet", table(spark, folder, name).schema
    reader = spark.readStream.schema(schema)
    return reader.option("pathGlobFilter", f"{name}.parquet").parquet(folder) if _is_file(spark, path) else reader.parquet(path)


def admitted_so_far(spark: SparkSession, folder: str) -> DataFrame:
    """(digest): the texts of all documents, admitted as they arrive, and the same arrivals once more, which adds nothing."""
    out = f"{shared_dir(spark)}/tessera/{uuid.uuid4().hex}"
    spark.createDataFrame([], "digest string").write.parquet(f"{out}/register")
    for again in ("first", "second"):
        new = _arrivals(spark, folder, "documents").where("text is not null").select(F.sha2(F.encode("text", "UTF-8"), 256).alias("digest"))
        admit_stream(new, f"{out}/register", "digest", f"{out}/{again}").awaitTermination()
    return spark.read.parquet(f"{out}/register")


def windows_so_far(spark: SparkSession, folder: str) -> DataFrame:
    """(hour, event_type, n): events counted per hour and type as they arrive, from the last state."""
    out = f"{shared_dir(spark)}/tessera/{uuid.uuid4().hex}"
    counts = late_counts(_arrivals(spark, folder, "events").withColumn("ts", F.col("ts").cast("timestamp")), "ts", "event_type")

    def keep(batch: DataFrame, _: int) -> None:
        batch.select(F.date_format("window.start", "yyyy-MM-dd HH:mm").alias("hour"), "event_type", "n").write.mode("overwrite").parquet(f"{out}/state")

    counts.writeStream.outputMode("complete").foreachBatch(keep).option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{out}/state")


QUERIES = {
    "stream_quality_counts": lambda s, d: counted_so_far(s, d, "tafsirs", "source"),
    "stream_admitted": admitted_so_far,
    "stream_windows": windows_so_far,
}
SQL = {
    "stream_quality_counts": QUALITY_SQL["quality_counts"],
    "stream_admitted": "SELECT DISTINCT sha256(text) AS digest FROM documents WHERE text IS NOT NULL",
    "stream_windows": "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') AS hour, event_type, count(*) AS n FROM events WHERE ts IS NOT NULL GROUP BY ALL",
}
