"""Archives and snapshots: members of ZIP files, pinned compressed JSON, versioned tables behind a verified pointer."""

from __future__ import annotations

import gzip
import hashlib
import io
import uuid
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import sha256
from ..plans.runtime import materialize, shared_dir, table
from .files import against_manifest, file_name

MOST_BYTES = 1 << 30  # of one unpacked member or file; more is refused, not cut


def zip_members(spark: SparkSession, path: str) -> DataFrame:
    """(archive, name, n_bytes, digest) of every member of ZIP files, one task a file, read in pieces.

    A repeated member name, an absolute name, one that leaves its folder and a damaged member fail the read.
    """

    def members(content: bytes) -> Iterator[tuple[str, int, str]]:
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            names = [i.filename for i in z.infolist()]
            if len(set(names)) != len(names) or any(n.startswith("/") or ".." in n.split("/") for n in names):
                raise ValueError("unsafe or repeated member names")
            for info in z.infolist():
                if info.is_dir():
                    continue
                digest, size = hashlib.sha256(), 0
                with z.open(info) as f:
                    while piece := f.read(1 << 20):
                        digest.update(piece)
                        size += len(piece)
                        if size > MOST_BYTES:
                            raise ValueError(f"{info.filename} unpacks to more than {MOST_BYTES} bytes")
                yield info.filename, size, digest.hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(p, *m) for p, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for m in members(c)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate((pa.string(), pa.string(), pa.int64(), pa.string()))], names=["archive", "name", "n_bytes", "digest"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(run, "archive string, name string, n_bytes long, digest string")


def unpacked(files: DataFrame) -> DataFrame:
    """`files(name, content BINARY, n_unpacked LONG)` to (name, text): gzip content whose unpacked size is exactly the told one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for content, size in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                if size > MOST_BYTES:
                    raise ValueError(f"more than {MOST_BYTES} bytes are announced")
                with gzip.GzipFile(fileobj=io.BytesIO(content)) as g:
                    data = g.read(size + 1)
                if len(data) != size:
                    raise ValueError("unpacked size differs")
                texts.append(data.decode("utf-8"))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["name", "text"])

    return files.select("name", "content", "n_unpacked").mapInArrow(run, "name string, text string")


CELLS = "schemaVersion int, edition struct<id: string, source: string>, verses map<string, map<string, struct<text: string, footnotes: string>>>"


def ingested(spark: SparkSession, path: str, manifest: DataFrame, allow_partial: bool = False, base: str | None = None) -> DataFrame:
    """(source_id, sura, aya, text, footnotes) of pinned gzip JSON files.

    `manifest(source_id, file_name, sha256, edition, n_unpacked)`. A file whose digest, edition or unpacked size differs,
    and a blank cell, fail the read; `allow_partial` skips files that are missing and nothing else. A null footnote is
    the empty one.
    """
    files = spark.read.format("binaryFile").load(path).select(file_name(base).alias("file_name"), "content")
    met = manifest.join(files, "file_name", "left")
    refuse = lambda bad, code: F.assert_true(~bad, F.lit(code)).isNull()
    there = met.where("content is not null") if allow_partial else met.where(refuse(F.col("content").isNull(), "missing file"))
    good = there.where(refuse(F.sha2("content", 256) != F.col("sha256"), "digest differs"))
    parsed = unpacked(good.select(F.col("file_name").alias("name"), "content", "n_unpacked")).select(F.col("name").alias("file_name"), F.from_json("text", CELLS, {"mode": "FAILFAST"}).alias("j"))
    whole = parsed.join(manifest.select("file_name", "source_id", "edition"), "file_name").where(refuse(~F.col("j.edition.id").eqNullSafe(F.col("edition")), "edition differs"))
    chapters = whole.select("source_id", F.explode("j.verses").alias("sura", "cells"))
    cells = chapters.select("source_id", F.col("sura").cast("int").alias("sura"), F.explode("cells").alias("aya", "cell"))
    rows = cells.select("source_id", "sura", F.col("aya").cast("int").alias("aya"), "cell.text", F.coalesce("cell.footnotes", F.lit("")).alias("footnotes"))
    return rows.where(refuse(F.coalesce(F.trim("text"), F.lit("")) == "", "blank cell"))


def published(df: DataFrame, root: str, keys: list[str]) -> str:
    """Write `df` as a new version under `root` and then its manifest line; returns the version.

    The version is the digest of its content, so the same content gives the same version and is written once. A reader
    sees a version only once its manifest line is there, so a writer that fails leaves nothing to be read.
    """
    spark = df.sparkSession
    at = f"{root}/pending/{uuid.uuid4().hex}"
    df.write.parquet(at)
    held = spark.read.schema(df.schema).parquet(at)
    version, n = _content(held)
    spark.createDataFrame([(version, n, at, ",".join(keys))], "version string, n_rows long, path string, keys string").coalesce(1).write.mode("append").json(f"{root}/manifest")
    return version


def _content(df: DataFrame) -> tuple[str, int]:
    """(digest, rows) of a table whatever the order of its rows: two sums of row hashes and the count."""
    cols = sorted(df.columns)
    h = lambda salt: F.sum(F.xxhash64(F.lit(salt), *(x for c in cols for x in (F.col(c).isNull(), F.col(c)))).cast("decimal(20,0)"))
    r = df.agg(h("a").alias("a"), h("b").alias("b"), F.count(F.lit(1)).alias("n")).first()
    return hashlib.sha256(f"{r.a}:{r.b}:{r.n}:{cols}".encode()).hexdigest(), r.n


def restored(spark: SparkSession, root: str, version: str) -> DataFrame:
    """The table of a version, after its content was verified against it; another content or an unknown version raises."""
    line = spark.read.schema("version string, n_rows long, path string, keys string").json(f"{root}/manifest").where(F.col("version") == version).limit(1).collect()
    if not line:
        raise ValueError(f"no version {version}")
    df = spark.read.parquet(line[0].path)
    if _content(df) != (version, line[0].n_rows):
        raise ValueError(f"version {version} was changed")
    return df


def _folder(s) -> str:
    return f"{shared_dir(s)}/tessera/{uuid.uuid4().hex}"


def _ingest(s, d):
    """Every chapter of every source written as gzip JSON {sura: {aya: {text, footnotes}}}, pinned, and read back under its pins."""
    e = table(s, d, "corpus_entries").where(r"source_id is not null and sura is not null and aya is not null and text rlike '[^\\s\\p{Z}]'")
    one = e.groupBy("source_id", "sura", "aya").agg(F.min("text").alias("text"), F.min("footnotes").alias("footnotes"))
    cells = F.map_from_entries(F.collect_list(F.struct(F.col("aya").cast("string"), F.struct("text", "footnotes"))))  # one chapter
    files = one.groupBy("source_id", "sura").agg(cells.alias("cells")).select(
        "source_id", "sura", F.to_json(F.struct(F.lit(1).alias("schemaVersion"), F.struct(F.col("source_id").alias("id"), F.lit("own").alias("source")).alias("edition"), F.create_map(F.col("sura").cast("string"), "cells").alias("verses")), {"ignoreNullFields": "false"}).alias("value"),
    )
    at = _folder(s)
    files = materialize(files)
    files.repartition("source_id", "sura").write.option("compression", "gzip").partitionBy("source_id", "sura").text(at)
    written = s.read.format("binaryFile").load(f"{at}/source_id=*/sura=*/*.gz").select(
        file_name(at).alias("file_name"), F.sha2("content", 256).alias("sha256"), F.url_decode(F.regexp_extract("path", "source_id=([^/]*)", 1)).alias("source_id"), F.regexp_extract("path", "sura=([^/]*)", 1).cast("int").alias("sura"),
    )
    manifest = materialize(written.join(files.select("source_id", "sura", (F.octet_length("value") + 1).cast("long").alias("n_unpacked")), ["source_id", "sura"]).withColumn("edition", F.col("source_id")).drop("sura"))
    read = ingested(s, f"{at}/source_id=*/sura=*/*.gz", manifest, base=at)
    return read.select("source_id", "sura", "aya", sha256(F.col("text")).alias("text_sha256"), "footnotes")


def _snapshot(s, d):
    """Verses published as a version, restored and compared with what was published: no row differs."""
    v, root = table(s, d, "verses").select("verse_id", "source_id", "text"), _folder(s)
    first, again = published(v, root, ["verse_id"]), published(v, root, ["verse_id"])
    changed = published(v.where("text is not null"), root, ["verse_id"])
    of = lambda x: restored(s, root, x).select("verse_id", sha256(F.col("text")).alias("digest"))
    same = against_manifest(of(first), of(again), ["verse_id"]).groupBy("status").agg(F.count(F.lit(1)).alias("n")).select(F.lit(first == again).alias("one_version"), "status", "n")
    return same.unionByName(against_manifest(of(changed), of(first), ["verse_id"]).groupBy("status").agg(F.count(F.lit(1)).alias("n")).select(F.lit(changed == first).alias("one_version"), "status", "n"))


QUERIES = {"pinned_ingest": _ingest, "snapshot_versions": _snapshot}
SQL = {
    "pinned_ingest": r"WITH o AS (SELECT source_id, sura, aya, min(text) AS text, min(footnotes) AS footnotes FROM corpus_entries WHERE source_id IS NOT NULL AND sura IS NOT NULL AND aya IS NOT NULL AND regexp_matches(text, '[^\s\p{Z}]') GROUP BY ALL) SELECT source_id, sura, aya, sha256(text) AS text_sha256, coalesce(footnotes, '') AS footnotes FROM o",
    "snapshot_versions": "SELECT false AS one_version, 'missing' AS status, count(*) AS n FROM verses WHERE text IS NULL HAVING count(*) > 0",
}
