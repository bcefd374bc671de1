"""Pinned files, manifests, JSON lines and append-only ledgers."""

from __future__ import annotations

import re
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import git_blob_sha1, sha256
from ..plans.runtime import shared_dir, table
from . import pipe_text


def file_name(base: str | None = None) -> Column:
    """The last part of a file's path, or what follows the folder `base`."""
    return F.element_at(F.split("path", "/"), -1) if base is None else F.element_at(F.split("path", re.escape(base.split("/")[-1] + "/"), 2), 2)


def pinned_texts(spark: SparkSession, path: str, pins: dict[str, str], base: str | None = None) -> DataFrame:
    """(name, text, blob) of text files whose git object id equals the pinned one; another id or a missing file raises.

    A file is named by its last part, or by what follows the folder `base`.
    """
    files = spark.read.format("binaryFile").load(path).select(file_name(base).alias("name"), F.decode("content", "UTF-8").alias("text"))
    wanted = spark.createDataFrame(sorted(pins.items()), "name string, pin string")
    got = F.broadcast(wanted).join(files, "name", "left").withColumn("blob", git_blob_sha1(F.col("text")))  # as many rows as pins
    bad = [r.name for r in got.where(~F.col("blob").eqNullSafe(F.col("pin"))).select("name").limit(10).collect()]
    if bad:
        raise ValueError(f"pins not met: {bad}")
    return got.select("name", "text", "blob")


def against_manifest(members: DataFrame, manifest: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, status) of what differs between members(keys, digest) and manifest(keys, digest): missing, unlisted, changed."""
    m = members.groupBy(*keys).agg(F.min("digest").alias("got"), F.lit(True).alias("here"))
    w = manifest.groupBy(*(F.col(k).alias(f"w_{k}") for k in keys)).agg(F.min("digest").alias("want"), F.lit(True).alias("listed"))
    on = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"w_{k}")) for k in keys))
    status = F.when(F.col("here").isNull(), "missing").when(F.col("listed").isNull(), "unlisted").when(~F.col("got").eqNullSafe(F.col("want")), "changed")
    return m.join(w, on, "full_outer").select(*(F.when(F.col("here"), F.col(k)).otherwise(F.col(f"w_{k}")).alias(k) for k in keys), status.alias("status")).where("status is not null")


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One record per line; a line that doesn't fit the schema fails the read."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def write_jsonl(df: DataFrame, path: str) -> None:
    """One JSON object per line, nulls kept, in one directory of part files."""
    df.write.option("ignoreNullFields", "false").mode("errorifexists").json(path)


def admitted(new: DataFrame, register: DataFrame, digest: str) -> DataFrame:
    """The new records whose digest the register doesn't have yet, each digest once."""
    return new.where(F.col(digest).isNotNull()).dropDuplicates([digest]).join(register.select(digest), digest, "left_anti")


def long_form(tables: dict[str, DataFrame], key: list[str], text: str) -> DataFrame:
    """One long table (source, key..., text) of one table per source; blank texts are left out."""
    return reduce(DataFrame.unionByName, [df.select(F.lit(n).alias("source"), *key, F.col(text).alias("text")) for n, df in tables.items()]).where(F.col("text").rlike(r"[^\s\p{Z}]"))


def joined_words(words: DataFrame, key: list[str], position: str, word: str) -> DataFrame:
    """(key, text): word rows joined by spaces in order of position; bounded by the length of one verse."""
    w = words.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct(F.col(position).alias("p"), F.col(word).alias("w")))).alias("x"))
    return w.select(*key, F.array_join(F.transform("x", lambda s: s["w"]), " ").alias("text"))


def _digests(df: DataFrame) -> DataFrame:
    return df.select("source_id", "sura", "aya", sha256(F.col("text")).alias("digest"))


def _manifest(s, d):
    v, e = table(s, d, "verses").where("deleted_at is null"), table(s, d, "corpus_entries").where("source_kind = 'quran'")
    return against_manifest(_digests(v), _digests(e), ["source_id", "sura", "aya"]).groupBy("source_id", "status").agg(F.count(F.lit(1)).alias("n"))


def _words(s, d):
    v = table(s, d, "verses").where("text is not null").select("verse_id", F.posexplode(F.split("text", " ")).alias("p", "w"))
    return joined_words(v, ["verse_id"], "p", "w").select("verse_id", sha256(F.col("text")).alias("text_sha256"))


def _long(s, d):
    v, e, t = table(s, d, "verses"), table(s, d, "corpus_entries"), table(s, d, "tafsirs")
    parts = {"verses": v.select(F.col("verse_id").alias("id"), "text"), "entries": e.select(F.col("entry_id").alias("id"), "text"), "notes": e.select(F.col("entry_id").alias("id"), F.col("footnotes").alias("text")), "tafsirs": t.select(F.col("tafsir_id").alias("id"), "text")}
    return long_form(parts, ["id"], "text").groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("n_chars"))


def _folder(s) -> str:
    return f"{shared_dir(s)}/tessera/{uuid.uuid4().hex}"


def _jsonl(s, d):
    """Verses written as JSON lines and read back under their schema."""
    v, at = table(s, d, "verses").select("verse_id", "source_id", "sura", "aya", "text"), _folder(s)
    write_jsonl(v, at)
    back = read_jsonl(s, at, "verse_id bigint, source_id string, sura int, aya int, text string")
    return back.select("verse_id", "source_id", "sura", "aya", sha256(F.col("text")).alias("text_sha256"))


def _one_line(s, d):
    v = table(s, d, "verses").where("deleted_at is null and sura between 0 and 999 and aya between 0 and 999 and text is not null and source_id is not null")
    return v.groupBy("source_id", "sura", "aya").agg(F.min(F.translate("text", "\n\r\u000b\u000c\u001c\u001d\u001e\u0085\u2028\u2029", "          ")).alias("text"))


def _pipe_files(s, d):
    """Every witness written as one numbered text file in order of its keys, and read back at the `ordered` level."""
    at = _folder(s)
    lines = _one_line(s, d).select("source_id", "sura", "aya", F.concat_ws("|", F.col("sura").cast("string"), F.col("aya").cast("string"), "text").alias("value"))
    lines.repartition("source_id").sortWithinPartitions("source_id", "sura", "aya").select("source_id", "value").write.partitionBy("source_id").text(at)
    back = pipe_text.read(s, f"{at}/source_id=*/*.txt", "ordered")
    return back.select(F.regexp_extract("path", "source_id=([^/]*)", 1).alias("source_id"), "sura", "aya", sha256(F.col("text")).alias("text_sha256"))


def _pinned(s, d):
    """Every witness written as one text, pinned by its git object id, and read back under its pin."""
    at = _folder(s)
    whole = _one_line(s, d).select("source_id", F.format_string("%04d%04d", "sura", "aya").alias("k"), "text").repartition("source_id").sortWithinPartitions("source_id", "k")
    whole.select("source_id", "text").write.partitionBy("source_id").text(at)
    files = s.read.format("binaryFile").load(f"{at}/source_id=*/*.txt").select(file_name(at).alias("name"), git_blob_sha1(F.decode("content", "UTF-8")).alias("pin"))
    pins = {r.name: r.pin for r in files.collect()}  # one row a file
    return pinned_texts(s, f"{at}/source_id=*/*.txt", pins, at).groupBy().agg(F.count(F.lit(1)).alias("n_files"), F.sum(F.length("text")).alias("n_chars"))


def _admitted(s, d):
    """Entries whose text no verse has yet, each text once."""
    of = lambda t: table(s, d, t).select(sha256(F.col("text")).alias("digest")).where("digest is not null")
    return admitted(of("corpus_entries"), of("verses").distinct(), "digest")


QUERIES = {"jsonl_roundtrip": _jsonl, "pipe_files": _pipe_files, "pinned_files": _pinned, "admitted": _admitted, "manifest_check": _manifest, "joined_words": _words, "long_form": _long}
_LINES = r"WITH l AS (SELECT source_id, sura, aya, min(translate(text, chr(10) || chr(13) || chr(11) || chr(12) || chr(28) || chr(29) || chr(30) || chr(133) || chr(8232) || chr(8233), '          ')) AS text FROM verses WHERE deleted_at IS NULL AND sura BETWEEN 0 AND 999 AND aya BETWEEN 0 AND 999 AND text IS NOT NULL AND source_id IS NOT NULL GROUP BY ALL)"
SQL = {
    "jsonl_roundtrip": "SELECT verse_id, source_id, sura, aya, sha256(text) AS text_sha256 FROM verses",
    "pipe_files": _LINES + " SELECT source_id, sura, aya, sha256(text) AS text_sha256 FROM l",
    "pinned_files": _LINES + " SELECT count(DISTINCT source_id) AS n_files, sum(length(text) + 1)::BIGINT AS n_chars FROM l",
    "admitted": "SELECT DISTINCT sha256(text) AS digest FROM corpus_entries WHERE text IS NOT NULL AND sha256(text) NOT IN (SELECT sha256(text) FROM verses WHERE text IS NOT NULL)",
    "manifest_check": "WITH v AS (SELECT source_id, sura, aya, min(sha256(text)) AS h FROM verses WHERE deleted_at IS NULL GROUP BY ALL), e AS (SELECT source_id, sura, aya, min(sha256(text)) AS h FROM corpus_entries WHERE source_kind = 'quran' GROUP BY ALL), j AS (SELECT coalesce(v.source_id, e.source_id) AS source_id, CASE WHEN v.k IS NULL THEN 'missing' WHEN e.k IS NULL THEN 'unlisted' WHEN v.h IS DISTINCT FROM e.h THEN 'changed' END AS status FROM (SELECT *, 1 AS k FROM v) v FULL JOIN (SELECT *, 1 AS k FROM e) e ON v.source_id IS NOT DISTINCT FROM e.source_id AND v.sura IS NOT DISTINCT FROM e.sura AND v.aya IS NOT DISTINCT FROM e.aya) SELECT source_id, status, count(*) AS n FROM j WHERE status IS NOT NULL GROUP BY ALL",
    "joined_words": "SELECT verse_id, sha256(text) AS text_sha256 FROM verses WHERE text IS NOT NULL",
    "long_form": r"WITH a AS (SELECT 'verses' AS source, text FROM verses UNION ALL SELECT 'entries', text FROM corpus_entries UNION ALL SELECT 'notes', footnotes FROM corpus_entries UNION ALL SELECT 'tafsirs', text FROM tafsirs) SELECT source, count(*) AS n, sum(length(text))::BIGINT AS n_chars FROM a WHERE regexp_matches(text, '[^\s\p{Z}]') GROUP BY ALL",
}
