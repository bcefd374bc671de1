"""Problem 2: references to records that are missing, deleted or arrive later.

Plan: the parents are reduced to one row per key with their validity (earliest live arrival), combined on the map
side, so a key with many parent rows costs one row. References and parents are then co-partitioned and sorted by key
and merged linearly (a sort-merge join; the merge hint keeps it so at any size). A hot key is a hot reference key
only, since the parent side is unique, and adaptive execution splits its partition. It can do so only where both sides
of the merge are an exchange, which is why the reduced parents are written first: read back, they are exchanged like
the references, instead of ending in the aggregation's own partitioning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.runtime import materialize, table


def orphans(refs: DataFrame, parents: DataFrame, keys: list[tuple[str, str]], ref_id: str, ref_at: str, parent_at: str, parent_deleted: str) -> DataFrame:
    """(row_id, loaded_at, reason) of every reference without a valid parent.

    `keys` are (reference column, parent column); values are compared exactly. A reference with a null in its key is
    none. Reasons: `missing` no parent row; `deleted` every parent row has `parent_deleted` set, whenever; `late`
    the first parent row that isn't deleted arrived after the reference. A parent row with a null arrival counts as
    always there; a reference without an arrival is never late.
    """
    k = [f"_k{i}" for i in range(len(keys))]
    r = refs.select(
        F.col(ref_id).alias("row_id"), F.col(ref_at).alias("loaded_at"), *(F.col(a).alias(x) for x, (a, _) in zip(k, keys))
    ).where(" and ".join(f"{x} is not null" for x in k))
    live: Column = F.col(parent_deleted).isNull()
    p = (
        parents.where(" and ".join(f"`{b}` is not null" for _, b in keys))
        .groupBy(*(F.col(b).alias(x) for x, (_, b) in zip(k, keys)))
        .agg(
            F.bool_or(live).alias("_live"),
            F.bool_or(live & F.col(parent_at).isNull()).alias("_always"),
            F.min(F.when(live, F.col(parent_at))).alias("_from"),
        )
    )
    reason = (
        F.when(F.col("_live").isNull(), "missing").when(~F.col("_live"), "deleted")
        .when(~F.col("_always") & (F.col("_from") > F.col("loaded_at")), "late")
    )
    return r.join(materialize(p).hint("merge"), k, "left").select("row_id", "loaded_at", reason.alias("reason")).where("reason is not null")


def all_orphans(spark, folder: str) -> DataFrame:
    verses, entries = table(spark, folder, "verses"), table(spark, folder, "corpus_entries")
    a = orphans(
        table(spark, folder, "tafsirs"), verses,
        [("verse_source", "source_id"), ("sura", "sura"), ("aya", "aya")], "tafsir_id", "loaded_at", "loaded_at", "deleted_at",
    )
    b = orphans(entries, table(spark, folder, "corpus_sources"), [("source_id", "source_id")], "entry_id", "loaded_at", "loaded_at", "withdrawn_at")
    return a.select(F.lit("tafsirs").alias("table_name"), "*").unionByName(b.select(F.lit("corpus_entries").alias("table_name"), "*"))


def p2_found(spark, folder: str) -> DataFrame:
    return all_orphans(spark, folder).drop("loaded_at")


def p2_monthly(spark, folder: str) -> DataFrame:
    month = F.date_format("loaded_at", "yyyy-MM").alias("month")
    return all_orphans(spark, folder).groupBy("table_name", month, "reason").agg(F.count(F.lit(1)).alias("n"))


_ORPHANS = """
WITH p AS (SELECT source_id, sura, aya, count(*) FILTER (WHERE deleted_at IS NULL) AS live,
                  min(loaded_at) FILTER (WHERE deleted_at IS NULL) AS since FROM verses GROUP BY ALL),
s AS (SELECT source_id, count(*) FILTER (WHERE withdrawn_at IS NULL) AS live,
             min(loaded_at) FILTER (WHERE withdrawn_at IS NULL) AS since FROM corpus_sources GROUP BY ALL),
o AS (SELECT 'tafsirs' AS table_name, t.tafsir_id AS row_id, t.loaded_at, p.live, p.since
      FROM tafsirs t LEFT JOIN p ON t.verse_source = p.source_id AND t.sura = p.sura AND t.aya = p.aya
      WHERE t.verse_source IS NOT NULL AND t.sura IS NOT NULL AND t.aya IS NOT NULL
      UNION ALL
      SELECT 'corpus_entries', e.entry_id, e.loaded_at, s.live, s.since FROM corpus_entries e LEFT JOIN s USING (source_id)
      WHERE e.source_id IS NOT NULL),
f AS (SELECT table_name, row_id, loaded_at, CASE WHEN live IS NULL THEN 'missing' WHEN live = 0 THEN 'deleted'
             WHEN since > loaded_at THEN 'late' END AS reason FROM o)
"""
SQL = {
    "p2_found": _ORPHANS + "SELECT table_name, row_id, reason FROM f WHERE reason IS NOT NULL",
    "p2_monthly": _ORPHANS + "SELECT table_name, strftime(loaded_at, '%Y-%m') AS month, reason, count(*) AS n FROM f WHERE reason IS NOT NULL GROUP BY ALL",
}
QUERIES = {"p2_found": p2_found, "p2_monthly": p2_monthly}
