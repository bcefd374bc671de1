"""Problem 3: differences between two copies of a dataset.

Method: a column-by-bucket checksum matrix. Keys are hashed into buckets; per bucket, side and column the rows' wide
hashes (of key and value, as 38-digit decimals) are added up. Equal sums mean equal content, so only the buckets and
columns whose sums differ are read again and joined. A repeated delivery of a key must not count twice, so every side
is reduced to one row of hashes per key first; that shuffle moves hashes, never texts.

The matrix grows with the data: there is a bucket for every few rows, so that at one differing key in a hundred nine
tenths of the texts stay unread at any size. The unequal buckets are counted; up to a documented number they are
broadcast, beyond it both tables are shuffled by bucket.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.runtime import materialize, table

ROWS_A_BUCKET = 8
LEAST_BUCKETS = 4096
BROADCAST_BUCKETS = 1_000_000  # unequal buckets in a broadcast: a number and two flags or three each, 50 MB at most


def _wide(*cols: Column) -> Column:
    """A wide additive hash: two 64-bit hashes as one decimal below 10^38 / 2^..; nulls and values never collide by position."""
    tagged = [x for c in cols for x in (c.isNull(), c)]
    a = F.pmod(F.xxhash64(*tagged), F.lit(10**13)).cast("decimal(13,0)")
    b = F.pmod(F.xxhash64(F.lit("second"), *tagged), F.lit(10**13)).cast("decimal(13,0)")
    return (a * F.lit(10**13).cast("decimal(14,0)") + b).cast("decimal(27,0)")


def differences(left: DataFrame, right: DataFrame, keys: list[str], values: list[str], names: tuple[str, str], buckets: int | None = None, most: int = BROADCAST_BUCKETS) -> DataFrame:
    """(keys..., finding): `only_in_<left>`, `only_in_<right>`, or a value column's name for every key on both sides
    whose stored values differ in any way (null equals only null).

    Keys with a null in them are compared like any other key (null equals null). Repeated deliveries of a key are
    expected to agree; where they do not, the least value stands for the key. Extra columns are ignored.
    """
    buckets = buckets or max(LEAST_BUCKETS, left.count() // ROWS_A_BUCKET)
    bucket = F.pmod(F.xxhash64(*keys), F.lit(buckets))

    def hashed(df: DataFrame, side: str) -> DataFrame:
        each = df.select(*keys, *(_wide(*(F.col(k) for k in keys), F.col(v)).alias(f"h_{v}") for v in values))
        one = each.groupBy(*keys).agg(*(F.min(f"h_{v}").alias(f"h_{v}") for v in values))
        return one.select(bucket.alias("bucket"), F.lit(side).alias("side"), _wide(*(F.col(k) for k in keys)).alias("h_key"), *(f"h_{v}" for v in values))

    sums = (
        hashed(left, "l").unionByName(hashed(right, "r")).groupBy("bucket")
        .agg(*(
            (F.coalesce(F.sum(F.when(F.col("side") == "l", F.col(f"h_{c}"))), F.lit(0)) != F.coalesce(F.sum(F.when(F.col("side") == "r", F.col(f"h_{c}"))), F.lit(0))).alias(f"d_{c}")
            for c in ("key", *values)
        ))
    )
    unequal = materialize(sums.where(reduce(lambda a, b: a | b, (F.col(f"d_{c}") for c in ("key", *values)))))
    unequal = F.broadcast(unequal) if unequal.count() <= most else unequal.hint("merge")

    def suspect(df: DataFrame, side: str) -> DataFrame:
        rows = df.select(*keys, *values, bucket.alias("bucket")).join(unequal, "bucket")
        # a column whose sums agree in the bucket is not carried on
        rows = rows.select(*keys, *(F.when(F.col(f"d_{v}") | F.col("d_key"), F.col(v)).alias(v) for v in values))
        return rows.groupBy(*keys).agg(*(F.min(v).alias(f"{side}_{v}") for v in values), F.lit(True).alias(f"{side}_here"))

    l = suspect(left, "l")
    r = suspect(right, "r").withColumnsRenamed({k: f"r_key_{k}" for k in keys})  # both may come from one table
    on = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"r_key_{k}")) for k in keys))
    met = l.join(r, on, "full_outer").select(
        *(F.when(F.col("l_here"), F.col(k)).otherwise(F.col(f"r_key_{k}")).alias(k) for k in keys), "l_here", "r_here", *(f"{s}_{v}" for s in "lr" for v in values)
    )
    found = F.when(F.col("r_here").isNull(), F.array(F.lit(f"only_in_{names[0]}"))).when(F.col("l_here").isNull(), F.array(F.lit(f"only_in_{names[1]}"))).otherwise(
        F.array_compact(F.array(*(F.when(~F.col(f"l_{v}").eqNullSafe(F.col(f"r_{v}")), F.lit(v)) for v in values)))
    )
    return met.select(*keys, F.explode(found).alias("finding"))


def p3_found(spark, folder: str) -> DataFrame:
    verses = table(spark, folder, "verses").where("deleted_at is null")
    entries = table(spark, folder, "corpus_entries").where("source_kind = 'quran'")
    return differences(verses, entries, ["source_id", "sura", "aya"], ["text", "page_no"], ("verses", "entries"))


def p3_by_source(spark, folder: str) -> DataFrame:
    return p3_found(spark, folder).groupBy("source_id", "finding").agg(F.count(F.lit(1)).alias("n"))


_DIFF = """
WITH v AS (SELECT source_id, sura, aya, min(text) AS text, min(page_no) AS page_no FROM verses WHERE deleted_at IS NULL GROUP BY ALL),
e AS (SELECT source_id, sura, aya, min(text) AS text, min(page_no) AS page_no FROM corpus_entries WHERE source_kind = 'quran' GROUP BY ALL),
j AS (SELECT coalesce(v.source_id, e.source_id) AS source_id, coalesce(v.sura, e.sura) AS sura, coalesce(v.aya, e.aya) AS aya,
             v.rowid IS NULL AS no_v, e.rowid IS NULL AS no_e, v.text AS vt, e.text AS et, v.page_no AS vp, e.page_no AS ep
      FROM (SELECT *, 1 AS rowid FROM v) v FULL JOIN (SELECT *, 1 AS rowid FROM e) e
      ON v.source_id IS NOT DISTINCT FROM e.source_id AND v.sura IS NOT DISTINCT FROM e.sura AND v.aya IS NOT DISTINCT FROM e.aya),
f AS (SELECT source_id, sura, aya, 'only_in_verses' AS finding FROM j WHERE no_e
      UNION ALL SELECT source_id, sura, aya, 'only_in_entries' FROM j WHERE no_v
      UNION ALL SELECT source_id, sura, aya, 'text' FROM j WHERE NOT no_v AND NOT no_e AND vt IS DISTINCT FROM et
      UNION ALL SELECT source_id, sura, aya, 'page_no' FROM j WHERE NOT no_v AND NOT no_e AND vp IS DISTINCT FROM ep)
"""
SQL = {"p3_found": _DIFF + "SELECT * FROM f", "p3_by_source": _DIFF + "SELECT source_id, finding, count(*) AS n FROM f GROUP BY ALL"}
QUERIES = {"p3_found": p3_found, "p3_by_source": p3_by_source}
