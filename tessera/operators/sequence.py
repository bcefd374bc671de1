"""Ordered-row operators: hash chains, islands, ranks, states, quotas and slots, running order checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import stable_id
from ..plans.running import RANGE_BITS, greatest_before, ranked
from ..plans.runtime import table


def chain_breaks(rows: DataFrame, ledger: str, seq: str, prev: str, digest: str) -> DataFrame:
    """(ledger, n_entries, first_break): the first sequence number whose stored previous digest isn't its predecessor's.

    The first entry's stored previous digest must be empty (null). Chains are independent, so each is one window.
    """
    w = Window.partitionBy(ledger).orderBy(seq)
    broken = ~F.col(prev).eqNullSafe(F.lag(digest).over(w))
    return rows.withColumn("_b", broken).groupBy(ledger).agg(F.count(F.lit(1)).alias("n_entries"), F.min(F.when(F.col("_b"), F.col(seq))).alias("first_break"))


def islands(rows: DataFrame, by: str, value: str) -> DataFrame:
    """(by, start, stop, n): maximal half-open ranges of consecutive integers; repeats count once.

    Ranges are found inside blocks of numbers first; only those that touch a block's edge, two a block at most, are
    then joined over the edges.
    """
    one = rows.where(F.col(value).isNotNull()).select(by, value).distinct().withColumn("_block", F.shiftright(F.col(value).cast("long"), RANGE_BITS))
    w = Window.partitionBy(by, "_block").orderBy(value)
    local = one.withColumn("_g", F.col(value) - F.row_number().over(w)).groupBy(by, "_block", "_g").agg(
        F.min(value).alias("start"), (F.max(value) + 1).alias("stop"), F.count(F.lit(1)).alias("n")
    ).drop("_block", "_g")
    edge = (F.col("start") % (1 << RANGE_BITS) == 0) | (F.col("stop") % (1 << RANGE_BITS) == 0)
    order = Window.partitionBy(by).orderBy("start")
    opens = F.coalesce((F.col("start") != F.lag("stop").over(order)).cast("int"), F.lit(1))
    joined = local.where(edge).withColumn("_new", opens).withColumn("_i", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    whole = joined.groupBy(by, "_i").agg(F.min("start").alias("start"), F.max("stop").alias("stop"), F.sum("n").alias("n")).drop("_i")
    return local.where(~edge).unionByName(whole)


def round_robin(slots: DataFrame, by: str, order: str, n: int) -> DataFrame:
    """Adds `lane`: the k-th slot of a group gets lane k mod n."""
    return ranked(slots, by, order, "_k").withColumn("lane", (F.col("_k") - 1) % n).drop("_k")


def current_state(decisions: DataFrame, by: str, seq: str, decision: str, full: str, default: str, rejected: str, quarantined: str) -> DataFrame:
    """(by, state): the latest full-scope decision, unless a quarantine of a record stands; a rejection outweighs both."""
    s = decisions.groupBy(by).agg(
        F.max_by(F.when(F.col(full), F.col(decision)), F.when(F.col(full), F.col(seq))).alias("latest"),
        F.bool_or(~F.col(full) & (F.col(decision) == quarantined)).alias("held"),
    )
    latest = F.coalesce("latest", F.lit(default))
    return s.select(by, F.when(latest == rejected, rejected).when(F.col("held"), quarantined).otherwise(latest).alias("state"))


def overlaps(spans: DataFrame, by: str, start: str, end: str) -> DataFrame:
    """(by, n_spans, n_overlaps, n_gaps) of spans in order: a span that begins before the furthest end so far, or after it."""
    reach = greatest_before(spans, by, [start, end], end, "_r", bits=6)
    return reach.groupBy(by).agg(F.count(F.lit(1)).alias("n_spans"), F.count_if(F.col("_r") > F.col(start)).alias("n_overlaps"), F.count_if(F.col("_r") < F.col(start)).alias("n_gaps"))


def first_of_group(rows: DataFrame, by: list[str], order: str, n: int = 8) -> DataFrame:
    """The first `n` rows of every group in order, ranked; group limits are applied before the shuffle by the planner."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(order))).where(F.col("rank") <= n)


def quotas(sources: DataFrame, source: str, total: int) -> DataFrame:
    """(source, quota): equal parts of `total`, the remainder one each to the first sources in order."""
    names = sources.where(F.col(source).isNotNull()).select(source).distinct()
    ranked = names.withColumn("_k", F.row_number().over(Window.orderBy(source)) - 1)  # a list of names, one row each
    n = names.agg(F.count(F.lit(1)).alias("_n"))
    share = F.floor(F.lit(total) / F.col("_n")) + F.when(F.col("_k") < F.lit(total) % F.col("_n"), 1).otherwise(0)
    return ranked.crossJoin(F.broadcast(n)).select(source, share.cast("long").alias("quota"))


def slots(plan: DataFrame, source: str, part: str = "primary") -> DataFrame:
    """One row per slot of `plan(source, quota)`, with ids like `primary:source:0001`."""
    return plan.where("quota > 0").select(source, F.explode(F.sequence(F.lit(1), F.col("quota").cast("int"))).alias("slot")).withColumn(
        "slot_id", F.concat_ws(":", F.lit(part), source, F.lpad(F.col("slot").cast("string"), 4, "0"))
    )


def _ledger(s, d):
    """Events as one ledger per user: digests follow arrival, sequence numbers may not."""
    e = table(s, d, "events").select("user_id", "event_id", "ts", stable_id("", F.col("event_id"), F.col("event_type"), digits=16).alias("digest"))
    return e.withColumn("prev", F.lag("digest").over(Window.partitionBy("user_id").orderBy("ts", "event_id")))


def _decisions(s, d):
    return table(s, d, "events").select(
        "user_id", "event_id", (F.col("event_type") != "click").alias("full"),
        F.when(F.col("event_type") == "click", "RECORD_QUARANTINED").when(F.col("event_type") == "error", "SOURCE_REJECTED").otherwise(F.upper("event_type")).alias("decision"),
    )


def _sources(s, d):
    return table(s, d, "documents").select("source")


QUERIES = {
    "hash_chain": lambda s, d: chain_breaks(_ledger(s, d), "user_id", "event_id", "prev", "digest"),
    "islands": lambda s, d: islands(table(s, d, "events"), "event_type", "event_id"),
    "round_robin": lambda s, d: round_robin(table(s, d, "events").select("event_id", "event_type"), "event_type", "event_id", 7),
    "current_state": lambda s, d: current_state(_decisions(s, d), "user_id", "event_id", "decision", "full", "UNREVIEWED", "SOURCE_REJECTED", "RECORD_QUARANTINED"),
    "overlaps": lambda s, d: overlaps(table(s, d, "documents").where("published_at is not null").select("source", F.unix_date(F.col("published_at").cast("date")).alias("a"), F.unix_date(F.col("collected_at").cast("date")).alias("b")), "source", "a", "b"),
    "first_of_group": lambda s, d: first_of_group(table(s, d, "documents").select("doc_id", "lang", "source"), ["lang", "source"], "doc_id"),
    "quotas": lambda s, d: quotas(_sources(s, d), "source", 1000),
    "slot_plan": lambda s, d: slots(quotas(_sources(s, d), "source", 1000), "source"),
}
_Q = "WITH n AS (SELECT DISTINCT source FROM documents WHERE source IS NOT NULL), q AS (SELECT source, (1000 // (SELECT count(*) FROM n) + CASE WHEN row_number() OVER (ORDER BY source) - 1 < 1000 % (SELECT count(*) FROM n) THEN 1 ELSE 0 END)::BIGINT AS quota FROM n)"
SQL = {
    "hash_chain": "WITH e AS (SELECT user_id, event_id, ts, substr(sha256(event_id::VARCHAR || chr(31) || event_type || chr(31)), 1, 16) AS digest FROM events), p AS (SELECT *, lag(digest) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev FROM e), b AS (SELECT *, lag(digest) OVER (PARTITION BY user_id ORDER BY event_id) AS want FROM p) SELECT user_id, count(*) AS n_entries, min(event_id) FILTER (prev IS DISTINCT FROM want) AS first_break FROM b GROUP BY user_id",
    "islands": "WITH g AS (SELECT event_type, event_id, event_id - row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS g FROM events) SELECT event_type, min(event_id) AS start, max(event_id) + 1 AS stop, count(*) AS n FROM g GROUP BY event_type, g",
    "round_robin": "SELECT event_id, event_type, (row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1) % 7 AS lane FROM events",
    "current_state": "WITH s AS (SELECT user_id, max_by(event_type, event_id) FILTER (event_type <> 'click') AS t, bool_or(event_type = 'click') AS h FROM events GROUP BY user_id) SELECT user_id, CASE WHEN t = 'error' THEN 'SOURCE_REJECTED' WHEN h THEN 'RECORD_QUARANTINED' ELSE coalesce(upper(t), 'UNREVIEWED') END AS state FROM s",
    "overlaps": "WITH e AS (SELECT source, published_at::DATE - DATE '1970-01-01' AS a, collected_at::DATE - DATE '1970-01-01' AS b FROM documents WHERE published_at IS NOT NULL), r AS (SELECT *, max(b) OVER (PARTITION BY source ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS r FROM e) SELECT source, count(*) AS n_spans, count(*) FILTER (r > a) AS n_overlaps, count(*) FILTER (r < a) AS n_gaps FROM r GROUP BY source",
    "first_of_group": "SELECT doc_id, lang, source, row_number() OVER (PARTITION BY lang, source ORDER BY doc_id) AS rank FROM documents QUALIFY rank <= 8",
    "quotas": _Q + " SELECT * FROM q",
    "slot_plan": _Q + " SELECT source, slot, 'primary:' || source || ':' || lpad(slot::VARCHAR, 4, '0') AS slot_id FROM (SELECT source, unnest(range(1, quota + 1)) AS slot FROM q)",
}
