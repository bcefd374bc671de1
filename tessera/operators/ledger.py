"""Hash-chained ledgers: append and verification."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import sha256
from ..plans.runtime import table

GENESIS = "0" * 64  # fixed value: what the first entry of a ledger names as its predecessor


def entry_digest(seq: int, prev: str, payload: str) -> str:
    """SHA-256 of the canonical JSON (sorted keys, compact) of an entry without its own digest."""
    return hashlib.sha256(json.dumps({"payload": payload, "prev_entry_sha256": prev, "seq": seq}, ensure_ascii=False, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def _recomputed() -> Column:
    body = F.to_json(F.struct(F.col("payload"), F.col("prev_entry_sha256"), F.col("seq")))
    return sha256(body)


def appended(entries: DataFrame, heads: DataFrame | None = None) -> DataFrame:
    """`entries(ledger, at, payload STRING)` to their chained form (ledger, seq, prev_entry_sha256, payload, entry_sha256).

    `heads(ledger, seq, entry_sha256)` holds the last entry of each verified ledger (see `verified`); others begin anew.
    Entries are taken in order of `at`, then payload. A chain is sequential by nature: entries are sorted by ledger and
    streamed through, one entry in memory at a time, so a long ledger costs time in one task but no memory. Null ledgers
    and payloads are left out.
    """
    usable = entries.where("ledger is not null and payload is not null").select("ledger", "at", "payload")
    start = (usable.select("ledger", "at", "payload", F.lit(None).cast("long").alias("seq"), F.lit(None).cast("string").alias("head")))
    if heads is not None:
        known = heads.select(F.col("ledger").alias("_l"), F.col("seq").alias("_s"), F.col("entry_sha256").alias("_h"))
        start = usable.join(known, F.col("ledger") == F.col("_l"), "left").select("ledger", "at", "payload", F.col("_s").cast("long").alias("seq"), F.col("_h").alias("head"))

    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ledger, seq, prev = object(), 0, GENESIS
        for batch in batches:
            rows = []
            for name, payload, begin, head in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3, 4))):
                if name != ledger:
                    ledger, seq, prev = name, begin or 0, head or GENESIS
                seq += 1
                digest = entry_digest(seq, prev, payload)
                rows.append((seq, prev, digest))
                prev = digest
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.string()), batch.column(2), pa.array([r[2] for r in rows], pa.string())],
                names=["ledger", "seq", "prev_entry_sha256", "payload", "entry_sha256"],
            )

    kind = entries.schema["ledger"].dataType.simpleString()
    out = f"ledger {kind}, seq long, prev_entry_sha256 string, payload string, entry_sha256 string"
    return start.repartition("ledger").sortWithinPartitions("ledger", "at", "payload").mapInArrow(chain, out)


def verified(register: DataFrame) -> DataFrame:
    """(ledger, n_entries, first_break, chain_valid): the least sequence number at which a ledger breaks, null without one.

    An entry breaks its ledger where its digest isn't that of its content, where it doesn't name the digest before it, or
    where its number isn't one more than the one before. Digests are recomputed in parallel; only the order needs a window.
    """
    w = Window.partitionBy("ledger").orderBy("seq")
    before = F.coalesce(F.lag("entry_sha256").over(w), F.lit(GENESIS))
    number = F.coalesce(F.lag("seq").over(w), F.lit(0)) + 1
    broken = ~(F.col("entry_sha256").eqNullSafe(_recomputed()) & F.col("prev_entry_sha256").eqNullSafe(before) & F.col("seq").eqNullSafe(number))
    each = register.withColumn("_broken", broken).groupBy("ledger").agg(F.count(F.lit(1)).alias("n_entries"), F.min(F.when(F.col("_broken"), F.col("seq"))).alias("first_break"))
    return each.withColumn("chain_valid", F.col("first_break").isNull())


def heads(register: DataFrame) -> DataFrame:
    """(ledger, seq, entry_sha256) of the last entry of every ledger whose chain holds; appending to another raises."""
    good = verified(register)
    bad = [r.ledger for r in good.where("not chain_valid").select("ledger").limit(10).collect()]
    if bad:
        raise ValueError(f"chains are broken: {bad}")
    return register.groupBy("ledger").agg(F.max(F.struct("seq", "entry_sha256")).alias("_m")).select("ledger", "_m.seq", "_m.entry_sha256")


def _events(s, d):
    return table(s, d, "events").select(F.col("user_id").alias("ledger"), F.col("event_id").alias("at"), F.concat_ws(":", F.col("event_id").cast("string"), "event_type").alias("payload"), "event_type")


def _tampered(s, d):
    """The chained events, the payload of every error changed after it was written."""
    register = appended(_events(s, d))
    return verified(register.withColumn("payload", F.when(F.col("payload").endswith(":error"), F.concat("payload", F.lit("?"))).otherwise(F.col("payload"))))


QUERIES = {"ledger_append": lambda s, d: appended(_events(s, d)), "ledger_verify": _tampered}
_CHAIN = """WITH RECURSIVE e AS (SELECT user_id AS ledger, event_id::VARCHAR || ':' || event_type AS payload, row_number() OVER (PARTITION BY user_id ORDER BY event_id, event_type) AS seq FROM events WHERE user_id IS NOT NULL),
c AS (SELECT ledger, 0::BIGINT AS seq, NULL::VARCHAR AS prev_entry_sha256, NULL::VARCHAR AS payload, repeat('0', 64) AS entry_sha256 FROM e WHERE seq = 1 UNION ALL
  SELECT e.ledger, e.seq, c.entry_sha256, e.payload, sha256('{"payload":"' || e.payload || '","prev_entry_sha256":"' || c.entry_sha256 || '","seq":' || e.seq || '}') FROM c JOIN e ON e.ledger = c.ledger AND e.seq = c.seq + 1)
"""
SQL = {
    "ledger_append": _CHAIN + "SELECT * FROM c WHERE seq > 0",
    "ledger_verify": _CHAIN + "SELECT ledger, count(*) AS n_entries, min(seq) FILTER (ends_with(payload, ':error')) AS first_break, count(*) FILTER (ends_with(payload, ':error')) = 0 AS chain_valid FROM c WHERE seq > 0 GROUP BY ledger",
}
