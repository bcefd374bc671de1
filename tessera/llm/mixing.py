"""Problem 8: mixing sources to target weights.

Method: hierarchical budgeting. Sources are the leaves of a tree domain - language - source. A node's weight is the sum
of its leaves' target shares; weights are propagated as token budgets from the root. A leaf can give at most its
tokens times its allowed repeats; what it falls short of is redistributed among its siblings with room (in proportion
to their weights), what the language can't take among the domain's other languages, and only then among the other
domains. A leaf's allocation is then taken as a prefix of seeded epochs: whole passes over its documents, and of the
last pass the documents in seeded order until the tokens are reached.

Tokens are counted once, in Arrow batches. The budget works on one row per source (the targets are a small table by
nature; its size is checked). The prefix is a two-level sum: documents fall in ranges of their seeded order, whose
totals are summed first, so a source with a third of all documents is spread over many tasks.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.runtime import materialize, spread, table

TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
SEED = 20_240_501
RANGE_BITS = 10  # a source is split into 2^10 ranges of its seeded order
MOST_TARGETS = 100_000
# Fixed value: the published split pattern of the byte-level tokenizers.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(maxsize=2)
def encoding(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def _count(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoding(path).encode_ordinary
        for batch in batches:
            counts = [len(encode(t)) for t in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(counts, pa.int64())], names=[*batch.schema.names[:-1], "n_tokens"])

    return run


def counted(documents: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """`documents(doc_id, source, lang, text)` to (doc_id, source, lang, n_tokens); null texts give no row."""
    kinds = ", ".join(f"{c} {documents.schema[c].dataType.simpleString()}" for c in ("doc_id", "source", "lang"))
    return spread(documents.where("text is not null").select("doc_id", "source", "lang", "text")).mapInArrow(_count(tokenizer), f"{kinds}, n_tokens long")


def _fill(nodes: list[dict], amount: float) -> float:
    """Give `amount` to leaves with room, in proportion to their weights; returns what no leaf could take."""
    while amount > 1e-9:
        open_ = [n for n in nodes if n["room"] > 1e-9]
        weight = sum(n["weight"] for n in open_)
        if not open_:
            break
        given = 0.0
        for n in open_:
            part = min(n["room"], amount * (n["weight"] / weight if weight else 1 / len(open_)))
            n["room"] -= part
            n["given"] += part
            given += part
        amount -= given
        if given <= 1e-9:
            break
    return max(0.0, amount)


def budgets(leaves: list[dict], total: float) -> dict[str, float]:
    """Tokens for each leaf {source, domain, lang, weight, capacity} of the tree, shortages redistributed bottom up."""
    whole = sum(x["weight"] for x in leaves)
    short_by: dict[tuple, float] = {}
    for x in leaves:
        want = total * x["weight"] / whole if whole else 0.0
        x["given"] = min(want, x["capacity"])
        x["room"] = x["capacity"] - x["given"]
        node = (x["domain"], x["lang"])
        short_by[node] = short_by.get(node, 0.0) + want - x["given"]
    for level in (2, 1, 0):  # siblings in a language, languages of a domain, domains
        up: dict[tuple, float] = {}
        for node, amount in sorted(short_by.items(), key=lambda kv: tuple(str(k) for k in kv[0])):
            inside = [x for x in leaves if (x["domain"], x["lang"])[:level] == node[:level]]
            rest = _fill(inside, amount)
            if level:
                up[node[: level - 1]] = up.get(node[: level - 1], 0.0) + rest
        short_by = up
    return {x["source"]: x["given"] for x in leaves}


def mixture(documents: DataFrame, targets: DataFrame, tokenizer: str = TOKENIZER, seed: int = SEED, total: int | None = None) -> tuple[DataFrame, DataFrame]:
    """`documents(doc_id, source, lang, text)`, `targets(source, target_share, max_repeats)` to (chosen, report).

    chosen: (doc_id, source, n_tokens, copies), copies at least 1 and at most the source's max_repeats.
    report: one row per target with the tokens available, budgeted and taken, and the share reached; `most_total` is the
    greatest total at which the source can still have its share (null without one), the least of them reaches all targets.

    `total` tokens are wanted; unset, as many as the documents of all targets have. The domain is the part of a
    source's name after its last hyphen, its language the one with most tokens. Documents without a source or of no
    target, and without a token, are never chosen. A source with no documents gets nothing; its share goes to its
    siblings first. Null shares and repeats count as 0; a source named twice has its shares added, its repeats the
    least of both. The tokens taken differ from the budget by at most half of one document for each source.
    """
    spark = documents.sparkSession
    goals = targets.where("source is not null").groupBy("source").agg(
        F.sum(F.greatest(F.coalesce("target_share", F.lit(0.0)), F.lit(0.0))).alias("target_share"),
        F.min(F.greatest(F.coalesce("max_repeats", F.lit(0)), F.lit(0))).alias("max_repeats"),
    )
    rows = goals.limit(MOST_TARGETS + 1).collect()
    if len(rows) > MOST_TARGETS:
        raise ValueError(f"more than {MOST_TARGETS} sources have a target")
    wanted = F.broadcast(spark.createDataFrame([(r.source,) for r in rows], "source string"))  # at most MOST_TARGETS names
    tokens = materialize(counted(documents.join(wanted, "source", "left_semi"), tokenizer).where("n_tokens > 0"))
    by = tokens.groupBy("source", "lang").agg(F.sum("n_tokens").alias("n")).groupBy("source").agg(
        F.sum("n").alias("available"), F.max(F.struct("n", "lang")).alias("most")
    )
    have = {r.source: (r.available, r.most.lang) for r in by.collect()}  # at most one row per target
    leaves = [
        {
            "source": r.source, "domain": r.source.rpartition("-")[2], "lang": have.get(r.source, (0, None))[1],
            "weight": r.target_share, "capacity": float(have.get(r.source, (0, None))[0] * r.max_repeats), "repeats": r.max_repeats,
            "available": have.get(r.source, (0, None))[0],
        }
        for r in rows
    ]
    given = budgets(leaves, float(sum(x["available"] for x in leaves) if total is None else total))
    plan = []
    for x in leaves:
        whole = int(given[x["source"]] // x["available"]) if x["available"] else 0
        plan.append((x["source"], x["weight"], int(x["repeats"]), int(x["available"]), given[x["source"]], min(whole, int(x["repeats"])), given[x["source"]] - whole * x["available"]))
    allotted = F.broadcast(spark.createDataFrame(plan, "source string, target_share double, max_repeats int, available long, budget double, epochs int, rest double"))

    at = F.xxhash64(F.lit(seed), "doc_id", "n_tokens")
    drawn = tokens.join(allotted, "source").withColumn("at", F.xxhash64(at, "epochs")).withColumn("slot", F.shiftrightunsigned("at", 64 - RANGE_BITS))
    sums = drawn.groupBy("source", "slot").agg(F.sum("n_tokens").alias("n"))
    before = Window.partitionBy("source").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    offset = sums.select("source", "slot", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))  # 2^RANGE_BITS rows per source at most
    inside = Window.partitionBy("source", "slot").orderBy("at", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    placed = drawn.join(offset, ["source", "slot"]).withColumn("reach", F.col("offset") + F.sum("n_tokens").over(inside))
    more = (F.col("epochs") < F.col("max_repeats")) & (F.col("reach") - F.col("n_tokens") / 2 <= F.col("rest"))
    chosen = placed.select("doc_id", "source", "n_tokens", (F.col("epochs") + F.when(more, 1).otherwise(0)).alias("copies")).where("copies > 0")
    taken = chosen.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("taken"), F.count(F.lit(1)).alias("n_docs"), F.max("copies").alias("most_copies"))
    all_taken = Window.partitionBy()
    report = (
        allotted.join(taken, "source", "left").fillna(0, ["taken", "n_docs", "most_copies"])
        .select(
            "source", "target_share", "max_repeats", F.col("available").alias("available_tokens"),
            F.floor(F.try_divide(F.col("available") * F.col("max_repeats"), F.col("target_share"))).alias("most_total"), F.round("budget").cast("long").alias("budget_tokens"),
            F.col("taken").alias("taken_tokens"), "n_docs", "most_copies",
            F.round(F.col("taken") / F.nullif(F.sum("taken").over(all_taken), F.lit(0)), 6).alias("actual_share"),
        )
    )
    return chosen, report


def p8_mix(spark, folder: str) -> DataFrame:
    return mixture(table(spark, folder, "documents"), table(spark, folder, "mix_targets"))[0]


def p8_shares(spark, folder: str) -> DataFrame:
    return mixture(table(spark, folder, "documents"), table(spark, folder, "mix_targets"))[1]
