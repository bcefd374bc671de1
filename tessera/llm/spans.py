"""Problem 1: long exact spans that records have verbatim in common.

Method: super-k-mer partitioning. Every window of `k` code points has a minimiser, the least hash among its
pieces of `m` code points; consecutive windows with the same minimiser form one super-k-mer and travel as one
packed string to the bucket of that minimiser. Equal windows have equal minimisers, so they meet in one bucket,
where sorting the windows counts them exactly.

Plan, in order:
1. one scan gives the super-k-mers as numbers (minimiser, record, start, windows), without text; one of very many
   windows (repetitive text) is cut;
2. those of copies are dropped: a class of copies (one 128-bit digest) is stood for by its least id;
3. an aggregation by minimiser (combined on the map side) finds the buckets that two different texts reach; all
   others can hold no shared window and move no text;
4. each of these texts is fetched once and the strings of those buckets are packed;
5. buckets are sorted and counted; a bucket above `hot` windows is split into its single windows first, which
   spread over all tasks by their own hash and are joined natively, so no task holds a hot bucket;
6. only the first window of every longest common span of two texts gives a pair, so a long span gives one, and a window
   that a text repeats is joined once for each character before it.

The members of a class get their pairs back at the end.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.runtime import materialize, spread, table
from .codes import code_points, mixed, pieces, rolling, sliding_min

K, M = 150, 32
HOT = 400_000  # windows of a bucket that one task sorts
LONGEST = 4096  # windows of one super-k-mer


def super_kmers(codes: np.ndarray, starts: np.ndarray, k: int, m: int) -> tuple[np.ndarray, ...]:
    """(text number, minimiser, start in the text, windows) of every super-k-mer of all texts."""
    n = len(codes) - k + 1
    if n <= 0:
        return tuple(np.empty(0, t) for t in (np.int64, np.int64, np.int32, np.int32))
    least = sliding_min(rolling(codes, m), k - m + 1)
    inside = np.zeros(n + 1, np.int8)
    for a, b in zip(starts[:-1], starts[1:]):
        if b - a >= k:
            inside[a : b - k + 1] = 1
    first = inside[:n] == 1
    first[1:] &= (inside[: n - 1] == 0) | (least[1:] != least[:-1])
    ends_here = inside[:n] == 1
    ends_here[: n - 1] &= (inside[1:n] == 0) | (least[1:] != least[:-1])
    at, last = np.flatnonzero(first), np.flatnonzero(ends_here)
    if len(at) and (last - at).max() >= LONGEST:
        parts = (last - at) // LONGEST + 1
        step = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        at, last = np.repeat(at, parts) + step * LONGEST, np.repeat(last, parts)
        last = np.minimum(last, at + LONGEST - 1)
    text = np.searchsorted(starts, at, "right") - 1
    return text, least[at].view(np.int64), (at - starts[text]).astype(np.int32), (last - at + 1).astype(np.int32)


def _scan(k: int, m: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in pieces(batches, "text"):
            text, least, start, windows = super_kmers(*code_points(texts), k, m)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(text)), pa.array(least), pa.array(start), pa.array(windows)],
                names=["id", "mh", "start", "nwin"],
            )

    return run


def _pack(k: int):
    """Text and its wanted super-k-mers to packed strings; hot ones are cut into single windows keyed by their hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in pieces(batches, "text"):
            out: dict[str, list] = {c: [] for c in ("key", "id", "start", "nwin", "before", "packed", "hot")}

            def put(*row) -> None:
                for c, v in zip(out, row):
                    out[c].append(v)

            for id_, t, wanted in zip(batch.column(0).to_pylist(), texts, batch.column(2).to_pylist()):
                for w in wanted:
                    s, n = w["start"], w["nwin"]
                    packed = t[s : s + n + k - 1]
                    if not w["hot"]:
                        put(w["mh"], id_, s, n, ord(t[s - 1]) if s else -1, packed, False)
                        continue
                    digests = rolling(code_points([packed])[0], k).view(np.int64).tolist()
                    for j, d in enumerate(digests):
                        put(d, id_, s + j, 1, ord(t[s + j - 1]) if s + j else -1, packed[j : j + k], True)
            if out["key"]:
                yield pa.RecordBatch.from_pydict(out, schema=PACKED)

    return run


PACKED = pa.schema([("key", pa.int64()), ("id", pa.int64()), ("start", pa.int32()), ("nwin", pa.int32()), ("before", pa.int32()), ("packed", pa.string()), ("hot", pa.bool_())])
FOUND = pa.schema([("kind", pa.string()), ("a", pa.int64()), ("b", pa.int64()), ("s", pa.int32()), ("e", pa.int32())])


def count_bucket(key: np.ndarray, id_: np.ndarray, start: np.ndarray, before: np.ndarray, packed: list[str], k: int, with_pairs: bool = True):
    """Pairs of ids and shared runs (id, start, end) of whole buckets, by sorting their windows.

    A window that stands in two ids is shared. It gives a pair only where it is the first of a common span: the
    characters before it differ, or it begins a text.
    """
    codes, at = code_points(packed)
    row = np.repeat(np.arange(len(packed)), np.diff(at) - k + 1)
    first = np.zeros(len(packed), np.int64)
    np.cumsum((np.diff(at) - k + 1)[:-1], out=first[1:])
    offset = np.arange(len(row)) - first[row]
    place = at[row] + offset
    with np.errstate(over="ignore"):
        window = rolling(codes, k)[place] ^ mixed(key[row].view(np.uint64))
    order = np.lexsort((id_[row], window))
    window, row, offset, place = window[order], row[order], offset[order], place[order]
    new = np.ones(len(window), bool)
    new[1:] = window[1:] != window[:-1]
    head = np.flatnonzero(new)
    group = np.cumsum(new) - 1
    # exactness: every window of a group is compared with the group's first, character by character
    many = np.flatnonzero(np.diff(np.append(head, len(window)))[group] > 1)
    same = np.ones(len(many), bool)
    for j in range(k):
        same &= codes[place[many] + j] == codes[place[head[group[many]]] + j]
    if not same.all():  # two windows with one hash: number the windows of those groups by their characters
        bad = np.unique(group[many][~same])
        text = [None if g not in bad else packed[r][o : o + k] for g, r, o in zip(group.tolist(), row.tolist(), offset.tolist())]
        names: dict = {}
        number = np.array([names.setdefault((int(g), t), len(names)) for g, t in zip(group, text)])
        order = np.lexsort((id_[row], number))
        row, offset, number = row[order], offset[order], number[order]
        new = np.ones(len(number), bool)
        new[1:] = number[1:] != number[:-1]
        head, group = np.flatnonzero(new), np.cumsum(new) - 1
    ids = id_[row]
    tail = np.append(head[1:], len(ids)) - 1
    shared = (ids[head] != ids[tail])[group]
    prev = np.where(offset > 0, codes[np.maximum(at[row] + offset - 1, 0)].astype(np.int64), before[row])
    low, high = np.minimum.reduceat(prev, head), np.maximum.reduceat(prev, head)
    pairs: set[tuple[int, int]] = set()
    for g in np.flatnonzero((ids[head] != ids[tail]) & ((low != high) | (low == -1))).tolist() if with_pairs else ():
        lines = set(zip(ids[head[g] : tail[g] + 1].tolist(), prev[head[g] : tail[g] + 1].tolist()))
        for (a, p), (b, q) in combinations(sorted(lines), 2):
            if a != b and (p != q or p == -1):
                pairs.add((a, b))
    hit = np.flatnonzero(shared)
    r, p = row[hit], offset[hit] + start[row[hit]]
    order = np.lexsort((p, r))
    r, p = r[order], p[order]
    cut = np.ones(len(r), bool)
    cut[1:] = (r[1:] != r[:-1]) | (p[1:] != p[:-1] + 1)
    begin = np.flatnonzero(cut)
    end = np.append(begin[1:], len(r)) - 1
    runs = (id_[r[begin]], p[begin], p[end] + k) if len(r) else (np.empty(0, np.int64),) * 3
    return pairs, runs


def _count(k: int, with_pairs: bool = True, chars: int = 400_000):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list] = [[], [], [], [], []]
        size, last = 0, None

        def flush(n: int) -> pa.RecordBatch:
            key, id_, start, before, packed = (h[:n] for h in held)
            for h in held:
                del h[:n]
            pairs, (rid, rs, re_) = count_bucket(np.array(key, np.int64), np.array(id_, np.int64), np.array(start, np.int64), np.array(before, np.int64), packed, k, with_pairs)
            p = np.array(sorted(pairs), np.int64).reshape(-1, 2)
            return pa.RecordBatch.from_arrays(
                [
                    pa.array(["pair"] * len(p) + ["run"] * len(rid), pa.string()),
                    pa.array(np.concatenate([p[:, 0], rid]), pa.int64()),
                    pa.array(np.concatenate([p[:, 1], rid]), pa.int64()),
                    pa.array(np.concatenate([np.zeros(len(p), np.int64), rs]).astype(np.int32)),
                    pa.array(np.concatenate([np.zeros(len(p), np.int64), re_]).astype(np.int32)),
                ],
                schema=FOUND,
            )

        for batch in batches:
            for row in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("key", "id", "start", "before", "packed"))):
                if size > chars and row[0] != last:
                    yield flush(len(held[0]))
                    size = 0
                for h, v in zip(held, row):
                    h.append(v)
                size, last = size + len(row[4]), row[0]
        if held[0]:
            yield flush(len(held[0]))

    return run


def shared_spans(texts: DataFrame, k: int = K, m: int = M, hot: int = HOT, with_pairs: bool = True) -> tuple[DataFrame, DataFrame]:
    """`texts(id BIGINT, text STRING)` to (found, classes).

    `found(kind, a, b, s, e)`: kind `pair` for two ids (a < b) of different texts that share at least `k` code
    points, unless `with_pairs` is off; kind `run` for a piece [s, e) of record a whose windows stand in another text too.
    `classes(rep, id)`: the members of every class of exact copies of at least `k` code points, the rep (the
    least id) included; classes of one are left out, and only reps occur in `found`.

    Null ids and null texts, and texts shorter than `k`, take part in nothing. Ids are expected to be unique;
    two rows with one id count as one record. No bucket, partner or candidate is ever dropped.
    """
    long = texts.where(F.col("id").isNotNull() & (F.length("text") >= k)).select("id", "text")
    digests = materialize(long.select("id", F.unhex(F.md5("text")).alias("td")))
    same = materialize(digests.groupBy("td").agg(F.min("id").alias("rep"), F.max("id").alias("top")))
    reps = same.select(F.col("rep").alias("id"))
    scanned = materialize(spread(long).mapInArrow(_scan(k, m), "id long, mh long, start int, nwin int").join(reps, "id", "left_semi"))
    wanted = materialize(
        scanned.groupBy("mh").agg(F.min("id").alias("lo"), F.max("id").alias("hi"), F.sum("nwin").alias("n"))
        .where("lo < hi").select("mh", (F.col("n") > hot).alias("hot"))
    )
    lists = scanned.join(wanted, "mh").groupBy("id").agg(F.collect_list(F.struct("mh", "start", "nwin", "hot")).alias("wanted"))
    packed = materialize(
        long.join(lists, "id").select("id", "text", "wanted")
        .mapInArrow(_pack(k), "key long, id long, start int, nwin int, before int, packed string, hot boolean")
    )
    cold = packed.where("not hot").repartition("key").sortWithinPartitions("key").mapInArrow(_count(k, with_pairs), "kind string, a long, b long, s int, e int")
    single = packed.where("hot").select("key", "packed", "id", "start", "before")
    kept = materialize(single.groupBy("key", "packed").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo < hi").select("key", "packed"))
    single = materialize(single.join(kept, ["key", "packed"]))
    firsts = materialize(single.select("key", "packed", "id", "before").distinct())
    a, b = firsts.alias("a"), firsts.alias("b")
    hot_pairs = a.join(
        b,
        F.expr("a.key = b.key and a.packed = b.packed and a.id < b.id and (a.before <> b.before or a.before = -1)"),
    ).select(F.lit("pair").alias("kind"), F.col("a.id").alias("a"), F.col("b.id").alias("b"), F.lit(0).alias("s"), F.lit(0).alias("e"))
    hot_runs = single.select(F.lit("run").alias("kind"), F.col("id").alias("a"), F.col("id").alias("b"), F.col("start").alias("s"), (F.col("start") + k).alias("e"))
    classes = digests.join(same.where("rep < top").select("td", "rep"), "td").select("rep", "id").distinct()
    found = cold.unionByName(hot_pairs) if with_pairs else cold
    return materialize(found.unionByName(hot_runs)), classes


def span_pairs(texts: DataFrame, k: int = K, m: int = M, hot: int = HOT) -> DataFrame:
    """(id_a, id_b): every two ids, id_a < id_b, whose texts share at least `k` consecutive code points, copies included."""
    found, classes = shared_spans(texts, k, m, hot)
    classes = materialize(classes)
    pairs = found.where("kind = 'pair'").select("a", "b").distinct()
    for side in ("a", "b"):
        pairs = (
            pairs.join(classes.select(F.col("rep").alias(side), F.col("id").alias("copy")), side, "left")
            .withColumn(side, F.coalesce("copy", side)).drop("copy")
        )
    x, y = classes.alias("x"), classes.alias("y")
    within = x.join(y, F.expr("x.rep = y.rep and x.id < y.id")).select(F.col("x.id").alias("a"), F.col("y.id").alias("b"))
    return pairs.unionByName(within).select(F.least("a", "b").alias("id_a"), F.greatest("a", "b").alias("id_b"))


def span_links(texts: DataFrame, k: int = K, m: int = M, hot: int = HOT) -> DataFrame:
    """(kind, id_a, id_b): `pair` for two class representatives that share a span, `member` for a representative and each copy.

    The pairs of `span_pairs` without copies expanded: a class of any size is one row a member.
    """
    found, classes = shared_spans(texts, k, m, hot)
    pairs = found.where("kind = 'pair'").select("kind", F.col("a").alias("id_a"), F.col("b").alias("id_b")).distinct()
    return pairs.unionByName(classes.where("rep <> id").select(F.lit("member").alias("kind"), F.col("rep").alias("id_a"), F.col("id").alias("id_b")))


def span_shares(texts: DataFrame, k: int = K, m: int = M, hot: int = HOT) -> DataFrame:
    """(id, n_chars, shared_chars, n_runs): of every record with a text, how much stands in other records too.

    A copy of another record's text (of at least `k` code points) is shared as a whole; null texts give no row,
    shorter ones 0 shared characters.
    """
    found, classes = shared_spans(texts, k, m, hot, with_pairs=False)
    classes = materialize(classes)
    runs = found.where("kind = 'run'").select(F.col("a").alias("id"), "s", "e")
    reach = Window.partitionBy("id").orderBy("s", "e").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.withColumn("to", F.coalesce(F.max("e").over(reach), F.lit(0)))
    merged = runs.groupBy("id").agg(
        F.sum(F.greatest(F.lit(0), F.col("e") - F.greatest("s", "to"))).alias("part"),
        F.sum(F.when(F.col("s") > F.col("to"), 1).when((F.col("s") == 0) & (F.col("to") == 0), 1).otherwise(0)).alias("n_runs"),
    )
    whole = classes.select("id", F.lit(True).alias("whole"))
    n = texts.where(F.col("id").isNotNull() & F.col("text").isNotNull()).select("id", F.length("text").alias("n_chars"))
    return (
        n.join(merged, "id", "left").join(whole, "id", "left")
        .select(
            "id", F.col("n_chars").cast("long").alias("n_chars"),
            F.when(F.col("whole"), F.col("n_chars")).otherwise(F.coalesce("part", F.lit(0))).cast("long").alias("shared_chars"),
            F.when(F.col("whole"), 1).otherwise(F.coalesce("n_runs", F.lit(0))).cast("long").alias("n_runs"),
        )
    )


def p1_found(spark, folder: str) -> DataFrame:
    return span_pairs(table(spark, folder, "tafsirs").select(F.col("tafsir_id").alias("id"), "text"))


def p1_links(spark, folder: str) -> DataFrame:
    return span_links(table(spark, folder, "tafsirs").select(F.col("tafsir_id").alias("id"), "text"))


def p1_shares(spark, folder: str) -> DataFrame:
    return span_shares(table(spark, folder, "tafsirs").select(F.col("tafsir_id").alias("id"), "text")).withColumnRenamed("id", "tafsir_id")
