"""Problem 7: held-out evaluation texts that leaked into training text.

Method: Wu-Manber multi-pattern search on folded words. The patterns are all runs of `n` consecutive words of the
items (or all words of a shorter item), grouped by their length m. A block is two words. The shift table says for
every block that occurs in a pattern how far the window may move at least; a block that occurs nowhere moves it by
the whole m - 1 words. Where the shift is 0, the block selects the bucket of patterns that end with it, and direct
comparison of all m words confirms.

Items are the stated query set: they are taken in blocks of a documented size, so the tables that travel to the
executors stay bounded, and every block is searched in all documents. A block's result is written and its tables are
given up before the next block is read, so neither the driver nor an executor holds more than one. Documents are never
shuffled.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.runtime import materialize, spread, table

RUN = 10
#: Characters of item text in one pass (and one item more); their tables take about 100 MB of Python memory.
CHARS_AT_ONCE = 2_000_000

WORD = re.compile(r"[^\W_]+")


def _unseen() -> re.Pattern:
    """By rule over planes 0 and 1: combining marks and invisible format characters."""
    spans: list[list[int]] = []
    for o in [*range(0x80, 0xD800), *range(0xE000, 0x20000), *range(0xE0000, 0xE0200)]:
        kind = unicodedata.category(chr(o))
        if kind[0] == "M" or kind == "Cf":
            if spans and spans[-1][1] == o - 1:
                spans[-1][1] = o
            else:
                spans.append([o, o])
    return re.compile("[" + "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in spans) + "]+")


UNSEEN = _unseen()


def words(text: str) -> list[str]:
    """Runs of letters and digits without case, combining marks, compatibility forms and invisible characters."""
    if text.isascii():
        return WORD.findall(text.lower())
    text = unicodedata.normalize("NFKD", unicodedata.normalize("NFKD", text).casefold())
    return WORD.findall(UNSEEN.sub("", text).replace("ı", "i"))


class Matcher:
    """Shift table and suffix buckets of the patterns of one length."""

    def __init__(self, m: int, patterns: dict[tuple[str, ...], set[int]]):
        self.m, self.block = m, min(2, m)
        self.skip = m - self.block + 1
        self.shift: dict[tuple[str, ...], int] = {}
        self.bucket: dict[tuple[str, ...], dict[tuple[str, ...], set[int]]] = {}
        for p, items in patterns.items():
            for end in range(self.block, m + 1):
                b = p[end - self.block : end]
                self.shift[b] = min(self.shift.get(b, self.skip), m - end)
            self.bucket.setdefault(p[m - self.block :], {})[p] = items

    def find(self, text: list[str]) -> set[int]:
        m, block, skip, shift, found = self.m, self.block, self.skip, self.shift, set()
        at, n = m, len(text)
        while at <= n:
            tail = tuple(text[at - block : at])
            step = shift.get(tail, skip)
            if step:
                at += step
                continue
            hit = self.bucket[tail].get(tuple(text[at - m : at]))
            if hit:
                found |= hit
            at += 1
        return found


def matchers(items: list[tuple[int, str]], n: int) -> list[Matcher]:
    by: dict[int, dict[tuple[str, ...], set[int]]] = {}
    for item, text in items:
        w = words(text)
        m = min(n, len(w))
        for i in range(len(w) - m + 1 if m else 0):
            by.setdefault(m, {}).setdefault(tuple(w[i : i + m]), set()).add(item)
    return [Matcher(m, patterns) for m, patterns in sorted(by.items())]


def _search(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = shared.value
        for batch in batches:
            docs: list[int] = []
            items: list[int] = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                w = words(text)
                hit = set().union(*(t.find(w) for t in tables))
                docs += [doc] * len(hit)
                items += hit
            yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(items, pa.int64())], names=["doc_id", "item_id"])

    return run


def _blocks(items: DataFrame, at_once: int) -> Iterator[list[tuple[int, str]]]:
    """The items, fetched one partition at a time, in blocks of about `at_once` characters."""
    block, size = [], 0
    for r in items.where("item_id is not null and text is not null").select("item_id", "text").toLocalIterator():
        block.append((r.item_id, r.text))
        size += len(r.text)
        if size >= at_once:
            yield block
            block, size = [], 0
    if block:
        yield block


def leaks(documents: DataFrame, items: DataFrame, n: int = RUN, at_once: int = CHARS_AT_ONCE) -> DataFrame:
    """`documents(doc_id BIGINT, text)`, `items(item_id BIGINT, text)` to (doc_id, item_id): the document has `n`
    consecutive words of the item, or all words of an item of fewer.

    Null ids and texts, and items without a word, match nothing; a doc_id that occurs twice gives its rows once.
    """
    spark = documents.sparkSession
    docs = spread(documents.where("doc_id is not null and text is not null").select("doc_id", "text"))
    found = []
    for block in _blocks(items, at_once):
        tables = spark.sparkContext.broadcast(matchers(block, n))
        found.append(materialize(docs.mapInArrow(_search(tables), "doc_id long, item_id long")))
        tables.destroy()
    return reduce(DataFrame.unionByName, found).distinct() if found else spark.createDataFrame([], "doc_id long, item_id long")


def p7_found(spark, folder: str) -> DataFrame:
    return leaks(table(spark, folder, "documents"), table(spark, folder, "eval_items"))


def p7_items(spark, folder: str) -> DataFrame:
    """Of every item, in how many documents it leaked (0 too)."""
    items = table(spark, folder, "eval_items")
    n = p7_found(spark, folder).groupBy("item_id").agg(F.count(F.lit(1)).alias("n_docs"))
    return items.select("item_id", "benchmark_id", "split").join(n, "item_id", "left").fillna(0, ["n_docs"])
