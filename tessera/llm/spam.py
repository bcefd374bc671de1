"""Problem 9: keyword-stuffed pages, link lists and tag lists.

Method: phrase shingles and list density, joined. Every page's words are put down as words of sentences, words of lists
(links, tags, items between separators, lines without an end mark) or words of phrases that the page keeps repeating.
The shingles of five words of every sentence and line (short lines run together) are exploded and their hosts and
different texts counted over all documents. A phrase that stands on another host and in two other texts at least is
replicated. A page is stitched as far as its phrases are replicated in short pieces; a long run of them in one sentence
or line is a passage that others quote too, and no stitching. Both go into one evidence,

    bad share / DENSE + stitched share / STITCHED,

and a page is flagged where it reaches 1: a page of lists alone, a page of sentences only if nearly all its phrases are
replicated, and between them the more lists the fewer replicated phrases are needed.

Pages with one text count as one, so that a copy of an honest page, all of whose phrases stand on other hosts, is not
taken for a stitched one. Phrases are pre-aggregated on the map side, so one that a third of all pages share costs one
row per task. A page's phrases go to the join, and their hosts are looked at, only where a bitmap of fixed size doesn't
rule out that they stand in enough texts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.runtime import materialize, spread, table
from .codes import BASE, mixed, pieces
from .sentences import marked_units

SHINGLE = 5
DENSE = 0.7  # of the words in lists or repeated phrases: flagged without any replicated phrase
STITCHED = 0.8  # of the phrases replicated in short pieces: flagged without any list
PIECE = 8  # shingles (12 words) of the longest piece that is a phrase; more are a quoted passage
TEXTS = 3  # different texts with a replicated phrase, the page's own among them; a text and its revision are two
PHRASES = 20  # fewer are no evidence: terse notes may be all formula
SHORT = 3  # words of a sentence that counts as one phrase
SLOTS = 1 << 28  # bits, for phrases that are replicated
BROADCAST_TEXTS = 1_000_000  # digests of texts that occur more than once, 16 bytes each; beyond, all texts are grouped
REPEATS = 3  # a pair of words that occurs so often in one page counts as repeated ...
REPEATED_LEAST = 0.2  # ... where such pairs make up so much of the page; fewer are refrains and plain language

WORD = re.compile(r"[^\W_]+(?:['’\-][^\W_]+)*")
LINK = re.compile(
    r"<a\s[^>]*>.*?(?:</a>|$)|\[[^\]\n]*\]\([^)\s]*\)|(?:https?://|www\.)\S+|#\w+|\b(?-i:[a-z0-9][a-z0-9-]+(?:\.[a-z0-9-]{2,})*\.[a-z]{2,})\b(?:[/?:]\S*)?",
    re.I | re.M,
)
DOTTED = re.compile(r"[a-z0-9-]\.[a-z]{2}")
SEPARATOR = re.compile(r"\(\d+\)|[|>•·]")
ITEMS = re.compile(r"(?<![^\s|>•·()])(?:[^\s|>•·()]++(?:\s[^\s|>•·()]++){0,3}+\s*+(?:\(\d+\)|[|>•·])\s*+){5,}+")  # five items between separators, whatever ends the line
WRAPPED = 3  # lines at most, above the one that ends a sentence
LISTED = re.compile(r"[\d|#*•>/_]")
LONG_RUN = "⺀"
UNSPACED = re.compile("[฀-๿⺀-\U0010ffff]")


def weight(word: str) -> float:
    """Words in a run of letters: one, but about half its characters in scripts that put no spaces."""
    return max(1.0, len(word) / 2) if word[0] >= LONG_RUN or "฀" <= word[0] <= "๿" else 1.0


def spaced(word: str) -> list[str]:
    """Pieces of a run that stand for words: pairs of characters in scripts that put no spaces."""
    return [word] if weight(word) == 1.0 else [word[i : i + 2] for i in range(0, len(word), 2)]


class Memo(dict):
    """Hashes of words, each computed once."""

    def __missing__(self, word: str) -> int:
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def _shingles(h: np.ndarray, run: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, usable) for each word: of the five words from it on in its run; a run of fewer, but at least SHORT, is one phrase."""
    n = len(h)
    new = np.ones(n, bool)
    new[1:] = run[1:] != run[:-1]
    head = np.flatnonzero(new)
    size = np.diff(np.append(head, n))
    of = np.repeat(size, size)
    left = np.repeat(head + size, size) - np.arange(n)
    padded = np.append(h, np.zeros(SHINGLE, np.uint64))
    rolled, out, use = np.zeros(n, np.uint64), np.zeros(n, np.uint64), left >= SHINGLE
    with np.errstate(over="ignore"):
        for width in range(1, SHINGLE + 1):
            rolled = rolled * BASE + padded[width - 1 : width - 1 + n]
            if SHORT <= width < SHINGLE:
                whole = (of == width) & (left == width)
                out[whole], use = rolled[whole], use | whole
        return mixed(np.where(left >= SHINGLE, rolled, out)), use


def _wrapped(text: str, a: tuple[int, int], b: tuple[int, int]) -> bool:
    """Whether line `a` may be the wrapped beginning of the sentence in line `b`."""
    gap, line, then = text[a[1] : b[0]], text[a[0] : a[1]].lstrip("> "), text[b[0] : b[1]].lstrip("> ")
    return gap.strip() == "" and gap.count("\n") == 1 and len(line) < 120 and not LISTED.search(line) and not then[:1].isupper()


def _joined(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans in order, those that overlap made one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a < out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


class Batch:
    """The words of many texts in one list, with the sentences and lines they stand in."""

    def __init__(self) -> None:
        self.words: list[str] = []
        self.linked: list[int] = []  # words of sentences that stand in a link or between separators
        self.sizes: list[int] = []  # of each sentence or line, in words
        self.lists: list[bool] = []  # whether it is a line of a list
        self.runs: list[int] = []  # its number; short lines that run together have one

    def add(self, text: str) -> None:
        low = text.lower()
        spans = marked_units(text)
        same = len(low) == len(text)
        unspaced = UNSPACED.search(low) is not None
        hint = "#" in text or "://" in text or "](" in text or "<a" in low or "www." in low or DOTTED.search(text)
        links = [(m.start(), m.end()) for m in LINK.finditer(text)] if hint else []
        if len(SEPARATOR.findall(text)) >= 5:
            links = _joined(links + [(m.start(), m.end()) for m in ITEMS.finditer(text)])
        found_in = [WORD.findall(low, s, e) if same else [w.lower() for w in WORD.findall(text, s, e)] for s, e, _ in spans]
        sentence = [mark > 0 and (len(f) >= 3 or unspaced and sum(map(weight, f)) >= 3) for f, (_, _, mark) in zip(found_in, spans)]
        chain = 0
        for i in range(len(spans) - 2, -1, -1):  # a wrapped line belongs to the sentence that it begins
            chain = 0 if sentence[i] else chain
            if not sentence[i] and sentence[i + 1] and chain < WRAPPED and _wrapped(text, spans[i][:2], spans[i + 1][:2]):
                sentence[i], chain = True, chain + 1
        number, alone, at = self.runs[-1] if self.runs else 0, True, 0
        for (s, e, _), found, whole in zip(spans, found_in, sentence):
            own = whole or len(found) >= SHORT  # short lines run together
            number += own or alone
            alone = own
            while at < len(links) and links[at][1] <= s:
                at += 1
            touched = whole and at < len(links) and links[at][0] < e
            if unspaced or touched:
                inside = self._linked(text, s, e, links[at:]) if touched else ()
                begin = len(self.words)
                for i, w in enumerate(found):
                    parts = spaced(w) if unspaced else (w,)
                    if i in inside:
                        self.linked += range(len(self.words), len(self.words) + len(parts))
                    self.words += parts
                size = len(self.words) - begin
            else:
                self.words += found
                size = len(found)
            self.sizes.append(size)
            self.lists.append(not whole)
            self.runs.append(number)

    @staticmethod
    def _linked(text: str, s: int, e: int, links: list[tuple[int, int]]) -> set[int]:
        """Which words of a sentence begin in a link."""
        out, k = set(), 0
        for i, m in enumerate(WORD.finditer(text, s, e)):
            while k < len(links) and links[k][1] <= m.start():
                k += 1
            if k == len(links):
                break
            if links[k][0] <= m.start():
                out.add(i)
        return out


def pages(texts: list[str], memo: Memo) -> tuple[np.ndarray, ...]:
    """For each text: words, words in lists, words in lists or repeated phrases, phrases; and of all texts the different
    phrases of each in order, with a 0 between sentences or lines (so no phrase has the hash 0), and how many there are."""
    batch, ends = Batch(), []
    for t in texts:
        batch.add(t)
        ends.append(len(batch.words))
    if len(memo) > 100_000:
        memo.clear()
    words = batch.words
    size = np.diff(np.array([0, *ends]))
    page = np.repeat(np.arange(len(texts)), size)
    h = np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))
    of = np.array(batch.sizes, np.int64)
    in_list, number = np.repeat(np.array(batch.lists, bool), of), np.repeat(np.array(batch.runs, np.int64), of)
    in_list[batch.linked] = True
    repeated = np.zeros(len(words), bool)
    if len(words) > 1:
        with np.errstate(over="ignore"):
            pair = mixed((h[:-1] * BASE + h[1:]) ^ mixed(page[:-1].astype(np.uint64) + np.uint64(1)))
        valid = np.flatnonzero(page[1:] == page[:-1])
        _, index, count = np.unique(pair[valid], return_inverse=True, return_counts=True)
        often = valid[count[index] >= REPEATS]
        repeated[often] = repeated[often + 1] = True
        enough = np.bincount(page, repeated, len(texts)) >= REPEATED_LEAST * size
        repeated &= enough[page]
    phrase, use = _shingles(h, number) if words else (h, repeated)
    phrase, owner, number = phrase[use], page[use], number[use]
    phrase[phrase == 0] = np.uint64(1)
    # the different phrases of each page where they stand first
    first = np.sort(np.unique(phrase ^ mixed(owner.astype(np.uint64) + np.uint64(1)), return_index=True)[1])
    phrase, owner, number = phrase[first].view(np.int64), owner[first], number[first]
    n_phrases = np.bincount(owner, minlength=len(texts))
    gap = np.flatnonzero((number[1:] != number[:-1]) & (owner[1:] == owner[:-1])) + 1
    return (
        size.astype(np.float64), np.bincount(page, in_list, len(texts)), np.bincount(page, in_list | repeated, len(texts)), n_phrases,
        np.insert(phrase, gap, 0), n_phrases + np.bincount(owner[gap], minlength=len(texts)),
    )


def page(text: str) -> tuple[float, float, float]:
    """(words, words in lists, words in lists or repeated phrases) of one text."""
    n, lists, bad, *_ = pages([text], Memo())
    return float(n[0]), float(lists[0]), float(bad[0])


def _pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    memo = Memo()
    for batch, texts in pieces(batches, "text", 400_000):
        n, lists, bad, n_phrases, phrases, held = pages(texts, memo)
        offsets = np.zeros(len(texts) + 1, np.int32)
        np.cumsum(held, out=offsets[1:])
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(i) for i in range(3)), pa.array(n), pa.array(lists), pa.array(bad), pa.array(n_phrases, pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(phrases))],
            names=["digest", "low", "high", "n_words", "n_listed", "n_bad", "n_phrases", "phrases"],
        )


def _possible(shared):
    """The phrases of each page that may stand in enough texts, with the page's hosts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: np.ndarray = shared.value
        for batch in batches:
            column = batch.column(3)
            phrase = column.flatten().to_numpy(zero_copy_only=False)
            owner = np.repeat(np.arange(len(column)), column.value_lengths().to_numpy(zero_copy_only=False))
            slot = phrase & (SLOTS - 1)
            keep = ((words[slot >> 6] >> (slot & 63)) & 1 == 1) & (phrase != 0)
            of = pa.array(owner[keep])
            place = np.arange(len(phrase), dtype=np.int64)[keep]  # only its distance to others of the page counts
            yield pa.RecordBatch.from_arrays([*(batch.column(i).take(of) for i in range(3)), pa.array(phrase[keep]), pa.array(place)], names=["digest", "low", "high", "phrase", "place"])

    return run


def _bitmap(phrases: DataFrame) -> np.ndarray:
    """SLOTS bits in 64-bit words, set where a phrase falls; put together by Spark, so the driver gets SLOTS / 64 rows at most."""
    slot = F.col("phrase").bitwiseAND(F.lit(SLOTS - 1))
    rows = phrases.select(F.shiftright(slot, 6).alias("word"), F.expr("shiftleft(1L, cast(phrase & 63 as int))").alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    words = np.zeros(SLOTS >> 6, np.int64)
    words[rows["word"].to_numpy()] = rows["bits"].to_numpy()
    return words


def scored(documents: DataFrame, most: int = BROADCAST_TEXTS) -> DataFrame:
    """`documents(doc_id, source STRING, text STRING)` to (doc_id, n_words, list_share, bad_share, replicated_share, stitched_share, evidence, spam).

    The source is the host; a null source is a host of its own. Null texts give no row; texts without a word are not
    spam and have the evidence 0. `replicated_share` is that of a page's phrases that stand on two hosts and in three
    texts at least, `stitched_share` that of those in short pieces; both are null without a phrase.
    """
    host = F.xxhash64(F.coalesce("source", F.lit("")), F.col("source").isNull()).alias("host")
    digest_of_text = F.unhex(F.md5("text"))
    digest = digest_of_text.alias("digest")
    usable = documents.where("text is not null")
    # one row a text, of which only those that occur more than once have to be moved
    rows = spread(usable.select(host, "text"))
    twice = materialize(rows.groupBy(digest).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("digest"))
    once, several = None, rows
    if twice.count() <= most:
        keyed = rows.select(digest, F.col("host").alias("low"), F.col("host").alias("high"), "text")
        once = keyed.join(F.broadcast(twice), "digest", "left_anti")
        several = rows.join(F.broadcast(twice), digest_of_text.eqNullSafe(twice["digest"]), "left_semi")
    texts = several.groupBy("text").agg(F.min("host").alias("low"), F.max("host").alias("high")).select(digest, "low", "high", "text")
    judged = materialize(
        (texts if once is None else once.unionByName(texts))
        .mapInArrow(_pages, "digest binary, low long, high long, n_words double, n_listed double, n_bad double, n_phrases long, phrases array<long>")
    )
    # texts are counted for every phrase, hosts only for those in enough texts
    counted = judged.select(F.explode("phrases").alias("phrase")).where("phrase <> 0").groupBy("phrase").agg(F.count(F.lit(1)).alias("n"))
    often = materialize(counted.where(F.col("n") >= TEXTS).select("phrase"))
    bits = documents.sparkSession.sparkContext.broadcast(_bitmap(often))
    places = judged.select("digest", "low", "high", "phrases").mapInArrow(_possible(bits), "digest binary, low long, high long, phrase long, place long")
    places = materialize(places.join(often, "phrase"))
    wide = materialize(places.groupBy("phrase").agg(F.min("low").alias("low"), F.max("high").alias("high")).where("low <> high").select("phrase"))
    # replicated phrases that follow each other are one piece; a page's pieces are bounded by its text
    replicated = places.join(wide, "phrase").select("digest", "place")
    piece = F.col("place") - F.row_number().over(Window.partitionBy("digest").orderBy("place"))
    pieces_ = replicated.withColumn("piece", piece).groupBy("digest", "piece").agg(F.count(F.lit(1)).alias("n"))
    hits = pieces_.groupBy("digest").agg(F.sum("n").alias("n_replicated"), F.sum(F.when(F.col("n") <= PIECE, F.col("n")).otherwise(0)).alias("n_stitched"))
    share = lambda c: F.when(F.col("n_words") > 0, F.col(c) / F.col("n_words")).otherwise(0.0)
    n_phrases = F.col("n_phrases")
    scores = judged.select("digest", "n_words", "n_listed", "n_bad", "n_phrases")  # the phrases stay behind
    each_page = scores.join(hits, "digest", "left").select(
        "digest", F.col("n_words").cast("long").alias("n_words"), share("n_listed").alias("list_share"), share("n_bad").alias("bad_share"),
        *(F.when(n_phrases > 0, F.coalesce(f"n_{c}", F.lit(0)) / n_phrases).alias(f"{c}_share") for c in ("replicated", "stitched")), "n_phrases",
    )
    stitched = F.when(F.col("n_phrases") >= PHRASES, F.col("stitched_share")).otherwise(0.0)
    each_page = each_page.withColumn("evidence", F.col("bad_share") / DENSE + stitched / STITCHED).withColumn("spam", F.col("evidence") >= 1).drop("n_phrases")
    return usable.select("doc_id", digest).join(each_page, "digest").drop("digest")


def p9_found(spark, folder: str) -> DataFrame:
    return scored(table(spark, folder, "documents")).where("spam").select("doc_id")
