"""Problem 5: texts that were cut off by a field limit or in transfer.

Method: a backward character n-gram model. For every position of all texts (the last unit of each left out, since it
may be the cut one) the preceding characters are counted, per language, once as context and once as context of a
sentence's end (its end mark, before closing quotes). Contexts have 1 to 5 characters. The final context of a text gets the interpolated probability that a unit ends there rather than goes
on, and its log-odds are held against a threshold of its language: a tenth of the mean probability that the
language's own end characters have, so a language without end marks (Thai) gets a threshold that only a broken word
falls below.

What no character model can know is taken from structure first: lines that are closed by a line break or `<br>`,
headings, signature lines and list items are complete (the closing tag of a paragraph says nothing, it may be put
after a break); a quotation or bracket that stays open, an abbreviation, a
broken character and a comma are not.

The counts are combined per context on the map side and by Spark and stay a table of the shared folder, whatever its
size. The different final contexts of the texts that the model decides are joined with it, and their counts with the
texts. Only the counts of single characters go out as a broadcast.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.runtime import materialize, spread, table
from .codes import code_points, mixed, pieces, rolling
from .lookalike import canonical
from .sentences import BREAK, CLOSING, HIDDEN, HIDDEN_ONES, NEVER, QUOTED, THAI, WORDS_OF_ONE, _before, _depth, marked_units

ORDERS = (1, 2, 3, 4, 5)
PAD = max(ORDERS)
HELD = 4_000_000  # contexts in a task's memory; more are handed on in parts
PULL = 20.0  # weight of the shorter context's probability
FEW = 10  # ends below which a language takes the threshold of all together
PART = 0.1  # of the mean end probability, for the threshold

CLOSED = re.compile(rf"(?:[\n\r\u2028\u2029]|<br\s*/?>)[\s{HIDDEN}]*\Z", re.I)
PUT_AFTER = re.compile(rf"[\s{HIDDEN}]*(?:…|\.\.\.|\[\s*(?:…|\.\.\.)\s*\])[\s{HIDDEN}]*\Z")
TAGS = re.compile(r"</?\w+\s*/?>\s*\Z")
PARAGRAPH = re.compile(r"(?:</?p>\s*)+\Z", re.I)
SIGNATURE = re.compile(r"(?:[—–-]\s*[^\W\d]+(?:\s*,\s*\d+(?:[:/]\d+)?)?|[\[(]?[^\W\d]+,?\s\d+(?:[:/]\d+)?[\])])|[^\W\d]+,\s\d+:\d+")
HEADING = re.compile(r"[^\d\s.,:;!?()\[\]]+\s+\d+|第\s*\d+\s*[^\W\d]|[\u0e00-\u0e7f]+\d+")
ITEM = re.compile(r"\d{1,3}[.)．]\s*(?=\S)|[-*•]\s+(?=\S)")
ENDED = re.compile(rf"([.!?؟۔。！？।॥]+)((?:[{HIDDEN}]*[\"”»“«’'\)\]」』）】》]|[ \u00a0\u202f]»)*)\Z")


QUOTED_END = re.compile(rf"([!?؟۔。！？।॥]|(?<!\.)\.)(?=[{HIDDEN}]*[\"”»“«」』])")


SPACED = HIDDEN_ONES + " \u00a0\t"
MARKS = np.array([ord(c) for c in ".!?؟۔。！？।॥…"], np.uint32)


def group_of(lang: str | None, text: str) -> str:
    """The language a text is counted under: its own, or where that is unknown one by script."""
    if lang:
        return lang
    codes = code_points([text])[0]
    for name, low, high in (("th", "\u0e00", "\u0e7f"), ("zh", "一", "鿿"), ("hi", "ऀ", "ॿ"), ("ar", "\u0600", "ۿ")):
        if np.count_nonzero((codes >= ord(low)) & (codes <= ord(high))) * 3 > len(codes):
            return "ur" if name == "ar" and ("ے" in text or "ہ" in text) else name
    return "latin"


def last_line(text: str) -> str:
    """What stands after the last line break or tag."""
    at = max(text.rfind("\n"), text.rfind("\r"), text.rfind("\u2028"), text.rfind("\u2029")) + 1
    tag = len(text)
    while (tag := text.rfind("<", at, tag)) >= 0:
        if m := BREAK.match(text, tag):
            return text[m.end() :].strip()
    return text[at:].strip()


def structure(text: str) -> tuple[str, str]:
    """(`complete`, `cut` or `ask` the model; the text up to where it breaks off)."""
    body = text.rstrip()
    tagged = body.endswith(">")
    if not body or tagged and body.lstrip()[0] == "<" and not re.sub(r"<[^>]*>", "", text).strip():
        return "complete", text
    if body.endswith("\ufffd"):
        return "cut", body
    rest = PUT_AFTER.sub("", body) if body.rstrip(SPACED)[-1:] in "….]" else body
    marked = rest != body
    if not marked and (CLOSED.search(text) or tagged and CLOSED.search(PARAGRAPH.sub("", text))):
        return "complete", text
    while rest.endswith(">") and (m := TAGS.search(rest)) is not None:
        rest = rest[: m.start()].rstrip()
    rest = rest.rstrip(SPACED)
    line = last_line(rest)
    if not line:
        return "complete", rest
    shown = canonical(line).strip() if len(line.split(None, 4)) < 5 else ""  # neither has more than four words
    if SIGNATURE.fullmatch(shown) or HEADING.fullmatch(shown):
        return ("cut" if marked else "complete"), rest
    item = ITEM.match(line)
    end = ENDED.search(line)
    if item and not end and not marked:
        others = [x.strip() for x in BREAK.split(rest)[:-1] if ITEM.match(x.strip())]
        bare = sum(not ENDED.search(x) for x in others)
        if bare * 2 > len(others) if others else len(line.split()) <= 4:
            return "complete", rest
    if THAI.match(rest[-1]):
        return "ask", rest
    if QUOTED.search(line):
        start, stop, _ = marked_units(line)[-1]
        q, b = _depth(line[start:stop])
        if q or b:
            return "cut", rest
    if end and end[1] in (".", "۔") and not end[2]:
        token = _before(line, 0, end.start())
        token = token if token.isascii() else canonical(token)
        small = token.lower()
        if small in CLOSING:
            return "complete", rest
        if small in NEVER or token.isdigit() or len(token) == 1 and token not in WORDS_OF_ONE and token.isalpha():
            return "cut", rest
    return "ask", rest[: len(rest) - len(end[2])] if end else rest


def _language_key(name: str) -> int:
    h = 1469598103934665603
    for b in name.encode():
        h = (h ^ b) * 1099511628211 & ((1 << 64) - 1)
    return h


def _keys(hashes: np.ndarray, language: np.ndarray | np.uint64, order: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (mixed(hashes ^ mixed(np.atleast_1d(language) + np.uint64(order))) & ~np.uint64(1)).view(np.int64)  # the last bit is for `_count`


def _merge(parts: list[tuple[np.ndarray, np.ndarray]]) -> list[tuple[np.ndarray, np.ndarray]]:
    if len(parts) < 2:
        return parts
    key, index = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    return [(key, np.bincount(index, weights=np.concatenate([p[1] for p in parts]), minlength=len(key)).astype(np.int64))]


def _rows(key: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"lang": pa.nulls(len(key), pa.string()), "key": pa.array(key & ~np.int64(1)), "n": pa.array(n), "n_end": pa.array(n * (key & 1))})


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Context counts of one task: by hash for orders above 1, and rows (language, character) of order 1."""
    parts: list[tuple[np.ndarray, np.ndarray]] = []  # keys whose last bit says whether it was an end, and how often
    single: dict[tuple[str, str], list[int]] = {}
    for batch, texts in pieces(batches, "text", 500_000):
        names = [group_of(n, t) for n, t in zip(batch.column(0).to_pylist(), texts)]
        codes, at = code_points(["\0" * PAD + t for t in texts])
        use = np.zeros(len(codes) + 1, bool)
        end = np.zeros(len(codes) + 1, bool)
        for t, a in zip(texts, at.tolist()):
            found = marked_units(t)
            if len(found) < 2:
                continue
            base = a + PAD
            use[base + 1 : base + found[-1][0] + 1] = True
            for _, e, mark in found[:-1]:
                if mark >= 0:
                    end[base + (mark or e)] = True
                else:
                    use[base + e] = False  # closed by its line, which says nothing of the characters
            for mark in QUOTED_END.finditer(t, 0, found[-1][0]):
                end[base + mark.end(1)] = True
        mark = np.isin(codes, MARKS)
        use[1:-1] &= ~(mark[1:] & mark[:-1])  # inside a run of marks
        where = np.flatnonzero(use)
        if not len(where):
            continue
        keys = np.array([_language_key(n) for n in names], np.uint64)
        text = np.searchsorted(at, where - 1, "right") - 1
        language, stops = keys[text], end[where]
        found_keys = [_keys(rolling(codes, k)[where - k], language, k) | stops for k in ORDERS[1:]]
        parts.append(np.unique(np.concatenate(found_keys), return_counts=True))
        if sum(len(p[0]) for p in parts) > HELD:
            parts = _merge(parts)
            if len(parts[0][0]) > HELD // 2:
                yield _rows(*parts.pop())
        which: dict[str, int] = {}
        number = np.array([which.setdefault(n, len(which)) for n in names])[text]
        label = list(which)
        pair, index = np.unique(number.astype(np.int64) << 32 | codes[where - 1], return_inverse=True)
        for p, n, e in zip(pair.tolist(), np.bincount(index).tolist(), np.bincount(index, weights=stops).tolist()):
            row = single.setdefault((label[p >> 32], chr(p & 0xFFFFFFFF)), [0, 0])
            row[0] += n
            row[1] += int(e)
    for key, n in _merge(parts):
        yield _rows(key, n)
    yield pa.RecordBatch.from_pydict(
        {
            "lang": pa.array([x for x, _ in single], pa.string()),
            "key": pa.array([ord(c) for _, c in single], pa.int64()),
            "n": pa.array([r[0] for r in single.values()], pa.int64()),
            "n_end": pa.array([r[1] for r in single.values()], pa.int64()),
        }
    )


ANY = "*"  # all languages together, for one that the texts say nothing of


class Model:
    """Counts of single characters: the end probability after one, and one threshold for each language."""

    def __init__(self, singles: dict[tuple[str, int], tuple[int, int]]):
        pooled: dict[tuple[str, int], tuple[int, int]] = {}
        for (_, c), (n, e) in singles.items():
            have = pooled.get((ANY, c), (0, 0))
            pooled[ANY, c] = (have[0] + n, have[1] + e)
        self.singles = singles | pooled
        total: dict[str, list[float]] = {ANY: [0, 0, 0.0]}
        for (lang, _), (n, e) in self.singles.items():
            t = total.setdefault(lang, [0, 0, 0.0])
            t[0] += n
            t[1] += e
            t[2] += e * e / n
        self.prior = (total[ANY][1] + 0.5) / (total[ANY][0] + 1)
        self.threshold = {lang: PART * m / e for lang, (_, e, m) in total.items() if e >= FEW}

    def log_odds(self, langs: list[str], tails: list[str], longer: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """For every final context, the log-odds of end against continuation above its language's threshold; negative is cut.

        `longer` holds for each order above 1 how often the context was seen (0: not known) and how often as an end.
        """
        p = np.full(len(tails), self.prior)
        for any_language in (True, False):  # one character: in all languages, then in this one
            got = np.array([self.singles.get((ANY if any_language else g, ord(t[-1])), (0, 0)) for g, t in zip(langs, tails)], float).reshape(-1, 2)
            p = (got[:, 1] + PULL * p) / (got[:, 0] + PULL)
        for n, e in longer:
            p = np.where(n > 0, (e + PULL * p) / (n + PULL), p)
        t = np.array([self.threshold.get(g, self.threshold.get(ANY, PART)) for g in langs])
        return np.log(p / (1 - p + 1e-12) + 1e-12) - np.log(t / (1 - t))


def counted(texts: DataFrame) -> DataFrame:
    """(lang, key, n, n_end): rows of order 1 by language and character; rows of longer contexts by hash, without a language."""
    counts = spread(texts.select("lang", "text")).mapInArrow(_count, "lang string, key long, n long, n_end long")
    return materialize(counts.groupBy("lang", "key").agg(F.sum("n").alias("n"), F.sum("n_end").alias("n_end")))


def trained(counts: DataFrame) -> Model:
    singles = counts.where("lang is not null").toArrow().to_pydict()
    return Model({(lang, key): (n, e) for lang, key, n, e in zip(singles["lang"], singles["key"], singles["n"], singles["n_end"])})


def _structure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts that structure decides with `truncated`, the others with their language and the last characters."""
    for batch in batches:
        langs, texts = batch.column(1).to_pylist(), batch.column(2).to_pylist()
        found = [structure(t) for t in texts]
        cut = [None if kind == "ask" else kind == "cut" for kind, _ in found]
        group = [group_of(g, t) if kind == "ask" else None for (kind, _), g, t in zip(found, langs, texts)]
        tail = [("\0" * PAD + rest[-PAD:])[-PAD:] if kind == "ask" else None for kind, rest in found]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cut, pa.bool_()), pa.array(group, pa.string()), pa.array(tail, pa.string())], names=["id", "truncated", "lang", "tail"])


def _final_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The keys of each final context, one row for each order above 1."""
    for batch in batches:
        langs, tails = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        codes, at = code_points(tails)
        language = np.array([_language_key(g) for g in langs], np.uint64)
        for k in ORDERS[1:]:
            key = _keys(rolling(codes, k)[at[1:] - k], language, k)
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(tails, pa.string()), pa.array([k] * len(key), pa.int32()), pa.array(key)], names=["lang", "tail", "k", "key"])


def _judge(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = shared.value
        for batch in batches:
            many = [batch.column(i).fill_null(0).to_numpy() for i in range(3, batch.num_columns)]
            odds = model.log_odds(batch.column(1).to_pylist(), batch.column(2).to_pylist(), list(zip(many[::2], many[1::2])))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(odds < 0), pa.array(["model"] * len(odds), pa.string()), pa.array(odds)], names=["id", "truncated", "decided_by", "log_odds"])

    return run


def judged(texts: DataFrame) -> DataFrame:
    """`texts(id, lang STRING, text STRING)` to (id, truncated, decided_by, log_odds).

    Null texts give no row; blank and markup-only texts are complete; a null language is guessed by script.
    """
    usable = texts.where("text is not null").select("id", "lang", "text")
    counts = counted(usable)
    model = texts.sparkSession.sparkContext.broadcast(trained(counts))
    kind = texts.schema["id"].dataType.simpleString()
    found = materialize(spread(usable).mapInArrow(_structure, f"id {kind}, truncated boolean, lang string, tail string"))
    asked = found.where("tail is not null").select("id", "lang", "tail")
    keys = asked.select("lang", "tail").distinct().mapInArrow(_final_keys, "lang string, tail string, k int, key long")
    known = counts.where("lang is null").select("key", "n", "n_end")
    longer = [F.max(F.when(F.col("k") == k, F.col(c))).alias(f"{c}_{k}") for k in ORDERS[1:] for c in ("n", "n_end")]
    contexts = keys.join(known, "key").groupBy("lang", "tail").agg(*longer)
    by_model = asked.join(contexts, ["lang", "tail"], "left").select("id", "lang", "tail", *contexts.columns[2:])
    by_structure = found.where("tail is null").select("id", "truncated", F.lit("structure").alias("decided_by"), F.lit(None).cast("double").alias("log_odds"))
    return by_structure.unionAll(by_model.mapInArrow(_judge(model), f"id {kind}, truncated boolean, decided_by string, log_odds double"))


def _tafsirs(spark, folder: str) -> DataFrame:
    return table(spark, folder, "tafsirs").select(F.col("tafsir_id").alias("id"), "lang", "text")


def p5_found(spark, folder: str) -> DataFrame:
    return judged(_tafsirs(spark, folder)).where("truncated").select(F.col("id").alias("tafsir_id"))


def p5_rates(spark, folder: str) -> DataFrame:
    """(source, n_texts, n_truncated, rate): how often each source truncates; a null source is one of its own."""
    source = table(spark, folder, "tafsirs").select(F.col("tafsir_id").alias("id"), "source")
    each = judged(_tafsirs(spark, folder)).join(source, "id")
    return each.groupBy("source").agg(
        F.count(F.lit(1)).alias("n_texts"), F.count_if("truncated").alias("n_truncated"), F.round(F.avg(F.col("truncated").cast("int")), 6).alias("rate")
    )
