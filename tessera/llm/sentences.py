"""Problem 6: sentence units in any language and script.

Method: semi-Markov dynamic programming. A text is cut at line breaks and tags into lines; within a line every end
mark that is followed by white space, a closing quote or a letter of a script without spaces (and, between Thai
letters, every space) may end a unit. The programme selects whole spans; the score of a span is the sum of

- closing: how its last word and end mark close (end mark, abbreviation, initial, list number, ellipsis),
- opening: how the span after it opens (a small letter or a comma says that the sentence goes on),
- balance: whether it begins or ends inside a quotation or a pair of brackets that the line closes later,
- length: whether it is too short to be one, or longer than sentences are,

with the weights below. No candidate is decided before the programme runs. The starts that a span can have are tried
from its end back and only while an earlier one can still be better, at most LONG characters, so the programme is
linear in the length of the line.

Everything is one pass over the texts in Arrow batches; nothing is shuffled.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.runtime import spread, table
from .codes import pieces
from .lookalike import canonical

# Abbreviations that never end a sentence (lower case), by language.
NEVER = frozenset(
    # English
    "dr prof mr mrs ms st vol ff ch pp cf i.e e.g ed eds no nos approx v vv p ca fig sec ref"
    # French
    " éd ex c.-à-d chap art trad"
    # German
    " vgl bd bzw nr ggf z.b d.h u.a hrsg kap"
    # Indonesian
    " hlm jil dll dsb yth"
    # Turkish
    " bkz çev"
    # Hindi
    " पृ डॉ सं"
    # Thai
    " \u0e1e.\u0e28 \u0e14\u0e23"
    # Arabic (single letters are taken by rule)
    " هـ".split()
)
# Abbreviations that close a sentence when a new one begins.
CLOSING = frozenset("etc usw vb a.h p.m a.m a.d b.c وغيره इत्यादि".split())
#: Latin words of one letter, which do end sentences in lower case.
WORDS_OF_ONE = frozenset("aoeyàıi")

HIDDEN = "\u200b-\u200f\u2060\ufeff\u061c\u00ad"
HIDDEN_ONES = "".join(map(chr, (*range(0x200B, 0x2010), 0x2060, 0xFEFF, 0x61C, 0xAD)))
BREAK = re.compile(r"[\n\r\u2028\u2029]|<(?:br\s*/?|/?p)>", re.I)
CANDIDATE = re.compile(
    rf"([.!?؟۔。！？।॥…]+)((?:[{HIDDEN}]*[\"”»“«’'\)\]」』）】》]|[ \u00a0\u202f]»(?![^\s<,.;:!?…]))*)([\s{HIDDEN}]*)"
)
THAI_SPACE = re.compile(rf"(?<=[\u0e00-\u0e7f{HIDDEN}])\s[\s{HIDDEN}]*(?=[\u0e00-\u0e7f])")
THAI = re.compile("[\u0e00-\u0e7f]")
QUOTED = re.compile("[\"“”„«»「」『』()（）]")
ELLIPSIS = re.compile(r"\.{2,}|…+")
OPENERS = "\"“„«»「『(（[" + "\u200b\u200c\u200d\u200e\u200f\u2060\ufeff\u061c\u00ad"
COMMAS = ",،，、;؛；"

# Weights of the programme. Closing and opening evidence add up per end; balance and length belong to the span.
END = 1.5  # an end mark, or a space between Thai letters
ORDINAL = 0.25  # a number and its stop before a script without capitals
GOES_ON = -6.0  # abbreviation, initial, list number, ellipsis; a small letter or a comma opens what follows
INSIDE = -1.5  # a span that begins or ends inside a closed quotation or bracket
SHORT, TOO_SHORT = 3, -0.25  # characters of the shortest span that may stand alone
LONG, TOO_LONG = 600, -2.0  # beyond this a sentence is rare; outweighs what holds a long quotation together


def _before(text: str, low: int, at: int) -> str:
    """The token that ends at `at` (letters, marks, digits, inner dots and hyphens); of a long one its last 40 characters."""
    i, least = at, max(low, at - 40)
    while i > least:
        c = text[i - 1]
        if c.isspace() or c in "<>()[]\"“”„«»「」『』،,;:（）":
            break
        i -= 1
    return text[i:at]


def _opening(text: str, at: int, high: int) -> str:
    """The first character of what opens at `at`, quotes and brackets skipped; empty at the end of the line."""
    while at < high and text[at] in OPENERS:
        at += 1
    return text[at] if at < high else ""


def closing_score(text: str, low: int, high: int, start: int, mark: str, closers: str, following: str) -> float:
    """The evidence of an end mark at `start` and the word before it; `following` is the first character after it."""
    if mark == ".":
        token = _before(text, low, start)
        if not token.isascii():
            token = canonical(token)
        if token.isdigit():
            begin = start - len(token)
            while begin > low and text[begin - 1].isspace():
                begin -= 1
            if begin == low or text[begin - 1] in ".!?؟۔。！？।\"”»“«)」":
                return GOES_ON  # a list number belongs to what follows
            return GOES_ON if following.islower() or following.isupper() else ORDINAL
        if not closers:
            small = token.lower()
            if small not in CLOSING and (small in NEVER or len(token) == 1 and token.isalpha() and token not in WORDS_OF_ONE):
                return GOES_ON  # an abbreviation, an initial or a letter that stands for a word
        return END
    if mark == "۔" and not closers and following.isdigit() and len(_before(text, low, start)) == 1:
        return GOES_ON
    return GOES_ON if mark[0] in ".…" and ELLIPSIS.fullmatch(mark) else END


def opening_score(text: str, after: int, closers: str, following: str) -> float:
    """The evidence of what opens at `after`: a small letter, or a comma behind a quotation, continues the sentence."""
    return GOES_ON if following.islower() or closers and text[after] in COMMAS else 0.0


def _depth(piece: str) -> tuple[int, int]:
    """(quotes, brackets) that a piece leaves open; a straight quote counts by parity."""
    german = "„" in piece or re.search(r"»\w", piece) is not None
    q = piece.count('"') % 2 + abs(piece.count("«") - piece.count("»")) + abs(piece.count("「") - piece.count("」"))
    q += abs(piece.count("„") - piece.count("“")) if german else abs(piece.count("“") - piece.count("”"))
    b = abs(piece.count("(") - piece.count(")")) + abs(piece.count("（") - piece.count("）"))
    return q, b


PAIRS = {"«": "»", "“": "”", "「": "」", "『": "』", "(": ")", "（": "）"}


def _enclosed(text: str, low: int, high: int) -> list[int]:
    """Where quotations and brackets that are also closed open and close, as a sorted flat list of disjoint intervals."""
    marks = [(m.start(), m[0]) for m in QUOTED.finditer(text, low, high)]
    if len(marks) < 2:
        return []
    closes = {v: k for k, v in PAIRS.items()}
    if any(c == "„" for _, c in marks):
        closes.pop("”"), closes.update({"“": "„"})
    if next((c for _, c in marks if c in "«»"), "«") == "»":  # the German direction
        closes.pop("»"), closes.update({"«": "»"})
    open_at: dict[str, list[int]] = {}
    spans: list[tuple[int, int]] = []
    for at, c in marks:
        if c == '"' and open_at.get(c) or c in closes and open_at.get(closes[c]):
            spans.append((open_at[closes.get(c, c)].pop(), at))
        elif c not in closes:
            open_at.setdefault(c, []).append(at)
    flat: list[int] = []
    for a, b in sorted(spans):
        if not flat or a > flat[-1]:
            flat += (a, b)
        elif b > flat[-1]:
            flat[-1] = b
    return flat


def units(text: str) -> list[tuple[int, int]]:
    """The units of a text as (start, end) in code points."""
    return [(a, b) for a, b, _ in marked_units(text)]


def marked_units(text: str) -> list[tuple[int, int, int]]:
    """The units of a text, each with the position behind its end mark: 0 if a space ended it, -1 if only its line did."""
    out: list[tuple[int, int, int]] = []
    thai = THAI.search(text) is not None
    low, n = 0, len(text)
    for m in BREAK.finditer(text):
        if low < m.start():
            _line(text, low, m.start(), thai, out)
        low = m.end()
    if low < n:
        _line(text, low, n, thai, out)
    return out


def _line(text: str, low: int, high: int, thai: bool, out: list[tuple[int, int, int]]) -> None:
    while low < high and text[low].isspace():
        low += 1
    while high > low and text[high - 1].isspace():
        high -= 1
    if low == high:
        return
    cuts: list[tuple[int, int, float, int]] = []  # where a unit may end, where the next begins, score, behind the mark
    last, tail = -1, high
    while tail > low and (text[tail - 1] in ".…\ufffd" or text[tail - 1].isspace()):
        tail -= 1
    for m in CANDIDATE.finditer(text, low, high):
        start, stop, after = m.start(), m.end(2), m.end()
        if after >= high:
            last = m.end(1)
            break
        mark, closers, gap = m[1], m[2], m[3]
        if mark == "." and not closers and (not gap or not any(c.isspace() for c in gap)):
            continue  # inside a number, a name or an abbreviation, invisible characters or not
        following = _opening(text, after, high)
        score = closing_score(text, low, high, start, mark, closers, following) + opening_score(text, after, closers, following)
        if after >= tail:
            score = GOES_ON  # only dots and broken characters follow
        cuts.append((stop, after, score, m.end(1)))
    if thai:
        cuts += [(m.start(), m.end(), END, 0) for m in THAI_SPACE.finditer(text, low, high)]
        cuts.sort()
    if not cuts:
        out.append((low, high, last))
        return
    flat = _enclosed(text, low, high) if QUOTED.search(text, low, high) else []
    inside = [bisect_left(flat, c[0]) % 2 == 1 for c in cuts] if flat else []
    inside = inside if True in inside else None
    _programme(low, high, last, cuts, inside, out)


def _programme(begin: int, high: int, last: int, cuts: list[tuple[int, int, float, int]], inside: list[bool] | None, out: list[tuple[int, int, int]]) -> None:
    """The spans of the best total score, appended to `out`.

    For every end the starts before it are tried from the nearest back, until no earlier one can be better: the best
    total so far bounds them all, and those more than LONG characters away differ in that total alone.
    """
    first = [begin, *(c[1] for c in cuts)]
    held = [False, *inside, False] if inside else None
    best, back = [0.0], []
    bound, by = [0.0], [0]  # the greatest total up to each start, and where it is
    lose, of = (bound, by) if held is None else ([0.0], [0])  # the same for a span that begins at the start and ends outside
    for j, cut in enumerate([*cuts, (high, high, 0.0, last)]):
        end, i, top, who = cut[0], j, float("-inf"), 0
        shut = held is not None and held[j + 1]
        least, most, at = (bound, INSIDE, by) if shut else (lose, 0.0, of)
        while i >= 0 and top <= least[i] + most:
            if first[i] < end - LONG:
                if least[i] + most + TOO_LONG >= top:
                    top, who = least[i] + most + TOO_LONG, at[i]
                break
            value = best[i] + (INSIDE if shut or held is not None and held[i] else 0.0) + (TOO_SHORT if end - first[i] < SHORT else 0.0)
            if value >= top:  # of equal totals the one with fewer ends
                top, who = value, i
            i -= 1
        back.append(who)
        total = top + cut[2]
        best.append(total)
        i = total > bound[-1]
        bound.append(total if i else bound[-1])
        by.append(j + 1 if i else by[-1])
        if held is not None:
            value = total + (INSIDE if shut else 0.0)
            i = value > lose[-1]
            lose.append(value if i else lose[-1])
            of.append(j + 1 if i else of[-1])
    j, spans = len(back), []
    while j:
        i = back[j - 1]
        spans.append((first[i], cuts[j - 1][0] if j <= len(cuts) else high, cuts[j - 1][3] if j <= len(cuts) else last))
        j = i
    out.extend(reversed(spans))


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, texts in pieces(batches, "text"):
        found = [units(t) for t in texts]
        flat = [u for f in found for u in f]
        owner = pa.array([i for i, f in enumerate(found) for _ in f], pa.int64())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0).take(owner), pa.array([s for s, _ in flat], pa.int32()), pa.array([e for _, e in flat], pa.int32())],
            names=["id", "start_pos", "end_pos"],
        )


def sentence_units(texts: DataFrame) -> DataFrame:
    """`texts(id, text STRING)` to (id, start_pos, end_pos), one row for each unit; positions are 0-based code points.

    Null texts, and texts of white space and tags only, have no unit. A row whose id is null keeps its units under
    the null id; repeated ids give repeated rows.
    """
    kind = texts.schema["id"].dataType.simpleString()
    return spread(texts.where("text is not null").select("id", "text")).mapInArrow(_run, f"id {kind}, start_pos int, end_pos int")


def p6_found(spark, folder: str) -> DataFrame:
    texts = table(spark, folder, "tafsirs").select(F.col("tafsir_id").alias("id"), "text")
    return sentence_units(texts).withColumnRenamed("id", "tafsir_id")
