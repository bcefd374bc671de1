"""Literal and folded search with exact source positions."""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.folds import fold_marks, fold_quran_marks
from ..functions.offsets import whole_word_places
from ..functions.spans import explode_spans
from ..functions.text import sha256
from ..plans.runtime import table


def find(texts: DataFrame, query: str, order: list[str], folded: bool = False, limit: int = 20) -> DataFrame:
    """The first `limit` texts (1 to 100) in order that contain `query`, exactly or without optional marks. Never a pattern."""
    if not 1 <= limit <= 100:
        raise ValueError("limit must be 1 to 100")
    text, asked = F.col("text"), F.lit(query)
    if folded:
        text, asked = fold_quran_marks(text), fold_quran_marks(asked)
    if not query:
        raise ValueError("empty query")
    return texts.where(F.contains(text, asked)).orderBy(*order).limit(limit)


def key_status(refs: DataFrame, keys: DataFrame, columns: list[str], in_domain: str) -> DataFrame:
    """Adds `status`: `out_of_domain`, `found` or `not_found` to every reference; null keys are out of the domain."""
    known = keys.select(*columns).distinct().withColumn("_known", F.lit(True))
    return refs.join(known, columns, "left").withColumn(
        "status", F.when(~F.coalesce(F.expr(in_domain), F.lit(False)), "out_of_domain").when(F.col("_known"), "found").otherwise("not_found")
    ).drop("_known")


def line_index(texts: DataFrame, key: str) -> DataFrame:
    """(key, line, byte_start, byte_end, line_sha256): the lines of every text with running byte offsets."""
    lines = texts.where("text is not null").select(key, F.posexplode(F.split("text", "\n")).alias("line", "content"))
    w = Window.partitionBy(key).orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.octet_length("content") + 1).over(w) - 1
    return lines.select(key, "line", (end - F.octet_length("content")).alias("byte_start"), end.alias("byte_end"), sha256(F.col("content")).alias("line_sha256"))


def literal_hits(texts: DataFrame, key: str, literals: list[str]) -> DataFrame:
    """(key, literal, line, char_start, byte_start) of every occurrence, overlapping ones too; none spans a line end."""

    def hits(text: str) -> list[tuple]:
        out = []
        for n, line in enumerate(text.split("\n")):
            for x in literals:
                at = line.find(x)
                while at >= 0:
                    out.append((x, n, at, len(line[:at].encode("utf-8", "surrogatepass"))))
                    at = line.find(x, at + 1)
        return out

    if not all(literals):
        raise ValueError("empty literal")
    return explode_spans(texts, key, "text", hits, "literal string, line int, char_start int, byte_start int")


def context_frames(texts: DataFrame, key: str, literal: str, radius: int = 1) -> DataFrame:
    """(key, line, from_line, to_line, byte_start, byte_end): every line with the literal, and `radius` lines around it."""
    lines = texts.where("text is not null").select(key, F.posexplode(F.split("text", "\n")).alias("line", "content"))
    run = Window.partitionBy(key).orderBy("line")
    end = F.sum(F.octet_length("content") + 1).over(run.rowsBetween(Window.unboundedPreceding, 0)) - 1
    spans = lines.withColumn("e", end).withColumn("s", F.col("e") - F.octet_length("content"))
    around = run.rowsBetween(-radius, radius)
    framed = spans.select(
        key, "line", "content", F.min("line").over(around).alias("from_line"), F.max("line").over(around).alias("to_line"),
        F.min("s").over(around).alias("byte_start"), F.max("e").over(around).alias("byte_end"),
    )
    return framed.where(F.contains("content", F.lit(literal))).drop("content")


def whole_words(texts: DataFrame, key: str, terms: list[str]) -> DataFrame:
    """(key, term, n): how often a term stands as a whole word (no letter, digit or underscore beside it); zeros are left out."""
    words = texts.where("text is not null").select(key, F.explode(F.split("text", r"[^\p{L}\p{N}_]+")).alias("term"))
    return words.where(F.col("term").isin(terms)).groupBy(key, "term").agg(F.count(F.lit(1)).alias("n"))


def located_terms(texts: DataFrame, key: str, terms: list[str]) -> DataFrame:
    """(key, term, profile, start_pos, end_pos, byte_start, byte_end, span_sha256) of whole-word places, overlapping ones too.

    A term is looked for as written; only in a text where it nowhere stands so is it looked for without vowel marks
    (`marks`, three characters at least). Spans are those of the raw text, in code points and in UTF-8 bytes.
    """

    def places(text: str) -> list[tuple]:
        out = []
        for term in terms:
            profile, spans = whole_word_places(text, term)
            for a, b in spans:
                before, piece = text[:a].encode("utf-8", "surrogatepass"), text[a:b].encode("utf-8", "surrogatepass")
                out.append((term, profile, a, b, len(before), len(before) + len(piece), hashlib.sha256(piece).hexdigest()))
        return out

    return explode_spans(texts, key, "text", places, "term string, profile string, start_pos int, end_pos int, byte_start int, byte_end int, span_sha256 string")


def marker_status(texts: DataFrame, key: str, marker: str) -> DataFrame:
    """(key, status): `PRESENT`, `NOT_OBSERVED`, or where there is no text to search `NOT_CHECKED`, which is not a no.

    The marker counts as a whole word, with or without vowel marks; its presence says nothing of its role.
    """
    bare = lambda c: fold_marks(c)
    word = rf"(?<![\p{{L}}\p{{N}}_]){re.escape(marker)}(?![\p{{L}}\p{{N}}_])"
    there = F.col("text").rlike(word) | bare(F.col("text")).rlike(word)
    return texts.select(key, F.when(F.col("text").isNull(), "NOT_CHECKED").when(there, "PRESENT").otherwise("NOT_OBSERVED").alias("status"))


PLACED_TERMS, MARKER = ["gloss", "هامش", "من", "the"], "الشارح"
LITERALS, TERMS = ["gloss", "ana", "ويسأل", "ı"], ["the", "gloss", "في", "قال", "ve"]


def _find_both(s, d):
    verses = table(s, d, "verses").where("deleted_at is null").select("verse_id", "source_id", "sura", "aya", "text")
    parts = [find(verses, "من", ["sura", "aya", "source_id", "verse_id"], folded=f, limit=100).select(F.lit("folded" if f else "exact").alias("match"), "verse_id") for f in (False, True)]
    return parts[0].unionByName(parts[1])


QUERIES = {
    "find_limit": _find_both,
    "key_status": lambda s, d: key_status(
        table(s, d, "tafsirs").select("verse_source", "sura", "aya"), table(s, d, "verses").withColumnRenamed("source_id", "verse_source"),
        ["verse_source", "sura", "aya"], "sura between 1 and 114 and aya >= 1",
    ).groupBy("verse_source", "status").agg(F.count(F.lit(1)).alias("n")),
    "line_index": lambda s, d: line_index(table(s, d, "documents"), "doc_id"),
    "literal_hits": lambda s, d: literal_hits(table(s, d, "documents"), "doc_id", LITERALS),
    "context_frames": lambda s, d: context_frames(table(s, d, "documents"), "doc_id", "gloss"),
    "located_terms": lambda s, d: located_terms(table(s, d, "tafsirs"), "tafsir_id", PLACED_TERMS),
    "marker_status": lambda s, d: marker_status(table(s, d, "tafsirs"), "tafsir_id", MARKER),
    "whole_words": lambda s, d: whole_words(table(s, d, "documents"), "doc_id", TERMS),
}
_L = "WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS content, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line FROM documents WHERE text IS NOT NULL)"
_B = _L + ", b AS (SELECT *, sum(strlen(content) + 1) OVER (PARTITION BY doc_id ORDER BY line) - 1 AS e FROM l)"
# the marks spelled out once more, independently of functions.folds
_MARKS = "||".join(f"chr({o})" for a, b in ((0x610, 0x61A), (0x64B, 0x652), (0x6D6, 0x6DC), (0x6DF, 0x6E4), (0x6E7, 0x6E8), (0x6EA, 0x6ED)) for o in range(a, b + 1))
_VOWELS = r"[\x{064B}-\x{0652}\x{0656}-\x{065F}\x{0670}\x{06D6}-\x{06ED}]"
_EDGE = lambda t, a, b: rf"NOT regexp_matches(substr({t}, ({a})::INT, 1) || substr({t}, ({b})::INT + 1, 1), '[\p{{L}}\p{{N}}_]')"
_ASKED = ", ".join(f"('{x}')" for x in PLACED_TERMS)
_FIND = "(SELECT '{0}' AS match, verse_id FROM verses WHERE deleted_at IS NULL AND contains({1}, 'من') ORDER BY sura NULLS FIRST, aya NULLS FIRST, source_id NULLS FIRST, verse_id LIMIT 100)"
SQL = {
    "find_limit": f"SELECT * FROM {_FIND.format('exact', 'text')} UNION ALL SELECT * FROM {_FIND.format('folded', f'translate(text, {_MARKS}, {chr(39) * 2})')}",
    "key_status": "WITH k AS (SELECT DISTINCT source_id, sura, aya FROM verses) SELECT t.verse_source, CASE WHEN coalesce(t.sura BETWEEN 1 AND 114 AND t.aya >= 1, false) = false THEN 'out_of_domain' WHEN k.sura IS NOT NULL THEN 'found' ELSE 'not_found' END AS status, count(*) AS n FROM tafsirs t LEFT JOIN k ON t.verse_source = k.source_id AND t.sura = k.sura AND t.aya = k.aya GROUP BY ALL",
    "line_index": _B + " SELECT doc_id, line, (e - strlen(content))::BIGINT AS byte_start, e::BIGINT AS byte_end, sha256(content) AS line_sha256 FROM b",
    "literal_hits": _L + f", x AS (SELECT *, unnest({LITERALS}) AS literal FROM l), y AS (SELECT *, unnest(range(1, length(content) + 1)) AS p FROM x WHERE contains(content, literal)) SELECT doc_id, literal, line, p - 1 AS char_start, strlen(substr(content, 1, p - 1)) AS byte_start FROM y WHERE substr(content, p, length(literal)) = literal",
    "context_frames": _B + ", f AS (SELECT doc_id, line, content, min(line) OVER w AS from_line, max(line) OVER w AS to_line, min(e - strlen(content)) OVER w AS byte_start, max(e) OVER w AS byte_end FROM b WINDOW w AS (PARTITION BY doc_id ORDER BY line ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)) SELECT doc_id, line, from_line, to_line, byte_start::BIGINT AS byte_start, byte_end::BIGINT AS byte_end FROM f WHERE contains(content, 'gloss')",
    "marker_status": rf"SELECT tafsir_id, CASE WHEN text IS NULL THEN 'NOT_CHECKED' WHEN regexp_matches(regexp_replace(text, '{_VOWELS}', '', 'g'), '(^|[^\p{{L}}\p{{N}}_]){MARKER}($|[^\p{{L}}\p{{N}}_])') THEN 'PRESENT' ELSE 'NOT_OBSERVED' END AS status FROM tafsirs",
    "located_terms": rf"""WITH t AS (SELECT tafsir_id, text, term FROM tafsirs, (VALUES {_ASKED}) v(term) WHERE text IS NOT NULL),
e AS (SELECT *, unnest(range(0, length(text))) AS a, 'literal_exact_v1' AS profile FROM t WHERE contains(text, term)),
x AS (SELECT tafsir_id, text, term, profile, a, a + length(term) AS b FROM e WHERE substr(text, a + 1, length(term)) = term AND {_EDGE("text", "a", "a + length(term)")} AND (a > 0 OR true)),
c AS (SELECT tafsir_id, unnest(string_split(text, '')) AS c, generate_subscripts(string_split(text, ''), 1) - 1 AS p FROM tafsirs WHERE text <> ''),
k AS (SELECT tafsir_id, string_agg(c, '' ORDER BY p) AS bare, list(p ORDER BY p) AS ps FROM c WHERE NOT regexp_matches(c, '{_VOWELS}') GROUP BY tafsir_id),
m AS (SELECT t.*, bare, ps FROM t JOIN k USING (tafsir_id) WHERE length(term) >= 3 AND contains(bare, term) AND NOT EXISTS (FROM x WHERE x.tafsir_id = t.tafsir_id AND x.term = t.term)),
n AS (SELECT *, unnest(range(1, length(bare) + 1)) AS f FROM m),
y AS (SELECT tafsir_id, text, term, 'marks' AS profile, ps[f] AS a, ps[f + length(term) - 1] + 1 AS b FROM n WHERE substr(bare, f, length(term)) = term),
z AS (SELECT * FROM x UNION ALL SELECT * FROM y WHERE {_EDGE("text", "a", "b")})
SELECT tafsir_id, term, profile, a::INT AS start_pos, b::INT AS end_pos, strlen(substr(text, 1, a)) AS byte_start, strlen(substr(text, 1, b)) AS byte_end, sha256(substr(text, a + 1, b - a)) AS span_sha256 FROM z""",
    "whole_words": rf"WITH w AS (SELECT doc_id, unnest(regexp_split_to_array(text, '[^\p{{L}}\p{{N}}_]+')) AS term FROM documents) SELECT doc_id, term, count(*) AS n FROM w WHERE term IN {tuple(TERMS)} GROUP BY ALL",
}
