"""Coverage and quality audits of keyed text tables: one scan with map-side aggregation each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import TAG, has_text, sha256
from ..plans.runtime import table

LIMITS = (32767, 65535)  # fixed values: text lengths at which upstream systems cut


def length_distribution(texts: DataFrame, by: str) -> DataFrame:
    """Per group: rows, greatest length in code points, rows exactly at and above each limit. Null texts count as rows only."""
    n = F.length("text")
    return texts.groupBy(by).agg(
        F.count(F.lit(1)).alias("n_rows"), F.max(n).alias("max_chars"),
        *(F.count_if(n == x).alias(f"at_{x}") for x in LIMITS), *(F.count_if(n > x).alias(f"above_{x}") for x in LIMITS),
    )


def _flags() -> dict[str, Column]:
    value = F.coalesce("text", F.lit(""))
    return {
        "SQL_EMPTY": ~has_text(value),
        "MARKUP_ONLY": has_text(value) & ~has_text(F.regexp_replace(value, TAG, "")),
        "POSSIBLE_TRUNCATION": F.length(value).isin(*LIMITS),
        "CONTAINS_BR": F.instr(F.lower(value), "<br") > 0,
        "SLASH_MARKED": F.instr(F.regexp_replace(value, TAG, ""), "/") > 0,
    }


def quality_counts(texts: DataFrame, by: str) -> DataFrame:
    """Per group, how many rows carry each flag; a null text counts as empty."""
    return texts.groupBy(by).agg(F.count(F.lit(1)).alias("n_rows"), *(F.count_if(c).alias(k.lower()) for k, c in _flags().items()))


def quality_queue(texts: DataFrame, key: str) -> DataFrame:
    """One row (key, issue) for each flag that calls for a look (a `<br>` alone doesn't)."""
    issues = F.array_compact(F.array(*(F.when(c, F.lit(k)) for k, c in _flags().items() if k != "CONTAINS_BR")))
    return texts.select(key, F.explode(issues).alias("issue"))


def lookup(verses: DataFrame, works: DataFrame) -> DataFrame:
    """Every verse with what the works say on it: counts and a sorted list of works.

    The works are reduced to one row per verse before the join, so a verse that holds a tenth of all commentary is
    one row in it. Verses without a work keep zeros; works' rows with a null key or source are left out.
    """
    value = F.coalesce("text", F.lit(""))
    shown = has_text(F.regexp_replace(value, TAG, ""))
    per = works.where("source is not null").groupBy(F.col("verse_source").alias("source_id"), "sura", "aya").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if(shown).alias("n_displayable"), F.array_join(F.array_sort(F.collect_set("source")), ",").alias("works"),
    )
    return verses.select("verse_id", "source_id", "sura", "aya").join(per, ["source_id", "sura", "aya"], "left").select(
        "verse_id", F.coalesce("n_rows", F.lit(0)).alias("n_rows"), F.coalesce("n_displayable", F.lit(0)).alias("n_displayable"), "works"
    )


def key_coverage(rows: DataFrame, by: str, keys: list[str]) -> DataFrame:
    """Per group against all keys any group has: missing keys, keys delivered twice, rows with blank text."""
    usable = rows.where(" and ".join(f"{k} is not null" for k in [by, *keys]))
    each = usable.groupBy(by, *keys).agg(F.count(F.lit(1)).alias("n"), F.count_if(~has_text(F.col("text"))).alias("blank"))
    universe = usable.select(*keys).distinct().agg(F.count(F.lit(1)).alias("universe"))
    per = each.groupBy(by).agg(F.count(F.lit(1)).alias("n_keys"), F.count_if(F.col("n") > 1).alias("n_repeated"), F.sum("blank").alias("n_blank"))
    return per.crossJoin(F.broadcast(universe)).select(by, "n_keys", (F.col("universe") - F.col("n_keys")).alias("n_missing"), "n_repeated", "n_blank")  # one row


def existence(tables: dict[str, DataFrame], keys: list[str]) -> DataFrame:
    """For every key of any table, in which tables it stands: one union and one aggregation, no join."""
    parts = [df.select(*keys, *(F.lit(n == name).alias(n) for n in tables)) for name, df in tables.items()]
    union = parts[0]
    for p in parts[1:]:
        union = union.unionByName(p)
    return union.where(" and ".join(f"{k} is not null" for k in keys)).groupBy(*keys).agg(*(F.bool_or(n).alias(n) for n in tables))


def safe_text(texts: DataFrame, by: str, most: int = 4000) -> DataFrame:
    """Per group, how many texts break each character rule: length, control characters, directional controls, no letter."""
    t = F.coalesce("text", F.lit(""))
    return texts.groupBy(by).agg(
        F.count_if(F.length(t) > most).alias("too_long"),
        F.count_if(t.rlike(r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]")).alias("control"),
        F.count_if(t.rlike("[؜‎‏‪-‮⁦-⁩]")).alias("directional"),
        F.count_if(~t.rlike(r"\p{L}")).alias("no_letter"),
    )


def redacted(texts: DataFrame, key: str) -> DataFrame:
    """Texts replaced by digest and sizes; the authority flag is a literal false."""
    return texts.select(key, sha256(F.col("text")).alias("text_sha256"), F.length("text").alias("n_chars"), F.octet_length("text").alias("n_bytes"), F.lit(False).alias("verified"))


def heading_numbers(text: Column) -> Column:
    """The numbers in brackets within the first title, which stands between two `<br>`; empty without one."""
    parts = F.split(text, "<br>", 3)
    return F.when(F.size(parts) >= 3, F.regexp_extract_all(parts[1], F.lit(r"\(([0-9]{1,3})\)"), 1)).otherwise(F.array().cast("array<string>"))


def neighbours(rows: DataFrame) -> DataFrame:
    """(tafsir_id, n_neighbours, n_named, status) of every record of markup only: do records on the verse before or after
    it, of the same work, name its number in their heading?

    Exactly one does: `ONE_ADJACENT_HEADING_MATCH`, else `AMBIGUOUS_OR_NOT_FOUND`. Only the few markup-only records are
    joined; the others are reduced to keys and numbers first. Records with a null in their key have no neighbours.
    """
    empty = rows.where(_flags()["MARKUP_ONLY"]).select("tafsir_id", "source", "verse_source", "sura", F.col("aya").alias("missing"))
    asked = empty.select("*", F.explode(F.array(F.col("missing") - 1, F.col("missing") + 1)).alias("aya")).where("aya >= 1")
    beside = rows.where("text is not null").select("source", "verse_source", "sura", "aya", heading_numbers(F.col("text")).alias("numbers"))
    met = asked.join(beside, ["source", "verse_source", "sura", "aya"])
    n = met.groupBy("tafsir_id").agg(F.count(F.lit(1)).alias("n_neighbours"), F.count_if(F.array_contains("numbers", F.col("missing").cast("string"))).alias("n_named"))
    status = F.when(F.col("n_named") == 1, "ONE_ADJACENT_HEADING_MATCH").otherwise("AMBIGUOUS_OR_NOT_FOUND")
    return empty.select("tafsir_id").join(n, "tafsir_id", "left").fillna(0, ["n_neighbours", "n_named"]).withColumn("status", status)


def _tafsirs(s, d):
    return table(s, d, "tafsirs")


QUERIES = {
    "length_distribution": lambda s, d: length_distribution(_tafsirs(s, d), "source"),
    "quality_counts": lambda s, d: quality_counts(_tafsirs(s, d), "source"),
    "quality_queue": lambda s, d: quality_queue(_tafsirs(s, d), "tafsir_id"),
    "verse_lookup": lambda s, d: lookup(table(s, d, "verses").where("deleted_at is null"), _tafsirs(s, d)),
    "key_coverage": lambda s, d: key_coverage(table(s, d, "verses"), "source_id", ["sura", "aya"]),
    "existence": lambda s, d: existence(
        {
            "in_verses": table(s, d, "verses").select("source_id", "sura", "aya"),
            "in_entries": table(s, d, "corpus_entries").select("source_id", "sura", "aya"),
            "in_tafsirs": _tafsirs(s, d).select(F.col("verse_source").alias("source_id"), "sura", "aya"),
        },
        ["source_id", "sura", "aya"],
    ),
    "safe_text": lambda s, d: safe_text(table(s, d, "documents"), "lang"),
    "redacted": lambda s, d: redacted(_tafsirs(s, d), "tafsir_id"),
    "neighbours": lambda s, d: neighbours(_tafsirs(s, d)),
}
_V = "coalesce(text, '')"
_T = rf"regexp_matches(regexp_replace({_V}, '<[^>]*>', '', 'g'), '[^\s\p{{Z}}]')"
_H = rf"regexp_matches({_V}, '[^\s\p{{Z}}]')"
_S = rf"contains(regexp_replace({_V}, '<[^>]*>', '', 'g'), '/')"
SQL = {
    "length_distribution": "SELECT source, count(*) AS n_rows, max(length(text)) AS max_chars, count(*) FILTER (length(text)=32767) AS at_32767, count(*) FILTER (length(text)=65535) AS at_65535, count(*) FILTER (length(text)>32767) AS above_32767, count(*) FILTER (length(text)>65535) AS above_65535 FROM tafsirs GROUP BY source",
    "quality_counts": f"SELECT source, count(*) AS n_rows, count(*) FILTER (NOT {_H}) AS sql_empty, count(*) FILTER ({_H} AND NOT {_T}) AS markup_only, count(*) FILTER (length({_V}) IN (32767, 65535)) AS possible_truncation, count(*) FILTER (contains(lower({_V}), '<br')) AS contains_br, count(*) FILTER ({_S}) AS slash_marked FROM tafsirs GROUP BY source",
    "quality_queue": f"SELECT tafsir_id, 'SQL_EMPTY' AS issue FROM tafsirs WHERE NOT {_H} UNION ALL SELECT tafsir_id, 'MARKUP_ONLY' FROM tafsirs WHERE {_H} AND NOT {_T} UNION ALL SELECT tafsir_id, 'POSSIBLE_TRUNCATION' FROM tafsirs WHERE length({_V}) IN (32767, 65535) UNION ALL SELECT tafsir_id, 'SLASH_MARKED' FROM tafsirs WHERE {_S}",
    "verse_lookup": f"WITH p AS (SELECT verse_source, sura, aya, count(*) AS n_rows, count(*) FILTER ({_T}) AS n_displayable, string_agg(DISTINCT source, ',' ORDER BY source) AS works FROM tafsirs WHERE source IS NOT NULL GROUP BY ALL) SELECT verse_id, coalesce(n_rows, 0) AS n_rows, coalesce(n_displayable, 0) AS n_displayable, works FROM verses v LEFT JOIN p ON v.source_id = p.verse_source AND v.sura = p.sura AND v.aya = p.aya WHERE deleted_at IS NULL",
    "key_coverage": rf"WITH u AS (SELECT * FROM verses WHERE source_id IS NOT NULL AND sura IS NOT NULL AND aya IS NOT NULL), e AS (SELECT source_id, sura, aya, count(*) AS n, count(*) FILTER (NOT coalesce(regexp_matches(text, '[^\s\p{{Z}}]'), false)) AS b FROM u GROUP BY ALL) SELECT source_id, count(*) AS n_keys, (SELECT count(*) FROM (SELECT DISTINCT sura, aya FROM u)) - count(*) AS n_missing, count(*) FILTER (n > 1) AS n_repeated, sum(b)::BIGINT AS n_blank FROM e GROUP BY source_id",
    "existence": "WITH a AS (SELECT source_id, sura, aya, 1 AS t FROM verses UNION ALL SELECT source_id, sura, aya, 2 FROM corpus_entries UNION ALL SELECT verse_source, sura, aya, 3 FROM tafsirs) SELECT source_id, sura, aya, bool_or(t=1) AS in_verses, bool_or(t=2) AS in_entries, bool_or(t=3) AS in_tafsirs FROM a WHERE source_id IS NOT NULL AND sura IS NOT NULL AND aya IS NOT NULL GROUP BY ALL",
    "safe_text": rf"SELECT lang, count(*) FILTER (length({_V}) > 4000) AS too_long, count(*) FILTER (regexp_matches({_V}, '[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]')) AS control, count(*) FILTER (regexp_matches({_V}, '[\x{{61c}}\x{{200e}}\x{{200f}}\x{{202a}}-\x{{202e}}\x{{2066}}-\x{{2069}}]')) AS directional, count(*) FILTER (NOT regexp_matches({_V}, '\p{{L}}')) AS no_letter FROM documents GROUP BY lang",
    "redacted": "SELECT tafsir_id, sha256(text) AS text_sha256, length(text) AS n_chars, strlen(text) AS n_bytes, false AS verified FROM tafsirs",
    "neighbours": rf"""WITH e AS (SELECT * FROM tafsirs WHERE {_H} AND NOT {_T}), h AS (SELECT *, CASE WHEN len(string_split(text, '<br>')) >= 3 THEN regexp_extract_all(string_split(text, '<br>')[2], '\(([0-9]{{1,3}})\)', 1) ELSE [] END AS numbers FROM tafsirs WHERE text IS NOT NULL),
m AS (SELECT e.tafsir_id, count(*) AS n, count(*) FILTER (list_contains(numbers, e.aya::VARCHAR)) AS k FROM e JOIN h ON h.source = e.source AND h.verse_source = e.verse_source AND h.sura = e.sura AND abs(h.aya - e.aya) = 1 AND h.aya >= 1 GROUP BY e.tafsir_id)
SELECT tafsir_id, coalesce(n, 0) AS n_neighbours, coalesce(k, 0) AS n_named, CASE WHEN k = 1 THEN 'ONE_ADJACENT_HEADING_MATCH' ELSE 'AMBIGUOUS_OR_NOT_FOUND' END AS status FROM e LEFT JOIN m USING (tafsir_id)""",
}
