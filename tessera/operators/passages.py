"""Commentary as passages: records with their holds, statements of each record, summaries and rollups, record counts against receipts."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.spans import explode_spans
from ..functions.text import TAG, has_text, sha256, stable_id
from ..plans.runtime import table
from .quality import LIMITS
from .segments import WIDE_MARKERS, mention_spans, mentions_sql, statement_spans, statements_sql

HELD_LENGTH = LIMITS[0]  # fixed value: a record of exactly this many characters was cut upstream and is withheld


def record_flags(text: Column) -> Column:
    """The quality flags of a record as one array, in a fixed order."""
    value = F.coalesce(text, F.lit(""))
    shown = has_text(F.regexp_replace(value, TAG, ""))
    flags = {
        "EMPTY": ~has_text(value), "MARKUP_ONLY": has_text(value) & ~shown, "LENGTH_CEILING": F.length(value) == HELD_LENGTH,
        "CONTAINS_BR": F.contains(F.lower(value), F.lit("<br")),
    }
    return F.array_compact(F.array(*(F.when(c, F.lit(k)) for k, c in flags.items())))


def verse_records(verses: DataFrame, works: DataFrame, show_held: bool = False) -> DataFrame:
    """Every commentary record with its verse and state: (tafsir_id, source, status, flags, text_sha256, n_chars).

    Verses are reduced to one row a key, so a hot verse is a hot key of the records only. Status: `UNKNOWN_VERSE` (its
    reference leads nowhere), `WITHHELD` (cut at the upstream limit; its text is null unless `show_held`, its flags stay),
    `NO_TEXT` (empty or markup only), `SHOWN`. Records without a source are dropped, as unknown works are.
    """
    known = verses.where("source_id is not null and sura is not null and aya is not null").groupBy(F.col("source_id").alias("verse_source"), "sura", "aya").agg(F.lit(True).alias("_known"))
    r = works.where("source is not null").join(known, ["verse_source", "sura", "aya"], "left")
    flags = record_flags(F.col("text"))
    held = F.array_contains(flags, "LENGTH_CEILING")
    status = F.when(F.col("_known").isNull(), "UNKNOWN_VERSE").when(held, "WITHHELD").when(F.exists(flags, lambda x: x.isin("EMPTY", "MARKUP_ONLY")), "NO_TEXT").otherwise("SHOWN")
    text = F.col("text") if show_held else F.when(~held, F.col("text"))
    return r.select("tafsir_id", "source", status.alias("status"), F.array_join(flags, ",").alias("flags"), sha256(text).alias("text_sha256"), F.length(text).alias("n_chars"))


def passages(works: DataFrame, lookup: DataFrame) -> DataFrame:
    """(tafsir_id, source, start_pos, end_pos, passage_sha256, passage_id): the statements of every record that is shown.

    The raw rows are read once more and must carry the digest that the lookup gave (a semi join), held ones are skipped.
    """
    shown = lookup.where("status = 'SHOWN'").select("tafsir_id", F.col("text_sha256").alias("_want"))
    raw = works.select("tafsir_id", "text").join(shown, "tafsir_id").where(sha256(F.col("text")) == F.col("_want"))

    def cut(text: str) -> list[tuple]:
        return [(a, b, hashlib.sha256(text[a:b].encode("utf-8", "surrogatepass")).hexdigest()) for a, b in statement_spans(text)]

    spans = explode_spans(raw, "tafsir_id", "text", cut, "start_pos int, end_pos int, passage_sha256 string")
    named = stable_id("tp:", F.col("tafsir_id"), F.col("start_pos"), F.col("end_pos"), digits=32).alias("passage_id")
    return spans.join(lookup.select("tafsir_id", "source"), "tafsir_id").select("tafsir_id", "source", "start_pos", "end_pos", "passage_sha256", named)


def passage_summary(found: DataFrame, marked: DataFrame) -> DataFrame:
    """(what, name, n): passages in all, by work, by verification (always unverified) and by attribution.

    A passage is `NAMED_REPORT` if a marked window of its record begins in it, else `UNATTRIBUTED`.
    """
    hit = found.join(marked.select(F.col("tafsir_id").alias("_t"), F.col("start_pos").alias("_s")), (F.col("tafsir_id") == F.col("_t")) & (F.col("_s") >= F.col("start_pos")) & (F.col("_s") < F.col("end_pos")), "left_semi")
    each = found.select("passage_id", "source").join(hit.select("passage_id", F.lit("NAMED_REPORT").alias("attribution")), "passage_id", "left").fillna("UNATTRIBUTED", ["attribution"])
    long = each.select(F.explode(F.array(
        F.struct(F.lit("all").alias("what"), F.lit("passages").alias("name")), F.struct(F.lit("work").alias("what"), F.col("source").alias("name")),
        F.struct(F.lit("verification").alias("what"), F.lit("UNVERIFIED").alias("name")), F.struct(F.lit("attribution").alias("what"), F.col("attribution").alias("name")),
    )).alias("x"))
    return long.groupBy("x.what", "x.name").agg(F.count(F.lit(1)).alias("n"))


def record_rollup(lookup: DataFrame, found: DataFrame, marked: DataFrame) -> DataFrame:
    """(tafsir_id, source, status, passage_count, candidate_count, passages_redacted): one row a record, those without passages too.

    `passages_redacted` is the nested detail: spans and digests in order, never text. It is bounded by one record's text.
    """
    detail = found.groupBy("tafsir_id").agg(F.count(F.lit(1)).alias("passage_count"), F.array_sort(F.collect_list(F.struct("start_pos", "end_pos", "passage_sha256"))).alias("passages_redacted"))
    candidates = marked.groupBy("tafsir_id").agg(F.count(F.lit(1)).alias("candidate_count"))
    return lookup.select("tafsir_id", "source", "status").join(detail, "tafsir_id", "left").join(candidates, "tafsir_id", "left").select(
        "tafsir_id", "source", "status", F.coalesce("passage_count", F.lit(0)).alias("passage_count"), F.coalesce("candidate_count", F.lit(0)).alias("candidate_count"), "passages_redacted"
    )


def receipt_counts(rows: DataFrame, receipts: DataFrame, by: str, keys: list[str]) -> DataFrame:
    """(by, n_rows, n_keys, expected, met): rows and different keys of every group must both equal the receipt's number.

    `receipts(by, expected)`; a group without a receipt, and a receipt without rows, are not met. Keys are counted in two
    steps, so a hot group costs one row a key and not one task.
    """
    each = rows.where(F.col(by).isNotNull()).groupBy(by, *keys).agg(F.count(F.lit(1)).alias("n"))
    n = each.groupBy(by).agg(F.sum("n").alias("n_rows"), F.count(F.lit(1)).alias("n_keys"))
    both = n.join(receipts, by, "full_outer").fillna(0, ["n_rows", "n_keys"])
    return both.select(by, "n_rows", "n_keys", "expected", F.coalesce((F.col("n_rows") == F.col("expected")) & (F.col("n_keys") == F.col("expected")), F.lit(False)).alias("met"))


def grid_coverage(rows: DataFrame, chapters: DataFrame, by: str) -> DataFrame:
    """(by, n_keys, n_missing, n_outside) of every group against the grid of `chapters(sura, n)`: ayas 1 to n of each.

    Missing keys are counted by difference with the grid's size, those outside by the chapter's bound, so the grid is
    never multiplied with the groups. Rows with a null in their key or group are left out.
    """
    one = rows.where(F.col(by).isNotNull() & F.col("sura").isNotNull() & F.col("aya").isNotNull()).select(by, "sura", "aya").distinct()
    placed = one.join(chapters, "sura", "left").withColumn("_in", F.coalesce((F.col("aya") >= 1) & (F.col("aya") <= F.col("n")), F.lit(False)))
    size = chapters.agg(F.sum("n").alias("_size"))
    per = placed.groupBy(by).agg(F.count_if("_in").alias("n_keys"), F.count_if(~F.col("_in")).alias("n_outside"))
    return per.crossJoin(F.broadcast(size)).select(by, "n_keys", (F.col("_size") - F.col("n_keys")).alias("n_missing"), "n_outside")  # one row


def _lookup(s, d):
    return verse_records(table(s, d, "verses").where("deleted_at is null"), table(s, d, "tafsirs"))


def _marked(s, d):
    return explode_spans(table(s, d, "tafsirs"), "tafsir_id", "text", lambda t: mention_spans(t, WIDE_MARKERS), "start_pos int, end_pos int, kind string")


def _rollup(s, d):
    r = record_rollup(_lookup(s, d), passages(table(s, d, "tafsirs"), _lookup(s, d)), _marked(s, d))
    written = F.array_join(F.transform("passages_redacted", lambda x: F.concat(x["start_pos"].cast("string"), F.lit(":"), x["end_pos"].cast("string"), F.lit(":"), x["passage_sha256"])), " ")
    return r.withColumn("passages_redacted", sha256(F.coalesce(written, F.lit(""))))


def _receipts(s, d):
    entries = table(s, d, "corpus_entries").where("source_kind = 'quran' and source_id is not null")
    return receipt_counts(table(s, d, "verses"), entries.groupBy("source_id").agg(F.count(F.lit(1)).alias("expected")), "source_id", ["sura", "aya"])


def _grid(s, d):
    v = table(s, d, "verses").where("deleted_at is null")
    chapters = table(s, d, "corpus_entries").where("source_kind = 'quran' and sura is not null and aya is not null").groupBy("sura").agg(F.max("aya").alias("n"))
    return grid_coverage(v, chapters, "source_id")


QUERIES = {
    "verse_records": _lookup,
    "passages": lambda s, d: passages(table(s, d, "tafsirs"), _lookup(s, d)),
    "passage_summary": lambda s, d: passage_summary(passages(table(s, d, "tafsirs"), _lookup(s, d)), _marked(s, d)),
    "record_rollup": _rollup,
    "receipt_counts": _receipts,
    "grid_coverage": _grid,
}
_V = "coalesce(text, '')"
_SHOWN = rf"regexp_matches(regexp_replace({_V}, '<[^>]*>', '', 'g'), '[^\s\p{{Z}}]')"
_ANY = rf"regexp_matches({_V}, '[^\s\p{{Z}}]')"
_REC = f"""kn AS (SELECT DISTINCT source_id, sura, aya FROM verses WHERE deleted_at IS NULL),
rc AS (SELECT tafsir_id, source, text, k.sura IS NOT NULL AS known, length({_V}) = {HELD_LENGTH} AS held, NOT {_ANY} AS empty, {_ANY} AND NOT {_SHOWN} AS markup, contains(lower({_V}), '<br') AS br
  FROM tafsirs t LEFT JOIN kn k ON k.source_id = t.verse_source AND k.sura = t.sura AND k.aya = t.aya WHERE source IS NOT NULL),
lk AS (SELECT tafsir_id, source, CASE WHEN NOT known THEN 'UNKNOWN_VERSE' WHEN held THEN 'WITHHELD' WHEN empty OR markup THEN 'NO_TEXT' ELSE 'SHOWN' END AS status,
  concat_ws(',', CASE WHEN empty THEN 'EMPTY' END, CASE WHEN markup THEN 'MARKUP_ONLY' END, CASE WHEN held THEN 'LENGTH_CEILING' END, CASE WHEN br THEN 'CONTAINS_BR' END) AS flags,
  CASE WHEN NOT held THEN text END AS text FROM rc)"""
_PASS = f"""WITH RECURSIVE {_REC}, sh AS (SELECT tafsir_id, source, text FROM lk WHERE status = 'SHOWN'), {statements_sql("sh", "tafsir_id")}, {mentions_sql("tafsirs", "tafsir_id", WIDE_MARKERS)},
pa AS (SELECT tafsir_id, source, start_pos, end_pos, sha256(substr(text, start_pos + 1, end_pos - start_pos)) AS passage_sha256,
  'tp:' || substr(sha256(tafsir_id || chr(31) || start_pos || chr(31) || end_pos || chr(31)), 1, 32) AS passage_id FROM st JOIN sh USING (tafsir_id))"""
SQL = {
    "verse_records": f"WITH {_REC} SELECT tafsir_id, source, status, flags, sha256(text) AS text_sha256, length(text) AS n_chars FROM lk",
    "passages": _PASS + " SELECT * FROM pa",
    "passage_summary": _PASS + """, ap AS (SELECT *, CASE WHEN EXISTS (FROM me WHERE me.tafsir_id = pa.tafsir_id AND me.start_pos >= pa.start_pos AND me.start_pos < pa.end_pos) THEN 'NAMED_REPORT' ELSE 'UNATTRIBUTED' END AS attribution FROM pa)
SELECT 'all' AS what, 'passages' AS name, count(*) AS n FROM ap UNION ALL SELECT 'work', source, count(*) FROM ap GROUP BY source UNION ALL SELECT 'verification', 'UNVERIFIED', count(*) FROM ap UNION ALL SELECT 'attribution', attribution, count(*) FROM ap GROUP BY attribution""",
    "record_rollup": _PASS + """, n AS (SELECT tafsir_id, count(*) AS p, string_agg(start_pos || ':' || end_pos || ':' || passage_sha256, ' ' ORDER BY start_pos) AS x FROM pa GROUP BY tafsir_id), c AS (SELECT tafsir_id, count(*) AS c FROM me GROUP BY tafsir_id)
SELECT lk.tafsir_id, source, status, coalesce(p, 0) AS passage_count, coalesce(c, 0) AS candidate_count, sha256(coalesce(x, '')) AS passages_redacted FROM lk LEFT JOIN n USING (tafsir_id) LEFT JOIN c USING (tafsir_id)""",
    "receipt_counts": "WITH n AS (SELECT source_id, count(*) AS n_rows, count(DISTINCT (sura, aya)) AS n_keys FROM verses WHERE source_id IS NOT NULL GROUP BY source_id), r AS (SELECT source_id, count(*) AS expected FROM corpus_entries WHERE source_kind = 'quran' AND source_id IS NOT NULL GROUP BY source_id) SELECT source_id, coalesce(n_rows, 0) AS n_rows, coalesce(n_keys, 0) AS n_keys, expected, coalesce(n_rows = expected AND n_keys = expected, false) AS met FROM n FULL JOIN r USING (source_id)",
    "grid_coverage": "WITH g AS (SELECT sura, unnest(range(1, max(aya) + 1)) AS aya FROM corpus_entries WHERE source_kind = 'quran' AND sura IS NOT NULL AND aya IS NOT NULL GROUP BY sura), k AS (SELECT DISTINCT source_id, sura, aya FROM verses WHERE deleted_at IS NULL AND source_id IS NOT NULL AND sura IS NOT NULL AND aya IS NOT NULL) SELECT source_id, count(g.sura) AS n_keys, (SELECT count(*) FROM g) - count(g.sura) AS n_missing, count(*) - count(g.sura) AS n_outside FROM k LEFT JOIN g ON g.sura = k.sura AND g.aya = k.aya GROUP BY source_id",
}
