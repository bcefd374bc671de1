"""Why shared runs of words do or don't reach a link: places of runs in raw texts, containment, and the stage each is lost at."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.offsets import find_folded, marks_with_origins
from ..functions.spans import explode_spans
from ..plans.runtime import materialize, table
from . import segments
from .matching import WORDS, met_runs, word_runs

# The stages, in the order in which the first that fits is taken.
STAGES = [
    "NORMALIZER_OR_TOKENIZATION_MISMATCH", "OUTSIDE_T02_PASSAGE", "OUTSIDE_NARRATION_WINDOW", "CROSSES_OR_OUTSIDE_SOURCE_BLOCK",
    "INSIDE_ALL_PIPELINE_WINDOWS",
]


def contained(places: DataFrame, spans: DataFrame, key: str, name: str) -> DataFrame:
    """Adds `name`: the start of the first span of the same record that holds [start_pos, end_pos) whole, null without one.

    `spans(key, start_pos, end_pos)` may overlap; the first is the one that begins, then ends, first. The join is on the
    record, so what meets is bounded by one text.
    """
    s = spans.select(F.col(key).alias("_k"), F.col("start_pos").alias("_a"), F.col("end_pos").alias("_b"))
    wanted = places.select(key, "start_pos", "end_pos").distinct()
    held = wanted.join(s, (F.col(key) == F.col("_k")) & (F.col("_a") <= F.col("start_pos")) & (F.col("end_pos") <= F.col("_b")))
    first = held.groupBy(key, "start_pos", "end_pos").agg(F.min(F.struct("_a", "_b")).alias("_s"))
    return places.join(first.select(key, "start_pos", "end_pos", F.col("_s._a").alias(name)), [key, "start_pos", "end_pos"], "left")


def located_hits(rows: DataFrame, sources: DataFrame, key: str, source_key: str, words: int = WORDS) -> DataFrame:
    """(key, start_pos, end_pos, source_key, source_start, source_end, agrees) of every place of a shared run on both sides.

    The rows' runs are broadcast only while their counted number stays below a bound; beyond it both sides are shuffled.
    """
    r = word_runs(rows, [key], words).drop("pos")
    s = word_runs(sources, [source_key], words).drop("pos").withColumnsRenamed({"start_pos": "source_start", "end_pos": "source_end", "phrase": "source_phrase"})
    met = met_runs(r, s)
    return met.select(key, "start_pos", "end_pos", source_key, "source_start", "source_end", (F.col("phrase") == F.col("source_phrase")).alias("agrees"))


def staged(rows: DataFrame, passages: DataFrame, windows: DataFrame, sources: DataFrame, blocks: DataFrame, key: str, source_key: str, words: int = WORDS) -> DataFrame:
    """Every place of a shared run with the stage at which a pipeline of passages, marked windows and source blocks loses it.

    (key, start_pos, end_pos, source_key, source_start, source_end, stage). The passages and windows are spans of the
    rows, the blocks of the sources; a run has to lie inside one of each. Null texts share nothing. No place is capped.
    """
    hits = materialize(located_hits(rows, sources, key, source_key, words))
    own = contained(contained(hits.select(key, "start_pos", "end_pos").distinct(), passages, key, "passage"), windows, key, "window")
    theirs = contained(
        hits.select(source_key, F.col("source_start").alias("start_pos"), F.col("source_end").alias("end_pos")).distinct(), blocks, source_key, "block"
    ).withColumnsRenamed({"start_pos": "source_start", "end_pos": "source_end"})
    stage = (
        F.when(~F.col("agrees"), STAGES[0]).when(F.col("passage").isNull(), STAGES[1]).when(F.col("window").isNull(), STAGES[2])
        .when(F.col("block").isNull(), STAGES[3]).otherwise(STAGES[4])
    )
    return (
        hits.join(own, [key, "start_pos", "end_pos"]).join(theirs, [source_key, "source_start", "source_end"])
        .select(key, "start_pos", "end_pos", source_key, "source_start", "source_end", stage.alias("stage"))
    )


def folded_places(texts: DataFrame, key: str, terms: list[str]) -> DataFrame:
    """(key, term, start_pos, end_pos): where a term stands in the folded text, as spans of the raw one."""
    return explode_spans(texts, key, "text", lambda t: [(x, a, b) for x in terms for a, b in find_folded(t, x)], "term string, start_pos int, end_pos int")


def unmarked_places(texts: DataFrame, key: str, terms: list[str], profile: str = "spaces") -> DataFrame:
    """(key, term, start_pos, end_pos): where a term stands in the text without what the profile deletes; spans are raw.

    What was deleted between the first and the last character found lies inside the span.
    """

    def places(text: str) -> list[tuple]:
        bare, at = marks_with_origins(text, profile)
        out = []
        for x in terms:
            wanted = marks_with_origins(x, profile)[0]
            i = bare.find(wanted) if wanted else -1
            while i >= 0:
                out.append((x, at[i], at[i + len(wanted) - 1] + 1))
                i = bare.find(wanted, i + 1)
        return out

    return explode_spans(texts, key, "text", places, "term string, start_pos int, end_pos int")




def _stages(s, d):
    items, docs = table(s, d, "eval_items").select("item_id", "text"), table(s, d, "documents").select("doc_id", "text")
    statements = segments.spans_of(items, "item_id", segments.statement_spans)
    windows = segments.spans_of(items, "item_id", lambda t: segments.mention_spans(t, {"ANY": "gloss|reader|margin|قال|خبز"}), "kind")
    blocks = segments.spans_of(docs, "doc_id", segments.block_spans, "locator")
    return staged(items, statements, windows, docs, blocks, "item_id", "doc_id")


FOLDED_TERMS, SPACED_TERMS = ["الي", "هامش", "an e"], ["the", "قال:", "a b"]
QUERIES = {
    "coverage_stages": lambda s, d: _stages(s, d).groupBy("stage").agg(F.count(F.lit(1)).alias("n")),
    "coverage_places": _stages,
    "folded_places": lambda s, d: folded_places(table(s, d, "verses"), "verse_id", FOLDED_TERMS),
    "unmarked_places": lambda s, d: unmarked_places(table(s, d, "verses"), "verse_id", SPACED_TERMS),
}
# the folds spelled out once more, independently of functions.folds
_VOWELS = "[\\x{064B}-\\x{065F}\\x{0670}\\x{0640}]"
_GONE = "[\\x{064B}-\\x{0652}\\x{0656}-\\x{065F}\\x{0670}\\x{06D6}-\\x{06ED}\\[\\] \\t\\n\\r\\f\\v\\x{00A0}]"
_WORDS = lambda name, rows, key: f"""{name}_c AS (SELECT {key}, unnest(regexp_extract_all(text, '[\\s\\x{{1c}}-\\x{{1f}}\\x{{85}}\\p{{Z}}]*[^\\s\\x{{1c}}-\\x{{1f}}\\x{{85}}\\p{{Z}}]+')) AS c, generate_subscripts(regexp_extract_all(text, '[\\s\\x{{1c}}-\\x{{1f}}\\x{{85}}\\p{{Z}}]*[^\\s\\x{{1c}}-\\x{{1f}}\\x{{85}}\\p{{Z}}]+'), 1) AS i FROM {rows} WHERE text IS NOT NULL),
{name}_w AS (SELECT {key}, i, sum(length(c)) OVER w AS b, length(regexp_replace(c, '^[\\s\\x{{1c}}-\\x{{1f}}\\x{{85}}\\p{{Z}}]+', '')) AS n, translate(regexp_replace(regexp_replace(c, '^[\\s\\x{{1c}}-\\x{{1f}}\\x{{85}}\\p{{Z}}]+', ''), '{_VOWELS}', '', 'g'), 'أإآىة', 'اااي'||'ه') AS w FROM {name}_c WINDOW w AS (PARTITION BY {key} ORDER BY i)),
{name}_k AS (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY i) AS j FROM {name}_w WHERE w <> ''),
{name} AS (SELECT {key}, b - n AS a, lead(b, 9) OVER (PARTITION BY {key} ORDER BY j) AS b, list(w) OVER (PARTITION BY {key} ORDER BY j ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING) AS gram FROM {name}_k QUALIFY lead(b, 9) OVER (PARTITION BY {key} ORDER BY j) IS NOT NULL)"""  # noqa: E731
_PLACES = f"""WITH RECURSIVE {segments.statements_sql("eval_items", "item_id")}, {segments.mentions_sql("eval_items", "item_id", {"ANY": "gloss|reader|margin|قال|خبز"})},
{segments.blocks_sql("documents", "doc_id")}, {_WORDS("g", "eval_items", "item_id")}, {_WORDS("h", "documents", "doc_id")},
pl AS (SELECT item_id, g.a::INT AS start_pos, g.b::INT AS end_pos, doc_id, h.a::INT AS source_start, h.b::INT AS source_end,
  CASE WHEN NOT EXISTS (FROM st WHERE st.item_id = g.item_id AND st.start_pos <= g.a AND g.b <= st.end_pos) THEN '{STAGES[1]}'
       WHEN NOT EXISTS (FROM me WHERE me.item_id = g.item_id AND me.start_pos <= g.a AND g.b <= me.end_pos) THEN '{STAGES[2]}'
       WHEN NOT EXISTS (FROM bl WHERE bl.doc_id = h.doc_id AND bl.start_pos <= h.a AND h.b <= bl.end_pos) THEN '{STAGES[3]}' ELSE '{STAGES[4]}' END AS stage
  FROM g JOIN h USING (gram))"""
_FIND = lambda terms, kept, shown, joined, last: f"""WITH c AS (SELECT verse_id, unnest(string_split(text, '')) AS c, generate_subscripts(string_split(text, ''), 1) - 1 AS p, length(text) AS n FROM verses WHERE text <> ''),
k AS (SELECT verse_id, p, n, {shown} AS c, row_number() OVER (PARTITION BY verse_id ORDER BY p) AS i FROM c WHERE {kept}), r AS (SELECT *, {joined} AS again FROM k),
q AS (SELECT verse_id, p, n, c, row_number() OVER (PARTITION BY verse_id ORDER BY p) AS i FROM r WHERE NOT again),
t AS (SELECT verse_id, string_agg(c, '' ORDER BY i) AS folded, list(p ORDER BY i) AS ps, any_value(n) AS n FROM q GROUP BY verse_id),
x AS (SELECT *, unnest(range(1, length(folded) + 1)) AS f FROM t), y AS (SELECT x.*, term, wanted FROM x JOIN (VALUES {terms}) v(term, wanted) ON substr(folded, f, length(wanted)) = wanted)
SELECT verse_id, term, ps[f]::INT AS start_pos, ({last})::INT AS end_pos FROM y"""  # noqa: E731
SQL = {
    "coverage_places": _PLACES + " SELECT * FROM pl",
    "coverage_stages": _PLACES + " SELECT stage, count(*) AS n FROM pl GROUP BY stage",
    "folded_places": _FIND(
        "('الي', 'الي'), ('هامش', 'هامش'), ('an e', 'an e')", f"NOT regexp_matches(c, '{_VOWELS}')", "CASE WHEN regexp_matches(c, '[\\s\\x{1c}-\\x{1f}\\x{85}\\p{Z}]') THEN ' ' ELSE translate(c, 'أإآىة', 'اااي'||'ه') END",
        "c = ' ' AND coalesce(lag(c) OVER (PARTITION BY verse_id ORDER BY i) = ' ', false)", "coalesce(ps[f + length(wanted)], n)",
    ),
    "unmarked_places": _FIND("('the', 'the'), ('قال:', 'قال:'), ('a b', 'ab')", f"NOT regexp_matches(c, '{_GONE}')", "c", "false", "ps[f + length(wanted) - 1] + 1"),
}
