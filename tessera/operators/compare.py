"""Keyed comparison of two text tables: difference classes, first differences, lowest similarity."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..functions.folds import collapse, fold_alef, fold_extended, markless, nfc
from ..plans.runtime import table

# The classes, in the order in which the first that fits is taken.
CLASSES = [
    "EXACT", "UNICODE_NFC_ONLY", "WHITESPACE_ONLY", "MARKS_ONLY_CANDIDATE", "ALEF_VARIANTS_CANDIDATE",
    "ADDITIONAL_SCRIPT_VARIANTS_CANDIDATE", "UNRESOLVED_SCRIPT_DIFFERENCE",
]

TRIAGE = [
    "EXACT", "UNICODE_CANONICAL_ONLY", "WHITESPACE_ONLY", "COMBINING_MARKS_ONLY_CANDIDATE", "TATWEEL_OR_MARKS_CANDIDATE", "TEXTUAL_REVIEW_REQUIRED",
]
WITNESS = [
    "EXACT_EQUAL", "ARABIC_MARKS_OR_EDITORIAL_BRACKET_DIFFERENCE", "WHITESPACE_DIFFERENCE", "TOKEN_BOUNDARY_DIFFERENCE_CANDIDATE",
    "TEXTUAL_DIFFERENCE_REQUIRES_REVIEW",
]
# The marks and white space that the witness comparison names.
WITNESS_MARKS = "".join(chr(o) for a, b in ((0x610, 0x61A), (0x64B, 0x65F), (0x670, 0x670), (0x6D6, 0x6ED)) for o in range(a, b + 1))
WITNESS_SPACE = " \t\n\r\f\v\u00a0"


def matched(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, a, b): the texts of keys on both sides, one row per key (the least text of repeated deliveries)."""
    a = left.groupBy(*keys).agg(F.min("text").alias("a"))
    b = right.groupBy(*keys).agg(F.min("text").alias("b"))
    return a.join(b, keys).where("a is not null and b is not null")


def classified(pairs: DataFrame) -> DataFrame:
    """Adds `class`: the first fold under which `a` and `b` are equal."""
    p = pairs.withColumns({"na": nfc("a"), "nb": nfc("b")})
    steps = [lambda c: c, lambda c: F.trim(collapse(c)), lambda c: F.trim(collapse(markless(c))), lambda c: fold_alef(F.trim(collapse(markless(c)))), lambda c: F.trim(fold_extended(markless(c)))]
    ladder = F.when(F.col("a") == F.col("b"), CLASSES[0])
    for name, f in zip(CLASSES[1:], steps):
        ladder = ladder.when(f(F.col("na")) == f(F.col("nb")), name)
    return p.withColumn("class", ladder.otherwise(CLASSES[-1])).drop("na", "nb")


def triaged(pairs: DataFrame) -> DataFrame:
    """Adds `class` of the import triage: like `classified`, but with tatweel as a step of its own and no letter variants."""
    p = pairs.withColumns({"na": nfc("a"), "nb": nfc("b")})
    flat = lambda c: F.trim(collapse(c))
    steps = [lambda c: c, flat, lambda c: markless(flat(c)), lambda c: F.translate(markless(flat(c)), "\u0640", "")]
    ladder = F.when(F.col("a") == F.col("b"), TRIAGE[0])
    for name, f in zip(TRIAGE[1:], steps):
        ladder = ladder.when(f(F.col("na")) == f(F.col("nb")), name)
    return p.withColumn("class", ladder.otherwise(TRIAGE[-1])).drop("na", "nb")


def witnessed(pairs: DataFrame) -> DataFrame:
    """Adds `class` of the witness comparison: marks and editorial brackets, then spaces, then where words are cut."""
    base = lambda c: F.translate(c, WITNESS_MARKS + "[]", "")
    spaced = lambda c: F.trim(F.regexp_replace(F.translate(base(c), WITNESS_SPACE, " " * len(WITNESS_SPACE)), " +", " "))
    steps = [base, spaced, lambda c: F.translate(base(c), WITNESS_SPACE, "")]
    ladder = F.when(F.col("a") == F.col("b"), WITNESS[0])
    for name, f in zip(WITNESS[1:], steps):
        ladder = ladder.when(f(F.col("a")) == f(F.col("b")), name)
    return pairs.withColumn("class", ladder.otherwise(WITNESS[-1]))


def class_counts(pairs: DataFrame, by: str, ladder=classified, classes: list[str] | None = None) -> DataFrame:
    """Per group the count of every class of a ladder, zeros included."""
    classes = classes or CLASSES
    got = ladder(pairs).groupBy(by).agg(*(F.count_if(F.col("class") == c).alias(c) for c in classes))
    return got.select(by, F.explode(F.map_from_arrays(F.array(*map(F.lit, classes)), F.array(*classes))).alias("class", "n"))


def first_differences(pairs: DataFrame, by: str, order: list[str], n: int = 20) -> DataFrame:
    """Of every group the first `n` differing keys in order, with how many differ in all."""
    d = pairs.where("a <> b").select(by, *order)
    # a rank with a bound alone is applied before the shuffle; the counts are combined on the map side
    first = d.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("rank") <= n)
    n = d.groupBy(F.col(by).alias("_by")).agg(F.count(F.lit(1)).alias("n_differing"))
    return first.join(n, F.col(by).eqNullSafe(F.col("_by"))).select(by, *order, "rank", "n_differing")


@F.pandas_udf(DoubleType())
def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Matching-blocks similarity without the popularity heuristic; not an edit distance."""
    return pd.Series([1.0 if x == y else difflib.SequenceMatcher(None, x, y, autojunk=False).ratio() for x, y in zip(a, b)], dtype=float)


def lowest_similarity(pairs: DataFrame, keys: list[str], n: int = 40) -> DataFrame:
    """The `n` least similar pairs; ties are ordered by the key written as one string."""
    ref = F.concat_ws(":", *(F.col(k).cast("string") for k in keys))
    return pairs.select(ref.alias("ref"), F.round(ratio("a", "b"), 6).alias("ratio")).orderBy("ratio", "ref").limit(n)


def changed_regions(pairs: DataFrame, key: str) -> DataFrame:
    """(key, tag, a_start, a_end, b_start, b_end) of every region that is not equal."""
    out = f"{key} {pairs.schema[key].dataType.simpleString()}, tag string, a_start int, a_end int, b_start int, b_end int"

    def run(frames):
        for f in frames:
            rows = [(k, *op) for k, a, b in zip(f[key], f["a"], f["b"]) for op in difflib.SequenceMatcher(None, a, b, autojunk=False).get_opcodes() if op[0] != "equal"]
            yield pd.DataFrame(rows, columns=[key, "tag", "a_start", "a_end", "b_start", "b_end"])

    return pairs.select(key, "a", "b").where("a <> b").mapInPandas(run, out)


def _pairs(s, d):
    return matched(table(s, d, "verses").where("deleted_at is null"), table(s, d, "corpus_entries").where("source_kind = 'quran'"), ["source_id", "sura", "aya"])


QUERIES = {
    "triage_classes": lambda s, d: class_counts(_pairs(s, d), "source_id", triaged, TRIAGE),
    "witness_classes": lambda s, d: class_counts(_pairs(s, d), "source_id", witnessed, WITNESS),
    "difference_classes": lambda s, d: class_counts(_pairs(s, d), "source_id"),
    "first_differences": lambda s, d: first_differences(_pairs(s, d), "source_id", ["sura", "aya"]),
    "lowest_similarity": lambda s, d: lowest_similarity(_pairs(s, d), ["source_id", "sura", "aya"]),
}
_P = "WITH p AS (SELECT * FROM (SELECT source_id, sura, aya, min(text) AS a FROM verses WHERE deleted_at IS NULL GROUP BY ALL) JOIN (SELECT source_id, sura, aya, min(text) AS b FROM corpus_entries WHERE source_kind = 'quran' GROUP BY ALL) USING (source_id, sura, aya) WHERE a IS NOT NULL AND b IS NOT NULL)"
_C = r"trim(regexp_replace({}, '[\s\x{{85}}\p{{Z}}]+', ' ', 'g'))"
_W = lambda x: _C.format(x)
_M = lambda x: _W(rf"regexp_replace({x}, '\p{{M}}', '', 'g')")
_A = lambda x: f"translate({_M(x)}, 'ٱأإآ', 'اااا')"
_E = lambda x: _W(f"translate({_A(x)}, 'ىـۥۦ۞۩', 'ي')")
_PAIR = lambda f: f"{f('nfc_normalize(a)')} = {f('nfc_normalize(b)')}"
_FLAT = lambda x: _W(f"nfc_normalize({x})")
_BARE = lambda x: rf"regexp_replace({_FLAT(x)}, '\p{{M}}', '', 'g')"
_BASE = lambda x: rf"regexp_replace({x}, '[\x{{610}}-\x{{61A}}\x{{64B}}-\x{{65F}}\x{{670}}\x{{6D6}}-\x{{6ED}}\[\]]', '', 'g')"
_CUT = lambda x, by: rf"regexp_replace({_BASE(x)}, '[ \t\n\r\f\v\x{{A0}}]+', '{by}', 'g')"
_EQ = lambda f: f"{f('a')} = {f('b')}"
_EACH = lambda case, classes: _P + f", c AS (SELECT source_id, {case} AS class FROM p) SELECT s.source_id, k.class, count(c.class) AS n FROM (SELECT DISTINCT source_id FROM c) s CROSS JOIN (SELECT unnest({classes}) AS class) k LEFT JOIN c ON c.source_id = s.source_id AND c.class = k.class GROUP BY ALL"
SQL = {
    "triage_classes": _EACH(f"CASE WHEN a = b THEN '{TRIAGE[0]}' WHEN nfc_normalize(a) = nfc_normalize(b) THEN '{TRIAGE[1]}' WHEN {_EQ(_FLAT)} THEN '{TRIAGE[2]}' WHEN {_EQ(_BARE)} THEN '{TRIAGE[3]}' WHEN replace({_BARE('a')}, chr(1600), '') = replace({_BARE('b')}, chr(1600), '') THEN '{TRIAGE[4]}' ELSE '{TRIAGE[5]}' END", TRIAGE),
    "witness_classes": _EACH(f"CASE WHEN a = b THEN '{WITNESS[0]}' WHEN {_EQ(_BASE)} THEN '{WITNESS[1]}' WHEN trim({_CUT('a', ' ')}) = trim({_CUT('b', ' ')}) THEN '{WITNESS[2]}' WHEN {_CUT('a', '')} = {_CUT('b', '')} THEN '{WITNESS[3]}' ELSE '{WITNESS[4]}' END", WITNESS),
    "difference_classes": _P
    + f", c AS (SELECT source_id, CASE WHEN a = b THEN '{CLASSES[0]}' WHEN nfc_normalize(a) = nfc_normalize(b) THEN '{CLASSES[1]}' WHEN {_PAIR(_W)} THEN '{CLASSES[2]}' WHEN {_PAIR(_M)} THEN '{CLASSES[3]}' WHEN {_PAIR(_A)} THEN '{CLASSES[4]}' WHEN {_PAIR(_E)} THEN '{CLASSES[5]}' ELSE '{CLASSES[6]}' END AS class FROM p) "
    + f"SELECT s.source_id, k.class, count(c.class) AS n FROM (SELECT DISTINCT source_id FROM c) s CROSS JOIN (SELECT unnest({CLASSES}) AS class) k LEFT JOIN c ON c.source_id = s.source_id AND c.class = k.class GROUP BY ALL",
    "first_differences": _P + ", d AS (SELECT source_id, sura, aya, row_number() OVER (PARTITION BY source_id ORDER BY sura, aya) AS rank, count(*) OVER (PARTITION BY source_id) AS n_differing FROM p WHERE a <> b) SELECT * FROM d WHERE rank <= 20",
}
