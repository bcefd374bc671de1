"""Queries over the scalar functions: folds, ids, digests, readers and slices, run over whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import folds
from ..functions.spans import explode_spans
from ..functions.text import canonical_json_sha256, git_blob_sha1, sha256, slice_text, stable_id, strict_timestamp
from ..plans.runtime import table
from ..sources.pipe_text import parsed
from ..sources.strict_json import blind_leaks, load, top_level_objects, with_errors
from .compare import _pairs, changed_regions, matched
from .matching import cutoff_tail

LOCATOR = r"^gitblob:([0-9a-f]{40})#char=([0-9]+):([0-9]+)$"


def resolved(rows: DataFrame, locator: str, text: str, excerpt: str) -> DataFrame:
    """Adds `resolves`: the locator parses, its blob is the text's, its range lies inside and the slice is the excerpt."""
    g = lambda i: F.regexp_extract(locator, LOCATOR, i)
    a, b = g(2).try_cast("int"), g(3).try_cast("int")
    ok = (g(1) == git_blob_sha1(F.col(text))) & (a < b) & (b <= F.length(text)) & (slice_text(F.col(text), a, b) == F.col(excerpt))
    return rows.withColumn("resolves", F.coalesce(ok, F.lit(False)))


def split_opening(sura: Column, aya: Column, text: Column, openings: list[str], exempt: tuple[int, ...] = (1, 9)) -> Column:
    """struct(opening, rest): the formula that begins first verses, taken off except in exempt chapters; null opening elsewhere."""
    first = (aya == 1) & ~sura.isin(*exempt)
    out = F.struct(F.lit(None).cast("string").alias("opening"), text.alias("rest"))
    for o in openings:
        out = F.when(first & F.startswith(text, F.lit(o + " ")), F.struct(F.lit(o).alias("opening"), F.substring(text, F.lit(len(o) + 2), F.length(text)).alias("rest"))).otherwise(out)
    return out


FOLDS = {"n_exact": lambda c: c, "n_match": folds.fold_match, "n_quran": folds.fold_quran_marks, "n_fingerprint": folds.fold_fingerprint, "n_brackets": folds.fold_brackets}


def fold_profile(texts: DataFrame, by: str) -> DataFrame:
    """Per group, how many different texts each fold leaves."""
    return texts.groupBy(by).agg(*(F.count_distinct(f(F.col("text"))).alias(n) for n, f in FOLDS.items()))


def _locators(s, d):
    t = table(s, d, "documents").where("length(text) > 60").select("doc_id", "source", "text", slice_text(F.col("text"), F.lit(20), F.lit(50)).alias("excerpt"))
    shifted = F.when(F.col("source").endswith("notes"), 21).otherwise(20)
    t = t.withColumn("locator", F.concat(F.lit("gitblob:"), git_blob_sha1(F.col("text")), F.lit("#char="), shifted.cast("string"), F.lit(":"), (shifted + 30).cast("string")))
    return resolved(t, "locator", "text", "excerpt").select("doc_id", "resolves")


def _stamps(s, d):
    at = F.date_format("loaded_at", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    broken = F.when(F.col("aya") % 3 == 0, F.regexp_replace(at, "T", " ")).when(F.col("aya") % 3 == 1, F.regexp_replace(at, "-[0-9]{2}T", "-31T")).otherwise(at)
    return table(s, d, "verses").where("aya is not null").select((F.col("aya") % 3).alias("kind"), strict_timestamp(broken).isNotNull().alias("ok")).groupBy("kind").agg(F.count_if("ok").alias("n_valid"), F.count(F.lit(1)).alias("n"))


def _pipes(s, d):
    v = table(s, d, "verses").where("sura between 0 and 999 and aya between 0 and 999 and text is not null")
    lines = v.select(F.concat_ws("|", F.col("sura").cast("string"), F.col("aya").cast("string"), "text").alias("value"))
    return parsed(lines).groupBy("sura", "aya").agg(F.count(F.lit(1)).alias("n"), F.min(sha256(F.col("text"))).alias("least_sha256"))


def _odd_json(s, d):
    """Events as JSON with every defect: a repeated key, NaN, a byte order mark, text after the value, sound and broken."""
    e = table(s, d, "events").select("event_id", "event_type", "props")
    body = F.coalesce("props", F.lit("{}"))
    odd = (
        F.when(F.col("event_type") == "click", F.lit('{"a": 1, "b": {"a": 2, "a": 3}}')).when(F.col("event_type") == "view", F.lit('{"a": NaN}'))
        .when(F.col("event_type") == "error", F.concat(F.lit("\ufeff"), body)).when(F.col("event_type") == "signup", F.concat(body, F.lit(" {}"))).otherwise(body)
    )
    return with_errors(e.withColumn("json", odd), "json").groupBy("event_type", F.coalesce("json_error", F.lit("OK")).alias("result")).agg(F.count(F.lit(1)).alias("n"))


def _told(s, d):
    """Model-like text around JSON objects, and inputs that name their answer."""
    return table(s, d, "events").select("event_id", "event_type", F.concat(F.lit("so it is: "), F.coalesce("props", F.lit("{}")), F.lit(' and {"t": "}{", "of": {"x": "'), "event_type", F.lit('"}} {open')).alias("text"))


def _objects(s, d):
    return explode_spans(_told(s, d), "event_id", "text", top_level_objects, "start_pos int, end_pos int")


KEYS, ANSWERS = frozenset({"label", "gold"}), frozenset({"click", "error"})


def _blind(s, d):
    asked = F.concat(F.lit('{"q": {"Label": 1, "said": ["a", "'), "event_type", F.lit('"]}, "text": "error?"}'))
    rows = table(s, d, "events").where("event_type is not null").select("event_id", asked.alias("text"))
    return explode_spans(rows, "event_id", "text", lambda t: [(p,) for p in blind_leaks(load(t), KEYS, ANSWERS)], "path string")


def _canonical(s, d):
    text = F.concat(F.lit('{ "z" : ['), F.col("event_id").cast("string"), F.lit(', 2 ],"a":{"d":"'), "event_type", F.lit('", "c":true}}'))
    return table(s, d, "events").where("event_type is not null").select("event_id", canonical_json_sha256(text).alias("digest"))


OPENINGS = ["إلى", "من", "عن", "Hūbaq", "Ṭīshīb", "في", "على", "هذا", "قال"]


def _openings(s, d):
    v = table(s, d, "verses").where("text is not null").withColumn("plain", folds.fold_marks(F.col("text")))
    return v.select("verse_id", split_opening(F.col("sura"), F.lit(1), F.col("plain"), OPENINGS).alias("x")).select("verse_id", "x.opening", F.md5("x.rest").alias("rest_md5"))


def _tails(s, d):
    """Verses cut to three quarters, with the other system's text as their witness."""
    v = matched(table(s, d, "verses").where("deleted_at is null"), table(s, d, "corpus_entries").where("source_kind = 'quran'"), ["source_id", "sura", "aya"])
    rows = v.select("source_id", "sura", "aya", F.substring("a", F.lit(1), (F.length("a") * 3 / 4).cast("int")).alias("text"), F.col("b").alias("witness"))
    return cutoff_tail(rows, 10, 40, 5).select("source_id", "sura", "aya", "tail", "unique", "continues")


def _tokens(s, d):
    return table(s, d, "documents").where("text is not null").select("doc_id", F.size(F.array_distinct(F.split(folds.fold_tokens(F.col("text")), r"\s+"))).alias("n_words"))


QUERIES = {
    "json_defects": _odd_json,
    "json_objects": _objects,
    "blind_leaks": _blind,
    "canonical_json": _canonical,
    "split_openings": _openings,
    "cutoff_tails": _tails,
    "fold_tokens": _tokens,
    "changed_regions": lambda s, d: changed_regions(_pairs(s, d).withColumn("k", F.concat_ws(":", "source_id", F.col("sura").cast("string"), F.col("aya").cast("string"))), "k"),
    "text_ids": lambda s, d: table(s, d, "documents").where("text is not null").select(
        "doc_id", git_blob_sha1(F.col("text")).alias("blob"), sha256(F.col("text")).alias("text_sha256"), stable_id("p:", F.coalesce("source", F.lit("")), F.col("text"), digits=32).alias("passage_id"),
    ),
    "fold_profile": lambda s, d: fold_profile(table(s, d, "verses"), "source_id"),
    "json_errors": lambda s, d: with_errors(table(s, d, "events"), "props").groupBy("event_type", F.coalesce("json_error", F.lit("OK")).alias("result")).agg(F.count(F.lit(1)).alias("n")),
    "locators": _locators,
    "strict_timestamps": _stamps,
    "pipe_lines": _pipes,
}
# the folds spelled out once more, independently of functions.folds: code points that go, letters that are replaced
_GONE = lambda ranges, old="", new="": (lambda c: f"translate({c}, '{old}', '{new}')" if old else c)("regexp_replace(text, '[" + "".join("-".join(rf"\x{{{x}}}" for x in r.split("-")) for r in ranges.split()) + "]', '', 'g')")
_WS = r"regexp_replace({}, '[\s\x{{85}}\p{{Z}}]+', ' ', 'g')"
_VOWELS = r"[\x{064B}-\x{0652}\x{0656}-\x{065F}\x{0670}\x{06D6}-\x{06ED}]"  # spelled out once more, independently of functions.folds
_LIT = lambda s: "'" + s.replace("'", "''") + "'"
_OPENED = " ".join(f"WHEN starts_with(p, '{o} ') THEN '{o}'" for o in reversed(OPENINGS))
SQL = {
    "json_defects": "SELECT event_type, CASE event_type WHEN 'click' THEN 'DUPLICATE_KEY' WHEN 'view' THEN 'NOT_A_NUMBER' WHEN 'error' THEN 'BOM' WHEN 'signup' THEN 'NOT_JSON' ELSE CASE WHEN json_valid(coalesce(props, '{}')) THEN 'OK' ELSE 'NOT_JSON' END END AS result, count(*) AS n FROM events GROUP BY ALL",
    "json_objects": f"WITH t AS (SELECT event_id, length('so it is: ') AS a, length(coalesce(props, '{{}}')) AS n, length(event_type) AS e FROM events) SELECT event_id, a::INT AS start_pos, (a + n)::INT AS end_pos FROM t UNION ALL SELECT event_id, (a + n + 5)::INT, (a + n + 5 + length({_LIT('{"t": "}{", "of": {"x": "')}) + e + 3)::INT FROM t",
    "blind_leaks": "SELECT event_id, 'input.q.Label' AS path FROM events WHERE event_type IS NOT NULL UNION ALL SELECT event_id, 'input.q.said[1]' FROM events WHERE event_type IN ('click', 'error')",
    "canonical_json": """SELECT event_id, sha256('{"a":{"c":true,"d":"' || event_type || '"},"z":[' || event_id || ',2]}') AS digest FROM events WHERE event_type IS NOT NULL""",
    "split_openings": f"WITH v AS (SELECT verse_id, sura, regexp_replace(text, '{_VOWELS}', '', 'g') AS p FROM verses WHERE text IS NOT NULL), o AS (SELECT *, CASE WHEN sura NOT IN (1, 9) THEN CASE {_OPENED} END END AS opening FROM v) SELECT verse_id, opening, md5(CASE WHEN opening IS NULL THEN p ELSE substr(p, length(opening) + 2) END) AS rest_md5 FROM o",
    "cutoff_tails": r"""WITH v AS (SELECT source_id, sura, aya, min(text) AS a FROM verses WHERE deleted_at IS NULL GROUP BY ALL), e AS (SELECT source_id, sura, aya, min(text) AS b FROM corpus_entries WHERE source_kind = 'quran' GROUP BY ALL), j AS (SELECT source_id, sura, aya, regexp_replace(substr(a, 1, (length(a) * 3 / 4)::DOUBLE::INT - CASE WHEN (length(a) * 3 / 4)::DOUBLE::INT > length(a) * 3.0 / 4 THEN 1 ELSE 0 END), '[^\p{L}]', '', 'g') AS t, regexp_replace(b, '[^\p{L}]', '', 'g') AS w FROM v JOIN e USING (source_id, sura, aya) WHERE a IS NOT NULL AND b IS NOT NULL), n AS (SELECT source_id, sura, aya, t, w, max(n) FILTER (length(t) >= n AND contains(w, right(t, n))) AS tail FROM j, (SELECT unnest(range(10, 41)) AS n) GROUP BY ALL) SELECT source_id, sura, aya, tail::INT AS tail, tail IS NOT NULL AND NOT contains(substr(w, instr(w, right(t, tail)) + 1), right(t, tail)) AS "unique", length(w) - (instr(w, right(t, tail)) - 1 + tail) >= 5 AS continues FROM n""",
    "text_ids": "SELECT doc_id, sha1('blob '::BLOB || strlen(text)::VARCHAR::BLOB || '\\x00'::BLOB || encode(text)) AS blob, sha256(text) AS text_sha256, 'p:' || substr(sha256(coalesce(source, '') || chr(31) || text || chr(31)), 1, 32) AS passage_id FROM documents WHERE text IS NOT NULL",
    "fold_profile": rf"SELECT source_id, count(DISTINCT text) AS n_exact, count(DISTINCT {_WS.format(_GONE('64B-65F 670 640', 'أإآىة', 'ااايه'))}) AS n_match, count(DISTINCT {_GONE('610-61A 64B-652 6D6-6DC 6DF-6E4 6E7-6E8 6EA-6ED')}) AS n_quran, count(DISTINCT trim({_WS.format(_GONE('610-61A 64B-65F 670 6D6-6ED 640', 'أإآى', 'اااي'))})) AS n_fingerprint, count(DISTINCT {_GONE('64B-652 656-65F 670 6D6-6ED 5B 5D')}) AS n_brackets FROM verses GROUP BY source_id",
    "json_errors": "SELECT event_type, CASE WHEN coalesce(json_valid(props), false) THEN 'OK' ELSE 'NOT_JSON' END AS result, count(*) AS n FROM events GROUP BY ALL",
    "locators": "SELECT doc_id, coalesce(NOT ends_with(source, 'notes'), true) OR substr(text, 22, 30) = substr(text, 21, 30) AS resolves FROM documents WHERE length(text) > 60",
    "strict_timestamps": "SELECT aya % 3 AS kind, count(*) FILTER (CASE aya % 3 WHEN 0 THEN false WHEN 1 THEN month(loaded_at) IN (1, 3, 5, 7, 8, 10, 12) ELSE true END) AS n_valid, count(*) AS n FROM verses WHERE aya IS NOT NULL GROUP BY ALL",
    "pipe_lines": "SELECT sura, aya, count(*) AS n, min(sha256(text)) AS least_sha256 FROM verses WHERE sura BETWEEN 0 AND 999 AND aya BETWEEN 0 AND 999 AND text IS NOT NULL GROUP BY ALL",
}
