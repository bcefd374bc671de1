"""Scoring and corpus statistics: gold against prediction, gates, document frequency, rollups, percentiles."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.runtime import table


def safe_div(a: Column, b: Column) -> Column:
    """0 where the denominator is 0."""
    return F.coalesce(F.try_divide(a.cast("double"), b), F.lit(0.0))


def per_label(rows: DataFrame, labels: list[str]) -> DataFrame:
    """(label, tp, fp, fn, f1) for every declared label, those that never occur included; one scan of `rows(gold, pred)`.

    A null gold or prediction equals nothing and counts against the other side only.
    """
    hits = lambda x: (F.coalesce(F.col("gold") == x, F.lit(False)), F.coalesce(F.col("pred") == x, F.lit(False)))
    aggs = []
    for i, x in enumerate(labels):
        g, p = hits(x)
        aggs += [F.count_if(g & p).alias(f"tp{i}"), F.count_if(~g & p).alias(f"fp{i}"), F.count_if(g & ~p).alias(f"fn{i}")]
    wide = rows.agg(*aggs)
    long = wide.select(F.explode(F.array(*(F.struct(F.lit(x).alias("label"), F.col(f"tp{i}").alias("tp"), F.col(f"fp{i}").alias("fp"), F.col(f"fn{i}").alias("fn")) for i, x in enumerate(labels)))).alias("x")).select("x.*")
    precision, recall = safe_div(F.col("tp"), F.col("tp") + F.col("fp")), safe_div(F.col("tp"), F.col("tp") + F.col("fn"))
    return long.withColumn("f1", F.round(safe_div(2 * precision * recall, precision + recall), 6))


def macro_f1(rows: DataFrame, labels: list[str]) -> DataFrame:
    return per_label(rows, labels).agg(F.round(F.avg("f1"), 5).alias("macro_f1"))


def micro_prf(rows: DataFrame) -> DataFrame:
    """`rows(gold ARRAY, pred ARRAY)` to micro precision, recall and F1; a null set is empty."""
    g, p = F.coalesce("gold", F.array().cast("array<string>")), F.coalesce("pred", F.array().cast("array<string>"))
    n = rows.agg(*(F.coalesce(F.sum(F.size(x)), F.lit(0)).alias(k) for k, x in (("tp", F.array_intersect(g, p)), ("fp", F.array_except(p, g)), ("fn", F.array_except(g, p)))))
    n = n.withColumns({"precision": safe_div(F.col("tp"), F.col("tp") + F.col("fp")), "recall": safe_div(F.col("tp"), F.col("tp") + F.col("fn"))})
    f1 = safe_div(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))
    return n.select(*(F.round(x, 6).alias(k) for k, x in (("micro_precision", F.col("precision")), ("micro_recall", F.col("recall")), ("micro_f1", f1))))


def gated(metrics: DataFrame, rules: DataFrame) -> DataFrame:
    """`metrics(metric, actual)`, `rules(metric, least, most)` to (metric, actual, passed); a missing or NaN metric fails."""
    m = rules.join(metrics, "metric", "left")
    there = F.col("actual").isNotNull() & ~F.isnan("actual")
    ok = F.when(F.col("least").isNotNull(), F.col("actual") >= F.col("least")).when(F.col("most").isNotNull(), F.col("actual") <= F.col("most")).otherwise(F.lit(False))
    return m.select("metric", "actual", (there & F.coalesce(ok, F.lit(False))).alias("passed"))


def idf(texts: DataFrame, key: str) -> DataFrame:
    """(token, df, idf): ln((n + 1) / (df + 1)) + 1 over distinct lower-case words of at least two characters."""
    words = F.filter(F.array_distinct(F.split(F.lower("text"), r"[^\p{L}\p{N}]+")), lambda w: F.length(w) >= 2)
    df = texts.where("text is not null").select(F.explode(words).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    n = texts.where("text is not null").agg(F.count(F.lit(1)).alias("n"))
    return df.crossJoin(F.broadcast(n)).select("token", "df", F.round(F.log((F.col("n") + 1) / (F.col("df") + 1)) + 1, 6).alias("idf"))  # one row


def top_sources(rows: DataFrame, by: str, source: str, score: str, key: str, k: int = 3) -> DataFrame:
    """Of every group: the best row of each source, then the best `k` sources. Ties go to the smaller key.

    The first step is a maximum that combines on the map side, so the ranking sees one row per group and source.
    """
    best = rows.where(F.col(source).isNotNull()).groupBy(by, source).agg(F.max(F.struct(F.col(score).alias("score"), (-F.col(key)).alias("neg"))).alias("b"))
    flat = best.select(by, source, "b.score", (-F.col("b.neg")).alias(key))
    w = Window.partitionBy(by).orderBy(F.desc("score"), key)
    return flat.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def provenance(rows: DataFrame, by: str, split: str) -> DataFrame:
    """Per group: the count and the sorted distinct values of `split` in one string."""
    return rows.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.array_join(F.array_sort(F.collect_set(split)), ",").alias("splits"))


def percentiles(rows: DataFrame, by: str, value: str, points: tuple[float, ...] = (0.5, 0.95, 0.99)) -> DataFrame:
    """Exact percentiles with linear interpolation; null values are left out."""
    p = rows.groupBy(by).agg(F.percentile(value, F.array(*map(F.lit, points))).alias("p"))
    return p.select(by, *(F.round(F.col("p")[i], 6).alias(f"p{int(x * 100)}") for i, x in enumerate(points)))


def votes(rows: DataFrame, by: str, supports: int = 2) -> DataFrame:
    """`rows(by, vote)` to one status: any `object` is contested, then enough `support` and a `clear`, else undetermined."""
    n = rows.groupBy(by).agg(*(F.count_if(F.col("vote") == v).alias(v) for v in ("support", "clear", "object")))
    status = F.when(F.col("object") > 0, "CONTESTED").when((F.col("support") >= supports) & (F.col("clear") > 0), "SUPPORTED").otherwise("UNDETERMINED")
    return n.select(by, status.alias("status"))


def case_problems(gold: DataFrame, predictions: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, problem): cases that don't stand once on either side: `missing`, `unexpected`, `repeated_gold`, `repeated_prediction`.

    Scores count only where there are none. Each side is reduced to a count per case first. Null keys are cases like others.
    """
    n = lambda df, name: df.groupBy(*(F.col(k).alias(f"{name}_{k}") for k in keys)).agg(F.count(F.lit(1)).alias(name))
    on = [F.col(f"g_{k}").eqNullSafe(F.col(f"p_{k}")) for k in keys]
    both = n(gold, "g").join(n(predictions, "p"), reduce(lambda a, b: a & b, on), "full_outer")
    found = F.array_compact(F.array(
        F.when(F.col("p").isNull(), "missing"), F.when(F.col("g").isNull(), "unexpected"), F.when(F.col("g") > 1, "repeated_gold"), F.when(F.col("p") > 1, "repeated_prediction"),
    ))
    return both.select(*(F.when(F.col("g").isNotNull(), F.col(f"g_{k}")).otherwise(F.col(f"p_{k}")).alias(k) for k in keys), F.explode(found).alias("problem"))


def count_gates(rows: DataFrame, label: str, least: dict[str, int], denominators: dict[str, Column], least_of: dict[str, int]) -> DataFrame:
    """(metric, actual, passed): enough gold cases of every label, and large enough denominators; what isn't there counts 0.

    `least` are labels with their least number, `denominators` conditions over the rows, `least_of` their least number.
    One scan whatever the number of gates.
    """
    gates = {f"gold_label_count:{k}": (F.coalesce(F.col(label) == k, F.lit(False)), n) for k, n in least.items()}
    gates |= {f"{k}_denominator": (F.coalesce(denominators.get(k, F.lit(False)), F.lit(False)), n) for k, n in least_of.items()}
    wide = rows.agg(*(F.count_if(c).alias(f"n{i}") for i, (c, _) in enumerate(gates.values())))
    each = F.array(*(F.struct(F.lit(k).alias("metric"), F.col(f"n{i}").alias("actual"), (F.col(f"n{i}") >= n).alias("passed")) for i, (k, (_, n)) in enumerate(gates.items())))
    return wide.select(F.explode(each).alias("x")).select("x.*")


def safety_rates(rows: DataFrame, unsafe: tuple[list[str], list[str]], collapse: tuple[list[str], list[str]]) -> DataFrame:
    """(metric, numerator, denominator, rate) of `rows(gold, pred, gold_direction, pred_direction, gold_sources, pred_sources)`.

    `unsafe_merge`: of cases with a gold label of the first list, those predicted as one of the second. `scope_collapse`
    likewise. `direction_error`: of cases with a gold direction, those whose prediction differs or has none.
    `provenance_preservation`: of all cases, those whose predicted sources (arrays, order aside) are the gold ones. A rate
    over no case is 0.
    """
    is_one = lambda c, values: F.coalesce(F.col(c).isin(*values), F.lit(False))
    directed = F.col("gold_direction").isNotNull()
    parts = {
        "unsafe_merge": (is_one("gold", unsafe[0]), is_one("pred", unsafe[1])), "direction_error": (directed, ~F.col("pred_direction").eqNullSafe(F.col("gold_direction"))),
        "scope_collapse": (is_one("gold", collapse[0]), is_one("pred", collapse[1])),
        "provenance_preservation": (F.lit(True), F.coalesce(F.array_sort("pred_sources") == F.array_sort("gold_sources"), F.lit(False))),
    }
    wide = rows.agg(*(F.count_if(d & n).alias(f"{k}_n") for k, (d, n) in parts.items()), *(F.count_if(d).alias(f"{k}_d") for k, (d, _) in parts.items()))
    each = F.array(*(F.struct(F.lit(k).alias("metric"), F.col(f"{k}_n").alias("numerator"), F.col(f"{k}_d").alias("denominator")) for k in parts))
    return wide.select(F.explode(each).alias("x")).select("x.*", F.round(safe_div(F.col("x.numerator"), F.col("x.denominator")), 6).alias("rate"))


def evidence_ranking(texts: DataFrame, key: str, source: str, query: list[str], priority: list[str], k: int, anchor: str | None = None) -> DataFrame:
    """(rank, source, key, score): the best text of each source for a query, then the best `k` sources.

    The score is the sum of idf (3 times for priority words) of the query's words that a text has, over the root of its
    number of different words; only scores above 0 count, ties go to the smaller key, and the anchor's source is left out.
    The query travels as a literal, so texts are scored where they are; idf comes from all texts.
    """
    words = F.filter(F.array_distinct(F.split(F.lower("text"), r"[^\p{L}\p{N}]+")), lambda w: F.length(w) >= 2)
    rows = texts.where("text is not null").select(key, source, words.alias("_w"))
    asked = sorted({w.lower() for w in [*query, *priority]})
    wide = rows.agg(F.count(F.lit(1)).alias("n"), *(F.count_if(F.array_contains("_w", w)).alias(f"d{i}") for i, w in enumerate(asked))).first()
    weight = {w: (math.log((wide["n"] + 1) / (wide[f"d{i}"] + 1)) + 1) * (3 if w in {p.lower() for p in priority} else 1) for i, w in enumerate(asked)}
    total = sum((F.when(F.array_contains("_w", w), F.lit(x)).otherwise(0.0) for w, x in weight.items()), F.lit(0.0))
    scored = rows.select(key, source, F.round(total / F.sqrt(F.greatest(F.size("_w"), F.lit(1))), 6).alias("score")).where((F.col("score") > 0) & F.col(source).isNotNull())
    if anchor is not None:
        scored = scored.where(F.col(source) != anchor)
    best = scored.groupBy(source).agg(F.min(F.struct((-F.col("score")).alias("_s"), key)).alias("b"))
    top = best.select(source, (-F.col("b._s")).alias("score"), F.col(f"b.{key}").alias(key)).orderBy(F.desc("score"), key).limit(k)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), key)))  # k rows


LABELS = ["quran", "tafsir", "translation", "hadith"]


def _judged(s, d):
    kind = F.lower(F.coalesce("source_id", F.lit("")))
    pred = F.when(kind.rlike("^(ta|tafsir)[-_]"), "tafsir").when(kind.rlike("^(tr|translation)[-_]"), "translation").otherwise("quran")
    return table(s, d, "corpus_entries").select(F.col("source_kind").alias("gold"), pred.alias("pred"))


def _sets(s, d):
    one = lambda t, c: table(s, d, t).where("sura is not null and aya is not null").groupBy("sura", "aya").agg(F.collect_set("source_id").alias(c))
    return one("corpus_entries", "gold").join(one("verses", "pred"), ["sura", "aya"], "full_outer")


def _gates(s, d):
    rules = s.createDataFrame([("tafsir", 0.9, None), ("hadith", 0.5, None), ("quran", None, 0.99), ("absent", 0.1, None)], "metric string, least double, most double")
    return gated(per_label(_judged(s, d), LABELS).select(F.col("label").alias("metric"), F.col("f1").alias("actual")), rules)


def _cases(s, d):
    return case_problems(table(s, d, "verses").where("deleted_at is null"), table(s, d, "corpus_entries").where("source_kind = 'quran'"), ["source_id", "sura", "aya"])


def _count_gates(s, d):
    j = _judged(s, d)
    return count_gates(j, "gold", {"tafsir": 100, "hadith": 1, "quran": 10**9}, {"merge": F.col("gold") == "tafsir", "all": F.lit(True)}, {"merge": 50, "all": 10**9, "absent": 1})


def _safety(s, d):
    """Entries as cases: kinds are labels, the parity of the page a direction, the works on both sides provenance."""
    e = table(s, d, "corpus_entries").where("source_kind is not null")
    v = table(s, d, "verses").where("deleted_at is null").groupBy("source_id", "sura", "aya").agg(F.min("page_no").alias("page"))
    kind = F.lower(F.coalesce("source_id", F.lit("")))
    pred = F.when(kind.rlike("^(ta|tafsir)[-_]"), "tafsir").when(kind.rlike("^tr[-_]"), "translation").otherwise("quran")
    side = lambda c: F.when(c % 2 == 0, "even").when(c % 2 == 1, "odd")
    rows = e.join(v, ["source_id", "sura", "aya"], "left").select(
        F.col("source_kind").alias("gold"), pred.alias("pred"), side(F.col("page_no")).alias("gold_direction"), side(F.col("page")).alias("pred_direction"),
        F.array(F.coalesce("source_id", F.lit("")), F.lit("x")).alias("gold_sources"), F.when(F.col("source_id").isNotNull(), F.array(F.lit("x"), F.lower("source_id"))).alias("pred_sources"),
    )
    return safety_rates(rows, (["tafsir", "translation"], ["quran"]), (["translation"], ["tafsir", "quran"]))


QUERY, PRIORITY = ["gloss", "margin", "reader", "قال", "في", "la"], ["gloss", "هامش"]
QUERIES = {
    "case_problems": _cases,
    "count_gates": _count_gates,
    "safety_rates": _safety,
    "evidence_ranking": lambda s, d: evidence_ranking(table(s, d, "documents"), "doc_id", "source", QUERY, PRIORITY, 8, "ferry-lectures"),
    "per_label": lambda s, d: per_label(_judged(s, d), LABELS),
    "macro_f1": lambda s, d: macro_f1(_judged(s, d), LABELS),
    "micro_prf": lambda s, d: micro_prf(_sets(s, d)),
    "threshold_gate": _gates,
    "idf_scores": lambda s, d: idf(table(s, d, "documents"), "doc_id"),
    "top_sources": lambda s, d: top_sources(table(s, d, "documents").where("text is not null").withColumn("size", F.length("text")), "lang", "source", "size", "doc_id"),
    "provenance_counts": lambda s, d: provenance(table(s, d, "documents"), "source", "lang"),
    "percentiles": lambda s, d: percentiles(table(s, d, "events"), "event_type", "value"),
    "vote_status": lambda s, d: votes(table(s, d, "events").select("user_id", F.element_at(F.create_map(*(F.lit(x) for x in ("click", "support", "view", "support", "purchase", "clear", "error", "object"))), F.col("event_type")).alias("vote")), "user_id"),
}
_J = "WITH j AS (SELECT source_kind AS gold, CASE WHEN regexp_matches(lower(coalesce(source_id, '')), '^(ta|tafsir)[-_]') THEN 'tafsir' WHEN regexp_matches(lower(coalesce(source_id, '')), '^(tr|translation)[-_]') THEN 'translation' ELSE 'quran' END AS pred FROM corpus_entries), c AS (SELECT label, count(*) FILTER (gold = label AND pred = label) AS tp, count(*) FILTER (coalesce(gold <> label, true) AND pred = label) AS fp, count(*) FILTER (gold = label AND pred <> label) AS fn FROM j CROSS JOIN (SELECT unnest(['quran', 'tafsir', 'translation', 'hadith']) AS label) GROUP BY label), f AS (SELECT *, round(CASE WHEN 2 * tp + fp + fn = 0 THEN 0 ELSE 2.0 * tp / (2 * tp + fp + fn) END, 6) AS f1 FROM c)"
_TERMS = ", ".join(f"('{w}', {3 if w in PRIORITY else 1})" for w in sorted({*QUERY, *PRIORITY}))
SQL = {
    "case_problems": "WITH g AS (SELECT source_id, sura, aya, count(*) AS n FROM verses WHERE deleted_at IS NULL GROUP BY ALL), p AS (SELECT source_id, sura, aya, count(*) AS n FROM corpus_entries WHERE source_kind = 'quran' GROUP BY ALL), j AS (SELECT CASE WHEN g.n IS NOT NULL THEN g.source_id ELSE p.source_id END AS source_id, CASE WHEN g.n IS NOT NULL THEN g.sura ELSE p.sura END AS sura, CASE WHEN g.n IS NOT NULL THEN g.aya ELSE p.aya END AS aya, g.n AS g, p.n AS p FROM g FULL JOIN p ON g.source_id IS NOT DISTINCT FROM p.source_id AND g.sura IS NOT DISTINCT FROM p.sura AND g.aya IS NOT DISTINCT FROM p.aya) SELECT source_id, sura, aya, 'missing' AS problem FROM j WHERE p IS NULL UNION ALL SELECT source_id, sura, aya, 'unexpected' FROM j WHERE g IS NULL UNION ALL SELECT source_id, sura, aya, 'repeated_gold' FROM j WHERE g > 1 UNION ALL SELECT source_id, sura, aya, 'repeated_prediction' FROM j WHERE p > 1",
    "count_gates": "WITH n AS (SELECT count(*) FILTER (source_kind = 'tafsir') AS t, count(*) FILTER (source_kind = 'hadith') AS h, count(*) FILTER (source_kind = 'quran') AS q, count(*) AS a FROM corpus_entries) SELECT 'gold_label_count:tafsir' AS metric, t AS actual, t >= 100 AS passed FROM n UNION ALL SELECT 'gold_label_count:hadith', h, h >= 1 FROM n UNION ALL SELECT 'gold_label_count:quran', q, q >= 1000000000 FROM n UNION ALL SELECT 'merge_denominator', t, t >= 50 FROM n UNION ALL SELECT 'all_denominator', a, a >= 1000000000 FROM n UNION ALL SELECT 'absent_denominator', 0, false FROM n",
    "safety_rates": "WITH v AS (SELECT source_id, sura, aya, min(page_no) AS page FROM verses WHERE deleted_at IS NULL GROUP BY ALL), r AS (SELECT source_kind AS gold, CASE WHEN regexp_matches(lower(coalesce(e.source_id, '')), '^(ta|tafsir)[-_]') THEN 'tafsir' WHEN regexp_matches(lower(coalesce(e.source_id, '')), '^tr[-_]') THEN 'translation' ELSE 'quran' END AS pred, page_no % 2 AS gd, page % 2 AS pd, e.source_id FROM corpus_entries e LEFT JOIN v ON v.source_id = e.source_id AND v.sura = e.sura AND v.aya = e.aya WHERE source_kind IS NOT NULL), n AS (SELECT 'unsafe_merge' AS metric, count(*) FILTER (gold IN ('tafsir', 'translation') AND pred = 'quran') AS numerator, count(*) FILTER (gold IN ('tafsir', 'translation')) AS denominator FROM r UNION ALL SELECT 'direction_error', count(*) FILTER (gd IS NOT NULL AND pd IS DISTINCT FROM gd), count(gd) FROM r UNION ALL SELECT 'scope_collapse', count(*) FILTER (gold = 'translation' AND pred IN ('tafsir', 'quran')), count(*) FILTER (gold = 'translation') FROM r UNION ALL SELECT 'provenance_preservation', count(*) FILTER (source_id = lower(source_id)), count(*) FROM r) SELECT *, round(CASE WHEN denominator = 0 THEN 0 ELSE numerator / denominator END, 6) AS rate FROM n",
    "evidence_ranking": rf"WITH w AS (SELECT doc_id, source, list_filter(list_distinct(regexp_split_to_array(lower(text), '[^\p{{L}}\p{{N}}]+')), lambda x: length(x) >= 2) AS w FROM documents WHERE text IS NOT NULL), q AS (SELECT * FROM (VALUES {_TERMS}) t(term, factor)), i AS (SELECT term, factor * (ln(((SELECT count(*) FROM w) + 1) / (count(w.doc_id) + 1)) + 1) AS x FROM q LEFT JOIN w ON list_contains(w.w, q.term) GROUP BY term, factor), s AS (SELECT doc_id, source, round(sum(x) / sqrt(greatest(any_value(len(w)), 1)), 6) AS score FROM w JOIN i ON list_contains(w.w, i.term) WHERE source <> 'ferry-lectures' GROUP BY doc_id, source), b AS (SELECT * FROM s WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY source ORDER BY score DESC, doc_id) = 1) SELECT source, doc_id, score, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM b QUALIFY rank <= 8",
    "per_label": _J + " SELECT * FROM f",
    "macro_f1": _J + " SELECT round(avg(f1), 5) AS macro_f1 FROM f",
    "micro_prf": "WITH g AS (SELECT DISTINCT sura, aya, source_id FROM corpus_entries WHERE sura IS NOT NULL AND aya IS NOT NULL AND source_id IS NOT NULL), p AS (SELECT DISTINCT sura, aya, source_id FROM verses WHERE sura IS NOT NULL AND aya IS NOT NULL AND source_id IS NOT NULL), n AS (SELECT (SELECT count(*) FROM g JOIN p USING (sura, aya, source_id)) AS tp, (SELECT count(*) FROM g) AS ng, (SELECT count(*) FROM p) AS np) SELECT round(tp / np, 6) AS micro_precision, round(tp / ng, 6) AS micro_recall, round(2 * (tp / np) * (tp / ng) / (tp / np + tp / ng), 6) AS micro_f1 FROM n",
    "threshold_gate": _J + " SELECT r.metric, f1 AS actual, coalesce(CASE WHEN least IS NOT NULL THEN f1 >= least ELSE f1 <= most END, false) AS passed FROM (VALUES ('tafsir', 0.9, NULL), ('hadith', 0.5, NULL), ('quran', NULL, 0.99), ('absent', 0.1, NULL)) r(metric, least, most) LEFT JOIN f ON f.label = r.metric",
    "idf_scores": r"WITH w AS (SELECT doc_id, unnest(list_distinct(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'))) AS token FROM documents WHERE text IS NOT NULL), n AS (SELECT count(*) AS n FROM documents WHERE text IS NOT NULL) SELECT token, count(*) AS df, round(ln((any_value(n) + 1) / (count(*) + 1)) + 1, 6) AS idf FROM w, n WHERE length(token) >= 2 GROUP BY token",
    "top_sources": "WITH b AS (SELECT lang, source, doc_id, length(text) AS score, row_number() OVER (PARTITION BY lang, source ORDER BY length(text) DESC, doc_id) AS r FROM documents WHERE source IS NOT NULL AND text IS NOT NULL), t AS (SELECT lang, source, score, doc_id, row_number() OVER (PARTITION BY lang ORDER BY score DESC, doc_id) AS rank FROM b WHERE r = 1) SELECT * FROM t WHERE rank <= 3",
    "provenance_counts": "SELECT source, count(*) AS n, coalesce(string_agg(DISTINCT lang, ',' ORDER BY lang), '') AS splits FROM documents GROUP BY source",
    "percentiles": "SELECT event_type, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99 FROM events GROUP BY event_type",
    "vote_status": "WITH n AS (SELECT user_id, count(*) FILTER (event_type IN ('click', 'view')) AS s, count(*) FILTER (event_type = 'purchase') AS c, count(*) FILTER (event_type = 'error') AS o FROM events GROUP BY user_id) SELECT user_id, CASE WHEN o > 0 THEN 'CONTESTED' WHEN s >= 2 AND c > 0 THEN 'SUPPORTED' ELSE 'UNDETERMINED' END AS status FROM n",
}
