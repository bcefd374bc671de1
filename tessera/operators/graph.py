"""Graphs and rules: closure, cycles, components, typed edges, pairs in a group, three-valued rules, exact subsets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import sha256, stable_id
from ..plans.running import greatest_before
from ..plans.runtime import materialize, table

DEPTH = 128  # fixed value: paths longer than this are refused


def closure(edges: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(src, dst, depth): every reachable pair with its least number of steps, by joining the frontier until it is empty.

    A cycle gives a row with src = dst and ends there. Raises when paths are still growing at `depth`.
    """
    edges = materialize(edges.where("src is not null and dst is not null").select("src", "dst").distinct())
    found = frontier = materialize(edges.withColumn("depth", F.lit(1)))
    for step in range(2, depth + 2):
        grown = frontier.join(edges.select(F.col("src").alias("dst"), F.col("dst").alias("_to")), "dst").where("src <> dst").select("src", F.col("_to").alias("dst")).distinct()
        frontier = materialize(grown.join(found, ["src", "dst"], "left_anti").withColumn("depth", F.lit(step)))
        if frontier.isEmpty():
            return found
        if step > depth:
            raise ValueError(f"paths are longer than {depth}")
        found = materialize(found.unionByName(frontier))
    return found


def on_cycle(edges: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(node): the nodes that reach themselves."""
    return closure(edges, depth).where("src = dst").select(F.col("src").alias("node"))


def components(records: DataFrame, key: str, links: DataFrame, most: int = 200) -> DataFrame:
    """(key, component): records that share any link stay together; the component is its least key.

    `links(key, link)` ties records to shared values (a source, a family, a digest), never to each other, so a value
    that a third of all records share stays linear. Labels travel along least values until nothing changes; each
    round is written to the shared folder. Records without a link are their own component.
    """
    ties = materialize(links.where(f"{key} is not null and link is not null").select(key, "link").distinct())
    labels = materialize(records.where(f"{key} is not null").select(key, F.col(key).alias("component")).distinct())
    for _ in range(most):
        by_link = ties.join(labels, key).groupBy("link").agg(F.min("component").alias("c"))
        low = ties.join(by_link, "link").groupBy(key).agg(F.min("c").alias("c"))
        # a component's own component may already have a lower label: jump there too
        jump = labels.select(F.col(key).alias("c"), F.col("component").alias("j"))
        new = labels.join(low, key, "left").withColumn("c", F.least("component", F.coalesce("c", "component"))).join(jump, "c", "left").select(key, "component", F.least("c", F.coalesce("j", "c")).alias("n"))
        new = materialize(new)
        if new.where("n <> component").isEmpty():
            return labels
        labels = new.select(key, F.col("n").alias("component"))
    raise ValueError("labels still change")


def exact_subset(sizes: list[tuple[str, int]], target: int) -> list[str] | None:
    """Names of components whose sizes add up to exactly `target`, or None. A component list is a driver-side plan.

    Reachable sums are the bits of one integer per component taken so far; the choice is read backwards: a component is
    in it where the sum could not be reached without it.
    """
    steps = [1]
    for _, size in sizes:
        steps.append(steps[-1] | (steps[-1] << size) & ((1 << target + 1) - 1))
    if target < 0 or not steps[-1] >> target & 1:
        return None
    chosen, left = [], target
    for (name, size), before in zip(reversed(sizes), reversed(steps[:-1])):
        if not before >> left & 1:
            chosen.append(name)
            left -= size
    return chosen[::-1]


def topological(nodes: dict[str, list[str]]) -> list[str]:
    """Dependency-first order of a small plan, names breaking ties; a missing dependency or a cycle raises."""
    left, done = {k: set(v) for k, v in nodes.items()}, []
    if missing := set().union(*left.values(), set()) - set(left):
        raise ValueError(f"missing dependencies: {sorted(missing)}")
    while left:
        ready = sorted(k for k, v in left.items() if not v - set(done))
        if not ready:
            raise ValueError(f"cycle among {sorted(left)}")
        done.append(ready[0])
        del left[ready[0]]
    return done


def pairs_in_group(spans: DataFrame, group: str, key: str, start: str, end: str) -> DataFrame:
    """(group, first, second): spans of one text that don't overlap, in order. A group is one text, so it is bounded by it."""
    a, b = spans.alias("a"), spans.alias("b")
    before = F.expr(f"a.{group} = b.{group} and a.{end} <= b.{start} and (a.{start} < b.{start} or a.{start} = b.{start} and a.{key} < b.{key})")
    return a.join(b, before).select(F.col(f"a.{group}").alias(group), F.col(f"a.{key}").alias("first"), F.col(f"b.{key}").alias("second"))


def ordered_pairs(left: DataFrame, right: DataFrame, by: str, title: str, at: str) -> DataFrame:
    """(by, left_at, right_at): titles of one work unique on both sides, kept while the right position grows past the last kept.

    A pair that is kept has the greatest right position so far, so the last kept one is the running maximum, which is
    found in two levels: a work with a third of all titles is spread. Null works and titles pair with nothing.
    """
    one = lambda df, name: df.where(F.col(title).isNotNull() & F.col(by).isNotNull()).groupBy(by, title).agg(F.min(at).alias(name), F.count(F.lit(1)).alias("n")).where("n = 1").drop("n")
    met = one(left, "left_at").join(one(right, "right_at"), [by, title]).select(by, F.col("left_at").cast("long").alias("left_at"), F.col("right_at").cast("long").alias("right_at"))
    kept = greatest_before(met, by, ["left_at", "right_at"], "right_at", "_last")
    return kept.where("_last is null or right_at > _last").drop("_last")


def evaluate(rules: DataFrame, facts: DataFrame, objections: DataFrame) -> DataFrame:
    """One step of three-valued rules: (rule_id, status).

    `rules(rule_id, if_all, unless_any)` hold arrays of (atom, truth); `facts(atom, truth)`; `objections(rule_id, status)`.
    A missing fact is unknown, never false. A premise that fails makes a rule not applicable, before an exception that
    holds, before an open or sustained objection, before anything unknown.
    """
    known = facts.where("atom is not null and truth is not null").groupBy("atom").agg(F.bool_or("truth").alias("fact"))
    long = lambda c: rules.select("rule_id", F.lit(c).alias("role"), F.explode(c).alias("x")).select("rule_id", "role", "x.atom", "x.truth")
    clauses = long("if_all").unionByName(long("unless_any")).join(known, "atom", "left")
    holds = F.col("fact") == F.col("truth")
    seen = clauses.groupBy("rule_id").agg(
        F.bool_or((F.col("role") == "if_all") & ~holds).alias("failed"), F.bool_or((F.col("role") == "unless_any") & holds).alias("excepted"), F.bool_or(F.col("fact").isNull()).alias("unknown")
    )
    blocked = objections.where("status in ('open', 'sustained')").select("rule_id", F.lit(True).alias("blocked")).distinct()
    status = (
        F.when(F.col("failed"), "NOT_APPLICABLE").when(F.col("excepted"), "BLOCKED_BY_EXCEPTION").when(F.col("blocked"), "BLOCKED_BY_OBJECTION")
        .when(F.col("unknown"), "UNDETERMINED").otherwise("CONDITIONALLY_SUPPORTED")
    )
    return rules.select("rule_id").join(seen, "rule_id", "left").join(blocked, "rule_id", "left").select("rule_id", status.alias("status"))


def conclusions(rules: DataFrame, statuses: DataFrame, facts: DataFrame) -> DataFrame:
    """(atom, status, supported_truth): contested where supported rules disagree or contradict a given fact."""
    known = facts.groupBy(F.col("atom")).agg(F.bool_or("truth").alias("fact"))
    s = rules.select("rule_id", F.col("then.atom").alias("atom"), F.col("then.truth").alias("truth")).join(statuses, "rule_id")
    ok = F.col("status") == "CONDITIONALLY_SUPPORTED"
    n = s.groupBy("atom").agg(F.bool_or(ok & F.col("truth")).alias("yes"), F.bool_or(ok & ~F.col("truth")).alias("no")).join(known, "atom", "left")
    contested = (F.col("yes") & F.col("no")) | F.coalesce((F.col("yes") & ~F.col("fact")) | (F.col("no") & F.col("fact")), F.lit(False))
    some = F.col("yes") | F.col("no")
    return n.select("atom", F.when(contested, "CONTESTED").when(some, "CONDITIONALLY_SUPPORTED").otherwise("UNDETERMINED").alias("status"), F.when(some & ~contested, F.col("yes")).alias("supported_truth"))


def dangling(references: list[tuple[str, DataFrame, DataFrame]]) -> DataFrame:
    """(rule, n_rows, n_dangling) for each (name, references(ref), targets(id)); null references are not counted."""
    each = []
    for name, refs, targets in references:
        known = targets.where("id is not null").select(F.col("id").alias("ref")).distinct().withColumn("_k", F.lit(True))
        each.append(refs.where("ref is not null").join(known, "ref", "left").groupBy().agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col("_k").isNull()).alias("n_dangling")).select(F.lit(name).alias("rule"), "*"))
    return reduce(DataFrame.unionByName, each)


def evidence_graph(works: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Content-addressed nodes (kind, node_id) and edges (kind, src, dst) of works, verses and passages, each once."""
    w = works.where("source is not null and sura is not null and aya is not null and text is not null").select(
        stable_id("work:", F.col("source")).alias("work"), stable_id("verse:", F.col("verse_source"), F.col("sura"), F.col("aya")).alias("verse"),
        stable_id("passage:", F.col("source"), sha256(F.col("text"))).alias("passage"),
    )
    nodes = reduce(DataFrame.unionByName, [w.select(F.lit(k).alias("kind"), F.col(k).alias("node_id")) for k in ("work", "verse", "passage")]).where("node_id is not null").distinct()
    edges = w.select(F.lit("passage_of").alias("kind"), F.col("passage").alias("src"), F.col("work").alias("dst")).unionByName(
        w.select(F.lit("comments_on").alias("kind"), F.col("passage").alias("src"), F.col("verse").alias("dst"))
    ).where("dst is not null").distinct()
    return nodes, edges


def _kind_counts(s, d):
    nodes, edges = evidence_graph(table(s, d, "tafsirs"))
    count = lambda df, what: df.groupBy("kind").agg(F.count(F.lit(1)).alias("n")).select(F.lit(what).alias("what"), "kind", "n")
    return count(nodes, "node").unionByName(count(edges, "edge"))


def _edges(s, d):
    t = lambda n, a, b, p, q: table(s, d, n).select(F.concat(F.lit(p), F.col(a).cast("string")).alias("src"), F.concat(F.lit(q), F.col(b).cast("string")).alias("dst"))
    return t("supplier", "s_suppkey", "s_nationkey", "s", "n").unionByName(t("customer", "c_custkey", "c_nationkey", "c", "n")).unionByName(t("nation", "n_nationkey", "n_regionkey", "n", "r"))


def _ring(s, d):
    return table(s, d, "nation").select(F.col("n_nationkey").cast("long").alias("src"), ((F.col("n_nationkey") * 7 + 3) % 30).cast("long").alias("dst"))


def _paragraph_links(s, d):
    p = table(s, d, "documents").where("text is not null").select("doc_id", F.explode(F.split("text", "\n\n")).alias("p"))
    return p.where(F.length("p") >= 40).select("doc_id", F.md5("p").alias("link"))


def _parts(s, d):
    lines = table(s, d, "documents").where("text is not null").select("doc_id", F.posexplode(F.split("text", "\n\n")).alias("part", "p"))
    w = Window.partitionBy("doc_id").orderBy("part").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.length("p") + 2).over(w) - 2
    return lines.select("doc_id", "part", (end - F.length("p")).alias("a"), end.alias("b"))


def _rules(s, d):
    """Two rules a verse: equal texts say that both copies are the same, unequal pages that they aren't; not of withdrawn sources."""
    v = table(s, d, "verses").where("deleted_at is null").groupBy("source_id", "sura", "aya").agg(F.min("text").alias("a"), F.min("page_no").alias("pa"))
    e = table(s, d, "corpus_entries").where("source_kind = 'quran'").groupBy("source_id", "sura", "aya").agg(F.min("text").alias("b"), F.min("page_no").alias("pb"), F.bool_or(F.col("footnotes") == "").alias("blank"), F.bool_or(F.length("footnotes") > 0).alias("noted"))
    k = v.join(e, ["source_id", "sura", "aya"], "full_outer").where("source_id is not null and sura is not null and aya is not null")
    k = k.withColumn("k", F.concat_ws(":", "source_id", F.col("sura").cast("string"), F.col("aya").cast("string")))
    clause = lambda name, of, truth: F.struct(F.concat(F.lit(name), F.col(of)).alias("atom"), F.lit(truth).alias("truth"))
    rule = lambda name, fact, truth: k.select(F.concat(F.lit(name), "k").alias("rule_id"), F.array(clause(fact, "k", truth)).alias("if_all"), F.array(clause("withdrawn:", "source_id", True)).alias("unless_any"), clause("same:", "k", truth).alias("then"))
    fact = lambda name, truth: k.select(F.concat(F.lit(name), "k").alias("atom"), truth.alias("truth"))
    facts = fact("text:", F.col("a") == F.col("b")).unionByName(fact("page:", F.col("pa") == F.col("pb"))).unionByName(
        table(s, d, "corpus_sources").select(F.concat(F.lit("withdrawn:"), "source_id").alias("atom"), F.col("withdrawn_at").isNotNull().alias("truth"))
    )
    objections = k.where("blank or noted").select(F.concat(F.lit("t:"), "k").alias("rule_id"), F.when(F.col("blank"), "open").otherwise("answered").alias("status"))
    return rule("t:", "text:", True).unionByName(rule("p:", "page:", False)), facts, objections


def _references(s, d):
    e, t, src, v = (table(s, d, n) for n in ("corpus_entries", "tafsirs", "corpus_sources", "verses"))
    return dangling([
        ("entry_source", e.select(F.col("source_id").alias("ref")), src.select(F.col("source_id").alias("id"))),
        ("verse_source", v.select(F.col("source_id").alias("ref")), src.select(F.col("source_id").alias("id"))),
        ("tafsir_witness", t.select(F.col("verse_source").alias("ref")), v.select(F.col("source_id").alias("id"))),
    ])


def _numbered(s, d):
    v = table(s, d, "verses").where("deleted_at is null").select("source_id", "text", F.col("verse_id").alias("at"))
    e = table(s, d, "corpus_entries").where("source_kind = 'quran'").select("source_id", "text", F.col("entry_id").alias("at"))
    return ordered_pairs(v, e, "source_id", "text", "at")


def _subset(s, d):
    """Whether sources can be chosen that hold exactly half of all documents, or a third: sizes are one row a source."""
    sizes = [(r.source, r.n) for r in table(s, d, "documents").where("source is not null").groupBy("source").agg(F.count(F.lit(1)).alias("n")).orderBy("source").collect()]
    whole = sum(n for _, n in sizes)
    rows = []
    for part in (2, 3, 1000):
        chosen = exact_subset(sizes, whole // part)
        rows.append((whole // part, chosen is not None, sum(dict(sizes)[x] for x in chosen or [])))
    return s.createDataFrame(rows, "target long, reachable boolean, total long")


def _plan(s, d):
    """Regions before their nations, as a plan that is ordered on the driver."""
    pairs = table(s, d, "nation").select("n_name", "n_regionkey").collect()
    nodes = {f"r{r.n_regionkey}": [] for r in pairs} | {f"n{r.n_name}": [f"r{r.n_regionkey}"] for r in pairs}
    return s.createDataFrame([(i, x) for i, x in enumerate(topological(nodes), 1)], "place long, node string")


QUERIES = {
    "context_edges": lambda s, d: evidence_graph(table(s, d, "tafsirs"))[1],
    "ring_closure": lambda s, d: closure(_ring(s, d)),
    "exact_subset": _subset,
    "plan_order": _plan,
    "closure": lambda s, d: closure(_edges(s, d)),
    "on_cycle": lambda s, d: on_cycle(_ring(s, d)),
    "components": lambda s, d: components(table(s, d, "documents"), "doc_id", _paragraph_links(s, d)),
    "pairs_in_group": lambda s, d: pairs_in_group(_parts(s, d), "doc_id", "part", "a", "b"),
    "ordered_pairs": _numbered,
    "rule_status": lambda s, d: evaluate(*_rules(s, d)),
    "rule_conclusions": lambda s, d: conclusions(_rules(s, d)[0], evaluate(*_rules(s, d)), _rules(s, d)[1]),
    "dangling_references": _references,
    "kind_counts": _kind_counts,
}
_R = """WITH v AS (SELECT source_id, sura, aya, min(text) AS a, min(page_no) AS pa FROM verses WHERE deleted_at IS NULL GROUP BY ALL), e AS (SELECT source_id, sura, aya, min(text) AS b, min(page_no) AS pb, bool_or(footnotes = '') AS blank FROM corpus_entries WHERE source_kind = 'quran' GROUP BY ALL),
k AS (SELECT source_id || ':' || sura || ':' || aya AS k, a = b AS text, pa = pb AS page, coalesce(blank, false) AS blank, withdrawn_at, s.source_id IS NOT NULL AS known FROM v FULL JOIN e USING (source_id, sura, aya) LEFT JOIN corpus_sources s USING (source_id) WHERE source_id IS NOT NULL AND sura IS NOT NULL AND aya IS NOT NULL),
t AS (SELECT k, CASE WHEN NOT text THEN 'NOT_APPLICABLE' WHEN withdrawn_at IS NOT NULL THEN 'BLOCKED_BY_EXCEPTION' WHEN blank THEN 'BLOCKED_BY_OBJECTION' WHEN text IS NULL OR NOT known THEN 'UNDETERMINED' ELSE 'CONDITIONALLY_SUPPORTED' END AS t,
  CASE WHEN page THEN 'NOT_APPLICABLE' WHEN withdrawn_at IS NOT NULL THEN 'BLOCKED_BY_EXCEPTION' WHEN page IS NULL OR NOT known THEN 'UNDETERMINED' ELSE 'CONDITIONALLY_SUPPORTED' END AS p FROM k)
"""
_OK = "source IS NOT NULL AND sura IS NOT NULL AND aya IS NOT NULL AND text IS NOT NULL"
_ID = lambda kind, *parts: f"'{kind}:' || substr(sha256({' || chr(31) || '.join(parts)} || chr(31)), 1, 40)"
SQL = {
    "context_edges": f"WITH t AS (SELECT * FROM tafsirs WHERE source IS NOT NULL AND sura IS NOT NULL AND aya IS NOT NULL AND text IS NOT NULL) SELECT DISTINCT 'passage_of' AS kind, {_ID('passage', 'source', 'sha256(text)')} AS src, {_ID('work', 'source')} AS dst FROM t UNION SELECT 'comments_on', {_ID('passage', 'source', 'sha256(text)')}, {_ID('verse', 'verse_source', 'sura', 'aya')} FROM t WHERE verse_source IS NOT NULL",
    "ring_closure": "WITH RECURSIVE e AS (SELECT n_nationkey::BIGINT AS src, ((n_nationkey * 7 + 3) % 30)::BIGINT AS dst FROM nation), c AS (SELECT src, dst, 1 AS depth FROM e UNION SELECT c.src, e.dst, c.depth + 1 FROM c JOIN e ON c.dst = e.src WHERE c.src <> c.dst AND c.depth < 40) SELECT src, dst, min(depth) AS depth FROM c GROUP BY src, dst",
    "exact_subset": "WITH RECURSIVE n AS (SELECT source, count(*) AS n, row_number() OVER (ORDER BY source) AS i FROM documents WHERE source IS NOT NULL GROUP BY source), s AS (SELECT 0::BIGINT AS i, 0::BIGINT AS t UNION SELECT n.i, s.t + x.k * n.n FROM s JOIN n ON n.i = s.i + 1, (VALUES (0), (1)) x(k)), g AS (SELECT (SELECT sum(n) FROM n)::BIGINT // p AS target FROM (VALUES (2), (3), (1000)) v(p)) SELECT target, target IN (SELECT t FROM s) AS reachable, CASE WHEN target IN (SELECT t FROM s) THEN target ELSE 0 END AS total FROM g",
    "plan_order": "WITH x AS (SELECT DISTINCT 'r' || n_regionkey AS node, 'r' || n_regionkey AS region, 0 AS l FROM nation UNION ALL SELECT 'n' || n_name, 'r' || n_regionkey, 1 FROM nation) SELECT row_number() OVER (ORDER BY region, l, node) AS place, node FROM x",
    "ordered_pairs": "WITH RECURSIVE l AS (SELECT source_id, text, min(verse_id) AS l FROM verses WHERE deleted_at IS NULL AND source_id IS NOT NULL AND text IS NOT NULL GROUP BY ALL HAVING count(*) = 1), r AS (SELECT source_id, text, min(entry_id) AS r FROM corpus_entries WHERE source_kind = 'quran' AND source_id IS NOT NULL AND text IS NOT NULL GROUP BY ALL HAVING count(*) = 1), m AS (SELECT source_id, l, r, row_number() OVER (PARTITION BY source_id ORDER BY l) AS i FROM l JOIN r USING (source_id, text)), k AS (SELECT source_id, i, l, r, r AS last, true AS ok FROM m WHERE i = 1 UNION ALL SELECT m.source_id, m.i, m.l, m.r, CASE WHEN m.r > k.last THEN m.r ELSE k.last END, m.r > k.last FROM k JOIN m ON m.source_id = k.source_id AND m.i = k.i + 1) SELECT source_id, l AS left_at, r AS right_at FROM k WHERE ok",
    "closure": "WITH n AS (SELECT 'n' || n_nationkey AS src, 'r' || n_regionkey AS dst FROM nation), l AS (SELECT 's' || s_suppkey AS src, 'n' || s_nationkey AS dst FROM supplier UNION SELECT 'c' || c_custkey, 'n' || c_nationkey FROM customer) SELECT src, dst, 1 AS depth FROM n UNION SELECT src, dst, 1 FROM l UNION SELECT l.src, n.dst, 2 FROM l JOIN n ON l.dst = n.src",
    "on_cycle": "WITH RECURSIVE e AS (SELECT n_nationkey AS src, (n_nationkey * 7 + 3) % 30 AS dst FROM nation), c AS (SELECT src, dst FROM e UNION SELECT c.src, e.dst FROM c JOIN e ON c.dst = e.src) SELECT src::BIGINT AS node FROM c WHERE src = dst",
    "components": "WITH RECURSIVE p AS (SELECT doc_id, unnest(string_split(text, chr(10)||chr(10))) AS p FROM documents), l AS (SELECT DISTINCT doc_id, md5(p) AS link FROM p WHERE length(p) >= 40), e AS (SELECT DISTINCT a.doc_id AS x, b.doc_id AS y FROM l a JOIN l b USING (link) WHERE a.doc_id <> b.doc_id), r AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x) SELECT x AS doc_id, min(y) AS component FROM r GROUP BY x",
    "pairs_in_group": "WITH p AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10)||chr(10)), 1) - 1 AS part FROM documents WHERE text IS NOT NULL) SELECT doc_id, a.part AS first, b.part AS second FROM p a JOIN p b USING (doc_id) WHERE a.part < b.part",
    "rule_status": _R + "SELECT 't:' || k AS rule_id, t AS status FROM t UNION ALL SELECT 'p:' || k, p FROM t",
    "rule_conclusions": _R + "SELECT 'same:' || k AS atom, CASE WHEN t = p AND t = 'CONDITIONALLY_SUPPORTED' THEN 'CONTESTED' WHEN 'CONDITIONALLY_SUPPORTED' IN (t, p) THEN 'CONDITIONALLY_SUPPORTED' ELSE 'UNDETERMINED' END AS status, CASE WHEN t = p THEN NULL WHEN t = 'CONDITIONALLY_SUPPORTED' THEN true WHEN p = 'CONDITIONALLY_SUPPORTED' THEN false END AS supported_truth FROM t",
    "dangling_references": "SELECT 'entry_source' AS rule, count(*) AS n_rows, count(*) FILTER (source_id NOT IN (SELECT source_id FROM corpus_sources)) AS n_dangling FROM corpus_entries WHERE source_id IS NOT NULL UNION ALL SELECT 'verse_source', count(*), count(*) FILTER (source_id NOT IN (SELECT source_id FROM corpus_sources)) FROM verses WHERE source_id IS NOT NULL UNION ALL SELECT 'tafsir_witness', count(*), count(*) FILTER (verse_source NOT IN (SELECT source_id FROM verses WHERE source_id IS NOT NULL)) FROM tafsirs WHERE verse_source IS NOT NULL",
    "kind_counts": f"SELECT 'node' AS what, 'work' AS kind, count(DISTINCT source) AS n FROM tafsirs WHERE {_OK} UNION ALL SELECT 'node', 'verse', count(DISTINCT (verse_source, sura, aya)) FROM tafsirs WHERE {_OK} AND verse_source IS NOT NULL UNION ALL SELECT 'node', 'passage', count(DISTINCT (source, text)) FROM tafsirs WHERE {_OK} UNION ALL SELECT 'edge', 'passage_of', count(DISTINCT (source, text)) FROM tafsirs WHERE {_OK} UNION ALL SELECT 'edge', 'comments_on', count(DISTINCT (source, text, verse_source, sura, aya)) FROM tafsirs WHERE {_OK} AND verse_source IS NOT NULL",
}
