"""Evidence bundles: structural validation, rootedness of claims, typed traversal, bound endpoints, projected edges, registries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import has_text, sha256
from ..plans.runtime import materialize, table
from .graph import DEPTH

SALT = "projection"  # default of the salted handles


def _problem(df: DataFrame, code: str, entity: str) -> DataFrame:
    return df.select(F.lit(code).alias("code"), F.col(entity).alias("entity"))


def duplicate_ids(collections: dict[str, DataFrame]) -> DataFrame:
    """(code, entity): ids that occur more than once in or across collections. A duplicate is a violation and never dropped."""
    ids = reduce(DataFrame.unionByName, [c.select("id") for c in collections.values()])
    return _problem(ids.where("id is not null").groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "DUPLICATE_ID", "id")


def unknown_references(refs: DataFrame, targets: DataFrame, code: str) -> DataFrame:
    """(code, entity): owners in `refs(owner, ref)` with a reference that no target id has; null references are none."""
    known = targets.select(F.col("id").alias("ref")).distinct()
    return _problem(refs.where("ref is not null").join(known, "ref", "left_anti").select("owner").distinct(), code, "owner")


def rooted(claims: DataFrame, premises: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(id, rooted, level): whether all that a claim rests on is sound, and how many steps it is from its farthest source.

    `claims(id, sound)`; `premises(id, premise)`. A claim is rooted if it is sound and every premise is known and rooted.
    Levels are settled from the sources up, one written round each; a claim on a cycle, or above one, is never settled
    and keeps a null level, not rooted. Raises when claims are still being settled at `depth`.
    """
    edges = materialize(premises.where("id is not null and premise is not null").select("id", "premise").distinct())
    open_ = materialize(claims.where("id is not null").groupBy("id").agg(F.bool_and(F.coalesce("sound", F.lit(False))).alias("sound")))
    missing = edges.join(open_.select(F.col("id").alias("premise")), "premise", "left_anti").select("id").distinct()
    known = materialize(edges.join(open_.select(F.col("id").alias("premise")), "premise", "left_semi").groupBy("id").agg(F.count(F.lit(1)).alias("known")))
    ready = open_.join(edges.select("id").distinct(), "id", "left_anti").select("id", F.col("sound").alias("rooted"), F.lit(1).alias("level"))
    settled = fresh = materialize(ready)
    for level in range(2, depth + 2):
        above = edges.join(fresh.select(F.col("id").alias("premise")), "premise").select("id").distinct()
        met = edges.join(above, "id", "left_semi").join(settled.select(F.col("id").alias("premise"), "rooted"), "premise", "left")
        whole = met.groupBy("id").agg(F.bool_and(F.coalesce("rooted", F.lit(False))).alias("all"), F.count_if(F.col("rooted").isNull()).alias("waiting"))
        lost = missing.select("id", F.lit(True).alias("lost"))
        done = met.where("rooted is not null").groupBy("id").agg(F.count(F.lit(1)).alias("done"))
        now = (
            whole.join(known, "id").join(done, "id").where("done = known").join(lost, "id", "left").join(open_, "id")
            .select("id", (F.col("all") & F.col("sound") & F.col("lost").isNull()).alias("rooted"), F.lit(level).alias("level"))
        )
        fresh = materialize(now.join(settled.select("id"), "id", "left_anti"))
        if fresh.isEmpty():
            return open_.select("id").join(settled, "id", "left").select("id", F.coalesce("rooted", F.lit(False)).alias("rooted"), "level")
        if level > depth:
            raise ValueError(f"proofs are longer than {depth}")
        settled = materialize(settled.unionByName(fresh))
    return settled


def validated(sources: DataFrame, evidence: DataFrame, claims: DataFrame, inferences: DataFrame, premises: DataFrame, objections: DataFrame) -> DataFrame:
    """(code, entity) of everything that is wrong in a bundle; no rows say that its structure holds and no more.

    `sources(id)`; `evidence(id, source_id, excerpt, excerpt_sha256, status, method)`; `claims(id, kind, evidence_ids
    ARRAY, assessment)`, kind `source` or `inferred`; `inferences(id, conclusion)`; `premises(inference, premise)`, one row
    each, so a conclusion may rest on any number; `objections(id, target, status)`. Evidence is verified exactly if its method isn't `unverified`; a source claim needs verified evidence and
    nothing else, an inferred one an inference; an objection that isn't answered contradicts `no_recorded_objection` on
    the conclusion and on everything that rests on it.
    """
    ref = lambda df, owner, column: df.select(F.col(owner).alias("owner"), F.col(column).alias("ref"))
    many = lambda df, column: df.select(F.col("id").alias("owner"), F.explode(column).alias("ref"))
    good = evidence.where("status = 'verified'").select(F.col("id").alias("ref"), F.lit(True).alias("_ok")).distinct()
    own = claims.where("kind = 'source'").select(F.col("id").alias("owner"), F.explode_outer("evidence_ids").alias("ref")).join(good, "ref", "left")
    sound = own.groupBy("owner").agg(F.bool_and(F.coalesce("_ok", F.lit(False))).alias("sound"))
    concluded = inferences.select(F.col("conclusion").alias("owner"), F.lit(True).alias("has")).distinct()
    state = claims.join(sound, claims["id"] == sound["owner"], "left").drop("owner").join(concluded, claims["id"] == concluded["owner"], "left").drop("owner")
    state = materialize(state.select("id", "kind", "assessment", F.when(F.col("kind") == "source", F.coalesce("sound", F.lit(False)) & F.col("has").isNull()).otherwise(F.coalesce("has", F.lit(False))).alias("sound")))
    named = premises
    premises = materialize(premises.join(inferences.select(F.col("id").alias("inference"), "conclusion"), "inference").select(F.col("conclusion").alias("id"), "premise"))
    roots = rooted(state.select("id", "sound"), premises)
    # what rests on a conclusion that is objected to: from each, upwards until nothing new is reached
    hit = reached = materialize(objections.where("status <> 'answered'").join(inferences.select(F.col("id").alias("target"), "conclusion"), "target").select(F.col("conclusion").alias("id")).distinct())
    for _ in range(DEPTH):
        hit = materialize(premises.join(hit.select(F.col("id").alias("premise")), "premise").select("id").distinct().join(reached, "id", "left_anti"))
        if hit.isEmpty():
            break
        reached = materialize(reached.unionByName(hit))
    parts = [
        duplicate_ids({"sources": sources, "evidence": evidence, "claims": claims, "inferences": inferences, "objections": objections}),
        unknown_references(ref(evidence, "id", "source_id"), sources, "UNKNOWN_SOURCE"),
        unknown_references(many(claims, "evidence_ids"), evidence, "UNKNOWN_EVIDENCE"),
        unknown_references(ref(inferences, "id", "conclusion"), claims, "UNKNOWN_CONCLUSION"),
        unknown_references(ref(named, "inference", "premise"), claims, "UNKNOWN_PREMISE"),
        unknown_references(ref(objections, "id", "target"), inferences, "UNKNOWN_TARGET"),
        _problem(evidence.where(~sha256(F.col("excerpt")).eqNullSafe(F.col("excerpt_sha256"))), "DIGEST_MISMATCH", "id"),
        _problem(evidence.where((F.col("status") == "verified") == (F.col("method") == "unverified")), "INCONSISTENT_VERIFICATION", "id"),
        _problem(state.where("not sound"), "UNSOUND_CLAIM", "id"),
        _problem(roots.where("not rooted"), "UNROOTED_CLAIM", "id"),
        _problem(roots.where("level is null"), "CYCLE", "id"),
        _problem(state.where("assessment = 'no_recorded_objection'").join(reached, "id", "left_semi"), "OPEN_OBJECTION", "id"),
    ]
    return reduce(DataFrame.unionByName, parts)


def traversed(starts: DataFrame, edges: DataFrame, path: list[str]) -> DataFrame:
    """(start, status, end): every start followed along one edge of each kind of `path`, where there is exactly one.

    `starts(start)`, `edges(kind, src, dst)`. `RESOLVED` with its end, `MISSING:<kind>` or `AMBIGUOUS:<kind>` at the first
    step that has none or several. Edges are reduced to one row per source before each join.
    """
    at = starts.where("start is not null").select("start").distinct().select("start", F.col("start").alias("node"), F.lit(None).cast("string").alias("failed"))
    for kind in path:
        one = edges.where(F.col("kind") == kind).groupBy(F.col("src").alias("node")).agg(F.min("dst").alias("lo"), F.max("dst").alias("hi"))
        at = at.join(one, "node", "left").select(
            "start", F.when(F.col("failed").isNull() & (F.col("lo") == F.col("hi")), F.col("lo")).alias("node"),
            F.coalesce("failed", F.when(F.col("lo").isNull(), F.lit(f"MISSING:{kind}")).when(F.col("lo") != F.col("hi"), F.lit(f"AMBIGUOUS:{kind}"))).alias("failed"),
        )
    return at.select("start", F.coalesce("failed", F.lit("RESOLVED")).alias("status"), F.col("node").alias("end"))


def unbound_endpoints(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """(link, node, ref): endpoints of `links(link, node, ref)` that the node's `evidence_refs` array doesn't name; an unknown node names none."""
    bound = nodes.select("node", F.explode("evidence_refs").alias("ref")).distinct()
    return links.where("ref is not null").join(bound, ["node", "ref"], "left_anti").select("link", "node", "ref")


def projected_edges(edges: dict[str, DataFrame], salt: str = SALT) -> DataFrame:
    """(edge_type, src, dst): the set of typed edges of all collections, their ends as salted digests."""
    handle = lambda c: sha256(F.concat_ws("\u001f", F.lit(salt), F.col(c).cast("string")))
    parts = [df.where("src is not null and dst is not null").select(F.lit(k).alias("edge_type"), handle("src").alias("src"), handle("dst").alias("dst")) for k, df in edges.items()]
    return reduce(DataFrame.unionByName, parts).distinct()


def registry_problems(rows: DataFrame, key: str, enums: dict[str, list[str]], parent: tuple[str, str] | None = None, filled: list[str] | None = None) -> DataFrame:
    """(entry, problem) of a dimension table: repeated keys, values outside their list, blank columns, unequal to the parent.

    `parent` is (column naming another entry, column that must be equal on both).
    """
    e = rows.select(F.col(key).alias("entry"), *[c for c in rows.columns if c != key])
    parts = [e.where("entry is not null").groupBy("entry").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("entry", F.lit("REPEATED_KEY").alias("problem"))]
    parts += [e.where(~F.coalesce(F.col(c).isin(*values), F.lit(False))).select("entry", F.lit(f"NOT_ALLOWED:{c}").alias("problem")) for c, values in enums.items()]
    parts += [e.where(~has_text(F.col(c))).select("entry", F.lit(f"BLANK:{c}").alias("problem")) for c in filled or []]
    if parent:
        other = e.select(F.col("entry").alias(parent[0]), F.col(parent[1]).alias("_want"), F.lit(True).alias("_there")).dropDuplicates([parent[0]])
        met = e.where(F.col(parent[0]).isNotNull()).join(other, parent[0], "left")
        parts.append(met.where("_there is null").select("entry", F.lit("UNKNOWN_PARENT").alias("problem")))
        parts.append(met.where(F.col("_there") & ~F.col(parent[1]).eqNullSafe(F.col("_want"))).select("entry", F.lit(f"DIFFERS_FROM_PARENT:{parent[1]}").alias("problem")))
    return reduce(DataFrame.unionByName, parts)


def layered(layers: dict[str, DataFrame], key: str) -> tuple[DataFrame, DataFrame]:
    """(key, layer, ordinal) of all layers in their order, and (key, n) of keys that stand in more than one row.

    Ordinals continue from layer to layer. A key in two layers is a violation and told, never dropped.
    """
    from ..plans.running import ranked

    union = reduce(DataFrame.unionByName, [df.where(F.col(key).isNotNull()).select(key, F.lit(i).alias("_layer"), F.lit(name).alias("layer")) for i, (name, df) in enumerate(layers.items())])
    union = materialize(union)
    n = union.groupBy("_layer").agg(F.count(F.lit(1)).alias("_n"))
    before = n.alias("a").join(n.alias("b"), F.expr("b._layer < a._layer"), "left").groupBy("a._layer").agg(F.coalesce(F.sum("b._n"), F.lit(0)).alias("_from"))  # one row a layer
    placed = ranked(union, "_layer", key, "_i").join(F.broadcast(before), "_layer").select(key, "layer", (F.col("_from") + F.col("_i")).alias("ordinal"))
    return placed, union.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def _bundle(s, d):
    e = table(s, d, "corpus_entries")
    sources = table(s, d, "corpus_sources").select(F.concat(F.lit("s:"), "source_id").alias("id"))
    digest = F.when(F.col("page_no").isNull(), F.lit("")).otherwise(sha256(F.col("text")))
    evidence = e.select(
        F.concat(F.lit("e:"), F.col("entry_id").cast("string")).alias("id"), F.concat(F.lit("s:"), "source_id").alias("source_id"), F.col("text").alias("excerpt"), digest.alias("excerpt_sha256"),
        F.when(F.col("text").isNotNull(), "verified").otherwise("pending").alias("status"), F.when(F.col("footnotes") == "", "unverified").otherwise("manual").alias("method"),
    )
    keyed = e.where("sura is not null and aya is not null")
    claim = lambda kind: F.concat_ws(":", F.lit(kind), F.col("sura").cast("string"), F.col("aya").cast("string"))
    first = e.select(F.concat(F.lit("c:"), F.col("entry_id").cast("string")).alias("id"), F.lit("source").alias("kind"), F.array(F.concat(F.lit("e:"), F.col("entry_id").cast("string"))).alias("evidence_ids"), F.lit("no_recorded_objection").alias("assessment"))
    verse = keyed.select(claim("v").alias("id")).distinct()
    chapter = keyed.select(F.concat_ws(":", F.lit("k"), F.col("sura").cast("string")).alias("id")).distinct()
    inferred = verse.unionByName(chapter).select("id", F.lit("inferred").alias("kind"), F.array().cast("array<string>").alias("evidence_ids"), F.lit("no_recorded_objection").alias("assessment"))
    inferences = verse.unionByName(chapter).select(F.concat(F.lit("i:"), "id").alias("id"), F.col("id").alias("conclusion"))
    by_verse = keyed.select(F.concat(F.lit("i:"), claim("v")).alias("inference"), F.concat(F.lit("c:"), F.col("entry_id").cast("string")).alias("premise"))
    by_chapter = keyed.select(F.concat_ws(":", F.lit("i:k"), F.col("sura").cast("string")).alias("inference"), claim("v").alias("premise")).distinct()
    objections = keyed.where("source_kind = 'tafsir' and page_no is null").select(F.concat(F.lit("o:"), F.col("entry_id").cast("string")).alias("id"), F.concat(F.lit("i:"), claim("v")).alias("target"), F.when(F.col("aya") % 2 == 0, "open").otherwise("answered").alias("status"))
    return sources, evidence, first.unionByName(inferred), inferences, by_verse.unionByName(by_chapter), objections


def _path(s, d):
    t, v = table(s, d, "tafsirs"), table(s, d, "verses").where("deleted_at is null")
    key = lambda w: F.concat_ws(":", w, F.col("sura").cast("string"), F.col("aya").cast("string"))
    whole = lambda *c: " and ".join(f"{x} is not null" for x in c)
    comments = t.where(whole("verse_source", "sura", "aya")).select(F.lit("comments_on").alias("kind"), F.concat(F.lit("t"), F.col("tafsir_id").cast("string")).alias("src"), key("verse_source").alias("dst"))
    written = v.where(whole("source_id", "sura", "aya")).select(F.lit("written_in").alias("kind"), key("source_id").alias("src"), F.concat(F.lit("v"), F.col("verse_id").cast("string")).alias("dst"))
    paged = v.where("page_no is not null").select(F.lit("on_page").alias("kind"), F.concat(F.lit("v"), F.col("verse_id").cast("string")).alias("src"), F.concat(F.lit("p"), F.col("page_no").cast("string")).alias("dst"))
    starts = t.select(F.concat(F.lit("t"), F.col("tafsir_id").cast("string")).alias("start"))
    return traversed(starts, comments.unionByName(written).unionByName(paged), ["comments_on", "written_in", "on_page"])


def _endpoints(s, d):
    nodes = table(s, d, "verses").where("sura is not null and aya is not null").groupBy(F.concat_ws(":", F.col("sura").cast("string"), F.col("aya").cast("string")).alias("node")).agg(F.collect_set("source_id").alias("evidence_refs"))
    links = table(s, d, "tafsirs").where("sura is not null and aya is not null").select(F.col("tafsir_id").alias("link"), F.concat_ws(":", F.col("sura").cast("string"), F.col("aya").cast("string")).alias("node"), F.col("verse_source").alias("ref"))
    return unbound_endpoints(links, nodes)


def _edges(s, d):
    t, e = table(s, d, "tafsirs"), table(s, d, "corpus_entries")
    return projected_edges({
        "work_cites_witness": t.select(F.col("source").alias("src"), F.col("verse_source").alias("dst")),
        "work_in_language": t.select(F.col("source").alias("src"), F.col("lang").alias("dst")),
        "entry_of_source": e.select(F.col("entry_id").alias("src"), F.col("source_id").alias("dst")),
        "source_of_kind": e.select(F.col("source_id").alias("src"), F.col("source_kind").alias("dst")),
    })


def _registry(s, d):
    src = table(s, d, "corpus_sources").withColumn("paired", F.when(F.col("source_id").endswith("b"), F.regexp_replace("source_id", "b$", "a")))
    return registry_problems(src, "source_id", {"source_kind": ["quran", "tafsir"], "lang": ["ar", "en", "fr", "de", "tr"]}, ("paired", "lang"), ["version", "raw_sha256"])


def _layers(s, d):
    v = table(s, d, "verses").where("deleted_at is null").select(F.col("verse_id").alias("id"))
    e = table(s, d, "corpus_entries")
    return layered({"primary": v, "reserve_1": e.where("source_kind = 'quran'").select(F.col("entry_id").alias("id")), "reserve_2": e.where("source_kind <> 'quran'").select(F.col("entry_id").alias("id"))}, "id")


QUERIES = {
    "bundle_problems": lambda s, d: validated(*_bundle(s, d)),
    "typed_path": lambda s, d: _path(s, d),
    "unbound_endpoints": _endpoints,
    "projected_edges": _edges,
    "registry_problems": _registry,
    "layer_ordinals": lambda s, d: _layers(s, d)[0],
    "layer_repeats": lambda s, d: _layers(s, d)[1],
}
_B = """WITH e AS (SELECT *, CASE WHEN text IS NOT NULL THEN true ELSE false END AS ok FROM corpus_entries), k AS (SELECT * FROM e WHERE sura IS NOT NULL AND aya IS NOT NULL),
v AS (SELECT 'v:' || sura || ':' || aya AS id, 'k:' || sura AS ch, bool_and(ok) AS ok, bool_or(source_kind = 'tafsir' AND page_no IS NULL AND aya % 2 = 0) AS obj FROM k GROUP BY sura, aya),
c AS (SELECT ch AS id, bool_and(ok) AS ok, bool_or(obj) AS obj FROM v GROUP BY ch)
SELECT 'DUPLICATE_ID' AS code, 's:' || source_id AS entity FROM corpus_sources GROUP BY source_id HAVING count(*) > 1
UNION ALL SELECT 'UNKNOWN_SOURCE', 'e:' || entry_id FROM e WHERE source_id IS NOT NULL AND source_id NOT IN (SELECT source_id FROM corpus_sources)
UNION ALL SELECT 'DIGEST_MISMATCH', 'e:' || entry_id FROM e WHERE page_no IS NULL
UNION ALL SELECT 'INCONSISTENT_VERIFICATION', 'e:' || entry_id FROM e WHERE (text IS NOT NULL) = coalesce(footnotes = '', false)
UNION ALL SELECT 'UNSOUND_CLAIM', 'c:' || entry_id FROM e WHERE NOT ok
UNION ALL SELECT 'UNROOTED_CLAIM', 'c:' || entry_id FROM e WHERE NOT ok UNION ALL SELECT 'UNROOTED_CLAIM', id FROM v WHERE NOT ok UNION ALL SELECT 'UNROOTED_CLAIM', id FROM c WHERE NOT ok
UNION ALL SELECT 'OPEN_OBJECTION', id FROM v WHERE obj UNION ALL SELECT 'OPEN_OBJECTION', id FROM c WHERE obj"""
_LAY = "WITH a AS (SELECT verse_id AS id, 0 AS l, 'primary' AS layer FROM verses WHERE deleted_at IS NULL UNION ALL SELECT entry_id, 1, 'reserve_1' FROM corpus_entries WHERE source_kind = 'quran' UNION ALL SELECT entry_id, 2, 'reserve_2' FROM corpus_entries WHERE source_kind <> 'quran')"
SQL = {
    "bundle_problems": _B,
    "typed_path": """WITH a AS (SELECT 't' || tafsir_id AS start, verse_source AS w, sura, aya FROM tafsirs), b AS (SELECT source_id, sura, aya, min('v' || verse_id) AS lo, max('v' || verse_id) AS hi FROM verses WHERE deleted_at IS NULL AND source_id IS NOT NULL AND sura IS NOT NULL AND aya IS NOT NULL GROUP BY ALL),
p AS (SELECT 'v' || verse_id AS v, 'p' || page_no AS p FROM verses WHERE deleted_at IS NULL AND page_no IS NOT NULL)
SELECT start, CASE WHEN w IS NULL OR a.sura IS NULL OR a.aya IS NULL THEN 'MISSING:comments_on' WHEN lo IS NULL THEN 'MISSING:written_in' WHEN lo <> hi THEN 'AMBIGUOUS:written_in' WHEN p.p IS NULL THEN 'MISSING:on_page' ELSE 'RESOLVED' END AS status,
CASE WHEN lo = hi THEN p.p END AS "end" FROM a LEFT JOIN b ON a.w = b.source_id AND a.sura = b.sura AND a.aya = b.aya LEFT JOIN p ON p.v = b.lo AND lo = hi""",
    "unbound_endpoints": "SELECT tafsir_id AS link, sura || ':' || aya AS node, verse_source AS ref FROM tafsirs t WHERE sura IS NOT NULL AND aya IS NOT NULL AND verse_source IS NOT NULL AND NOT EXISTS (FROM verses v WHERE v.sura = t.sura AND v.aya = t.aya AND v.source_id = t.verse_source)",
    "projected_edges": "WITH e AS (SELECT 'work_cites_witness' AS edge_type, source AS a, verse_source AS b FROM tafsirs UNION SELECT 'work_in_language', source, lang FROM tafsirs UNION SELECT 'entry_of_source', entry_id::VARCHAR, source_id FROM corpus_entries UNION SELECT 'source_of_kind', source_id, source_kind FROM corpus_entries) SELECT edge_type, sha256('projection' || chr(31) || a) AS src, sha256('projection' || chr(31) || b) AS dst FROM e WHERE a IS NOT NULL AND b IS NOT NULL",
    "registry_problems": "WITH p AS (SELECT *, CASE WHEN ends_with(source_id, 'b') THEN regexp_replace(source_id, 'b$', 'a') END AS paired FROM corpus_sources) SELECT source_id AS entry, 'REPEATED_KEY' AS problem FROM p GROUP BY source_id HAVING count(*) > 1 UNION ALL SELECT source_id, 'NOT_ALLOWED:source_kind' FROM p WHERE NOT coalesce(source_kind IN ('quran', 'tafsir'), false) UNION ALL SELECT source_id, 'NOT_ALLOWED:lang' FROM p WHERE NOT coalesce(lang IN ('ar', 'en', 'fr', 'de', 'tr'), false) UNION ALL SELECT source_id, 'BLANK:version' FROM p WHERE coalesce(trim(version), '') = '' UNION ALL SELECT source_id, 'BLANK:raw_sha256' FROM p WHERE coalesce(trim(raw_sha256), '') = '' UNION ALL SELECT source_id, 'UNKNOWN_PARENT' FROM p WHERE paired IS NOT NULL AND paired NOT IN (SELECT source_id FROM p) UNION ALL SELECT p.source_id, 'DIFFERS_FROM_PARENT:lang' FROM p JOIN p q ON q.source_id = p.paired WHERE p.lang IS DISTINCT FROM q.lang",
    "layer_ordinals": _LAY + " SELECT id, layer, row_number() OVER (ORDER BY l, id) AS ordinal FROM a",
    "layer_repeats": _LAY + " SELECT id, count(*) AS n FROM a GROUP BY id HAVING count(*) > 1",
}
