import gzip
import hashlib
import json
import random
import zipfile

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.functions import offsets
from tessera.operators import bundle, coverage, ledger, metrics, passages, search, sequence
from tessera.plans import running
from tessera.sources import archives

MARKED = "كَتَبَ"


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="abأةى\u064e\u0640 \n", max_size=40))
def test_origins_tile_the_text(raw):
    folded, edges = offsets.match_with_origins(raw)
    assert len(edges) == len(folded) + 1 and all(a < b for a, b in zip(edges, edges[1:])) and edges[-1] == len(raw)
    for i in range(len(folded)):
        piece = offsets.match_with_origins(raw[edges[i] : edges[i + 1]])[0]
        assert piece == folded[i]
    bare, places = offsets.marks_with_origins(raw, "spaces")
    assert bare == "".join(raw[i] for i in places) and not set(bare) & set(" \n\u064e")


def test_folded_places_are_raw_spans():
    assert offsets.find_folded("xx أمرَ  b", "امر b") == [(3, 10)] and offsets.find_folded("aaa", "aa") == [(0, 2), (1, 3)] and offsets.find_folded("a", "") == []
    assert offsets.located_words(" a \u064e bَ") == [("a", 1, 2), ("b", 5, 7)]


def test_whole_words_exact_before_folded(spark, rows):
    t = spark.createDataFrame([(1, f"{MARKED} كتب", "x"), (2, f"a {MARKED}، b", "x"), (3, f"{MARKED}ون", "x"), (4, None, "x"), (5, "", "x")], "id int, text string, term string")
    got = rows(search.located_terms(t.drop("term"), "id", ["كتب"]), "id", "profile", "start_pos", "end_pos", "byte_start")
    assert got == [(1, "literal_exact_v1", 7, 10, 13), (2, "marks", 2, 7, 2), (3, "marks", 0, 5, 0)]  # a mark behind the last letter counts as apart
    assert rows(search.marker_status(t, "id", "كتب")) == [(1, "PRESENT"), (2, "PRESENT"), (3, "NOT_OBSERVED"), (4, "NOT_CHECKED"), (5, "NOT_OBSERVED")]


def test_stages_of_a_shared_run(spark):
    words = [f"w{i}" for i in range(40)]
    text = " ".join(words)
    r = spark.createDataFrame([(1, text, 0), (2, None, 0), (3, text, 0)], "id long, text string, pos int")
    s = spark.createDataFrame([(7, "x " + " ".join(words[5:20]) + " y"), (8, None)], "doc long, text string")
    spans = lambda *x: spark.createDataFrame(list(x), "id long, start_pos int, end_pos int")
    blocks = spark.createDataFrame([(7, 0, 40)], "doc long, start_pos int, end_pos int")
    at = {w: text.index(w + " ") for w in words[:-1]}
    passages_ = spans((1, 0, at["w18"]), (1, 0, at["w16"]), (3, 0, len(text)))
    windows = spans((1, at["w6"], len(text)))
    got = {}
    for x in coverage.staged(r, passages_, windows, s, blocks, "id", "doc").collect():
        got.setdefault((x.id, x.stage), []).append(x.start_pos)
    assert sum(map(len, got.values())) == 12  # six runs of ten words, in two records
    assert sorted(got[1, coverage.STAGES[1]]) == [at["w9"], at["w10"]] and got[1, coverage.STAGES[2]] == [at["w5"]] and len(got[3, coverage.STAGES[2]]) == 6
    assert sum(len(v) for k, v in got.items() if k[1] in coverage.STAGES[3:] and k[0] == 1) == 3
    assert coverage.staged(r.limit(0), passages_, windows, s, blocks, "id", "doc").count() == 0


def test_two_level_ranks_and_maxima(spark):
    rnd = random.Random(4)
    data = [(rnd.choice("ab"), rnd.randint(-50, 300), i) for i in range(400)] + [(None, 5, 900), ("a", None, 901), (None, 7, 902)]
    df = spark.createDataFrame(data, "g string, at int, v int").dropDuplicates(["g", "at"])
    rows_ = [tuple(r) for r in df.collect()]
    got = {(r.g, r["at"]): r.k for r in running.ranked(df, "g", "at", "k", bits=3).collect()}
    top = {(r.g, r["at"]): r.m for r in running.greatest_before(df, "g", ["at"], "v", "m", bits=3).collect()}
    for g in ("a", "b", None):
        mine = sorted((r for r in rows_ if r[0] == g), key=lambda r: (r[1] is not None, r[1] or 0))
        assert [got[g, r[1]] for r in mine] == list(range(1, len(mine) + 1))
        assert [top[g, r[1]] for r in mine] == [max((x[2] for x in mine[:i]), default=None) for i in range(len(mine))]


def test_islands_over_block_edges(spark, rows, monkeypatch):
    monkeypatch.setattr(sequence, "RANGE_BITS", 2)
    values = [0, 1, 2, 3, 4, 5, 6, 7, 8, 11, 12, 14, 16, 17, -1, 3, None]
    df = spark.createDataFrame([("g", v, "x") for v in values] + [("h", 8, "x")], "g string, v int, start string")
    assert rows(sequence.islands(df, "g", "v")) == [("g", -1, 9, 10), ("g", 11, 13, 2), ("g", 14, 15, 1), ("g", 16, 18, 2), ("h", 8, 9, 1)]
    assert sequence.islands(df.limit(0), "g", "v").count() == 0


def test_ledger_appends_and_breaks(spark):
    e = spark.createDataFrame([("a", 2, "two"), ("a", 1, "one \"q\""), ("b", 1, "é"), (None, 1, "x"), ("b", 2, None)], "ledger string, at int, payload string").withColumn("seq", F.lit("clash"))
    first = ledger.appended(e)
    chain = sorted((r.ledger, r.seq, r.prev_entry_sha256, r.payload, r.entry_sha256) for r in first.collect())
    prev = ledger.GENESIS
    for name, seq, before, payload, digest in [c for c in chain if c[0] == "a"]:
        want = hashlib.sha256(json.dumps({"payload": payload, "prev_entry_sha256": prev, "seq": seq}, ensure_ascii=False, sort_keys=True, separators=(",", ":")).encode()).hexdigest()
        assert (before, digest) == (prev, want)
        prev = digest
    assert [c[3] for c in chain] == ['one "q"', "two", "é"] and all(r.chain_valid for r in ledger.verified(first).collect())
    more = ledger.appended(spark.createDataFrame([("a", 9, "three"), ("c", 1, "new")], "ledger string, at int, payload string"), ledger.heads(first))
    whole = first.unionByName(more)
    state = {r.ledger: (r.n_entries, r.first_break) for r in ledger.verified(whole).collect()}
    assert state == {"a": (3, None), "b": (1, None), "c": (1, None)}
    changed = whole.withColumn("payload", F.when(F.col("payload") == "two", "2").otherwise(F.col("payload")))
    assert {r.ledger: r.first_break for r in ledger.verified(changed).collect()} == {"a": 2, "b": None, "c": None}
    assert {r.ledger: r.first_break for r in ledger.verified(whole.where("payload <> 'two'")).collect()}["a"] == 3
    with pytest.raises(ValueError):
        ledger.heads(changed)
    assert ledger.appended(e.limit(0)).count() == 0 and ledger.verified(first.limit(0)).count() == 0


def test_rooted_claims(spark):
    claims = spark.createDataFrame([(c, c != "bad") for c in ("s1", "s2", "bad", "x", "y", "z", "c1", "c2", "up", "lost")], "id string, sound boolean")
    premises = spark.createDataFrame([("x", "s1"), ("x", "s2"), ("y", "x"), ("y", "s1"), ("z", "bad"), ("z", "x"), ("c1", "c2"), ("c2", "c1"), ("up", "c1"), ("lost", "nowhere"), ("lost", "s1"), (None, "s1"), ("x", None)], "id string, premise string")
    got = {r.id: (r.rooted, r.level) for r in bundle.rooted(claims, premises).collect()}
    assert {k for k, v in got.items() if v[0]} == {"s1", "s2", "x", "y"} and got["y"][1] == 3 and got["c1"] == (False, None) == got["up"]
    assert bundle.rooted(claims.limit(0), premises).count() == 0
    with pytest.raises(ValueError):
        bundle.rooted(spark.createDataFrame([(str(i), True) for i in range(8)], "id string, sound boolean"), spark.createDataFrame([(str(i + 1), str(i)) for i in range(7)], "id string, premise string"), depth=3)


def test_bundle_problems(spark, rows):
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    df = spark.createDataFrame
    sources = df([("s",), ("s2",), ("s2",)], "id string")
    evidence = df([("e1", "s", "a", sha("a"), "verified", "manual"), ("e2", "s9", "b", sha("x"), "pending", "manual")], "id string, source_id string, excerpt string, excerpt_sha256 string, status string, method string")
    none = "no_recorded_objection"
    claims = df([("c1", "source", ["e1"], none), ("c2", "source", ["e2", "e9"], none), ("k", "inferred", [], none), ("top", "inferred", [], none), ("alone", "inferred", [], "open")], "id string, kind string, evidence_ids array<string>, assessment string")
    inferences = df([("i1", "k"), ("i2", "top"), ("i3", "gone")], "id string, conclusion string")
    premises = df([("i1", "c1"), ("i2", "k"), ("i2", "c1"), ("i3", "c8")], "inference string, premise string")
    objections = df([("o1", "i1", "open"), ("o2", "i2", "answered"), ("o3", "i7", "open")], "id string, target string, status string")
    got = rows(bundle.validated(sources, evidence, claims, inferences, premises, objections))
    assert got == sorted([
        ("DUPLICATE_ID", "s2"), ("UNKNOWN_SOURCE", "e2"), ("UNKNOWN_EVIDENCE", "c2"), ("UNKNOWN_CONCLUSION", "i3"), ("UNKNOWN_PREMISE", "i3"), ("UNKNOWN_TARGET", "o3"), ("DIGEST_MISMATCH", "e2"),
        ("INCONSISTENT_VERIFICATION", "e2"), ("UNSOUND_CLAIM", "alone"), ("UNSOUND_CLAIM", "c2"), ("UNROOTED_CLAIM", "alone"), ("UNROOTED_CLAIM", "c2"), ("OPEN_OBJECTION", "k"), ("OPEN_OBJECTION", "top"),
    ], key=repr)


def test_typed_path_and_endpoints(spark, rows):
    e = spark.createDataFrame([("a", "1", "2"), ("a", "1", "2"), ("b", "2", "3"), ("a", "4", "5"), ("a", "4", "6"), ("a", "7", "8"), ("b", None, "9")], "kind string, src string, dst string")
    s = spark.createDataFrame([("1",), ("4",), ("7",), ("9",), (None,), ("1",)], "start string")
    assert rows(bundle.traversed(s, e, ["a", "b"])) == [("1", "RESOLVED", "3"), ("4", "AMBIGUOUS:a", None), ("7", "MISSING:b", None), ("9", "MISSING:a", None)]
    links = spark.createDataFrame([(1, "n", "r"), (2, "n", "q"), (3, "m", "r"), (4, "n", None)], "link int, node string, ref string")
    nodes = spark.createDataFrame([("n", ["r", "s"]), ("k", None)], "node string, evidence_refs array<string>")
    assert rows(bundle.unbound_endpoints(links, nodes), "link") == [(2,), (3,)]
    edges = bundle.projected_edges({"x": e.select("src", "dst"), "y": e.select("src", "dst")})
    assert edges.count() == 10
    reg = spark.createDataFrame([("a", "ok", None, "1"), ("a", "ok", None, "1"), ("b", "no", "a", "2"), ("c", None, "z", " ")], "id string, kind string, parent string, v string")
    assert rows(bundle.registry_problems(reg, "id", {"kind": ["ok"]}, ("parent", "v"), ["v"])) == [("a", "REPEATED_KEY"), ("b", "DIFFERS_FROM_PARENT:v"), ("b", "NOT_ALLOWED:kind"), ("c", "BLANK:v"), ("c", "NOT_ALLOWED:kind"), ("c", "UNKNOWN_PARENT")]
    placed, twice = bundle.layered({"p": spark.createDataFrame([(3,), (1,)], "id int"), "r": spark.createDataFrame([(1,), (2,), (None,)], "id int")}, "id")
    assert rows(placed) == [(1, "p", 1), (1, "r", 3), (2, "r", 4), (3, "p", 2)] and rows(twice) == [(1, 2)]


def test_passages_skip_what_is_held(spark, rows):
    v = spark.createDataFrame([("w", 1, 1), ("w", 1, 1), ("w", None, 1)], "source_id string, sura int, aya int")
    long = "A statement of words that is long enough. Another one that is long enough too."
    data = [(1, "s", "w", 1, 1, long), (2, "s", "w", 1, 1, "x" * passages.HELD_LENGTH), (3, "s", "w", 1, 1, "<br>"), (4, "s", "w", 9, 9, long), (5, None, "w", 1, 1, long), (6, "s", "w", 1, 1, None)]
    w = spark.createDataFrame(data, "tafsir_id long, source string, verse_source string, sura int, aya int, text string").withColumn("status", F.lit("clash"))
    look = passages.verse_records(v, w.drop("status"))
    assert rows(look, "tafsir_id", "status") == [(1, "SHOWN"), (2, "WITHHELD"), (3, "NO_TEXT"), (4, "UNKNOWN_VERSE"), (6, "NO_TEXT")]
    assert look.where("tafsir_id = 2").first().text_sha256 is None and look.where("tafsir_id = 2").first().flags == "LENGTH_CEILING"
    assert passages.verse_records(v, w, show_held=True).where("tafsir_id = 2").first().n_chars == passages.HELD_LENGTH
    found = passages.passages(w, look)
    assert rows(found, "tafsir_id", "start_pos", "end_pos") == [(1, 0, 41), (1, 42, 78)]
    marked = spark.createDataFrame([(1, 43, 60, "k")], "tafsir_id long, start_pos int, end_pos int, kind string")
    assert rows(passages.passage_summary(found, marked)) == [("all", "passages", 2), ("attribution", "NAMED_REPORT", 1), ("attribution", "UNATTRIBUTED", 1), ("verification", "UNVERIFIED", 2), ("work", "s", 2)]
    roll = {r.tafsir_id: (r.passage_count, r.candidate_count) for r in passages.record_rollup(look, found, marked).collect()}
    assert roll == {1: (2, 1), 2: (0, 0), 3: (0, 0), 4: (0, 0), 6: (0, 0)}


def test_counts_against_receipts_and_grid(spark, rows):
    r = spark.createDataFrame([("a", 1, 1), ("a", 1, 2), ("b", 1, 1), ("b", 1, 1), (None, 1, 1), ("a", 7, 1), ("a", 1, None)], "s string, sura int, aya int")
    got = rows(passages.receipt_counts(r, spark.createDataFrame([("a", 4), ("b", 2), ("c", 1)], "s string, expected long"), "s", ["sura", "aya"]))
    assert got == [("a", 4, 4, 4, True), ("b", 2, 1, 2, False), ("c", 0, 0, 1, False)]
    assert rows(passages.grid_coverage(r, spark.createDataFrame([(1, 3)], "sura int, n int"), "s")) == [("a", 2, 1, 1), ("b", 1, 2, 0)]


def test_cases_gates_and_safety(spark, rows):
    g = spark.createDataFrame([(1,), (2,), (2,), (None,)], "id int")
    p = spark.createDataFrame([(1,), (3,), (None,), (None,)], "id int")
    assert rows(metrics.case_problems(g, p, ["id"])) == [(2, "missing"), (2, "repeated_gold"), (3, "unexpected"), (None, "repeated_prediction")]
    j = spark.createDataFrame([("same", "merge", "in", "in", ["a", "b"], ["b", "a"]), ("other", "merge", "in", None, ["a"], None), ("other", None, None, "in", ["a"], ["a"]), (None, "merge", None, None, None, None)], "gold string, pred string, gold_direction string, pred_direction string, gold_sources array<string>, pred_sources array<string>")
    got = {r.metric: (r.numerator, r.denominator, r.rate) for r in metrics.safety_rates(j, (["other"], ["merge"]), (["none"], ["merge"])).collect()}
    assert got == {"unsafe_merge": (1, 2, 0.5), "direction_error": (1, 2, 0.5), "scope_collapse": (0, 0, 0.0), "provenance_preservation": (2, 4, 0.5)}
    gates = {r.metric: (r.actual, r.passed) for r in metrics.count_gates(j, "gold", {"other": 2, "z": 1}, {"d": F.col("gold_direction").isNotNull()}, {"d": 3, "gone": 0}).collect()}
    assert gates == {"gold_label_count:other": (2, True), "gold_label_count:z": (0, False), "d_denominator": (2, False), "gone_denominator": (0, True)}
    t = spark.createDataFrame([(1, "a", "fox den"), (2, "a", "fox"), (3, "b", "fox den owl"), (4, "c", "none here"), (5, None, "fox"), (6, "d", None), (7, "e", "fox")], "id long, source string, text string").withColumn("score", F.lit("x"))
    assert [(r["rank"], r.source, r.id) for r in sorted(metrics.evidence_ranking(t, "id", "source", ["fox"], ["owl"], 2, "e").collect(), key=lambda r: r["rank"])] == [(1, "b", 3), (2, "a", 2)]
    assert metrics.evidence_ranking(t.limit(0), "id", "source", ["fox"], [], 2).count() == 0


def test_fold_tokens(spark):
    import unicodedata

    from tessera.functions.folds import fold_tokens

    t = spark.createDataFrame([("Ｆｏｘ ﬁn كَتَبـ STRASSE ß",), (None,), ("",)], "t string")
    got = [r[0] for r in t.select(fold_tokens(F.col("t"))).collect()]
    want = "".join(c for c in unicodedata.normalize("NFKC", "Ｆｏｘ ﬁn كَتَبـ STRASSE ß") if c != "\u0640" and not unicodedata.combining(c)).casefold()
    assert got == [want, None, ""]


def test_zip_members(spark, rows, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("x/one.txt", "1" * 100_000)
        z.writestr("two.txt", "")
    got = rows(archives.zip_members(spark, str(tmp_path / "a.zip")), "name", "n_bytes", "digest")
    assert got == [("two.txt", 0, hashlib.sha256(b"").hexdigest()), ("x/one.txt", 100_000, hashlib.sha256(b"1" * 100_000).hexdigest())]
    with zipfile.ZipFile(tmp_path / "b.zip", "w") as z:
        z.writestr("../out", "")
    with pytest.raises(Exception, match="unsafe"):
        archives.zip_members(spark, str(tmp_path / "b.zip")).collect()


def test_pinned_ingest_refuses(spark, rows, tmp_path):
    body = json.dumps({"schemaVersion": 1, "edition": {"id": "e", "source": "o"}, "verses": {"1": {"1": {"text": "t", "footnotes": None}, "2": {"text": "u", "footnotes": "f"}}}}).encode()
    (tmp_path / "s.json.gz").write_bytes(data := gzip.compress(body))
    schema = "source_id string, file_name string, sha256 string, edition string, n_unpacked long"
    line = ("s", "s.json.gz", hashlib.sha256(data).hexdigest(), "e", len(body))
    read = lambda *lines, **kw: archives.ingested(spark, str(tmp_path), spark.createDataFrame(list(lines), schema), **kw)
    assert rows(read(line)) == [("s", 1, 1, "t", ""), ("s", 1, 2, "u", "f")]
    gone = ("t", "t.json.gz", "0", "e", 1)
    assert read(line, gone, allow_partial=True).count() == 2
    for bad, code in (((*line[:2], "0" * 64, *line[3:]), "digest"), ((*line[:3], "other", line[4]), "edition"), ((*line[:4], len(body) - 1), "size"), (gone, "missing")):
        with pytest.raises(Exception, match=code):
            read(bad).collect()


def test_snapshots(spark, rows, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, None), (1, "a")], "id int, t string")
    root = str(tmp_path / "vault")
    one = archives.published(df, root, ["id"])
    assert archives.published(df.orderBy(F.desc("id")), root, ["id"]) == one != archives.published(df.limit(0), root, ["id"])
    assert rows(archives.restored(spark, root, one)) == rows(df)
    with pytest.raises(ValueError):
        archives.restored(spark, root, "none")
    at = next(r.path for r in spark.read.json(f"{root}/manifest").collect() if r.version == one)
    df.limit(1).write.mode("append").parquet(at)
    with pytest.raises(ValueError, match="changed"):
        archives.restored(spark, root, one)
