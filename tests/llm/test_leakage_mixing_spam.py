import os
import random

import pytest
from pyspark.sql import functions as F

from tessera.llm import leakage, mixing, spam


def brute(docs, items, n):
    out = set()
    for i, t in items:
        w = leakage.words(t or "")
        m = min(n, len(w))
        grams = {tuple(w[j : j + m]) for j in range(len(w) - m + 1)} if m else set()
        for d, text in docs:
            v = leakage.words(text or "")
            if any(tuple(v[j : j + m]) in grams for j in range(len(v) - m + 1)):
                out.add((d, i))
    return out


def test_leaks_equal_brute_force(spark):
    r = random.Random(2)
    text = lambda k: " ".join(r.choices("abcd", k=k))
    docs = [(i, text(r.randint(0, 40))) for i in range(80)] + [(500, None), (1, text(9))]
    items = [(i, text(r.randint(1, 12))) for i in range(30)] + [(98, None), (99, "...")]
    d = spark.createDataFrame([(*x, "z") for x in docs], "doc_id long, text string, item_id string")
    i = spark.createDataFrame(items, "item_id long, text string")
    for at_once in (5000, 7):
        got = [tuple(x) for x in leakage.leaks(d, i, 5, at_once).collect()]
        assert sorted(got) == sorted(brute(docs, items, 5))
    assert leakage.leaks(d, i.limit(0), 5).count() == 0 and leakage.leaks(d.limit(0), i, 5).count() == 0


def test_words_fold_what_is_not_seen():
    assert leakage.words("Café, Ｗord_x1 é") == ["cafe", "word", "x1", "e"]
    assert leakage.words("أَمْرٌ ﻛﺘﺎﺏ") == leakage.words("امر كتاب")
    assert leakage.words("wo​rd so­ft") == ["word", "soft"] and leakage.words("IŞIK") == leakage.words("ışık")


def leaf(source, weight, capacity):
    lang, _, domain = source.partition("-")
    return {"source": source, "domain": domain, "lang": lang, "weight": weight, "capacity": capacity}


def test_budget_goes_to_siblings_first():
    b = mixing.budgets([leaf("en-a", 0.25, 10), leaf("en-a2", 0.25, 1000), leaf("fr-a", 0.5, 1000)], 100)
    assert b["en-a"] == 10
    x = [leaf("en-n", 0.2, 5.0), leaf("en-n", 0.2, 1000.0), leaf("fr-n", 0.2, 1000.0), leaf("en-l", 0.4, 1000.0)]
    for i, s in enumerate(x):
        s["source"] += str(i)
    got = mixing.budgets(x, 100)
    assert got == pytest.approx({"en-n0": 5, "en-n1": 35, "fr-n2": 20, "en-l3": 40})
    x = [leaf("en-n", 0.5, 5.0), leaf("fr-n", 0.1, 12.0), leaf("en-l", 0.4, 1000.0)]
    assert mixing.budgets(x, 100) == pytest.approx({"en-n": 5, "fr-n": 12, "en-l": 83})
    assert sum(mixing.budgets([leaf("a-b", 1.0, 7.0)], 100).values()) == 7


@pytest.mark.skipif(not os.path.exists(mixing.TOKENIZER), reason="no tokenizer")
def test_mixture(spark):
    r = random.Random(4)
    docs = [(i, r.choice(["x-notes", "x-notes", "x-notes", "y-notes", "z-letters"]), "en", "word " * r.randint(1, 60)) for i in range(400)]
    docs += [(900, None, "en", "word"), (901, "other", "en", "word"), (902, "x-notes", None, None), (903, "x-notes", "en", ""), (None, "y-notes", "en", "word word")]
    d = spark.createDataFrame(docs, "doc_id long, source string, lang string, text string").withColumn("n_tokens", F.lit("clash"))
    t = spark.createDataFrame([("x-notes", 0.2, 1), ("y-notes", 0.3, 3), ("z-letters", 0.45, 2), ("none-notes", 0.05, 4), (None, 0.1, 1)], "source string, target_share double, max_repeats int")
    chosen, report = mixture = mixing.mixture(d, t)
    rows = chosen.collect()
    cap = {"x-notes": 1, "y-notes": 3, "z-letters": 2}
    assert rows and all(1 <= x.copies <= cap[x.source] for x in rows) and len({(x.doc_id, x.source) for x in rows}) == len(rows)
    by = {x.source: x for x in report.collect()}
    assert by["none-notes"].taken_tokens == 0 and abs(sum(x.actual_share for x in by.values()) - 1) < 1e-5
    for s in cap:
        assert abs(by[s].taken_tokens - by[s].budget_tokens) <= 61
        assert by[s].taken_tokens == sum(x.n_tokens * x.copies for x in rows if x.source == s)
    again = mixing.mixture(d, t)[0].collect()
    assert sorted(map(tuple, again), key=repr) == sorted(map(tuple, rows), key=repr)
    other = mixing.mixture(d, t, seed=7)[0].collect()
    assert sorted(map(tuple, other), key=repr) != sorted(map(tuple, rows), key=repr)
    assert mixing.mixture(d.limit(0), t)[0].count() == 0 and mixing.mixture(d, t.limit(0))[0].count() == 0
    assert len(mixture) == 2


PROSE = "The reader of the old copy compares each leaf with care. He doubts the margin, but the note is clear. Was it written before the rain? "
SPAM = [
    "cheap lamp | best lamp | lamp sale | cheap lamp | lamp sale | best lamp | cheap lamp | lamp sale | best lamp", "#lamp #ink_well #paper #old #sale #best #cheap #lamp2 #rope", "lamp in Rome, lamp near Paris, lamp in Oslo, lamp near Bonn, lamp in Cairo, lamp near Lima",
    "ink L36 SKU-123 5.00 sale\npen M20 SKU-124 6.00 sale\ncup S30 SKU-999 7.10 sale", "[a b](http://x.test/1)\n[c d](http://x.test/2)\n<a href=\"y.example/3\">e f</a>\nwww.z.example/q", "Best lamp here! Best lamp cheap. Best lamp here! Best lamp cheap. Cheap lamp best lamp. Best lamp here best lamp.",
    PROSE + "\n" + " > ".join(f"item{i}" for i in range(90)), "PROSE " + " ".join(f"tag{i} ({i})" for i in range(60)) + " and the reader closes it.",
]
CLEAN = [PROSE * 2, "Notes to the first leaf\n1. On the winter\n2. On the path\n\n" + PROSE * 2, PROSE + "See [this](http://x.test/a) and [that](http://x.test/b) too. #lamp", PROSE + "The refrain comes back.\n" + PROSE.replace("old", "new") + "The refrain comes back.", "A short note. Very terse.", "", "…", "Gloss: a note in the margin that explains a word.\nLeaf: one sheet of a book, of two pages."]


def test_spam(spark):
    rows = [(i, "h", t) for i, t in enumerate(SPAM)] + [(100 + i, "h", t) for i, t in enumerate(CLEAN)] + [(200, None, None), (201, None, SPAM[0])]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, source string, text string, phrase string")
    got = {r.doc_id: r for r in spam.scored(df).collect()}
    assert [t for i, t in enumerate(SPAM) if not got[i].spam] == []
    assert [t for i, t in enumerate(CLEAN) if got[100 + i].spam] == []
    assert 200 not in got and got[201].spam
    key = lambda x: sorted(map(tuple, x.collect()), key=repr)
    assert key(spam.scored(df, most=0)) == key(spam.scored(df))  # too many repeated texts to broadcast: all are grouped
    assert spam.scored(df.limit(0)).count() == 0


def test_replicated_phrases_decide_between(spark):
    """Pages of one density differ by replication alone: list phrases on other hosts and in other texts, or not."""
    r = random.Random(8)
    prose = lambda: " ".join("".join(r.choices("abcdefghijk", k=6)) for _ in range(24)).capitalize() + "."
    lines = lambda kind: "\n".join(" ".join(f"{kind}{i}x{k}" for k in range(6)) for i in range(5))
    shared, df = lines("part"), lambda x: spark.createDataFrame(x, "doc_id long, source string, text string")
    rows = [(i, f"h{i % 2}", prose() + "\n" + shared) for i in range(4)] + [(10 + i, f"h{i}", prose() + "\n" + lines(f"own{i}")) for i in range(4)]
    copied = prose() + "\n" + lines("copied")
    passage = " ".join(f"quoted{k}" for k in range(30))  # one that others quote too is no stitching
    rows += [(30 + i, f"h{i}", prose() + "\n" + passage) for i in range(4)]
    rows += [(20 + i, f"h{i}", copied) for i in range(4)]
    got = {x.doc_id: x for x in spam.scored(df(rows)).collect()}
    assert len({round(x.bad_share, 9) for x in got.values()}) == 1 and got[0].bad_share < spam.DENSE
    assert {i for i, x in got.items() if x.spam} == {0, 1, 2, 3} and got[20].stitched_share == 0
    assert got[30].stitched_share == 0 < got[30].replicated_share
    one_host = spam.scored(df([(i, "h", t) for i, _, t in rows])).collect()
    assert not any(x.spam for x in one_host)


def test_pages_stitched_from_replicated_sentences(spark):
    """Sentences, each once in a page, but on many hosts; copies and one revision of an honest page are no cases."""
    r = random.Random(6)
    words = ["".join(r.choices("abcdefghijklmnoprstuvw", k=7)) for _ in range(3000)]
    line = lambda k: " ".join(r.sample(words, k)).capitalize() + "."
    pool = [line(r.choice([4, 7, 11])) for _ in range(40)]
    stitched = [(i, f"h{i % 8}", " ".join(r.sample(pool, 15))) for i in range(40)]
    honest = " ".join(line(9) for _ in range(15))
    rows = stitched + [(100 + i, f"h{i}", honest) for i in range(8)] + [(110, "h9", honest + " " + line(9))] + [(200, "h1", " ".join(line(9) for _ in range(15)))]
    rows += [(300 + i, f"h{i}", pool[0]) for i in range(3)]  # a terse note
    assert max(spam.page(t)[2] / spam.page(t)[0] for _, _, t in rows if len(t) > 300) < 0.1
    df = lambda x: spark.createDataFrame(x, "doc_id long, source string, text string")
    got = {x.doc_id: x for x in spam.scored(df(rows)).collect()}
    assert {i for i, x in got.items() if x.spam} == set(range(40)) and len(got) == len(rows)
    assert got[100].stitched_share == 0.0 and got[200].stitched_share == 0.0 and got[0].stitched_share == 1.0
    assert not any(x.spam for x in spam.scored(df([(i, "h", t) for i, _, t in stitched])).collect())
