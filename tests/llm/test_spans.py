import random
from collections import defaultdict
from itertools import combinations

import numpy as np
import pytest

from tessera.llm import spans
from tessera.llm.codes import code_points, rolling, sliding_min


def brute(rows, k):
    at = defaultdict(set)
    for i, t in rows:
        if i is not None and t is not None:
            for j in range(len(t) - k + 1):
                at[t[j : j + k]].add(i)
    pairs = {p for ids in at.values() for p in combinations(sorted(ids), 2)}
    shares = {}
    for i, t in rows:
        if i is not None and t is not None:
            hit = set()
            for j in range(len(t) - k + 1):
                if len(at[t[j : j + k]]) > 1:
                    hit |= set(range(j, j + k))
            shares[i] = (len(t), len(hit))
    return pairs, shares


def corpus(seed):
    r = random.Random(seed)
    text = lambda n: "".join(r.choices("ab 😀é", k=n))
    boiler, rows = text(40), []
    for i in range(60):
        t = text(r.randint(0, 60))
        if i % 3 == 0:
            t += boiler[: r.randint(10, 40)]
        if i % 7 == 0 and rows:
            t = rows[-1][1] or ""
        if i % 5 == 0:
            t = boiler[r.randint(0, 20) :] + t
        rows.append((i, t))
    rows += [(100, None), (None, boiler), (101, ""), (102, "a" * 300), (103, "a" * 200), (104, boiler), (105, boiler)]
    return rows


@pytest.mark.parametrize(("k", "m", "hot"), [(20, 5, 4000), (20, 5, 1), (12, 3, 2), (20, 20, 1)])
def test_pairs_and_shares_equal_brute_force(spark, k, m, hot):
    for seed in (1, 2):
        rows = corpus(seed)
        df = spark.createDataFrame([(i, t, "clash", "x") for i, t in rows], "id long, text string, start string, mh string")
        pairs, shares = brute(rows, k)
        got = [tuple(r) for r in spans.span_pairs(df, k, m, hot).collect()]
        assert sorted(got) == sorted(pairs)  # each once
        told = {r.id: (r.n_chars, r.shared_chars) for r in spans.span_shares(df, k, m, hot).collect()}
        assert told == shares
        links = spans.span_links(df, k, m, hot).collect()
        of = {r.id_b: r.id_a for r in links if r.kind == "member"}
        same = {(a, b) for a in shares for b in shares if a < b and of.get(a, a) == of.get(b, b)}
        met = {(r.id_a, r.id_b) for r in links if r.kind == "pair"}
        assert same | {(a, b) for a in shares for b in shares if a < b and tuple(sorted((of.get(a, a), of.get(b, b)))) in met} == pairs


@pytest.mark.parametrize("hot", [10, 10**9])
def test_repetitive_texts(spark, hot):
    """Long runs of one character or pair: few super-k-mers of very many windows, which are cut."""
    rows = [(1, "=" * 20_000), (2, "x" + "=" * 9_000), (3, "ab" * 5_000), (4, "b" + "ab" * 4_000 + "c"), (5, "=" * 20_000), (6, "y" * 5_000)]
    df = spark.createDataFrame(rows, "id long, text string")
    want = {(1, 2), (1, 5), (2, 5), (3, 4)}
    assert sorted(tuple(r) for r in spans.span_pairs(df, 150, 32, hot).collect()) == sorted(want)
    told = {r.id: r.shared_chars for r in spans.span_shares(df, 150, 32, hot).collect()}
    assert told == {1: 20_000, 2: 9_000, 3: 10_000, 4: 8_001, 5: 20_000, 6: 0}
    _, _, _, n = spans.super_kmers(*code_points([t for _, t in rows]), 150, 32)
    assert n.max() <= spans.LONGEST and n.sum() == sum(len(t) - 149 for _, t in rows)


def test_many_lines_of_one_sign(spark):
    df = spark.range(5_000).selectExpr("id", "concat('=', repeat('=', cast(200 + id as int)), cast(id as string)) as text")
    told = spans.span_shares(df, 150, 32, 1000).where("shared_chars < 201").count()
    assert told == 0


def test_empty_and_none_shared(spark):
    df = spark.createDataFrame([(1, "x" * 10), (2, "y" * 400)], "id long, text string")
    assert spans.span_pairs(df, 20, 5).count() == 0 and spans.span_pairs(df.limit(0), 20, 5).count() == 0
    assert spans.span_shares(df.limit(0), 20, 5).count() == 0


def test_colliding_hashes_are_told_apart(monkeypatch):
    monkeypatch.setattr(spans, "rolling", lambda c, w: np.zeros(max(0, len(c) - w + 1), np.uint64))
    packed = ["abcde", "abcdX", "abcde"]
    pairs, runs = spans.count_bucket(np.zeros(3, np.int64), np.array([1, 2, 3]), np.zeros(3, np.int64), np.array([-1, -1, -1]), packed, 5)
    assert pairs == {(1, 3)} and sorted(runs[0].tolist()) == [1, 3]


def test_rolling_and_minimum():
    codes, _ = code_points(["abracadabra" * 3])
    for w in (1, 2, 3, 7, 8, 13):
        h = rolling(codes, w)
        assert len(h) == 34 - w
        same = {}
        for i in range(len(h)):
            assert same.setdefault(tuple(codes[i : i + w]), h[i]) == h[i]
        assert len(set(h.tolist())) == len(same)
        assert (sliding_min(h, 5) == [h[i : i + 5].min() for i in range(len(h) - 4)]).all()


@pytest.mark.parametrize("hot", [2, 1000])
def test_shares_build_no_pairs(spark, monkeypatch, hot):
    """A passage that many different texts share: runs grow with the texts, pairs with their square."""
    r = random.Random(8)
    some = lambda n: "".join(r.choices("abcdefgh", k=n))
    passage = some(30)
    rows = [(i, some(20) + passage + some(20)) for i in range(40)]
    built, whole = [], spans.shared_spans
    monkeypatch.setattr(spans, "shared_spans", lambda *a, **b: built.append(whole(*a, **b)) or built[-1])
    got = {x.id: x.shared_chars for x in spans.span_shares(spark.createDataFrame(rows, "id long, text string"), 20, 8, hot).collect()}
    assert {i: n for i, (_, n) in brute(rows, 20)[1].items()} == got
    assert built[0][0].where("kind = 'pair'").count() == 0
