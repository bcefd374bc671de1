import pytest

from tessera.llm.lookalike import canonical, lookalike_pairs, normalized, resolved

SAME = [
    ("paper cat", "раper сat"), ("the gloss", "ｔｈｅ ｇｌｏｓｓ"), ("café élan", "café élan"), ("a b", "a b"), ("a b", "a b"), ("word", "wo​rd﻿"),
    ("soft", "so­ft"), ("scope", "ѕсоре"), ("كتاب في", "ﻛﺘﺎﺏ ﻓﻲ"), ("علي كان", "علی کان"), ("مُدَّ", "مُدَّ"), ("أمر", "أمر"), ("٣٫7", "۳٫7"), ("nūr ʿusīl", "nūr ʿu\u0455\u0456\u0304l"), ("nūr", "nūr"),
    ("ok? yes", "οk? yes"), ("\u0441\u043b\u043e\u0432\u043e", "\u0441\u043b\u043e\u0432o"), ("\u03bb\u03cc\u03b3\u03bf\u03c2", "\u03bb\u03cc\u03b3o\u03c2"), ("\u0561\u0580\u0585\u0580", "\u0561\u0580o\u0580"), ("\u13a3\u13aa\u13a4", "\u13a3A\u13a4"),
    ("\u0436\u043e\u0434", "\u0436\u03bf\u0434"), ("office", "o\ufb03ce"), ("IV part", "\u2163 part"), ("\u0e19\u0e33", "\u0e19\u0e4d\u0e32"), ("CLOVER", "\u13df\u13deO\u13d9E\u13a1"), ("sun", "\u0455\u057d\u0578"),
]
DIFFERENT = [("paper", "Paper"), ("cafe", "café"), ("أمر", "امر"), ("كتب", "كَتَبَ"), ("كتاب", "كتـاب"), ("a b", "ab"), ("at", "bt"), ("мир", "mup"), ("a\nb", "a b"), ("\u0436a", "\u0436\u0431"), ("\u017fin", "sin"), ("\u0441\u043b\u043e\u0432\u043e", "\u0421\u043b\u043e\u0432\u043e"), ("٤", "۴"), ("x²", "x2")]


@pytest.mark.parametrize(("a", "b"), SAME)
def test_same_look(a, b):
    assert canonical(a) == canonical(b)


@pytest.mark.parametrize(("a", "b"), DIFFERENT)
def test_visible_difference(a, b):
    assert canonical(a) != canonical(b)


def test_tokens():
    assert resolved("\u0436oz") == ("\u0436oz", "single") and resolved("раper")[1] == "mixed" and resolved("ѕсоре")[1] == "whole" and resolved("мир") == ("мир", "single") and resolved("paper")[1] == "single"


def test_pairs(spark):
    rows = [("g", 1, "paper"), ("g", 2, "рaper"), ("g", 3, "paper"), ("g", 4, "ｐaper"), ("h", 5, "рaper"), ("g", 6, None), ("g", 7, " "), ("g", 8, " ​"), (None, 9, "рaper"), ("g", None, "рaper"), ("g", 10, "")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "grp string, id long, text string, look string")
    got = sorted((r.id_a, r.id_b) for r in lookalike_pairs(df).collect())
    assert got == [(1, 2), (1, 4), (2, 3), (2, 4), (3, 4)]
    assert lookalike_pairs(df.limit(0)).count() == 0
    n = {r.id: r for r in normalized(df).collect() if r.id}
    assert n[2].text == "paper" and n[2].n_mixed_tokens == 1 and n[4].n_odd_forms == 1 and 6 not in n


def test_long_text():
    assert canonical("ｘ​" * 100_000) == "x" * 100_000


def test_classes(spark):
    rows = [("g", i, t) for i, t in enumerate(["paper", "pаper", "paper", "ｐaper", "other", "other", None, " "])] + [("h", 20, "pаper"), (None, 21, "paper"), ("g", None, "pаper")]
    from tessera.llm.lookalike import lookalike_classes

    df = spark.createDataFrame([(*r, "x") for r in rows], "grp string, id long, text string, look string")
    got = sorted(tuple(r) for r in lookalike_classes(df).collect())
    assert got == [("g", i, 0, 4, 3) for i in range(4)]
    assert lookalike_classes(df.limit(0)).count() == 0
