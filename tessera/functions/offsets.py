"""Folds that keep, for every character they leave, where it came from in the raw text."""

from __future__ import annotations

import re

import numpy as np

from .folds import HARAKAT, PLAIN_MARKS

# The letters that narration matching replaces, and what by.
MATCH_OLD, MATCH_NEW = "أإآىة", "ااايه"
_FOLDED = dict(zip(map(ord, MATCH_OLD), MATCH_NEW)) | dict.fromkeys(map(ord, HARAKAT))
# What the conservative profiles delete beyond vowel signs.
PROFILES = {"marks": "", "brackets": "[]", "spaces": "[] \t\n\r\f\v "}


def match_with_origins(raw: str) -> tuple[str, np.ndarray]:
    """The text folded for narration matching, and its edges: character i comes from raw[edges[i] : edges[i + 1]].

    Marks belong to the character before them, a run of white space is one blank, and marks before the first
    character to nothing. So the origins tile the text from the first kept character to its end.
    """
    kept = [i for i, c in enumerate(raw) if ord(c) not in _FOLDED or _FOLDED[ord(c)] is not None]
    blank = [raw[i].isspace() for i in kept]
    first = [i for k, i in enumerate(kept) if not (blank[k] and k and blank[k - 1])]
    folded = "".join(" " if raw[i].isspace() else _FOLDED.get(ord(raw[i]), raw[i]) for i in first)
    return folded, np.array([*first, len(raw)], np.int32)


def marks_with_origins(raw: str, profile: str = "marks") -> tuple[str, list[int]]:
    """The text without what the profile deletes, and the raw place of every character left; nothing is replaced."""
    gone = frozenset(PLAIN_MARKS + PROFILES[profile])
    places = [i for i, c in enumerate(raw) if c not in gone]
    return "".join(map(raw.__getitem__, places)), places


def find_folded(raw: str, term: str) -> list[tuple[int, int]]:
    """Raw spans of every place, overlapping ones too, where the folded term stands in the folded text."""
    text, edges = match_with_origins(raw)
    wanted = match_with_origins(term)[0]
    out, at = [], text.find(wanted) if wanted else -1
    while at >= 0:
        out.append((int(edges[at]), int(edges[at + len(wanted)])))
        at = text.find(wanted, at + 1)
    return out


def located_words(raw: str) -> list[tuple[str, int, int]]:
    """Folded words between white space with their raw spans; what folds to nothing is no word."""
    return [(w, m.start(), m.end()) for m in re.finditer(r"\S+", raw) for w in m[0].translate(_FOLDED).split()]


def _apart(text: str, a: int, b: int) -> bool:
    """Whether no letter, digit or underscore touches [a, b) from outside."""
    outside = text[a - 1 : a] + text[b : b + 1]
    return not any(c.isalnum() or c == "_" for c in outside)


FOLDED_LEAST = 3  # fixed value: characters of a term that may be looked for without its marks


def whole_word_places(text: str, term: str) -> tuple[str, list[tuple[int, int]]]:
    """(`literal_exact_v1`, `marks` or empty, spans): whole-word places as written, and only if there are none without marks."""
    exact = [(m.start(), m.start() + len(term)) for m in re.finditer(f"(?={re.escape(term)})", text)] if term else []
    exact = [p for p in exact if _apart(text, *p)]
    if exact or not term:
        return ("literal_exact_v1" if exact else ""), exact
    bare, places = marks_with_origins(text)
    wanted = marks_with_origins(term)[0]
    if len(wanted) < FOLDED_LEAST:
        return "", []
    spans = [(places[m.start()], places[m.start() + len(wanted) - 1] + 1) for m in re.finditer(f"(?={re.escape(wanted)})", bare)]
    spans = [p for p in spans if _apart(text, *p)]
    return ("marks" if spans else ""), spans
