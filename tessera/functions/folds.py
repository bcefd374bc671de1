"""Named text folds as columns. Each search or comparison states its fold; they differ on purpose and are never shared.

All but `nfc` are one `translate` or `regexp_replace` and stay inside whole-stage code generation.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def _run(a: int, b: int) -> str:
    return "".join(map(chr, range(a, b + 1)))


# The characters each fold deletes or replaces.
HARAKAT = _run(0x64B, 0x65F) + "ٰـ"
QURAN_MARKS = "".join(c for c in _run(0x610, 0x61A) + _run(0x64B, 0x652) + _run(0x6D6, 0x6ED) if unicodedata.category(c) == "Mn")
FINGERPRINT_MARKS = _run(0x610, 0x61A) + _run(0x64B, 0x65F) + "ٰ" + _run(0x6D6, 0x6ED) + "ـ"
PLAIN_MARKS = _run(0x64B, 0x652) + _run(0x656, 0x65F) + "ٰ" + _run(0x6D6, 0x6ED)
EXTRA_SIGNS = "ـۥۦ۞۩"


def _translate(c: Column, delete: str, old: str = "", new: str = "") -> Column:
    return F.translate(c, old + delete, new)


def collapse(c: Column) -> Column:
    """Runs of white space become one space."""
    return F.regexp_replace(c, r"(?U)\s+", " ")


def fold_match(c: Column) -> Column:
    """Narration matching: no vowel signs or tatweel, alef forms to alef, alef maqsura to ya, ta marbuta to ha, runs to one space."""
    return collapse(_translate(c, HARAKAT, "أإآىة", "اااي" + "ه"))


def fold_quran_marks(c: Column) -> Column:
    """Optional marks only; hamza signs and the small alef stay."""
    return _translate(c, QURAN_MARKS)


def fold_fingerprint(c: Column) -> Column:
    """Duplicate keys: marks and tatweel go, alef forms and alef maqsura are merged, ta marbuta stays; trimmed."""
    return F.trim(collapse(_translate(c, FINGERPRINT_MARKS, "أإآى", "اااي")))


def fold_marks(c: Column) -> Column:
    return _translate(c, PLAIN_MARKS)


def fold_brackets(c: Column) -> Column:
    return _translate(c, PLAIN_MARKS + "[]")


def fold_spaces(c: Column) -> Column:
    return _translate(c, PLAIN_MARKS + "[] \t\n\r\f\v ")


@F.pandas_udf(StringType())
def nfc(s: pd.Series) -> pd.Series:
    """Unicode NFC; Spark has no built-in."""
    return s.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFC", t))


@F.pandas_udf(StringType())
def fold_tokens(s: pd.Series) -> pd.Series:
    """Retrieval tokens: NFKC, no tatweel or marks, case folded."""

    def one(t: str | None) -> str | None:
        if t is None:
            return None
        t = unicodedata.normalize("NFKC", t).translate(_DROP)
        return t.casefold()

    return s.map(one)


_DROP = dict.fromkeys(map(ord, FINGERPRINT_MARKS))


def markless(c: Column) -> Column:
    """No combining marks; for columns already in NFC."""
    return F.regexp_replace(c, r"\p{M}", "")


def fold_alef(c: Column) -> Column:
    return F.translate(c, "ٱأإآ", "اااا")


def fold_extended(c: Column) -> Column:
    """On top of NFC and `markless`: alef variants, alef maqsura, small signs; runs of white space to one."""
    return collapse(_translate(fold_alef(c), EXTRA_SIGNS, "ى", "ي"))
