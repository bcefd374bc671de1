"""Problem 4: texts that look the same but are written with different characters.

Method: every token's letters have sets of scripts they can be read in (a Cyrillic 'а' also as Latin 'a', and that as
Cyrillic). The sets of a token are intersected: it is spelled throughout in the first script that all its letters can
be read in, whether it mixes scripts (a Latin 'o' in a Cyrillic, Greek, Armenian or Cherokee word too) or uses
look-alike letters throughout; a token that no one script can spell stays as it is. Remaining forms are brought to one:
width and presentation forms, letters that are drawn as two others (ligatures, Roman numerals, sara am), composed and
decomposed marks and their order, kinds of space, invisible characters, and the regional forms of Arabic letters and
digits. Case, marks, tatweel and quotation marks are visible and stay.

Equal canonical texts meet by a 128-bit digest. Only pairs with at least one text that is not already canonical can
be cases, so the join's one side is the few changed texts; exact copies are never compared with each other.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.runtime import materialize, spread, table
from .codes import pieces

# Letters of other scripts that look like a Latin letter, and what they look like.
CYRILLIC = "АВЕЅІЈКМНОРСТУХҮѴԌԚԜаеѕіјорсухѵԛԝԁһӏ"
CYRILLIC_AS_LATIN = "ABESIJKMHOPCTYXYVGQWaesijopcyxvqwdhl"
GREEK = "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧονϲϳ"
GREEK_AS_LATIN = "ABEZHIKMNOPTYXovcj"
ARMENIAN = "ՕՍՏօսհոցզ"
ARMENIAN_AS_LATIN = "OUSouhngq"
CHEROKEE = "ᎠᎡᎢᎪᎫᎬᎳᎷᎻᏀᏃᏙᏚᏞᏟᏢᏦᏴ"
CHEROKEE_AS_LATIN = "DRTAJEWMHGZVSLCPKB"
# Regional Arabic letters and digits that are drawn like the common ones.
ARABIC = "یکہھەۀ۰۱۲۳۷۸۹"
ARABIC_AS_COMMON = "يكهههۀ٠١٢٣٧٨٩"

#: Scripts in the order in which a token that several can spell takes one, with their letters that look like Latin ones.
AS_LATIN = {"Latin": {}, "Cyrillic": dict(zip(CYRILLIC, CYRILLIC_AS_LATIN)), "Greek": dict(zip(GREEK, GREEK_AS_LATIN)), "Armenian": dict(zip(ARMENIAN, ARMENIAN_AS_LATIN)), "Cherokee": dict(zip(CHEROKEE, CHEROKEE_AS_LATIN))}
LATIN_OF = {c: latin for letters in AS_LATIN.values() for c, latin in letters.items()}
#: For each script, its letter that looks like a Latin one (the first where two do).
OF_LATIN = {script: {latin: c for c, latin in reversed(letters.items())} for script, letters in AS_LATIN.items()}
FORMS = ("<wide>", "<narrow>", "<isolated>", "<initial>", "<medial>", "<final>", "<noBreak>")
# Ranges of letters and numerals that are drawn like the letters they decompose to.
DRAWN_AS_TWO = ((0x132, 0x133), (0x1C7, 0x1CC), (0xE33, 0xE33), (0xEB3, 0xEB3), (0x2160, 0x217F), (0xFB00, 0xFB04), (0xFB06, 0xFB06), (0xFB13, 0xFB17))


def _invisible(c: str) -> bool:
    o = ord(c)
    return unicodedata.category(c) == "Cf" and o not in range(0x600, 0x606) or o in (0x34F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x3164) or 0xFE00 <= o <= 0xFE0F


def _table() -> dict[int, str | None]:
    """By rule over all of Unicode's planes 0 and 14: invisible characters, spaces, width and presentation forms."""
    out: dict[int, str | None] = {}
    for o in [*range(0x80, 0xD800), *range(0xE000, 0x10000), *range(0xE0000, 0xE0200)]:
        c = chr(o)
        if _invisible(c):
            out[o] = None
        elif unicodedata.category(c) == "Zs":
            out[o] = " "
        elif unicodedata.decomposition(c).startswith(FORMS):
            plain = unicodedata.normalize("NFKC", c)
            if " " not in plain:
                out[o] = plain
    out |= {o: unicodedata.normalize("NFKC", chr(o)) for a, b in DRAWN_AS_TWO for o in range(a, b + 1) if unicodedata.normalize("NFKC", chr(o)) != chr(o)}
    return out | dict(zip(map(ord, ARABIC), ARABIC_AS_COMMON))


TABLE = _table()
ODD = re.compile("[" + re.escape("".join(map(chr, sorted(TABLE)))) + "]")
FOREIGN = re.compile("[\u0370-\u058f\u13a0-\u13f5\u1f00-\u1fff]")
TOKEN = re.compile(r"(?:[^\W\d_][\u0300-\u036f]*)+")


def _own(letter: str) -> str:
    """The script a letter belongs to; empty for modifier letters, which go with any."""
    o = ord(letter)
    if 0x2B0 <= o < 0x300:
        return ""
    if o < 0x2B0 or 0x1E00 <= o < 0x1F00:
        return "Latin"
    if 0x370 <= o < 0x400 or 0x1F00 <= o < 0x2000:
        return "Greek"
    if o < 0x530:
        return "Cyrillic"
    return "Armenian" if o < 0x590 else "Cherokee" if 0x13A0 <= o < 0x13F6 else "other"


@lru_cache(maxsize=4096)
def scripts(letter: str) -> frozenset[str]:
    """The scripts a letter can be read in, look-alikes of other scripts included."""
    own = _own(letter)
    if not own:
        return frozenset((*AS_LATIN, "other"))
    latin = letter if own == "Latin" else AS_LATIN.get(own, {}).get(letter)
    return frozenset((own, *(s for s in AS_LATIN if latin and (s == "Latin" or latin in OF_LATIN[s]))))


def resolved(token: str) -> tuple[str, str]:
    """A token in its consistent spelling, and what it was: `single`, `mixed` (scripts) or `whole` (all look-alikes)."""
    letters = [c for c in token if c.isalpha()]
    own = {_own(c) for c in letters} - {""}
    common = frozenset.intersection(*map(scripts, letters)) if letters else frozenset()
    script = next((s for s in AS_LATIN if s in common), None)
    if script is None or own <= {script}:
        return token, "single"
    latin = (LATIN_OF.get(c, c) for c in token)
    spelled = "".join(latin) if script == "Latin" else "".join(c if _own(c) in ("", script) else OF_LATIN[script].get(LATIN_OF.get(c, c), c) for c in token)
    return spelled, "mixed" if len(own) > 1 else "whole"


def canonical(text: str) -> str:
    """The one form of all texts that look like `text`."""
    if text.isascii():
        return text
    text = text.translate(TABLE)
    if FOREIGN.search(text):
        text = TOKEN.sub(lambda m: resolved(m[0])[0], unicodedata.normalize("NFD", text))
    return unicodedata.normalize("NFC", text)


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, texts in pieces(batches, "text"):
        canon = [canonical(t) for t in texts]
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0),
                batch.column(1),
                pa.array([xxhash.xxh3_128_digest(c.encode("utf-8", "surrogatepass")) if c.strip() else None for c in canon], pa.binary()),
                pa.array([xxhash.xxh3_64_intdigest(t.encode("utf-8", "surrogatepass")) - (1 << 63) for t in texts], pa.int64()),
                pa.array([c != t for c, t in zip(canon, texts)], pa.bool_()),
            ],
            names=["grp", "id", "look", "exact", "changed"],
        )


def lookalike_pairs(texts: DataFrame) -> DataFrame:
    """`texts(grp STRING, id BIGINT, text STRING)` to (grp, id_a, id_b): pairs of one group whose texts are different
    strings that look the same, id_a < id_b.

    Null or blank texts (blank once invisible characters are gone), null ids and null groups take part in nothing.
    """
    usable = texts.where("grp is not null and id is not null and text is not null").select("grp", "id", "text")
    marked = materialize(spread(usable).mapInArrow(_digest, "grp string, id long, look binary, exact long, changed boolean").where("look is not null"))
    a, b = marked.where("changed").alias("a"), marked.alias("b")
    met = a.join(b, F.expr("a.look = b.look and a.grp = b.grp and a.exact <> b.exact and a.id <> b.id and (not b.changed or a.id < b.id)"))
    return met.select(F.col("a.grp").alias("grp"), F.least("a.id", "b.id").alias("id_a"), F.greatest("a.id", "b.id").alias("id_b"))


def lookalike_classes(texts: DataFrame) -> DataFrame:
    """`texts(grp STRING, id BIGINT, text STRING)` to (grp, id, class_id, n_texts, n_spellings): every text that looks like
    another string of its group, with its class (its least id), how many texts look so and in how many spellings.

    One row a text however large a class is: the classes are counted with map-side combination and joined back.
    """
    usable = texts.where("grp is not null and id is not null and text is not null").select("grp", "id", "text")
    marked = materialize(spread(usable).mapInArrow(_digest, "grp string, id long, look binary, exact long, changed boolean").where("look is not null"))
    spelled = marked.groupBy("grp", "look", "exact").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("least"))
    classes = spelled.groupBy("grp", "look").agg(F.min("least").alias("class_id"), F.sum("n").alias("n_texts"), F.count(F.lit(1)).alias("n_spellings")).where("n_spellings > 1")
    return marked.join(materialize(classes), ["grp", "look"]).select("grp", "id", "class_id", "n_texts", "n_spellings")


def _normalize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, texts in pieces(batches, "text"):
        odd = [len(ODD.findall(t)) for t in texts]
        kinds = [[resolved(m)[1] for m in TOKEN.findall(unicodedata.normalize("NFD", t.translate(TABLE)))] if FOREIGN.search(t) else [] for t in texts]
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0),
                pa.array([canonical(t) for t in texts]),
                pa.array(odd, pa.int32()),
                pa.array([k.count("mixed") for k in kinds], pa.int32()),
                pa.array([k.count("whole") for k in kinds], pa.int32()),
            ],
            names=["id", "text", "n_odd_forms", "n_mixed_tokens", "n_whole_tokens"],
        )


def normalized(texts: DataFrame) -> DataFrame:
    """`texts(id, text)` to (id, text in its canonical form, counts of what was odd in it); null texts give no row."""
    kind = texts.schema["id"].dataType.simpleString()
    return spread(texts.where("text is not null").select("id", "text")).mapInArrow(
        _normalize, f"id {kind}, text string, n_odd_forms int, n_mixed_tokens int, n_whole_tokens int"
    )


def _both(spark, folder: str) -> DataFrame:
    verses = table(spark, folder, "verses").where("sura is not null and aya is not null")
    return verses.select(F.concat_ws(":", F.lit("v"), "sura", "aya").alias("grp"), F.col("verse_id").alias("id"), "text").unionByName(
        table(spark, folder, "tafsirs").select(F.lit("t").alias("grp"), F.col("tafsir_id").alias("id"), "text")
    )


def _table_name():
    return F.when(F.col("grp") == "t", "tafsirs").otherwise("verses").alias("table_name")


def p4_found(spark, folder: str) -> DataFrame:
    return lookalike_pairs(_both(spark, folder)).select(_table_name(), "id_a", "id_b")


def p4_classes(spark, folder: str) -> DataFrame:
    return lookalike_classes(_both(spark, folder)).select(_table_name(), "id", "class_id", "n_texts", "n_spellings")
