"""Numbered text lines `sura|aya|text`, at four levels of strictness."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LEVELS = ("comments", "unique", "ordered", "closed")


class PipeTextError(ValueError):
    pass


def parsed(lines: DataFrame, value: str = "value") -> DataFrame:
    """(sura, aya, text) of lines; the text may hold bars. Empty lines and comments (#) are skipped, others must parse.

    A line that doesn't parse gives a row with null numbers, so a caller can refuse it.
    """
    p = F.split(F.col(value), "[|]", 3)
    ok = (F.size(p) == 3) & p[0].rlike(r"^[0-9]{1,3}$") & p[1].rlike(r"^[0-9]{1,3}$")
    kept = lines.where((F.trim(F.col(value)) != "") & ~F.startswith(F.col(value), F.lit("#")))
    return kept.select(F.when(ok, p[0]).cast("int").alias("sura"), F.when(ok, p[1]).cast("int").alias("aya"), F.when(ok, p[2]).alias("text"))


def parse_file(content: bytes, level: str = "closed") -> list[tuple[int, int, str]]:
    """The verses of one file; each level adds to the one before it.

    comments: lines must parse. unique: no key twice. ordered: keys ascend. closed: UTF-8 without BOM, line ends are LF
    only, the file ends with one, and after a first comment below the verses (the footer) no verse follows.
    """
    if level not in LEVELS:
        raise ValueError(level)
    strict = LEVELS.index(level)
    if strict == 3 and content.startswith(b"\xef\xbb\xbf"):
        raise PipeTextError("BOM")
    text = content.decode("utf-8-sig")
    if strict == 3 and ("\r" in text or not text.endswith("\n")):
        raise PipeTextError("LINE_END")
    out: list[tuple[int, int, str]] = []
    seen: set[tuple[int, int]] = set()
    footer = False
    for n, line in enumerate(text.splitlines() if strict < 3 else text.split("\n"), 1):
        if not line.strip():
            continue
        if line.startswith("#"):
            footer = bool(out)
            continue
        if strict == 3 and footer:
            raise PipeTextError(f"VERSE_AFTER_FOOTER line {n}")
        head, bar, rest = line.partition("|")
        aya, bar2, verse = rest.partition("|")
        if not (bar and bar2 and head.isascii() and head.isdigit() and aya.isascii() and aya.isdigit()):
            raise PipeTextError(f"MALFORMED line {n}")
        key = (int(head), int(aya))
        if strict >= 1 and key in seen:
            raise PipeTextError(f"DUPLICATE {key[0]}:{key[1]}")
        if strict >= 2 and out and key < out[-1][:2]:
            raise PipeTextError(f"ORDER {key[0]}:{key[1]}")
        seen.add(key)
        out.append((*key, verse))
    return out


def read(spark: SparkSession, path: str, level: str = "closed") -> DataFrame:
    """(path, sura, aya, text) of pinned files, one task per file; a file that breaks its level fails the read."""
    if level not in LEVELS:
        raise ValueError(level)

    def run(frames):
        for f in frames:
            rows = [(p, *row) for p, c in zip(f["path"], f["content"]) for row in parse_file(bytes(c), level)]
            yield pd.DataFrame(rows, columns=["path", "sura", "aya", "text"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(run, "path string, sura int, aya int, text string")
