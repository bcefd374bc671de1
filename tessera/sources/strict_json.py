"""JSON that is refused where common readers guess: duplicate keys, NaN, byte order marks, trailing text."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


class _Duplicate(ValueError):
    pass


class _NotANumber(ValueError):
    pass


def _pairs(pairs):
    if len({k for k, _ in pairs}) != len(pairs):
        raise _Duplicate
    return dict(pairs)


def _constant(name):
    raise _NotANumber(name)


def load(text: str):
    """The parsed value; raises ValueError with what is wrong."""
    if text.startswith("﻿"):
        raise ValueError("BOM")
    try:
        return json.loads(text, object_pairs_hook=_pairs, parse_constant=_constant)
    except _Duplicate:
        raise ValueError("DUPLICATE_KEY") from None
    except _NotANumber:
        raise ValueError("NOT_A_NUMBER") from None
    except RecursionError:
        raise ValueError("TOO_DEEP") from None
    except ValueError:
        raise ValueError("NOT_JSON") from None


@F.pandas_udf(StringType())
def json_error(s: pd.Series) -> pd.Series:
    """What is wrong with a JSON text, null where nothing is; a null text is NOT_JSON."""

    def one(t):
        try:
            load(t) if t is not None else load("")
        except ValueError as e:
            return str(e)
        return None

    return s.map(one)


def with_errors(rows: DataFrame, column: str) -> DataFrame:
    return rows.withColumn("json_error", json_error(column))


def top_level_objects(text: str) -> list[tuple[int, int]]:
    """Spans of the outermost {...} in free text, braces inside strings not counted."""
    out, depth, begin, quoted, escaped = [], 0, 0, False, False
    for i, c in enumerate(text):
        if quoted:
            quoted, escaped = (escaped or c != '"'), (c == "\\" and not escaped)
        elif c == '"' and depth:
            quoted = True
        elif c == "{":
            begin, depth = (i if depth == 0 else begin), depth + 1
        elif c == "}" and depth:
            depth -= 1
            if depth == 0:
                out.append((begin, i + 1))
    return out


def blind_leaks(value, keys: frozenset[str], labels: frozenset[str], path: str = "input") -> list[str]:
    """Paths in a JSON value whose key names an answer, or whose text equals a label."""
    if isinstance(value, dict):
        found = [f"{path}.{k}" for k in value if k.lower() in keys]
        return found + [x for k, v in value.items() for x in blind_leaks(v, keys, labels, f"{path}.{k}")]
    if isinstance(value, list):
        return [x for i, v in enumerate(value) for x in blind_leaks(v, keys, labels, f"{path}[{i}]")]
    return [path] if isinstance(value, str) and value in labels else []
