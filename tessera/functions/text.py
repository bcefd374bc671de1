"""Scalar text functions as columns: digests, ids, plain text of markup, strict dates, span slices."""

from __future__ import annotations

import hashlib
import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

TAG = r"<[^>]*>"
BREAKING_TAG = r"(?i)<(?:br|h5)\s*/?>|</h5>"


def sha256(c: Column) -> Column:
    """Hex SHA-256 of the UTF-8 bytes."""
    return F.sha2(F.encode(c, "UTF-8"), 256)


def git_blob_sha1(c: Column) -> Column:
    """The object id git gives to a file of exactly this text."""
    size = F.octet_length(c).cast("string")
    return F.sha1(F.concat(F.encode(F.concat(F.lit("blob "), size), "UTF-8"), F.unhex(F.lit("00")), F.encode(c, "UTF-8")))


def stable_id(prefix: str, *parts: Column, digits: int = 40) -> Column:
    """`prefix` and the first hex digits of the digest of the parts, separated by U+001F; null if any part is."""
    return F.concat(F.lit(prefix), F.substring(sha256(F.concat(*[x for p in parts for x in (p.cast("string"), F.lit("\u001f"))])), 1, digits))


def has_text(c: Column) -> Column:
    """Whether anything but white space is there (null: false)."""
    return F.coalesce(c.rlike(r"[^\s\p{Z}]"), F.lit(False))


def plain_text(c: Column) -> Column:
    """Breaking tags become line ends, all other tags go."""
    return F.regexp_replace(F.regexp_replace(c, BREAKING_TAG, "\n"), TAG, "")


def slice_text(c: Column, start: Column, end: Column) -> Column:
    """Code points [start, end) of a text, counted from 0."""
    return F.substring(c, start + 1, end - start)


def strict_timestamp(c: Column) -> Column:
    """A timestamp written exactly as 2024-01-31T23:59:59Z, else null; impossible dates are null too."""
    at = F.try_to_timestamp(c, F.lit("yyyy-MM-dd'T'HH:mm:ss'Z'"))
    return F.when(F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'") == c, at)


@F.pandas_udf(StringType())
def canonical_json_sha256(s: pd.Series) -> pd.Series:
    """Digest of a JSON text written again with sorted keys, compact and without NaN; null where it isn't such JSON."""

    def one(t: str | None) -> str | None:
        try:
            text = json.dumps(json.loads(t, parse_constant=_refuse), ensure_ascii=False, sort_keys=True, separators=(",", ":"))
            return hashlib.sha256(text.encode()).hexdigest()
        except (ValueError, TypeError):
            return None

    return s.map(one)


def _refuse(name: str):
    raise ValueError(name)
