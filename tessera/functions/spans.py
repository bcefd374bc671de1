"""Span functions that need a loop over the characters, run in Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from ..plans.runtime import spread


def explode_spans(df: DataFrame, key: str, text: str, fn: Callable[[str], list[tuple]], columns: str) -> DataFrame:
    """One row (key, columns...) for each tuple that `fn` gives for a text; null texts give none.

    `columns` is a DDL list of fixed types (int, string, boolean). Each text is worked on whole, in its own row's batch.
    """
    names = [c.split()[0] for c in columns.split(",")]
    kinds = [{"int": pa.int32(), "string": pa.string(), "boolean": pa.bool_()}[c.split()[1]] for c in columns.split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fn(t) for t in batch.column(1).to_pylist()]
            owner = pa.array([i for i, f in enumerate(found) for _ in f], pa.int64())
            flat = [x for f in found for x in f]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(owner), *(pa.array([x[i] for x in flat], k) for i, k in enumerate(kinds))], names=[key, *names]
            )

    kind = df.schema[key].dataType.simpleString()
    return spread(df.where(f"`{text}` is not null").select(key, text)).mapInArrow(run, f"{key} {kind}, {columns}")
