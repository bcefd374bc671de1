"""Vectorised work on the code points of many texts at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
BASE = U64(0x9E3779B97F4A7C15)
MIX = U64(0xBF58476D1CE4E5B9)


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The code points of all texts in one array, and where each text begins (with the end at last)."""
    starts = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) for t in texts], out=starts[1:])
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4"), starts


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values, so that their order says nothing about the text."""
    x = (x ^ (x >> U64(29))) * MIX
    return x ^ (x >> U64(32))


def rolling(codes: np.ndarray, width: int) -> np.ndarray:
    """A 64-bit polynomial hash of the `width` code points from each position on, by doubling."""
    n = len(codes) - width + 1
    if n <= 0:
        return np.empty(0, U64)
    piece, out, done, size = mixed((codes.astype(U64) + U64(1)) * BASE), None, 0, 1
    with np.errstate(over="ignore"):
        while True:
            if width & size:
                part = piece[done : done + n]
                out = part if out is None else out * U64(pow(int(BASE), size, 1 << 64)) + part
                done += size
            if done == width:
                return mixed(out)
            piece = piece[:-size] * U64(pow(int(BASE), size, 1 << 64)) + piece[size:]
            size *= 2


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """The least of the `width` values from each position on, by doubling."""
    size = 1
    while size * 2 <= width:
        values = np.minimum(values[:-size], values[size:])
        size *= 2
    rest = width - size
    return np.minimum(values[: len(values) - rest], values[rest:]) if rest else values


def pieces(batches: Iterator[pa.RecordBatch], column: str, chars: int = 1_000_000) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Cut batches so that one piece holds about `chars` characters; a text is never cut."""
    for batch in batches:
        texts = batch.column(batch.schema.get_field_index(column)).to_pylist()
        begin = size = 0
        for i, t in enumerate(texts):
            if size and size + len(t) > chars:
                yield batch.slice(begin, i - begin), texts[begin:i]
                begin, size = i, 0
            size += len(t)
        if begin < len(texts):
            yield batch.slice(begin), texts[begin:]
