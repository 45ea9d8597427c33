"""Hashes of words and shingles in numpy, and counts of hashed features over a corpus."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BASE = 0x9E3779B97F4A7C15 | 1
BLOCK = 1 << 18
CELLS = 1 << 12  # counters in a row that travels


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads all bits (splitmix64's finalizer)."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _powers(base: int) -> np.ndarray:
    out = np.full(BLOCK + 1, base, np.uint64)
    out[0] = 1
    return np.cumprod(out)


_UP = _powers(BASE)
_DOWN = _powers(pow(BASE, -1, 1 << 64))


def word_hashes(solid: bytes) -> np.ndarray:
    """64-bit hashes of the words of a text whose words are joined by single spaces."""
    if not solid:
        return np.zeros(0, np.uint64)
    found, at = [], 0
    while at < len(solid):
        end = at + BLOCK
        if end < len(solid):
            cut = solid.rfind(b" ", at, end)
            if cut < 0:  # one word longer than a block
                cut = solid.find(b" ", end)
                cut = len(solid) if cut < 0 else cut
                h = np.zeros(1, np.uint64)
                for i in range(at, cut, BLOCK):
                    h = mix(h + word_hashes_of(np.frombuffer(solid, np.uint8, min(BLOCK, cut - i), i), np.zeros(1, np.int64), np.array([min(BLOCK, cut - i)])))
                found.append(h)
                at = cut + 1
                continue
            end = cut
        a = np.frombuffer(solid, np.uint8, min(end, len(solid)) - at, at)
        gaps = np.flatnonzero(a == 32)
        found.append(word_hashes_of(a, np.concatenate(([0], gaps + 1)), np.concatenate((gaps, [len(a)]))))
        at = end + 1
    return found[0] if len(found) == 1 else np.concatenate(found)


def word_hashes_of(a: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Polynomial hashes of the slices of a, from running sums, then mixed."""
    sums = np.zeros(len(a) + 1, np.uint64)
    np.cumsum((a.astype(np.uint64) + np.uint64(1)) * _UP[: len(a)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * _DOWN[starts] + np.uint64(BASE))


def shingles(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of the runs of ``size`` words; of all words if there are fewer."""
    n = len(words)
    if not n:
        return words
    size = min(size, n)
    m = n - size + 1
    total = np.zeros(m, np.uint64)
    for k in range(size):
        total = (total + words[k : k + m]) * np.uint64(BASE)
    return mix(total)


def counted(df: DataFrame, buckets: int, features: Callable[[], Callable[..., np.ndarray]], parts: int = 32) -> tuple[np.ndarray, int]:
    """How many rows of df have each feature, and how many rows there are.

    features() gives the function that returns a row's distinct feature numbers below ``buckets``. A task counts into
    one array; arrays travel in slices, and each slice is summed as a stream, so no task or driver holds more than
    ``buckets`` counters whatever the number of rows or tasks.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, total, n = features(), np.zeros(buckets, np.uint32), 0
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                total[of(*row)] += 1
                n += 1
                if n % 4_000_000_000 == 0:
                    yield from sliced(total)
                    total[:] = 0
        yield from sliced(total)
        yield pa.RecordBatch.from_pydict({"slice": [-1], "counts": [np.array([n], np.uint64).tobytes()]})

    def sliced(total: np.ndarray) -> Iterator[pa.RecordBatch]:
        for i in range(0, buckets, CELLS):
            if total[i : i + CELLS].any():
                yield pa.RecordBatch.from_arrays([pa.array([i // CELLS], pa.int64()), pa.array([total[i : i + CELLS].tobytes()])], ["slice", "counts"])

    partial = df.mapInArrow(count, "slice long, counts binary")
    # a task's counters are few bytes, so hold them as bytes of a kind until the sum
    got = partial.repartition(parts, "slice").mapInArrow(summed, "slice long, counts binary").collect()
    out, n = np.zeros(buckets, np.uint64), 0
    for k, raw in got:
        if k < 0:
            n += int(np.frombuffer(raw, np.uint64).sum())
        else:
            part = np.frombuffer(raw, np.uint64)
            out[k * CELLS : k * CELLS + len(part)] += part
    return out, n


def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each slice of counters, as 64-bit sums."""
    held: dict[int, np.ndarray] = {}
    for batch in batches:
        for k, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            part = np.frombuffer(raw, np.uint64 if k < 0 else np.uint32).astype(np.uint64)
            if k in held:
                held[k] += part
            else:
                held[k] = part
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int64()), pa.array([x.tobytes() for x in held.values()])], ["slice", "counts"])


def normal(text: str | None) -> bytes:
    """The words of a text joined by single spaces, as bytes."""
    return b" ".join((text or "").encode().split())


def draw(*parts: Column) -> Column:
    return F.xxhash64(*parts)
