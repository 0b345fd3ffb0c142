"""Most frequent items in bounded memory: hierarchical count-sketch, descent over hash prefixes, verification.

A first scan adds every occurrence to one count-sketch for each prefix length of the item's mixed 64-bit value; tasks emit
their non-zero counters, Spark adds them up, and the driver gets a table whose size is fixed by the parameters.  The descent keeps
the heaviest prefixes of each length; as the mixing can be undone, full-length prefixes are the items.  A second scan counts
the candidates exactly.

A result is certain if no prefix let go can hold an item as frequent as the last one listed, up to three standard errors of the sketch.
Otherwise both scans are repeated with a wider sketch and beam, and in the end all items are counted.

Null lists and null values have no occurrences; an empty input gives no rows; ties go to the smaller item.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from strandloom.session import saved

STEP, LEVELS, ROWS = 8, 8, 5
#: Counters a row, and prefixes kept at each level of the descent (candidates verified), of each attempt.
ATTEMPTS = ((8192, 2048), (32768, 4096))
M1, M2 = 0xBF58476D1CE4E5B9, 0x94D049BB133111EB


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective mixing of 64-bit values."""
    x = x.astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(M1)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(M2)
    return x ^ (x >> np.uint64(31))


def unmix(x: np.ndarray) -> np.ndarray:
    """Inverse of `mix`."""

    def unshift(v: np.ndarray, k: int) -> np.ndarray:
        out = v
        for _ in range(64 // k + 1):
            out = v ^ (out >> np.uint64(k))
        return out

    x = unshift(x.astype(np.uint64), 31) * np.uint64(pow(M2, -1, 1 << 64))
    x = unshift(x, 27) * np.uint64(pow(M1, -1, 1 << 64))
    return unshift(x, 30)


def cells(prefix: np.ndarray, level: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Counter number in the level's table (rows x items) and sign of prefixes of `level` steps."""
    out, sign = [], []
    for r in range(ROWS):
        h = mix(prefix + np.uint64((level * ROWS + r + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
        out.append((h % np.uint64(width)).astype(np.int64) + r * width)
        sign.append(1 - 2 * (h >> np.uint64(63)).astype(np.int64))
    return np.stack(out), np.stack(sign)


def _values(col) -> np.ndarray:
    if pa.types.is_list(col.type) or pa.types.is_large_list(col.type):
        col = col.flatten()
    return col.drop_null().to_numpy(zero_copy_only=False).astype(np.int64)


def _sketch(width: int):
    """Arrow kernel: a task's occurrences -> the non-zero counters of its sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros((LEVELS, ROWS * width), dtype=np.int64)
        for batch in batches:
            items, n = np.unique(_values(batch.column(0)), return_counts=True)
            h = mix(items)
            for level in range(LEVELS):
                cell, sign = cells(h >> np.uint64(64 - STEP * (level + 1)), level, width)
                table[level] += np.bincount(cell.ravel(), weights=(sign * n).ravel(), minlength=ROWS * width).astype(np.int64)
        flat = table.ravel()
        some = np.flatnonzero(flat)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(flat[some])], names=["cell", "n"])

    return run


def descend(table: np.ndarray, width: int, beam: int) -> tuple[np.ndarray, np.ndarray, float]:
    """Candidate items, their estimates, and the largest count that a prefix let go may well have."""
    prefix, cut = np.zeros(1, dtype=np.uint64), 0.0
    for level in range(LEVELS):
        prefix = ((prefix << np.uint64(STEP))[:, None] | np.arange(1 << STEP, dtype=np.uint64)).ravel()
        cell, sign = cells(prefix, level, width)
        guess = np.median(table[level][cell] * sign, axis=0)
        order = np.argsort(-guess, kind="stable")
        # the spread of the counters, which the few cells of heavy items do not move
        error = float(np.median(np.abs(table[level]))) / 0.6745
        if len(order) > beam:
            cut = max(cut, max(0.0, float(guess[order[beam]])) + 3 * error)
            order = order[:beam]
        prefix, guess = prefix[order], guess[order]
    return unmix(prefix).astype(np.int64), guess, cut


def _verified(items: np.ndarray, guess: np.ndarray):
    """Arrow kernel: a task's occurrences of the candidates."""
    order = np.argsort(items)
    items, guess = items[order], np.round(guess[order]).astype(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(len(items), dtype=np.int64)
        for batch in batches:
            v = _values(batch.column(0))
            if len(v):
                at = np.minimum(np.searchsorted(items, v), len(items) - 1)
                n += np.bincount(at[items[at] == v], minlength=len(items))
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(items[some]), pa.array(guess[some]), pa.array(n[some])], names=["item", "est_count", "n"])

    return run


def top_items(df: DataFrame, col: str, k: int, attempts: tuple[tuple[int, int], ...] = ATTEMPTS) -> DataFrame:
    """item, est_count, n: the `k` most frequent values of a bigint or array<bigint> column; `n` is exact.

    The driver gets the sketch's counters (8 * 5 * width at most) and the count of the k-th item.
    """
    for width, beam in attempts:
        found = df.select(col).mapInArrow(_sketch(width), "cell int, n bigint").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
        table = np.zeros(LEVELS * ROWS * width, dtype=np.int64)
        table[found["cell"].to_numpy()] = found["n"].to_numpy()
        items, guess, cut = descend(table.reshape(LEVELS, -1), width, beam)
        counted = df.select(col).mapInArrow(_verified(items, guess), "item bigint, est_count bigint, n bigint").groupBy("item", "est_count").agg(F.sum("n").alias("n"))
        top = saved(counted.orderBy(F.desc("n"), "item").limit(k))
        size, least = top.agg(F.count("*"), F.min("n")).first()
        if cut == 0 or (size == k and least > cut):
            return top
    values = df.select(F.explode(col).alias("item")) if isinstance(df.schema[col].dataType, ArrayType) else df.select(F.col(col).alias("item"))
    every = values.where("item IS NOT NULL").groupBy(F.col("item").cast("bigint").alias("item")).agg(F.count("*").alias("n"))
    return every.select("item", F.col("n").alias("est_count"), "n").orderBy(F.desc("n"), "item").limit(k)
