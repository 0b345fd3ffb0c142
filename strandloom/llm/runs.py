"""Runs of equal events collapsed into one event each, clean or blurred.

Every sequence is an entity; its events are letters.  Exact runs come first (their similarity is 1 and nothing lies between
their events).  The runs of a sequence form a linked list; two neighbours of the same event may merge if only a short gap of letters
that are no events (unclear ones) parts them.  A priority queue merges the most similar neighbours until none meets the limits of
gap and similarity.  Chains that could never reach the wanted number of events are left out of the queue; this changes no
reported run.

Null, empty and placeholder sequences have no runs; white space inside a sequence is no event and no position; letters other
than the wanted events only ever lie inside gaps, and an event never bridges a run of another.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of text that one pass of the array code takes at most (a longer sequence is its own pass).
BLOCK_BYTES = 8 << 20
BASES = "ACGT"
SKIP, OTHER = 255, 254


def letter_codes(events: str, same: dict[str, str]) -> np.ndarray:
    """Byte -> event number in either letter case; SKIP for white space and continuation bytes, OTHER for the rest."""
    table = np.full(256, OTHER, dtype=np.uint8)
    table[0x80:0xC0] = SKIP
    table[[ord(c) for c in " \t\n\r\v\f"]] = SKIP
    for letter in [*events, *same]:
        code = events.index(same.get(letter, letter))
        table[[ord(letter.upper()), ord(letter.lower())]] = code
    return table


def agglomerate(start: list[int], end: list[int], max_gap: int, min_similarity: float) -> list[tuple[int, int, int]]:
    """Merges neighbouring runs [start, end) of one event with nothing but unclear letters between them; gives (start, events, span) of what remains.

    The similarity of two neighbours is the share of their event in their common span; ties go to the left.
    """
    n = len(start)
    count = [e - s for s, e in zip(start, end)]
    right, left = [*range(1, n), -1], [-1, *range(n - 1)]
    end = list(end)
    alive = [True] * n
    queue: list[tuple[float, int, int, int, int]] = []

    def offer(i: int, j: int) -> None:
        both = count[i] + count[j]
        similarity = both / (end[j] - start[i])
        if start[j] - end[i] <= max_gap and similarity >= min_similarity:
            heapq.heappush(queue, (-similarity, start[i], i, j, both))

    for i in range(n - 1):
        offer(i, i + 1)
    while queue:
        _, _, i, j, both = heapq.heappop(queue)
        if not (alive[i] and alive[j]) or right[i] != j or count[i] + count[j] != both:
            continue
        count[i], end[i], alive[j] = both, end[j], False
        right[i] = k = right[j]
        if k >= 0:
            left[k] = i
            offer(i, k)
        if left[i] >= 0:
            offer(left[i], i)
    return [(start[i], count[i], end[i] - start[i]) for i in range(n) if alive[i]]


def block_runs(codes: np.ndarray, at: np.ndarray, n_events: int, min_events: int, max_gap: int, min_similarity: float) -> np.ndarray:
    """Runs of the sequences codes[at[i]:at[i+1]]: rows of (sequence, start in it, events, span, event)."""
    n = len(codes)
    if n == 0:
        return np.empty((0, 5), dtype=np.int64)
    edge = np.empty(n, dtype=bool)
    edge[0] = True
    np.not_equal(codes[1:], codes[:-1], out=edge[1:])
    edge[at[:-1][at[:-1] < n]] = True
    start = np.flatnonzero(edge)
    end = np.append(start[1:], n)
    own = codes[start] < n_events
    start, end = start[own], end[own]
    if not len(start):
        return np.empty((0, 5), dtype=np.int64)
    event = codes[start]
    doc = np.searchsorted(at, start, side="right") - 1
    linked = (doc[1:] == doc[:-1]) & (event[1:] == event[:-1]) & (start[1:] - end[:-1] <= max_gap)
    first = np.flatnonzero(np.append(True, ~linked))
    size = np.diff(np.append(first, len(start)))
    able = np.add.reduceat(end - start, first) >= min_events
    one = first[able & (size == 1)]
    found = [np.stack([doc[one], start[one], end[one] - start[one], end[one] - start[one], event[one]], axis=1)]
    more = []
    for a, k in zip(first[able & (size > 1)].tolist(), size[able & (size > 1)].tolist()):
        merged = agglomerate(start[a : a + k].tolist(), end[a : a + k].tolist(), max_gap, min_similarity)
        more += [(doc[a], *m, event[a]) for m in merged if m[1] >= min_events]
    if more:
        found.append(np.array(more, dtype=np.int64))
    out = np.concatenate(found).astype(np.int64)
    out[:, 1] -= at[out[:, 0]]
    return out


def _kernel(events: str, same: dict[str, str], min_events: int, max_gap: int, min_similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = letter_codes(events, same)
        for batch in batches:
            ids, seqs = batch.column(0), batch.column(1).cast(pa.large_string())
            bounds = np.frombuffer(seqs.buffers()[1], dtype=np.int64)[seqs.offset : seqs.offset + len(seqs) + 1]
            data = np.frombuffer(seqs.buffers()[2] or b"", dtype=np.uint8)
            i = 0
            while i < len(seqs):
                j = min(len(seqs), max(i + 1, int(np.searchsorted(bounds, bounds[i] + BLOCK_BYTES, side="right")) - 1))
                codes = table[data[bounds[i] : bounds[j]]]
                kept = codes != SKIP
                at = np.concatenate([[0], np.cumsum(kept)])[bounds[i : j + 1] - bounds[i]]
                r = block_runs(codes[kept], at, len(events), min_events, max_gap, min_similarity)
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array(r[:, 0] + i)), pa.array([events[c] for c in r[:, 4]], pa.string()), *[pa.array(r[:, c].astype(np.int32)) for c in (1, 2, 3)]],
                    names=["id", "event", "run_start", "n_events", "run_span"],
                )
                i = j

    return run


def collapse_runs(
    df: DataFrame, id_col: str, seq_col: str, min_events: int, max_gap: int = 0, min_similarity: float = 0.5,
    events: str = BASES, same: dict[str, str] | None = None, placeholders: tuple[str, ...] = ("*",),
) -> DataFrame:
    """id, event, run_start, n_events, run_span of every run of at least `min_events`, once for each id.

    Rows of one id must hold the same sequence.  Rows with a null id are skipped.  The kernel runs where the rows lie; only
    found runs are shuffled to remove those of repeated rows, after a partial removal in each task.
    """
    if min_events < 1 or max_gap < 0:
        raise ValueError("min_events >= 1 and max_gap >= 0 are needed")
    kind = df.schema[id_col].dataType.simpleString()
    rows = df.select(F.col(id_col).alias("id"), F.col(seq_col).alias("seq")).where(
        F.col("id").isNotNull() & F.col("seq").isNotNull() & ~F.trim("seq").isin("", *placeholders)
    )
    found = rows.mapInArrow(
        _kernel(events, same or {"U": "T"}, min_events, max_gap, min_similarity),
        f"id {kind}, event string, run_start int, n_events int, run_span int",
    )
    return found.dropDuplicates(["id", "event", "run_start"])
