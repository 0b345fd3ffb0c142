"""Array kernels for sequences: letter codes, run collapsing, rolling canonical hashes, syncmers.

All work on the concatenated sequences of an Arrow batch; `at` holds the sequences' bounds.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

# The published 64-bit seeds of the rolling hash for A, C, G, T; other letters have seed 0.
SEEDS = np.array([0x3C8BFBB395C60474, 0x3193C18562A02B4C, 0x20323ED082572324, 0x295549F54BE24456, 0], dtype=np.uint64)

_CODE = np.full(256, 4, dtype=np.uint8)
for _i, _c in enumerate("ACGT"):
    _CODE[[ord(_c), ord(_c.lower())]] = _i
_CODE[[ord("U"), ord("u")]] = 3
_WHITE = np.zeros(256, dtype=bool)
_WHITE[[ord(c) for c in " \t\n\r\v\f"]] = True
_RUNS = np.zeros(256, dtype=bool)
_RUNS[[ord(c) for c in "ACGTNacgtn"]] = True
_COMPLEMENT = np.full(256, ord("N"), dtype=np.uint8)
for _a, _b in zip("ACGTacgtUu", "TGCAtgcaAa"):
    _COMPLEMENT[ord(_a)] = ord(_b)


def string_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and bounds of a string column; nulls count as empty."""
    col = col.cast(pa.large_string()).fill_null("")
    at = np.frombuffer(col.buffers()[1], dtype=np.int64)[col.offset : col.offset + len(col) + 1]
    return np.frombuffer(col.buffers()[2] or b"", dtype=np.uint8)[at[0] : at[-1]], at - at[0]


def compact(data: np.ndarray, at: np.ndarray, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The kept bytes and their bounds."""
    return data[keep], np.concatenate([[0], np.cumsum(keep)])[at]


def clean(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Upper case, U as T, without white space."""
    data, at = compact(data, at, ~_WHITE[data])
    lower = (data >= 97) & (data <= 122)
    data = np.where(lower, data - 32, data).astype(np.uint8)
    return np.where(data == ord("U"), np.uint8(ord("T")), data), at


def collapse(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Homopolymer compression: bytes, bounds, and for each kept letter its position in its own sequence.

    Runs of A, C, G, T and N collapse in either case; other letters never do.
    """
    n = len(data)
    keep = np.ones(n, dtype=bool)
    if n:
        keep[1:] = (data[1:] != data[:-1]) | ~_RUNS[data[1:]]
        keep[at[:-1][at[:-1] < n]] = True
    where = np.flatnonzero(keep)
    out, bounds = compact(data, at, keep)
    return out, bounds, where - np.repeat(at[:-1], np.diff(bounds))


def reverse_complement(seq: str) -> str:
    """A and T, C and G swapped in either case, U read as T; every other letter becomes N."""
    return _COMPLEMENT[np.frombuffer(seq.encode("latin-1", "replace"), dtype=np.uint8)][::-1].tobytes().decode("latin-1")


def _rol(x: np.ndarray, k: int) -> np.ndarray:
    k %= 64
    return x if k == 0 else (x << np.uint64(k)) | (x >> np.uint64(64 - k))


def window_starts(at: np.ndarray, n: int, l: int) -> np.ndarray:
    """Starts of the windows of l letters that lie inside one sequence."""
    if n < l:
        return np.empty(0, dtype=np.int64)
    end = np.repeat(at[1:], np.diff(at))
    i = np.arange(n - l + 1)
    return i[i + l <= end[: n - l + 1]]


def canonical_hashes(data: np.ndarray, l: int) -> np.ndarray:
    """Rolling hash of every window of l letters, the smaller of both strands."""
    n = len(data) - l + 1
    if n < 1:
        return np.empty(0, dtype=np.uint64)
    code = _CODE[data]
    own = SEEDS[code]
    other = SEEDS[np.where(code < 4, 3 - code, 4)]
    fwd, rev = np.zeros(n, dtype=np.uint64), np.zeros(n, dtype=np.uint64)
    for i in range(l):
        fwd ^= _rol(own[i : i + n], l - 1 - i)
        rev ^= _rol(other[i : i + n], i)
    return np.minimum(fwd, rev)


def density_bound(density: float) -> np.uint64:
    """Largest hash that a density keeps; a density of at most 0.5 keeps hashes inside bigint."""
    if not 0 < density <= 0.5:
        raise ValueError("density must lie in (0, 0.5]")
    return np.uint64(int(density * float(2**64 - 1)))


def density_minimizers(
    data: np.ndarray, at: np.ndarray, l: int, density: float, hpc: bool, collapsed_positions: bool = False, without: str = "",
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sequence number, position in the sequence as given (or after collapsing), and hash of the selected windows; windows with a letter
    of `without` are left out."""
    pos = None
    if hpc:
        data, at, pos = collapse(data, at)
    if pos is None or collapsed_positions:
        pos = np.arange(len(data)) - np.repeat(at[:-1], np.diff(at))
    start = window_starts(at, len(data), l)
    h = canonical_hashes(data, l)[start]
    keep = h <= density_bound(density)
    if without:
        bad = np.concatenate([[0], np.cumsum(np.isin(data, np.frombuffer(without.encode(), dtype=np.uint8)))])
        keep &= bad[start + l] == bad[start]
    start, h = start[keep], h[keep]
    return np.searchsorted(at, start, side="right") - 1, pos[start], h


def mix_masked(key: np.ndarray, mask: int) -> np.ndarray:
    """The published invertible integer hash on as many bits as the mask has."""
    m, u = np.uint64(mask), np.uint64
    key = key.astype(np.uint64)
    key = (~key + (key << u(21))) & m
    key = key ^ (key >> u(24))
    key = (key + (key << u(3)) + (key << u(8))) & m
    key = key ^ (key >> u(14))
    key = (key + (key << u(2)) + (key << u(4))) & m
    key = key ^ (key >> u(28))
    return (key + (key << u(31))) & m


def two_bit(code: np.ndarray, k: int) -> np.ndarray:
    """Smaller of both strands of every k-letter window as 2-bit numbers; windows with other letters hold rubbish."""
    n = max(0, len(code) - k + 1)
    fwd, rev = np.zeros(n, dtype=np.uint64), np.zeros(n, dtype=np.uint64)
    if n == 0:
        return fwd
    for i in range(k):
        c = code[i : i + n].astype(np.uint64) & np.uint64(3)
        fwd = (fwd << np.uint64(2)) | c
        rev |= (np.uint64(3) - c) << np.uint64(2 * i)
    return np.minimum(fwd, rev)


def sliding_minimum(values: list[int], width: int) -> list[int]:
    """Index of the tracked minimum of every window: leftmost in the first, kept until it leaves or a strictly smaller value
    comes; after it left, the rightmost minimum of the window."""
    out = []
    at = -1
    for i in range(width - 1, len(values)):
        low = i - width + 1
        if at < 0:
            at = min(range(low, i + 1), key=lambda j: (values[j], j))
        elif at < low:
            at = min(range(low, i + 1), key=lambda j: (values[j], -j))
        elif values[i] < values[at]:
            at = i
        out.append(at)
    return out


def tracked_minima(values: np.ndarray, owner: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The windows of `width` values inside one owner, by their starts, and for each the index that `sliding_minimum` tracks.

    Where a window has one minimum, that is it.  Otherwise the choice hangs on the windows before, back to one without a tie, and
    only such stretches are walked.
    """
    n = len(values) - width + 1
    if n < 1:
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
    start = np.flatnonzero(owner[:n] == owner[width - 1 :])
    least = values[start].copy()
    left, right = np.zeros(len(start), dtype=np.int64), np.zeros(len(start), dtype=np.int64)
    for o in range(1, width):
        v = values[start + o]
        left[v < least] = o
        right[v <= least] = o
        np.minimum(least, v, out=least)
    at = start + left
    first = np.append(True, (start[1:] != start[:-1] + 1) | (owner[start[1:]] != owner[start[:-1]])) if len(start) else np.empty(0, dtype=bool)
    for i in np.flatnonzero((left != right) & ~first).tolist():
        at[i] = at[i - 1] if at[i - 1] >= start[i] else start[i] + right[i]
    return start, at


def syncmers(data: np.ndarray, at: np.ndarray, l: int, s: int, density: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sequence number, start in it and hash of the open syncmers: the smallest canonical s-mer of the l-mer sits in its middle, and the
    l-mer's hash is kept by the density.  Letters outside ACGT cut the sequence; s = 0 keeps by density alone."""
    if not 0 <= s < l <= 31:
        raise ValueError("0 <= s < l <= 31 is needed")
    code = _CODE[data]
    # pieces of clear letters inside one sequence
    doc = np.repeat(np.arange(len(at) - 1), np.diff(at))
    clear = np.flatnonzero(code < 4)
    code, doc = code[clear], doc[clear]
    piece = np.cumsum(np.append(0, (np.diff(clear) > 1) | (np.diff(doc) > 0))) if len(clear) else np.empty(0, dtype=np.int64)
    n = max(0, len(code) - l + 1)
    start = np.flatnonzero(piece[:n] == piece[l - 1 :]) if n else np.empty(0, dtype=np.int64)
    whole = mix_masked(two_bit(code, l), 4**l - 1)[start]
    kept = whole <= np.uint64(int(density * float(4**l)))
    if s and len(start):
        windows, low = tracked_minima(mix_masked(two_bit(code, s), 4**s - 1), piece[: len(code) - s + 1], l - s + 1)
        # windows over s-mers of two pieces are none: an l-mer's own windows are looked up by its start
        kept &= low[np.searchsorted(windows, start)] == start + -(-(l - s + 1) // 2) - 1
    start, whole = start[kept], whole[kept]
    return doc[start], clear[start] - at[doc[start]], whole.astype(np.int64)
