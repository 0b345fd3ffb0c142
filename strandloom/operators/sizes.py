"""Numbers of nodes, links and maximal paths of the overlap graph, without a row for each window, link or path.

Windows, then ends of nodes, travel packed: one row holds all that a batch sends to one piece.  At a (k-1)-mer links are counted by side,
weak ones by rank of abundance, and a single link left is known by exclusive or (`junctions`).  With only such links kept, a graph has as
many paths as nodes less links, and one more for each circle.  Definitions are those of `graph.edges` and `graph.unitigs`.

In `graph.edges`, two nodes that meet in m ways and are linked in w have m * w rows, of which each end that they meet by counts its part.  m is
more than 1 for a node and itself, and where a node has one (k-1)-mer at both ends (a twin; a (k-1)-mer has a few at most).  Two nodes that share
both of two different (k-1)-mers are one node: read so that one of them comes first, the windows could differ only where both have period two,
and then the two are one or each its own mirror image.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.operators import graph
from strandloom.session import tasks, written

#: Pieces of a task, which are worked on one after the other.
PIECES = 16
#: Elements of lists whose windows are made at once (a longer list is taken by itself).
AT_ONCE = 2_000_000
#: Links among which one task looks for circles.
TOGETHER = 2_000_000
#: Kinds of rows: numbers of nodes and of links (a), single links left between two ends (a, b).
NODES, LINKS, STEP = range(3)

WINDOW = (("xa", "<u8"), ("ya", "<u8"), ("xb", "<u4"), ("yb", "<u4"), ("flag", "u1"), ("n", "<u4"))
#: flag of a window: whether its first and last (k-1)-mer (x, y) are reversed or palindromes.
X_REV, Y_REV, X_PAL, Y_PAL = 1, 2, 4, 8
#: ref: twice the node's number, and 1 at its first end.
ENDS = (("ka", "<u8"), ("kb", "<u4"), ("ref", "<i8"), ("ab", "<i8"), ("flag", "u1"))
#: flag of an end: whether it is left of its key, that is a palindrome, the node's both are one, the other one is a palindrome.
LEFT, PAL, TWIN, OTHER_PAL = 1, 2, 4, 8


def _mix(h: np.ndarray, v: np.ndarray) -> np.ndarray:
    h = (h ^ v) * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def _packed(columns: dict[str, np.ndarray], kinds: tuple) -> bytes:
    # byte by byte, so that bytes which are zero in most rows lie together and compress
    return b"".join(np.ascontiguousarray(columns[c], dtype=kind).view(np.uint8).reshape(-1, np.dtype(kind).itemsize).T.tobytes() for c, kind in kinds)


def _unpacked(blobs: list[bytes], kinds: tuple) -> dict[str, np.ndarray]:
    width = sum(np.dtype(kind).itemsize for _, kind in kinds)
    out: dict[str, list[np.ndarray]] = {c: [] for c, _ in kinds}
    for blob in blobs:
        n, at = len(blob) // width, 0
        for c, kind in kinds:
            size = np.dtype(kind).itemsize
            out[c].append(np.ascontiguousarray(np.frombuffer(blob, dtype=np.uint8, count=n * size, offset=at).reshape(size, n).T).view(kind).reshape(-1))
            at += n * size
    return {c: np.concatenate(x) if x else np.empty(0, dtype=kind) for (c, kind), x in zip(kinds, out.values())}


def _pieces(columns: dict[str, np.ndarray], kinds: tuple, by: np.ndarray, n: int) -> tuple[list[int], list[bytes]]:
    """Packs of the rows, which are sorted by the 64-bit numbers `by`, for each of n pieces that they fall into."""
    cuts = np.searchsorted(by, np.array([(i << 64) // n & ~15 for i in range(1, n)], dtype=np.uint64))  # the last bits are a window's flag
    at = [0, *cuts.tolist(), len(by)]
    there = [i for i in range(n) if at[i + 1] > at[i]]
    return there, [_packed({c: x[at[i] : at[i + 1]] for c, x in columns.items()}, kinds) for i in there]


def _by_piece(rows: DataFrame, n_tasks: int, run: Callable[[int, dict[int, list[bytes]]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """What `run` makes of each piece and its packs by kind, of rows (piece, kind, pack)."""

    def every(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, {}
        for batch in batches:
            for piece, kind, pack in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                if piece != now:
                    if now is not None:
                        yield from run(now, held)
                    now, held = piece, {}
                held.setdefault(kind, []).append(pack)
        if now is not None:
            yield from run(now, held)

    # repartition by id takes the remainder, so a task's pieces are every n_tasks-th
    return rows.repartitionById(n_tasks, F.col("piece")).sortWithinPartitions("piece").mapInArrow(every, schema)


def _packs(pieces: list[int], kind: int, packs: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(pieces, pa.int32()), pa.array([kind] * len(pieces), pa.int32()), pa.array(packs, pa.binary())], names=["piece", "kind", "pack"])


def _rows(kind: int, *columns: np.ndarray) -> pa.RecordBatch:
    n = len(columns[0])
    values = [pa.array(np.asarray(x, dtype=np.int64)) for x in columns] + [pa.nulls(n, pa.int64())] * (2 - len(columns))
    return pa.RecordBatch.from_arrays([pa.array(np.full(n, kind, dtype=np.int32)), *values], names=["kind", "a", "b"])


def _runs(*columns: np.ndarray) -> np.ndarray:
    """Where rows begin that differ from the one before."""
    if not len(columns[0]):
        return np.empty(0, dtype=np.int64)
    new = np.zeros(len(columns[0]) - 1, dtype=bool)
    for x in columns:
        new |= x[1:] != x[:-1]
    return np.flatnonzero(np.append(True, new))


def _counted(w: dict[str, np.ndarray]) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """Each window once, with the sum of its n; and the numbers that they are sorted by, those with the same two keys together."""
    seed = np.full(len(w["xa"]), 7, dtype=np.uint64)
    h = _mix(_mix(_mix(seed, w["xa"]), w["ya"]), w["xb"].astype(np.uint64) << np.uint64(32) | w["yb"].astype(np.uint64))
    h = (h & ~np.uint64(15)) | w["flag"].astype(np.uint64)
    names = ("xa", "ya", "xb", "yb")
    order = np.argsort(h, kind="stable")
    s = {c: x[order] for c, x in w.items()}
    h = h[order]
    first = _runs(h, *[s[c] for c in names])
    if len(first) != len(_runs(h)) or len(_runs(h >> np.uint64(4))) != len(_runs(h >> np.uint64(4), *[s[c] for c in names])):
        order = np.lexsort((s["flag"], s["yb"], s["xb"], s["ya"], s["xa"], h >> np.uint64(4)))
        s, h = {c: x[order] for c, x in s.items()}, h[order]
        first = _runs(h, *[s[c] for c in names])
    n = np.add.reduceat(s["n"].astype(np.int64), first) if len(first) else np.empty(0, dtype=np.int64)
    return {c: x[first] for c, x in s.items()} | {"n": n}, h[first]


def _windows(minims: pa.Array, k: int) -> dict[str, np.ndarray]:
    """Every window of the lists: its (k-1)-mers by 96 bits, as read in the direction in which the first has the smaller bits."""
    at = np.concatenate([[0], np.cumsum(pc.list_value_length(minims).to_numpy(zero_copy_only=False), dtype=np.int64)])
    values = minims.flatten().fill_null(-1).to_numpy(zero_copy_only=False).view(np.uint64)
    short = k - 1
    n = max(len(values) - short + 1, 0)

    def folded(steps: range, seed: int) -> np.ndarray:
        h = np.full(n, seed, dtype=np.uint64)
        for j in steps:
            h = _mix(h, values[j : j + n])
        return h

    ahead, back = range(short), range(short - 1, -1, -1)
    a, other = folded(ahead, 1), folded(back, 1)
    rev = other < a
    pal = np.ones(n, dtype=bool)
    for j in range(short // 2):
        pal &= values[j : j + n] == values[short - 1 - j : short - 1 - j + n]
    b = np.where(rev, folded(back, 2), folded(ahead, 2)).astype(np.uint32)
    a = np.minimum(a, other)
    per = np.maximum(np.diff(at) - k + 1, 0)
    i = np.repeat(at[:-1] - np.concatenate([[0], np.cumsum(per)[:-1]]), per) + np.arange(per.sum())
    first, last = i, i + 1
    flags = lambda x, y, turned: (rev[x] ^ (turned & ~pal[x])) * X_REV + (rev[y] ^ (turned & ~pal[y])) * Y_REV + pal[x] * X_PAL + pal[y] * Y_PAL
    own, turned = flags(first, last, False), flags(last, first, True)
    less = (a[last] < a[first]) | ((a[last] == a[first]) & ((b[last] < b[first]) | ((b[last] == b[first]) & (turned < own))))
    x, y = np.where(less, last, first), np.where(less, first, last)
    return {"xa": a[x], "ya": a[y], "xb": b[x], "yb": b[y], "flag": np.where(less, turned, own).astype(np.uint8), "n": np.ones(len(i), dtype=np.uint32)}


def _nodes(piece: int, w: dict[str, np.ndarray], min_abundance: int, n_pieces: int) -> Iterator[pa.RecordBatch]:
    """Packs (0) of the ends of a piece's nodes, and one (1) of their number and that of the rows that nodes linked to themselves have twice."""
    w, _ = _counted(w)
    keep = w["n"] >= min_abundance
    w = {c: x[keep] for c, x in w.items()}
    flag, ab, n = w["flag"], w["n"], int(keep.sum())
    if not n:
        return
    twin = (w["xa"] == w["ya"]) & (w["xb"] == w["yb"])
    x_pal, y_pal = (flag & X_PAL) > 0, (flag & Y_PAL) > 0
    yield _packs([piece], 1, [np.array([n, int((x_pal & ~twin).sum() + (y_pal & ~twin).sum())], dtype="<i8").tobytes()])
    ref = (piece << 40) + 2 * np.arange(n)
    last = ((flag & Y_REV) == 0) * LEFT + y_pal * PAL + (x_pal & ~twin) * OTHER_PAL
    first = ((flag & X_REV) > 0) * LEFT + x_pal * PAL + (y_pal & ~twin) * OTHER_PAL
    ends = {
        "ka": np.concatenate([w["ya"], w["xa"]]), "kb": np.concatenate([w["yb"], w["xb"]]), "ref": np.concatenate([ref, ref + 1]), "ab": np.concatenate([ab, ab]),
        "flag": np.concatenate([last, first]) + np.tile(twin * TWIN, 2),
    }
    order = np.argsort(ends["ka"])
    ends = {c: x[order] for c, x in ends.items()}
    pieces, packs = _pieces(ends, ENDS, ends["ka"], n_pieces)
    yield _packs(pieces, 0, packs)


def _left_over(e: dict[str, np.ndarray], presimp: float) -> Iterator[pa.RecordBatch]:
    """LINKS and STEP of a piece's ends."""
    order = np.lexsort((e["kb"], e["ka"]))
    e = {c: x[order] for c, x in e.items()}
    n = len(order)
    first = _runs(e["ka"], e["kb"])
    group = np.repeat(np.arange(len(first)), np.diff(np.append(first, n)))
    ref, ab = e["ref"], e["ab"]
    left, pal, twin = (e["flag"] & LEFT) > 0, (e["flag"] & PAL) > 0, (e["flag"] & TWIN) > 0
    # ends of one side of a key, and the side across
    side = 2 * group + (left & ~pal)
    across = np.where(pal, side, side ^ 1)
    n_sides = 2 * len(first)
    size = np.bincount(side, minlength=n_sides)
    most = np.zeros(n_sides, dtype=np.int64)
    np.maximum.at(most, side, ab)
    # an end also counts the node's link with itself at the other one
    self_too = (e["flag"] & OTHER_PAL) > 0
    rows, high = size[across] + self_too, np.maximum(most[across], np.where(self_too, ab, 0))
    double = _twins(np.flatnonzero(twin), group, first, n, ref)
    link = lambda p, q: pal[p] | (left[p] != left[q])
    for s, p, alone, others in double:
        # the twin's row is found by both of its ends, as is each linked one by each end of the other
        for x, y in ((s, p), (p, s)):
            there = alone[link(y, alone)]
            rows[x] += len(there)
            high[x] = max(high[x], ab[there].max(initial=0))
        ways = link(s, alone).astype(np.int64) + link(p, alone)
        rows[alone] += ways
        high[alone] = np.maximum(high[alone], np.where(ways > 0, ab[s], 0))
        for u, v in others:
            ways = sum(int(link(x, y)) for x in (s, p) for y in (u, v))
            for x in (s, p):
                rows[x] += 2 * ways - int(link(x, u)) - int(link(x, v))
                high[x] = max(high[x], ab[u] if ways else 0)
    ab32 = ab.astype(np.float32)
    limit = np.where(rows >= 2, np.float32(presimp) * np.minimum(high, ab).astype(np.float32), np.float32(-1)).astype(np.float32)
    values = np.unique(ab32)
    rank, above = np.searchsorted(values, ab32), np.searchsorted(values, limit)  # ab32 < limit where rank < above
    width = len(values) + 1
    start = np.searchsorted(np.sort(side), np.arange(n_sides + 1))

    def ordered(by: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = side * width + by
        o = np.argsort(key, kind="stable")
        return key[o], np.append(0, np.bitwise_xor.accumulate(ref[o]))

    by_rank, xor_rank = ordered(rank)
    by_above, xor_above = ordered(above)
    begin, end = start[across], start[across + 1]
    weak = np.searchsorted(by_rank, across * width + above)
    strong = np.searchsorted(by_above, across * width + rank, side="right")
    deg = (end - begin) - (weak - begin) - (end - strong)
    only = (xor_rank[end] ^ xor_rank[begin]) ^ (xor_rank[weak] ^ xor_rank[begin]) ^ (xor_above[end] ^ xor_above[strong])
    links = int(deg.sum())
    gone = lambda p, q: (ab32[q] < limit[p]) | (ab32[p] < limit[q])

    def cut(x: int, y: np.ndarray) -> None:
        deg[x] -= len(y)
        only[x] ^= np.bitwise_xor.reduce(ref[y], initial=0)
        deg[y] -= 1
        only[y] ^= ref[x]

    for s, p, alone, others in double:
        out = gone(s, alone) | gone(p, alone)
        for x in (s, p):
            here = link(x, alone)
            links += 2 * int((2 * (here & ~out)).sum() - (here & ~gone(x, alone)).sum())
            cut(x, alone[here & out & ~gone(x, alone)])
        for u, v in others:
            out = any(gone(x, y) for x in (s, p) for y in (u, v))
            for x in (s, p):
                for y in (u, v):
                    if link(x, y):
                        links += (0 if out else 4) - (0 if gone(x, y) else 1)
                        if out and not gone(x, y) and ref[s] < ref[u]:
                            cut(x, np.array([y]))
    yield _rows(LINKS, [links])
    one = (deg == 1) & (ref >> 1 != only >> 1)
    ref, only = ref[one], only[one]
    both = np.isin(only, ref) & (ref < only)
    yield _rows(STEP, ref[both], only[both])


def _twins(at: np.ndarray, group: np.ndarray, first: np.ndarray, n: int, ref: np.ndarray) -> list[tuple]:
    """Of each node with both of its ends at one key: the ends, those of other nodes with one end there, and the pairs of ends of nodes like it,
    itself included."""
    out = []
    bounds = np.append(first, n)
    own = group[at]
    for g in np.unique(own):
        here = at[np.searchsorted(own, g) : np.searchsorted(own, g, side="right")]
        here = here[np.argsort(ref[here])]
        pairs = list(zip(here[::2].tolist(), here[1::2].tolist()))
        alone = np.setdiff1d(np.arange(bounds[g], bounds[g + 1]), here)
        out += [(s, p, alone, pairs) for s, p in pairs]
    return out


def _circles(a: np.ndarray, b: np.ndarray) -> int:
    """Number of circles of links between ends, of which each end has one."""
    ends, across = np.concatenate([a, b]), np.concatenate([b, a])
    order = np.argsort(ends)
    ends, across = ends[order], across[order]
    # a link leads from an end to the other end of the node that it reaches
    to = across ^ 1
    i = np.minimum(np.searchsorted(ends, to), max(len(ends) - 1, 0))
    at = np.where(ends[i] == to, i, -1) if len(ends) else i
    step = at
    for _ in range(int(len(ends)).bit_length() + 1):
        at = np.where(at >= 0, at[at], -1)
    left = np.flatnonzero(at >= 0)
    if not len(left):
        return 0
    at, low = np.searchsorted(left, step[left]), np.arange(len(left))
    for _ in range(int(len(left)).bit_length() + 1):
        low, at = np.minimum(low, low[at]), at[at]
    return len(np.unique(low)) // 2


def _number_of_circles(steps: DataFrame, n: int) -> int:
    """Circles of n links (a, b)."""
    if n > TOGETHER:
        first = steps.select("a", "b").union(steps.select(F.col("b").alias("a"), F.col("a").alias("b"))).select(F.col("a").alias("v"), F.col("b").bitwiseXOR(F.lit(1)).alias("at"))
        on, seen = written(first), 2 * n
        while seen > TOGETHER:
            # what has come to a path's end finds nothing; each path loses some in each round, circles nothing
            on = written(on.join(on.select(F.col("v").alias("at"), F.col("at").alias("next")), "at").select("v", F.col("next").alias("at")), instead_of=on)
            last, seen = seen, on.count()
            if seen == last:
                break
        v = on.select("v")
        steps = written(steps.join(v.withColumnRenamed("v", "a"), "a", "left_semi").join(v.withColumnRenamed("v", "b"), "b", "left_semi").select("a", "b"))
        if seen > TOGETHER:
            return graph.components(steps.select(F.shiftright("a", 1).alias("n1"), F.shiftright("b", 1).alias("n2"))).select("component").distinct().count()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        a, b = ([x.column(c).to_numpy() for x in held] for c in (0, 1))
        yield pa.RecordBatch.from_arrays([pa.array([_circles(np.concatenate(a), np.concatenate(b)) if held else 0], pa.int64())], names=["n"])

    return steps.select("a", "b").repartition(1).mapInArrow(run, "n bigint").agg(F.sum("n")).first()[0] or 0


def of_lists(lists: DataFrame, k: int, min_abundance: int, strict: bool, presimp: float) -> dict[str, int]:
    """nodes, edges, paths: what `kminmers.nodes`, `graph.edges` and `graph.unitigs` of lists (read_id, minims) would list, as numbers."""
    if presimp >= 1:
        raise ValueError("presimp < 1 is needed")
    size = F.size("minims")
    n_tasks = tasks(lists.sparkSession)
    n_pieces = n_tasks * PIECES

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            upto = np.cumsum(pc.list_value_length(batch.column(0)).to_numpy(zero_copy_only=False))
            cuts = [0, *(np.flatnonzero(upto[1:] // AT_ONCE > upto[:-1] // AT_ONCE) + 1).tolist(), len(upto)]
            for i, j in zip(cuts, cuts[1:]):
                w, h = _counted(_windows(batch.column(0).slice(i, j - i), k))
                pieces, packs = _pieces(w, WINDOW, h, n_pieces)
                yield _packs(pieces, 0, packs)

    def nodes(piece: int, packs: dict[int, list[bytes]]) -> Iterator[pa.RecordBatch]:
        yield from _nodes(piece, _unpacked(packs[0], WINDOW), min_abundance, n_pieces)

    def left_over(piece: int, packs: dict[int, list[bytes]]) -> Iterator[pa.RecordBatch]:
        for pack in packs.get(1, []):
            for kind, number in zip((NODES, LINKS), np.frombuffer(pack, dtype="<i8")):
                yield _rows(kind, [number])
        if 0 in packs:
            yield from _left_over(_unpacked(packs[0], ENDS), presimp)

    kept = lists.where((size > k if strict else size >= k) & F.col("read_id").isNotNull()).select("minims")
    packed = "piece int, kind int, pack binary"
    ends = _by_piece(kept.mapInArrow(windows, packed), n_tasks, nodes, packed)
    found = written(_by_piece(ends, n_tasks, left_over, "kind int, a bigint, b bigint"))
    own = lambda kind: F.col("kind") == kind
    one = found.agg(*[F.coalesce(F.sum(F.when(own(kind), F.col("a"))), F.lit(0)) for kind in (NODES, LINKS)], F.count_if(own(STEP))).first()
    n_nodes, n_links, n_steps = one
    return {"nodes": n_nodes, "edges": n_links, "paths": n_nodes - n_steps + _number_of_circles(found.where(own(STEP)), n_steps)}
