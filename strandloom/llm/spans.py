"""Long spans shared between records: seeds of k consecutive elements, collinear chains, aligned passages.

1. Every record's windows of k elements, in canonical direction, become 96-bit seeds (equal windows of one record once).
2. For every seed the smallest and the largest record that hold it are found with a partial aggregate; a seed is shared if they
   differ.  A record's partner at a seed is the smallest holder (the largest for that one itself), so links grow with the seeds
   and never with the pairs of holders, and neighbouring seeds of a copied stretch agree on their partner.
3. Each record chains its seeds with every partner: matched blocks in order, gap costs, a Fenwick tree for the best predecessor.
4. A record's covered stretches are the union of its chained seeds.

Passages are a search: a stated set of records, against all others, with every occurrence of a window and not one partner a seed:

1. Records with equal lists form a class; classes are searched, and each record has a row that names its class.
2. Two holders of a window give a row only where their common stretch begins or ends, as told by the elements beside the window; so
   rows grow with the stretches of all pairs and not with their windows.
3. Windows of one element only would pair most records with most others.  They are not paired: a run of such windows is a class row
   (`run`), and any two rows of a class share just the shorter one.  Pairs with another stretch, or with two runs, in common get the
   blocks of their runs back before chaining.
4. The blocks of each pair are chained and aligned; each passage is written once, as the searched record sees it.

Records whose list is null, shorter than k, or that have no id share nothing.  A null inside a list equals only a null.
"""

from __future__ import annotations

import math
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandloom.llm.heavy import mix
from strandloom.operators.balance import balanced_join
from strandloom.session import saved

NULL_ELEMENT = np.uint64(0x6A09E667F3BCC909)
FACTOR = 0x9E3779B97F4A7C15
#: Matched blocks of a chain: start in the record, (mirrored) start in the partner, elements.
BLOCKS = pa.list_(pa.struct([("at", pa.int32()), ("by", pa.int32()), ("n", pa.int32())]))


def window_seeds(values: np.ndarray, at: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start, two hashes and direction of each window of k elements inside the lists values[at[i]:at[i+1]]."""
    n = len(values)
    if n < k:
        z = np.empty(0, dtype=np.int64)
        return z, z.astype(np.uint64), z.astype(np.uint64), z.astype(bool)
    size = np.diff(at)
    doc_end = np.repeat(at[1:], size)
    start = np.flatnonzero(np.arange(n) + k <= doc_end)
    a, b = mix(values), mix(values + np.uint64(FACTOR))
    sums = []
    for x in (a, b):
        fwd, rev = np.zeros(n - k + 1, dtype=np.uint64), np.zeros(n - k + 1, dtype=np.uint64)
        for i in range(k):
            w = np.uint64(pow(FACTOR, i + 1, 1 << 64))
            fwd += w * x[i : n - k + 1 + i]
            rev += w * x[k - 1 - i : n - i]
        sums += [mix(fwd)[start], mix(rev)[start]]
    f1, r1, f2, r2 = sums
    back = (r1 < f1) | ((r1 == f1) & (r2 < f2))
    return start, np.where(back, r1, f1), np.where(back, r2, f2), back


def list_values(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Elements of a list column, with a fixed value for nulls inside, and the lists' bounds."""
    col = col.cast(pa.large_list(pa.int64()))
    at = col.offsets.to_numpy()
    flat = col.values.slice(at[0], at[-1] - at[0])
    values = flat.fill_null(0).to_numpy(zero_copy_only=False).view(np.uint64)
    return np.where(flat.is_null().to_numpy(zero_copy_only=False), NULL_ELEMENT, values), at - at[0]


def _seeds(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(0)
            values, at = list_values(batch.column(2))
            start, h1, h2, back = window_seeds(values, at, k)
            doc = np.searchsorted(at, start, side="right") - 1
            # equal windows of one record once: the first of them
            order = np.lexsort((start, h1, doc))
            d, h = doc[order], h1[order]
            one = np.sort(order[np.append(True, (d[1:] != d[:-1]) | (h[1:] != h[:-1]))]) if len(order) else order
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(h1[one].view(np.int64)), pa.array((h2[one] >> np.uint64(32)).astype(np.uint32).view(np.int32)),
                    keys.take(pa.array(doc[one])), pa.array(((start[one] - at[doc[one]]) * 2 + back[one]).astype(np.int32)),
                ],
                names=["h1", "h2", "rec", "place"],
            )

    return run


def chain_blocks(i: list[int], j: list[int], n: list[int], gap_cost: float) -> list[list[int]]:
    """Chains of matched blocks (i, j, length) that increase in both coordinates.

    Best predecessor: maximum of score + gap_cost * (end_i + end_j) over blocks that end before this one in both, from a
    Fenwick tree over the second coordinate; blocks enter the tree in order of their end in the first.  Every block ends up in one
    chain, taken from the best end downwards.
    """
    m = len(i)
    si, ei, sj, ej, size = i, [x + y for x, y in zip(i, n)], j, [x + y for x, y in zip(j, n)], n
    ends = sorted(set(ej))
    tree = [(-math.inf, -1)] * (len(ends) + 1)
    # few blocks make most chains, so plain lists are quicker than arrays here
    slot = {e: x for x, e in enumerate(ends, 1)}
    order = sorted(range(m), key=[*zip(si, sj)].__getitem__)
    closing = sorted(range(m), key=[*zip(ei, sj)].__getitem__)
    score, before = [0.0] * m, [-1] * m
    c = 0
    for x in order:
        while c < m and ei[closing[c]] <= si[x]:
            y = closing[c]
            entry = (score[y] + gap_cost * (ei[y] + ej[y]), y)
            s = slot[ej[y]]
            while s <= len(ends):
                if entry > tree[s]:
                    tree[s] = entry
                s += s & -s
            c += 1
        best = (-math.inf, -1)
        s = bisect_right(ends, sj[x])
        while s > 0:
            if tree[s] > best:
                best = tree[s]
            s -= s & -s
        gain = best[0] - gap_cost * (si[x] + sj[x])
        score[x] = size[x] + max(0.0, gain)
        before[x] = best[1] if gain > 0 else -1
    chains, used = [], [False] * m
    for x in sorted(range(m), key=score.__getitem__, reverse=True):
        chain = []
        while x >= 0 and not used[x]:
            used[x] = True
            chain.append(x)
            x = before[x]
        if chain:
            chains.append(chain[::-1])
    return chains


def matched_blocks(i: np.ndarray, j: np.ndarray, group: np.ndarray, step: np.ndarray, k: int):
    """Seeds that follow one another on a diagonal become one block: rows (group, i, j, length in elements).

    `step` is +1 for a partner in the same direction, -1 for a reversed one; j of reversed partners is mirrored, so that both
    coordinates increase along a chain.
    """
    jj = j * step
    diag = jj - i
    order = np.lexsort((i, diag, group))
    g, a, b, d = group[order], i[order], jj[order], diag[order]
    new = np.append(True, (g[1:] != g[:-1]) | (d[1:] != d[:-1]) | (a[1:] > a[:-1] + 1))
    first = np.flatnonzero(new)
    length = np.diff(np.append(first, len(a))) + k - 1
    return g[first], a[first], b[first], length


def _chain(k: int, gap_cost: float):
    """Arrow kernel over one row a record: its seeds as arrays -> chains (rec, partner, back, i0, i1, j0, j1, matched, covered)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            recs, links = batch.column(0), batch.column(1)
            at = links.offsets.to_numpy()
            seeds = links.values.slice(at[0], at[-1] - at[0])
            at = at - at[0]
            place, partner, other = (seeds.field(c).to_numpy(zero_copy_only=False) for c in range(3))
            row = np.repeat(np.arange(len(recs)), np.diff(at))
            back = (place ^ other) & 1
            i, j = (place >> 1).astype(np.int64), (other >> 1).astype(np.int64)
            order = np.lexsort((back, partner, row))
            r, p, b = row[order], partner[order], back[order]
            new = np.append(True, (r[1:] != r[:-1]) | (p[1:] != p[:-1]) | (b[1:] != b[:-1])) if len(r) else np.empty(0, dtype=bool)
            group = np.empty(len(r), dtype=np.int64)
            group[order] = np.cumsum(new) - 1
            head = order[np.flatnonzero(new)]
            g, a, c, n = matched_blocks(i, j, group, np.where(back == 1, -1, 1), k) if len(r) else (np.empty(0, dtype=np.int64),) * 4
            bounds = np.append(np.flatnonzero(np.append(True, g[1:] != g[:-1])), len(g)) if len(g) else np.zeros(1, dtype=np.int64)
            out = []
            for s, e in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
                h = head[g[s]]
                for chain in [[0]] if e - s == 1 else chain_blocks(a[s:e].tolist(), c[s:e].tolist(), n[s:e].tolist(), gap_cost):
                    blocks = [(int(a[s + x]), int(c[s + x]), int(n[s + x])) for x in chain]
                    last = s + chain[-1]
                    j0, j1 = int(c[s + chain[0]]), int(c[last] + n[last])
                    if back[h]:
                        # mirrored starts: the reversed stretch ends k after its first start and begins at its last
                        j0, j1 = int(k - n[last] - c[last]), int(k - c[s + chain[0]])
                    out.append((int(row[h]), int(partner[h]), bool(back[h]), blocks[0][0], int(a[last] + n[last]), j0, j1, sum(x[2] for x in blocks), blocks))
            cols = [*zip(*out)] or [[]] * 9
            yield pa.RecordBatch.from_arrays(
                [
                    recs.take(pa.array(cols[0], pa.int64())), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.bool_()),
                    *[pa.array(x, pa.int32()) for x in cols[3:8]],
                    pa.array([[{"at": u, "by": v, "n": m} for u, v, m in x] for x in cols[8]], BLOCKS),
                ],
                names=["rec", "partner", "back", "i0", "i1", "j0", "j1", "matched", "blocks"],
            )

    return run


def records_once(df: DataFrame, id_col: str, list_col: str, *more: str) -> DataFrame:
    """rec bigint, id, list and further columns, one row for each id; all rows of one id with a list must hold the same.

    `rec` is a 64-bit hash of the id; should two ids ever share one, the query fails rather than mix them up.
    """
    some = df.where(F.col(id_col).isNotNull() & F.col(list_col).isNotNull())
    named = some.select(F.xxhash64(id_col).alias("rec"), F.col(id_col).alias("id"), F.col(list_col).alias("list"), *more)
    once = named.groupBy("rec").agg(F.min("id").alias("id"), F.max("id").alias("id2"), F.first("list").alias("list"), *[F.first(c).alias(c) for c in more])
    same = F.when(F.col("id") == F.col("id2"), F.col("id")).otherwise(F.raise_error(F.lit("two ids have one hash")).cast("string"))
    return once.select("rec", same.alias("id"), "list", *more)


def seed_links(records: DataFrame, k: int) -> DataFrame:
    """rec, place, partner, other: each shared seed of each record with the place of the same seed in its partner.

    A place is twice the window's start, plus one if the canonical direction is backwards.  The whole record goes into the
    kernel so that all readers of `records` share its one shuffle.
    """
    seeds = records.mapInArrow(_seeds(k), "h1 bigint, h2 int, rec bigint, place int")
    ends = seeds.groupBy("h1", "h2").agg(F.min(F.struct("rec", "place")).alias("low"), F.max(F.struct("rec", "place")).alias("high"))
    shared = ends.where(F.col("low.rec") != F.col("high.rec"))
    partner = F.when(F.col("rec") == F.col("low.rec"), F.col("high")).otherwise(F.col("low"))
    # a seed that many records hold makes a large partition here, which adaptive execution splits: the other side has one row a seed
    return seeds.join(shared.hint("merge"), ["h1", "h2"]).select("rec", "place", partner["rec"].alias("partner"), partner["place"].alias("other"))


def shared_chains(records: DataFrame, k: int = 8, gap_cost: float = 0.1) -> DataFrame:
    """rec, partner, back, i0, i1, j0, j1, matched, blocks: collinear chains; [i0, i1) and [j0, j1) are list positions.

    Only the first of equal windows of a record enters; `shared_stretches` adds the others.
    """
    grouped = seed_links(records, k).groupBy("rec").agg(F.collect_list(F.struct("place", "partner", "other")).alias("links"))  # bounded by the record's length
    return grouped.mapInArrow(
        _chain(k, gap_cost),
        "rec bigint, partner bigint, back boolean, i0 int, i1 int, j0 int, j1 int, matched int, blocks array<struct<at:int,by:int,n:int>>",
    )


def one_element_runs(values: np.ndarray, at: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Record, start and length of the maximal runs of one element, at least k long, inside the lists values[at[i]:at[i+1]]."""
    owner = np.repeat(np.arange(len(at) - 1), np.diff(at))
    first = np.flatnonzero(np.append(True, (values[1:] != values[:-1]) | (owner[1:] != owner[:-1]))) if len(values) else np.empty(0, dtype=np.int64)
    size = np.diff(np.append(first, len(values)))
    long = size >= k
    return owner[first[long]], first[long], size[long]


def _flanked(k: int):
    """Arrow kernel: (rec, id, list) -> every window of more than one element, with its canonical direction (a palindrome has both)
    and the elements before and behind it in that direction; null where the list, or the stretch of such windows, ends."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values, at = list_values(batch.column(2))
            start, h1, h2, back = window_seeds(values, at, k)
            _, run_at, size = one_element_runs(values, at, k)
            flat = np.zeros(len(values) + 1, dtype=np.int64)
            np.add.at(flat, run_at, 1)
            np.add.at(flat, run_at + size - k + 1, -1)
            flat = np.cumsum(flat) > 0
            mirror = np.array([np.array_equal(values[x : x + k], values[x : x + k][::-1]) for x in start[values[start] == values[start + k - 1]].tolist()], dtype=bool)
            palindrome = np.zeros(len(start), dtype=bool)
            palindrome[values[start] == values[start + k - 1]] = mirror
            keep = ~flat[start]
            start, h1, h2, back, palindrome = (x[keep] for x in (start, h1, h2, back, palindrome))
            twice = np.flatnonzero(palindrome)
            pick = np.append(np.arange(len(start)), twice)
            back = np.append(back & ~palindrome, np.ones(len(twice), dtype=bool))
            start, h1, h2, palindrome = start[pick], h1[pick], h2[pick], palindrome[pick]
            doc = np.searchsorted(at, start, side="right") - 1
            has_left, has_right = (start > at[doc]), (start + k < at[doc + 1])
            has_left &= ~flat[np.maximum(start - 1, 0)]
            has_right &= ~flat[start + 1]
            v = values.view(np.int64)
            left, right = v[np.maximum(start - 1, 0)], v[np.minimum(start + k, len(v) - 1)]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(h1.view(np.int64)), pa.array((h2 >> np.uint64(32)).astype(np.uint32).view(np.int32)), batch.column(0).take(pa.array(doc)),
                    pa.array((start - at[doc]).astype(np.int32)), pa.array(back), pa.array(palindrome),
                    pa.array(np.where(back, right, left), mask=~np.where(back, has_right, has_left)),
                    pa.array(np.where(back, left, right), mask=~np.where(back, has_left, has_right)),
                ],
                names=["h1", "h2", "rec", "at", "turned", "both", "prev", "next"],
            )

    return run


def _runs(k: int):
    """Arrow kernel: (rec, id, list) -> rec and its runs of one element, of records that have any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values, at = list_values(batch.column(2))
            doc, start, size = one_element_runs(values, at, k)
            some, first = np.unique(doc, return_index=True)
            items = pa.StructArray.from_arrays(
                [pa.array(values.view(np.int64)[start]), pa.array((start - at[doc]).astype(np.int32)), pa.array(size.astype(np.int32))], names=["run", "at", "n"]
            )
            lists = pa.ListArray.from_arrays(pa.array(np.append(first, len(doc)).astype(np.int32)), items)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(some)), lists], names=["rec", "runs"])

    return run


def run_blocks(own: list[tuple[int, int, int]], theirs: list[tuple[int, int, int]], k: int) -> set[tuple[bool, int, int, int]]:
    """(back, diagonal, start, elements): runs (element, start, elements) of one element laid at each other's start and at each other's
    end.  The diagonal is the (mirrored) start in the partner less the start."""
    out = set()
    for x, a, n in own:
        for y, b, m in theirs:
            if x == y:
                if n == m:
                    out.add((False, b - a, a, n))
                    out.add((True, k - b - n - a, a, n))
                    continue
                s = min(n, m)
                z = a + n - s
                out.add((False, b - a, a, s))
                out.add((False, b + m - s - z, z, s))
                out.add((True, k - b - m - a, a, s))
                out.add((True, k - b - s - z, z, s))
    return out


def joined_blocks(blocks: list[tuple[bool, int, int, int]], k: int) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Blocks (back, diagonal, start, elements) of one diagonal whose windows overlap or follow one another become one: (start, start in
    the partner, elements), first those in the same direction, then those turned round."""
    out = [], []
    last, stop = None, 0
    for back, d, a, n in sorted(blocks):
        mine = out[back]
        if last == (back, d) and a <= stop - k + 1:
            stop, a = max(stop, a + n), mine[-1][0]
            mine[-1] = (a, a + d, stop - a)
        else:
            last, stop = (back, d), a + n
            mine.append((a, a + d, n))
    return out


def _rows_of(col: pa.Array) -> tuple[list[int], dict[str, np.ndarray]]:
    """Bounds of the rows of an array<struct> column (nulls are empty), and its fields as arrays."""
    size = pc.fill_null(pc.list_value_length(col), 0).to_numpy(zero_copy_only=False)
    flat = col.flatten()
    return np.concatenate([[0], np.cumsum(size)]).tolist(), {f.name: flat.field(f.name).to_numpy(zero_copy_only=False) for f in flat.type}


def _pair_chains(k: int, gap_cost: float, min_matched: int):
    """Arrow kernel: one row a pair with the ends of its common stretches and both records' runs -> chains, as from `_chain`.

    A chain that is one block inside a run of one element is left to the class rows; one block of less than `min_matched` elements is
    no passage.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            (at, e), (own_at, own), (their_at, theirs) = (_rows_of(batch.column(c)) for c in (2, 3, 4))
            n_rows = len(batch)
            row = np.repeat(np.arange(n_rows), np.diff(at))
            back = e["back"].astype(bool)
            diagonal = np.where(back, -e["j"] - e["i"], e["j"] - e["i"]).astype(np.int64)
            first, last = (np.flatnonzero(e[c].astype(bool)) for c in ("begins", "stops"))
            first, last = (x[np.lexsort((e["i"][x], diagonal[x], back[x], row[x]))] for x in (first, last))
            # the stretches of the batch: every beginning has its end
            start, size = e["i"][first].astype(np.int64), e["i"][last].astype(np.int64) - e["i"][first] + k
            owner, turned, by = row[first], back[first], diagonal[first] + start  # `by` is mirrored where turned
            bounds = np.searchsorted(owner, np.arange(n_rows + 1))
            with_runs = (np.diff(own_at) > 0) & (np.diff(their_at) > 0)
            plain = (np.diff(bounds) == 1) & ~with_runs
            # most pairs have one stretch: no chaining
            x = bounds[:-1][plain]
            x = x[size[x] >= min_matched]
            j0 = np.where(turned[x], k - size[x] - by[x], by[x])
            out = list(zip(owner[x].tolist(), turned[x].tolist(), start[x].tolist(), (start[x] + size[x]).tolist(), j0.tolist(), (j0 + size[x]).tolist(), size[x].tolist(), ([t] for t in zip(start[x].tolist(), by[x].tolist(), size[x].tolist()))))
            stretch = list(zip(turned.tolist(), diagonal[first].tolist(), start.tolist(), size.tolist()))
            bounds = bounds.tolist()
            own, theirs = ([*zip(*(f[c].tolist() for c in ("run", "at", "n")))] for f in (own, theirs))
            for r in np.flatnonzero(~plain).tolist():
                found, mine = stretch[bounds[r] : bounds[r + 1]], own[own_at[r] : own_at[r + 1]]
                if with_runs[r]:
                    found.extend(run_blocks(mine, theirs[their_at[r] : their_at[r + 1]], k))
                for back_, some in enumerate(joined_blocks(found, k)):
                    if not some:
                        continue
                    for chain in [[0]] if len(some) == 1 else chain_blocks(*map(list, zip(*some)), gap_cost):
                        held = [some[x] for x in chain]
                        (a, b, _), (a2, b2, n2) = held[0], held[-1]
                        if len(held) == 1 and (n2 < min_matched or any(s <= a and a + n2 <= s + n for _, s, n in mine)):
                            continue
                        j0, j1 = (k - n2 - b2, k - b) if back_ else (b, b2 + n2)
                        out.append((r, bool(back_), a, a2 + n2, j0, j1, sum([x[2] for x in held]), held))
            cols = [*zip(*out)] or [[]] * 8
            rows = pa.array(cols[0], pa.int64())
            flat = [t for x in cols[7] for t in x]
            items = pa.StructArray.from_arrays([pa.array([t[c] for t in flat], pa.int32()) for c in range(3)], names=["at", "by", "n"])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(rows), batch.column(1).take(rows), pa.array(cols[1], pa.bool_()), *[pa.array(x, pa.int32()) for x in cols[2:7]],
                    pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(x) for x in cols[7]])]).astype(np.int32)), items),
                ],
                names=["rec", "partner", "back", "i0", "i1", "j0", "j1", "matched", "blocks"],
            )

    return run


def pair_chains(records: DataFrame, runs: DataFrame, queries: DataFrame, k: int, min_matched: int, gap_cost: float = 0.1) -> DataFrame:
    """rec, partner, back, i0, i1, j0, j1, matched, blocks: chains of every pair of a record in `queries` (rec) and another one that shares a
    window of more than one element, or two runs of one element.  `runs` is (rec, runs)."""
    kinds = "h1 bigint, h2 int, rec bigint, at int, turned boolean, both boolean, prev bigint, next bigint"
    a = records.join(queries, "rec", "left_semi").mapInArrow(_flanked(k), kinds).alias("a")
    b = records.mapInArrow(_flanked(k), kinds).alias("b")
    differ = lambda c: F.coalesce(F.col(f"a.{c}") != F.col(f"b.{c}"), F.lit(True))
    same = (F.col("a.h1") == F.col("b.h1")) & (F.col("a.h2") == F.col("b.h2")) & (F.col("a.rec") != F.col("b.rec"))
    ends = a.join(b.hint("merge"), same & (differ("prev") | differ("next")) & ~(F.col("a.both") & F.col("a.turned")))
    side = lambda x, y: F.when(F.col("a.turned"), differ(y)).otherwise(differ(x))
    item = F.struct(
        (F.col("a.turned") != F.col("b.turned")).alias("back"), F.col("a.at").alias("i"), F.col("b.at").alias("j"),
        side("prev", "next").alias("begins"), side("next", "prev").alias("stops"),
    )
    linked = ends.select(F.col("a.rec").alias("rec"), F.col("b.rec").alias("partner"), item.alias("item"))
    linked = saved(linked.groupBy("rec", "partner").agg(F.collect_list("item").alias("ends")))  # bounded by both lists
    theirs = runs.select(F.col("rec").alias("partner"), F.col("runs").alias("runs2"))
    whole = linked.join(runs, "rec", "left").join(theirs, "partner", "left").select("rec", "partner", "ends", "runs", "runs2")
    # two runs of one record, in whatever order, as a key
    two = F.transform("runs", lambda x, p: F.transform(F.slice("runs", p + 2, F.size("runs")), lambda y: F.struct(F.least(x["run"], y["run"]).alias("x"), F.greatest(x["run"], y["run"]).alias("y"))))
    keyed = runs.where(F.size("runs") > 1).select("rec", "runs", F.explode(F.array_distinct(F.flatten(two))).alias("key"))
    left, right = keyed.join(queries, "rec", "left_semi").alias("l"), keyed.alias("r")
    some = left.join(right.hint("merge"), (F.col("l.key") == F.col("r.key")) & (F.col("l.rec") != F.col("r.rec")))
    some = some.select(F.col("l.rec").alias("rec"), F.col("r.rec").alias("partner"), F.col("l.runs").alias("runs"), F.col("r.runs").alias("runs2"))
    more = some.dropDuplicates(["rec", "partner"]).join(linked.select("rec", "partner"), ["rec", "partner"], "left_anti")
    every = whole.unionByName(more.withColumn("ends", F.lit(None).cast(linked.schema["ends"].dataType)))
    return every.select("rec", "partner", "ends", "runs", "runs2").mapInArrow(
        _pair_chains(k, gap_cost, min_matched),
        "rec bigint, partner bigint, back boolean, i0 int, i1 int, j0 int, j1 int, matched int, blocks array<struct<at:int,by:int,n:int>>",
    )


def _stretches(k: int):
    """Arrow kernel: rows (rec, id, list, pos, blocks) -> id, n_elements, i0, i1, start_pos, end_pos of covered stretches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values, at = list_values(batch.column(2))
            pos = batch.column(3).cast(pa.large_list(pa.int32()))
            pos_at = pos.offsets.to_numpy()
            pos_flat = pos.values
            blocks = batch.column(4)
            b_at = blocks.offsets.to_numpy()
            b = blocks.values.slice(b_at[0], b_at[-1] - b_at[0])
            row = np.repeat(np.arange(len(batch)), np.diff(b_at))
            s = b.field(0).to_numpy(zero_copy_only=False).astype(np.int64) + at[row]
            n = b.field(2).to_numpy(zero_copy_only=False).astype(np.int64) - k + 1
            hit = np.zeros(len(values), dtype=bool)
            hit[np.repeat(s - np.append(0, np.cumsum(n)[:-1]), n) + np.arange(n.sum())] = True  # starts of chained windows
            start, h1, h2, _ = window_seeds(values, at, k)
            doc = np.searchsorted(at, start, side="right") - 1
            # equal windows of a record share its first one's fate
            order = np.lexsort((start, h1, doc))
            d, h = doc[order], h1[order]
            first = np.flatnonzero(np.append(True, (d[1:] != d[:-1]) | (h[1:] != h[:-1]))) if len(order) else order
            size = np.diff(np.append(first, len(order)))
            fate = np.repeat(np.logical_or.reduceat(hit[start[order]], first), size) if len(order) else np.empty(0, dtype=bool)
            depth = np.zeros(len(values) + 1, dtype=np.int64)
            np.add.at(depth, start[order[fate]], 1)
            np.add.at(depth, start[order[fate]] + k, -1)
            covered = np.cumsum(depth[:-1]) > 0
            owner = np.repeat(np.arange(len(batch)), np.diff(at))
            edge = np.flatnonzero(np.append(True, (covered[1:] != covered[:-1]) | (owner[1:] != owner[:-1]))) if len(covered) else np.empty(0, dtype=np.int64)
            stop = np.append(edge[1:], len(covered))
            keep = covered[edge]
            a, z = edge[keep], stop[keep]
            o = owner[a]
            i0, i1 = a - at[o], z - at[o]
            take = lambda i: pos_flat.take(pa.array(pos_at[o] + i))
            yield pa.RecordBatch.from_arrays(
                [batch.column(1).take(pa.array(o)), pa.array(np.diff(at)[o].astype(np.int32)), pa.array(i0.astype(np.int32)), pa.array(i1.astype(np.int32)), take(i0), take(i1 - 1)],
                names=["id", "n_elements", "i0", "i1", "start_pos", "end_pos"],
            )

    return run


def shared_stretches(df: DataFrame, id_col: str, list_col: str, pos_col: str, k: int = 8) -> DataFrame:
    """id, n_elements, i0, i1, start_pos, end_pos: maximal stretches whose elements each lie in a window of k elements that another
    id has as well, in either direction; found through the chains of each record, each id once."""
    records = records_once(df, id_col, list_col, pos_col)
    blocks = shared_chains(records, k).groupBy("rec").agg(F.flatten(F.collect_list("blocks")).alias("blocks"))
    rows = records.join(blocks, "rec").select("rec", "id", "list", pos_col, "blocks")
    kind = df.schema[id_col].dataType.simpleString()
    return rows.mapInArrow(_stretches(k), f"id {kind}, n_elements int, i0 int, i1 int, start_pos int, end_pos int")


def gap_matches(a: list, b: list) -> int:
    """Longest common subsequence of what lies between two blocks; a column of the table is the bits of one number."""
    at: dict = {}
    for j, y in enumerate(b):
        at[y] = at.get(y, 0) | 1 << j
    full = free = (1 << len(b)) - 1
    for x in a:
        hit = free & at.get(x, 0)
        free = (free + hit | free - hit) & full
    return len(b) - free.bit_count()


def _align(k: int):
    """Arrow kernel: chains with both lists -> their matched elements after aligning the gaps between blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            (own, own_at), (theirs, their_at) = list_values(batch["own"]), list_values(batch["theirs"])
            at, f = _rows_of(batch["blocks"])
            start, by, n = f["at"].astype(np.int64), f["by"].astype(np.int64), f["n"].astype(np.int64)
            row = np.repeat(np.arange(len(batch)), np.diff(at))
            back = batch["back"].to_numpy(zero_copy_only=False).astype(bool)
            total = batch["matched"].to_numpy(zero_copy_only=False).astype(np.int64)
            x = np.flatnonzero(row[1:] == row[:-1])
            a0, a1, b0, b1 = start[x] + n[x], start[x + 1], by[x] + n[x], by[x + 1]
            some = (a1 > a0) & (b1 > b0)
            for r, a, z, c, d in zip(*(v[some].tolist() for v in (row[x], a0, a1, b0, b1))):
                o, t = own_at[r], their_at[r]
                # mirrored starts: place m of a reversed partner is k - 1 - m of its list
                other = theirs[t + k - d : t + k - c][::-1] if back[r] else theirs[t + c : t + d]
                total[r] += gap_matches(own[o + a : o + z].tolist(), other.tolist())
            yield pa.RecordBatch.from_arrays([*batch.select(PASSAGE).columns, pa.array(total.astype(np.int32))], names=[*PASSAGE, "matched"])

    return run


PASSAGE = ["rec", "partner", "back", "i0", "i1", "j0", "j1"]


def classes_of(records: DataFrame) -> DataFrame:
    """records (rec, id, list) with `of`: the smallest rec among those of an equal list, by 128 bits of it."""
    keys = [F.xxhash64("list", F.size("list")), F.xxhash64(F.lit(0x5EED), F.size("list"), "list")]
    keyed = records.select("*", keys[0].alias("__a"), keys[1].alias("__b"))
    # reduced to one row a list in the map tasks; the members of a hot list meet that row, so adaptive execution may split them
    least = keyed.groupBy("__a", "__b").agg(F.min("rec").alias("of"))
    return keyed.join(least, ["__a", "__b"]).drop("__a", "__b")


def fuzzy_passages(df: DataFrame, id_col: str, list_col: str, searched: Column, k: int = 8, min_matched: int = 8) -> DataFrame:
    """id, partner, back, i0, i1, j0, j1, matched, identity, run: chains of the records of which a row meets `searched`, with every other.

    Both sides are classes of equal lists, named by one of their ids; `copies` tells the class of each record.  `matched` counts equal
    elements in blocks and in the aligned gaps, `identity` is their share of the longer side.  Only chains of several blocks need the lists; a
    partner of very many records is replicated to the tasks that hold them.  Rows without a partner are the members of another kind of
    class: a run of the element `run`; any two of them share the shorter run, in both directions.
    """
    every = saved(classes_of(records_once(df, id_col, list_col)))
    records = every.where("rec = of").select("rec", "id", "list")
    named = df.where(searched & F.col(id_col).isNotNull()).select(F.xxhash64(id_col).alias("rec")).distinct()
    queries = saved(every.join(named, "rec", "left_semi").select(F.col("of").alias("rec")).distinct())
    runs = saved(records.mapInArrow(_runs(k), "rec bigint, runs array<struct<run:bigint,at:int,n:int>>"))
    chains = saved(pair_chains(records, runs, queries, k, min_matched))
    lists = records.select("rec", F.col("list").alias("own"))
    multi = chains.where(F.size("blocks") > 1).join(lists, "rec")
    theirs = records.select(F.col("rec").alias("partner"), F.col("list").alias("theirs"))
    both = balanced_join(multi, theirs, ["partner"], ["rec", "i0"])
    aligned = both.select(*PASSAGE, "blocks", "own", "theirs", "matched").mapInArrow(
        _align(k), "rec bigint, partner bigint, back boolean, i0 int, i1 int, j0 int, j1 int, matched int"
    )
    single = chains.where(F.size("blocks") == 1).select(*PASSAGE, "matched")
    out = saved(aligned.unionByName(single).where(F.col("matched") >= min_matched))
    ids = records.select("rec", "id")
    own = balanced_join(out, ids, ["rec"], ["partner", "i0"])
    other = ids.select(F.col("rec").alias("partner"), F.col("id").alias("partner_id"))
    pairs = balanced_join(own, other, ["partner"], ["rec", "i0"]).select(
        "id", F.col("partner_id").alias("partner"), "back", "i0", "i1", "j0", "j1", "matched",
        (F.col("matched") / F.greatest(F.col("i1") - F.col("i0"), F.col("j1") - F.col("j0"))).alias("identity"), F.lit(None).cast("bigint").alias("run"),
    )
    long = runs.select("rec", F.inline("runs")).where(F.col("n") >= min_matched)
    shared = long.groupBy("run").agg(F.min("rec").alias("low"), F.max("rec").alias("high")).where("low <> high").select("run")
    kind = df.schema[id_col].dataType
    members = long.join(shared, "run", "left_semi").join(ids, "rec").select(
        "id", F.lit(None).cast(kind).alias("partner"), F.lit(None).cast("boolean").alias("back"), F.col("at").alias("i0"), (F.col("at") + F.col("n")).alias("i1"),
        F.lit(None).cast("int").alias("j0"), F.lit(None).cast("int").alias("j1"), F.col("n").alias("matched"), F.lit(1.0).alias("identity"), "run",
    )
    return pairs.unionByName(members)


def copies(df: DataFrame, id_col: str, list_col: str) -> DataFrame:
    """id, of: each record, once, with the id that names the class of its list."""
    every = saved(classes_of(records_once(df, id_col, list_col).where(F.size("list") > 0)))
    names = every.where("rec = of").select("of", F.col("id").alias("name"))
    return every.select("id", "of").join(names, "of").select("id", F.col("name").alias("of"))
