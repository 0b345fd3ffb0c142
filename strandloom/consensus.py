"""Partial-order alignment of element lists, heaviest-path consensus, and pairwise alignment scores.

Scores: 1 for a match, -1 for a mismatch or a gap.  A list may begin anywhere in the graph and must end at a node without
successors.  Of equal moves a skipped element wins over a skipped node, that over a match; of equal predecessors the later one.
"""

from __future__ import annotations

import numpy as np

MATCH, MISMATCH, GAP = 1, -1, -1
#: First letter of a gap where a consensus is cut to its template.
OPEN = -2
#: Lists that are aligned at once.
TOGETHER = 64


class Graph:
    """A directed acyclic graph of elements; edges carry a weight and the weights of the texts between their elements."""

    def __init__(self, values: list, texts: list[str], weight: int = 1):
        self.values = list(values)
        self.after: list[dict[int, list]] = [{} for _ in values]
        self.before: list[list[int]] = [[] for _ in values]
        for i in range(len(values) - 1):
            self._link(i, i + 1, texts[i], weight)

    def _link(self, a: int, b: int, text: str, weight: int) -> None:
        edge = self.after[a].get(b)
        if edge:
            edge[0] += weight
            edge[1][text] = edge[1].get(text, 0) + weight
        else:
            self.after[a][b] = [weight, {text: weight}]
            self.before[b].append(a)

    def order(self) -> list[int]:
        """Nodes, predecessors first."""
        left = [len(p) for p in self.before]
        ready = [i for i, n in enumerate(left) if n == 0]
        out = []
        for i in ready:
            out.append(i)
            for j in self.after[i]:
                left[j] -= 1
                if left[j] == 0:
                    ready.append(j)
        return out

    def align(self, values: list) -> tuple[int, list[tuple[int | None, int | None]]]:
        """Score and (node, element) pairs in order; None where one side is skipped."""
        return align_all([(self, values)])[0]

    def _pairs(self, values: list, score: dict[int, list[int]], end: int | None) -> list[tuple[int | None, int | None]]:
        """The moves that lead to `end`; rows of scores are raised by their column, where a skipped element costs nothing."""
        pairs: list[tuple[int | None, int | None]] = []
        v, j = end, len(values)
        while v is not None and v >= 0 and j > 0:
            row = score[v]
            here = row[j]
            if row[j - 1] == here:
                pairs.append((None, j - 1))
                j -= 1
                continue
            step = 2 if self.values[v] == values[j - 1] else 0
            for p in reversed(self.before[v] or [-1]):
                if score[p][j] - 1 == here:
                    pairs.append((v, None))
                    v = p
                    break
                if score[p][j - 1] + step == here:
                    pairs.append((v, j - 1))
                    v, j = p, j - 1
                    break
            else:
                pairs.append((v, j - 1))
                v, j = -1, j - 1
        pairs += [(None, x) for x in range(j - 1, -1, -1)]
        return pairs[::-1]

    def add(self, values: list, texts: list[str], pairs: list[tuple[int | None, int | None]], weight: int = 1) -> None:
        """Merges an aligned list: equal elements share their node, others get a new one."""
        last = None
        for node, j in pairs:
            if j is None:
                continue
            if node is None or self.values[node] != values[j]:
                node = len(self.values)
                self.values.append(values[j])
                self.after.append({})
                self.before.append([])
            if last is not None and last[0] != node:
                self._link(last[0], node, "".join(texts[last[1] : j]), weight)
            last = (node, j)

    def consensus(self, threshold: int = 0) -> tuple[list, list[str]]:
        """Elements of the heaviest path and the most common texts between them; edges below the threshold weigh nothing."""
        total = [0] * len(self.values)
        best: list[int | None] = [None] * len(self.values)
        for v in reversed(self.order()):
            top = None
            for u, (w, _) in self.after[v].items():
                key = (w if w >= threshold else 0, total[u])
                if top is None or key > top:
                    top, best[v] = key, u
            total[v] = sum(top) if top else 0
        if not self.values or max(total) == 0:
            return [], []
        v = max(range(len(total)), key=lambda i: (total[i], -i))
        path, texts = [v], []
        while best[v] is not None:
            between = self.after[v][best[v]][1]
            texts.append(max(between, key=between.get))
            v = best[v]
            path.append(v)
        return [self.values[i] for i in path], texts


def align_all(jobs: list[tuple[Graph, list]], both: bool = False) -> list[tuple]:
    """`Graph.align` of each list with its graph, step by step for all of them at once.

    With `both` each list is also taken reversed: (whether forwards, pairs) of the direction taken, forwards only if that scores strictly more.
    """
    ways = 2 if both else 1
    n = max(len(values) for _, values in jobs)
    orders = [g.order() for g, _ in jobs]
    depth = max(map(len, orders))
    own = np.full((len(jobs), ways, n), -1, dtype=np.int32)
    node = np.full((depth, len(jobs)), -2, dtype=np.int32)
    # rows of scores by place in the order, the last one for what begins anew; places beyond a list's end are not read
    preds: list[list[np.ndarray]] = [[] for _ in range(depth)]
    most = [0] * depth
    listed = []
    for x, ((g, values), order) in enumerate(zip(jobs, orders)):
        code: dict = {}
        own[x, 0, : len(values)] = [code.setdefault(e, len(code)) for e in values]
        if both:
            own[x, 1, : len(values)] = own[x, 0, : len(values)][::-1]
        node[: len(order), x] = [code.get(g.values[v], -2) for v in order]
        place = {v: t for t, v in enumerate(order)}
        before = [[place[p] for p in g.before[v]] or [depth] for v in order]
        listed.append(before)
        for t, p in enumerate(before):
            if len(p) > most[t]:
                most[t] = len(p)
    at = np.full((sum(most), len(jobs)), depth, dtype=np.int32)
    first = np.concatenate([[0], np.cumsum(most)]).tolist()
    for x, before in enumerate(listed):
        for t, p in enumerate(before):
            # fewer predecessors than others have: one of them again
            at[first[t] : first[t + 1], x] = p[0]
            if len(p) > 1:
                at[first[t] : first[t] + len(p), x] = p
    table = np.zeros((depth + 1, len(jobs), ways, n + 1), dtype=np.int32)
    every = np.arange(len(jobs))
    for t in range(depth):
        top = table[at[first[t]], every]
        for q in range(first[t] + 1, first[t + 1]):
            np.maximum(top, table[at[q], every], out=top)
        step = (own == node[t][:, None, None]).astype(np.int32)
        step += step
        step += top[..., :-1]
        top -= 1
        np.maximum(step, top[..., 1:], out=step)
        # fresh starts score nothing, as does the first column
        np.maximum.accumulate(step, axis=-1, out=table[t, :, :, 1:])
    done = []
    for x, ((g, values), order) in enumerate(zip(jobs, orders)):
        ends = [t for t, v in enumerate(order) if not g.after[v]]
        size = len(values)
        best = []
        for w in range(ways):
            # of equal ends the last one
            score, t = max(((int(table[t, x, w, size]), t) for t in ends), default=(size, None))
            best.append((score - size, t))
        w = int(both and best[0][0] <= best[1][0])
        score, t = best[w]
        rows = table[: len(order), x, w, : size + 1].tolist()
        score_of = dict(zip(order, rows))
        score_of[-1] = [0] * (size + 1)
        pairs = g._pairs(values[::-1] if w else values, score_of, None if t is None else order[t])
        done.append((w == 0, pairs) if both else (score, pairs))
    return done


def pair_scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Last row of the score table of a (whole) against b (any part); the first letter of a gap costs 2, each further one 1."""
    cols = np.arange(len(b) + 1)
    row = np.zeros(len(b) + 1, dtype=np.int64)
    down = np.full(len(b) + 1, -(1 << 40), dtype=np.int64)
    for i, x in enumerate(a):
        down = np.maximum(row + OPEN, down + GAP)
        new = np.append(OPEN + GAP * i, np.maximum(row[:-1] + np.where(b == x, MATCH, MISMATCH), down[1:]))
        # gaps in a: the best earlier column after paying for the gap from it
        across = np.maximum.accumulate(new + cols) - cols + (OPEN - GAP)
        row = np.maximum(new, np.append(new[:1], across[:-1] + GAP))
    return row


def identity(a: str, b: str) -> float:
    """Matches over alignment columns of a (whole) on b (any part), the better of both directions of a; 0 for empty texts.

    Of equal moves a pair of letters wins over a gap in b, that over a gap in a.
    """
    if not a or not b:
        return 0.0
    if a in b:
        return 1.0
    from strandloom.kernels import reverse_complement

    y = np.frombuffer(b.encode(), dtype=np.uint8)
    where = {c: int.from_bytes(np.packbits(y == c, bitorder="little").tobytes(), "little") for c in set(y.tolist())}
    best = 0.0
    for text in (a.encode(), reverse_complement(a).encode()):
        score, end, back = _rows(text, len(y), where)
        # matches are (columns + score) / 2 of at least len(text) columns
        if (max(score, 0) / len(text) + 1) / 2 > best:
            best = max(best, _share(len(text), end, back))
    return best


def _rows(a: bytes, n: int, where: dict[int, int]) -> tuple[int, int, list[tuple[int, int, int]]]:
    """Best score of a (whole) against any part of a text of n letters, its first end, and for each letter of a the places of the text that
    match it, those where another move beats the pair, and those where a gap in a or a pair is all there is.

    A row is kept as the differences between its neighbours, which are -1 to 2, in bits of whole numbers (u); those between two rows (v,
    as they enter a place) follow from them by carries.
    """
    whole = (1 << n) - 1
    um, u0, u1, u2 = 0, whole, 0, 0
    back = []
    for c in a:
        eq = where.get(c, 0)
        mis = whole ^ eq
        # differences between the rows: 2 and 1 are carried on over places of p
        p = mis & um
        x = (eq & um) << 1
        v2 = x | ((p + (x & p)) ^ p)
        mis0, mis1, mis2 = mis & u0, mis & u1, mis & u2
        x = ((eq & u0) | (v2 & mis0)) << 1
        v1 = x | ((p + (x & p)) ^ p)
        v0 = ((eq & u1) | (v2 & mis1) | (v1 & mis0) | (p & ~(v1 | v2))) << 1
        back.append((eq, mis & (u1 | u2 | v1 | v2), (v2 | v1 | v0) >> 1))
        v2, v1, v0 = v2 & whole, v1 & whole, v0 & whole
        vm = whole ^ (v2 | v1 | v0)
        low = p | mis0
        um, u0, u1 = (
            v2 | (v1 & (low | mis1)) | (v0 & low), (v1 & (eq | mis2)) | (v0 & mis1) | (vm & low), (v0 & (eq | mis2)) | (vm & mis1),
        )
        u2 = whole ^ (um | u0 | u1)
    bits = lambda u: np.unpackbits(np.frombuffer(u.to_bytes(n // 8 + 1, "little"), dtype=np.uint8), bitorder="little")[:n].astype(np.int64)
    row = np.concatenate([[0], np.cumsum(bits(u1) + 2 * bits(u2) - bits(um))]) + GAP * len(a)
    end = int(row.argmax())
    return int(row[end]), end, back


def _share(m: int, end: int, back: list[tuple[int, int, int]]) -> float:
    """Matches over columns of the alignment that `_rows` describes, of m letters up to place `end`."""
    i, j, same, columns = m, end, 0, 0
    while i:
        columns += 1
        if not j:
            i -= 1
            continue
        eq, other, risen = back[i - 1]
        if eq >> (j - 1) & 1:
            same += 1
            i, j = i - 1, j - 1
        elif not other >> (j - 1) & 1:
            i, j = i - 1, j - 1
        elif risen >> (j - 1) & 1:
            j -= 1
        else:
            i -= 1
    return same / columns


def template_part(template: list, found: list) -> tuple[int, int]:
    """Bounds of the part of `found` on which the whole template aligns best."""
    if not template or not found:
        return 0, 0
    code = {v: i for i, v in enumerate(dict.fromkeys([*template, *found]))}
    a, b = np.array([code[v] for v in template]), np.array([code[v] for v in found])
    end = int(pair_scores(a, b).argmax())
    back = pair_scores(a[::-1], b[:end][::-1])
    return end - int(back.argmax()), end


def correct(values: list, texts: list[str], others: list[tuple[list, list[str], list[str], int]], threshold: int = 0) -> tuple[list, list[str]]:
    """Consensus of a list with its recruits (values, texts, texts of the reversed list, weight), cut to the template's part.

    A recruit is taken forwards only if that aligns strictly better than its reverse.  Unchanged if fewer than two
    elements would remain.  Instead of texts there may be a function that returns them.
    """
    return correct_all([(values, texts, others)], threshold)[0]


def correct_all(jobs: list[tuple[list, list[str], list[tuple]]], threshold: int = 0) -> list[tuple[list, list[str]]]:
    """`correct` of each (values, texts, others); recruits are aligned one after the other, each with those of other lists in the same place."""
    given = lambda texts: texts() if callable(texts) else texts
    graphs = {x: Graph(values, texts) for x, (values, texts, others) in enumerate(jobs) if len(values) >= 2 and others}
    queues = {x: [o for o in jobs[x][2] if len(o[0]) >= 2] for x in graphs}
    for i in range(max(map(len, queues.values()), default=0)):
        # like sizes together, as all take the steps of the longest
        turn = sorted((x for x in queues if i < len(queues[x])), key=lambda x: (len(graphs[x].values), len(queues[x][i][0])))
        for start in range(0, len(turn), TOGETHER):
            part = turn[start : start + TOGETHER]
            for x, (forwards, pairs) in zip(part, align_all([(graphs[x], queues[x][i][0]) for x in part], both=True)):
                own, fwd, rev, weight = queues[x][i]
                if forwards:
                    graphs[x].add(own, given(fwd), pairs, weight)
                else:
                    graphs[x].add(own[::-1], given(rev), pairs, weight)
    done = []
    for x, (values, texts, _) in enumerate(jobs):
        found, between = graphs[x].consensus(threshold) if x in graphs else (values, texts)
        start, end = template_part(values, found) if x in graphs else (0, 0)
        done.append((found[start:end], between[start : end - 1]) if end - start >= 2 else (values, texts))
    return done
