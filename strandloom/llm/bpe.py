"""Byte-level BPE: array pre-tokenisation and merge replay over sets of distinct words.

Words are merged together, not one by one: an inverted index from token pair to word positions is walked in rank order, so each
merge touches exactly the places where its pair occurs and their neighbours.  `encode` brings the distinct words of the corpus here.
"""

from __future__ import annotations

import heapq
import json
from collections import defaultdict
from dataclasses import dataclass
from functools import lru_cache

import numpy as np

LETTER, NUMBER, OTHER, SPACE = 0, 1, 2, 3
#: Bytes of text that one pass of the array code takes at most (a single longer text is its own pass).
BLOCK_BYTES = 4 << 20


def char_classes() -> np.ndarray:
    """Class of every code point: letter, number, white space or other."""
    import regex

    table = np.full(0x110000, OTHER, dtype=np.uint8)
    every = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
    for cls, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\p{White_Space}+")):
        for m in regex.finditer(pattern, every):
            a, b = m.span()
            shift = lambda i: i if i < 0xD800 else i + 0x800
            table[shift(a) : shift(b - 1) + 1] = cls
    return table


class Merges:
    """Vocabulary and ranked merges of a byte-level BPE file in the `tokenizers` JSON form."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab = model["vocab"]
        self.byte_id = np.array([vocab[c] for c in byte_letters()], dtype=np.int64)
        self.rank: dict[tuple[int, int], tuple[int, int]] = {}
        for r, m in enumerate(model["merges"]):
            a, b = m if isinstance(m, list) else m.split(" ")
            self.rank.setdefault((vocab[a], vocab[b]), (r, vocab[a + b]))

    def replay(self, words: list[bytes]) -> list[list[int]]:
        """Token ids of each word: all merges in rank order over all words at once."""
        rank = self.rank
        sym: list[int] = []
        right: list[int] = []
        left: list[int] = []
        heads = []
        for w in words:
            base = len(sym)
            heads.append(base)
            sym.extend(self.byte_id[np.frombuffer(w, dtype=np.uint8)].tolist())
            left.extend([-1, *range(base, base + len(w) - 1)])
            right.extend([*range(base + 1, base + len(w)), -1])
        where: defaultdict[tuple[int, int], list[int]] = defaultdict(list)
        for i, j in enumerate(right):
            if j >= 0 and (sym[i], sym[j]) in rank:
                where[sym[i], sym[j]].append(i)
        queue = [(*rank[p], p) for p in where]
        heapq.heapify(queue)
        while queue:
            _, made, pair = heapq.heappop(queue)
            a, b = pair
            fresh = set()
            # left to right, so that overlapping occurrences resolve as in a single word
            for i in sorted(where.pop(pair, ())):
                j = right[i]
                if sym[i] != a or j < 0 or sym[j] != b:
                    continue
                sym[i], sym[j] = made, -1
                k = right[i] = right[j]
                if k >= 0:
                    left[k] = i
                    if (made, sym[k]) in rank:
                        fresh.add((made, sym[k]))
                        where[made, sym[k]].append(i)
                h = left[i]
                if h >= 0 and (sym[h], made) in rank:
                    fresh.add((sym[h], made))
                    where[sym[h], made].append(h)
            for p in fresh:
                heapq.heappush(queue, (*rank[p], p))
        out = []
        for i in heads:
            ids = []
            while i >= 0:
                ids.append(sym[i])
                i = right[i]
            out.append(ids)
        return out


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in shown else chr(next(rest)) for b in range(256)]


def word_starts(buf: np.ndarray, doc_at: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Byte offsets at which words begin; words tile the buffer.

    `buf` holds valid UTF-8, `doc_at` the offsets of the (non-empty) documents in it.  The cut is that of the published pattern:
    contractions, then letters, numbers or other signs with one leading blank, then white space that leaves its last
    character to a following word.
    """
    n = len(buf)
    cls = classes[:128][np.minimum(buf, 127)]
    high = buf >= 0x80
    if high.any():
        at = np.flatnonzero(high)
        lead = at[(buf[at] & 0xC0) != 0x80]
        chars = np.frombuffer(buf[at].tobytes().decode("utf-8").encode("utf-32-le"), dtype="<u4")
        size = np.where(chars < 0x800, 2, np.where(chars < 0x10000, 3, 4))
        cls[at] = np.repeat(classes[chars], size)
    else:
        lead = np.empty(0, dtype=np.int64)
    edge = np.empty(n, dtype=bool)
    edge[0] = True
    np.not_equal(cls[1:], cls[:-1], out=edge[1:])
    edge[doc_at] = True
    rs = np.flatnonzero(edge)
    rend = np.append(rs[1:], n)
    rc = cls[rs]
    begins = np.zeros(n + 1, dtype=bool)
    begins[doc_at] = True
    begins[n] = True
    follows = ~begins[rend]  # another run of the same document comes next

    start = edge  # every run begins a word but for the corrections below
    gap = np.flatnonzero((rc == SPACE) & follows)
    last = rend[gap] - 1
    if len(lead):
        wide = high[last]
        last[wide] = lead[np.searchsorted(lead, last[wide], side="right") - 1]
    start[last] = True
    blank = buf[last] == 0x20
    start[rend[gap[blank]]] = False

    tick = np.flatnonzero((rc == OTHER) & (rend - rs == 1) & follows & (buf[rs] == 0x27))
    tick = tick[start[rs[tick]]]
    if len(tick):
        tick = tick[rc[tick + 1] == LETTER]
        a = rs[tick + 1]
        room = rend[tick + 1] - a
        one, two = buf[a], buf[np.minimum(a + 1, n - 1)]
        single = np.isin(one, np.frombuffer(b"stmd", dtype=np.uint8))
        double = (room > 1) & (((two == 0x65) & ((one == 0x72) | (one == 0x76))) | ((one == 0x6C) & (two == 0x6C)))
        took = np.where(single, 1, np.where(double, 2, 0))
        hit = took > 0
        start[a[hit]] = False
        after = hit & (took < room)
        start[a[after] + took[after]] = True
    return np.flatnonzero(start)


@dataclass(frozen=True)
class Words:
    """The words of a buffer: those of up to 7 bytes as numbers (bytes, and the length in the highest byte), longer ones as bytes."""

    n: int
    short: np.ndarray
    key: np.ndarray
    long: np.ndarray
    piece: list[bytes]

    def distinct(self) -> list[bytes]:
        keys = np.unique(self.key)
        raw, size = keys.astype("<u8").tobytes(), (keys >> np.uint64(56)).tolist()
        return [raw[8 * i : 8 * i + m] for i, m in enumerate(size)] + list(dict.fromkeys(self.piece))

    def numbers(self, known: list[bytes]) -> np.ndarray:
        """The place of each word, in order, in the list `known`, which holds them all."""
        out = np.empty(self.n, dtype=np.int64)
        few = np.array([i for i, w in enumerate(known) if len(w) < 8], dtype=np.int64)
        if len(self.short):
            keys = np.array([int.from_bytes(known[i], "little") | len(known[i]) << 56 for i in few.tolist()], dtype=np.uint64)
            order = np.argsort(keys)
            out[self.short] = few[order[np.searchsorted(keys[order], self.key)]]
        if self.piece:
            place = {w: i for i, w in enumerate(known) if len(w) >= 8}
            out[self.long] = [place[w] for w in self.piece]
        return out


def cut(buf: np.ndarray, at: np.ndarray, classes: np.ndarray) -> tuple[np.ndarray, Words]:
    """Starts and words of the documents buf[at[i]:at[i+1]]; the buffer must not be empty."""
    n = len(buf)
    start = word_starts(buf, np.unique(at[:-1][at[:-1] < n]), classes)
    size = np.diff(np.append(start, n))
    padded = np.concatenate([buf, np.zeros(8, dtype=np.uint8)])
    eight = np.ndarray(shape=(n,), dtype="<u8", buffer=padded.data, strides=(1,))
    short, long = np.flatnonzero(size < 8), np.flatnonzero(size >= 8)
    length = size[short].astype(np.uint64)
    key = eight[start[short]] & ((np.uint64(1) << (length * np.uint64(8))) - np.uint64(1)) | length << np.uint64(56)
    raw, a = buf.tobytes(), start[long]
    return start, Words(len(start), short, key, long, [raw[i:j] for i, j in zip(a.tolist(), (a + size[long]).tolist())])


@lru_cache(maxsize=2)
def merges(path: str) -> Merges:
    """The merges of this Python worker."""
    return Merges(path)


@lru_cache(maxsize=1)
def classes() -> np.ndarray:
    return char_classes()


def blocks(at: np.ndarray, most: int = BLOCK_BYTES):
    """Ranges of documents of about `most` bytes; a longer document comes alone."""
    i, n = 0, len(at) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + most, side="right")) - 1)
        yield i, min(j, n)
        i = min(j, n)
