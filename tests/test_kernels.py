import random
import re

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st

from strandloom import kernels as K
from strandloom.params import Params

# A sequence and the hashes of its 10-mers that a density of 0.01 keeps.
SEQ = (
    "TGGAAGCCTTTTTGATCTTCCTTACCACGGTGATGATGGTGTCGCTGATGATGGCCGCGGATCCCTCCCTGCTTGCTACGCCGCGTACGTACCTGATGAGCCATATGCCGTGGCTACCGTTTTTGCTGATCCTGCTGCCCGCCAACATCATG"
    "ACCATGGTGATGTATGCCTTTCGTGCGGAACGCAAACACATTTCCGAAAGCGAAACCCACTTTCGGAACGCGATGGAATATTCCGCTATCGGTATGGCGTTAGTGGGCACCGAGGGACAATGGCTGCAAACCAACAAAGCGCTCTGCCAGT"
)
HASHES = [17721834324525059, 145164613009833572, 132671282722695729, 55654971230978398, 77488562567813534, 64734178350999831, 59815507667718894]


def arrays(*seqs):
    data = [s.encode() for s in seqs]
    return np.frombuffer(b"".join(data), dtype=np.uint8), np.concatenate([[0], np.cumsum([len(d) for d in data])]).astype(np.int64)


def test_known_hashes():
    row, pos, h = K.density_minimizers(*arrays(SEQ), 10, 0.01, hpc=False)
    assert pos.tolist() == [0, 29, 36, 157, 186, 288, 293] and h.tolist() == HASHES and set(row) == {0}


def test_hash_is_strand_neutral_and_respects_bounds():
    a = K.canonical_hashes(arrays(SEQ)[0], 12)
    b = K.canonical_hashes(arrays(K.reverse_complement(SEQ))[0], 12)
    assert (a == b[::-1]).all()
    row, pos, h = K.density_minimizers(*arrays("ACG", "", SEQ, "AC"), 10, 0.01, hpc=False)
    assert set(row) == {2} and h.tolist() == HASHES


def test_collapse():
    data, at, pos = K.collapse(*arrays("AACCGNNTRR", "", "AA", "aaA"))
    assert data.tobytes() == b"ACGNTRRAaA" and at.tolist() == [0, 7, 7, 8, 10]
    assert pos.tolist() == [0, 2, 4, 5, 7, 8, 9, 0, 0, 2]


def test_clean_and_complement():
    data, at = K.clean(*arrays("ac\ngu", " \n", "x-N"))
    assert data.tobytes() == b"ACGTX-N" and at.tolist() == [0, 4, 4, 7]
    assert K.reverse_complement("ACGTacgtuUx") == "NAaacgtACGT"


def slow_minimum(v, w):
    best, out = None, []
    for i in range(w - 1, len(v)):
        win = list(range(i - w + 1, i + 1))
        if best is None:
            best = min(win, key=lambda j: v[j])
        elif best < win[0]:
            low = min(v[j] for j in win)
            best = max(j for j in win if v[j] == low)
        elif v[i] < v[best]:
            best = i
        out.append(best)
    return out


@given(st.lists(st.integers(0, 3), min_size=1, max_size=40), st.integers(1, 8))
def test_sliding_minimum(v, w):
    assert K.sliding_minimum(v, w) == slow_minimum(v, w)


def one(seq: bytes, l, s, density):
    return [x.tolist() for x in K.syncmers(np.frombuffer(seq, dtype=np.uint8), np.array([0, len(seq)]), l, s, density)[1:]]


def test_syncmers_cut_at_unclear_letters():
    s = "".join(random.Random(1).choice("ACGT") for _ in range(300))
    a, h = one(s.encode(), 11, 4, 0.5)
    b, g = one((s + "N" + s).encode(), 11, 4, 0.5)
    assert a and b == a + [x + 301 for x in a] and g == h + h
    every, _ = one(s.encode(), 11, 0, 0.5)
    assert len(every) > len(a)
    assert one(b"ACG", 11, 4, 0.5) == [[], []] and one(b"", 11, 4, 0.5) == [[], []]


@given(st.lists(st.text("ACGTNA", max_size=60), max_size=5), st.sampled_from([(7, 3), (8, 2), (5, 4)]))
def test_syncmers_of_a_batch(seqs, ls):
    """Against a walk over each clear piece of each sequence; few letters make many ties."""
    l, s = ls
    want = []
    for row, seq in enumerate(seqs):
        for m in re.finditer("[ACGT]+", seq):
            code = np.array(["ACGT".index(c) for c in m.group()], dtype=np.uint8)
            if len(code) < l:
                continue
            small = K.mix_masked(K.two_bit(code, s), 4**s - 1).tolist()
            whole = K.mix_masked(K.two_bit(code, l), 4**l - 1).tolist()
            for i, low in enumerate(K.sliding_minimum(small, l - s + 1)):
                if low == i + -(-(l - s + 1) // 2) - 1 and whole[i] <= int(0.5 * 4.0**l):
                    want.append((row, m.start() + i, whole[i]))
    data = np.frombuffer("".join(seqs).encode(), dtype=np.uint8)
    got = K.syncmers(data, np.concatenate([[0], np.cumsum([len(x) for x in seqs])]).astype(np.int64), l, s, 0.5)
    assert list(zip(*(x.tolist() for x in got))) == want


def test_mix_is_invertible_on_small_masks():
    x = np.arange(4**6, dtype=np.uint64)
    assert len(np.unique(K.mix_masked(x, 4**6 - 1))) == 4**6


def test_parameters():
    for bad in ({"k": 1}, {"density": 0.7}, {"density": 0}, {"min_abundance": 0}, {"scheme": "x"}, {"scheme": "syncmers", "s": 12}):
        with pytest.raises(ValueError):
            Params(**bad)
