"""Lists that are corrected together, and the array-free identity, against the plain definitions."""

import random

from strandloom import consensus


def test_lists_are_corrected_together(monkeypatch):
    r = random.Random(5)
    calls = []
    plain = consensus.align_all
    monkeypatch.setattr(consensus, "align_all", lambda jobs, both=False: calls.append(len(jobs)) or plain(jobs, both))

    def noisy(true):
        out = [x if r.random() < 0.9 else r.randrange(6) for x in true if r.random() > 0.1]
        return out[::-1] if r.random() < 0.5 else out

    def texts(m):
        return [r.choice("ACGT") for _ in m[1:]]

    jobs = []
    for size in (20, 30, 8, 1, 25, 14):
        true = [r.randrange(6) for _ in range(size)]
        others = [(m, texts(m), texts(m), 1 + r.randrange(3)) for m in (noisy(true) for _ in range(5))]
        own = noisy(true)
        jobs.append((own, texts(own), others))
    found = consensus.correct_all(jobs)
    assert len(calls) == max(sum(len(o[0]) > 1 for o in others) for own, _, others in jobs if len(own) > 1)  # and not one for each list
    assert found == [consensus.correct(*job) for job in jobs]


def test_identity_keeps_no_rows_of_scores(monkeypatch):
    r = random.Random(6)
    b = "".join(r.choice("ACGT") for _ in range(300))
    a = "".join(x for x in b[20:280] if r.random() > 0.05)
    steps = []
    plain = consensus.np.maximum.accumulate

    class Counted:
        accumulate = staticmethod(lambda *x, **y: steps.append(1) or plain(*x, **y))

    monkeypatch.setattr(consensus.np, "maximum", Counted)
    assert consensus.identity(a, b) == len(a) / 260  # every letter of a, and those that it lacks between its ends
    assert not steps
