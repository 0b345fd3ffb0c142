"""Training-data operators against brute force, on small tables with nulls, empty and long values, ties and repeated rows."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandloom.llm import encode, heavy, mixing, runs, seen, spans, subjects, terms

RNG = random.Random(7)


def rows(df):
    return sorted(tuple(r) for r in df.collect())


# -- runs ---------------------------------------------------------------------------------------------------------------------

def brute_runs(seq, least, gap):
    s = "".join(seq.split()).upper().replace("U", "T")
    found = (m for b in "ACGT" for m in re.finditer(f"{b}+(?:[^ACGT]{{1,{gap}}}{b}+)*", s))
    return [(m.start(), m.group().count(m.group()[0]), len(m.group())) for m in found if m.group().count(m.group()[0]) >= least]


def brute_agglomeration(seq, least, gap, similarity):
    """Merges the best pair of neighbours of the whole sequence, one by one."""
    s = "".join(seq.split()).upper().replace("U", "T")
    have = [[m.start(), m.end(), m.end() - m.start(), m.group()[0]] for m in re.finditer("A+|C+|G+|T+", s)]
    while True:
        best = None
        for i, (a, b) in enumerate(zip(have, have[1:])):
            share = (a[2] + b[2]) / (b[1] - a[0])
            if a[3] == b[3] and b[0] - a[1] <= gap and share >= similarity and (best is None or share > best[0]):
                best = share, i
        if best is None:
            return sorted((a, n, z - a) for a, z, n, _ in have if n >= least)
        a, b = have[best[1]], have.pop(best[1] + 1)
        a[1], a[2] = b[1], a[2] + b[2]


@pytest.mark.parametrize("gap, similarity", [(1, 0.5), (3, 0.8), (4, 0.9)])
def test_runs_match_brute_force(spark, gap, similarity):
    data = [(None, "AAAAAAAAAA", 1), ("e", "", 1), ("n", None, 1), ("star", "*", 1), ("blank", " \n ", 1), ("u", "uuuUUTTTTNTT", 2), ("alt", "ATATATATATATATATAT", 3), ("é", "AAAAéAAAAA-A", 4)]
    data += [("pure", "AAAAGAAAA", 1), ("near", "AANNNAAAANAAAAAAANNAAANA", 1)]
    data += [(f"r{i}", "".join(RNG.choice("AACNN\nG" if i % 2 else "AACGTn\n") for _ in range(RNG.randint(1, 400))), i) for i in range(60)]
    data += [("long", "ACGT" * 5000 + "A" * 5000, 0)]
    data += data[:20]  # delivered again
    df = spark.createDataFrame(data, "read_id string, seq string, run_start int").repartition(5)
    brute = (lambda s: brute_runs(s, 4, gap)) if similarity == 0.5 else (lambda s: brute_agglomeration(s, 4, gap, similarity))
    want = sorted({(i, *r) for i, s, _ in data if i is not None and s for r in brute(s)})
    got = rows(runs.collapse_runs(df, "read_id", "seq", 4, gap, similarity).select("id", "run_start", "n_events", "run_span"))
    assert got == want


def test_runs_similarity_limit_merges_best_first():
    # A-AA--AA: gaps of 1 and 2; the purest neighbours merge first, and impure ones never
    assert runs.agglomerate([0, 2, 6], [1, 4, 8], max_gap=2, min_similarity=0.7) == [(0, 3, 4), (6, 2, 2)]
    assert runs.agglomerate([0, 2, 6], [1, 4, 8], max_gap=2, min_similarity=0.5) == [(0, 5, 8)]


def test_runs_of_empty_table(spark):
    assert rows(runs.collapse_runs(spark.createDataFrame([], "read_id string, seq string"), "read_id", "seq", 3)) == []
    with pytest.raises(ValueError):
        runs.collapse_runs(spark.createDataFrame([], "read_id string, seq string"), "read_id", "seq", 0)


# -- terms --------------------------------------------------------------------------------------------------------------------

def test_terms_match_brute_force_with_a_hot_term(spark):
    data = [(0, 5, RNG.randint(0, 300)) for _ in range(3000)] + [(RNG.randint(0, 1), RNG.randint(0, 40), RNG.randint(0, 99)) for _ in range(2000)]
    data += [(None, 1, 1), (0, None, 1), (0, 1, None)]
    df = spark.createDataFrame(data, "field int, item bigint, rec bigint").withColumn("occurrences", F.lit(1))
    whole = [d for d in data if None not in d]
    occ, recs = Counter((f, x) for f, x, _ in whole), Counter((f, x) for f, x, _ in set(whole))
    assert rows(terms.term_counts(df)) == sorted((*k, occ[k], recs[k]) for k in occ)
    assert rows(terms.term_counts(df.limit(0))) == []


def test_marks(spark):
    counts = spark.createDataFrame([(0, 1, 9, 1), (0, 2, 50, 40), (0, 3, 12, 12), (0, 4, 5, 5)], "field int, item bigint, occurrences bigint, records bigint")
    totals = spark.createDataFrame([(0, 100)], "field int, n_records bigint")
    got = {r["item"]: r["mark"] for r in terms.marked(counts, totals, {0: 0.1}).collect()}
    assert got == {1: "rare", 2: "common", 3: "common", 4: None}


# -- spans --------------------------------------------------------------------------------------------------------------------

def brute_shared(lists, k):
    has = defaultdict(set)
    canon = lambda w: min(tuple(w), tuple(w[::-1]))
    for i, m in lists.items():
        for a in range(len(m) - k + 1):
            has[canon([-1 if x is None else x for x in m[a : a + k]])].add(i)
    out = []
    for i, m in lists.items():
        hit = set()
        for a in range(len(m) - k + 1):
            if len(has[canon([-1 if x is None else x for x in m[a : a + k]])]) > 1:
                hit.update(range(a, a + k))
        for a in sorted(hit):
            if a - 1 not in hit:
                z = a
                while z + 1 in hit:
                    z += 1
                out.append((i, a * 10, z * 10))
    return sorted(out)


def test_spans_match_brute_force(spark):
    base = [RNG.randint(0, 10**9) for _ in range(120)]
    lists = {}
    for i in range(40):
        a, n = RNG.randint(0, 100), RNG.randint(0, 30)
        m = base[a : a + n]
        if i % 3 == 0:
            m = m[::-1]
        if i % 4 == 0 and len(m) > 10:
            m[5] = None if i % 8 == 0 else 1
        if i % 5 == 0:
            m = m + [77] * 9 + m[:6] + [77] * 7  # repeats inside a list
        lists[f"r{i}"] = m
    lists["one"], lists["none"] = [5], []
    data = [(i, m, [10 * x for x in range(len(m))], 0, "x") for i, m in lists.items()] + [(None, base, list(range(120)), 0, "x"), ("nolist", None, None, 0, "x")]
    data += data[:9]
    df = spark.createDataFrame(data, "read_id string, minims array<bigint>, pos array<int>, rec int, id string").repartition(3)
    got = rows(spans.shared_stretches(df, "read_id", "minims", "pos", 4).select("id", "start_pos", "end_pos"))
    assert got == brute_shared(lists, 4)
    assert rows(spans.shared_stretches(df.limit(0), "read_id", "minims", "pos", 4)) == []


def test_passages_bridge_differences(spark):
    m = list(range(100, 140))
    other = m[:15] + [1, 2] + m[16:]
    data = [("a", m, []), ("b", other, []), ("c", other[::-1], [])]
    df = spark.createDataFrame(data, "read_id string, minims array<bigint>, pos array<int>")
    found = {(r.id, r.partner): r for r in spans.fuzzy_passages(df, "read_id", "minims", F.lit(True), 4, 8).collect()}
    best = [r for r in found.values() if {r.id, r.partner} == {"a", "b"} or {r.id, r.partner} == {"a", "c"}]
    assert best and all(r.matched == 39 and r.identity > 0.9 for r in best)
    assert any(r.back for r in best) or any(r.back for r in found.values())


def test_passages_of_every_pair(spark):
    """A third record holds part of each passage, windows repeat, runs of one element, palindromes: against common stretches by brute force."""
    rng = random.Random(5)
    base = [rng.randint(0, 10**9) for _ in range(60)]
    lists = {"a": base[:40], "b": base[:40], "c": base[10:25], "d": base[5:30][::-1], "e": base[:13] + [7] * 15 + base[40:], "f": [7] * 13, "g": [9] + [7] * 14 + [8] * 13}
    lists |= {"h": base[3:18] + [1] + base[3:18], "i": [8] * 14 + [5] + [7] * 5, "j": base[40:50] + base[40:50][::-1], "k": base[38:52], "l": base[30:45] + [None] * 12, "m": [None] * 13 + base[40:]}
    for x in range(8):
        at = rng.randint(0, 45)
        lists[f"x{x}"] = (base[at : at + 15] + [3, 4] * rng.randint(0, 8))[:: rng.choice((1, -1))]
    df = spark.createDataFrame([*lists.items(), *lists.items(), (None, base), ("n", None)], "read_id string, minims array<bigint>").repartition(3)
    of = {r.id: r.of for r in spans.copies(df, "read_id", "minims").collect()}
    assert set(of) == set(lists) and all((of[x] == of[y]) == (lists[x] == lists[y]) for x in lists for y in lists) and of["a"] == of["b"]
    found = spans.fuzzy_passages(df, "read_id", "minims", F.lit(True), 4, 12).collect()
    got, members = defaultdict(list), defaultdict(dict)
    for r in found:
        if r.partner is None:
            members[r.run][r.id] = r.matched
        else:
            got[r.id, r.partner].append(r)
    for x, a in lists.items():
        for y, b in lists.items():
            if of[x] == of[y]:
                continue
            x, y = of[x], of[y]
            for back in (False, True):
                other = b[::-1] if back else b
                for i in range(len(a)):
                    for j in range(len(other)):
                        n = 0
                        if i == 0 or j == 0 or a[i - 1] != other[j - 1]:
                            while i + n < len(a) and j + n < len(other) and a[i + n] == other[j + n]:
                                n += 1
                        if n < 12:
                            continue
                        if len(set(a[i : i + n])) == 1:
                            assert any(m.get(x, 0) >= n and m.get(y, 0) >= n for m in members.values()), (x, y)
                            continue
                        j0 = len(b) - j - n if back else j
                        assert any(r.back == back and r.i0 <= i and i + n <= r.i1 and r.j0 <= j0 and j0 + n <= r.j1 for r in got[x, y]), (x, y, back, i, j, n)
    few = spans.fuzzy_passages(df, "read_id", "minims", F.col("read_id").isin("b", "e"), 4, 12).where("partner IS NOT NULL").collect()
    assert sorted(map(repr, few)) == sorted(repr(r) for r in found if r.partner is not None and r.id in (of["b"], "e"))
    assert all(r.matched <= min(r.i1 - r.i0, r.j1 - r.j0) for rs in got.values() for r in rs)
    assert members[7] == {"e": 15, "f": 13, "g": 14} and members[8] == {"g": 13, "i": 14}
    assert spans.fuzzy_passages(df.limit(0), "read_id", "minims", F.lit(True), 4, 12).collect() == []


def test_chain_prefers_collinear_blocks():
    i, j, n = [0, 10, 20], [0, 50, 20], [5, 5, 5]
    assert spans.chain_blocks(i, j, n, 0.1) == [[0, 2], [1]]


def test_gap_matches():
    def slow(a, b):
        return 0 if not a or not b else max(slow(a[1:], b), slow(a, b[1:]), slow(a[1:], b[1:]) + 1 if a[0] == b[0] else 0)

    for _ in range(60):
        a, b = ([RNG.choice([1, 2, 3, None]) for _ in range(RNG.randint(0, 6))] for _ in "ab")
        assert spans.gap_matches(a, b) == slow(a, b)


# -- heavy items --------------------------------------------------------------------------------------------------------------

def test_mix_is_invertible():
    x = np.array([0, 1, -1, 2**62, -(2**63), 12345], dtype=np.int64)
    assert (heavy.unmix(heavy.mix(x.view(np.uint64))).astype(np.int64) == x).all()


def test_heavy_items(spark):
    items = [x for x in range(60) for _ in range(1000 - 15 * x)] + [RNG.randint(10**6, 10**9) for _ in range(5000)] + [-5] * 1000
    data = [(items[i : i + 50] + [None], i) for i in range(0, len(items), 50)] + [(None, 0), ([], 0)]
    df = spark.createDataFrame(data, "v array<bigint>, n int").repartition(4)
    want = sorted(Counter(items).items(), key=lambda x: (-x[1], x[0]))[:10]
    got = heavy.top_items(df, "v", 10).orderBy(F.desc("n"), "item").collect()
    assert [(r["item"], r["n"]) for r in got] == want
    assert all(abs(r["est_count"] - r["n"]) < 200 for r in got)
    assert rows(heavy.top_items(df.limit(0), "v", 3)) == []


def test_heavy_items_of_a_flat_column(spark):
    """No item stands out: neither sketch can be sure, so all are counted."""
    items = [7 * x for x in range(4000) for _ in range(3)] + [70, 140, 140]
    df = spark.createDataFrame([(x,) for x in items] + [(None,)], "v bigint").repartition(3)
    want = sorted(Counter(items).items(), key=lambda x: (-x[1], x[0]))[:5]
    for attempts in (((64, 16), (128, 32)), ((64, 16), (8192, 4096)), heavy.ATTEMPTS):
        assert sorted(((r["item"], r["n"]) for r in heavy.top_items(df, "v", 5, attempts).collect()), key=lambda x: (-x[1], x[0])) == want


# -- seen ---------------------------------------------------------------------------------------------------------------------

def test_seen_in_order_of_arrival(spark):
    keys = [[1, 2], [2, 1], [1, 2, None], [None, 1, 2], [1, 2], None, [], [3]] + [[RNG.randint(0, 3)] for _ in range(60)]
    data = list(enumerate(keys))
    RNG.shuffle(data)
    df = spark.createDataFrame(data, "no2 int, l array<bigint>").withColumn("kind", F.lit("clash"))
    ids = spark.createDataFrame([(5, 1), (3, 1), (9, 1), (4, None), (1, 2)], "no2 int, l bigint")
    records = seen.arrivals(df, "list", seen.list_key("l"), "no2").union(seen.arrivals(ids, "id", seen.id_key("l"), "no2"))
    got = {(r.kind, r.no): r.repeat for r in seen.decide(records, 3).collect()}
    past, want = set(), {}
    for no, k in sorted(data):
        if k:
            want["list", no] = tuple(k) in past
            past.add(tuple(k))
    want |= {("id", 1): False, ("id", 3): False, ("id", 5): True, ("id", 9): True}
    assert got == want
    firsts = seen.exact_firsts(df, "list", "l", "no2").union(seen.exact_firsts(ids, "id", "l", "no2"))
    wrong = seen.wrong_answers(firsts, seen.decide(records, 2)).collect()
    assert sum(r.n_wrong for r in wrong) == 0 and sum(r.n_repeats for r in wrong) == sum(want.values())
    # a key that takes all ids for one: arrival 1 (id 2) comes first, so arrival 3, the first of id 1, is wrongly a repeat
    one = seen.arrivals(ids, "id", [F.when(F.col("l").isNotNull(), F.lit(7).cast("bigint")), F.lit(0).cast("bigint")], "no2")
    bad = seen.wrong_answers(seen.exact_firsts(ids, "id", "l", "no2"), seen.decide(one, 2)).first()
    assert (bad.n_records, bad.n_repeats, bad.n_wrong) == (4, 3, 1)


def test_seen_empty(spark):
    none = spark.createDataFrame([], "no bigint, l bigint")
    assert rows(seen.decide(seen.arrivals(none, "id", seen.id_key("l"), "no"), 2)) == []


# -- mixing -------------------------------------------------------------------------------------------------------------------

def documents(spark, n=400):
    text = lambda i: "word " * (1 + i % 40)
    data = [(i, text(i), [" A", "a", "b", "B ", "c", "other", None][i % 7 if i % 50 else 6], f"repo{i % 5}", "py", 0) for i in range(n)]
    data += [(n, None, "a", None, None, 0), (n + 1, "", "b", "repo1", "py", 0), (n + 2, "x" * 200_000, "a", "repo1", "py", 0)]
    return spark.createDataFrame(data, "doc_id bigint, text string, source string, repo string, lang string, n_tokens int")


def test_mixing_meets_shares_and_caps(spark):
    targets = mixing.read_targets(spark.createDataFrame([("a", 0.5, 1), ("b", 0.3, 2), ("c", 0.2, 3), (None, 0.1, 1)], "source string, target_share double, max_repeats int"))
    members = mixing.memberships(documents(spark), targets)
    assert np.abs(mixing.fit_rates(members, targets).error).max() < mixing.TOLERANCE
    chosen = mixing.choose(members, targets)
    assert chosen.where("soft AND repeats > 1").count() == 0  # they may be of the source that allows no repeats
    got = {r.source: r for r in mixing.shares(chosen, targets).collect()}
    for s, share, cap in (("a", 0.5, 1), ("b", 0.3, 2), ("c", 0.2, 3)):
        assert abs(got[s].expected_share - share) < 0.02 and got[s].most_repeats <= cap and got[s].too_large == (25000 if s == "a" else 0)
    assert chosen.count() == 403 and chosen.where("n_tokens = 0 AND repeats > 0").count() == 0


def test_mixing_without_targets_or_documents(spark):
    targets = mixing.read_targets(spark.createDataFrame([("a", 0.5, 1)], "source string, target_share double, max_repeats int"))
    none = documents(spark).limit(0)
    assert mixing.choose(mixing.memberships(none, targets), targets).count() == 0
    assert [r.tokens for r in mixing.shares(mixing.choose(mixing.memberships(none, targets), targets), targets).collect()] == [0]
    empty = mixing.read_targets(spark.createDataFrame([], "source string, target_share double, max_repeats int"))
    assert mixing.choose(mixing.memberships(documents(spark, 20), empty), empty).where("repeats > 0").count() == 0


# -- subjects -----------------------------------------------------------------------------------------------------------------

WORDS = {"sport": "goal racket umpire relay hurdle".split(), "law": "notary tribunal verdict lessee statute".split(), "music": "chord tempo octave violin sonata".split()}


def subject_doc(subs, rng):
    lines = []
    for s in subs:
        lines += [f"// {rng.choice(WORDS[s])} and {rng.choice(WORDS[s])}s" if rng.random() < 0.5 else f"let {rng.choice(WORDS[s])}Value = 'plain';" for _ in range(6)]
    lines += [f"let x{i} = getValue({i});" for i in range(5)]
    rng.shuffle(lines)
    return "\n".join(lines)


def test_subjects_held_out(spark):
    rng = random.Random(3)
    truth = {i: {s for s in WORDS if rng.random() < 0.3} for i in range(500)}
    docs = [(i, subject_doc(t, rng), rng.choice(["a", None]), 1) for i, t in truth.items()] + [(900, None, "a", 1), (901, "  ", "a", 1), (None, subject_doc({"law"}, rng), "a", 1)]
    labels = [(i, s) for i in range(250) for s in (truth[i] or {"none"})] + [(0, "none"), (None, "law"), (3, None), (10**9, "law"), (4, "unknown")]
    labels += labels[:40]
    out = subjects.classify(
        spark.createDataFrame(docs, "doc_id bigint, text string, source string, labels int"), spark.createDataFrame([(s, "") for s in WORDS] + [(None, "")], "subject string, about string"),
        spark.createDataFrame(labels, "doc_id bigint, subject string"),
    )
    got = {r.doc_id: set(r.subjects) for r in out.collect()}
    assert len(got) == 503 and got[900] == got[901] == set() and got[None] == {"law"}
    right = sum(got[i] == truth[i] for i in range(250, 500))
    assert right >= 240


def test_subjects_without_labels(spark):
    docs = spark.createDataFrame([(1, "goal goal", "a")], "doc_id bigint, text string, source string")
    names = spark.createDataFrame([("sport",)], "subject string")
    assert [r.subjects for r in subjects.classify(docs, names, spark.createDataFrame([], "doc_id bigint, subject string")).collect()] == [[]]


# -- encoding -----------------------------------------------------------------------------------------------------------------

TRICKY = ["", " ", "\n", "don't we'll I've he'd 'tis ''s", "a  b\n\n c\t", "naïve Ωμέγα 日本語 ١٢٣  x　y", "x" * 5000, "ab" * 3000 + " \n" * 50, "<|endoftext|>", "\x00\x1c\x85", "aaaaaaaa" * 30, "'re're'", "  'll"]


def test_encoding_equals_the_library(spark):
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(encode.VOCABULARY)
    t.encode_special_tokens = True
    letters = "ab 'sl\n\t1.é日"
    texts = TRICKY + ["".join(RNG.choice(letters) for _ in range(RNG.randint(0, 60))) for _ in range(500)]
    df = spark.createDataFrame([(i, x, 1) for i, x in enumerate(texts)] + [(-1, None, 1), (None, "x", 1)], "doc_id bigint, text string, ids int").repartition(3)
    got = {r.doc_id: r.ids for r in encode.encode_texts(df, "doc_id", "text").collect()}
    assert got[-1] == [] and got[0] == []
    for i, e in enumerate(t.encode_batch(texts, add_special_tokens=False)):
        assert got[i] == e.ids, texts[i]
    counts = {r.doc_id: r.n_tokens for r in encode.count_tokens(df, "doc_id", "text", ["doc_id"]).collect()}
    assert counts == {i: len(x) for i, x in got.items()}
    assert rows(encode.encode_texts(df.limit(0), "doc_id", "text")) == []
