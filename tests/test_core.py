"""Core operators against brute force on small tables."""

import math
import random
from collections import Counter, defaultdict
from dataclasses import replace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from strandloom import consensus, kernels, session
from strandloom.functions import dna
from strandloom.kernels import reverse_complement
from strandloom.operators import analytics, basespace, correct, graph, junctions, kminmers, minspace, sizes
from strandloom.operators.balance import balanced_aggregate, balanced_join, pack, plan_placement
from strandloom.params import Params, autodetect, sample_lengths
from strandloom.plans import pipeline
from strandloom.sources import formats
from strandloom.streaming.counts import stream_counts

RNG = random.Random(11)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def dna_text(n, seed=0):
    r = random.Random(seed)
    return "".join(r.choice("ACGT") for _ in range(n))


# -- placement of skewed keys -------------------------------------------------------------------------------------------------

def test_pack_is_even():
    where = pack([(10, "a"), (9, "b"), (5, "c"), (5, "d"), (1, "e")], 3)
    load = Counter()
    for n, x in [(10, "a"), (9, "b"), (5, "c"), (5, "d"), (1, "e")]:
        load[where[x]] += n
    assert max(load.values()) == 10


def skewed(spark):
    data = [(1, i, None) for i in range(4000)] + [(RNG.randint(2, 500), i, "x") for i in range(4000, 8000)] + [(None, 9000, "n"), (None, 9001, "n")]
    return spark.createDataFrame(data, "k bigint, v bigint, load string").repartition(5)


def test_balanced_aggregate_spreads_the_hot_key(spark):
    df = skewed(spark)
    placed = plan_placement(df, ["k"], tasks=8).place(df, ["k"], ["v"])
    sizes = [r["count"] for r in placed.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == 8002 and max(sizes) < 1.5 * 8002 / 8
    got = balanced_aggregate(placed, ["k"], {"n": F.count("*"), "s": F.sum("v")}, {"n": F.sum("n"), "s": F.sum("s")})
    assert rows(got) == rows(df.groupBy("k").agg(F.count("*").alias("n"), F.sum("v").alias("s")))


def test_balanced_join(spark):
    df = skewed(spark)
    other = spark.createDataFrame([(1, "one"), (1, "uno"), (3, "three"), (None, "null"), (999, "none")], "k bigint, name string")
    for how in ("inner", "left", "left_semi", "left_anti"):
        assert rows(balanced_join(df, other, ["k"], ["v"], how)) == rows(df.join(other, "k", how)), how
    with pytest.raises(ValueError):
        balanced_join(df, other, ["k"], ["v"], "full")
    assert rows(balanced_join(df.limit(0), other, ["k"], ["v"])) == []
    assert len(rows(balanced_join(df, other.limit(0), ["k"], ["v"], "left"))) == 8002


def test_weights_may_be_null(spark):
    df = spark.createDataFrame([(1, None), (1, -5), (2, 10)], "k bigint, w bigint")
    placed = plan_placement(df, ["k"], weight="w", tasks=2).place(df, ["k"], ["w"])
    assert rows(placed.select("k", "w")) == rows(df)


# -- column functions ---------------------------------------------------------------------------------------------------------

def test_sequence_functions(spark):
    df = spark.createDataFrame([("AACCGNNTRR", [3, 1, 2], [2, 1, 3]), ("ac\ngu", [1, 2, 1], []), (None, None, None), ("", [], [])], "s string, a array<bigint>, b array<bigint>")
    got = df.select(dna.collapse_runs("s"), dna.reverse_complement(dna.clean_seq("s")), F.size(dna.windows("a", 2)), dna.is_reversed(F.col("a")), dna.canonical(F.col("a"))).collect()
    assert [tuple(r) for r in got] == [("ACGNTRR", "NNANNCGGTT", 2, True, [2, 1, 3]), ("ac\ngu", "ACGT", 2, True, [1, 2, 1]), (None, None, 0, None, None), ("", "", 0, True, [])]
    d = df.select(*[F.round(dna.set_distance(F.col("a"), F.col("b"), k), 6) for k in ("jaccard", "containment", "mash")]).collect()
    assert tuple(d[0]) == (0, 0, 0) and tuple(d[1]) == (1, 1, 1) and tuple(d[3]) == (None, None, None)
    assert df.select(dna.fold(F.lit("x" * 161))).first()[0] == "x" * 80 + "\n" + "x" * 80 + "\nx"
    assert df.select(dna.fold(F.lit("x" * 160))).first()[0] == "x" * 80 + "\n" + "x" * 80
    assert df.select(dna.shown(F.col("a"))).first()[0] == "[3, 1, 2]"


# -- k-min-mers ---------------------------------------------------------------------------------------------------------------

def lists_frame(spark, lists):
    return spark.createDataFrame([(f"r{i:03}", m, [7 * j for j in range(len(m or []))]) for i, m in enumerate(lists)], "read_id string, minims array<bigint>, pos array<int>")


def test_counts_and_representatives(spark):
    lists = [[RNG.randint(0, 4) for _ in range(RNG.randint(0, 14))] for _ in range(40)] + [None, [], [1, 2, 3], [1, 2, 3, 4], [1, 2, 1, 9]]
    df = lists_frame(spark, lists)
    for strict in (True, False):
        occ = defaultdict(list)
        for i, m in enumerate(lists):
            if m and (len(m) > 3 if strict else len(m) >= 3):
                for a in range(len(m) - 2):
                    w = m[a : a + 3]
                    occ[tuple(min(w, w[::-1]))].append((f"r{i:03}", a, not w < w[::-1]))
        got = {tuple(r.kmer): r.abundance for r in kminmers.counts(df, 3, 1, strict).collect()}
        assert got == {k: len(v) for k, v in occ.items()}
        for m in (1, 2, 3):
            got = {tuple(r.kmer): (r.read_id, r.start, r.rev, r.seqlen) for r in kminmers.nodes(df, 3, m, strict).collect()}
            want = {k: (sorted(v)[m - 1][0], 7 * sorted(v)[m - 1][1], sorted(v)[m - 1][2], 16) for k, v in occ.items() if len(v) >= m}
            assert got == want


def test_common_windows_are_reduced_before_their_shuffle(spark):
    df = lists_frame(spark, [[1, 2, 3, 4], [4, 3, 2, 1], [1, 2, 3, 9]] * 50)
    batch = df.coalesce(1).toArrow().to_batches()[0]
    got = kminmers._first_places(batch, 3, 2).to_pylist()
    assert [(r["n"], r["read_id"], r["i"]) for r in got if (r["read_id"], r["i"]) in (("r000", 0), ("r001", 1))] == [(150, "r000", 0), (0, "r001", 1)]
    assert sorted(r["n"] for r in got) == [0, 0, 0, 50, 100, 150]
    # neither the shuffles' keys nor their rows hold the elements of windows
    plan = kminmers.nodes(kminmers.lists_once(df), 3)._jdf.queryExecution().executedPlan().toString()
    assert not [x for x in plan.splitlines() if "hashpartitioning(kmer" in x]
    got = {tuple(r.kmer): (r.abundance, r.read_id, r.start, r.rev) for r in kminmers.nodes(kminmers.lists_once(df), 3).collect()}
    assert got == {(1, 2, 3): (150, "r001", 7, True), (2, 3, 4): (100, "r001", 0, True), (2, 3, 9): (50, "r005", 7, False)}


def test_shifts_follow_the_direction(spark):
    df = spark.createDataFrame([("a", [1, 2, 3, 4], [0, 5, 7, 20]), ("b", [4, 3, 2, 1], [0, 13, 15, 20])], "read_id string, minims array<bigint>, pos array<int>")
    got = {(r.read_id, r.i): (r.kmer, r.shift_l, r.shift_r, r.span) for r in kminmers.occurrences(df, 3).collect()}
    assert got["a", 0] == ([1, 2, 3], 5, 2, 9) and got["b", 1] == ([1, 2, 3], 5, 2, 9)


def test_read_stats_and_coverage(spark):
    df = lists_frame(spark, [[1, 2, 3, 4], [4, 3, 2, 1], [9, 9, 9, 9], [1, 2]])
    known = kminmers.counts(df, 3)
    got = {r.read_id: r.counts for r in kminmers.read_stats(df, known.where("abundance < 3 AND kmer[0] <> 2"), 3).collect()}
    assert got == {"r000": [2, 0], "r001": [0, 2], "r002": [2, 2]}
    cov = {r.query_id: (r.n_kminmers, r.covered, r.pct) for r in kminmers.coverage(df.where("read_id = 'r000'"), df, 3).collect()}
    assert cov == {"r000": (2, 2, 100.0), "r001": (2, 2, 100.0), "r002": (2, 0, 0.0)}
    assert len(rows(kminmers.hits(df.where("read_id = 'r000'"), df.where("read_id = 'r001'"), 3))) == 2
    # r002 holds its window twice, r000 and r001 hold each other's in the other direction
    held = {(r.target_id, r.pos): r.n_hits for r in kminmers.hit_windows(df, df.where("read_id > 'r000'"), 3).collect()}
    assert held == {("r000", 0): 1, ("r000", 1): 1, ("r001", 0): 1, ("r001", 1): 1, ("r002", 0): 2, ("r002", 1): 2}
    one = kminmers.compare_sets(known.where("kmer[0] = 9"), known).first()
    assert (one.n_a, one.n_b, one.n_both, one.pct_a_in_b) == (1, 3, 1, 100.0)
    assert kminmers.compare_sets(known.limit(0), known.limit(0)).first().n_both == 0


def test_strand_symmetry(spark):
    seqs = [dna_text(900, i) for i in range(6)]
    p = Params(k=4, l=10, density=0.1, hpc=False)
    frame = lambda s: spark.createDataFrame([(f"r{i}", x) for i, x in enumerate(s)], "read_id string, seq string")
    a, b = (kminmers.counts(minspace.minimizers(frame(s), p), 4) for s in (seqs, [x if i % 2 else reverse_complement(x) for i, x in enumerate(seqs)]))
    assert rows(a) == rows(b)


def test_dictionary(spark):
    df = spark.createDataFrame([("a", ["ACC", "GGT", "TTT", None], [1, 1, 2, 3], [0, 4, 8, 9])], "read_id string, minimizers array<string>, minims array<bigint>, pos array<int>")
    assert rows(minspace.lmer_counts(df)) == [("AAA", 1), ("ACC", 2)]
    d = spark.createDataFrame([("GGT",)], "lmer string")
    assert [r.i for r in minspace.by_dictionary(df, d).collect()] == [0, 1]
    assert sorted(r.i for r in minspace.by_dictionary(df, d, keep=False).collect()) == [2, 3]


# -- graph --------------------------------------------------------------------------------------------------------------------

def brute_edges(nodes, presimp):
    out, gone = [], set()
    canon = lambda x: min(x, x[::-1])
    for n1, (a, ab1, len1, sl, sr) in nodes.items():
        for key in (canon(a[1:]), canon(a[:-1])):
            cand = []
            for n2, (b, ab2, len2, *_) in nodes.items():
                for _ in range((canon(b[:-1]) == key) + (canon(b[1:]) == key)):
                    for x, o1 in ((a, "+"), (a[::-1], "-")):
                        for y, o2 in ((b, "+"), (b[::-1], "-")):
                            if x[1:] == y[:-1]:
                                cand.append((n2, o1, o2, ab2, len2))
            ref = min(max([c[3] for c in cand], default=0), ab1)
            for n2, o1, o2, ab2, len2 in cand:
                if presimp and len(cand) >= 2 and ab2 < presimp * ref:
                    gone.add((n1, n2))
                else:
                    out.append((n1, o1, n2, o2, min(len1 - (sl if o1 == "+" else sr), len2 - 1)))
    return sorted(e for e in out if (e[0], e[2]) not in gone and (e[2], e[0]) not in gone)


def test_edges(spark):
    seen, nodes = set(), {}
    while len(nodes) < 60:
        k = [RNG.randint(0, 3) for _ in range(4)]
        k = tuple(min(k, k[::-1]))
        if k not in seen:
            seen.add(k)
            nodes[len(nodes)] = (list(k), RNG.choice([1, 5, 900, 1000]), RNG.randint(20, 60), RNG.randint(1, 9), RNG.randint(1, 9))
    df = spark.createDataFrame([(i, *v) for i, v in nodes.items()], "node_id bigint, kmer array<bigint>, abundance bigint, seqlen bigint, shift_l int, shift_r int")
    for presimp in (0.0, 0.25):
        assert rows(graph.edges(df, 4, presimp)) == sorted(brute_edges(nodes, presimp), key=repr)


def links(spark, data):
    return spark.createDataFrame(data, "n1 bigint, o1 string, n2 bigint, o2 string, overlap bigint")


def test_break_loops(spark):
    e = links(spark, [(1, "+", 1, "-", 3), (1, "+", 2, "+", 5), (2, "-", 1, "-", 4), (2, "+", 3, None, 1), (None, "+", 3, "+", 1), (3, "+", 2, "-", None)])
    assert rows(graph.break_loops(e)) == [(1, "+", 2, "+", 5), (3, "+", 2, "-", None)]


def test_components(spark):
    pairs = [(RNG.randint(0, 150), RNG.randint(0, 150)) for _ in range(110)] + [(200 + i, 201 + i) for i in range(60)] + [(300, 300)] + [(400, 401 + i) for i in range(50)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    e = links(spark, [(a, "+", b, "+", 1) for a, b in pairs] + [(None, "+", 5, "+", 1)])
    assert rows(graph.components(e)) == sorted(((x, find(x)) for x in root), key=repr)
    assert rows(graph.components(e.limit(0))) == []


def paths_of(df):
    out = defaultdict(list)
    for r in df.orderBy("unitig", "ord").collect():
        out[r.unitig].append((r.node_id, r.o))
    return sorted(out.values())


def test_unitigs(spark):
    chain = [(i, "+", i + 1, "+", 1) for i in range(20)]
    turned = [(31, "-", 30, "-", 1), (31, "+", 32, "-", 1)]  # 30+ 31+ 32-, partly written from the other side
    fork = [(40, "+", 41, "+", 1), (40, "+", 42, "+", 1), (41, "+", 43, "+", 1), (42, "+", 43, "+", 1)]
    circle = [(50, "+", 51, "+", 1), (51, "+", 52, "+", 1), (52, "+", 50, "+", 1)]
    loops = [(60, "+", 60, "+", 1), (61, "+", 61, "-", 1)]
    alone = spark.createDataFrame([(70,), (0,)], "node_id bigint")
    got = paths_of(graph.unitigs(links(spark, chain + turned + fork + circle + loops + [(1, None, 2, "+", 1)]), alone))
    assert [(i, "+") for i in range(21)] in got
    assert [(30, "+"), (31, "+"), (32, "-")] in got
    assert [(50, "+"), (51, "+"), (52, "+")] in got
    assert all([(n, "+")] in got for n in (40, 41, 42, 43, 60, 70))
    seen = Counter(n for p in got for n, _ in p)
    assert set(seen.values()) == {1}


def test_tips_and_bubbles(spark):
    main = [(i, "+", i + 1, "+", 1) for i in range(1, 8)]
    e = links(spark, main + [(4, "+", 90, "+", 1), (2, "+", 80, "+", 1), (80, "+", 4, "+", 1)])
    paths = graph.unitigs(e)
    nodes = spark.createDataFrame([(i, 10, 2, 2, 50 if i < 10 else 3) for i in [*range(1, 9), 80, 90]], "node_id bigint, seqlen bigint, shift_l int, shift_r int, abundance bigint")
    where = {r.node_id: r.unitig for r in paths.collect()}
    assert {r.unitig for r in graph.tips(e, paths, nodes, 3, 20).collect()} == {where[90], where[1]}
    stats = basespace.unitig_stats(paths, nodes)
    bubble = [r.unitig for r in graph.bubbles(e, paths, stats, 100).collect()]
    assert bubble == [where[80]]
    left = graph.without_unitigs(graph.both_sides(e), paths, spark.createDataFrame([(where[80],), (where[90],)], "unitig string"))
    assert not {80, 90} & {n for r in left.collect() for n in (r.n1, r.n2)}


def test_tips_with_unknown_lengths(spark):
    e = links(spark, [(i, "+", i + 1, "+", 1) for i in range(1, 20)] + [(10, "+", 90, "+", 1), (90, "+", 91, "+", 1), (91, "+", 92, "+", 1)])
    paths = graph.unitigs(e)
    nodes = spark.createDataFrame([(i, 10) for i in [*range(1, 21), 90, 91]], "node_id bigint, seqlen bigint")  # 92, the dead end, is unknown
    where = {r.node_id: r.unitig for r in paths.collect()}
    assert {r.unitig for r in graph.tips(e, paths, nodes, 3, 20).collect()} == {where[92]}
    assert graph.tips(e, paths, nodes, 2, 20).collect() == []


def test_n50(spark):
    df = spark.createDataFrame([(x,) for x in (80, 70, 50, 40, 30, 20, None)], "len bigint")
    assert tuple(graph.n50(df, "len").first()) == (6, 290, 70, 30)


# -- bases --------------------------------------------------------------------------------------------------------------------

def test_perfect_reads_give_the_genome_back(spark):
    genome = dna_text(6000, 5)
    reads = []
    for i, a in enumerate(range(0, 5001, 250)):
        s = genome[a : a + 1000]
        reads += [(f"f{i}", s), (f"r{i}", reverse_complement(s))]
    df = spark.createDataFrame(reads, "read_id string, seq string")
    done = pipeline.assemble(df, Params(k=5, l=12, density=0.05, hpc=False))
    found = done.contigs.collect()
    assert len(found) == 1 and len(found[0].seq) > 5500
    assert found[0].seq in genome or reverse_complement(found[0].seq) in genome
    full = pipeline.containment(df, df.where("read_id LIKE 'f%'"), Params(k=5, l=12, density=0.05, hpc=False))
    assert {r.pct for r in full.collect()} == {100.0}
    stats = pipeline.read_stats(df, Params(k=5, l=12, density=0.05, hpc=False)).collect()
    assert len(stats) == len(reads) and all(min(r.counts) >= 2 for r in stats)


def test_assembly_after_correction(spark, tmp_path):
    genome = dna_text(3000, 7)
    data = [(f"{a}.{x}", genome[a : a + 1000]) for a in range(0, 2001, 250) for x in range(2)]
    df = spark.createDataFrame(data, "read_id string, seq string")
    p = Params(k=5, l=12, density=0.05, hpc=False)
    done = correct.corrected(df, minspace.minimizers(df, p), p.l)
    formats.write_lines(formats.corrected_lines(done).withColumn("section", F.lit(0)), str(tmp_path / "lists"))
    again = formats.read_corrected(spark, str(tmp_path / "lists"))
    seqs = lambda x, **more: sorted(r.seq for r in pipeline.assemble_lists(x, x, p, **more).contigs.collect())
    found = seqs(again)
    assert found == seqs(done) == seqs(done, tip_length=500, bubble_length=500) and len(found) == 1 and len(found[0]) > 2800
    assert found[0] in genome or reverse_complement(found[0]) in genome
    assert pipeline.assemble_lists(done.limit(0), done.limit(0), p, tip_length=500).contigs.isEmpty()


def test_multi_k(spark):
    genome = dna_text(4000, 6)
    df = spark.createDataFrame([(f"{i}.{x}", genome[a : a + 1500]) for i, a in enumerate(range(0, 2501, 250)) for x in "ab"], "read_id string, seq string")
    found = pipeline.multi_k(df, Params(l=12, density=0.02, hpc=False), min_contig=1000, first_k=5, step=20)
    seqs = [r.seq for r in found.collect()]
    both = (genome, genome[::-1].translate(str.maketrans("ACGT", "TGCA")))
    assert max(map(len, seqs)) > 3900 and all(any(s in g for g in both) for s in seqs)


def test_assembly_cleans_tips_and_bubbles(spark):
    genome = dna_text(6000, 8)
    flip = lambda s, x: s[:x] + "".join("ACGT"[("ACGT".index(c) + 1) % 4] for c in s[x : x + 60]) + s[x + 60 :]
    end = lambda s: s[:700] + dna_text(300, 9)
    data = [(f"{a}.{x}", genome[a : a + 1000]) for a in range(0, 5001, 250) for x in range(4)]
    data += [(f"bubble{x}", flip(genome[1500:2500], 500)) for x in "ab"] + [(f"tip{x}", end(genome[3500:4500])) for x in "ab"]
    df = spark.createDataFrame(data, "read_id string, seq string")
    p = Params(k=5, l=12, density=0.05, hpc=False)
    both = (genome, genome[::-1].translate(str.maketrans("ACGT", "TGCA")))
    raw = [r.seq for r in pipeline.assemble(df, p).contigs.collect()]
    assert len(raw) > 3 and max(map(len, raw)) < 4000
    limits = {"tip_nodes": 60, "tip_length": 5000, "bubble_length": 1500, "rounds": 3}
    found = [r.seq for r in pipeline.multi_k(df, p, first_k=5, step=100, **limits).collect()]
    assert len(found) == 1 and len(found[0]) > 5500 and any(found[0] in g for g in both)


def test_overlap_repair(spark):
    e = links(spark, [(1, "+", 2, "+", 50), (1, "+", 2, "-", 10), (1, "+", 9, "+", 1), (1, "+", 2, "+", None)])
    sizes = spark.createDataFrame([(1, 40), (2, 30)], "node_id bigint, seqlen bigint")
    assert rows(basespace.repair_overlaps(e, sizes)) == [(1, "+", 2, "+", 29), (1, "+", 2, "-", 10)]


def test_autodetect(spark):
    df = spark.createDataFrame([("a", "A" * 4000), ("b", "A" * 2001), ("c", None)], "read_id string, seq string")
    assert tuple(sample_lengths(df).first()) == (3000, 4000)
    p = autodetect(df)
    assert (p.k, p.l, p.density) == (9, 12, 0.003)


# -- analyses -----------------------------------------------------------------------------------------------------------------

def test_interval_counts(spark):
    data = [(i, RNG.choice(["u", "v", None]), RNG.choice([None, RNG.randint(0, 300)]), RNG.randint(0, 40)) for i in range(300)]
    df = spark.createDataFrame(data, "id int, u string, s bigint, w int").withColumn("e", F.col("s") + F.col("w"))
    use = [(i, u, s, s + w) for i, u, s, w in data if u and s is not None and w > 5]
    want = sorted((i, sum(u == v and i != j and min(e, f) - max(s, t) > 5 for j, v, t, f in use)) for i, u, s, e in use)
    got = rows(analytics.overlap_counts(df, "u", "s", "e", 5, 25).select("id", "n_overlaps"))
    assert got == sorted(want, key=repr)


def test_similar_lists(spark):
    base = [list(range(100 * i, 100 * i + 20)) for i in range(5)]
    lists = []
    for b in base:
        lists += [b, b[::-1], b[:-1] + [7], b[:-2] + [7, 8], b + [5], b[:10]]
    lists += [[], None, [1], [1], [2, 2], [2, 2]]
    df = lists_frame(spark, lists)
    grams = lambda m: {tuple(min(m[i : i + 2], m[i : i + 2][::-1])) for i in range(len(m) - 1)}
    full = [m for m in lists if m]
    want = [sum(i != j and 1 - len(set(a) & set(b)) / len(set(a) | set(b)) < 0.15 and bool(grams(a) & grams(b)) for j, b in enumerate(full)) for i, a in enumerate(full)]
    got = [r.n_links for r in analytics.similar_lists(df).orderBy("read_id").collect()]
    assert got == want


def test_levenshtein_ball(spark):
    df = spark.createDataFrame([("ACGT",), (None,), ("AC",)], "l string")
    got = {r.other for r in analytics.levenshtein_ball(df, "l").where("lmer = 'ACGT'").collect()}
    inner = {"A" + x + "GT" for x in "ACGT"} | {"AC" + x + "T" for x in "ACGT"} | {"AGT", "ACT"} | {"A" + x + "CGT" for x in "ACGT"} | {"AC" + x + "GT" for x in "ACGT"}
    assert got == inner - {"ACGT"}


def test_samples_and_names(spark):
    paths = spark.createDataFrame([("u", 1), ("u", 2), ("w", 3)], "unitig string, node_id bigint")
    nodes = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b"), (3, None)], "node_id bigint, sample_id string")
    assert rows(analytics.unitig_samples(paths, nodes)) == [("u", 2)]
    names = spark.createDataFrame([("g1.c1",), ("g1.c2",), (None,)], "n string")
    assert rows(analytics.genome_ids(names, "n", ".")) == [("g1", 2)]


# -- consensus ----------------------------------------------------------------------------------------------------------------

def test_consensus_recovers_the_list():
    r = random.Random(2)
    true = [r.randrange(10**6) for _ in range(50)]

    def noisy():
        return [x if r.random() < 0.96 else r.randrange(10**6) for x in true if r.random() > 0.04]

    none = lambda m: [""] * (len(m) - 1)
    own = noisy()
    others = [(m, none(m), none(m), 1) for m in (noisy()[:: (-1 if i % 2 else 1)] for i in range(14))]
    found, texts = consensus.correct(own, none(own), others)
    assert found == true and len(texts) == len(found) - 1
    assert consensus.correct([1], [], others) == ([1], []) and consensus.correct(own, none(own), []) == (own, none(own))


def test_identity():
    assert consensus.identity("ACGT", "TTACGTAA") == 1.0 and consensus.identity("", "A") == 0.0
    assert consensus.identity("ACGAACGTTT", "TTACGTACGTTTAA") == 0.9
    assert consensus.identity(reverse_complement("ACGAACGTTT"), "TTACGTACGTTTAA") == 0.9


def test_correction_repairs_reads(spark):
    genome = dna_text(1200, 9)
    bad = genome[:600] + "A" * 3 + genome[603:]
    reads = spark.createDataFrame([(f"g{i}", genome) for i in range(5)] + [("bad", bad)], "read_id string, seq string")
    p = Params(k=3, l=10, density=0.1, hpc=False)
    lists = minspace.minimizers(reads, p)
    done = {r.read_id: r for r in correct.corrected(reads, lists, p.l, distance=0.4).collect()}
    assert done["bad"].minims == done["g0"].minims and done["bad"].seq in genome
    pairs = spark.createDataFrame([("x", "ACGT", "ACGT"), ("y", None, "A")], "read_id string, a string, b string")
    assert rows(correct.identities(pairs)) == [("x", 1.0), ("y", 0.0)]
    a = spark.createDataFrame([("x", 0.5), ("y", 0.9)], "read_id string, identity double")
    b = spark.createDataFrame([("x", 0.7), ("y", 0.9)], "read_id string, identity double")
    assert tuple(correct.compare_corrections(a, b).first())[:3] == (1, 1, 0)
    t = lambda d: spark.createDataFrame(d, "template string, recruit string")
    assert rows(correct.retrieval(t([("t", "a"), ("t", "b")]), t([("t", "b"), ("t", "c")]))) == [("t", 1, 1, 1)]


# -- files --------------------------------------------------------------------------------------------------------------------

def test_read_files(spark, tmp_path):
    (tmp_path / "a.fa").write_text(">r1 x\nACGT\nAC\n>r2\n\n>r3\nGG>T\n")
    assert rows(formats.read_reads(spark, str(tmp_path / "a.fa"))) == [("r1", "ACGTAC"), ("r2", ""), ("r3", "GG>T")]
    (tmp_path / "b.fq").write_text("@r1 y\nACGT\n+\n@@@@\n@r2\nGG\n+\nII\n")
    assert rows(formats.read_reads(spark, str(tmp_path / "b.fq"))) == [("r1", "ACGT"), ("r2", "GG")]
    assert formats.looks_like_fasta("x.fasta.gz") and not formats.looks_like_fasta("x.fastq.lz4") and formats.compression("x.lz4") == "lz4"
    for name, text in (("a.fa", "a.fa"), ("b.fq", "b.fq")):
        with pa.CompressedOutputStream(str(tmp_path / f"{name}.lz4"), "lz4") as f:
            f.write((tmp_path / text).read_bytes())
    assert rows(formats.read_reads(spark, str(tmp_path / "a.fa.lz4"))) == [("r1", "ACGTAC"), ("r2", ""), ("r3", "GG>T")]
    assert rows(formats.read_reads(spark, str(tmp_path / "b.fq.lz4"))) == [("r1", "ACGT"), ("r2", "GG")]
    many = "".join(f"line {i}\n" * 3 for i in range(100_000)) + "end"
    with pa.CompressedOutputStream(str(tmp_path / "many.txt.lz4"), "lz4") as f:
        f.write(many.encode())
    lines = formats.lz4_lines(spark, str(tmp_path / "many.txt.lz4"))
    assert lines.count() == 300_001 and lines.where("n = 299999 OR n = 300000").sort("n").select("line").collect() == [("line 99999",), ("end",)]
    (tmp_path / "c.txt").write_text("Parsing x\nid1 5 6\na: b\nid2 7\n")
    assert rows(formats.read_minspace_text(spark, str(tmp_path / "c.txt"))) == [("id1", [5, 6]), ("id2", [7])]
    (tmp_path / "d.txt").write_text("ACC 5\nGGT 7\nbad\n")
    assert rows(formats.read_lmer_counts(spark, str(tmp_path / "d.txt"))) == [("ACC", 7)]
    (tmp_path / "e.txt").write_text("ACCGG\nAC\nACCTT\n")
    assert rows(formats.read_lmer_list(spark, str(tmp_path / "e.txt"), 3)) == [("ACC",)]


def test_large_files_are_read_in_blocks(spark, tmp_path):
    conf, at, small = "spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", [(f"r{i}", "ACGT"[i % 4] * (i % 37 + 1)) for i in range(300)]
    for name, some in (("a.fq", small[:200]), ("b.fq", small[200:])):
        (tmp_path / name).write_bytes(b"".join(f"@{i} x\r\n{s}\n+\n@{s[1:]}\n".encode() for i, s in some))
    (tmp_path / "c.txt").write_text("".join(f"{i}\n{s}\n[5, 6]\n[]\n[0, {len(s)}]\n" for i, s in small))
    old = {x: spark.conf.get(x) for x in (conf, at)}
    try:
        spark.conf.set(conf, "700")
        spark.conf.set(at, "1")
        lines = formats.numbered_lines(spark, str(tmp_path / "a.fq"))
        assert lines.rdd.getNumPartitions() > 5 and [r.n for r in lines.sort("n").collect()] == list(range(800))
        assert rows(formats.read_fastq(spark, str(tmp_path / "*.fq"))) == sorted(small)
        assert rows(formats.read_corrected(spark, str(tmp_path / "c.txt"))) == sorted((i, s, [5, 6], [0, len(s)]) for i, s in small)
    finally:
        for x, y in old.items():
            spark.conf.set(x, y)


def test_n50_logs_and_subgraphs(spark, tmp_path):
    (tmp_path / "x.n50").write_text("assembly:/scratch/run-K11-L10-D0.001.msimpl.fa\nlargest:9\nN50:219850\nN90:7\nassembly:a/0.25-K31-L12-D0.003.fa\nN50:10\nassembly:1-K8-L12-D0.002.fa.n50\nN50:5\n")
    assert rows(formats.read_n50_logs(spark, str(tmp_path / "x.n50")).na.fill(-1)) == [(-1, 11, 10, 0.001, 219850), (0.25, 31, 12, 0.003, 10), (1, 8, 12, 0.002, 5)]
    s, p = spark.createDataFrame([("a",), ("b",), ("c",)], "name string"), spark.createDataFrame([("a", 1), ("c", 2)], "unitig string, x int")
    e = spark.createDataFrame([("a", "b"), ("b", "c")], "n1 string, n2 string")
    out = formats.subgraph_of(s, p, e, spark.createDataFrame([("a",), ("b",), ("b",), ("z",)], "name string"))
    assert [rows(x) for x in out] == [[("a",), ("b",)], [("a", 1)], [("a", "b")]]


def test_minimizers_and_bases_along_a_path(spark):
    seq = dna_text(60, 5)
    at, k, l = [0, 5, 11, 20, 26, 33, 40, 47], 4, 6  # windows of k elements begin at these letters
    minims = [100 + i for i in range(8)]
    kmers = [minims[i : i + k] for i in range(5)]
    node = [(i, min(w, w[::-1]), 3 - i, seq[at[i] : at[i + k - 1] + l]) for i, w in enumerate(kmers)]
    node[3] = (3, kmers[3][::-1], 0, kernels.reverse_complement(node[3][3]))  # stored the other way round
    nodes = spark.createDataFrame(node, "node_id bigint, kmer array<bigint>, abundance bigint, seq string")
    path = [("u", i, i, "-" if i == 3 else "+") for i in range(5)] + [("v", 0, 9, "+"), ("w", 0, 3, "+")]
    paths = spark.createDataFrame(path, "unitig string, ord bigint, node_id bigint, o string")
    chains = basespace.unitig_minimizers(paths, nodes)
    assert rows(chains) == [("u", minims), ("w", kmers[3][::-1])]
    assert rows(basespace.unitig_minimizers(paths, nodes, 0)) == [("u", minims)]
    node[3] = (3, kmers[3], 0, seq[at[3] : at[6] + l])
    whole = spark.createDataFrame(node, "node_id bigint, kmer array<bigint>, abundance bigint, seq string")
    # windows 0 and 3 cover the elements 0 to 6
    got = dict(rows(basespace.stepped_contigs(spark.createDataFrame([("u", minims), ("r", minims[:4][::-1]), ("x", [1, 2, 3, 4]), ("s", [1])], "unitig string, minims array<bigint>"), whole, k, l)))
    assert got == {"u": seq[: at[6] + l], "r": kernels.reverse_complement(seq[: at[3] + l])}


def test_labelled_templates_are_left_out(spark):
    rng = random.Random(4)
    data = [(i, j, rng.random()) for i in range(40) for j in rng.sample(range(40), 5) if i != j]
    df = spark.createDataFrame(data, "class_id bigint, other bigint, dist double")
    for threshold in (0, 1, 3):
        out = set()
        for i in range(40):
            if i not in out:
                out |= {j for _, j in sorted((d, j) for a, j, d in data if a == i)[:threshold] if j > i}
        assert {r[0] for r in correct.left_out(df, threshold).collect()} == out


def test_retrieval_distances(spark):
    lists = spark.createDataFrame([("t", [1, 2]), ("a", [1, 2]), ("b", [2, 3]), ("c", [9])], "id string, minims array<bigint>")
    found = spark.createDataFrame([("t", "a"), ("t", "b"), ("t", "a")], "template string, recruit string")
    truth = spark.createDataFrame([("t", "a"), ("t", "c"), ("t", "gone")], "template string, recruit string")
    got = {r.kind: (r.n, round(r.jaccard, 6), round(r.mash, 6)) for r in correct.retrieval_distances(found, truth, lists).collect()}
    assert got == {"tp": (1, 0.0, 0.0), "fp": (1, round(2 / 3, 6), round(0.1 * math.log(2), 6)), "fn": (1, 1.0, 1.0)}


def test_identity_and_template_ends_match_whole_tables():
    def whole(a, b):
        best = 0.0
        for x in (a, kernels.reverse_complement(a)):
            t = [[0] * (len(b) + 1)] + [[-(i + 1)] + [0] * len(b) for i in range(len(x))]
            for i in range(1, len(x) + 1):
                for j in range(1, len(b) + 1):
                    t[i][j] = max(t[i - 1][j - 1] + (1 if x[i - 1] == b[j - 1] else -1), t[i - 1][j] - 1, t[i][j - 1] - 1)
            i, j = len(x), max(range(len(b) + 1), key=lambda c: (t[-1][c], -c))
            same = columns = 0
            while i:
                columns += 1
                if j and t[i][j] == t[i - 1][j - 1] + (1 if x[i - 1] == b[j - 1] else -1):
                    same, i, j = same + (x[i - 1] == b[j - 1]), i - 1, j - 1
                elif t[i][j] == t[i - 1][j] - 1:
                    i -= 1
                else:
                    j -= 1
            best = max(best, same / columns)
        return best

    def affine(a, b):
        low = -(10**9)
        t = [[(0, low, low)] * (len(b) + 1)]
        for i in range(1, len(a) + 1):
            row = [(-1 - i, -1 - i, low)]
            for j in range(1, len(b) + 1):
                d, r = max(t[-1][j][0] - 2, t[-1][j][1] - 1), max(row[-1][0] - 2, row[-1][2] - 1)
                row.append((max(t[-1][j - 1][0] + (1 if a[i - 1] == b[j - 1] else -1), d, r), d, r))
            t.append(row)
        return [x[0] for x in t[-1]]

    rng = random.Random(9)
    for _ in range(60):
        a, b = ("".join(rng.choice("ACG") for _ in range(rng.randint(1, 14))) for _ in "ab")
        if a not in b:
            assert consensus.identity(a, b) == whole(a, b), (a, b)
        x, y = (np.frombuffer(s.encode(), dtype=np.uint8) for s in (a, b))
        assert consensus.pair_scores(x, y).tolist() == affine(a, b), (a, b)


def test_schemes_over_lists_of_lmers(spark):
    text = dna_text(400, 3)
    reads = spark.createDataFrame([("a", text), ("b", text[:100] + "N" + text[100:]), ("c", ""), ("d", "ACGT")], "read_id string, seq string")
    p = Params(k=3, l=8, density=0.5)
    every = {r.read_id: r for r in minspace.minimizers(reads, p).collect()}
    data, at, _ = kernels.collapse(np.frombuffer(text.encode(), dtype=np.uint8), np.array([0, len(text)]))
    hpc = data.tobytes().decode()
    words = [hpc[i : i + 8] for i in range(0, len(hpc) - 7, 3)]
    some = spark.createDataFrame([(w if i % 2 else kernels.reverse_complement(w) + "GG",) for i, w in enumerate(words)] + [("AC",), (None,)], "lmer string")
    starts = [i for i in range(len(hpc) - 7) if {hpc[i : i + 8], kernels.reverse_complement(hpc[i : i + 8])} & set(words)]
    uhs = {r.read_id: r for r in minspace.minimizers(reads, replace(p, scheme="uhs"), some).collect()}
    lcp = {r.read_id: r for r in minspace.minimizers(reads, replace(p, scheme="lcp"), some).collect()}
    assert set(uhs["a"].pos) <= set(starts) and uhs["a"] == lcp["a"] and uhs["c"].minims == uhs["d"].minims == []
    known = {r.minim for r in minspace.lmer_hashes(some, 8).collect()}
    own = minspace.minimizers(reads, p, some).where("read_id = 'a'").first()
    assert own.minims == [h for h in every["a"].minims if h in known] == uhs["a"].minims and own.minims
    with pytest.raises(ValueError):
        minspace.minimizers(reads, replace(p, scheme="uhs"))
    counts = spark.createDataFrame([("ACGTACGT", 5), ("AAAACCCC", 2), ("GGGGTTTT", 1), ("ACACACAC", 9)], "lmer string, n bigint")
    kept = minspace.dictionary(counts, 8, 0.5, low=1, high=9)
    assert {r.lmer for r in kept.collect()} <= {"ACGTACGT", "AAAACCCC"} and minspace.dictionary_sizes(counts, kept, 1, 9).first().n_skipped == 2
    assert minspace.every_lmer(spark, 3).count() == 32


def test_graph_files_round_trip(spark, tmp_path):
    nodes = spark.createDataFrame([(1, [5, 6], 3, 40, "ACGT", 2, 3)], "node_id bigint, kmer array<bigint>, abundance bigint, seqlen bigint, seq string, shift_l int, shift_r int")
    e = links(spark, [(1, "+", 1, "-", 7)])
    formats.write_lines(formats.gfa_lines(nodes, e), str(tmp_path / "g"))
    assert rows(formats.read_gfa_segments(spark, str(tmp_path / "g"))) == [("1", None, 40, 3, None)]
    assert rows(formats.read_gfa_links(spark, str(tmp_path / "g"))) == [("1", "+", "1", "-", 7)]
    contigs = spark.createDataFrame([("c", "ACGT", 2.25)], "name string, seq string, mean_abundance double")
    assert formats.complete_gfa_lines(contigs, e.limit(0)).first().value.startswith("S\tc\tACGT\tLN:i:4\tmc:f:2.")
    assert formats.fasta_lines(contigs).first()[0] == ">c\nACGT" and formats.stripped(contigs).first().seq == "*"
    formats.sequence_lines(nodes).write.text(str(tmp_path / "s"))
    assert rows(formats.read_sequence_lines(spark, str(tmp_path / "s"))) == [(1, [5, 6], "ACGT", 2, 3)]
    (tmp_path / "u.gfa").write_text("S\tu1\t*\tLN:i:9\nA\tu1\t0\t+\t17\t0\t5\n")
    assert rows(formats.read_gfa_paths(spark, str(tmp_path / "u.gfa"))) == [("u1", 0, "+", 17)]


def test_record_files_round_trip(spark, tmp_path):
    reads = spark.createDataFrame([("a", "ACGT", [5, 6], [0, 2]), ("b", "GG", [7], [0])], "read_id string, seq string, minims array<bigint>, pos array<int>")
    formats.corrected_lines(reads).coalesce(1).write.text(str(tmp_path / "c"))
    assert rows(formats.read_corrected(spark, str(tmp_path / "c"))) == rows(reads)
    stats = spark.createDataFrame([("a", [1, 2])], "read_id string, counts array<bigint>")
    assert formats.read_stats_lines(stats).first()[0] == "a: 1 2"
    rec = spark.createDataFrame([("t", ["x", "y"])], "template string, recruits array<string>")
    formats.recruit_lines(rec).write.text(str(tmp_path / "p"))
    assert rows(formats.read_recruits(spark, str(tmp_path / "p"))) == [("t", "x"), ("t", "y")]
    a, b = formats.truth_interval(F.lit("S1_chr_100_250_x"))
    assert tuple(spark.range(1).select(a, b).first()) == (100, 250)


# -- streaming ----------------------------------------------------------------------------------------------------------------

def test_streaming_counts_equal_batch_counts(spark, tmp_path):
    p = Params(k=3, l=8, density=0.2, hpc=False)
    frames = [spark.createDataFrame([(f"{j}.{i}", dna_text(300, 7 * j + i)) for i in range(4)], "read_id string, seq string") for j in range(3)]
    for f in frames:
        f.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(frames[0].schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = stream_counts(stream, p).writeStream.outputMode("complete").format("memory").queryName("kmers").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert rows(spark.table("kmers")) == rows(stream_counts(frames[0].union(frames[1]).union(frames[2]), p))


# -- the graph by its (k-1)-mers ----------------------------------------------------------------------------------------------

def random_nodes(spark, seed, letters, texts, k=3):
    """Nodes of random lists, a tandem repeat and a circle with a dead end."""
    r = random.Random(seed)
    lists = [[r.randrange(1, letters) for _ in range(r.randrange(5, 25))] for _ in range(texts)]
    circle = [100, 104, 101, 109, 102, 107, 108]
    lists += [circle + circle[:k - 1], circle[3:5] + [120, 121], [200, 201, 200, 201, 200], [210, 211, 212, 212, 211, 210]]
    kmers = {min(tuple(x[i:i + k]), tuple(x[i:i + k])[::-1]) for x in lists for i in range(len(x) - k + 1)}
    data = [(list(w), r.choice([2, 3, 9, 400]), r.randrange(30, 60), r.randrange(1, 9), r.randrange(1, 9), f"r{r.randrange(9)}") for w in sorted(kmers)]
    return kminmers.node_ids(spark.createDataFrame(data, "kmer array<bigint>, abundance bigint, seqlen bigint, shift_l int, shift_r int, read_id string"))


def test_paths_without_links_are_those_of_the_links(spark):
    nodes = session.written(random_nodes(spark, 1, 7, 6))
    links = session.written(graph.edges(nodes, 3, 0.01))
    found = junctions.Paths(nodes, 3, 0.01)
    assert rows(found.listed()) == rows(graph.unitigs(links, nodes))
    pipeline.clean(found, 3, 150, 150, 3)
    _, kept, paths = pipeline.simplified(graph.both_sides(links), nodes, 3, 150, 150, 3)
    assert rows(found.listed()) == rows(paths) and found.where.count() == kept.count() < nodes.count()


def test_a_common_end_of_many_nodes_lists_no_links(spark):
    n = 400
    data = [([x, 1, 1], 2, 40, 3, 3, "r") for x in range(10, 10 + n)] + [([1, 1, x], 2, 40, 3, 3, "r") for x in range(1000, 1000 + n)]
    nodes = session.written(kminmers.node_ids(spark.createDataFrame(data, "kmer array<bigint>, abundance bigint, seqlen bigint, shift_l int, shift_r int, read_id string")))
    found = junctions.Paths(nodes, 3, 0.01)
    pipeline.clean(found, 0, 1, 1)
    # (1, 1) is a palindrome, so all are linked to all and to themselves: only the links with themselves and double ones are listed
    assert found.segs.count() == 2 * n and found.cuts.count() <= 2 * n


def numbered_lists(spark, lists):
    data = [(f"r{i:05}", [int(x) for x in w], list(range(0, 10 * len(w), 10))) for i, w in enumerate(lists)]
    return spark.createDataFrame(data, "read_id string, minims array<bigint>, pos array<int>")


def test_sizes_without_links_are_those_of_the_links(spark, monkeypatch):
    for seed, k, presimp in ((1, 3, 0.25), (2, 4, 0.01)):
        r = random.Random(seed)
        # a circle, tandem repeats, palindromes; some lists are far more common than others
        texts = [[r.randrange(1, 5) for _ in range(r.randrange(k + 1, 14))] for _ in range(12)] + [[100, 101, 102, 103, 104] * 2, [110, 111] * 4, [120] * 7, [130, 131, 132, 131, 130, 133]]
        lists = session.written(numbered_lists(spark, [x if r.random() < 0.5 else x[::-1] for x in texts for _ in range(r.choice([1, 2, 5, 250]))]))
        nodes = session.written(kminmers.node_ids(kminmers.nodes(lists, k, 2)))
        links = session.written(graph.edges(nodes, k, presimp))
        assert links.count() < graph.edges(nodes, k).count()
        true = {"nodes": nodes.count(), "edges": links.count(), "paths": graph.unitigs(links, nodes).select("unitig").distinct().count()}
        assert sizes.of_lists(lists, k, 2, True, presimp) == true
        with monkeypatch.context() as m:
            m.setattr(sizes, "TOGETHER", 2)
            assert sizes.of_lists(lists, k, 2, True, presimp) == true


def test_sizes_of_a_common_end_list_no_links(spark):
    n = 6_000
    lists = numbered_lists(spark, [w for x in range(n) for w in [[10 + x, 1, 2], [1, 2, n + 10 + x]] * 2])
    # 72 million links, which the assembly listed for their number
    assert sizes.of_lists(lists, 3, 2, False, 0.01) == {"nodes": 2 * n, "edges": 2 * n * n, "paths": 2 * n}


def test_lists_of_reads_count_each_read_once(spark, monkeypatch):
    p = Params(k=3, l=8, density=0.3, hpc=False)
    data = [(f"r{i}", dna_text(120, 900 + i)) for i in range(6)]
    data += [data[1], data[1], data[4], ("r2", None), ("r3", "*"), ("r5", " "), (None, data[0][1]), ("none", None)]
    frame = spark.createDataFrame(data, "read_id string, seq string")
    true = rows(kminmers.lists_once(minspace.minimizers(minspace.with_sequence(frame), p)))
    assert len(true) == 6 and rows(minspace.lists_of_reads(frame, p)) == true
    monkeypatch.setattr(minspace, "FEW", 1)
    assert rows(minspace.lists_of_reads(frame, p)) == true
    assert rows(pipeline.sizes(frame, p)) == rows(pipeline.metrics(pipeline.assemble(frame, p, base_space=False)))
