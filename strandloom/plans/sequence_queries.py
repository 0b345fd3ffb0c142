"""Queries over reads and minimizer lists, and their SQL."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom import kernels
from strandloom.functions import dna
from strandloom.operators import analytics, correct, kminmers, minspace
from strandloom.params import Params, sample_lengths
from strandloom.plans import pipeline
from strandloom.session import saved, table

K = 5
DENSITY = Params(k=K, l=12, density=0.05)
#: Limits of graph cleaning: nodes and bases of a dead end, bases of a bubble's side.
TIP_NODES, TIP_LENGTH, BUBBLE_LENGTH = 10, 5_000, 5_000


def reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minspace.reads_once(table(spark, sf_dir, "reads"))


def lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kminmers.lists_once(table(spark, sf_dir, "minspace"))


def read_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean and largest length of a sample of reads, from which parameters are chosen."""
    return sample_lengths(table(spark, sf_dir, "reads"), n=10_000)


def hpc_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every read without repeated letters."""
    return reads(spark, sf_dir).select("read_id", dna.collapse_runs(dna.clean_seq("seq")).alias("hpc"))


def revcomp_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reverse complement of every read, unclear letters as N."""
    return reads(spark, sf_dir).select("read_id", dna.reverse_complement(dna.clean_seq("seq")).alias("rc"))


def base_composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Letters of each run and how many of them are unclear."""
    s = dna.only_bases(dna.clean_seq("seq"))
    rows = table(spark, sf_dir, "reads").where(F.col("seq").isNotNull() & ~F.trim("seq").isin("", "*"))
    return rows.groupBy("run_id").agg(F.sum(F.length(s)).cast("bigint").alias("letters"), F.sum(F.length(s) - F.length(F.translate(s, "N", ""))).cast("bigint").alias("unclear"))


def minimizers_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Selected 12-mers of every read: position and hash."""
    return _places(minspace.minimizers(reads(spark, sf_dir), DENSITY))


def minimizers_syncmer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Open syncmers of every read."""
    return _places(minspace.minimizers(reads(spark, sf_dir), Params(k=K, l=12, density=0.3, scheme="syncmers", s=4)))


def _heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lmer, n: the first 12 letters of the l-mers of minspace with their rows, as a list of l-mers."""
    rows = table(spark, sf_dir, "minspace").select(F.explode("minimizers").alias("lmer")).where("lmer IS NOT NULL")
    return rows.groupBy(F.substring("lmer", 1, DENSITY.l).alias("lmer")).agg(F.count("*").alias("n"))


def _places(found: DataFrame) -> DataFrame:
    return found.select("read_id", F.explode(F.arrays_zip("pos", "minims")).alias("x")).select("read_id", F.col("x.pos").alias("pos"), F.col("x.minims").alias("minim"))


def minimizers_uhs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Selected 12-mers of every read that a list holds."""
    return _places(minspace.minimizers(reads(spark, sf_dir), replace(DENSITY, scheme="uhs"), _heads(spark, sf_dir)))


def minimizers_lcp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Selected 12-mers of every read without an unclear letter that a list holds."""
    return _places(minspace.minimizers(reads(spark, sf_dir), replace(DENSITY, scheme="lcp"), _heads(spark, sf_dir)))


def minimizers_counted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Selected 12-mers of every read from a dictionary without rare and frequent ones."""
    known = minspace.dictionary(_heads(spark, sf_dir), DENSITY.l, DENSITY.density, low=1, high=200)
    return _places(minspace.minimizers(reads(spark, sf_dir), DENSITY, known))


def dictionary_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes of that dictionary."""
    heads = _heads(spark, sf_dir)
    return minspace.dictionary_sizes(heads, minspace.dictionary(heads, DENSITY.l, DENSITY.density, low=1, high=200), low=1, high=200)


def lmer_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Occurrences of every l-mer of minspace on either strand."""
    return minspace.lmer_counts(table(spark, sf_dir, "minspace"))


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "minspace")
    kept = rows.where(F.col("read_id").isNotNull() & F.col("minims").isNotNull())
    return kept.groupBy("read_id").agg(*[F.first(c).alias(c) for c in ("minimizers", "minims", "pos")])


def robust_minimizers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Minimizers without those whose l-mer occurs at most twice or at least 1000 times."""
    counts = minspace.lmer_counts(table(spark, sf_dir, "minspace"))
    return minspace.by_dictionary(_rows(spark, sf_dir), counts.where("n <= 2 OR n >= 1000"), keep=False).select("read_id", "i", "minim", "pos")


def dictionary_minimizers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Minimizers whose l-mer stands in a list: here those that occur at least five times."""
    counts = minspace.lmer_counts(table(spark, sf_dir, "minspace"))
    return minspace.by_dictionary(_rows(spark, sf_dir), counts.where("n >= 5")).select("read_id", "i", "minim", "pos")


def kminmer_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Abundance of every canonical window of 5 minimizers."""
    return kminmers.counts(lists(spark, sf_dir), K)


def kminmer_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of abundance 2 or more with length and shifts of their second occurrence."""
    return kminmers.nodes(lists(spark, sf_dir), K, 2).select("kmer", "abundance", "seqlen", "shift_l", "shift_r", "read_id", "start", "rev")


def read_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Abundance of each window of each read in the node table."""
    known = table(spark, sf_dir, "nodes").groupBy("kmer").agg(F.max("abundance").alias("abundance"))
    return kminmers.read_stats(lists(spark, sf_dir), known, K)


def _kinds(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    every = lists(spark, sf_dir)
    return every.where(F.col("read_id").endswith("/ccs")), every.where(F.col("read_id").endswith("/sub"))


def subread_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of each subread's windows occurs in consensus reads."""
    ccs, sub = _kinds(spark, sf_dir)
    return kminmers.coverage(ccs, sub, K)


def subread_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of consensus reads that subreads hold, with their occurrences there."""
    ccs, sub = _kinds(spark, sf_dir)
    return kminmers.hit_windows(ccs, sub, K)


def graph_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of subreads that nodes of the graph hold."""
    return kminmers.node_hits(table(spark, sf_dir, "nodes").where("kmer IS NOT NULL"), _kinds(spark, sf_dir)[1], K)


def kminmer_set_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct windows of consensus reads and of subreads, and what they share."""
    ccs, sub = _kinds(spark, sf_dir)
    return kminmers.compare_sets(kminmers.counts(ccs, K), kminmers.counts(sub, K))


def abundance_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of subreads by abundance, split by whether a consensus read holds them."""
    ccs, sub = _kinds(spark, sf_dir)
    found = kminmers.counts(sub, K).join(kminmers.counts(ccs, K).select("kmer", F.lit(True).alias("true_one")), "kmer", "left")
    return kminmers.abundance_histogram(found, F.coalesce("true_one", F.lit(False)))


def mappability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of distinct windows that occur once."""
    return kminmers.mappability(kminmers.counts(lists(spark, sf_dir), K))


def ngram_successors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of each minimizer after each pair of minimizers."""
    return kminmers.ngram_successors(lists(spark, sf_dir), 2)


def minimizer_spacing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean distance of the selected positions of each read."""
    return kminmers.spacing(lists(spark, sf_dir))


def similar_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads within a Jaccard distance of 0.15 that share two consecutive minimizers: number of links of each read."""
    return analytics.similar_lists(lists(spark, sf_dir)).select("read_id", "n_links")


def labelled_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of equal lists that an earlier class would label as corrected, each labelling its three nearest."""
    return correct.left_out(correct.recruits(lists(spark, sf_dir)), 3)


def assembly_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes of the graph of the reads, without base space."""
    return pipeline.sizes(table(spark, sf_dir, "reads"), DENSITY)


def corrected_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads after consensus with similar reads: minimizers before and after, identity of the new sequence with the old."""
    own = reads(spark, sf_dir).select("read_id", dna.clean_seq("seq").alias("seq"))
    found = saved(minspace.minimizers(own, DENSITY))
    done = correct.corrected(own, found, DENSITY.l)
    pairs = done.select("read_id", F.col("seq").alias("a")).join(own.select("read_id", F.col("seq").alias("b")), "read_id")
    sizes = found.select("read_id", F.size("minims").alias("n_before")).join(done.select("read_id", F.size("minims").alias("n_after")), "read_id")
    return sizes.join(correct.identities(pairs), "read_id")


def assembled_contigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assembly of the reads, the graph cleaned: length, nodes and abundance of each contig."""
    done = pipeline.assemble(table(spark, sf_dir, "reads"), DENSITY, TIP_NODES, TIP_LENGTH, BUBBLE_LENGTH, rounds=6)
    return done.contigs.select("name", F.length("seq").alias("bases"), "n_nodes", "mean_abundance")


def corrected_contigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assembly of the reads after their correction: length, nodes and abundance of each contig."""
    own = reads(spark, sf_dir).select("read_id", dna.clean_seq("seq").alias("seq"))
    done = saved(correct.corrected(own, saved(minspace.minimizers(own, DENSITY)), DENSITY.l))
    contigs = pipeline.assemble_lists(done, done, DENSITY, TIP_NODES, TIP_LENGTH, BUBBLE_LENGTH, rounds=6).contigs
    return contigs.select("name", F.length("seq").alias("bases"), "n_nodes", "mean_abundance")


def run_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows by the part of the read id before the first slash."""
    return analytics.genome_ids(table(spark, sf_dir, "reads"), "read_id", "/")


QUERIES = {f.__name__: f for f in (
    read_lengths, hpc_reads, revcomp_reads, base_composition, minimizers_density, minimizers_syncmer, minimizers_uhs, minimizers_lcp, minimizers_counted, dictionary_sizes, lmer_counts, robust_minimizers, dictionary_minimizers,
    kminmer_counts, kminmer_nodes, read_stats, subread_coverage, subread_hits, graph_hits, kminmer_set_compare, abundance_histogram, mappability, ngram_successors,
    minimizer_spacing, similar_reads, labelled_lists, corrected_reads, assembled_contigs, corrected_contigs, assembly_metrics, run_reads,
)}


def _hashes(l: int) -> str:
    """SQL column list: the rolling hash of the l letters from here on, the smaller of both strands, from columns f0.. and g0.. of each letter."""
    xor = lambda c: "xor(" * (l - 1) + f"{c}0" + "".join(f", lead({c}{o}, {o}, 0::UBIGINT) OVER w)" for o in range(1, l))
    return f"least({xor('f')}, {xor('g')})"


def _rotations(l: int) -> str:
    """Rows (letter, forward parts, backward parts) of the rolling hash, by place in the window."""
    rol = lambda x, k: ((x << k) | (x >> (64 - k))) & (1 << 64) - 1 if k % 64 else x
    seeds = [int(x) for x in kernels.SEEDS[:4]]
    parts = lambda i: [rol(seeds[i], l - 1 - o) for o in range(l)] + [rol(seeds[3 - i], o) for o in range(l)]
    rows = [(c, parts(i)) for i, c in enumerate("ACGT")] + [("N", [0] * 2 * l)]
    names = ", ".join([f"f{o}" for o in range(l)] + [f"g{o}" for o in range(l)])
    values = ", ".join(f"('{c}', {', '.join(f'{x}::UBIGINT' for x in p)})" for c, p in rows)
    return f"rot(letter, {names}) AS (VALUES {values})"


def _long_rotations(l: int) -> str:
    """Rows (letter, place, forward part, backward part) of the rolling hash."""
    rol = lambda x, k: ((x << k) | (x >> (64 - k))) & (1 << 64) - 1 if k % 64 else x
    seeds = [int(x) for x in kernels.SEEDS[:4]]
    return ", ".join(f"('{c}', {o}, {rol(seeds[i], l - 1 - o)}::UBIGINT, {rol(seeds[3 - i], o)}::UBIGINT)" for i, c in enumerate("ACGT") for o in range(l))


CLEAN = """r AS (SELECT read_id, any_value(replace(upper(regexp_replace(seq, '\\s', '', 'g')), 'U', 'T')) AS s FROM reads
  WHERE read_id IS NOT NULL AND seq IS NOT NULL AND trim(seq) NOT IN ('', '*') GROUP BY read_id)"""
HPC = CLEAN + """, c AS (SELECT read_id, unnest(string_split(s, '')) AS b, unnest(range(1, length(s) + 1)) AS i FROM r),
d AS (SELECT * FROM (SELECT *, lag(b) OVER (PARTITION BY read_id ORDER BY i) AS p FROM c) WHERE p IS NULL OR b <> p OR NOT b IN ('A', 'C', 'G', 'T', 'N'))"""
ONCE = """once AS (SELECT read_id, any_value(minims) AS minims, any_value(pos) AS pos, any_value(minimizers) AS minimizers FROM minspace
  WHERE read_id IS NOT NULL AND minims IS NOT NULL GROUP BY read_id)"""


def _windows(k: int, strict: bool = True) -> str:
    return f"""{ONCE}, w AS (SELECT read_id, i - 1 AS i, minims[i:i+{k - 1}] AS w, pos FROM
  (SELECT *, unnest(range(1, len(minims) - {k} + 2)) AS i FROM once WHERE len(minims) {'>' if strict else '>='} {k})),
occ AS (SELECT read_id, i, least(w, list_reverse(w)) AS kmer, NOT w < list_reverse(w) AS rev, pos[i+2] - pos[i+1] AS f, pos[i+{k}] - pos[i+{k - 1}] AS b,
  pos[i+1] AS start, pos[i+{k}] - pos[i+1] + 2 AS span FROM w)"""


_RC = "replace(replace(replace(replace(replace(replace({0}, 'A', 'x'), 'T', 'A'), 'x', 'T'), 'C', 'y'), 'G', 'C'), 'y', 'G')"
_LMER = f"""lm AS (SELECT unnest(minimizers) AS l FROM minspace), lc AS (SELECT least(l, reverse({_RC.format('l')})) AS lmer, count(*) AS n FROM lm WHERE l IS NOT NULL GROUP BY 1)"""
_ROWS = f"""{ONCE}, z AS (SELECT read_id, i - 1 AS i, minimizers[i] AS l, minims[i] AS minim, pos[i] AS pos FROM (SELECT *, unnest(range(1, len(minims) + 1)) AS i FROM once)),
zc AS (SELECT *, least(l, reverse({_RC.format('l')})) AS lmer FROM z)"""
_PICKED = f"""{HPC}, {_rotations(12)},
e AS (SELECT read_id, i, b, row_number() OVER (PARTITION BY read_id ORDER BY i) AS j, rot.* FROM d JOIN rot ON letter = CASE WHEN b IN ('A', 'C', 'G', 'T') THEN b ELSE 'N' END),
x AS (SELECT read_id, CAST(i - 1 AS INTEGER) AS pos, CAST(j - 1 AS INTEGER) AS hpos, {_hashes(12)} AS h, lead(i, 11) OVER w AS z,
  concat(b{''.join(f', lead(b, {o}) OVER w' for o in range(1, 12))}) AS word FROM e WINDOW w AS (PARTITION BY read_id ORDER BY j)),
picked AS (SELECT read_id, pos, hpos, CAST(h AS BIGINT) AS minim, least(word, reverse({_RC.format('word')})) AS lmer FROM x WHERE z IS NOT NULL AND h <= {int(kernels.density_bound(0.05))}::UBIGINT)"""
_HEADS = f"""heads AS (SELECT least(l, reverse({_RC.format('l')})) AS lmer FROM (SELECT substr(unnest(minimizers), 1, 12) AS l FROM minspace) WHERE length(l) = 12),
counted AS (SELECT lmer, n FROM (SELECT substr(l, 1, 12) AS h, count(*) AS n FROM (SELECT unnest(minimizers) AS l FROM minspace) WHERE l IS NOT NULL GROUP BY 1), LATERAL (SELECT least(h, reverse({_RC.format('h')})) AS lmer))"""
_OUT = "CAST(i AS INTEGER) AS i, minim, pos"

ORACLES = {
    "read_lengths": """SELECT CAST(floor(avg(length(seq))) AS BIGINT) AS mean_length, CAST(max(length(seq)) AS INTEGER) AS max_length FROM
(SELECT seq FROM reads WHERE seq IS NOT NULL ORDER BY read_id, length(seq) LIMIT 10000)""",
    "hpc_reads": f"WITH {HPC} SELECT read_id, string_agg(b, '' ORDER BY i) AS hpc FROM d GROUP BY read_id",
    "revcomp_reads": f"WITH {CLEAN} SELECT read_id, reverse(translate(regexp_replace(s, '[^ACGT]', 'N', 'g'), 'ACGT', 'TGCA')) AS rc FROM r",
    "base_composition": """SELECT run_id, CAST(sum(length(s)) AS BIGINT) AS letters, CAST(sum(length(s) - length(replace(s, 'N', ''))) AS BIGINT) AS unclear FROM
(SELECT run_id, regexp_replace(replace(upper(regexp_replace(seq, '\\s', '', 'g')), 'U', 'T'), '[^ACGT]', 'N', 'g') AS s FROM reads WHERE seq IS NOT NULL AND trim(seq) NOT IN ('', '*')) GROUP BY run_id""",
    "minimizers_density": f"WITH {_PICKED} SELECT read_id, pos, minim FROM picked",
    "minimizers_uhs": f"WITH {_PICKED}, {_HEADS} SELECT read_id, hpos AS pos, minim FROM picked WHERE lmer IN (SELECT lmer FROM heads)",
    "minimizers_lcp": f"WITH {_PICKED}, {_HEADS} SELECT read_id, hpos AS pos, minim FROM picked WHERE lmer IN (SELECT lmer FROM heads) AND NOT contains(lmer, 'N')",
    "minimizers_counted": f"WITH {_PICKED}, {_HEADS} SELECT read_id, pos, minim FROM picked WHERE lmer IN (SELECT lmer FROM counted WHERE n > 1 AND n < 200)",
    "dictionary_sizes": f"""WITH {_HEADS}, rot(letter, o, f, g) AS (VALUES {_long_rotations(12)}),
own AS (SELECT DISTINCT lmer FROM counted WHERE n > 1 AND n < 200), hashed AS (SELECT lmer, least(bit_xor(f), bit_xor(g)) AS h FROM
(SELECT lmer, substr(lmer, o + 1, 1) AS letter, o FROM own, range(12) t(o)) JOIN rot USING (letter, o) GROUP BY lmer),
kept AS (SELECT * FROM hashed WHERE h <= {int(kernels.density_bound(0.05))}::UBIGINT)
SELECT count(DISTINCT h) AS n_ids, CAST(sum(CASE WHEN lmer = reverse({_RC.format('lmer')}) THEN 1 ELSE 2 END) AS BIGINT) AS n_sequences, (SELECT count(*) FROM counted WHERE n <= 1 OR n >= 200) AS n_skipped FROM kept""",
    "lmer_counts": f"WITH {_LMER} SELECT lmer, n FROM lc",
    "robust_minimizers": f"WITH {_LMER}, {_ROWS} SELECT read_id, {_OUT} FROM zc JOIN lc USING (lmer) WHERE n > 2 AND n < 1000",
    "dictionary_minimizers": f"WITH {_LMER}, {_ROWS} SELECT read_id, {_OUT} FROM zc JOIN lc USING (lmer) WHERE n >= 5",
    "kminmer_counts": f"WITH {_windows(K)} SELECT kmer, count(*) AS abundance FROM occ GROUP BY kmer",
    "kminmer_nodes": f"""WITH {_windows(K)}, n AS (SELECT *, count(*) OVER (PARTITION BY kmer) AS abundance, row_number() OVER (PARTITION BY kmer ORDER BY read_id, i) AS place FROM occ)
SELECT kmer, abundance, CAST(span AS BIGINT) AS seqlen, CASE WHEN rev THEN b ELSE f END AS shift_l, CASE WHEN rev THEN f ELSE b END AS shift_r, read_id, start, rev FROM n WHERE place = 2""",
    "read_stats": f"""WITH {_windows(K)}, known AS (SELECT kmer, max(abundance) AS n FROM nodes GROUP BY kmer)
SELECT read_id, list(coalesce(n, 0) ORDER BY i) AS counts FROM occ LEFT JOIN known USING (kmer) GROUP BY read_id""",
    "subread_coverage": f"""WITH {_windows(K, False)}, held AS (SELECT DISTINCT kmer FROM occ WHERE read_id LIKE '%/ccs')
SELECT read_id AS query_id, count(*) AS n_kminmers, count(held.kmer) AS covered, 100 * count(held.kmer) / count(*) AS pct
FROM occ LEFT JOIN held USING (kmer) WHERE read_id LIKE '%/sub' GROUP BY read_id""",
    "subread_hits": f"""WITH {_windows(K, False)}, q AS (SELECT kmer, count(*) AS n_hits FROM occ WHERE read_id LIKE '%/sub' GROUP BY kmer)
SELECT read_id AS target_id, CAST(i AS INTEGER) AS pos, n_hits FROM occ JOIN q USING (kmer) WHERE read_id LIKE '%/ccs'""",
    "graph_hits": f"""WITH {_windows(K, False)} SELECT '*' AS target_id, read_id AS query_id, CAST(i AS INTEGER) AS query_pos FROM occ
WHERE read_id LIKE '%/sub' AND kmer IN (SELECT least(kmer, list_reverse(kmer)) FROM nodes WHERE kmer IS NOT NULL)""",
    "kminmer_set_compare": f"""WITH {_windows(K)}, g AS (SELECT kmer, max(CAST(read_id LIKE '%/ccs' AS BIGINT)) AS a, max(CAST(read_id LIKE '%/sub' AS BIGINT)) AS b FROM occ GROUP BY kmer)
SELECT CAST(sum(a) AS BIGINT) AS n_a, CAST(sum(b) AS BIGINT) AS n_b, CAST(sum(a * b) AS BIGINT) AS n_both, 100 * sum(a * b) / sum(a) AS pct_a_in_b, 100 * sum(a * b) / sum(b) AS pct_b_in_a FROM g""",
    "abundance_histogram": f"""WITH {_windows(K)}, s AS (SELECT kmer, count(*) AS n FROM occ WHERE read_id LIKE '%/sub' GROUP BY kmer), t AS (SELECT DISTINCT kmer FROM occ WHERE read_id LIKE '%/ccs')
SELECT CAST(n // 5 * 5 AS BIGINT) AS bin, count(t.kmer) AS genomic, count(*) - count(t.kmer) AS erroneous FROM s LEFT JOIN t USING (kmer) WHERE n < 500 GROUP BY 1""",
    "mappability": f"""WITH {_windows(K)}, g AS (SELECT kmer, count(*) AS n FROM occ GROUP BY kmer)
SELECT count(*) AS n_distinct, 100 * avg(CAST(n = 1 AS DOUBLE)) AS pct_unique FROM g""",
    "ngram_successors": f"""WITH {ONCE}, t AS (SELECT minims[i:i+1] AS gram, minims[i+2] AS next FROM (SELECT minims, unnest(range(1, len(minims) - 1)) AS i FROM once WHERE len(minims) >= 3))
SELECT gram, next, count(*) AS n FROM t GROUP BY gram, next""",
    "minimizer_spacing": f"WITH {ONCE} SELECT read_id, CASE WHEN len(pos) > 0 THEN (pos[-1] - pos[1]) / len(pos) ELSE -1.0 END AS mean_gap FROM once",
    "similar_reads": f"""WITH {ONCE}, s AS (SELECT read_id, list_sort(list_distinct(minims)) AS s, [least(minims[i:i+1], list_reverse(minims[i:i+1])) for i in range(1, len(minims))] AS g FROM once WHERE len(minims) > 0),
p AS (SELECT a.read_id FROM s a JOIN s b ON a.read_id <> b.read_id AND len(a.s) >= 0.85 * len(b.s) AND len(b.s) >= 0.85 * len(a.s)
  WHERE 1 - len(list_intersect(a.s, b.s)) / len(list_distinct(list_concat(a.s, b.s))) < 0.15 AND list_has_any(a.g, b.g))
SELECT s.read_id, count(p.read_id) AS n_links FROM s LEFT JOIN p USING (read_id) GROUP BY s.read_id""",
    "run_reads": "SELECT split_part(read_id, '/', 1) AS genome, count(*) AS n FROM reads WHERE read_id IS NOT NULL GROUP BY 1",
}
