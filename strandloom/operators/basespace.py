"""From paths of nodes back to sequences.

A path is (unitig, ord, node_id, o); the first node gives its whole sequence, each later one what it adds behind its predecessor.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandloom.functions.dna import canonical, clean_seq, reverse_complement


def node_sequences(nodes: DataFrame, reads: DataFrame, l: int) -> DataFrame:
    """Adds seq to nodes (read_id, start, seqlen, rev, ...): the bases of each node's representative, in its canonical direction.

    Only kept nodes fetch their read, and only the needed piece of it stays.
    """
    text = reads.select("read_id", clean_seq("seq").alias("text"))
    piece = F.col("text").substr(F.col("start") + 1, (F.col("seqlen") - 2 + l).cast("int"))
    return nodes.join(text, "read_id").withColumn("seq", F.when(F.col("rev"), reverse_complement(piece)).otherwise(piece)).drop("text")


def tail() -> Column:
    """What a node adds behind its predecessor: read forwards the last shift_r bases, read backwards the complement of its first
    shift_l bases."""
    n = F.length("seq")
    fwd = F.when(F.col("shift_r") > 0, F.col("seq").substr(n - F.col("shift_r") + 1, F.col("shift_r"))).otherwise("")
    back = F.when(F.col("shift_l") > 0, reverse_complement(F.col("seq").substr(F.lit(1), F.col("shift_l")))).otherwise("")
    return F.when(F.col("o") == "+", fwd).otherwise(back)


def contigs(paths: DataFrame, nodes: DataFrame) -> DataFrame:
    """name, seq, n_nodes, mean_abundance of every path; nodes hold (node_id, seq, shift_l, shift_r, abundance).

    The pieces of one path meet in one row, as its sequence must.
    """
    whole = F.when(F.col("o") == "+", F.col("seq")).otherwise(reverse_complement("seq"))
    piece = F.when(F.col("ord") == 0, whole).otherwise(tail())
    rows = paths.join(nodes.select("node_id", "seq", "shift_l", "shift_r", "abundance"), "node_id").select("unitig", "ord", "abundance", piece.alias("piece"))
    return _joined(rows)


def _joined(rows: DataFrame) -> DataFrame:
    parts = F.array_sort(F.collect_list(F.struct("ord", "piece")))
    per = rows.groupBy("unitig").agg(parts.alias("parts"), F.count("*").alias("n_nodes"), F.avg("abundance").alias("mean_abundance"))
    return per.select(F.col("unitig").alias("name"), F.array_join(F.transform("parts", lambda x: x["piece"]), "").alias("seq"), "n_nodes", "mean_abundance")


def contigs_from_reads(paths: DataFrame, nodes: DataFrame, reads: DataFrame, l: int) -> DataFrame:
    """`contigs` of the nodes' `node_sequences`, where of each node only what its path needs is fetched from its read."""
    forward, n = F.col("o") == "+", F.col("seqlen") - 2 + l
    shift = F.when(forward, F.col("shift_r")).otherwise(F.col("shift_l"))
    # a later node adds the end of its piece of the read where path and read have one direction, else its beginning turned round
    first, along = F.col("ord") == 0, forward != F.col("rev")
    size = F.when(first, n).otherwise(F.greatest(shift, F.lit(0)))
    begin = F.when(first | ~along, F.col("start")).otherwise(F.col("start") + n - size)
    wanted = paths.join(nodes.select("node_id", "seqlen", "shift_l", "shift_r", "abundance", "read_id", "start", "rev"), "node_id").select(
        "unitig", "ord", "abundance", "read_id", (begin + 1).cast("int").alias("begin"), size.cast("int").alias("size"), "rev", "o")
    piece = F.col("text").substr(F.col("begin"), F.col("size"))
    own = F.when(F.col("rev"), reverse_complement(piece)).otherwise(piece)
    rows = wanted.join(reads.select("read_id", clean_seq("seq").alias("text")), "read_id").select("unitig", "ord", "abundance", F.when(forward, own).otherwise(reverse_complement(own)).alias("piece"))
    return _joined(rows)


def unitig_minimizers(paths: DataFrame, nodes: DataFrame, min_abundance: int | None = None) -> DataFrame:
    """unitig, minims: the minimizers along each path; the first node gives all of its list, each later one its last element.

    `nodes` is (node_id, kmer, abundance).  Paths with an unknown node are left out, with `min_abundance` also those without any node of more.
    """
    own = F.when(F.col("o") == "+", F.col("kmer")).otherwise(F.reverse("kmer"))
    piece = F.when(F.col("ord") == 0, own).otherwise(F.slice(own, -1, 1))
    rows = paths.join(nodes.select("node_id", "kmer", "abundance"), "node_id", "left").select("unitig", "ord", "abundance", piece.alias("piece"))
    parts = F.array_sort(F.collect_list(F.struct("ord", "piece")))
    per = rows.groupBy("unitig").agg(parts.alias("parts"), F.count_if(F.col("piece").isNull()).alias("unknown"), F.max("abundance").alias("most"))
    kept = per.where("unknown = 0" if min_abundance is None else (F.col("unknown") == 0) & (F.col("most") > min_abundance))
    return kept.select("unitig", F.flatten(F.transform("parts", lambda x: x["piece"])).alias("minims"))


def stepped_contigs(chains: DataFrame, nodes: DataFrame, k: int, l: int) -> DataFrame:
    """unitig, seq from chains (unitig, minims) and nodes (kmer, seq): the bases of every window that begins where the last one ends, each
    without the l letters that it shares with it.  What is left behind the last whole window has no bases; chains with
    an unknown window are left out."""
    w = F.slice("minims", F.col("step") * (k - 1) + 1, k)
    steps = F.sequence(F.lit(0), F.floor((F.size("minims") - k) / (k - 1)).cast("int"))
    rows = chains.where(F.size("minims") >= k).select("unitig", "minims", F.explode(steps).alias("step")).select("unitig", "step", w.alias("w"), canonical(w).alias("kmer"))
    found = rows.join(nodes.select("kmer", "seq"), "kmer", "left")
    text = F.when(F.col("w") == F.col("kmer"), F.col("seq")).otherwise(reverse_complement("seq"))
    piece = F.when(F.col("step") == 0, text).otherwise(F.substr(text, F.lit(l + 1)))
    per = found.groupBy("unitig").agg(F.array_sort(F.collect_list(F.struct("step", piece.alias("piece")))).alias("parts"), F.count_if(F.col("seq").isNull()).alias("unknown"))
    return per.where("unknown = 0").select("unitig", F.array_join(F.transform("parts", lambda x: x["piece"]), "").alias("seq"))


def unitig_stats(paths: DataFrame, nodes: DataFrame) -> DataFrame:
    """unitig, n_nodes, bases, total_abundance, mean_abundance from (node_id, seqlen, shift_l, shift_r, abundance): the first node
    counts whole, later ones with what they add."""
    added = F.when(F.col("ord") == 0, F.col("seqlen")).otherwise(F.when(F.col("o") == "+", F.col("shift_r")).otherwise(F.col("shift_l")))
    rows = paths.join(nodes.select("node_id", "seqlen", "shift_l", "shift_r", "abundance"), "node_id")
    return rows.groupBy("unitig").agg(
        F.count("*").alias("n_nodes"), F.sum(added).cast("bigint").alias("bases"), F.sum("abundance").alias("total_abundance"), (F.sum("abundance") / F.count("*")).alias("mean_abundance")
    )


def repaired_overlap(overlap: str, len_a: str, len_b: str):
    """An overlap longer than either end becomes one less than the shorter end."""
    o, a, b = F.col(overlap), F.col(len_a), F.col(len_b)
    return F.when((o > a) | (o > b), F.least(a - 1, b - 1)).otherwise(o)


def repair_overlaps(links: DataFrame, sizes: DataFrame) -> DataFrame:
    """Links with repaired overlaps; sizes is (node_id, seqlen).  Links to unknown nodes and without an overlap are left out."""
    a = sizes.select(F.col("node_id").alias("n1"), F.col("seqlen").alias("len1"))
    b = sizes.select(F.col("node_id").alias("n2"), F.col("seqlen").alias("len2"))
    rows = links.where(F.col("overlap").isNotNull()).join(a, "n1").join(b, "n2")
    return rows.select("n1", "o1", "n2", "o2", repaired_overlap("overlap", "len1", "len2").alias("overlap"))
