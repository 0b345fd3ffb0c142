"""End-to-end runs: assembly at one k, at rising k, read statistics, containment."""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.operators import basespace, graph, junctions, kminmers, minspace
from strandloom.operators import sizes as numbers
from strandloom.params import Params, sample_lengths
from strandloom.session import written


@dataclass(frozen=True)
class Assembly:
    nodes: DataFrame
    edges: DataFrame
    paths: DataFrame
    contigs: DataFrame | None


def metrics(done: Assembly) -> DataFrame:
    """name, value: sizes of an assembly's parts; contigs are None where it has none."""
    own = [("nodes", done.nodes), ("edges", done.edges), ("paths", done.paths.select("unitig").distinct())] + ([("contigs", done.contigs)] if done.contigs is not None else [])
    rows = [f.agg(F.count("*").alias("value")).select(F.lit(n).alias("name"), "value") for n, f in own]
    if done.contigs is not None:
        rows.append(done.contigs.agg(F.coalesce(F.sum(F.length("seq")), F.lit(0)).alias("value")).select(F.lit("bases").alias("name"), "value"))
    return reduce(DataFrame.unionByName, rows)


def sizes(reads: DataFrame, p: Params) -> DataFrame:
    """name, value: `metrics` of the assembly of reads (read_id, seq) without cleaning and base space, of which nothing is listed."""
    found = numbers.of_lists(minspace.lists_of_reads(reads, p), p.k, p.min_abundance, p.strict, p.presimp)
    return reads.sparkSession.createDataFrame(list(found.items()), "name string, value bigint")


#: Bases of the graph above which a further series of rounds follows, and above which an aggressive one does; for each round of a
#: series the factors of tip_length and bubble_length.
LARGE, HUGE = 1_000_000, 100_000_000
MORE, AGGRESSIVE = ((1, 1), (2, 10), (3, 10)), ((1, 1), (2, 10), (4, 10))


def simplified(links: DataFrame, nodes: DataFrame, tip_nodes: int, tip_length: int, bubble_length: int, rounds: int = 1) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Links, nodes and maximal paths after up to `rounds` rounds of clipping dead ends and popping bubbles, then without loops.

    As in the original's script, a graph of over LARGE bases gets a further series of rounds, one of over HUGE bases loses its loops
    again and gets an aggressive series.  Series end early once nothing goes.
    """
    paths = None

    def mapped() -> DataFrame:
        """The maximal paths of the graph as it is now, found once until it changes."""
        nonlocal links, paths
        if paths is None:
            links = written(links)
            paths = written(graph.unitigs(links, nodes))
        return paths

    def bases() -> int:
        return basespace.unitig_stats(mapped(), nodes).agg(F.sum("bases")).first()[0] or 0

    def series(factors) -> None:
        nonlocal links, nodes, paths
        done = None
        for tip, bubble in factors:
            if (tip, bubble) == done:
                break
            gone = graph.tips(links, mapped(), nodes, tip_nodes, tip * tip_length) if tip_length else None
            if bubble_length:
                popped = graph.bubbles(links, mapped(), basespace.unitig_stats(mapped(), nodes), bubble * bubble_length)
                gone = popped if gone is None else gone.union(popped)
            gone = written(gone.distinct())
            if gone.isEmpty():
                done = (tip, bubble)
                continue
            out = paths.join(gone, "unitig", "left_semi").select("node_id").distinct()
            links = graph.without_unitigs(links, paths, gone)
            nodes, paths, done = written(nodes.join(out, "node_id", "left_anti")), None, None

    def unloop() -> None:
        nonlocal links, paths
        links, paths = graph.both_sides(graph.break_loops(links.withColumn("overlap", F.lit(0)))), None

    series(((1, 1),) * rounds)
    unloop()
    if bases() > LARGE:
        series(MORE)
        if bases() > HUGE:
            unloop()
            series(AGGRESSIVE)
    return links, nodes, mapped()


def clean(found: junctions.Paths, tip_nodes: int, tip_length: int, bubble_length: int, rounds: int = 1) -> None:
    """What `simplified` does, on paths of a graph whose links are not listed."""

    def series(factors) -> None:
        done = None
        for factor in factors:
            if factor != done:
                done = None if found.clip(tip_nodes, factor[0] * tip_length, factor[1] * bubble_length) else factor

    series(((1, 1),) * rounds)
    found.unloop()
    if found.bases() > LARGE:
        series(MORE)
        if found.bases() > HUGE:
            found.unloop()
            series(AGGRESSIVE)


def assemble(reads: DataFrame, p: Params, tip_nodes: int = 10, tip_length: int = 0, bubble_length: int = 0, rounds: int = 1, weighted: bool = False, base_space: bool = True) -> Assembly:
    """Nodes, edges, maximal paths and contigs of reads (read_id, seq).

    With tip_length or bubble_length above 0, the graph is cleaned (`simplified`) before the final paths.  `weighted` takes
    every row as its own read (contigs given twice then count twice); otherwise each read_id counts once.  Without `base_space` there are no
    contigs.
    """
    if weighted:
        own = written(reads.where("read_id IS NOT NULL AND seq IS NOT NULL").select("read_id", "seq"))
        lists = minspace.minimizers(own, p).repartition("read_id")
    else:
        # lists are made from every row and shuffled in place of the texts
        own, lists = minspace.reads_once(reads), kminmers.lists_once(minspace.minimizers(minspace.with_sequence(reads), p))
    return assemble_lists(own, lists, p, tip_nodes, tip_length, bubble_length, rounds, base_space)


def assemble_lists(
    reads: DataFrame, lists: DataFrame, p: Params, tip_nodes: int = 10, tip_length: int = 0, bubble_length: int = 0, rounds: int = 1, base_space: bool = True,
) -> Assembly:
    """`assemble` of reads (read_id, seq) whose lists (read_id, minims, pos) are given: a run that starts after the correction, with what
    `correct.corrected` returns or `formats.read_corrected` reads."""
    nodes = kminmers.checked_ids(written(kminmers.node_ids(kminmers.nodes(lists, p.k, p.min_abundance, p.strict))))
    edges = graph.edges(nodes, p.k, p.presimp)  # listed only where they are asked for
    found = junctions.Paths(nodes, p.k, p.presimp)
    if tip_length or bubble_length:
        clean(found, tip_nodes, tip_length, bubble_length, rounds)
    paths = found.listed()
    if tip_length or bubble_length:
        nodes = nodes.join(paths.select("node_id"), "node_id", "left_semi")
    contigs = basespace.contigs_from_reads(paths, nodes, reads, p.l) if base_space else None
    return Assembly(nodes, edges, paths, contigs)


def multi_k(
    reads: DataFrame, p: Params, min_contig: int = 100_000, first_k: int = 10, step: int = 5,
    tip_nodes: int = 10, tip_length: int = 50_000, bubble_length: int = 100_000, rounds: int = 6,
) -> DataFrame:
    """Contigs of the last of a series of assemblies with rising k, each with a cleaned graph: the long contigs of each
    round, given twice so that their windows count as seen twice, join the reads of the next."""
    mean = sample_lengths(reads, n=10_000).first()["mean_length"] or 0
    last = max(first_k, round(0.95 * mean * p.density))
    own = minspace.reads_once(reads)
    source = own
    contigs = None
    for k in range(first_k, last + 1, step):
        contigs = written(assemble(source, replace(p, k=k), tip_nodes, tip_length, bubble_length, rounds, weighted=True).contigs)
        long = contigs.where(F.length("seq") >= min_contig)
        copies = [long.select(F.concat(F.lit(f"k{k}.{i}."), "name").alias("read_id"), "seq") for i in (1, 2)]
        source = copies[0].unionByName(copies[1]).unionByName(own)
    return contigs


def read_stats(reads: DataFrame, p: Params) -> DataFrame:
    """read_id, counts: abundance of each window of each read among the kept nodes."""
    lists = written(minspace.minimizers(minspace.reads_once(reads), p))
    return kminmers.read_stats(lists, kminmers.counts(lists, p.k, p.min_abundance, p.strict), p.k, p.strict)


def containment(genomes: DataFrame, genes: DataFrame, p: Params) -> DataFrame:
    """query_id, n_kminmers, covered, pct: how much of each gene's windows occurs in the genomes, both (read_id, seq)."""
    a, b = (minspace.minimizers(minspace.reads_once(x), p) for x in (genomes, genes))
    return kminmers.coverage(a, b, p.k)
