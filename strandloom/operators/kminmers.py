"""Windows of k minimizers: occurrences, counts, nodes, abundance by read.

Lists with at most k elements give no window in strict mode (the reference point of this engine), shorter ones never.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandloom.functions.dna import canonical, is_reversed, windows


def lists_once(minspace: DataFrame) -> DataFrame:
    """read_id, minims, pos: one row for each id with a list; rows of one id that hold a list hold the same one."""
    kept = minspace.where(F.col("read_id").isNotNull() & F.col("minims").isNotNull())
    return kept.groupBy("read_id").agg(F.first("minims").alias("minims"), F.first("pos").alias("pos"))


def occurrences(lists: DataFrame, k: int, strict: bool = True) -> DataFrame:
    """read_id, i, kmer (canonical), rev, shift_l, shift_r, start, span: one row for each window.

    shift_l is the distance from the first to the second minimizer in the direction of the canonical form, shift_r that
    from the last but one to the last; span is the node's length as graphs state it.
    """
    size = F.size("minims")
    rows = lists.where(size > k if strict else size >= k).select("read_id", "pos", F.posexplode(windows("minims", k)).alias("i", "w"))
    return _placed(rows, k, "i")


def _placed(rows: DataFrame, k: int, *more: str) -> DataFrame:
    """The columns of `occurrences` and `more` of rows (read_id, pos, i, w)."""
    rev = is_reversed(F.col("w"))
    at = lambda o: F.element_at("pos", F.col("i") + 1 + o)
    first, last = at(1) - at(0), at(k - 1) - at(k - 2)
    return rows.select(
        "read_id", *more, canonical(F.col("w")).alias("kmer"), rev.alias("rev"),
        F.when(rev, last).otherwise(first).alias("shift_l"), F.when(rev, first).otherwise(last).alias("shift_r"),
        at(0).alias("start"), (at(k - 1) - at(0) + 2).alias("span"),
    )


def counts(lists: DataFrame, k: int, min_abundance: int = 1, strict: bool = True) -> DataFrame:
    """kmer, abundance."""
    size = F.size("minims")
    kmers = lists.where(size > k if strict else size >= k).select(F.explode(windows("minims", k)).alias("w")).select(canonical(F.col("w")).alias("kmer"))
    return kmers.groupBy("kmer").agg(F.count("*").alias("abundance")).where(F.col("abundance") >= min_abundance)


def smallest_per_key(df: DataFrame, keys: list[str], order: list[str], n: int, shards: int = 64) -> DataFrame:
    """The n rows of each key that come first by `order`, with their number `place`; a hot key is cut to n rows in each of `shards`
    pieces before its pieces meet."""
    cut = Window.partitionBy(*keys, "__shard").orderBy(*order)
    part = df.withColumn("__shard", F.pmod(F.xxhash64(*order), F.lit(shards))).withColumn("place", F.row_number().over(cut)).where(F.col("place") <= n)
    return part.drop("__shard").withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("place") <= n)


def nodes(lists: DataFrame, k: int, min_abundance: int = 2, strict: bool = True) -> DataFrame:
    """kmer, abundance, seqlen, shift_l, shift_r, read_id, start, rev: kept windows, each with the place of its
    min_abundance-th occurrence by (read_id, i).  Each read_id must have one list.

    Windows meet by 96 bits and not by their elements.  Each batch sends of a window its number and its first min_abundance places, so a
    common window costs so many rows a batch; only windows that stay fetch their elements from their list.
    """
    size = F.size("minims")
    # read twice: with the same columns and filters, so that a shuffle below (`lists_once`) is made once
    whole = lists.where((size > k if strict else size >= k) & F.col("read_id").isNotNull()).select("read_id", "minims", "pos")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _first_places(batch, k, min_abundance)

    rows = whole.mapInArrow(run, "a bigint, b int, n int, read_id string, i int")
    same = Window.partitionBy("a", "b")
    ranked = rows.select("read_id", "i", F.row_number().over(same.orderBy("read_id", "i")).alias("place"), F.sum("n").over(same).alias("abundance"))
    kept = ranked.where((F.col("place") == min_abundance) & (F.col("abundance") >= min_abundance))
    per = kept.groupBy("read_id").agg(F.collect_list(F.struct("i", "abundance")).alias("kept"))  # bounded by the read's length
    found = whole.join(per, "read_id").select("read_id", "minims", "pos", F.inline("kept"))
    found = found.select("read_id", "pos", "i", F.slice("minims", F.col("i") + 1, k).alias("w"), "abundance")
    return _placed(found, k, "abundance").select("kmer", "abundance", F.col("span").cast("bigint").alias("seqlen"), "shift_l", "shift_r", "read_id", "start", "rev")


def _first_places(batch: pa.RecordBatch, k: int, most: int) -> pa.RecordBatch:
    """a, b (96 bits of each window of rows (read_id, minims, ...), the same in either direction), n, read_id, i: the first `most` places of
    each window by (read_id, i); n is the window's number in the batch on its first row and 0 on others."""
    batch = batch.take(pc.sort_indices(batch.column(0)))
    ids, minims = batch.column(0), batch.column(1)
    at = np.concatenate([[0], np.cumsum(pc.list_value_length(minims).to_numpy(zero_copy_only=False), dtype=np.int64)])
    values = minims.flatten().fill_null(-1).to_numpy(zero_copy_only=False).view(np.uint64)
    row = np.repeat(np.arange(len(ids)), np.maximum(np.diff(at) - k + 1, 0))
    i = np.arange(len(row)) - np.searchsorted(row, row)
    start = at[row] + i

    def folded(steps: range, seed: int) -> np.ndarray:
        h = np.full(len(start), seed, dtype=np.uint64)
        for j in steps:
            h = (h ^ values[start + j]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(32)
            h *= np.uint64(0xD6E8FEB86659FD93)
            h ^= h >> np.uint64(32)
        return h

    a, back = folded(range(k), 1), folded(range(k - 1, -1, -1), 1)
    b = np.where(a <= back, folded(range(k), 2), folded(range(k - 1, -1, -1), 2)).astype(np.uint32).view(np.int32)
    a = np.minimum(a, back).view(np.int64)
    order = np.lexsort((b, a))  # stable: places of one window stay in order
    a, b, row, i = a[order], b[order], row[order], i[order]
    first = np.flatnonzero(np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]))[: len(a)])
    number = np.diff(np.append(first, len(a)))
    n = np.zeros(len(a), dtype=np.int32)
    n[first] = number
    keep = np.arange(len(a)) - np.repeat(first, number) < most
    return pa.RecordBatch.from_arrays(
        [pa.array(a[keep]), pa.array(b[keep]), pa.array(n[keep]), ids.take(pa.array(row[keep])), pa.array(i[keep].astype(np.int32))], names=["a", "b", "n", "read_id", "i"])


def node_ids(found: DataFrame) -> DataFrame:
    """Adds node_id, a 64-bit hash of the k-min-mer: the same in every run and partition.  See `checked_ids`."""
    return found.withColumn("node_id", F.xxhash64("kmer"))


def checked_ids(nodes: DataFrame) -> DataFrame:
    """`nodes`, of which each k-min-mer has one row; fails if two of them have one node_id."""
    if not nodes.groupBy("node_id").agg(F.count("*").alias("n")).where("n > 1").isEmpty():
        raise ValueError("two k-min-mers have one hash")
    return nodes


def read_stats(lists: DataFrame, known: DataFrame, k: int, strict: bool = True) -> DataFrame:
    """read_id, counts array<bigint>: abundance of each of a read's windows in order, 0 for unknown ones."""
    occ = occurrences(lists, k, strict).select("read_id", "i", "kmer")
    rows = occ.join(known.select("kmer", "abundance"), "kmer", "left")
    listed = F.array_sort(F.collect_list(F.struct("i", F.coalesce("abundance", F.lit(0)).cast("bigint").alias("n"))))  # bounded by the read's length
    return rows.groupBy("read_id").agg(F.transform(listed, lambda x: x["n"]).alias("counts"))


def hits(targets: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """target_id, pos, query_id, query_pos for every window that a target and a query share in either direction.

    Both sides are (read_id, minims, pos).  Positions are window numbers; the query side is usually far smaller and adaptive execution
    splits windows that very many targets hold.
    """
    t = occurrences(targets, k, strict=False).select(F.col("read_id").alias("target_id"), F.col("i").alias("pos"), "kmer")
    q = occurrences(queries, k, strict=False).select(F.col("read_id").alias("query_id"), F.col("i").alias("query_pos"), "kmer")
    return t.join(q, "kmer").select("target_id", "pos", "query_id", "query_pos")


def node_hits(nodes: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """target_id (`*`), query_id, query_pos: windows of the queries that a graph's nodes (kmer) hold, whose places are not known."""
    q = occurrences(queries, k, strict=False).select(F.col("read_id").alias("query_id"), F.col("i").alias("query_pos"), "kmer")
    return q.join(nodes.select(canonical(F.col("kmer")).alias("kmer")).distinct(), "kmer", "left_semi").select(F.lit("*").alias("target_id"), "query_id", "query_pos")


def hit_windows(targets: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """target_id, pos, n_hits: each window of a target that queries hold in either direction, with its occurrences among them.

    What `hits` lists, without a row for each pair: queries are counted by window first, so a window that many of them hold costs
    one row for each place in a target.
    """
    t = occurrences(targets, k, strict=False).select(F.col("read_id").alias("target_id"), F.col("i").alias("pos"), "kmer")
    return t.join(counts(queries, k, strict=False), "kmer").select("target_id", "pos", F.col("abundance").alias("n_hits"))


def coverage(targets: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """query_id, n_kminmers, covered, pct: distinct windows of each query that any target holds; queries with no window are left out.

    Needs only which windows exist among the targets, so a window that many targets hold costs one row.
    """
    q = occurrences(queries, k, strict=False).select(F.col("read_id").alias("query_id"), "i", "kmer")
    held = counts(targets, k, strict=False).select("kmer", F.lit(1).alias("held"))
    rows = q.join(held, "kmer", "left")
    per = rows.groupBy("query_id").agg(F.count("*").alias("n_kminmers"), F.count("held").alias("covered"))
    return per.withColumn("pct", 100 * F.col("covered") / F.col("n_kminmers"))


def compare_sets(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: n_a, n_b, n_both, pct_a_in_b, pct_b_in_a of two frames of k-min-mers (kmer)."""
    tagged = a.select("kmer", F.lit(1).alias("a"), F.lit(0).alias("b")).unionByName(b.select("kmer", F.lit(0).alias("a"), F.lit(1).alias("b")))
    per = tagged.groupBy("kmer").agg(F.max("a").alias("a"), F.max("b").alias("b"))
    n = lambda c: F.coalesce(F.sum(c), F.lit(0))
    one = per.agg(n("a").alias("n_a"), n("b").alias("n_b"), n(F.col("a") * F.col("b")).alias("n_both"))
    pct = lambda c: 100 * F.col("n_both") / F.nullif(F.col(c), F.lit(0))
    return one.withColumn("pct_a_in_b", pct("n_a")).withColumn("pct_b_in_a", pct("n_b"))


def abundance_histogram(found: DataFrame, genomic: Column, width: int = 5, top: int = 500) -> DataFrame:
    """bin, genomic, erroneous: windows by abundance; `genomic` tells the true ones."""
    kept = found.where(F.col("abundance") < top)
    return kept.groupBy((F.floor(F.col("abundance") / width) * width).alias("bin")).agg(F.count_if(genomic).alias("genomic"), F.count_if(~genomic).alias("erroneous"))


def mappability(found: DataFrame) -> DataFrame:
    """n_distinct and pct_unique: share of the distinct windows that occur once."""
    return found.agg(F.count("*").alias("n_distinct"), (100 * F.avg((F.col("abundance") == 1).cast("double"))).alias("pct_unique"))


def ngram_successors(lists: DataFrame, n: int) -> DataFrame:
    """gram, next, n, share: how often each element follows each run of n elements."""
    rows = lists.select(F.explode(windows("minims", n + 1)).alias("w"))
    per = rows.groupBy(F.slice("w", 1, n).alias("gram"), F.element_at("w", n + 1).alias("next")).agg(F.count("*").alias("n"))
    return per


def spacing(lists: DataFrame) -> DataFrame:
    """read_id, mean_gap: sum of the gaps between selected positions over the number of positions, -1 without any."""
    n = F.size("pos")
    return lists.select("read_id", F.when(n > 0, (F.element_at("pos", -1) - F.element_at("pos", 1)) / n).otherwise(-1.0).alias("mean_gap"))
