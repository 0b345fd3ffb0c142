"""Sequences to lists of selected l-mers ("minimizer space").

Null and empty sequences and those shorter than l give empty lists.  Positions are those of the sequence as given (without white
space), also where runs were collapsed before hashing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom import kernels as K
from strandloom.functions.dna import reverse_complement
from strandloom.operators.kminmers import lists_once
from strandloom.params import Params
from strandloom.session import written

#: Bytes of sequence that one pass of the array code takes at most (a longer sequence is its own pass).
BLOCK_BYTES = 8 << 20
#: Ids of several rows that are broadcast at most.
FEW = 2_000_000


def reads_once(reads: DataFrame) -> DataFrame:
    """read_id, seq: one row for each id with a sequence; rows of one id that hold a sequence hold the same one."""
    return with_sequence(reads).groupBy("read_id").agg(F.first("seq").alias("seq"))


def with_sequence(reads: DataFrame) -> DataFrame:
    """read_id, seq: the rows that have both."""
    return reads.where(F.col("read_id").isNotNull() & F.col("seq").isNotNull() & ~F.trim("seq").isin("", "*")).select("read_id", "seq")


def lists_of_reads(reads: DataFrame, p: Params) -> DataFrame:
    """`kminmers.lists_once` of the minimizers of reads (read_id, seq): only lists of ids that have several rows are shuffled.

    Such ids are known by 64 bits, of which up to FEW are broadcast; an id with another's bits is shuffled with it.  Where there are more,
    all lists are shuffled.
    """
    own = with_sequence(reads).withColumn("bits", F.xxhash64("read_id"))
    several = written(own.groupBy("bits").agg(F.count("*").alias("n")).where("n > 1").select("bits"))
    if several.count() > FEW:
        return lists_once(minimizers(own, p))
    several = F.broadcast(several)
    alone = minimizers(own.join(several, "bits", "left_anti"), p)
    return alone.unionByName(lists_once(minimizers(own.join(several, "bits", "left_semi"), p)))


def minimizers(reads: DataFrame, p: Params, lmers: DataFrame | None = None) -> DataFrame:
    """read_id, minims array<bigint>, pos array<int> of rows (read_id, seq), which are not shuffled unless `lmers` is given.

    `lmers` (lmer) restricts the selection to l-mers that it holds on either strand (their first l letters count, shorter ones never);
    the schemes uhs and lcp need it.  Those two give positions after the collapsing of runs, and lcp leaves out l-mers with an N, as
    the original does.  With `lmers`, each read_id must have one row.
    """
    if lmers is None and p.scheme in ("uhs", "lcp"):
        raise ValueError(f"the scheme {p.scheme} needs a list of l-mers")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            data, at = K.string_bytes(batch.column(1))
            i = 0
            while i < len(ids):
                j = min(len(ids), max(i + 1, int(np.searchsorted(at, at[i] + BLOCK_BYTES, side="right")) - 1))
                d, a = K.clean(data[at[i] : at[j]], at[i : j + 1] - at[i])
                if p.scheme == "syncmers":
                    row, pos, h = _syncmers(d, a, p)
                else:
                    row, pos, h = K.density_minimizers(d, a, p.l, p.density, p.hpc, p.scheme in ("uhs", "lcp"), "N" if p.scheme == "lcp" else "")
                bounds = pa.array(np.searchsorted(row, np.arange(j - i + 1)).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(i, j - i), pa.ListArray.from_arrays(bounds, pa.array(h.astype(np.int64))), pa.ListArray.from_arrays(bounds, pa.array(pos.astype(np.int32)))],
                    names=["read_id", "minims", "pos"],
                )
                i = j

    found = reads.select("read_id", "seq").mapInArrow(run, "read_id string, minims array<bigint>, pos array<int>")
    return found if lmers is None else among(found, lmer_hashes(lmers, p.l))


def among(lists: DataFrame, hashes: DataFrame) -> DataFrame:
    """Lists without the elements that are not in `hashes` (minim); a list may become empty.

    An exact semi-join whatever the dictionary's size; a frequent l-mer meets one row of it, so adaptive execution may split it.
    """
    rows = lists.select("read_id", F.posexplode(F.arrays_zip("minims", "pos")).alias("i", "x")).select("read_id", "i", F.col("x.minims").alias("minim"), F.col("x.pos").alias("pos"))
    kept = rows.join(hashes.select("minim").distinct(), "minim", "left_semi")
    every = kept.select("read_id", F.struct("i", "minim", "pos").alias("x")).unionByName(lists.select("read_id", F.lit(None).cast("struct<i:int,minim:bigint,pos:int>").alias("x")))
    listed = every.groupBy("read_id").agg(F.array_sort(F.collect_list("x")).alias("xs"))  # bounded by the read's length
    return listed.select("read_id", F.transform("xs", lambda x: x["minim"]).alias("minims"), F.transform("xs", lambda x: x["pos"]).alias("pos"))


def lmer_hashes(lmers: DataFrame, l: int) -> DataFrame:
    """lmer, minim: the first l letters of each string, in upper case, with the hash that minimizers have; shorter ones and nulls are left out."""
    head = F.upper(F.substring(F.trim("lmer"), 1, l))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = K.string_bytes(batch.column(0))
            h = K.canonical_hashes(data, l)[at[:-1]] if len(batch) else np.empty(0, dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(h.view(np.int64))], names=["lmer", "minim"])

    ascii_only = F.length("lmer") == F.octet_length("lmer")
    return lmers.select(head.alias("lmer")).where((F.length("lmer") == l) & ascii_only).mapInArrow(run, "lmer string, minim bigint")


def dictionary(counts: DataFrame, l: int, density: float, low: int = 0, high: int = 1 << 62) -> DataFrame:
    """lmer, minim: the dictionary of counted l-mers (lmer, n): canonical l-mers that occur more than `low` and less than `high` times and
    whose hash the density keeps.  Both strands of an l-mer have its hash, so no second row is needed."""
    kept = lmer_hashes(counts.where((F.col("n") > low) & (F.col("n") < high)), l)
    canonical = F.least("lmer", reverse_complement("lmer"))
    # a density of at most 0.5 keeps hashes inside bigint, so larger ones are negative here
    return kept.where((F.col("minim") >= 0) & (F.col("minim") <= F.lit(min(int(K.density_bound(density)), (1 << 63) - 1)))).select(canonical.alias("lmer"), "minim").distinct()


def every_lmer(spark: SparkSession, l: int) -> DataFrame:
    """lmer, n (1): all canonical l-mers, for dictionaries without counts; 4^l rows are made, so l is at most 14."""
    if not 1 <= l <= 14:
        raise ValueError("1 <= l <= 14 is needed")
    letter = lambda i: F.substring(F.lit("ACGT"), (F.shiftright("id", 2 * i).bitwiseAND(F.lit(3)) + 1).cast("int"), F.lit(1))
    rows = spark.range(4**l).select(F.concat(*[letter(i) for i in reversed(range(l))]).alias("lmer"))
    return rows.where(F.col("lmer") <= reverse_complement("lmer")).select("lmer", F.lit(1).cast("bigint").alias("n"))


def dictionary_sizes(counts: DataFrame, kept: DataFrame, low: int, high: int) -> DataFrame:
    """One row: n_ids, n_sequences (both strands) of a dictionary, and n_skipped: counted l-mers left out for their number."""
    own = kept.agg(F.countDistinct("minim").alias("n_ids"), F.sum(F.when(F.col("lmer") == reverse_complement("lmer"), 1).otherwise(2)).alias("n_sequences"))
    return own.crossJoin(counts.agg(F.count_if((F.col("n") <= low) | (F.col("n") >= high)).alias("n_skipped")))  # one row each


def _syncmers(d: np.ndarray, a: np.ndarray, p: Params) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    if not p.hpc:
        return K.syncmers(d, a, p.l, p.s, p.density)
    d, a, where = K.collapse(d, a)
    row, start, h = K.syncmers(d, a, p.l, p.s, p.density)
    return row, where[a[row] + start], h


def lmer_counts(minspace: DataFrame) -> DataFrame:
    """lmer, n: occurrences of every selected l-mer, counted under the smaller of both strands."""
    lmers = minspace.select(F.explode("minimizers").alias("lmer")).where(F.col("lmer").isNotNull())
    return lmers.select(F.least("lmer", reverse_complement("lmer")).alias("lmer")).groupBy("lmer").agg(F.count("*").alias("n"))


def by_dictionary(minspace: DataFrame, lmers: DataFrame, keep: bool = True) -> DataFrame:
    """Positions of (read_id, minimizers, minims, pos) rows whose l-mer, on either strand, is (keep) or is not (drop) in `lmers`
    (lmer): rows read_id, i, lmer, minim, pos.  An exact semi- or anti-join, whatever the dictionary's size."""
    rows = minspace.select("read_id", F.posexplode(F.arrays_zip("minimizers", "minims", "pos")).alias("i", "x"))
    rows = rows.select("read_id", "i", F.col("x.minimizers").alias("lmer"), F.col("x.minims").alias("minim"), F.col("x.pos").alias("pos"))
    canonical = F.least("lmer", reverse_complement("lmer"))
    other = lmers.select(canonical.alias("__lmer")).distinct()
    return rows.join(other, canonical == F.col("__lmer"), "left_semi" if keep else "left_anti")
