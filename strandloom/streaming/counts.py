"""K-min-mer counts over reads that keep arriving."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.functions.dna import canonical, windows
from strandloom.operators.minspace import minimizers
from strandloom.params import Params


def stream_counts(reads: DataFrame, p: Params) -> DataFrame:
    """kmer, abundance of a streaming (or batch) frame (read_id, seq), to be written in update or complete mode.

    The count is associative, so each micro-batch adds partial counts to keyed state; rows are counted as they come, repeated ids
    included.  Without a watermark state is kept for every window ever seen.
    """
    size = F.size("minims")
    lists = minimizers(reads, p).where(size > p.k if p.strict else size >= p.k)
    return lists.select(F.explode(windows("minims", p.k)).alias("w")).groupBy(canonical(F.col("w")).alias("kmer")).agg(F.count("*").alias("abundance"))
