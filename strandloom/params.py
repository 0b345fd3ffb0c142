"""Parameters of a run, validated, and their automatic choice."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Params:
    """k: minimizers of a node; l: letters of a minimizer; density: share of l-mers kept; scheme: density, syncmers, uhs (of a universal
    set) or lcp (of a set of core strings; those two take a list of l-mers); s: letters of the inner windows of syncmers; hpc: collapse runs first; min_abundance and presimp: graph filters."""

    k: int = 10
    l: int = 12
    density: float = 0.1
    scheme: str = "density"
    s: int = 4
    hpc: bool = True
    min_abundance: int = 2
    presimp: float = 0.01
    strict: bool = True

    def __post_init__(self) -> None:
        if self.k < 2 or self.l < 1 or self.min_abundance < 1 or not 0 < self.density <= 0.5 or self.presimp < 0:
            raise ValueError("k >= 2, l >= 1, min_abundance >= 1, 0 < density <= 0.5 and presimp >= 0 are needed")
        if self.scheme not in ("density", "syncmers", "uhs", "lcp"):
            raise ValueError(f"no scheme {self.scheme}")
        if self.scheme == "syncmers" and not 0 <= self.s < self.l <= 31:
            raise ValueError("0 <= s < l <= 31 is needed")


def sample_lengths(reads: DataFrame, seq: str = "seq", n: int = 100) -> DataFrame:
    """mean_length (whole number) and max_length of the n reads with the smallest ids."""
    first = reads.where(F.col(seq).isNotNull()).orderBy("read_id", F.length(seq)).limit(n)
    return first.agg(F.floor(F.avg(F.length(seq))).alias("mean_length"), F.max(F.length(seq)).alias("max_length"))


def autodetect(reads: DataFrame, base: Params | None = None) -> Params:
    """l = 12, density = 0.003 and k from the mean length of a sample of reads."""
    mean = sample_lengths(reads).first()["mean_length"] or 0
    return replace(base or Params(), l=12, density=0.003, k=max(2, int(mean * 0.003)))
