"""Column functions for sequences and minimizer lists."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clean_seq(c: str | Column) -> Column:
    """Upper case, U as T, without white space."""
    return F.regexp_replace(F.translate(F.upper(c), "U", "T"), r"\s", "")


def collapse_runs(c: str | Column) -> Column:
    """Homopolymer compression of A, C, G, T and N in either case."""
    return F.regexp_replace(c, r"([ACGTNacgtn])\1+", "$1")


def only_bases(c: str | Column) -> Column:
    """Letters outside ACGT, in either case, become N."""
    return F.regexp_replace(c, "[^ACGTacgt]", "N")


def reverse_complement(c: str | Column) -> Column:
    """A and T, C and G swapped in either case, U read as T; every other letter becomes N."""
    return F.reverse(F.translate(F.regexp_replace(c, "[^ACGTUacgtu]", "N"), "ACGTUacgtu", "TGCAAtgcaa"))


def fold(c: str | Column, width: int = 80) -> Column:
    """Line breaks after every `width` letters."""
    return F.regexp_replace(c, f"(.{{{width}}})(?!$)", "$1\n")


def windows(c: str, k: int) -> Column:
    """All runs of k consecutive elements of a list, in order; empty for shorter lists."""
    n = F.size(c)
    starts = F.when(n >= k, F.sequence(F.lit(1), F.greatest(n - k + 1, F.lit(1)))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.slice(F.col(c), i, k))


def canonical(c: Column) -> Column:
    """Smaller of a list and its reverse."""
    return F.least(c, F.reverse(c))


def is_reversed(c: Column) -> Column:
    """Whether the canonical form is the reverse; true for palindromes."""
    return ~(c < F.reverse(c))


def without_last(c: Column, k: int) -> Column:
    return F.slice(c, 1, k - 1)


def without_first(c: Column, k: int) -> Column:
    return F.slice(c, 2, k - 1)


def shown(c: Column) -> Column:
    """A list in brackets with commas."""
    return F.concat(F.lit("["), F.array_join(c.cast("array<string>"), ", "), F.lit("]"))


def set_distance(a: Column, b: Column, kind: str, l: int = 12) -> Column:
    """jaccard or containment (of a) distance, or Mash distance of two lists taken as sets; null for two empty lists."""
    both = F.size(F.array_intersect(a, b))
    if kind == "containment":
        return 1 - both / F.nullif(F.size(F.array_distinct(a)), F.lit(0))
    j = both / F.nullif(F.size(F.array_union(a, b)), F.lit(0))
    if kind == "jaccard":
        return 1 - j
    if kind == "mash":
        return F.when(j == 0, 1.0).otherwise(-F.log(2 * j / (1 + j)) / l)
    raise ValueError(f"no distance {kind}")
