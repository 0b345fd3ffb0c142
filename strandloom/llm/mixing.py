"""Mixing of sources to target shares: soft membership, projected-gradient rates, exact rounding.

1. Every document gets its size in tokens and its membership: a document that names a target source belongs to it; for the others
   a classifier counted over the whole table of documents with a known source (by repository, smoothed with the
   source's overall share, times the language's share) gives the posterior over the sources.
2. The largest total is set that the repeat caps allow.  Nonnegative rates, at most the cap, are fitted by projected gradient descent on
   the squared relative errors of the expected token totals.  A document's rate follows from its posterior and size, so documents that
   agree in both are counted first; each round is a distributed pass over these groups, in which each task folds the short history
   of steps, so no rates are shuffled or kept.  A fit that does not converge fails.
3. Rates become whole repeats: the whole part for certain, one more for the documents of smallest (random / fraction) until the
   fractions' tokens are used up, so a source misses its expected total by at most half of one document.

A document with more tokens than the whole target of its source cannot be used without missing the share; its rate is 0 and `shares`
reports the tokens of such documents.  A document of uncertain source is repeated no more often than every source that it may be of allows.  Documents with a null or empty
text have no tokens and are not used; sources outside the targets join only through the posterior.  A target source without
documents gets nothing and is reported with share 0.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandloom.llm.encode import VOCABULARY, count_tokens
from strandloom.session import saved

#: Weight of a source's overall share against a repository's counts.
SMOOTHING = 2.0
#: Ranges of the rounding key; only the range in which a source's tokens run out is sorted.
RANGES = 1 << 16
#: Rounds after which a descent that has not met the tolerance fails.
ROUNDS, TOLERANCE = 100, 1e-3


@dataclass(frozen=True)
class Targets:
    names: list[str]
    shares: np.ndarray
    caps: np.ndarray


def read_targets(df: DataFrame) -> Targets:
    """The (fixed, short) table source, target_share, max_repeats."""
    rows = df.where("source IS NOT NULL AND target_share > 0").orderBy("source").collect()
    share = np.array([r.target_share for r in rows], dtype=float)
    return Targets([r.source for r in rows], share / share.sum() if len(rows) else share, np.array([r.max_repeats or 0 for r in rows], dtype=np.int64))


def known_source(names: list[str]) -> Column:
    """The target source that a document names, in any case and with outer blanks; else null."""
    s = F.lower(F.trim("source"))
    if not names:
        return F.lit(None).cast("string")
    return F.when(s.isin(*names), s)


def memberships(documents: DataFrame, targets: Targets, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, domain (null if not named), n_tokens, p array<double> over the targets' names."""
    names = targets.names
    if not names:
        none = F.lit(None).cast("string"), F.array().cast("array<double>")
        return count_tokens(documents, "doc_id", "text", ["doc_id"], vocabulary).select("doc_id", none[0].alias("domain"), "n_tokens", none[1].alias("p"))
    lang = F.lower(F.trim("lang"))
    slim = saved(count_tokens(documents, "doc_id", "text", ["doc_id", "source", "repo", "lang"], vocabulary).select("doc_id", "n_tokens", "repo", lang.alias("tag"), known_source(names).alias("domain")))
    named, rest = slim.where(F.col("domain").isNotNull()), slim.where(F.col("domain").isNull())
    counts = lambda df, *by: df.groupBy(*by).agg(*[F.count_if(F.col("domain") == x).cast("double").alias(f"n{i}") for i, x in enumerate(names)])
    vector = F.array(*[F.col(f"n{i}") for i in range(len(names))])
    prior = np.array(counts(named).first(), dtype=float)
    prior = (prior + 1) / (prior + 1).sum()
    lit = lambda x: F.array(*[F.lit(float(v)) for v in x])
    # unnamed documents only; a repository or language that holds many of them meets one row, so adaptive execution may split it
    joined = rest
    for column, count in (("repo", "repo_n"), ("tag", "tag_n")):
        known = counts(named.where(F.col(column).isNotNull()), column).select(column, vector.alias(count))
        joined = joined.join(known, column, "left")
    zero = lit(np.zeros(len(names)))
    smooth = lambda n, weight: F.zip_with(F.coalesce(n, zero), lit(prior * weight), lambda a, b: a + b)
    raw = F.zip_with(smooth(F.col("repo_n"), SMOOTHING), F.zip_with(smooth(F.col("tag_n"), 100.0), lit(prior), lambda a, b: a / b), lambda a, b: a * b)
    soft = joined.withColumn("raw", raw).withColumn("total", F.aggregate("raw", F.lit(0.0), lambda a, x: a + x))
    p = F.transform("raw", lambda x: x / F.col("total"))
    hard = F.array(*[F.when(F.col("domain") == x, 1.0).otherwise(0.0) for x in names])
    return named.select("doc_id", "domain", "n_tokens", hard.alias("p")).unionByName(soft.select("doc_id", "domain", "n_tokens", p.alias("p")))


@dataclass(frozen=True)
class Descent:
    """What a document's rate follows from: first rates by source and the steps; and what the fit came to."""

    start: np.ndarray
    steps: list[np.ndarray]
    target: np.ndarray
    error: np.ndarray


def _rates(t: np.ndarray, p: np.ndarray, d: Descent, caps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Caps and rates of documents of `t` tokens with the memberships `p` after the steps of `d`."""
    if not len(caps):
        return np.zeros(len(p)), np.zeros(len(p))
    cap = np.where(p > 0, caps, caps.max()).min(axis=1).astype(float)
    cap[(t == 0) | (t > p @ d.target)] = 0
    r = np.clip(p @ d.start, 0, cap)
    for step in d.steps:
        r = np.clip(r - p @ step, 0, cap)
    return cap, r


def _memberships(col: pa.Array, k: int) -> np.ndarray:
    return col.flatten().to_numpy(zero_copy_only=False).reshape(len(col), k)


def fit_rates(members: DataFrame, targets: Targets) -> Descent:
    """The descent over all documents."""
    caps, k = targets.caps, len(targets.names)
    zero = np.zeros(k)
    if not k:
        return Descent(zero, [], zero, zero)
    groups = saved(members.groupBy("p", "n_tokens").agg(F.count("*").alias("n")))

    def totals(d: Descent) -> np.ndarray:
        """Sums over documents, for each source: expected tokens, tokens of certain members at their caps, usable tokens."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums = np.zeros(3 * k)
            for batch in batches:
                p, (t, n) = _memberships(batch.column(0), k), (batch.column(i).to_numpy(zero_copy_only=False).astype(float) for i in (1, 2))
                cap, r = _rates(t, p, d, caps)
                sums += np.concatenate([(r * t * n) @ p, (cap * t * n) @ (p == 1), (t * n * (cap > 0)) @ p])
            yield pa.RecordBatch.from_arrays([pa.array(range(3 * k), pa.int32()), pa.array(sums)], names=["i", "x"])

        out = np.zeros(3 * k)
        for i, x in groups.mapInArrow(run, "i int, x double").groupBy("i").agg(F.sum("x")).collect():  # 3 k rows
            out[i] = x
        return out.reshape(3, k)

    target = np.full(k, np.inf)
    for _ in range(ROUNDS):
        _, most, tokens = totals(Descent(zero, [], np.where(np.isinf(target), 1e18, target), zero))
        there = most > 0
        if not there.any():
            return Descent(zero, [], zero, zero)
        share = np.where(there, targets.shares, 0) / targets.shares[there].sum()
        # the largest total that the certain members alone can supply; it only ever falls, as documents become too large for it
        before, target = target, share * min(most[there] / share[there])
        if np.allclose(before, target, rtol=1e-9):
            break
    else:
        raise RuntimeError(f"the largest possible total is not settled after {ROUNDS} rounds")
    start, steps = np.where(there, target / np.maximum(tokens, 1), 0), []
    for _ in range(ROUNDS):
        got = totals(Descent(start, steps, target, zero))[0]
        error = np.where(there, (got - target) / np.maximum(target, 1), 0)
        if np.abs(error).max() < TOLERANCE:
            return Descent(start, steps, target, error)
        # the gradient, scaled by each source's tokens
        steps.append(np.where(there, (got - target) / np.maximum(tokens, 1), 0))
    raise RuntimeError(f"the rates miss their targets by {np.abs(error).max():.2g} after {ROUNDS} rounds")


def choose(members: DataFrame, targets: Targets) -> DataFrame:
    """doc_id, domain, soft, n_tokens, p, rate, repeats of every document; domain is the most probable source.

    `members` is read several times and should be saved.
    """
    descent = fit_rates(members, targets)
    names, caps = targets.names, targets.caps
    kind = members.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = _memberships(batch["p"], len(names))
            r = _rates(batch["n_tokens"].to_numpy(zero_copy_only=False), p, descent, caps)[1]
            best = pa.array([names[i] for i in p.argmax(axis=1)], pa.string()) if names else pa.nulls(len(p), pa.string())
            yield pa.RecordBatch.from_arrays([batch["doc_id"], best, batch["domain"].is_null(), batch["n_tokens"], batch["p"], pa.array(r)], names=["doc_id", "domain", "soft", "n_tokens", "p", "rate"])

    rated = members.mapInArrow(run, f"doc_id {kind}, domain string, soft boolean, n_tokens bigint, p array<double>, rate double")
    rated = rated.withColumn("whole", F.floor(F.col("rate") + 1e-9)).withColumn("part", F.greatest(F.col("rate") - F.col("whole"), F.lit(0.0)))
    chance = (F.xxhash64(F.lit(8), "doc_id").bitwiseAND(F.lit((1 << 40) - 1)) + 0.5) / float(1 << 40)
    rated = rated.withColumn("key", F.when(F.col("part") > 1e-9, chance / F.col("part")))
    rated = saved(rated.withColumn("range", F.least(F.floor(F.lit(RANGES) * F.col("key") / (1 + F.col("key"))), F.lit(RANGES - 1))))
    # at most RANGES rows a source; the range in which the source's tokens run out
    ranges = rated.where("key IS NOT NULL").groupBy("domain", "range").agg(F.sum("n_tokens").alias("inside"), F.sum(F.col("part") * F.col("n_tokens")).alias("wanted"))
    by = Window.partitionBy("domain")
    ranges = ranges.withColumn("wanted", F.sum("wanted").over(by)).withColumn("upto", F.sum("inside").over(by.orderBy("range")))
    split = ranges.where(F.col("upto") > F.col("wanted")).groupBy("domain").agg(
        F.min("range").alias("split"), F.min_by(F.col("upto") - F.col("inside"), "range").alias("before"), F.first("wanted").alias("wanted")
    )  # one row a source
    last = rated.join(F.broadcast(split), "domain").where(F.col("range") == F.col("split"))
    last = last.withColumn("upto", F.col("before") + F.sum("n_tokens").over(by.orderBy("key", "doc_id")))  # rows of one range
    last = last.where(F.col("upto") - F.col("n_tokens") / 2 <= F.col("wanted")).groupBy("domain").agg(F.max(F.struct("key", "doc_id")).alias("upto"))
    cut = split.select("domain", "split").join(last, "domain", "left")
    extra = F.col("key").isNotNull() & (
        F.col("split").isNull() | (F.col("range") < F.col("split")) | ((F.col("range") == F.col("split")) & F.coalesce(F.struct("key", "doc_id") <= F.col("upto"), F.lit(False)))
    )
    repeats = (F.col("whole") + extra.cast("int")).cast("int").alias("repeats")
    return rated.join(F.broadcast(cut), "domain", "left").select("doc_id", "domain", "soft", "n_tokens", "p", "rate", repeats)


def shares(chosen: DataFrame, targets: Targets) -> DataFrame:
    """source, target_share, max_repeats, available, too_large, tokens, share, expected_share, most_repeats: what the mix came to.

    `too_large` are the tokens of documents that no mix of this size can use.  `tokens` and `share` count documents by the source they name (all other used documents form the row with a null source);
    `expected_share` spreads those over the sources by their posterior.
    """
    used = F.col("repeats") * F.col("n_tokens")
    spread = [F.sum(used * F.element_at("p", i + 1)) for i in range(len(targets.names))]
    own = F.when(~F.col("soft"), F.col("domain"))
    got = chosen.groupBy(own.alias("source")).agg(
        F.sum("n_tokens").alias("available"), F.sum(F.when(F.col("rate") == 0, F.col("n_tokens"))).alias("too_large"), F.sum(used).alias("tokens"), F.max("repeats").alias("most_repeats"), F.array(*spread).alias("spread")
    )  # one row a source
    every = Window.partitionBy(F.lit(0))
    total = F.sum("tokens").over(every)
    listed = chosen.sparkSession.createDataFrame(
        [(n, float(s), int(c), i) for i, (n, s, c) in enumerate(zip(targets.names, targets.shares, targets.caps))], "source string, target_share double, max_repeats int, at int"
    )
    sums = [F.sum(F.element_at("spread", i + 1)).over(every) for i in range(len(targets.names))]
    full = got.join(listed, "source", "full").withColumn("sums", F.array(*sums))
    return full.select(
        "source", "target_share", "max_repeats", F.coalesce("available", F.lit(0)).alias("available"), F.coalesce("too_large", F.lit(0)).alias("too_large"), F.coalesce("tokens", F.lit(0)).alias("tokens"),
        F.coalesce(F.col("tokens") / total, F.lit(0.0)).alias("share"), (F.try_element_at("sums", F.col("at") + 1) / total).alias("expected_share"), F.coalesce("most_repeats", F.lit(0)).alias("most_repeats"),
    )
