"""Occurrences and records of every term: external sort of (term, record) pairs and a run-length scan.

Pairs are range-partitioned on (field, term, record), so a term that holds a third of all pairs is cut between records and no
task gets it whole; each task sorts its range (spilling as needed) and scans it once.  Equal pairs never part, hence
the distinct records of a term's pieces add up exactly.

Null terms and null records form no pair; empty inputs give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Run-length scan of sorted (field, item, rec) rows; a run may go on over batches."""
    open_run = None  # field, item, occurrences, records, last rec
    for batch in batches:
        f, x, r = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
        if not len(f):
            continue
        new_item = np.append(True, (f[1:] != f[:-1]) | (x[1:] != x[:-1]))
        new_rec = new_item | np.append(True, r[1:] != r[:-1])
        first = np.flatnonzero(new_item)
        occ = np.diff(np.append(first, len(f)))
        recs = np.add.reduceat(new_rec.astype(np.int64), first)
        fi, xi = f[first], x[first]
        if open_run is not None:
            if (fi[0], xi[0]) == open_run[:2]:
                occ[0] += open_run[2]
                recs[0] += open_run[3] - (r[0] == open_run[4])
            else:
                fi, xi = np.insert(fi, 0, open_run[0]), np.insert(xi, 0, open_run[1])
                occ, recs = np.insert(occ, 0, open_run[2]), np.insert(recs, 0, open_run[3])
        open_run = (fi[-1], xi[-1], occ[-1], recs[-1], r[-1])
        yield _batch(fi[:-1], xi[:-1], occ[:-1], recs[:-1])
    if open_run is not None:
        yield _batch(*[np.array([v]) for v in open_run[:4]])


def _batch(f, x, occ, recs) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(f.astype(np.int32)), pa.array(x.astype(np.int64)), pa.array(occ.astype(np.int64)), pa.array(recs.astype(np.int64))],
        names=["field", "item", "occurrences", "records"],
    )


def term_counts(pairs: DataFrame) -> DataFrame:
    """field int, item bigint, occurrences, records from rows (field int, item bigint, rec bigint)."""
    kept = pairs.select("field", "item", "rec").where(F.col("field").isNotNull() & F.col("item").isNotNull() & F.col("rec").isNotNull())
    runs = kept.repartitionByRange("field", "item", "rec").sortWithinPartitions("field", "item", "rec")
    parts = runs.mapInArrow(_scan, "field int, item bigint, occurrences bigint, records bigint")
    # a term has more than one part only where a range boundary cuts it
    return parts.groupBy("field", "item").agg(F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records"))


def marked(counts: DataFrame, totals: DataFrame, common_share: dict[int, float], min_common: int = 10) -> DataFrame:
    """Adds `mark`: rare (one record), common (more than the field's share of records, and at least `min_common`), else null.

    `totals` has one row for each field: field, n_records.
    """
    limit = F.lit(None).cast("double")
    for field, share in common_share.items():
        limit = F.when(F.col("field") == field, F.lit(share)).otherwise(limit)
    mark = F.when(F.col("records") == 1, "rare").when((F.col("records") > limit * F.col("n_records")) & (F.col("records") >= min_common), "common")
    return counts.join(F.broadcast(totals), "field").withColumn("mark", mark).drop("n_records")
