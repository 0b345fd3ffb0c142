"""Per-key work without stragglers when a few keys hold most rows.

Keys are placed by estimated load.  A pass with bounded memory estimates the load of every heavy key and of a fixed number of
hash buckets that stand for all light keys; the buckets and the heavy keys' shards are then bin-packed onto the tasks, largest
first.  Heavy keys are split into shards in proportion to their load, and a matching side is replicated to just those shards.

Nulls: a null key is a key like any other here.  Rows with a null or non-positive weight carry no load but are placed all the
same.  Empty inputs give empty results.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandloom.session import saved
from strandloom.session import tasks as session_tasks

#: Hash buckets that stand for the light keys.
BUCKETS = 4096
#: A key is heavy if its load exceeds this share of a task's fair load.
HEAVY_SHARE = 0.25
KEY, TASK = "__key", "__task"


def key_hash(keys: list[str]) -> Column:
    return F.xxhash64(*[F.col(k) for k in keys])


def _summaries(room: int):
    """Arrow kernel: per task, load by bucket and a Misra-Gries summary of `room` keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buckets = np.zeros(BUCKETS, dtype=np.int64)
        keys, loads = np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
        for batch in batches:
            k = batch.column(0).to_numpy(zero_copy_only=False)
            w = batch.column(1).to_numpy(zero_copy_only=False)
            buckets += np.bincount(k % BUCKETS, weights=w, minlength=BUCKETS).astype(np.int64)
            keys, at = np.unique(np.concatenate([keys, k]), return_inverse=True)
            loads = np.bincount(at, weights=np.concatenate([loads, w])).astype(np.int64)
            if len(keys) > room:
                loads = loads - np.partition(loads, len(loads) - room - 1)[len(loads) - room - 1]
                keys, loads = keys[loads > 0], loads[loads > 0]
        some = np.flatnonzero(buckets)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.concatenate([np.zeros(len(some), dtype=bool), np.ones(len(keys), dtype=bool)])),
                pa.array(np.concatenate([some, keys])),
                pa.array(np.concatenate([buckets[some], loads])),
            ],
            names=["is_key", "id", "load"],
        )

    return run


@dataclass(frozen=True)
class Placement:
    """Where rows go: task of each light bucket, tasks of each heavy key's shards.

    Both frames are bounded: `BUCKETS` rows, and at most tasks / HEAVY_SHARE keys.
    """

    buckets: DataFrame  # __bucket int, __light int
    heavy: DataFrame  # __key bigint, __shards array<int>
    tasks: int

    def _with_plan(self, df: DataFrame, keys: list[str]) -> DataFrame:
        return (
            df.withColumn(KEY, key_hash(keys))
            .withColumn("__bucket", F.pmod(F.col(KEY), F.lit(BUCKETS)).cast("int"))
            .join(F.broadcast(self.buckets), "__bucket", "left")
            .join(F.broadcast(self.heavy), KEY, "left")
            .withColumn("__light", F.coalesce("__light", F.pmod("__bucket", F.lit(self.tasks)).cast("int")))
        )

    def place(self, df: DataFrame, keys: list[str], spread: list[str]) -> DataFrame:
        """`df` shuffled once; adds `__task`.  Rows of a heavy key go to its shards by the hash of `spread` columns, which
        should tell its rows apart."""
        shard = F.element_at("__shards", (F.pmod(F.xxhash64(*spread), F.size("__shards")) + 1).cast("int"))
        return (
            self._with_plan(df, keys)
            .withColumn(TASK, F.when(F.col("__shards").isNull(), F.col("__light")).otherwise(shard))
            .drop(KEY, "__bucket", "__light", "__shards")
            .repartitionById(self.tasks, TASK)
        )

    def replicate(self, df: DataFrame, keys: list[str]) -> DataFrame:
        """The matching side: a heavy key's rows once for each task that holds one of its shards, others once."""
        where = F.when(F.col("__shards").isNull(), F.array("__light")).otherwise(F.array_distinct("__shards"))
        return (
            self._with_plan(df, keys)
            .withColumn(TASK, F.explode(where))
            .drop(KEY, "__bucket", "__light", "__shards")
            .repartitionById(self.tasks, TASK)
        )


def pack(loads: list[tuple[int, object]], tasks: int) -> dict:
    """Longest-first bin packing: item -> task, for (load, item) pairs."""
    heap = [(0, t) for t in range(tasks)]
    out = {}
    for load, item in sorted(loads, key=lambda x: -x[0]):
        used, t = heap[0]
        heapq.heapreplace(heap, (used + load, t))
        out[item] = t
    return out


def plan_placement(df: DataFrame, keys: list[str], weight: str | None = None, tasks: int | None = None) -> Placement:
    """Estimates loads in one pass over `df` (weight column or 1 a row) and places keys on `tasks` tasks.

    The driver receives BUCKETS bucket loads and the keys above the heavy limit only; by the limit these are at most
    tasks / HEAVY_SHARE keys.
    """
    spark = df.sparkSession
    tasks = tasks or session_tasks(spark)
    room = max(256, int(4 * tasks / HEAVY_SHARE))
    load = F.greatest(F.coalesce(F.col(weight), F.lit(0)), F.lit(0)).cast("bigint") if weight else F.lit(1).cast("bigint")
    # saved, as `df` may be dear to read again for the second look
    found = saved(
        df.select(key_hash(keys).alias("k"), load.alias("w"))
        .mapInArrow(_summaries(room), "is_key boolean, id bigint, load bigint")
        .groupBy("is_key", "id")
        .agg(F.sum("load").alias("load"))
    )
    total = found.where(~F.col("is_key")).agg(F.sum("load")).scalar()
    kept = found.where(~F.col("is_key") | (F.col("load") > total * F.lit(HEAVY_SHARE / tasks))).collect()
    buckets = {r.id: r.load for r in kept if not r.is_key}
    heavy = {r.id: r.load for r in kept if r.is_key}
    fair = max(1.0, sum(buckets.values()) / tasks)
    items: list[tuple[int, object]] = []
    for k, n in heavy.items():
        buckets[k % BUCKETS] = max(0, buckets.get(k % BUCKETS, 0) - n)
        shards = min(tasks, int(np.ceil(n / (fair * HEAVY_SHARE))))
        items += [(n // shards, (k, s)) for s in range(shards)]
    items += [(n, b) for b, n in buckets.items()]
    where = pack(items, tasks)
    shards: dict[int, list[int]] = {}
    for item, t in where.items():
        if isinstance(item, tuple):
            shards.setdefault(item[0], []).append(t)
    return Placement(
        spark.createDataFrame([(b, t) for b, t in where.items() if not isinstance(b, tuple)] or [(0, 0)], "__bucket int, __light int"),
        spark.createDataFrame(list(shards.items()), f"{KEY} bigint, __shards array<int>"),
        tasks,
    )


def balanced_aggregate(placed: DataFrame, keys: list[str], partial: dict[str, Column], final: dict[str, Column]) -> DataFrame:
    """Per-key aggregates of a placed frame: `partial` inside each task (no further shuffle), `final` over the few shard
    results of each key.  `final` expressions read the names of `partial`."""
    part = placed.groupBy(TASK, *keys).agg(*[c.alias(n) for n, c in partial.items()])
    return part.groupBy(*keys).agg(*[c.alias(n) for n, c in final.items()])


def balanced_join(left: DataFrame, right: DataFrame, keys: list[str], spread: list[str], how: str = "inner", tasks: int | None = None) -> DataFrame:
    """Equi-join of a skewed `left` with `right`, both shuffled once, without a straggling task.

    Null keys match nothing.  `how` is inner, left, left_semi or left_anti.  Columns of `right` that clash with `left` other than the
    keys must be renamed by the caller, as in Spark's own join on names.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError("a replicated side allows inner, left, left_semi and left_anti joins only")
    plan = plan_placement(left, keys, tasks=tasks)
    a, b = plan.place(left, keys, spread), plan.replicate(right.where(reduce(lambda x, y: x & y, [F.col(k).isNotNull() for k in keys])), keys)
    return a.join(b, [TASK, *keys], how).drop(TASK)
