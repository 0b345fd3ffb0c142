"""Queries over `minspace` and `nodes` for keys that hold most records."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.operators.balance import balanced_aggregate, balanced_join, plan_placement
from strandloom.session import table

#: Share of all occurrences from which an item is reported.
FOUND_SHARE = 0.015


def _count_values(field: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Arrow kernel: pre-aggregates a bigint or array<bigint> column inside each batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            col = batch.column(0)
            if pa.types.is_list(col.type) or pa.types.is_large_list(col.type):
                col = col.flatten()
            items, n = np.unique(col.drop_null().to_numpy(zero_copy_only=False).astype(np.int64), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array([field] * len(items), pa.string()), pa.array(items), pa.array(n.astype(np.int64))], names=["field", "item", "n"])

    return run


def item_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """field, item, n of every hash in minspace.minims and every nodes.abundance, all rows, through balanced placement.

    Null lists and null values count nowhere; repeated rows count each time.
    """
    parts = [
        table(spark, sf_dir, name).select(col).mapInArrow(_count_values(col), "field string, item bigint, n bigint")
        for name, col in (("minspace", "minims"), ("nodes", "abundance"))
    ]
    rows = parts[0].unionByName(parts[1]).withColumn("part", F.spark_partition_id())
    placed = plan_placement(rows, ["field", "item"]).place(rows, ["field", "item"], ["part", "n"])
    return balanced_aggregate(placed, ["field", "item"], {"n": F.sum("n")}, {"n": F.sum("n")})


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items with at least 1.5 % of the occurrences of their field."""
    counts = item_counts(spark, sf_dir)
    totals = counts.groupBy("field").agg(F.sum("n").alias("total"))  # two rows
    return counts.join(F.broadcast(totals), "field").where(F.col("n") >= FOUND_SHARE * F.col("total")).select("field", "item")


def p1_item_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Occurrences of every item of either field."""
    return item_counts(spark, sf_dir).select("field", "item", F.col("n").alias("occurrences"))


def p1_hash_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every hash of minspace that a node's k-min-mer contains: rows of minspace that have it, and of each such row the
    number of distinct node_ids joined, summed.  The occurrence side is skewed, the node side is replicated to its shards."""
    left = table(spark, sf_dir, "minspace").select("arrival_no", F.explode(F.array_distinct("minims")).alias("item")).where(F.col("item").isNotNull())
    right = (
        table(spark, sf_dir, "nodes").where(F.col("node_id").isNotNull()).select("node_id", F.explode(F.array_distinct("kmer")).alias("item"))
        .distinct().groupBy("item").agg(F.count("*").alias("n_nodes"))
    )
    joined = balanced_join(left, right, ["item"], ["arrival_no"])
    return joined.groupBy("item").agg(F.count("*").alias("n_rows"), F.sum("n_nodes").alias("pairs"))


QUERIES = {"p1_found": p1_found, "p1_item_counts": p1_item_counts, "p1_hash_nodes": p1_hash_nodes}

_COUNTS = """occ AS (
  SELECT 'minims' AS field, x AS item FROM (SELECT unnest(minims) AS x FROM minspace)
  UNION ALL SELECT 'abundance', abundance FROM nodes WHERE abundance IS NOT NULL),
counts AS (SELECT field, item, count(*) AS n FROM occ WHERE item IS NOT NULL GROUP BY ALL)"""

ORACLES = {
    "p1_found": f"""WITH {_COUNTS}
SELECT field, item FROM (SELECT *, sum(n) OVER (PARTITION BY field) AS total FROM counts) WHERE n >= 0.015 * total""",
    "p1_item_counts": f"WITH {_COUNTS} SELECT field, item, n AS occurrences FROM counts",
    "p1_hash_nodes": """WITH l AS (SELECT DISTINCT arrival_no, x AS item FROM (SELECT arrival_no, unnest(minims) AS x FROM minspace) WHERE x IS NOT NULL),
r AS (SELECT item, count(*) AS n_nodes FROM (SELECT DISTINCT node_id, x AS item FROM (SELECT node_id, unnest(kmer) AS x FROM nodes WHERE node_id IS NOT NULL) WHERE x IS NOT NULL) GROUP BY item)
SELECT item, count(*) AS n_rows, CAST(sum(n_nodes) AS BIGINT) AS pairs FROM l JOIN r USING (item) GROUP BY item""",
}
