"""What the library reads from the session: shared folder, number of tasks, tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder name below the cluster's shared checkpoint folder (`spark.checkpoint.dir`).

    Where the setting is absent a local session gets a temporary folder; a cluster must name one.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
        root = spark.sparkContext.getCheckpointDir()
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def saved(df: DataFrame) -> DataFrame:
    """`df` with its lineage cut by a reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession, "")
    return df.checkpoint()


def written(df: DataFrame, instead_of: DataFrame | None = None) -> DataFrame:
    """`df` as a Parquet table in the shared folder, for loops that join a frame with itself.

    A checkpoint keeps the size estimated for its plan, which such a loop squares each round, until a round over a few hundred rows takes
    many seconds; a table has the size of its files.  The table of `instead_of`, an earlier result of this function that nothing
    reads any more, is deleted.
    """
    spark = df.sparkSession
    where = shared_dir(spark, "table")
    df.write.parquet(where)
    out = spark.read.schema(df.schema).parquet(where)
    out.written_to = where
    if instead_of is not None:
        old = spark._jvm.org.apache.hadoop.fs.Path(instead_of.written_to)
        old.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(old, True)
    return out


def together(parts: list[DataFrame]) -> DataFrame:
    """The rows of results of `written` with equal columns, read as one table, so that the plan does not grow with their number."""
    return parts[0].sparkSession.read.schema(parts[0].schema).parquet(*[p.written_to for p in parts])


def tasks(spark: SparkSession) -> int:
    """The session's number of shuffle partitions."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the Parquet tables of a data directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
