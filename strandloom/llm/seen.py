"""First or repeat for every arriving record: keyed state on disk, exact, without expiry.

Records are delivered in order of arrival and read by a Structured Streaming query.  Its state, partitioned by key and kept in
RocksDB with checkpoints in the shared folder, holds for every key its first arrival; no watermark ever drops one.  Each
micro-batch writes a decision for every record it delivered: repeat, unless the record is the first arrival of its key.
A micro-batch that runs again after a failure overwrites its own decisions.

Records with a null key take no part and get no decision.  Arrival numbers must be unique within a kind.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from strandloom.session import shared_dir

#: How many deliveries a table is cut into.
DELIVERIES = 4
STATE_CONF = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256",
    "spark.sql.streaming.noDataMicroBatches.enabled": "false",
}


def list_key(col: str) -> list[Column]:
    """Two independent 64-bit hashes of an array<bigint>; nulls inside and the order count.  Null for a null or empty list."""
    c = F.col(col)
    holes = F.when(F.exists(c, lambda x: x.isNull()), F.transform(c, lambda x: x.isNull().cast("int")))
    some = F.size(c) > 0
    return [F.when(some, F.xxhash64(c, holes, F.size(c))), F.when(some, F.xxhash64(F.lit(0x5EED), F.size(c), c, holes))]


def id_key(col: str) -> list[Column]:
    """The key of a bigint column: itself."""
    return [F.col(col), F.when(F.col(col).isNotNull(), F.lit(0).cast("bigint"))]


def arrivals(df: DataFrame, kind: str, key: list[Column], order: str) -> DataFrame:
    """kind, k1, k2, no: the keyed records of one table."""
    return df.select(F.lit(kind).alias("kind"), key[0].alias("k1"), key[1].alias("k2"), F.col(order).alias("no")).where(
        F.col("k1").isNotNull() & F.col("no").isNotNull()
    )


def decide(records: DataFrame, deliveries: int = DELIVERIES) -> DataFrame:
    """kind, no, repeat of every record of `records` (kind, k1, k2, no).

    The bounds of the deliveries (a few numbers for each kind) go through the driver; records do not.
    """
    spark = records.sparkSession
    base = shared_dir(spark, "seen")
    cuts = [i / deliveries for i in range(1, deliveries)]
    bounds = records.groupBy("kind").agg(F.percentile_approx("no", cuts, 1000).alias("b")).collect()
    part = F.lit(0)
    for r in bounds:
        for b in r.b:
            part = part + F.when((F.col("kind") == r.kind) & (F.col("no") > b), 1).otherwise(0)
    records.withColumn("delivery", part).write.partitionBy("delivery").parquet(f"{base}/records")
    kinds = StructType([*records.schema.fields, StructField("delivery", IntegerType())])
    before = {k: spark.conf.get(k, None) for k in STATE_CONF}
    for k, v in STATE_CONF.items():
        spark.conf.set(k, v)
    try:
        for d in range(deliveries):
            now = spark.read.schema(kinds).parquet(f"{base}/records").where(F.col("delivery") == d)  # only this delivery's files are read
            now.write.mode("append").parquet(f"{base}/incoming")
            stream = spark.readStream.schema(kinds).parquet(f"{base}/incoming")
            firsts = stream.groupBy("kind", "k1", "k2").agg(F.min("no").alias("no"), F.min("delivery").alias("born"))

            def write(batch: DataFrame, number: int, now: DataFrame = now, d: int = d) -> None:
                first = batch.where(F.col("born") == d).select("kind", "no", F.lit(False).alias("again"))
                rows = now.select("kind", "no").join(first, ["kind", "no"], "left")
                rows.select("kind", "no", F.coalesce("again", F.lit(True)).alias("repeat")).write.mode("overwrite").parquet(f"{base}/decisions/batch={d}")

            (
                firsts.writeStream.outputMode("update").foreachBatch(write)
                .option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start().awaitTermination()
            )
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    return spark.read.schema("kind string, no bigint, repeat boolean").parquet(f"{base}/decisions").select("kind", "no", "repeat")


def exact_firsts(df: DataFrame, kind: str, column: str, order: str) -> DataFrame:
    """kind, no: the first arrival of every whole value of `column`, which is not hashed; null values and empty lists have none."""
    c = F.col(column)
    some = F.size(c) > 0 if isinstance(df.schema[column].dataType, ArrayType) else c.isNotNull()
    kept = df.where(some & F.col(order).isNotNull()).select(c.alias("key"), F.col(order).alias("no"))
    return kept.groupBy("key").agg(F.min("no").alias("no")).select(F.lit(kind).alias("kind"), "no")


def wrong_answers(firsts: DataFrame, decisions: DataFrame) -> DataFrame:
    """kind, n_records, n_repeats, n_wrong, wrong_rate: the decisions held against the true first arrivals (`exact_firsts`), so two
    values that the stream took for one key count as wrong."""
    truth = firsts.select("kind", "no", F.lit(False).alias("truth"))
    both = decisions.join(truth, ["kind", "no"], "left").withColumn("wrong", F.coalesce("truth", F.lit(True)) != F.col("repeat"))
    counted = both.groupBy("kind").agg(F.count("*").alias("n_records"), F.count_if("repeat").alias("n_repeats"), F.count_if("wrong").alias("n_wrong"))
    return counted.withColumn("wrong_rate", F.col("n_wrong") / F.col("n_records"))
