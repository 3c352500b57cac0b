"""Operator 1: sharding by a two-pass external shuffle, in DataFrame functions alone.

Pass one scatters the records uniformly into memory-sized buckets by a seeded hash of the whole
record; pass two loads one bucket at a time, puts it into a canonical order and permutes it with
Spark's seeded Fisher-Yates ``shuffle``.  The buckets one after the other are a random permutation
of all records; dealing it round-robin gives shards whose counts differ by at most one (law
``rows``), each in a random order.

Equal records get one hash; where one record repeats more than ``REPEATS`` times, its copies (which
are interchangeable) are spread by their row number instead, so no bucket outgrows memory.  Nulls
are values like any other, ties do not occur between different records, an empty table gives an
empty result, and the added names gain underscores where the table has them already.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from anomspark.llm.common import (BROADCAST_ROWS, checked_broadcast, ensure_checkpoint_dir, fresh, read,
                                  reliable_checkpoint)

SHARDS, SEED, REPEATS = 16, 20240601, 64
#: Bytes of records a bucket holds on average; a task works on one bucket at a time.
BUCKET_BYTES = 32 << 20
MOST_PARTITIONS = 100_000


def _hashable(df: DataFrame):
    """The columns in a form that can be hashed (maps as JSON), each with its null mark."""
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        yield c.isNull()
        yield F.to_json(c) if "map<" in f.dataType.simpleString() else c


def _bytes(df: DataFrame):
    parts = [F.coalesce(F.octet_length(F.col(f"`{f.name}`")), F.lit(0)) if f.dataType.simpleString() == "string"
             else F.lit(8) for f in df.schema.fields]
    return sum(parts, F.lit(16)).cast("long")


def shuffle_records(df: DataFrame, shards: int = SHARDS, seed: int = SEED,
                    bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """All rows of ``df`` with ``shard`` and ``slot`` (place in the shard, gapless from 0)."""
    key, bucket, rows, start, rank, shard, slot = fresh(df, "key", "bucket", "rows", "start", "rank", "shard", "slot")
    hashed = df.withColumn(key, F.xxhash64(F.lit(seed), *_hashable(df)))
    slim = reliable_checkpoint(hashed.select(F.col(key).alias("key"), _bytes(df).alias("bytes")))
    total = slim.agg(F.sum("bytes")).first()[0] or 0
    buckets = max(1, -(-total // bucket_bytes))
    where = F.pmod(F.col(key), F.lit(buckets))
    often = reliable_checkpoint(slim.groupBy("key").count().where(F.col("count") > REPEATS).select(
        F.col("key").alias("_often")))
    n = often.count()
    if n:
        row = F.xxhash64(F.lit(seed), F.monotonically_increasing_id())
        hashed = hashed.join(checked_broadcast(often, n), F.expr(f"`{key}` = _often"), "left")
        hashed = hashed.withColumn(bucket, F.when(F.col("_often").isNull(), where).otherwise(F.pmod(row, F.lit(buckets))))
        hashed = hashed.drop("_often")
        counts = hashed.groupBy(F.col(bucket).alias("b")).agg(F.count("*").alias("n"))
    else:
        hashed = hashed.withColumn(bucket, where)
        counts = slim.groupBy(F.pmod("key", F.lit(buckets)).alias("b")).agg(F.count("*").alias("n"))
    before = Window.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)  # one row for each bucket
    offsets = counts.select("b", F.coalesce(F.sum("n").over(before), F.lit(0)).alias(start))
    offsets = F.broadcast(offsets) if buckets <= BROADCAST_ROWS else offsets

    loaded = (hashed.repartition(min(buckets, MOST_PARTITIONS), bucket).sortWithinPartitions(bucket, key)
              .groupBy(bucket).agg(F.collect_list(F.struct(*[f"`{c}`" for c in df.columns])).alias(rows)))
    dealt = (loaded.join(offsets, F.col(bucket) == F.col("b")).select(start, F.shuffle(rows, F.lit(seed)).alias(rows))
             .select(start, F.posexplode(rows).alias(rank, rows))
             .withColumn(rank, F.col(start) + F.col(rank)))
    return dealt.select(f"{rows}.*", (F.col(rank) % shards).cast("int").alias(shard),
                        F.floor(F.col(rank) / F.lit(shards)).cast("long").alias(slot))


def write_shards(shuffled: DataFrame, path: str, shard: str = "shard", slot: str = "slot") -> None:
    """One folder for each shard; each bucket writes its rows of a shard, in slot order, as a file of their own,
    so nothing is shuffled again."""
    shuffled.sortWithinPartitions(shard, slot).write.partitionBy(shard).parquet(path)


def read_shards(spark: SparkSession, path: str, shuffled: DataFrame) -> DataFrame:
    """The written rows; an empty table has written none."""
    return spark.read.schema(shuffled.schema).parquet(path)


def op1_two_pass_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    shuffled = shuffle_records(read(spark, sf_dir, "documents"))
    path = f"{ensure_checkpoint_dir(spark)}/shards-{uuid.uuid4().hex}"
    write_shards(shuffled, path)
    out = read_shards(spark, path, shuffled)
    return out.select("doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
                      F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
                      F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
