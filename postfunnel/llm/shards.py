"""Sharding by jump consistent hashing, with gapless places inside every shard.

A key jumps from bucket to bucket: from b the next one is (b + 1) / u, with u
the key's own random number in (0, 1] at step b, until it passes the last
shard.  No ring table is kept, and with one shard more a key either stays or
moves to the new shard.  The law is ``key``: doc_id and the number of shards
decide alone.

Defined results: a null text has no bytes; rows without doc_id share the key
of null; rows with equal doc_id share a shard and have places of their own.
Only fixed-width columns are shuffled.  Places are counted per block of rows
that one task wrote, so no shard is numbered in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from postfunnel.functions.text import let
from postfunnel.llm.common import written

OVERHEAD = 16


def jumps(key: Column, shards: int) -> Column:
    """The bucket a key of any type holds with ``shards`` shards (``shard``) and with one more (``grown``)."""
    def step(at: Column, _: Column) -> Column:
        # 2**32 equally likely values; the next bucket is at least one further.
        draw = (F.pmod(F.xxhash64(F.lit(41), key, at["shard"]), F.lit(1 << 32)) + F.lit(1)).cast("double") / F.lit(float(1 << 32))
        return let(F.floor((at["shard"] + F.lit(1)).cast("double") / draw).cast("bigint"), lambda following: F.struct(
            F.when(following < F.lit(shards), following).otherwise(at["shard"]).alias("shard"),
            F.when(following <= F.lit(shards), following).otherwise(at["shard"]).alias("grown"),
            (following >= F.lit(shards)).alias("done")))

    # Every step goes up by one at least, so as many steps as shards always suffice; some ln(shards) are to be
    # expected.  The steps stand in spans of doubling length, and a key that has come to rest takes no span more.
    spans, covered = [], 0
    while covered < shards:
        spans.append(8 << len(spans))
        covered += spans[-1]
    start = F.struct(F.lit(0).cast("bigint").alias("shard"), F.lit(0).cast("bigint").alias("grown"), F.lit(False).alias("done"))
    return F.aggregate(F.array(*[F.lit(n) for n in spans]), start, lambda at, span: F.aggregate(
        F.when(at["done"], F.array().cast("array<int>")).otherwise(F.sequence(F.lit(1), span)), at,
        lambda here, n: F.when(here["done"], here).otherwise(step(here, n))))


def jump(key: Column, shards: int) -> Column:
    """The shard, 0 to shards - 1, of a key of any type."""
    return jumps(key, shards)["shard"].cast("int")


def assign_shards(docs: DataFrame, shards: int) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard (with one shard more)."""
    text = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    # A row's block and its place there are written with it: a later scan may cut the table otherwise.
    rows = written(docs.select(
        "doc_id", (F.length(text) + F.lit(OVERHEAD)).cast("long").alias("size"), F.crc32(text).alias("text_crc32"),
        jumps(F.col("doc_id"), shards).alias("_held"), F.spark_partition_id().alias("_block"), F.monotonically_increasing_id().alias("_at"),
    ).select("doc_id", "size", "text_crc32", F.col("_held.shard").cast("int").alias("shard"),
             F.col("_held.grown").cast("int").alias("grown_shard"), "_block", "_at"), "shards")
    counts = rows.groupBy("shard", "_block").agg(F.count(F.lit(1)).alias("_n"))
    earlier = W.partitionBy("shard").orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    starts = counts.select("shard", "_block", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_start"))
    inside = W.partitionBy("shard", "_block").orderBy("_at")
    return rows.join(starts, ["shard", "_block"]).select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard",
        (F.col("_start") + F.row_number().over(inside) - 1).cast("long").alias("slot"), "grown_shard")


def write_shards(docs: DataFrame, shards: int, path: str) -> None:
    """The rows as files of one folder per shard, in pieces that their readers can split."""
    shard = jump(F.col("doc_id"), shards)
    docs.withColumn("shard", shard).repartition("shard", F.pmod(F.xxhash64(*docs.columns), F.lit(64))).write.partitionBy("shard").parquet(path)
