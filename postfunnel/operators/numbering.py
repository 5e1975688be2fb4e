"""Exact running positions without a single-task sort.

A plain ``row_number()`` over everything sorts all rows in one task.  Here the
order key is cut into blocks of 65,536 values.  Rows are numbered inside their
block, and a block's start is found from block counts, level by level, so that
no window ever holds more than 65,536 rows however many rows or however skewed
the groups are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from postfunnel.session import shared_dir

BITS = 16


def with_position(df: DataFrame, order: str, before: tuple[str, ...] = (),
                  name: str = "position") -> DataFrame:
    """Add the 0-based position in the order (``before`` columns, ``order``).

    ``order`` is a non-negative bigint, unique within equal ``before`` values;
    ``before`` holds columns of few values and no nulls, such as a board's rank.
    """
    lead = list(before)
    rows = (
        df.withColumn("_b1", F.shiftright(order, BITS))
        .withColumn("_b2", F.shiftright(order, 2 * BITS))
        .withColumn("_b3", F.shiftright(order, 3 * BITS))
    )
    counts = rows.groupBy(*lead, "_b1", "_b2", "_b3").agg(F.count(F.lit(1)).alias("_n"))

    fine = _running(counts, [*lead, "_b2"], ["_b1"], "_s1")
    middle = _running(_totals(counts, *lead, "_b2", "_b3"), [*lead, "_b3"], ["_b2"], "_s2")
    # One row per lead value and 2**48 keys: a handful of rows for real keys.
    top = _running(_totals(counts, *lead, "_b3"), [], [*lead, "_b3"], "_s3")
    starts = (
        fine.join(middle.select(*lead, "_b2", "_s2"), [*lead, "_b2"])
        .join(top.select(*lead, "_b3", "_s3"), [*lead, "_b3"])
        .select(*lead, "_b1", (F.col("_s1") + F.col("_s2") + F.col("_s3")).alias("_start"))
    )
    placed = rows.drop("_b2", "_b3").join(starts, [*lead, "_b1"])
    inside = W.partitionBy(*lead, "_b1").orderBy(order)
    return placed.withColumn(
        name, F.col("_start") + F.row_number().over(inside) - 1
    ).drop("_b1", "_start")


def with_order(df: DataFrame, *order: str, name: str = "arrival") -> DataFrame:
    """Add the 0-based position in the order of several columns of any type, which tell all rows apart.

    The rows are dealt to ranges of the order, sorted and numbered inside their
    range, and written; a range starts where those before it end.  The cuts
    between ranges come from a sample, the positions do not depend on them, nor
    on how the input was split.  One number for each range is all that meets.
    """
    path = shared_dir(df.sparkSession, "ordered")
    (df.repartitionByRange(*order).sortWithinPartitions(*order)
     .withColumn("_range", F.spark_partition_id())
     .withColumn("_place", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
     .write.parquet(path))
    rows = df.sparkSession.read.parquet(path)
    counts = rows.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    starts = _running(counts, [], ["_range"], "_start").drop("_n")
    return rows.join(F.broadcast(starts), "_range").withColumn(name, F.col("_start") + F.col("_place")).drop("_range", "_place", "_start")


def _totals(counts: DataFrame, *keys: str) -> DataFrame:
    return counts.groupBy(*keys).agg(F.sum("_n").alias("_n"))


def _running(counts: DataFrame, within: list[str], order: list[str], name: str) -> DataFrame:
    """Rows that come before each group, among those of the same ``within``."""
    window = W.partitionBy(*within).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    return counts.withColumn(name, F.coalesce(F.sum("_n").over(window), F.lit(0).cast("bigint")))
