"""Filling in advert text that was never stored, and nothing else."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from postfunnel import vocab
from postfunnel.functions.text import blank_to_null, strip

REFETCHABLE = [vocab.BOARD_FEED, vocab.BOARD_CARDS]


def targets(jobs: DataFrame, min_score: int = 0) -> DataFrame:
    """Rows without text that are worth filling, best first."""
    rows = jobs.filter((F.coalesce("description", F.lit("")) == "")
                       & (F.coalesce("score", F.lit(0)) >= min_score))
    return rows.select("uid", "source", "title", "company", "score", "posted_at").orderBy(
        F.desc_nulls_last("score"), "uid")


def refetch_since(wanted: DataFrame, now: Column) -> DataFrame:
    """How far back each board must be read: a day before its oldest row."""
    day, far = F.make_dt_interval(days=F.lit(1)), F.make_dt_interval(days=F.lit(vocab.REFETCH_FALLBACK_DAYS))
    return wanted.groupBy("source").agg(
        F.coalesce(F.min("posted_at") - day, now - far).alias("since"))


def with_details(refetched: DataFrame, details: DataFrame) -> DataFrame:
    """The refetched rows, with the detail page's text (uid, body) where the listing gave none."""
    missing = strip(F.coalesce("description", F.lit(""))) == ""
    bodies = details.groupBy("uid").agg(F.min(blank_to_null(F.col("body"))).alias("_body"))
    rows = refetched.join(bodies, "uid", "left")
    return rows.withColumn("description", F.when(missing, F.col("_body")).otherwise(F.col("description"))).drop("_body")


def fill(wanted: DataFrame, refetched: DataFrame, capped: DataFrame | None, refetchable: list[str]) -> DataFrame:
    """Each wanted row with the first text found for it and what became of it.

    ``refetched`` has (uid, arrival, description); ``capped`` has (source,
    hit_page_cap), or is None for a walk that only the time ended.  "Gone" and
    "never looked that far" are different answers.
    """
    texts = refetched.filter(strip(F.coalesce("description", F.lit(""))) != "")
    first = W.partitionBy("uid").orderBy("arrival")
    texts = (
        texts.join(wanted.select("uid"), "uid", "left_semi")
        .withColumn("_n", F.row_number().over(first)).filter(F.col("_n") == 1)
        .select("uid", F.col("description").alias("text"))
    )
    rows = wanted.join(texts, "uid", "left")
    rows = rows.withColumn("hit_page_cap", F.lit(False)) if capped is None else rows.join(capped.select("source", "hit_page_cap"), "source", "left")
    status = (
        F.when(~F.col("source").isin(*refetchable), "not refetchable")
        .when(F.col("text").isNotNull(), "recovered")
        .when(F.coalesce("hit_page_cap", F.lit(False)), "not reached")
        .otherwise("gone")
    )
    out = rows.withColumn("status", status).drop("hit_page_cap")
    return out.withColumn("text", F.when(F.col("status") == "recovered", F.col("text")))


def apply_fill(jobs: DataFrame, filled: DataFrame) -> DataFrame:
    """Write the one column, and only where nothing stands in it."""
    found = filled.filter(F.col("status") == "recovered").select("uid", "text")
    rows = jobs.join(found, "uid", "left")
    empty = F.coalesce("description", F.lit("")) == ""
    return rows.withColumn(
        "description", F.when(empty & F.col("text").isNotNull(), F.col("text")).otherwise(F.col("description"))
    ).drop("text")
