"""Which postings get a follow-up letter.

Scores are compared only inside a board.  Reposts are collapsed by an
aggregation, which combines before it shuffles, so an advert that was copied a
million times costs one row per partition and not one huge group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from postfunnel import vocab
from postfunnel.functions import adverts
from postfunnel.functions.text import repost_signature, strip

SIGNATURE = ["sig_source", "sig_title", "sig_company"]


def draft_reason(score: Column, description: Column) -> Column:
    """Why a posting gets a letter, or null.  Needs the board's policy columns.

    The advert's text is only looked at between the two bars.
    """
    text = score.cast("string")
    good = F.concat(F.lit("score "), text, F.lit(" at or above "), F.col("source"),
                    F.lit(" draft_at "), F.col("draft_at").cast("string"))
    asked = F.concat(F.lit("the advert asks for a cover letter, and score "), text, F.lit(" clears "),
                     F.col("source"), F.lit(" draft_if_asked_at "), F.col("draft_if_asked_at").cast("string"))
    return F.when(score >= F.col("draft_at"), good).when(
        (score >= F.col("draft_if_asked_at")) & adverts.asks_for_letter(description), asked
    )


def qualifying(rows: DataFrame, policy: DataFrame) -> DataFrame:
    """Rows that deserve a letter; a board without a policy does not draft."""
    bars = policy.select("source", "draft_at", "draft_if_asked_at")
    out = rows.join(bars, "source").withColumn(
        "draft_reason", draft_reason(F.col("score"), F.col("description"))
    )
    return out.filter(F.col("draft_reason").isNotNull()).drop("draft_at", "draft_if_asked_at")


def with_signature(rows: DataFrame) -> DataFrame:
    return rows.select("*", *repost_signature(F.col("source"), F.col("title"), F.col("company")))


def collapse_reposts(rows: DataFrame) -> DataFrame:
    """Best-scored uid per signature (the earliest on a tie), with the arrival
    of the signature's first copy as ``first_arrival``."""
    best = F.max(F.struct(F.col("score"), (-F.col("arrival")).alias("late"), F.col("uid"))).alias("_best")
    grouped = with_signature(rows).groupBy(*SIGNATURE).agg(best, F.min("arrival").alias("first_arrival"))
    return grouped.select(
        F.col("sig_source").alias("source"), F.col("_best.uid").alias("uid"),
        F.col("_best.score").alias("score"), "first_arrival",
    )


def share_out(winners: DataFrame, cap: int = vocab.LETTERS_PER_RUN) -> DataFrame:
    """Slots shared between boards: every board's best, then every second best.

    Only the first ``cap`` rows of a board can ever be reached, so each
    partition keeps that many per board before anything is shuffled.
    """
    inside = W.partitionBy("source").orderBy(F.desc("score"), "first_arrival")
    tiers = winners.withColumn("tier", F.row_number().over(inside)).filter(F.col("tier") <= cap)
    return tiers.orderBy("tier", "source").limit(cap)


def run_letters(rows: DataFrame, policy: DataFrame, letters: DataFrame,
                cap: int = vocab.LETTERS_PER_RUN) -> DataFrame:
    """The letters one run drafts: qualifying, not drafted yet, reposts
    collapsed, slots shared out between boards."""
    open_rows = qualifying(rows, policy).join(letters.select("uid"), "uid", "left_anti")
    return share_out(collapse_reposts(open_rows), cap)


def backfill_letters(jobs: DataFrame, policy: DataFrame, letters: DataFrame,
                     limit: int | None = None) -> DataFrame:
    """All stored rows that should have a letter and whose advert has none
    under any uid; one uid per advert, best score first."""
    known = jobs.join(policy.select("source"), "source", "left_semi")
    drafted = with_signature(known.join(letters.select("uid"), "uid", "left_semi")).select(*SIGNATURE).distinct()
    open_rows = qualifying(known, policy).join(letters.select("uid"), "uid", "left_anti")
    # Order of the listing: score, then newest, then uid so that ties are stable.
    first = F.max_by(
        F.struct("uid", "score", "posted_at", "draft_reason"),
        F.struct(F.col("score"), F.col("posted_at"), F.col("uid")),
    ).alias("_first")
    picked = with_signature(open_rows).groupBy(*SIGNATURE).agg(first)
    picked = picked.join(drafted, SIGNATURE, "left_anti").select("sig_source", "_first.*")
    picked = picked.withColumnRenamed("sig_source", "source")
    ranked = picked.orderBy(F.desc("score"), F.desc("posted_at"), F.desc("uid"))
    return ranked.limit(limit) if limit is not None else ranked


def recent(jobs: DataFrame, limit: int = 50, min_score: int = 0) -> DataFrame:
    """Best rows first, newest first among equals; rows without a score last."""
    return (
        jobs.filter(F.coalesce("score", F.lit(0)) >= min_score)
        .orderBy(F.desc_nulls_last("score"), F.desc("posted_at"), "uid").limit(limit)
    )


def named_and_top(jobs: DataFrame, uids: list[str], top: int, min_score: int = 0) -> DataFrame:
    """The named rows plus ``top`` others that are not among them."""
    named = jobs.filter(F.col("uid").isin(*uids)) if uids else jobs.limit(0)
    others = jobs.filter(~F.col("uid").isin(*uids)) if uids else jobs
    return named.withColumn("picked", F.lit("named")).unionByName(
        recent(others, top, min_score).withColumn("picked", F.lit("top"))
    )


def prefix_hits(jobs: DataFrame, prefix: str) -> DataFrame:
    """At most two rows whose uid is, or starts with, the given text.

    An exact hit comes first and settles it; two rows without one mean the
    prefix is ambiguous.  ``startswith`` knows no wildcards, so nothing needs escaping.
    """
    hits = jobs.filter(F.col("uid").startswith(prefix)).withColumn("exact", F.col("uid") == prefix)
    return hits.orderBy(F.desc("exact"), "uid").limit(2)


def find_job(jobs: DataFrame, prefix: str):
    """The one row of a uid or unique prefix, or None; ambiguity is an error."""
    rows = prefix_hits(jobs, prefix).collect()
    if len(rows) == 2 and not rows[0].exact:
        raise LookupError(f"{prefix!r} matches more than one row; use the full uid")
    return rows[0] if rows else None


def drop_textless(rows: DataFrame) -> DataFrame:
    """Only rows with an advert text can be written about."""
    return rows.filter(strip(F.coalesce("description", F.lit(""))) != "")


def textless_counts(rows: DataFrame, *by: str) -> DataFrame:
    empty = strip(F.coalesce("description", F.lit(""))) == ""
    return rows.groupBy(*by).agg(F.count_if(~empty).alias("kept"), F.count_if(empty).alias("dropped"))
