"""Reports over the stored history.  Boards are a grouping key, never pooled.

``jobs`` has at least (uid, source, title, company, score, score_raw,
created_at); ``asks`` has (uid, kind, mandatory, detail), one row per
(uid, kind).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from postfunnel import vocab
from postfunnel.functions.dates import is_stale
from postfunnel.functions.text import blank_to_null, strip
from postfunnel.policy import Profile


def scope(jobs: DataFrame, source: str | None = None, since: Column | None = None) -> DataFrame:
    """The filter every report shares; it reaches the scan."""
    if source:
        jobs = jobs.filter(F.col("source") == source)
    if since is not None:
        jobs = jobs.filter(F.col("created_at") >= since)
    return jobs


def boards_in(jobs: DataFrame) -> DataFrame:
    return jobs.select("source").distinct().orderBy("source")


def scored_per_board(jobs: DataFrame) -> DataFrame:
    return jobs.groupBy("source").agg(F.count(F.lit(1)).alias("scored"))


def percent(part: Column, whole: Column) -> Column:
    return part.cast("double") * F.lit(100.0) / whole.cast("double")


def ask_tally(jobs: DataFrame, asks: DataFrame, profile: Profile) -> DataFrame:
    """What each board's listings ask for, as counts and as a share of that
    board's own rows."""
    tally = (
        asks.join(jobs.select("uid", "source"), "uid")
        .groupBy("source", "kind")
        .agg(F.count(F.lit(1)).alias("listings"), F.count_if("mandatory").alias("must"))
    )
    # One row per board, so the join below is with a table of boards.
    return (
        tally.join(scored_per_board(jobs), "source")
        .withColumn("share_pct", percent(F.col("listings"), F.col("scored")))
        .withColumn("cannot_provide", F.col("kind").isin(*profile.cannot_provide))
        .orderBy("source", F.desc("listings"), F.desc("must"), "kind")
    )


def coverage(jobs: DataFrame, asks: DataFrame) -> DataFrame:
    """Rows that asked for anything, out of all, per board.

    The distinct uids are found by a semi join, so no group ever collects them.
    """
    covered = jobs.join(asks.select("uid"), "uid", "left_semi")
    counted = covered.groupBy("source").agg(F.count(F.lit(1)).alias("covered"))
    return scored_per_board(jobs).join(counted, "source", "left").select(
        "source", F.coalesce("covered", F.lit(0)).alias("covered"), "scored"
    )


def _hard_asks(asks: DataFrame, profile: Profile) -> DataFrame:
    return asks.filter(F.col("mandatory") & F.col("kind").isin(*profile.cannot_provide))


def blocked_today(jobs: DataFrame, asks: DataFrame, profile: Profile) -> DataFrame:
    hit = jobs.join(_hard_asks(asks, profile).select("uid"), "uid", "left_semi")
    counted = hit.groupBy("source").agg(F.count(F.lit(1)).alias("blocked"))
    out = scored_per_board(jobs).join(counted, "source", "left").withColumn(
        "blocked", F.coalesce("blocked", F.lit(0))
    )
    return out.withColumn("blocked_pct", percent(F.col("blocked"), F.col("scored")))


def _kinds_per_job(asks: DataFrame) -> DataFrame:
    """Kinds of one job as text: as many at most as the vocabulary has."""
    return asks.groupBy("uid").agg(
        F.array_join(F.sort_array(F.collect_set("kind")), ",").alias("kinds")
    )


def blocked_list(jobs: DataFrame, asks: DataFrame, profile: Profile) -> DataFrame:
    """Rows one cannot apply to, ranked inside their board by raw score."""
    kinds = _kinds_per_job(_hard_asks(asks, profile))
    rows = jobs.join(kinds, "uid").select("source", "uid", "title", "company", "score", "score_raw", "kinds")
    return rows.orderBy("source", F.desc_nulls_last("score_raw"), "uid")


def ask_detail(jobs: DataFrame, asks: DataFrame, kind: str) -> DataFrame:
    """The sentences behind one kind, conditions first, then newest."""
    if kind not in vocab.REQUIREMENT_KINDS:
        raise ValueError(f"unknown kind {kind!r}; valid: {', '.join(sorted(vocab.REQUIREMENT_KINDS))}")
    rows = asks.filter(F.col("kind") == kind).join(
        jobs.select("uid", "source", "title", "company", "created_at"), "uid"
    )
    return rows.select("source", "uid", "title", "company", "mandatory", "detail", "created_at").orderBy(
        "source", F.desc("mandatory"), F.desc("created_at"), "uid"
    )


def manual_steps(jobs: DataFrame, asks: DataFrame, profile: Profile) -> DataFrame:
    """Rows that need work before one can apply; never a matter of score."""
    kinds = _kinds_per_job(asks.filter(F.col("kind").isin(*profile.needs_manual_step)))
    rows = jobs.join(kinds, "uid").select("source", "uid", "title", "company", "kinds", "created_at")
    return rows.orderBy("source", F.desc("created_at"), "uid")


def with_window(jobs: DataFrame, windows: DataFrame) -> DataFrame:
    """Bring each board's age window; a board without one is never trimmed."""
    return jobs.join(windows.select("source", "max_age_days"), "source", "left")


def fresh(jobs: DataFrame, windows: DataFrame, now: Column) -> DataFrame:
    rows = with_window(jobs, windows)
    return rows.filter(~is_stale(F.col("posted_at"), F.col("max_age_days"), now)).drop("max_age_days")


def board_tabs(jobs: DataFrame, windows: DataFrame, now: Column) -> DataFrame:
    return fresh(jobs, windows, now).groupBy("source").agg(F.count(F.lit(1)).alias("n")).orderBy("source")


def triage_tally(jobs: DataFrame, windows: DataFrame, now: Column) -> DataFrame:
    """Fresh rows per board and state, with the totals of both in one pass.

    A total is told from a missing value by its grouping, not by being null: a
    row without a state is counted under none.
    """
    def shown(name: str) -> Column:
        return F.when(F.col(f"_{name}_total") == 1, "(all)").otherwise(F.col(name)).alias(name)

    return (
        fresh(jobs, windows, now).rollup("source", "state")
        .agg(F.count(F.lit(1)).alias("n"), F.grouping("source").alias("_source_total"), F.grouping("state").alias("_state_total"))
        .select(shown("source"), shown("state"), "n")
    )


def triage_list(jobs: DataFrame, windows: DataFrame, letters: DataFrame, now: Column,
                state: str = "new", source: str | None = None,
                limit: int = vocab.SERVING_LIST_LIMIT) -> DataFrame:
    """One screen of the triage list; its length is the feature."""
    rows = jobs.filter(F.col("state") == (state if state in vocab.TRIAGE_STATES else "new"))
    if source:
        rows = rows.filter(F.col("source") == source)
    top = (
        fresh(rows, windows, now)
        .orderBy(F.desc_nulls_last("score"), F.desc_nulls_last("posted_at"), "uid").limit(limit)
    )
    return with_letter_mark(top, letters)


def with_letter_mark(jobs: DataFrame, letters: DataFrame) -> DataFrame:
    marks = letters.select("uid").distinct().withColumn("_mark", F.lit(True))
    return jobs.join(marks, "uid", "left").withColumn(
        "has_letter", F.col("_mark").isNotNull()
    ).drop("_mark")


def improve_tally(jobs: DataFrame, asks: DataFrame) -> DataFrame:
    """One row per kind over everything in scope: listings, conditions, whether
    it blocks, and its share of all rows."""
    tally = asks.join(jobs.select("uid"), "uid", "left_semi").groupBy("kind").agg(
        F.count(F.lit(1)).alias("listings"),
        F.count_if("mandatory").alias("must"),
        F.max("blocking").alias("blocking"),
    )
    total = jobs.agg(F.count(F.lit(1)))
    return tally.withColumn("scored", total.scalar()).withColumn(
        "share_pct", F.floor(percent(F.col("listings"), F.col("scored")) + 0.5).cast("int")
    ).orderBy(F.desc("blocking"), F.desc("listings"), F.desc("must"), "kind")


def ask_samples(jobs: DataFrame, asks: DataFrame, n: int = 3) -> DataFrame:
    """Up to ``n`` different sample texts per kind, conditions first.

    Equal texts are folded by an aggregation before the ranking, and the
    ranking keeps n rows per kind and partition before it shuffles, so a kind
    that holds a third of all asks stays small.
    """
    told = asks.filter(blank_to_null(F.col("detail")).isNotNull())
    told = told.join(jobs.select("uid"), "uid", "left_semi")
    key = F.lower(strip(F.col("detail")))
    order = F.struct(~F.col("mandatory"), F.col("uid"))
    texts = told.groupBy("kind", key.alias("text")).agg(
        F.min_by("detail", order).alias("detail"), F.min(order).alias("_order")
    )
    first = W.partitionBy("kind").orderBy("_order", "text")
    return texts.withColumn("rank", F.row_number().over(first)).filter(F.col("rank") <= n).select(
        "kind", "rank", "detail"
    )


def job_detail(jobs: DataFrame, asks: DataFrame, letters: DataFrame) -> DataFrame:
    """Jobs with their asks as one list (conditions first, then by kind) and
    their letter; a job without one has none, not a missing row."""
    listed = asks.groupBy("uid").agg(F.array_sort(F.collect_list(
        F.struct((~F.col("mandatory")).alias("optional"), "kind", "detail"))).alias("asks"))
    return jobs.join(listed, "uid", "left").join(letters.select("uid", "body", "drafted_at"), "uid", "left")


def ordered_asks(asks: DataFrame) -> DataFrame:
    """Each job's asks with their place: conditions first, then by kind.  A job
    has at most as many as the vocabulary."""
    inside = W.partitionBy("uid").orderBy(F.desc("mandatory"), "kind")
    return asks.withColumn("place", F.row_number().over(inside))


def asks_of(asks: DataFrame, uid: str) -> DataFrame:
    return ordered_asks(asks.filter(F.col("uid") == uid)).orderBy("place")


# -- the day's digest ---------------------------------------------------------

def verdict_rank(verdict: Column) -> Column:
    rank = None
    for name, place in vocab.VERDICT_ORDER.items():
        hit = F.coalesce(verdict, F.lit("unscored")) == name if name == "unscored" else verdict == name
        rank = F.when(hit, place) if rank is None else rank.when(hit, place)
    return rank.otherwise(9)


def digest_order() -> list[Column]:
    return [verdict_rank(F.col("verdict")), F.coalesce("score", F.lit(0)).desc(), F.col("arrival")]


def digest_sections(scored: DataFrame, policy: DataFrame, now: Column) -> DataFrame:
    """Which part of the digest a row belongs to; nothing is deleted, so a
    changed threshold or window simply renders differently."""
    bars = policy.select("source", "display_threshold", "max_age_days")
    rows = scored.join(bars, "source")
    return rows.withColumn(
        "section",
        F.when(is_stale(F.col("posted"), F.col("max_age_days"), now), "stale")
        .when(F.col("score") < F.col("display_threshold"), "below")
        .otherwise("kept"),
    ).drop("display_threshold", "max_age_days")


def digest_rows(sectioned: DataFrame) -> DataFrame:
    """Kept rows, split by whether the pay clears the inbound line."""
    kept = sectioned.filter(F.col("section") == "kept")
    return kept.withColumn("part", F.when(F.col("clears_inbound"), "worth the ask").otherwise("apply now"))


def digest_fallback(sectioned: DataFrame, n: int = 5) -> DataFrame:
    """The best rows below their threshold, shown when nothing was kept."""
    below = sectioned.filter(F.col("section") == "below")
    return below.orderBy(*digest_order()).limit(n)


def digest_counts(sectioned: DataFrame) -> DataFrame:
    return sectioned.groupBy("source", "section").agg(F.count(F.lit(1)).alias("n"))
