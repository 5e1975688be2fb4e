"""What is exported to the serving tables, and how they take it in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from postfunnel import vocab
from postfunnel.functions.text import blank_to_null, strip
from postfunnel.operators.numbering import with_position
from postfunnel.operators.store import latest

# Taken from a re-push; everything else keeps the value it was first given.
REFRESHED = ["score", "verdict", "why", "cv_variant", "salary_signal", "regions", "url",
             "title", "score_raw", "blockers"]
FIRST_GIVEN = ["source", "company", "posted_at", "first_seen", "state", "state_updated_at"]


# -- export -------------------------------------------------------------------

def export_jobs(jobs: DataFrame, since: Column | None = None) -> DataFrame:
    """The allow-listed columns and no other; the advert text stays behind."""
    rows = jobs if since is None else jobs.filter(F.col("created_at") >= since)
    return rows.select(*vocab.EXPORT_FIELDS)


def export_asks(asks: DataFrame, exported: DataFrame) -> DataFrame:
    return asks.join(exported.select("uid"), "uid", "left_semi").select(
        "uid", "kind", "mandatory", "detail", "blocking")


def export_letters(letters: DataFrame, exported: DataFrame) -> DataFrame:
    written = letters.filter(strip(F.coalesce("body", F.lit(""))) != "")
    return written.join(exported.select("uid"), "uid", "left_semi").select("uid", "body", "drafted_at")


def export_windows(exported: DataFrame, policy: DataFrame) -> DataFrame:
    """Age windows of the exported boards; a board without a policy is left
    out, a window of null is kept and means 'never trim'."""
    boards = exported.select("source").distinct()
    return boards.join(policy.select("source", "max_age_days"), "source").orderBy("source")


def with_chunks(rows: DataFrame, order: str, size: int = vocab.EXPORT_CHUNK) -> DataFrame:
    """Fixed-size chunks in the given order, without a single-task sort."""
    placed = with_position(rows, order)
    return placed.withColumn("chunk", F.floor(F.col("position") / size)).drop("position")


def export_preview(exported: DataFrame, n: int = 10) -> DataFrame:
    """The best n rows, each with the number of rows beyond them."""
    best = exported.orderBy(F.desc(F.coalesce("score", F.lit(0))), "uid").limit(n)
    total = exported.agg(F.count(F.lit(1))).scalar()
    return best.withColumn("more", F.greatest(total - n, F.lit(0)))


# -- intake -------------------------------------------------------------------

def take_in_jobs(serving: DataFrame, pushed: DataFrame, now: Column) -> DataFrame:
    """Upsert that never resets triage.

    ``pushed`` has the export columns and ``place``, its order in the payload.
    """
    new = latest(pushed.filter(F.col("uid").isNotNull()), ["uid"], [F.desc("place")])
    first = latest(pushed.filter(F.col("uid").isNotNull()), ["uid"], [F.col("place")])
    # A uid pushed twice at once: the first copy inserts, the later one updates.
    given = first.select("uid", *[F.col(c).alias(f"_f_{c}") for c in ("source", "company", "posted_at")])
    new = new.select("uid", F.lit(True).alias("_pushed"),
                     *[F.col(c).alias(f"_n_{c}") for c in REFRESHED]).join(given, "uid")
    both = serving.withColumn("_stored", F.lit(True)).join(new, "uid", "full_outer")
    pushed_now, stored = F.col("_pushed").isNotNull(), F.col("_stored").isNotNull()

    def fresh(column: str) -> Column:
        value = F.col(f"_n_{column}")
        if column == "title":
            value = F.coalesce(blank_to_null(value), F.lit(vocab.UNTITLED))
        return F.when(pushed_now, value).otherwise(F.col(column)).alias(column)

    defaults = {
        "source": F.coalesce(blank_to_null(F.col("_f_source")), F.lit("unknown")),
        "company": F.col("_f_company"),
        "posted_at": F.col("_f_posted_at"),
        "first_seen": now,
        "state": F.lit("new"),
        "state_updated_at": F.lit(None).cast("timestamp"),
    }
    kept = [F.when(stored, F.col(c)).otherwise(defaults[c]).alias(c) for c in FIRST_GIVEN]
    return both.select("uid", *[fresh(c) for c in REFRESHED], *kept)


def take_in_asks(serving: DataFrame, pushed: DataFrame) -> DataFrame:
    """Asks of every uid present in the payload are replaced.  A job pushed
    again with no asks at all is not in the payload, so it keeps its old ones."""
    usable = pushed.filter((F.coalesce("uid", F.lit("")) != "") & (F.coalesce("kind", F.lit("")) != ""))
    kept = serving.join(usable.select("uid"), "uid", "left_anti")
    new = latest(usable, ["uid", "kind"], [F.desc("place")]).select(
        "uid", "kind", F.coalesce("mandatory", F.lit(False)).alias("mandatory"), "detail",
        F.coalesce("blocking", F.lit(False)).alias("blocking"),
    )
    return kept.unionByName(new)


def take_in_letters(serving: DataFrame, pushed: DataFrame) -> DataFrame:
    usable = pushed.filter((F.coalesce("uid", F.lit("")) != "") & (F.coalesce("body", F.lit("")) != ""))
    new = latest(usable, ["uid"], [F.desc("place")]).select("uid", "body", "drafted_at")
    return serving.join(new.select("uid"), "uid", "left_anti").unionByName(new)


def take_in_windows(serving: DataFrame, pushed: DataFrame) -> DataFrame:
    """A window is a whole number of days or null, which means 'never trim'."""
    window = F.col("max_age_days")
    whole = (window >= 0) & (window == F.floor(window))
    usable = pushed.filter((F.coalesce("source", F.lit("")) != "") & (window.isNull() | whole))
    new = latest(usable, ["source"], [F.desc("place")]).select(
        "source", window.cast("int").alias("max_age_days"))
    return serving.join(new.select("source"), "source", "left_anti").unionByName(new)


def apply_triage(jobs: DataFrame, changes: DataFrame) -> DataFrame:
    """The latest valid change of each known uid sets its state.

    ``changes`` has (uid, state, changed_at, change_no).
    """
    valid = changes.filter(F.col("state").isin(*vocab.TRIAGE_STATES))
    last = valid.groupBy("uid").agg(
        F.max(F.struct("changed_at", "change_no", "state")).alias("_last")
    )
    joined = jobs.join(last, "uid", "left")
    return (
        joined.withColumn("state", F.coalesce("_last.state", "state"))
        .withColumn("state_updated_at", F.coalesce("_last.changed_at", "state_updated_at"))
        .drop("_last")
    )
