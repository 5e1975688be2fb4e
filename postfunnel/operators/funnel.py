"""The eligibility funnel: ordered tests, of which the first to object wins.

Every test is a nullable reason; null means "passes".  Unknown data never
objects: in three-valued logic a comparison with null is null, and a null
condition falls through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from postfunnel import vocab
from postfunnel.functions import adverts, money, regions
from postfunnel.policy import Profile


def expired_reason(now: Column) -> Column:
    return F.when(
        F.col("expires") < now,
        F.concat(F.lit("expired "), F.date_format("expires", "yyyy-MM-dd")),
    )


def region_reason(profile: Profile) -> Column:
    places = F.col("location_restrictions")
    admitted = F.exists(
        places, lambda r: regions.region_allowed(r, profile.allow_regions, profile.deny_regions)
    )
    return F.when(
        (F.size(places) > 0) & ~admitted,
        F.concat(F.lit("hiring limited to "), F.array_join(F.slice(places, 1, 3), ", ")),
    )


def timezone_reason(profile: Profile) -> Column:
    zones = F.col("timezone_restrictions")
    accepted = F.exists(zones, lambda z: z.isin(*profile.accept_offsets)) if profile.accept_offsets else F.lit(False)
    shown = F.transform(F.slice(zones, 1, 4), lambda z: F.format_string("UTC%+d", z))
    return F.when(
        (F.size(zones) > 0) & ~accepted, F.concat(F.lit("requires "), F.array_join(shown, ", "))
    )


def employer_reason(profile: Profile) -> Column:
    blocked = regions.first_name_in(F.col("company"), profile.employer_blocklist)
    return F.when(
        blocked.isNotNull(),
        F.concat(F.lit("blocklisted employer ("), F.col("company"), F.lit(")")),
    )


def salary_reason() -> Column:
    floor = F.col("floor_hourly") * vocab.HOURS_PER_YEAR
    return F.when(
        F.col("annual_usd") < floor,
        F.concat(
            F.lit("pays up to "), F.format_number("annual_usd", 0),
            F.lit(" USD/yr, floor is "), F.format_number(floor, 0),
        ),
    )


def haystack() -> Column:
    return F.concat(F.col("title"), F.lit(" "), F.array_join("categories", " "))


def role_reason(profile: Profile) -> Column:
    text = haystack()
    excluded = regions.first_pattern(text, profile.role_exclude)
    unpaid = regions.first_match(text, profile.role_exclude_unless_paid)
    reason = F.when(
        excluded.isNotNull(), F.concat(F.lit("excluded title ("), excluded, F.lit(")"))
    ).when(
        F.col("annual_usd").isNull() & unpaid.isNotNull(),
        F.concat(F.lit("'"), unpaid, F.lit("' title and no salary stated")),
    )
    if profile.role_include:
        wanted = regions.first_pattern(text, profile.role_include)
        reason = reason.when(wanted.isNull(), F.lit("title matches no target role"))
    return reason


def stage_reasons(profile: Profile, now: Column) -> list[tuple[str, Column]]:
    """The tests in the order that decides which reason is recorded."""
    reasons = {
        "expired": expired_reason(now),
        "region": region_reason(profile),
        "timezone": timezone_reason(profile),
        "employer": employer_reason(profile),
        "salary": salary_reason(),
        "role": role_reason(profile),
    }
    return [(stage, reasons[stage]) for stage in vocab.STAGES]


def with_policy(df: DataFrame, policy: DataFrame, *columns: str) -> DataFrame:
    """Bring the board's own numbers to its rows; rows of unknown boards stay."""
    return df.join(policy.select("source", *columns), "source", "left")


def with_annual(df: DataFrame) -> DataFrame:
    return df.withColumn(
        "annual_usd",
        money.annual_usd_max(F.col("salary_max"), F.col("currency"), F.col("salary_period")),
    )


def tag(postings: DataFrame, profile: Profile, now: Column, policy: DataFrame | None = None) -> DataFrame:
    """Every posting with the stage that rejects it, the reason, and the notes
    that do not depend on the advert's text.

    One pass, no shuffle: the policy is the size of the profile and is
    broadcast, the rest is native expressions over the row.
    """
    policy = profile.frame(postings.sparkSession) if policy is None else policy
    rows = with_annual(with_policy(postings, policy, "floor_hourly"))
    first = F.coalesce(*[
        F.when(reason.isNotNull(), F.struct(F.lit(stage).alias("stage"), reason.alias("reason")))
        for stage, reason in stage_reasons(profile, now)
    ])
    trusted = F.col("regions_authoritative") if "regions_authoritative" in postings.columns else F.lit(True)
    return (
        rows.withColumn("_first", first)
        .withColumn("rejected_by", F.col("_first.stage"))
        .withColumn("reason", F.coalesce(F.col("_first.reason"), F.lit("")))
        .withColumn("salary_signal", money.salary_signal(F.col("annual_usd"), profile.target_hourly))
        .withColumn("clears_inbound", money.clears_inbound(F.col("annual_usd"), profile.inbound_hourly))
        .withColumn("local_anchor", regions.all_local(F.col("location_restrictions"), profile.local_anchors))
        .withColumn("flagged_employer", regions.first_name_in(F.col("company"), profile.employer_flags))
        .withColumn("region_unverified", (F.size("location_restrictions") == 0) & ~trusted)
        .drop("_first", "floor_hourly")
    )


def survivors(tagged: DataFrame) -> DataFrame:
    return tagged.filter(F.col("rejected_by").isNull())


def rejects(tagged: DataFrame) -> DataFrame:
    return tagged.filter(F.col("rejected_by").isNotNull())


def with_notes(rows: DataFrame) -> DataFrame:
    """Eligibility sentences, worked out for survivors only: the funnel scan
    itself never has to read the advert's text."""
    return rows.withColumn("eligibility_notes", adverts.eligibility_sentences(F.col("description")))


def mark_seen(postings: DataFrame, *stored: DataFrame) -> DataFrame:
    """Add ``seen``: the row's uid is already among the stored ones."""
    known = None
    for table in stored:
        ids = table.select("uid")
        known = ids if known is None else known.unionByName(ids)
    known = known.distinct().withColumn("seen", F.lit(True))
    return postings.join(known, "uid", "left").withColumn("seen", F.coalesce("seen", F.lit(False)))


def unseen(postings: DataFrame, *stored: DataFrame) -> DataFrame:
    rows = postings
    for table in stored:
        rows = rows.join(table.select("uid"), "uid", "left_anti")
    return rows


def funnel_counts(tagged: DataFrame, *by: str) -> DataFrame:
    """Counters of a run: fetched, already seen, removed per stage, to score."""
    seen = F.col("seen") if "seen" in tagged.columns else F.lit(False)
    aggregates = [F.count(F.lit(1)).alias("fetched"), F.count_if(seen).alias("already_seen")]
    aggregates += [
        F.count_if(~seen & (F.col("rejected_by") == stage)).alias(stage) for stage in vocab.STAGES
    ]
    aggregates.append(F.count_if(~seen & F.col("rejected_by").isNull()).alias("to_score"))
    return tagged.groupBy(*by).agg(*aggregates)


def funnel_line() -> Column:
    """The counters as one line; stages that removed nothing are left out."""
    def part(column: str, before: str, after: str) -> Column:
        return F.when(F.col(column) > 0, F.concat(F.lit(before), F.col(column).cast("string"), F.lit(after)))

    parts = [F.concat(F.col("fetched").cast("string"), F.lit(" fetched")),
             part("already_seen", "", " already seen")]
    parts += [part(stage, "-", f" {stage}") for stage in vocab.STAGES]
    parts.append(F.concat(F.col("to_score").cast("string"), F.lit(" to score")))
    return F.concat_ws("  ", *parts)


def stage_rank(stage: Column) -> Column:
    return F.array_position(F.array(*[F.lit(s) for s in vocab.STAGES]), stage)


def near_misses(tagged: DataFrame, n: int = 3) -> DataFrame:
    """The rejects that got furthest; a bounded top-n, not a full sort."""
    return rejects(tagged).orderBy(stage_rank(F.col("rejected_by")).desc(), "arrival").limit(n)


def advise(tagged: DataFrame, board: str = vocab.BOARD_MANUAL) -> DataFrame:
    """Rows a person picked pass whatever the tests say; the objection is kept."""
    picked = (F.col("source") == board) & F.col("rejected_by").isNotNull()
    return (
        tagged.withColumn("objection", F.when(
            picked, F.concat(F.col("rejected_by"), F.lit(": "), F.col("reason"))).otherwise(F.lit("")))
        .withColumn("reason", F.when(picked, F.lit("")).otherwise(F.col("reason")))
        .withColumn("rejected_by", F.when(~picked, F.col("rejected_by")))
    )


def reject_counts(stored_rejects: DataFrame) -> DataFrame:
    return stored_rejects.groupBy("stage").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "stage")


def explain_rejects(tagged: DataFrame) -> DataFrame:
    return rejects(tagged).select("uid", "rejected_by", "title", "reason")


