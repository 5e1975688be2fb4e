"""The settings the registered queries run under, and the views as operators
want them."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from postfunnel.plans import views
from postfunnel.policy import Profile, profile_from
from postfunnel.schema import empty_list

SETTINGS = {
    "identity": {"name": "sample", "utc_offset": 1},
    "regions": {
        "allow": ["Africa", "Nation_1", "Europe and Nation_7"],
        "deny": ["Nation_13"],
        "local_anchor": ["nation_1"],
    },
    "timezone": {"accept": [0, 1, 2, 3, -5]},
    "rate": {"target_hourly_usd": 40, "absolute_floor_hourly_usd": 30, "inbound_floor_hourly_usd": 45},
    "roles": {
        "include": ["bolt", "gear", "widget", "ring", "plate"],
        "exclude": ["anvil", r"\bpromo\b"],
        "exclude_unless_paid": [r"\bold\b", r"large \w+"],
    },
    "employers": {"blocklist": ["#000000007"], "flag": ["000003", "00001"]},
    "deliverables": {
        "cannot_provide": ["degree", "named_clients"],
        "needs_manual_step": ["video_intro", "test_task"],
        "blocker_penalty": 30,
    },
    "scoring": {"display_threshold": 60},
    "boards": {
        "defaults": {"absolute_floor_hourly_usd": 15, "max_age_days": 400},
        "building": {"draft_at": 75, "draft_if_asked_at": 60},
        "automobile": {"display_threshold": 50, "draft_at": 70, "draft_if_asked_at": 40,
                       "absolute_floor_hourly_usd": 30, "max_age_days": 800},
        "machinery": {"display_threshold": 0, "draft_at": 60, "absolute_floor_hourly_usd": 12.5,
                      "max_age_days": None},
        "furniture": {"display_threshold": 40, "draft_at": 80, "draft_if_asked_at": 55,
                      "absolute_floor_hourly_usd": 20, "max_age_days": 30},
        "household": {"display_threshold": 65, "draft_at": 90, "draft_if_asked_at": 65,
                      "absolute_floor_hourly_usd": 25, "max_age_days": 1200},
        # The boards of the adverts; src19 has no policy on purpose.
        **{f"src{n}": {"draft_at": 60 + n, "draft_if_asked_at": 30 + n} for n in range(19)},
    },
}
BOARDS = ["building", "automobile", "machinery", "furniture", "household"]


def profile() -> Profile:
    return profile_from(SETTINGS)


def now() -> Column:
    return F.to_timestamp(F.lit(views.CLOCK))


def stamp(column) -> Column:
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss")


def joined(column, sep: str = ",") -> Column:
    return F.array_join(column, sep)


def postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The posting view with its lists in the shape of the record."""
    p = views.view(spark, sf_dir, "postings")
    return p.select(
        "arrival", "source", "source_id", "uid", "title", "company", "url", "posted", "expires",
        F.lit("").alias("excerpt"),
        F.concat(F.lit("About "), F.col("title"), F.lit(". Must be located in the office.")).alias("description"),
        F.when(F.col("anywhere"), empty_list("string")).otherwise(F.col("places")).alias("location_restrictions"),
        F.when(F.col("any_zone"), empty_list("int")).otherwise(F.col("zones")).alias("timezone_restrictions"),
        "salary_max", "salary_period", "currency",
        F.array("category").alias("categories"),
    )


def capabilities(spark: SparkSession) -> DataFrame:
    """What the boards declare; furniture and household declare nothing."""
    return spark.createDataFrame(pa.table({
        "source": ["building", "automobile", "machinery"],
        "regions_authoritative": pa.array([False, None, True], pa.bool_()),
        "publishes_expiry": pa.array([None, True, False], pa.bool_()),
    }))


def stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The job view with its regions in the shape of the store."""
    j = views.view(spark, sf_dir, "jobs")
    return j.withColumn(
        "regions", F.when(F.col("anywhere"), empty_list("string")).otherwise(F.col("regions"))
    ).drop("anywhere")
