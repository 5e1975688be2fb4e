"""Which postings get a letter, and single-row look-ups."""

from __future__ import annotations

from pyspark.sql import functions as F

from postfunnel.operators import selection
from postfunnel.plans import sample, views
from postfunnel.plans.catalog import query
from postfunnel.plans.catalog.duck import sql, strip
from postfunnel.plans.catalog.text import ASKS_SQL

_SIG = "source, lower(trim(title)), lower(trim(coalesce(company, '')))"


@query("f11_prefix_lookup", sql("""
    SELECT uid, uid = 'building:1' AS exact FROM jobs WHERE starts_with(uid, 'building:1') ORDER BY exact DESC, uid LIMIT 2""", "jobs"))
def prefix_lookup(spark, d):
    return selection.prefix_hits(views.view(spark, d, "jobs"), "building:1").select("uid", "exact")


def candidates(spark, d):
    """Scored rows, some of whose adverts ask for a letter."""
    jobs = views.view(spark, d, "jobs")
    asked = F.when(F.col("arrival") % 9 == 0, "Please send a cover letter.").when(
        F.col("arrival") % 9 == 1, "No cover letter needed.").otherwise(F.col("description"))
    return jobs.withColumn("description", asked)


_CANDIDATES = """cands AS (SELECT j.*, arrival % 9 = 0 AS asking FROM jobs j),
  quals AS (SELECT c.*, draft_at, draft_if_asked_at FROM cands c JOIN policy USING (source)
    WHERE score >= draft_at OR (asking AND score >= draft_if_asked_at))"""


@query("w01_collapse_reposts", sql(f"""
    SELECT source, uid, score, first_arrival FROM (SELECT *, row_number() OVER (PARTITION BY {_SIG} ORDER BY score DESC NULLS LAST, arrival) AS n,
      min(arrival) OVER (PARTITION BY {_SIG}) AS first_arrival FROM jobs) WHERE n = 1""", "jobs"))
def collapse_reposts(spark, d):
    return selection.collapse_reposts(views.view(spark, d, "jobs"))


_SHARED = """SELECT source, uid, score, tier FROM (SELECT *, CAST(row_number() OVER (PARTITION BY source ORDER BY score DESC, first_arrival) AS INT) AS tier
  FROM winners) ORDER BY tier, source LIMIT 5"""


@query("w02_share_out", sql("", "jobs").rstrip() + f""",
    winners AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {_SIG} ORDER BY score DESC, arrival) AS n,
      min(arrival) OVER (PARTITION BY {_SIG}) AS first_arrival FROM jobs WHERE score IS NOT NULL) WHERE n = 1) {_SHARED}""")
def share_out(spark, d):
    rows = views.view(spark, d, "jobs").filter(F.col("score").isNotNull())
    return selection.share_out(selection.collapse_reposts(rows)).select("source", "uid", "score", "tier")


@query("w03_draft_reason", sql(f"""
    SELECT uid, CASE WHEN score >= draft_at THEN 'score ' || score || ' at or above ' || source || ' draft_at ' || draft_at
      WHEN score >= draft_if_asked_at AND {ASKS_SQL} THEN 'the advert asks for a cover letter, and score ' || score || ' clears '
        || source || ' draft_if_asked_at ' || draft_if_asked_at END AS reason
    FROM adverts JOIN policy USING (source)
    WHERE score >= draft_at OR (score >= draft_if_asked_at AND {ASKS_SQL})""", "adverts", "policy"))
def draft_reason(spark, d):
    rows = selection.qualifying(views.view(spark, d, "adverts"), sample.profile().frame(spark))
    return rows.select("uid", F.col("draft_reason").alias("reason"))


@query("w04_run_letters", sql("", "jobs", "policy", "letters").rstrip() + f""", {_CANDIDATES},
    winners AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {_SIG} ORDER BY score DESC, arrival) AS n,
      min(arrival) OVER (PARTITION BY {_SIG}) AS first_arrival FROM quals WHERE uid NOT IN (SELECT uid FROM letters)) WHERE n = 1) {_SHARED}""")
def run_letters(spark, d):
    out = selection.run_letters(candidates(spark, d), sample.profile().frame(spark), views.view(spark, d, "letters"))
    return out.select("source", "uid", "score", "tier")


_BACKFILL = f"""drafted AS (SELECT DISTINCT source AS s1, lower(trim(title)) AS s2, lower(trim(coalesce(company, ''))) AS s3
    FROM cands WHERE uid IN (SELECT uid FROM letters)),
  picked AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {_SIG} ORDER BY score DESC, posted_at DESC, uid DESC) AS n
    FROM quals WHERE uid NOT IN (SELECT uid FROM letters) AND ({_SIG}) NOT IN (SELECT (s1, s2, s3) FROM drafted)) WHERE n = 1)"""


@query("w05_backfill_letters", sql("", "jobs", "policy", "letters").rstrip() + f""", {_CANDIDATES}, {_BACKFILL}
    SELECT uid, source, score, CASE WHEN score >= draft_at THEN 'score ' || score || ' at or above ' || source || ' draft_at ' || draft_at
      ELSE 'the advert asks for a cover letter, and score ' || score || ' clears ' || source || ' draft_if_asked_at ' || draft_if_asked_at END AS reason
    FROM picked""")
def backfill_letters(spark, d):
    out = selection.backfill_letters(candidates(spark, d), sample.profile().frame(spark), views.view(spark, d, "letters"))
    return out.select("uid", "source", "score", F.col("draft_reason").alias("reason"))


@query("w05_backfill_limit", sql("", "jobs", "policy", "letters").rstrip() + f""", {_CANDIDATES}, {_BACKFILL}
    SELECT uid, score FROM picked ORDER BY score DESC, posted_at DESC, uid DESC LIMIT 10""")
def backfill_limit(spark, d):
    out = selection.backfill_letters(candidates(spark, d), sample.profile().frame(spark), views.view(spark, d, "letters"), 10)
    return out.select("uid", "score")


@query("w09_recent", sql("""
    SELECT uid, score FROM jobs WHERE coalesce(score, 0) >= 40 ORDER BY score DESC NULLS LAST, posted_at DESC, uid LIMIT 50""", "jobs"))
def recent(spark, d):
    return selection.recent(views.view(spark, d, "jobs"), 50, 40).select("uid", "score")


_NAMED = [f"{board}:{n}" for board in sample.BOARDS for n in range(5)]
_NAMED_SQL = ", ".join(f"'{u}'" for u in _NAMED)


@query("w11_named_and_top", sql(f"""
    SELECT uid, 'named' AS picked FROM jobs WHERE uid IN ({_NAMED_SQL}) UNION ALL
    (SELECT uid, 'top' AS picked FROM jobs WHERE uid NOT IN ({_NAMED_SQL}) AND coalesce(score, 0) >= 10
      ORDER BY score DESC NULLS LAST, posted_at DESC, uid LIMIT 20)""", "jobs"))
def named_and_top(spark, d):
    return selection.named_and_top(views.view(spark, d, "jobs"), _NAMED, 20, 10).select("uid", "picked")


@query("r11_drop_textless", sql(f"""
    SELECT j.source, count(*) FILTER (WHERE {strip("coalesce(description, '')")} <> '') AS kept,
      count(*) FILTER (WHERE {strip("coalesce(description, '')")} = '') AS dropped
    FROM jobs j JOIN letters USING (uid) GROUP BY j.source""", "jobs", "letters"))
def drop_textless(spark, d):
    wanted = views.view(spark, d, "jobs").join(views.view(spark, d, "letters").select("uid"), "uid", "left_semi")
    return selection.textless_counts(wanted, "source")
