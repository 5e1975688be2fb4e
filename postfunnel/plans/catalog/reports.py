"""Reports, digest and triage lists over the stored history."""

from __future__ import annotations

from pyspark.sql import functions as F

from postfunnel.operators import reports
from postfunnel.plans import sample, views
from postfunnel.plans.catalog import query
from postfunnel.plans.catalog.duck import NOW, sql

_HARD = "mandatory AND kind IN ('degree', 'named_clients')"
_STALE = f"coalesce(date_diff('microsecond', posted_at, {NOW}) >= (max_age_days + 1) * 86400000000, false)"
_FRESH = f"jobs LEFT JOIN policy USING (source) WHERE NOT {_STALE}"
_PCT = "CAST({} AS DOUBLE) * CAST(100 AS DOUBLE) / CAST({} AS DOUBLE)"


def jobs(spark, d):
    return views.view(spark, d, "jobs")


def asks(spark, d):
    return views.view(spark, d, "asks")


def windows(spark):
    return sample.profile().frame(spark)


@query("g01_ask_tally", sql(f"""
    SELECT source, kind, listings, must, scored, {_PCT.format('listings', 'scored')} AS share_pct, kind IN ('degree', 'named_clients') AS cannot_provide
    FROM (SELECT source, kind, count(*) AS listings, count(*) FILTER (WHERE mandatory) AS must FROM asks JOIN jobs USING (uid) GROUP BY ALL)
    JOIN (SELECT source, count(*) AS scored FROM jobs GROUP BY source) USING (source)""", "asks", "jobs"))
def ask_tally(spark, d):
    return reports.ask_tally(jobs(spark, d), asks(spark, d), sample.profile())


@query("g02_coverage", sql("""
    SELECT source, count(DISTINCT a.uid) AS covered, count(DISTINCT j.uid) AS scored FROM jobs j LEFT JOIN asks a USING (uid) GROUP BY source""", "asks", "jobs"))
def coverage(spark, d):
    return reports.coverage(jobs(spark, d), asks(spark, d))


@query("g03_blocked_today", sql(f"""
    SELECT source, scored, blocked, {_PCT.format('blocked', 'scored')} AS blocked_pct
    FROM (SELECT source, count(DISTINCT j.uid) AS scored, count(DISTINCT j.uid) FILTER (WHERE {_HARD}) AS blocked
      FROM jobs j LEFT JOIN asks a USING (uid) GROUP BY source)""", "asks", "jobs"))
def blocked_today(spark, d):
    return reports.blocked_today(jobs(spark, d), asks(spark, d), sample.profile())


@query("g04_blocked_list", sql(f"""
    SELECT source, uid, title, company, score, score_raw, kinds FROM jobs JOIN
      (SELECT uid, string_agg(kind, ',' ORDER BY kind) AS kinds FROM asks WHERE {_HARD} GROUP BY uid) USING (uid)""", "asks", "jobs"))
def blocked_list(spark, d):
    return reports.blocked_list(jobs(spark, d), asks(spark, d), sample.profile())


@query("g05_ask_detail", sql("""
    SELECT source, uid, title, company, mandatory, detail FROM asks JOIN jobs USING (uid) WHERE kind = 'test_task'""", "asks", "jobs"))
def ask_detail(spark, d):
    return reports.ask_detail(jobs(spark, d), asks(spark, d), "test_task").drop("created_at")


@query("g06_manual_steps", sql("""
    SELECT source, uid, title, company, kinds FROM jobs JOIN (SELECT uid, string_agg(kind, ',' ORDER BY kind) AS kinds FROM asks
      WHERE kind IN ('video_intro', 'test_task') GROUP BY uid) USING (uid)""", "asks", "jobs"))
def manual_steps(spark, d):
    return reports.manual_steps(jobs(spark, d), asks(spark, d), sample.profile()).drop("created_at")


@query("g07_scoped_boards", sql(f"""
    SELECT DISTINCT source FROM jobs WHERE created_at >= {NOW} - INTERVAL '30' DAY""", "jobs"))
def scoped_boards(spark, d):
    since = sample.now() - F.make_dt_interval(days=F.lit(30))
    return reports.boards_in(reports.scope(jobs(spark, d), since=since))


@query("g07_scoped_tally", sql(f"""
    SELECT kind, count(*) AS listings FROM asks JOIN jobs USING (uid) WHERE source = 'machinery'
      AND created_at >= {NOW} - INTERVAL '900' DAY GROUP BY kind""", "asks", "jobs"))
def scoped_tally(spark, d):
    since = sample.now() - F.make_dt_interval(days=F.lit(900))
    scoped = reports.scope(jobs(spark, d), "machinery", since)
    return reports.ask_tally(scoped, asks(spark, d), sample.profile()).select("kind", "listings")


@query("g08_board_tabs", sql(f"SELECT source, count(*) AS n FROM {_FRESH} GROUP BY source", "jobs", "policy"))
def board_tabs(spark, d):
    return reports.board_tabs(jobs(spark, d), windows(spark), sample.now())


@query("g09_triage_tally", sql(f"""
    SELECT coalesce(source, '(all)') AS source, coalesce(state, '(all)') AS state, count(*) AS n
    FROM (SELECT source, state FROM {_FRESH}) GROUP BY ROLLUP (source, state)""", "jobs", "policy"))
def triage_tally(spark, d):
    return reports.triage_tally(jobs(spark, d), windows(spark), sample.now())


@query("g10_improve_tally", sql(f"""
    SELECT kind, count(*) AS listings, count(*) FILTER (WHERE mandatory) AS must, bool_or(blocking) AS blocking,
      (SELECT count(*) FROM jobs) AS scored, CAST(floor({_PCT.format('count(*)', '(SELECT count(*) FROM jobs)')} + 0.5) AS INT) AS share_pct
    FROM asks WHERE uid IN (SELECT uid FROM jobs) GROUP BY kind""", "asks", "jobs"))
def improve_tally(spark, d):
    return reports.improve_tally(jobs(spark, d), asks(spark, d))


@query("g11_ask_samples", sql("""
    SELECT kind, CAST(rank AS INT) AS rank, detail FROM (
      SELECT *, row_number() OVER (PARTITION BY kind ORDER BY optional, uid, text) AS rank FROM (
        SELECT * FROM (SELECT kind, lower(trim(detail)) AS text, detail, NOT mandatory AS optional, uid,
          row_number() OVER (PARTITION BY kind, lower(trim(detail)) ORDER BY NOT mandatory, uid) AS n
          FROM asks WHERE detail <> '' AND uid IN (SELECT uid FROM jobs)) WHERE n = 1)) WHERE rank <= 3""", "asks", "jobs"))
def ask_samples(spark, d):
    return reports.ask_samples(jobs(spark, d), asks(spark, d))


@query("j03_has_letter", sql("""
    SELECT uid, EXISTS (SELECT 1 FROM letters l WHERE l.uid = j.uid) AS has_letter FROM jobs j""", "jobs", "letters"))
def has_letter(spark, d):
    return reports.with_letter_mark(jobs(spark, d), views.view(spark, d, "letters")).select("uid", "has_letter")


@query("j10_job_detail", sql("""
    SELECT uid, score, asks, l.body FROM jobs LEFT JOIN (SELECT uid, string_agg(kind || ':' || detail, '|' ORDER BY mandatory DESC, kind) AS asks
      FROM asks GROUP BY uid) USING (uid) LEFT JOIN letters l USING (uid)""", "jobs", "asks", "letters"))
def job_detail(spark, d):
    rows = reports.job_detail(jobs(spark, d), asks(spark, d), views.view(spark, d, "letters"))
    listed = F.transform("asks", lambda a: F.concat(a["kind"], F.lit(":"), a["detail"]))
    return rows.select("uid", "score", F.array_join(listed, "|").alias("asks"), "body")


def scored(spark, d):
    """Stored rows as the pairs a digest is made of."""
    j = jobs(spark, d)
    pay = sample.postings(spark, d).select("uid", ((F.col("salary_max") > 40000) | F.col("salary_max").isNull()).alias("clears_inbound"))
    return j.withColumnRenamed("posted_at", "posted").join(pay, "uid")


_RANK = "CASE verdict WHEN 'strong' THEN 0 WHEN 'maybe' THEN 1 WHEN 'no' THEN 2 WHEN 'unscored' THEN 3 ELSE 9 END"


@query("w06_digest_order", sql(f"SELECT uid, {_RANK} AS rank, coalesce(score, 0) AS shown FROM jobs", "jobs"))
def digest_order(spark, d):
    rows = jobs(spark, d).orderBy(*reports.digest_order())
    return rows.select("uid", reports.verdict_rank(F.col("verdict")).alias("rank"),
                       F.coalesce("score", F.lit(0)).alias("shown"))


@query("w06_digest_top", sql(f"""
    SELECT uid FROM jobs ORDER BY {_RANK}, coalesce(score, 0) DESC, arrival LIMIT 25""", "jobs"))
def digest_top(spark, d):
    return jobs(spark, d).orderBy(*reports.digest_order()).limit(25).select("uid")


_SECTION = f"CASE WHEN {_STALE} THEN 'stale' WHEN score < display_threshold THEN 'below' ELSE 'kept' END"


@query("w07_digest_sections", sql(f"SELECT uid, {_SECTION} AS section FROM jobs JOIN policy USING (source)", "jobs", "policy"))
def digest_sections(spark, d):
    return reports.digest_sections(scored(spark, d), windows(spark), sample.now()).select("uid", "section")


@query("w07_digest_counts", sql(f"SELECT source, {_SECTION} AS section, count(*) AS n FROM jobs JOIN policy USING (source) GROUP BY ALL", "jobs", "policy"))
def digest_counts(spark, d):
    return reports.digest_counts(reports.digest_sections(scored(spark, d), windows(spark), sample.now()))


@query("w08_digest_rows", sql(f"""
    SELECT uid, source, CASE WHEN p.salary_max > 40000 OR p.salary_max IS NULL THEN 'worth the ask' ELSE 'apply now' END AS part
    FROM (SELECT *, {_SECTION} AS section FROM jobs JOIN policy USING (source)) j JOIN postings p USING (uid, source) WHERE section = 'kept'""", "jobs", "policy"))
def digest_rows(spark, d):
    sections = reports.digest_sections(scored(spark, d), windows(spark), sample.now())
    return reports.digest_rows(sections).select("uid", "source", "part")


@query("w08_digest_fallback", sql(f"""
    SELECT uid, score FROM (SELECT *, {_SECTION} AS section FROM jobs JOIN policy USING (source)) WHERE section = 'below'
    ORDER BY {_RANK}, coalesce(score, 0) DESC, arrival LIMIT 5""", "jobs", "policy"))
def digest_fallback(spark, d):
    sections = reports.digest_sections(scored(spark, d), windows(spark), sample.now())
    return reports.digest_fallback(sections).select("uid", "score")


@query("w10_triage_list", sql(f"""
    SELECT uid, source, score, uid IN (SELECT uid FROM letters) AS has_letter FROM {_FRESH} AND state = 'interested'
    ORDER BY score DESC NULLS LAST, posted_at DESC, uid LIMIT 200""", "jobs", "policy", "letters"))
def triage_list(spark, d):
    out = reports.triage_list(jobs(spark, d), windows(spark), views.view(spark, d, "letters"), sample.now(), "interested")
    return out.select("uid", "source", "score", "has_letter")


@query("w12_ordered_asks", sql("""
    SELECT uid, kind, CAST(row_number() OVER (PARTITION BY uid ORDER BY mandatory DESC, kind) AS INT) AS place FROM asks""", "asks"))
def ordered_asks(spark, d):
    return reports.ordered_asks(asks(spark, d)).select("uid", "kind", "place")
