"""Eligibility: regions, employers, patterns, stages and the funnel's counters."""

from __future__ import annotations

from pyspark.sql import functions as F

from postfunnel.functions import regions
from postfunnel.operators import funnel, hydrate, store
from postfunnel.plans import sample, views
from postfunnel.plans.catalog import query
from postfunnel.plans.catalog.duck import ADMITS, sql
from postfunnel.sources import boards, cards


def tagged(spark, d):
    rows = boards.with_capabilities(sample.postings(spark, d), sample.capabilities(spark))
    return funnel.tag(rows, sample.profile(), sample.now())


def survivors(spark, d):
    return funnel.survivors(tagged(spark, d))


@query("f19_region_allowed", sql(
    f"SELECT uid, count(*) AS stated, count(*) FILTER (WHERE {ADMITS}) AS admitting "
    "FROM (SELECT uid, unnest(locs) AS x FROM ads) GROUP BY uid", "ads"))
def region_allowed(spark, d):
    p = sample.profile()
    rows = sample.postings(spark, d).filter(F.size("location_restrictions") > 0)
    hits = F.filter("location_restrictions", lambda r: regions.region_allowed(r, p.allow_regions, p.deny_regions))
    return rows.select("uid", F.size("location_restrictions").cast("bigint").alias("stated"),
                       F.size(hits).cast("bigint").alias("admitting"))


@query("f20_local_anchor", sql("SELECT uid, local_anchor FROM tagged", "tagged"))
def local_anchor(spark, d):
    rows = sample.postings(spark, d)
    return rows.select("uid", regions.all_local(F.col("location_restrictions"), sample.profile().local_anchors).alias("local_anchor"))


@query("f21_flagged_employer", sql(
    "SELECT flagged_employer, count(*) AS n FROM tagged GROUP BY 1", "tagged"))
def flagged_employer(spark, d):
    rows = sample.postings(spark, d)
    flag = regions.first_name_in(F.col("company"), sample.profile().employer_flags)
    return rows.groupBy(flag.alias("flagged_employer")).agg(F.count(F.lit(1)).alias("n"))


@query("f22_first_pattern", sql(r"""
    SELECT uid, CASE WHEN regexp_matches(hay, '(?i)anvil') THEN 'anvil'
      WHEN regexp_matches(hay, '(?i)\bpromo\b') THEN '\bpromo\b' END AS pattern,
      CASE WHEN regexp_matches(hay, '(?i)\bold\b') THEN regexp_extract(hay, '(?i)\bold\b')
      WHEN regexp_matches(hay, '(?i)large \w+') THEN regexp_extract(hay, '(?i)large \w+') END AS matched
    FROM ads""", "ads"))
def first_pattern(spark, d):
    p, text = sample.profile(), funnel.haystack()
    return sample.postings(spark, d).select(
        "uid", regions.first_pattern(text, p.role_exclude).alias("pattern"),
        regions.first_match(text, p.role_exclude_unless_paid).alias("matched"))


def _stage(name: str, number: int):
    @query(f"p0{number}_{name}", sql(f"SELECT uid, r{number} AS reason FROM reasons WHERE r{number} IS NOT NULL", "reasons"))
    def stage(spark, d):
        p = sample.profile()
        rows = funnel.with_annual(funnel.with_policy(sample.postings(spark, d), p.frame(spark), "floor_hourly"))
        reason = dict(funnel.stage_reasons(p, sample.now()))[name]
        return rows.select("uid", reason.alias("reason")).filter(F.col("reason").isNotNull())
    return stage


for _n, _name in enumerate(["expired", "region", "timezone", "employer", "salary", "role"], 1):
    _stage(_name, _n)


@query("p07_tagged_postings", sql("""
    SELECT uid, rejected_by, reason, annual_usd, salary_signal, clears_inbound, local_anchor,
      flagged_employer, region_unverified FROM tagged""", "tagged"))
def tagged_postings(spark, d):
    return tagged(spark, d).select(
        "uid", "rejected_by", "reason", "annual_usd", "salary_signal", "clears_inbound", "local_anchor",
        "flagged_employer", "region_unverified")


@query("p08_region_unverified", sql(
    "SELECT source, count(*) AS n FROM tagged WHERE region_unverified GROUP BY source", "tagged"))
def region_unverified(spark, d):
    rows = tagged(spark, d).filter("region_unverified")
    return rows.groupBy("source").agg(F.count(F.lit(1)).alias("n"))


def _stored(spark, d):
    """Rows of earlier runs: every seventh advert scored, every thirteenth rejected."""
    jobs = views.view(spark, d, "jobs")
    return jobs.filter("arrival % 7 = 0"), jobs.filter("arrival % 13 = 0")


_SEEN = "(arrival % 7 = 0 OR arrival % 13 = 0)"


@query("p09_unseen", sql(f"SELECT uid FROM postings WHERE NOT {_SEEN}", "postings"))
def unseen(spark, d):
    return funnel.unseen(sample.postings(spark, d), *_stored(spark, d)).select("uid")


_COUNTS = f"""count(*) AS fetched, count(*) FILTER (WHERE {_SEEN}) AS already_seen,
  count(*) FILTER (WHERE NOT {_SEEN} AND rejected_by = 'expired') AS expired,
  count(*) FILTER (WHERE NOT {_SEEN} AND rejected_by = 'region') AS region,
  count(*) FILTER (WHERE NOT {_SEEN} AND rejected_by = 'timezone') AS timezone,
  count(*) FILTER (WHERE NOT {_SEEN} AND rejected_by = 'employer') AS employer,
  count(*) FILTER (WHERE NOT {_SEEN} AND rejected_by = 'salary') AS salary,
  count(*) FILTER (WHERE NOT {_SEEN} AND rejected_by = 'role') AS role,
  count(*) FILTER (WHERE NOT {_SEEN} AND rejected_by IS NULL) AS to_score"""
_LINE = "concat_ws('  ', fetched || ' fetched', CASE WHEN already_seen > 0 THEN already_seen || ' already seen' END, " + ", ".join(
    f"CASE WHEN {s} > 0 THEN '-' || {s} || ' {s}' END" for s in ("expired", "region", "timezone", "employer", "salary", "role")
) + ", to_score || ' to score') AS line"


@query("p10_funnel_counts", sql(
    f"SELECT *, {_LINE} FROM (SELECT source, {_COUNTS} FROM tagged GROUP BY source)", "tagged"))
def funnel_counts(spark, d):
    rows = funnel.mark_seen(sample.postings(spark, d), *_stored(spark, d))
    counted = funnel.funnel_counts(funnel.tag(rows, sample.profile(), sample.now()), "source")
    return counted.withColumn("line", funnel.funnel_line())


@query("p10_funnel_line", sql(f"SELECT {_LINE} FROM (SELECT {_COUNTS} FROM tagged)", "tagged"))
def funnel_line(spark, d):
    rows = funnel.mark_seen(sample.postings(spark, d), *_stored(spark, d))
    counted = funnel.funnel_counts(funnel.tag(rows, sample.profile(), sample.now()))
    return counted.select(funnel.funnel_line().alias("line"))


@query("p11_near_misses", sql("""
    SELECT uid, rejected_by, reason FROM tagged WHERE rejected_by IS NOT NULL
    ORDER BY CASE rejected_by WHEN 'expired' THEN 0 WHEN 'region' THEN 1 WHEN 'timezone' THEN 2
      WHEN 'employer' THEN 3 WHEN 'salary' THEN 4 ELSE 5 END DESC, arrival LIMIT 5""", "tagged"))
def near_misses(spark, d):
    return funnel.near_misses(tagged(spark, d), 5).select("uid", "rejected_by", "reason")


@query("p12_advise_not_veto", sql("""
    SELECT uid, CASE WHEN source <> 'household' THEN rejected_by END AS rejected_by,
      CASE WHEN source = 'household' THEN '' ELSE reason END AS reason,
      CASE WHEN source = 'household' AND rejected_by IS NOT NULL THEN rejected_by || ': ' || reason ELSE '' END AS objection
    FROM tagged""", "tagged"))
def advise(spark, d):
    # The sample's hand-picked board.
    return funnel.advise(tagged(spark, d), "household").select("uid", "rejected_by", "reason", "objection")


@query("p13_reject_counts", sql(
    "SELECT rejected_by AS stage, count(*) AS n FROM tagged WHERE rejected_by IS NOT NULL GROUP BY 1", "tagged"))
def reject_counts(spark, d):
    return funnel.reject_counts(store.stored_rejects(tagged(spark, d), 1))


@query("p14_explain_rejects", sql(
    "SELECT uid, rejected_by, title, reason FROM tagged WHERE rejected_by IS NOT NULL", "tagged"))
def explain_rejects(spark, d):
    return funnel.explain_rejects(tagged(spark, d))


# Two survivors' boards have detail pages.
_BODY = """CASE WHEN arrival % 2 = 0 THEN CASE WHEN arrival % 9 IN (4, 5) THEN NULL
   WHEN arrival % 9 = 6 THEN 'Part ' || title
   ELSE 'Full ' || title || chr(10) || ' Must be located in ' || source || '.' END END"""


@query("s10_hydrate", sql(f"""
    SELECT uid, body IS NOT NULL AND chosen AS hydrated,
      CASE WHEN body IS NOT NULL AND chosen THEN 'Stated pay: ' || currency || chr(10) || chr(10) || body
        ELSE 'About ' || title || '. Must be located in the office.' END AS description,
      CASE WHEN body IS NULL OR NOT chosen THEN 'Must be located in the office.'
        WHEN arrival % 9 = 6 THEN '' ELSE 'Must be located in ' || source || '.' END AS notes
    FROM (SELECT uid, title, source, arrival, coalesce(currency, 'none') AS currency, {_BODY} AS body,
      source IN ('building', 'machinery') AS chosen
      FROM survivors)""", "survivors"))
def hydrated(spark, d):
    details = views.view(spark, d, "details").select("uid", cards.detail_body(F.col("html")).alias("body"))
    rows = survivors(spark, d).withColumn("salary_text", F.coalesce("currency", F.lit("none")))
    out = hydrate.hydrate(rows, details, ["building", "machinery"])
    return out.select("uid", "hydrated", "description", sample.joined("eligibility_notes", " | ").alias("notes"))
