"""Batches, responses, asks and prices."""

from __future__ import annotations

from pyspark.sql import functions as F

from postfunnel.operators import funnel, scoring
from postfunnel.plans import sample, views
from postfunnel.plans.catalog import query
from postfunnel.plans.catalog.duck import sql
from postfunnel.plans.catalog.funnel import survivors

_PLACE = """SELECT *, row_number() OVER (ORDER BY list_position(['building','automobile','machinery','furniture','household'], source), arrival) - 1 AS pos
  FROM survivors"""


def batches(spark, d):
    return scoring.with_batches(survivors(spark, d), sample.BOARDS)


@query("c01_score_batches", sql(f"SELECT uid, pos // 12 AS batch, CAST(pos % 12 AS INT) AS i FROM ({_PLACE})", "survivors"))
def score_batches(spark, d):
    return batches(spark, d).select("uid", "batch", "i")


@query("c02_render_batches", sql(f"""
    SELECT pos // 12 AS batch, CAST(count(*) AS INT) AS n, md5(string_agg(
      '[' || pos % 12 || '] ' || title || chr(10) || '  company: ' || coalesce(nullif(company, ''), 'unknown') || chr(10)
      || '  hiring regions: ' || CASE WHEN len(locs) > 0 THEN array_to_string(locs, ', ')
          WHEN region_unverified THEN 'none stated, and this board''s region field is not reliable -- do NOT assume worldwide'
          ELSE 'none stated (worldwide)' END || chr(10)
      || '  salary: ' || coalesce('up to ' || format('{{:,}}', CAST(annual_usd AS BIGINT)) || ' USD/yr', 'not stated') || ' (' || salary_signal || ')' || chr(10)
      || coalesce('  FLAGGED EMPLOYER: ' || flagged_employer || ' (rate-anchoring intermediary)' || chr(10), '')
      || '  eligibility text found: Must be located in the office.' || chr(10)
      || '  description: About ' || title || '. Must be located in the office.', chr(10) || chr(10) ORDER BY pos)) AS digest
    FROM ({_PLACE}) GROUP BY 1""", "survivors"))
def render_batches(spark, d):
    rows = funnel.with_notes(batches(spark, d))
    return scoring.render_batches(rows).select("batch", "n", F.md5("text").alias("digest"))


def bodies(spark, d):
    """One JSON list per batch, in no useful order and with junk in it."""
    r = views.view(spark, d, "responses")
    once = r.select("batch", "said", "score", (-F.col("arrival")).alias("at"))
    again = r.filter("twice").select("batch", "said", F.col("score") + 1, (F.lit(1) + F.col("arrival")).alias("at"))
    items = once.union(again).select("batch", F.struct("at", F.to_json(F.struct(
        F.col("said").alias("i"), "score", F.lit("maybe").alias("verdict"), F.col("said").alias("why"),
        F.lit("data").alias("cv_variant"))).alias("json")).alias("_item"))
    lists = items.groupBy("batch").agg(F.array_sort(F.collect_list("_item")).alias("_items"))
    text = F.array_join(F.col("_items.json"), ",")
    return lists.select("batch", F.concat(F.lit('[null,7,"junk",{"score":3},'), text, F.lit("]")).alias("body"))


def sent(spark, d):
    return views.view(spark, d, "responses").select("batch", F.col("i").cast("int").alias("i"), "arrival")


_SAID = """said AS (SELECT batch, try_cast(said AS INT) AS i, max(score + CASE WHEN twice THEN 1 ELSE 0 END) AS score
  FROM responses WHERE try_cast(said AS INT) < 12 GROUP BY ALL)"""


@query("c03_merge_responses", sql("", "responses").rstrip() + f""", {_SAID}
    SELECT r.arrival, CAST(s.score AS INT) AS score, CASE WHEN s.i IS NULL THEN 'unscored' ELSE 'maybe' END AS verdict,
      CASE WHEN s.i IS NULL THEN 'model returned no entry for this job' ELSE CAST(s.i AS VARCHAR) END AS why,
      CASE WHEN s.i IS NULL THEN 'engineering' ELSE 'data' END AS cv_variant, s.i IS NOT NULL AS scored
    FROM responses r LEFT JOIN said s ON s.batch = r.batch AND s.i = r.i""")
def merge_responses(spark, d):
    merged = scoring.merge_responses(sent(spark, d), scoring.parse_responses(bodies(spark, d)))
    return merged.select("arrival", "score", "verdict", "why", "cv_variant", "scored")


@query("j07_pairing", sql("", "responses").rstrip() + f""", {_SAID}
    SELECT r.batch, count(*) AS sent, count(s.i) AS scored, count(*) - count(s.i) AS unscored
    FROM responses r LEFT JOIN said s ON s.batch = r.batch AND s.i = r.i GROUP BY r.batch""")
def pairing(spark, d):
    return scoring.pairing(sent(spark, d), scoring.parse_responses(bodies(spark, d)))


_FIRST = """first AS (SELECT uid, kind, mandatory, trim(detail) AS detail, position FROM (
  SELECT *, row_number() OVER (PARTITION BY uid, kind ORDER BY position) AS n FROM raw_asks WHERE kind <> 'made_up') WHERE n = 1)"""


@query("c04_first_asks", sql("", "raw_asks").rstrip() + f", {_FIRST} SELECT uid, kind, mandatory, detail FROM first")
def first_asks(spark, d):
    return scoring.first_asks(views.view(spark, d, "raw_asks"))


def results(spark, d):
    """Each posting with its asks as the scorer listed them."""
    asks = views.view(spark, d, "raw_asks").groupBy("uid").agg(
        F.array_sort(F.collect_list(F.struct("position", "kind", "mandatory", "detail"))).alias("_asks"))
    said = F.transform("_asks", lambda a: F.struct(
        F.concat(F.lit(" "), a["kind"]).alias("kind"), a["mandatory"].alias("mandatory"), a["detail"].alias("detail")))
    p = sample.postings(spark, d).select("uid", "source", "arrival").join(asks, "uid", "left")
    score = F.when(F.col("arrival") % 13 != 0, (F.col("arrival") * 37) % 101).cast("int")
    return p.select("uid", "source", "arrival", score.alias("score"), said.alias("requirements"))


_KINDS = "coalesce(string_agg(kind, ',' ORDER BY position) FILTER (WHERE {}), '')"


@query("c05_blockers_and_steps", sql("", "raw_asks").rstrip() + f""", {_FIRST}
    SELECT uid, {_KINDS.format("mandatory AND kind IN ('degree', 'named_clients')")} AS blockers,
      {_KINDS.format("NOT mandatory AND kind IN ('degree', 'named_clients')")} AS soft_blockers,
      {_KINDS.format("kind IN ('video_intro', 'test_task')")} AS manual_steps,
      count(kind) AS n_asks FROM postings LEFT JOIN first USING (uid) GROUP BY uid""")
def blockers_and_steps(spark, d):
    priced = scoring.price(results(spark, d), sample.profile())
    return priced.select("uid", sample.joined("blockers").alias("blockers"), sample.joined("soft_blockers").alias("soft_blockers"),
                         sample.joined("manual_steps").alias("manual_steps"),
                         F.size("requirements").cast("bigint").alias("n_asks"))


@query("c06_penalty", sql("", "raw_asks").rstrip() + f""", {_FIRST},
    raw AS (SELECT uid, CAST(CASE WHEN arrival % 13 <> 0 THEN (arrival * 37) % 101 END AS INT) AS raw FROM postings)
    SELECT uid, raw AS score_raw, CAST(CASE WHEN n = 0 THEN raw WHEN raw IS NOT NULL THEN greatest(0, raw - 30 * n) END AS INT) AS score
    FROM raw LEFT JOIN (SELECT uid, count(*) AS n FROM first WHERE mandatory AND kind IN ('degree', 'named_clients') GROUP BY uid
      UNION ALL SELECT uid, 0 FROM postings WHERE uid NOT IN (SELECT uid FROM first WHERE mandatory AND kind IN ('degree', 'named_clients'))) USING (uid)""")
def penalty(spark, d):
    return scoring.price(results(spark, d), sample.profile()).select("uid", "score_raw", "score")


_REPRICED = """repriced AS (SELECT j.uid, j.source, j.score AS old_score, coalesce(j.score_raw, j.score) AS score_raw,
    coalesce(b.kinds, '') AS blockers, CAST(CASE WHEN b.n IS NULL THEN coalesce(j.score_raw, j.score)
      WHEN coalesce(j.score_raw, j.score) IS NULL THEN NULL
      ELSE greatest(0, coalesce(j.score_raw, j.score) - 30 * b.n) END AS INT) AS score
  FROM jobs j LEFT JOIN (SELECT uid, count(*) AS n, string_agg(kind, ',' ORDER BY kind) AS kinds FROM asks
    WHERE mandatory AND kind IN ('degree', 'named_clients') GROUP BY uid) b USING (uid))"""


@query("c07_reprice", sql("", "jobs", "asks").rstrip() + f""", {_REPRICED}
    SELECT uid, score_raw, score, blockers, score IS DISTINCT FROM old_score AS changed FROM repriced""")
def reprice(spark, d):
    out = scoring.reprice(views.view(spark, d, "jobs"), views.view(spark, d, "asks"), sample.profile())
    return out.select("uid", "score_raw", "score", sample.joined("blockers").alias("blockers"), "changed")


@query("c07_reprice_counts", sql("", "jobs", "asks").rstrip() + f""", {_REPRICED}
    SELECT count(*) AS rows, count(*) FILTER (WHERE score IS DISTINCT FROM old_score) AS changed FROM repriced""")
def reprice_counts(spark, d):
    out = scoring.reprice(views.view(spark, d, "jobs"), views.view(spark, d, "asks"), sample.profile())
    return out.agg(F.count(F.lit(1)).alias("rows"), F.count_if("changed").alias("changed"))


@query("c07_reflag", sql("SELECT uid, kind, mandatory AND kind IN ('degree', 'named_clients') AS blocking FROM asks", "asks"))
def reflag(spark, d):
    return scoring.reflag(views.view(spark, d, "asks"), sample.profile()).select("uid", "kind", "blocking")


@query("c08_live_kinds", sql("""
    SELECT uid, CASE WHEN arrival % 2 = 1 THEN 'named_clients,degree' ELSE '' END AS blockers,
      coalesce(steps, '') AS steps
    FROM jobs LEFT JOIN (SELECT uid, string_agg(kind, ',' ORDER BY kind) AS steps FROM asks
      WHERE kind IN ('video_intro', 'test_task') GROUP BY uid) USING (uid)""", "jobs", "asks"))
def live_kinds(spark, d):
    p = sample.profile()
    kinds = views.view(spark, d, "asks").groupBy("uid").agg(F.sort_array(F.collect_set("kind")).alias("kinds"))
    rows = views.view(spark, d, "jobs").join(kinds, "uid", "left")
    return rows.select(
        "uid", sample.joined(scoring.live_kinds(F.col("blockers"), p.cannot_provide)).alias("blockers"),
        F.coalesce(sample.joined(scoring.live_kinds(F.col("kinds"), p.needs_manual_step)), F.lit("")).alias("steps"))


@query("c09_run_summary", sql("""
    SELECT source, display_threshold, count(*) FILTER (WHERE coalesce(score, 0) >= display_threshold) AS above, count(*) AS scored
    FROM jobs JOIN policy USING (source) GROUP BY ALL""", "jobs", "policy"))
def run_summary(spark, d):
    return scoring.run_summary(views.view(spark, d, "jobs"), sample.profile().frame(spark))


@query("j06_mandatory_kinds", sql("""
    SELECT j.uid, (SELECT string_agg(kind, ',' ORDER BY kind) FROM asks a WHERE a.uid = j.uid AND a.mandatory) AS musts FROM jobs j""",
    "jobs", "asks"))
def mandatory_kinds(spark, d):
    musts = views.view(spark, d, "asks").filter("mandatory").groupBy("uid").agg(
        F.array_join(F.sort_array(F.collect_set("kind")), ",").alias("musts"))
    return views.view(spark, d, "jobs").select("uid").join(musts, "uid", "left")
