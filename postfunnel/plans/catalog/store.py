"""Stored tables, exports, serving tables and recovery."""

from __future__ import annotations

from pyspark.sql import functions as F

from postfunnel.operators import recovery, serving, store
from postfunnel.plans import sample, views
from postfunnel.plans.catalog import query
from postfunnel.plans.catalog.duck import NOW, sql
from postfunnel.plans.catalog.funnel import tagged
from postfunnel.session import shared_dir
from postfunnel.sources import boards, cards


def jobs(spark, d):
    return views.view(spark, d, "jobs")


def asks(spark, d):
    return views.view(spark, d, "asks")


def letters(spark, d):
    return views.view(spark, d, "letters")


_LEDGER = """ledger AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY event_no DESC) AS n FROM run_events) WHERE n = 1)"""


@query("s18_next_since", sql("", "run_events").rstrip() + f""", {_LEDGER},
    last AS (SELECT arg_max(started_at, run_id) AS last FROM ledger WHERE ok)
    SELECT strftime(CASE WHEN last IS NULL THEN now - INTERVAL '48' HOUR
      ELSE greatest(now - INTERVAL '336' HOUR, least(last, now - INTERVAL '1' HOUR)) END, '%Y-%m-%d %H:%M:%S') AS since
    FROM (SELECT last, TIMESTAMP '2024-01-31 00:00:00' AS now FROM last)""")
def next_since(spark, d):
    ledger = store.run_ledger(views.view(spark, d, "run_events"))
    now = F.to_timestamp(F.lit("2024-01-31 00:00:00"))
    return store.next_since(ledger, now).select(sample.stamp("since").alias("since"))


def _versions(spark, d):
    """An older store and a run that scores some of its rows again."""
    j = jobs(spark, d).select("uid", "arrival", "source", "title", "score", "verdict", "description")
    old = j.filter("arrival % 3 <> 0").drop("arrival").withColumn("run_id", F.lit(1))
    new = j.filter("arrival % 3 = 0 OR arrival % 5 = 0").drop("arrival").withColumn(
        "score", F.lit(7)).withColumn("description", F.lit(None).cast("string")).withColumn("run_id", F.lit(2))
    return old, new


_UPSERT = """SELECT uid, source, title, CAST(CASE WHEN new THEN 7 ELSE score END AS INT) AS score, verdict,
    CASE WHEN NOT new THEN description END AS description, CASE WHEN new THEN 2 ELSE 1 END AS run_id
  FROM (SELECT *, arrival % 3 = 0 OR arrival % 5 = 0 AS new FROM jobs)"""


@query("k01_upsert_jobs", sql(_UPSERT, "jobs"))
def upsert_jobs(spark, d):
    return store.upsert_rows(*_versions(spark, d))


@query("k01_versioned_table", sql(f"SELECT source, run_id, count(*) AS n FROM ({_UPSERT}) GROUP BY ALL", "jobs"))
def versioned_table(spark, d):
    """The same through the written table: two versions, the second read back."""
    old, new = _versions(spark, d)
    table = store.VersionedTable(spark, shared_dir(spark, "jobs"), F.col("source"))
    table.upsert(old, store.upsert_rows)
    table.upsert(new, store.upsert_rows)
    return table.read().groupBy("source", "run_id").agg(F.count(F.lit(1)).alias("n"))


@query("k02_replace_asks", sql("""
    SELECT uid, kind, mandatory, 'old' AS detail FROM asks JOIN jobs USING (uid) WHERE arrival % 5 <> 0
    UNION ALL SELECT uid, kind, mandatory, detail FROM (SELECT r.uid, kind, r.mandatory, 'new ' || r.position AS detail,
      row_number() OVER (PARTITION BY r.uid, kind ORDER BY r.position DESC) AS n
      FROM raw_asks r JOIN jobs USING (uid) WHERE arrival % 10 = 0) WHERE n = 1""", "asks", "jobs", "raw_asks"))
def replace_asks(spark, d):
    """Every fifth job is scored again; every second of those asks nothing now."""
    again = jobs(spark, d).filter("arrival % 5 = 0").select("uid", "arrival")
    old = asks(spark, d).select("uid", "kind", "mandatory", F.lit("old").alias("detail"))
    new = views.view(spark, d, "raw_asks").join(again.filter("arrival % 10 = 0"), "uid").select(
        "uid", "kind", "mandatory", F.concat(F.lit("new "), F.col("position").cast("string")).alias("detail"), "position")
    return store.replace_asks(old, again, new)


@query("k03_stored_rejects", sql("""
    SELECT uid, rejected_by AS stage, reason, title, 3 AS run_id FROM tagged WHERE rejected_by IS NOT NULL""", "tagged"))
def stored_rejects(spark, d):
    rows = tagged(spark, d)
    return store.stored_rejects(rows.unionByName(rows.filter("arrival % 4 = 0")), 3).drop("posted_at")


@query("k04_run_ledger", sql("", "run_events").rstrip() + f""", {_LEDGER}
    SELECT run_id, strftime(finished_at, '%Y-%m-%d %H:%M:%S') AS finished, ok, fetched, error FROM ledger""")
def run_ledger(spark, d):
    return store.run_ledger(views.view(spark, d, "run_events")).select(
        "run_id", sample.stamp("finished_at").alias("finished"), "ok", "fetched", "error")


@query("k04_last_run", sql("", "run_events").rstrip() + f", {_LEDGER} SELECT run_id, ok, error FROM ledger ORDER BY run_id DESC LIMIT 1")
def last_run(spark, d):
    return store.last_run(store.run_ledger(views.view(spark, d, "run_events"))).select("run_id", "ok", "error")


@query("k05_daily_digest", sql("""
    SELECT source, '2001-08-02' AS day, CAST(2 * count(*) AS BIGINT) AS n FROM jobs GROUP BY source""", "jobs"))
def daily_digest(spark, d):
    """Two runs of one day: the second adds to the first."""
    path = shared_dir(spark, "digest")
    for _ in range(2):
        store.append_digest(jobs(spark, d).select("uid", "source", "score"), path, sample.now())
    back = spark.read.parquet(path)
    return back.groupBy("source", F.col("day").cast("string").alias("day")).agg(F.count(F.lit(1)).alias("n"))


def _pushed(spark, d):
    """A push of every second row, with a second copy of some of them."""
    j = jobs(spark, d).filter("arrival % 2 = 0")
    first = j.select(
        "uid", F.when(F.col("arrival") % 12 != 0, F.col("source")).alias("source"),
        F.when(F.col("arrival") % 8 != 0, F.col("title")).alias("title"), "company", "url", "posted_at",
        F.to_json("regions").alias("regions"), "salary_signal", F.lit(11).alias("score"), "verdict", "why",
        F.lit("data").alias("cv_variant"), "score_raw", F.to_json("blockers").alias("blockers"), F.col("arrival").alias("place"))
    second = first.filter("place % 20 = 0").withColumn("score", F.lit(12)).withColumn(
        "company", F.lit("later")).withColumn("place", F.col("place") + 1_000_000_000_000)
    return first.unionByName(second)


def _serving(spark, d):
    """Serving rows of earlier pushes, already triaged."""
    j = jobs(spark, d).filter("arrival % 3 <> 0")
    return j.select(
        "uid", "source", "title", "company", "url", "posted_at", F.to_json("regions").alias("regions"), "salary_signal",
        "score", "verdict", "why", F.lit("cv").alias("cv_variant"), "score_raw", F.to_json("blockers").alias("blockers"),
        F.col("created_at").alias("first_seen"), "state", F.col("created_at").alias("state_updated_at"))


@query("k06_serving_upsert", sql(f"""
    SELECT uid, CASE WHEN stored THEN source WHEN arrival % 12 = 0 THEN 'unknown' ELSE source END AS source,
      CASE WHEN pushed AND arrival % 8 = 0 THEN '(untitled)' ELSE title END AS title, company,
      CAST(CASE WHEN pushed AND arrival % 20 = 0 THEN 12 WHEN pushed THEN 11 ELSE score END AS INT) AS score,
      CASE WHEN pushed THEN 'data' ELSE 'cv' END AS cv_variant, CASE WHEN stored THEN state ELSE 'new' END AS state,
      strftime(CASE WHEN stored THEN created_at ELSE {NOW} END, '%Y-%m-%d %H:%M:%S') AS first_seen,
      CASE WHEN stored THEN strftime(created_at, '%Y-%m-%d %H:%M:%S') END AS state_updated_at
    FROM (SELECT *, arrival % 3 <> 0 AS stored, arrival % 2 = 0 AS pushed FROM jobs) WHERE stored OR pushed""", "jobs"))
def serving_upsert(spark, d):
    out = serving.take_in_jobs(_serving(spark, d), _pushed(spark, d), sample.now())
    return out.select("uid", "source", "title", "company", "score", "cv_variant", "state",
                      sample.stamp("first_seen").alias("first_seen"), sample.stamp("state_updated_at").alias("state_updated_at"))


@query("k07_serving_asks", sql("""
    SELECT uid, kind, mandatory, detail, blocking FROM asks WHERE kind <> 'degree' AND uid NOT IN
      (SELECT uid FROM raw_asks JOIN jobs USING (uid) WHERE arrival % 7 = 0 AND kind <> 'made_up')
    UNION ALL SELECT uid, kind, mandatory, detail, false FROM (SELECT r.*, row_number() OVER (PARTITION BY r.uid, kind ORDER BY r.position DESC) AS n
      FROM raw_asks r JOIN jobs USING (uid) WHERE arrival % 7 = 0 AND kind <> 'made_up') WHERE n = 1""", "asks", "jobs", "raw_asks"))
def serving_asks(spark, d):
    stored = asks(spark, d).filter("kind <> 'degree'")
    again = jobs(spark, d).filter("arrival % 7 = 0").select("uid")
    pushed = views.view(spark, d, "raw_asks").join(again, "uid").select(
        "uid", F.when(F.col("kind") != "made_up", F.col("kind")).alias("kind"), "mandatory", "detail",
        F.lit(None).cast("boolean").alias("blocking"), F.col("position").alias("place"))
    return serving.take_in_asks(stored, pushed)


@query("k08_serving_letters", sql("""
    SELECT uid, CASE WHEN arrival % 51 = 0 AND arrival % 4 <> 0 THEN 'again' ELSE body END AS body FROM letters JOIN jobs USING (uid)
    UNION ALL SELECT uid, 'again' FROM jobs WHERE arrival % 3 = 0 AND arrival % 17 <> 0 AND arrival % 4 <> 0""", "letters", "jobs"))
def serving_letters(spark, d):
    pushed = jobs(spark, d).filter("arrival % 3 = 0").select(
        "uid", F.when(F.col("arrival") % 8 == 0, "").when(F.col("arrival") % 4 != 0, "again").alias("body"),
        F.lit(None).cast("timestamp").alias("drafted_at"), F.col("arrival").alias("place"))
    return serving.take_in_letters(letters(spark, d), pushed).select("uid", "body")


@query("k09_serving_windows", sql("""
    SELECT source, CASE WHEN n % 4 = 1 OR n % 4 = 2 THEN 99 WHEN n % 4 = 0 THEN NULL ELSE CAST(n AS INT) END AS max_age_days
    FROM (SELECT source, coalesce(max_age_days, 0) AS n FROM raw_policy)""", "raw_policy"))
def serving_windows(spark, d):
    raw = views.view(spark, d, "raw_policy").select("source", F.coalesce("max_age_days", F.lit(0)).alias("n"))
    stored = raw.select("source", F.lit(99).alias("max_age_days"))
    window = (F.when(F.col("n") % 4 == 1, F.lit(-1.0)).when(F.col("n") % 4 == 2, F.lit(2.5))
              .when(F.col("n") % 4 == 3, F.col("n").cast("double")))
    pushed = raw.select("source", window.alias("max_age_days"), F.col("n").alias("place"))
    return serving.take_in_windows(stored, pushed)


_EXPORTED = f"exported AS (SELECT * FROM jobs WHERE created_at >= {NOW} - INTERVAL '1200' DAY)"


@query("k10_export_jobs", sql("", "jobs").rstrip() + f""", {_EXPORTED}
    SELECT uid, source, title, company, url, strftime(posted_at, '%Y-%m-%d %H:%M:%S') AS posted_at, salary_signal, score, verdict,
      why, score_raw, CASE WHEN arrival % 2 = 1 THEN '["named_clients","degree"]' ELSE '["equipment"]' END AS blockers FROM exported""")
def export_jobs(spark, d):
    rows = jobs(spark, d).withColumn("cv_variant", F.lit("data")).withColumn("blockers", F.to_json("blockers"))
    out = serving.export_jobs(rows, sample.now() - F.make_dt_interval(days=F.lit(1200)))
    return out.drop("regions", "cv_variant").withColumn("posted_at", sample.stamp("posted_at"))


def _exported(spark, d):
    rows = jobs(spark, d).withColumn("cv_variant", F.lit("data"))
    return serving.export_jobs(rows, sample.now() - F.make_dt_interval(days=F.lit(1200)))


@query("k11_export_asks", sql("", "jobs", "asks").rstrip() + f""", {_EXPORTED}
    SELECT uid, kind, mandatory, detail, blocking FROM asks WHERE uid IN (SELECT uid FROM exported)""")
def export_asks(spark, d):
    return serving.export_asks(asks(spark, d), _exported(spark, d))


@query("k12_export_letters", sql("", "jobs", "letters").rstrip() + f""", {_EXPORTED}
    SELECT uid, body FROM letters WHERE trim(body) <> '' AND uid IN (SELECT uid FROM exported)""")
def export_letters(spark, d):
    return serving.export_letters(letters(spark, d), _exported(spark, d)).select("uid", "body")


@query("k13_export_windows", sql("", "jobs", "policy").rstrip() + f""", {_EXPORTED}
    SELECT DISTINCT source, max_age_days FROM exported JOIN policy USING (source)""")
def export_windows(spark, d):
    return serving.export_windows(_exported(spark, d), sample.profile().frame(spark))


@query("k14_export_chunks", sql("SELECT uid, (row_number() OVER (ORDER BY arrival) - 1) // 200 AS chunk FROM jobs", "jobs"))
def export_chunks(spark, d):
    return serving.with_chunks(jobs(spark, d).select("uid", "arrival"), "arrival").select("uid", "chunk")


@query("k15_triage_changes", sql("""
    SELECT uid, CASE WHEN s IS NOT NULL THEN s ELSE state END AS state, strftime(t, '%Y-%m-%d %H:%M:%S') AS changed
    FROM jobs LEFT JOIN (SELECT user_id, arg_max(state, change_no) AS s, max(changed_at) AS t FROM clicks
      WHERE state <> 'deleted' GROUP BY user_id) c ON c.user_id = jobs.arrival""", "jobs", "clicks"))
def triage_changes(spark, d):
    j = jobs(spark, d).select("uid", "arrival", "state", F.lit(None).cast("timestamp").alias("state_updated_at"))
    clicks = views.view(spark, d, "clicks").join(j.select("uid", F.col("arrival").alias("user_id")), "user_id")
    changes = clicks.select("uid", "state", F.col("changed_at").cast("timestamp").alias("changed_at"), "change_no")
    out = serving.apply_triage(j, changes)
    return out.select("uid", "state", sample.stamp("state_updated_at").alias("changed"))


@query("k16_added_columns", sql("""
    SELECT uid, title, CASE WHEN arrival % 2 = 0 THEN score END AS score_raw, CASE WHEN arrival % 2 = 1 THEN why END AS why FROM jobs""", "jobs"))
def added_columns(spark, d):
    """Rows written before a column existed keep it null; none is dropped."""
    j = jobs(spark, d)
    old = j.filter("arrival % 2 = 1").select("uid", "title", "why")
    new = j.filter("arrival % 2 = 0").select("uid", "title", F.col("score").alias("score_raw"))
    return store.upsert_rows(old, new)


@query("k17_results_as_json", sql("""
    SELECT uid, '{"uid":"' || uid || '","title":"' || title || '","score":' || coalesce(CAST(score AS VARCHAR), 'null') || '}' AS json FROM jobs""", "jobs"))
def results_as_json(spark, d):
    j = sample.stored(spark, d).withColumnRenamed("regions", "location_restrictions").withColumn("cv_variant", F.lit("data"))
    full = store.results_as_json(j)
    part = F.to_json(F.from_json("json", "uid string, title string, score int"), {"ignoreNullFields": "false"})
    return full.select("uid", part.alias("json"))


@query("k18_export_preview", sql("", "jobs").rstrip() + f""", {_EXPORTED}
    SELECT uid, score, greatest((SELECT count(*) FROM exported) - 10, 0) AS more FROM exported ORDER BY coalesce(score, 0) DESC, uid LIMIT 10""")
def export_preview(spark, d):
    return serving.export_preview(_exported(spark, d)).select("uid", "score", "more")


@query("r09_recovery_targets", sql("""
    SELECT uid, source, score FROM jobs WHERE coalesce(description, '') = '' AND coalesce(score, 0) >= 20""", "jobs"))
def recovery_targets(spark, d):
    return recovery.targets(jobs(spark, d), 20).select("uid", "source", "score")


@query("g12_refetch_since", sql("""
    SELECT source, strftime(min(posted_at) - INTERVAL '1' DAY, '%Y-%m-%d %H:%M:%S') AS since FROM jobs
    WHERE coalesce(description, '') = '' AND coalesce(score, 0) >= 20 GROUP BY source""", "jobs"))
def refetch_since(spark, d):
    out = recovery.refetch_since(recovery.targets(jobs(spark, d), 20), sample.now())
    return out.select("source", sample.stamp("since").alias("since"))


def _filled(spark, d):
    since = F.to_timestamp(F.lit("1999-05-20 00:00:00"))
    walk = views.view(spark, d, "page_walk")
    found = boards.walk(walk, since, 40)
    text = F.when(F.col("arrival") % 4 != 0, F.concat(F.lit("found "), "uid"))
    refetched = found.select("uid", "arrival", text.alias("description"))
    capped = boards.walk_ends(walk, since, 40)
    return recovery.fill(recovery.targets(jobs(spark, d)), refetched, capped, ["building", "machinery", "furniture"])


_FILL_WALK = """pages AS (SELECT *, coalesce(min(fresh) OVER (PARTITION BY source ORDER BY page_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true)
    AND row_number() OVER (PARTITION BY source ORDER BY page_no) = page_no AS reached
  FROM (SELECT source, page_no, bool_or(posted >= TIMESTAMP '1999-05-20') AS fresh FROM page_walk WHERE page_no <= 40 GROUP BY ALL)),
  found AS (SELECT w.uid FROM page_walk w JOIN pages p USING (source, page_no) WHERE reached AND w.posted >= TIMESTAMP '1999-05-20' AND w.arrival % 4 <> 0),
  caps AS (SELECT source, bool_or(page_no = 40 AND fresh) AS hit FROM pages WHERE reached GROUP BY source)"""
_STATUS = """CASE WHEN source NOT IN ('building', 'machinery', 'furniture') THEN 'not refetchable'
  WHEN uid IN (SELECT uid FROM found) THEN 'recovered' WHEN hit THEN 'not reached' ELSE 'gone' END"""


@query("r10_fill_missing_text", sql("", "jobs", "page_walk").rstrip() + f""", {_FILL_WALK}
    SELECT uid, status, CASE WHEN status = 'recovered' THEN 'found ' || uid END AS text FROM (
      SELECT j.uid, {_STATUS} AS status FROM jobs j LEFT JOIN caps USING (source) WHERE coalesce(description, '') = '')""")
def fill_missing_text(spark, d):
    return _filled(spark, d).select("uid", "status", "text")


@query("r10_filled_jobs", sql("", "jobs", "page_walk").rstrip() + f""", {_FILL_WALK}
    SELECT uid, CASE WHEN coalesce(description, '') = '' AND source IN ('building', 'machinery', 'furniture') AND uid IN (SELECT uid FROM found)
      THEN 'found ' || uid ELSE description END AS description FROM jobs""")
def filled_jobs(spark, d):
    return recovery.apply_fill(jobs(spark, d), _filled(spark, d)).select("uid", "description")


def _recovered(spark, d):
    """Each board walked to its own oldest row without text, and the detail page where the listing has none."""
    wanted = recovery.targets(jobs(spark, d))
    walk = views.view(spark, d, "page_walk").join(recovery.refetch_since(wanted, sample.now()), "source")
    found = boards.walk(walk, F.col("since"))
    listed = F.when(F.col("arrival") % 4 != 0, F.concat(F.lit("found "), "uid"))
    details = views.view(spark, d, "details").select("uid", cards.detail_body(F.col("html")).alias("body"))
    refetched = recovery.with_details(found.select("uid", "arrival", listed.alias("description")), details)
    return recovery.fill(wanted, refetched, None, ["building", "machinery", "furniture"])


@query("r10_recover_by_board", sql("", "jobs", "page_walk", "postings").rstrip() + """,
    since AS (SELECT source, min(posted_at) - INTERVAL '1' DAY AS since FROM jobs WHERE coalesce(description, '') = '' GROUP BY source),
    pages AS (SELECT *, coalesce(min(fresh) OVER (PARTITION BY source ORDER BY page_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true)
        AND row_number() OVER (PARTITION BY source ORDER BY page_no) = page_no AS reached
      FROM (SELECT source, page_no, bool_or(posted >= since) AS fresh FROM page_walk JOIN since USING (source) GROUP BY ALL)),
    found AS (SELECT w.uid, w.arrival, CASE WHEN w.arrival % 4 <> 0 THEN 'found ' || w.uid WHEN w.arrival % 9 IN (4, 5) THEN NULL
        WHEN w.arrival % 9 = 6 THEN 'Part ' || p.title ELSE 'Full ' || p.title || chr(10) || ' Must be located in ' || w.source || '.' END AS text
      FROM page_walk w JOIN pages g USING (source, page_no) JOIN since s USING (source) JOIN postings p ON p.uid = w.uid WHERE g.reached AND w.posted >= s.since)
    SELECT j.uid, CASE WHEN j.source NOT IN ('building', 'machinery', 'furniture') THEN 'not refetchable' WHEN text IS NOT NULL THEN 'recovered' ELSE 'gone' END AS status,
      CASE WHEN j.source IN ('building', 'machinery', 'furniture') THEN text END AS text
    FROM jobs j LEFT JOIN found f ON f.uid = j.uid WHERE coalesce(j.description, '') = ''""")
def recover_by_board(spark, d):
    return _recovered(spark, d).select("uid", "status", "text")
