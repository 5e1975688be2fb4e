"""Streams run to the end of what is there, their result read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from postfunnel.operators import funnel
from postfunnel.operators.store import VersionedTable, upsert_rows
from postfunnel.plans import sample, views
from postfunnel.plans.catalog import query
from postfunnel.plans.catalog.duck import sql
from postfunnel.session import shared_dir
from postfunnel.streaming import ingest, throttle


def table_stream(spark, d, name, bytes_per_batch=None):
    # A pattern, because a table may be one file or a folder of files.
    return ingest.file_stream(spark, f"{d}/{name}.parquet*", bytes_per_batch=bytes_per_batch)


def posting_stream(spark, d):
    """Orders as they arrive, joined with the tables that stand still."""
    seen = {"orders": table_stream(spark, d, "orders")}
    views.view(spark, d, "postings", seen)
    p = seen["postings"]
    return p.select(
        "arrival", "source", "uid", "title", "company", "posted", "expires",
        F.when(F.col("anywhere"), F.expr("cast(array() as array<string>)")).otherwise(F.col("places")).alias("location_restrictions"),
        F.when(F.col("any_zone"), F.expr("cast(array() as array<int>)")).otherwise(F.col("zones")).alias("timezone_restrictions"),
        "salary_max", "salary_period", "currency", F.array("category").alias("categories"))


_OUTCOMES = """SELECT source, CASE WHEN rejected_by IS NULL THEN 'survivor' ELSE 'reject' END AS outcome,
  coalesce(rejected_by, 'none') AS stage, count(*) AS n FROM tagged GROUP BY ALL"""


def _outcomes(rows):
    return rows.groupBy("source", "outcome", F.coalesce("rejected_by", F.lit("none")).alias("stage")).agg(
        F.count(F.lit(1)).alias("n"))


@query("t01_incremental_run", sql(_OUTCOMES, "tagged"))
def incremental_run(spark, d):
    run = ingest.FunnelRun(spark, shared_dir(spark, "run"), sample.profile(), sample.now())
    return _outcomes(run.run(posting_stream(spark, d)))


@query("t02_rerun_finds_nothing_new", sql(_OUTCOMES, "tagged"))
def rerun(spark, d):
    """The run, a second run over the same files, and a replay of its batch."""
    run = ingest.FunnelRun(spark, shared_dir(spark, "rerun"), sample.profile(), sample.now())
    stream = posting_stream(spark, d)
    run.run(stream)
    run.run(stream)
    run.process(sample.postings(spark, d), 7)  # all of it seen: adds no row
    return _outcomes(run.results())


@query("t03_without_repeats", sql("SELECT event_type, count(*) AS n FROM events GROUP BY event_type"))
def without_repeats(spark, d):
    """Every event twice on the stream, once in the result."""
    events = table_stream(spark, d, "events").select(
        "event_id", F.col("ts").cast("timestamp").alias("ts"), "event_type",
        F.explode(F.array(F.lit(1), F.lit(2))).alias("copy"))
    root = shared_dir(spark, "repeats")
    once = ingest.without_repeats(events, "event_id", "ts", "60 days")
    ingest.append_available(once, f"{root}/rows", f"{root}/checkpoint")
    return spark.read.parquet(f"{root}/rows").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query("t04_stream_funnel", sql("SELECT uid, rejected_by, reason FROM tagged", "tagged"))
def stream_funnel(spark, d):
    root = shared_dir(spark, "funnel")
    tagged = funnel.tag(posting_stream(spark, d), sample.profile(), sample.now())
    ingest.append_available(tagged.select("uid", "rejected_by", "reason"), f"{root}/rows", f"{root}/checkpoint")
    return spark.read.parquet(f"{root}/rows")


@query("t05_stream_upsert", sql("""
    SELECT uid, CASE WHEN arrival % 2 = 0 THEN title ELSE 'old' END AS title FROM postings""", "postings"))
def stream_upsert(spark, d):
    """A stream of every second posting folded into a table of all of them."""
    root = shared_dir(spark, "upsert")
    table = VersionedTable(spark, f"{root}/table")
    table.replace(sample.postings(spark, d).select("uid", F.lit("old").alias("title")), 1)
    rows = posting_stream(spark, d).filter("arrival % 2 = 0").select("uid", "title")

    def process(batch, batch_id):
        table.upsert(batch, upsert_rows, version=batch_id + 2)

    ingest.run_available(rows, process, f"{root}/checkpoint")
    return table.read()


# Attempts are rare in the events, so the sample's window is days, not minutes.
_WINDOW_MINUTES, _MOST = 60 * 24 * 6, 2


@query("t06_failure_throttle", f"""
    WITH attempts AS (SELECT user_id, list({{'id': event_id, 'at': epoch_us(ts), 'failed': event_type = 'error'}} ORDER BY ts, event_id) AS es
      FROM events WHERE event_type IN ('error', 'signup') GROUP BY user_id),
    folded AS (SELECT user_id, list_reduce(es, lambda acc, e: CASE
        WHEN acc.fails >= {_MOST} AND e.at - acc.opened <= {_WINDOW_MINUTES * 60_000_000}
          THEN {{'log': acc.log || [{{'id': e.id, 'outcome': 'throttled', 'fails': acc.fails}}], 'fails': acc.fails, 'opened': acc.opened, 'id': 0, 'at': 0, 'failed': false}}
        WHEN NOT e.failed
          THEN {{'log': acc.log || [{{'id': e.id, 'outcome': 'ok', 'fails': 0}}], 'fails': 0, 'opened': 0, 'id': 0, 'at': 0, 'failed': false}}
        WHEN acc.fails > 0 AND e.at - acc.opened <= {_WINDOW_MINUTES * 60_000_000}
          THEN {{'log': acc.log || [{{'id': e.id, 'outcome': 'failed', 'fails': acc.fails + 1}}], 'fails': acc.fails + 1, 'opened': acc.opened, 'id': 0, 'at': 0, 'failed': false}}
        ELSE {{'log': acc.log || [{{'id': e.id, 'outcome': 'failed', 'fails': 1}}], 'fails': 1, 'opened': e.at, 'id': 0, 'at': 0, 'failed': false}} END) AS done
      FROM (SELECT user_id, [{{'log': []::STRUCT(id BIGINT, outcome VARCHAR, fails INT)[], 'fails': 0, 'opened': CAST(0 AS BIGINT), 'id': CAST(0 AS BIGINT), 'at': CAST(0 AS BIGINT), 'failed': false}}]
        || list_transform(es, lambda e: {{'log': []::STRUCT(id BIGINT, outcome VARCHAR, fails INT)[], 'fails': 0, 'opened': CAST(0 AS BIGINT), 'id': e.id, 'at': e.at, 'failed': e.failed}}) AS es FROM attempts))
    SELECT CAST(user_id AS VARCHAR) AS key, l.id AS attempt_no, l.outcome AS outcome, l.fails AS fails
    FROM (SELECT user_id, unnest(done.log) AS l FROM folded)""")
def failure_throttle(spark, d):
    root = shared_dir(spark, "throttle")
    ts = F.col("ts").cast("timestamp")
    attempts = table_stream(spark, d, "events", 256 << 20).filter(F.col("event_type").isin("error", "signup")).select(
        F.col("user_id").cast("string").alias("key"), F.col("event_id").alias("attempt_no"), ts.alias("ts"),
        F.unix_micros(ts).alias("at"), (F.col("event_type") == "error").alias("failed")).withWatermark("ts", "60 days")
    out = throttle.throttle(attempts, _WINDOW_MINUTES, _MOST)
    ingest.append_available(out, f"{root}/rows", f"{root}/checkpoint")
    return throttle.last_told(spark.read.parquet(f"{root}/rows")).drop("at")


@query("t07_stage_counters", sql("""
    SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, event_type AS stage, count(*) AS n FROM events GROUP BY ALL"""))
def stage_counters(spark, d):
    root = shared_dir(spark, "counters")
    events = table_stream(spark, d, "events").select(F.col("ts").cast("timestamp").alias("ts"), "event_type")
    counted = ingest.stage_counters(events, "ts", "event_type", "60 days")
    table = ingest.upsert_available(counted, VersionedTable(spark, f"{root}/table", key="stage"), f"{root}/checkpoint",
                                    ingest.replace_counters, "update")
    return table.select(F.date_format("day", "yyyy-MM-dd").alias("day"), "stage", "n")
