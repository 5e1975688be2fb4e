"""A run from postings to stored tables, twice over the same rows."""

import datetime as dt
import json

from pyspark.sql import functions as F

from postfunnel.plans import run as plan
from postfunnel.policy import profile_from
from postfunnel.schema import as_posting

def now():
    return F.to_timestamp(F.lit("2026-09-04 12:00:00"))


SETTINGS = {
    "identity": {}, "regions": {"allow": ["Kenya"]}, "timezone": {"accept": [3]},
    "rate": {"target_hourly_usd": 40, "absolute_floor_hourly_usd": 30},
    "roles": {"exclude": ["intern"]}, "scoring": {},
    "deliverables": {"cannot_provide": ["degree"], "needs_manual_step": ["test_task"]},
    "boards": {"defaults": {"draft_at": 70}, "north": {}, "south": {}},
}


def postings(spark, titles):
    when = dt.datetime(2026, 9, 3)
    rows = [(n, "north" if n % 2 else "south", str(n), f"{'north' if n % 2 else 'south'}:{n}", t, when)
            for n, t in enumerate(titles)]
    return as_posting(spark.createDataFrame(
        rows, "arrival long, source string, source_id string, uid string, title string, posted timestamp"))


def scorer(batches):
    """Scores index 0 and 1 of each batch; index 0 asks for a degree."""
    body = json.dumps([
        {"i": 0, "score": 80, "verdict": "strong", "why": "w", "cv_variant": "data",
         "requirements": [{"kind": "degree", "mandatory": True, "detail": " a degree "}]},
        {"i": "1", "score": 90, "verdict": "strong", "why": "w", "cv_variant": "data", "requirements": []},
    ])
    return batches.select("batch", F.lit(body).alias("body"))


def test_run_stores_results_and_a_second_run_finds_nothing(spark, tmp_path):
    profile = profile_from(SETTINGS)
    kept = plan.RunStore(spark, str(tmp_path / "store"))
    rows = postings(spark, ["dev", "intern", "builder", "tester", "writer"])

    first = plan.run(spark, rows, profile, now(), kept, scorer=scorer)
    assert first.line == "5 fetched  -1 role  4 to score"
    stored = {r.uid: r for r in kept.jobs.read().collect()}
    assert len(stored) == 4
    # Boards in name order, arrival inside: north:3, south:0, south:2, south:4.
    assert (stored["north:3"].score_raw, stored["north:3"].score, stored["north:3"].blockers) == (80, 50, ["degree"])
    assert stored["south:0"].score == 90
    assert (stored["south:2"].score, stored["south:2"].verdict) == (None, "unscored")
    assert [(r.uid, r.kind, r.detail, r.blocking) for r in kept.asks.read().collect()] == [
        ("north:3", "degree", "a degree", True)]
    assert [(r.uid, r.stage) for r in kept.rejects().collect()] == [("north:1", "role")]

    letters = spark.createDataFrame([], "uid string")
    assert [r.uid for r in plan.letters_for(first, profile, letters).collect()] == ["south:0"]

    second = plan.run(spark, rows, profile, now(), kept, scorer=scorer)
    assert second.line == "5 fetched  5 already seen  0 to score"
    assert second.run_id == 2
    assert kept.jobs.read().count() == 4
    assert kept.ledger().filter("ok").count() == 2


def test_rescore_replaces_rows_and_their_asks(spark, tmp_path):
    profile = profile_from(SETTINGS)
    kept = plan.RunStore(spark, str(tmp_path / "store"))
    rows = postings(spark, ["dev", "builder"])
    plan.run(spark, rows, profile, now(), kept, scorer=scorer)
    assert kept.asks.read().count() == 1
    plan.run(spark, rows, profile, now(), kept, rescore=True)
    assert {r.score for r in kept.jobs.read().collect()} == {None}
    assert kept.asks.read().count() == 0


def test_a_board_without_a_policy_stops_the_run(spark, tmp_path):
    import pytest

    from postfunnel.policy import PolicyError

    rows = postings(spark, ["dev"]).withColumn("source", F.lit("west"))
    with pytest.raises(PolicyError, match="west"):
        plan.run(spark, rows, profile_from(SETTINGS), now(), plan.RunStore(spark, str(tmp_path / "s")))


def test_failures_of_boards_and_of_the_run_are_kept(spark, tmp_path):
    import pytest

    kept = plan.RunStore(spark, str(tmp_path / "s"))
    status = spark.createDataFrame([("north", True, None), ("south", False, "no such folder")], "source string, ok boolean, error string")
    plan.run(spark, postings(spark, ["dev"]), profile_from(SETTINGS), now(), kept, status=status)
    with pytest.raises(plan.NoSource, match="south: no such folder"):
        plan.run(spark, postings(spark, []), profile_from(SETTINGS), now(), kept, status=status.where("NOT ok"))

    def broken(batches):
        raise ValueError("the scorer is away")

    with pytest.raises(ValueError, match="away"):
        plan.run(spark, postings(spark, ["dev", "more"]), profile_from(SETTINGS), now(), kept, scorer=broken)
    ledger = kept.ledger().orderBy("run_id").collect()
    assert [(r.ok, r.error) for r in ledger] == [
        (True, "south: no such folder"), (False, "NoSource: every source failed: south: no such folder"), (False, "ValueError: the scorer is away")]
    assert all(r.finished_at > r.started_at for r in ledger)


def test_of_two_copies_in_a_run_the_later_one_is_stored(spark, tmp_path):
    kept = plan.RunStore(spark, str(tmp_path / "s"))
    rows = postings(spark, ["dev", "old", "x", "new"]).withColumn("uid", F.when(F.col("arrival") % 2 == 1, "north:1").otherwise(F.col("uid")))
    plan.run(spark, rows, profile_from(SETTINGS), now(), kept)
    assert sorted((r.uid, r.title) for r in kept.jobs.read().collect()) == [("north:1", "new"), ("south:0", "dev"), ("south:2", "x")]
