"""Operators on small frames, against plain Python where that is the clearer form."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from postfunnel import policy as policies
from postfunnel import vocab
from postfunnel.operators import funnel, hydrate, numbering, recovery, reports, scoring, selection, serving, store
from postfunnel.operators.numbering import with_position
from postfunnel.policy import BoardPolicy, PolicyError, Profile, policy_frame, profile_from
from postfunnel.schema import as_posting

DAY = dt.datetime(2026, 9, 1)


def now():
    return F.to_timestamp(F.lit("2026-09-04 12:00:00"))


def profile(**changes):
    boards = {b: BoardPolicy(b, 50, 70, 40, 10.0, 7) for b in ("north", "south")}
    boards["south"] = BoardPolicy("south", 20, 60, 60, 30.0, None)
    base = dict(allow_regions=["Kenya"], accept_offsets=[3], target_hourly=40.0, floor_hourly=10.0, inbound_hourly=45.0,
                role_exclude=["intern"], role_exclude_unless_paid=["junior"], cannot_provide=["degree", "references"],
                needs_manual_step=["test_task"], blocker_penalty=30, boards=boards)
    return Profile(**{**base, **changes})


def one(spark, **changes):
    """One posting that passes everything, with one field changed."""
    base = dict(arrival=1, source="north", source_id="1", uid="north:1", title="Dev", company="Acme", posted=DAY)
    row = {**base, **changes}
    schema = ("arrival long, source string, source_id string, uid string, title string, company string, posted timestamp, "
              "expires timestamp, location_restrictions array<string>, timezone_restrictions array<int>, salary_max long, "
              "salary_period string, currency string, categories array<string>, description string")
    names = [p.split()[0] for p in schema.split(", ")]
    return as_posting(spark.createDataFrame([tuple(row.get(n) for n in names)], schema))


@pytest.mark.parametrize("changes, stage, reason", [
    ({}, None, ""),
    ({"expires": dt.datetime(2026, 9, 4, 11)}, "expired", "expired 2026-09-04"),
    ({"expires": dt.datetime(2026, 9, 4, 12)}, None, ""),
    ({"location_restrictions": ["Peru", "Chile", "Cuba", "Fiji"]}, "region", "hiring limited to Peru, Chile, Cuba"),
    ({"location_restrictions": ["Peru", "kenya only"]}, None, ""),
    ({"timezone_restrictions": [-5, 0, 8, 9, 10]}, "timezone", "requires UTC-5, UTC+0, UTC+8, UTC+9"),
    ({"timezone_restrictions": [-5, 3]}, None, ""),
    ({"salary_max": 20799}, "salary", "pays up to 20,799 USD/yr, floor is 20,800"),
    ({"salary_max": 20800}, None, ""),
    ({"salary_max": 20799, "source": "south"}, "salary", "pays up to 20,799 USD/yr, floor is 62,400"),
    ({"salary_max": 0}, None, ""),
    ({"salary_max": 100, "currency": "EUR"}, None, ""),
    ({"title": "Intern dev"}, "role", "excluded title (intern)"),
    ({"categories": ["Interns"]}, "role", "excluded title (intern)"),
    ({"title": "Junior dev"}, "role", "'Junior' title and no salary stated"),
    ({"title": "Junior dev", "salary_max": 90000}, None, ""),
    ({"title": "Intern", "location_restrictions": ["Peru"]}, "region", "hiring limited to Peru"),  # the earlier test wins
])
def test_stages(spark, changes, stage, reason):
    row = funnel.tag(one(spark, **changes), profile(), now()).first()
    assert (row.rejected_by, row.reason) == (stage, reason)


def test_blocklist_include_list_and_unknown_board(spark):
    tagged = funnel.tag(one(spark), profile(employer_blocklist=["acm"]), now()).first()
    assert (tagged.rejected_by, tagged.reason) == ("employer", "blocklisted employer (Acme)")
    assert funnel.tag(one(spark, company=None), profile(employer_blocklist=["acm"]), now()).first().rejected_by is None
    tagged = funnel.tag(one(spark), profile(role_include=["plumber"]), now()).first()
    assert tagged.reason == "title matches no target role"
    rows = one(spark, source="west")
    assert [r.source for r in policies.missing_policies(rows, profile().frame(spark)).collect()] == ["west"]
    with pytest.raises(PolicyError, match="west"):
        policies.require_policies(rows, profile().frame(spark))


def test_policy_resolution_and_mistakes():
    settings = {"identity": {}, "regions": {}, "timezone": {}, "roles": {}, "scoring": {"display_threshold": 55},
                "rate": {"target_hourly_usd": 40, "absolute_floor_hourly_usd": 20},
                "boards": {"defaults": {"draft_at": 80, "max_age_days": 21}, "a": None,
                           "b": {"display_threshold": 0, "draft_if_asked_at": 30, "max_age_days": None}}}
    found = profile_from(settings)
    assert found.boards["a"] == BoardPolicy("a", 55, 80, 80, 20.0, 21)
    assert found.boards["b"] == BoardPolicy("b", 0, 80, 30, 20.0, None)
    assert found.inbound_hourly == 40.0
    with pytest.raises(PolicyError, match="c"):
        found.require_boards(["a", "c"])
    for change, words in [({"rate": {"target_hourly_usd": 5, "absolute_floor_hourly_usd": 20}}, "above the target"),
                          ({"deliverables": {"cannot_provide": ["degre"]}}, "degre"),
                          ({"deliverables": {"cannot_provide": ["degree"], "needs_manual_step": ["degree"]}}, "both"),
                          ({"roles": {"exclude": ["("]}}, "no valid pattern"), ({"boards": []}, None), ({"boards": [1]}, "map")]:
        if words is None:
            assert profile_from({**settings, **change}).boards == {}
            continue
        with pytest.raises(PolicyError, match=words):
            profile_from({**settings, **change})
    del settings["rate"]
    with pytest.raises(PolicyError, match="rate"):
        profile_from(settings)


@pytest.mark.parametrize("keys", [
    [0], list(range(300)), [n * 70_001 for n in range(300)],
    [7, 2**16, 2**16 + 1, 2**32, 2**32 + 5, 2**48, 2**48 + 2**32, 2**62, 2**63 - 1],
])
def test_positions_match_a_sorted_list(spark, keys):
    random.Random(4).shuffle(keys := list(keys))
    rows = [(board, k) for k in keys for board in (2, 1)]
    frame = spark.createDataFrame(rows, "board int, k long").repartition(5)
    found = {(r.board, r.k): r.position for r in with_position(frame, "k", ("board",)).collect()}
    assert found == {row: n for n, row in enumerate(sorted(rows))}
    alone = with_position(frame.filter("board = 1"), "k").collect()
    assert [r.k for r in sorted(alone, key=lambda r: r.position)] == sorted(keys)


def test_price_and_reprice(spark):
    kind = "array<struct<kind string, mandatory boolean, detail string>>"
    cases = [
        (1, 80, [("degree", True, " x "), ("degree", False, "later"), ("references", True, None), ("bogus", True, ""), (" test_task ", False, "")]),
        (2, 20, [("degree", True, "y" * 300)]), (3, None, [("degree", True, "")]), (4, 70, [("degree", False, "")]),
        (5, 50, None), (6, 60, [(None, True, None)]),
    ]
    rows = spark.createDataFrame(cases, f"uid int, score int, requirements {kind}")
    found = {r.uid: r for r in scoring.price(rows, profile()).collect()}
    assert [(found[n].score_raw, found[n].score) for n in range(1, 7)] == [(80, 20), (20, 0), (None, None), (70, 70), (50, 50), (60, 60)]
    assert [tuple(a) for a in found[1].requirements] == [("degree", True, "x"), ("references", True, ""), ("test_task", False, "")]
    assert (found[1].blockers, found[1].soft_blockers, found[1].manual_steps) == (["degree", "references"], [], ["test_task"])
    assert (found[4].soft_blockers, len(found[2].requirements[0].detail), found[6].requirements) == (["degree"], 200, [])

    jobs = spark.createDataFrame([("a", 50, 80, ["degree"]), ("b", 50, None, []), ("c", None, None, []), ("d", 10, 40, ["gone"])],
                                 "uid string, score int, score_raw int, blockers array<string>")
    asks = spark.createDataFrame([("a", "degree", True), ("a", "references", True), ("b", "degree", False), ("c", "degree", True)],
                                 "uid string, kind string, mandatory boolean")
    again = {r.uid: r for r in scoring.reprice(jobs, asks, profile()).collect()}
    assert (again["a"].score, again["a"].blockers, again["a"].changed) == (20, ["degree", "references"], True)
    assert (again["b"].score, again["b"].score_raw, again["b"].changed) == (50, 50, False)
    assert (again["c"].score, again["c"].changed) == (None, False)
    assert (again["d"].score, again["d"].blockers) == (40, [])  # nothing blocks any more: back to the raw score


def test_responses_by_index_not_by_place(spark):
    body = '[{"i":2,"score":30},null,5,"x",{"score":1},{"i":"0","score":10},{"i":2,"score":31},{"i":-1,"score":9},{"i":12,"score":9},{"i":1.0,"score":20}]'
    answers = spark.createDataFrame([(0, body), (1, "no list")], "batch long, body string")
    batched = spark.createDataFrame([(0, n) for n in range(4)] + [(1, 0)], "batch long, i int")
    merged = scoring.merge_responses(batched, scoring.parse_responses(answers)).orderBy("batch", "i").collect()
    assert [r.score for r in merged] == [10, 20, 31, None, None]
    assert [(r.verdict, r.why) for r in merged[3:]] == [("unscored", vocab.UNSCORED_WHY)] * 2


def jobs_frame(spark, rows):
    names = "uid string, source string, title string, company string, score int, arrival long, posted_at timestamp, description string"
    return spark.createDataFrame(rows, names).repartition(3)


def test_letters_are_shared_between_boards(spark):
    ask = "Send a cover letter."
    rows = [("n1", "north", "Dev", "A", 90, 1, DAY, ""), ("n2", "north", " dev", "a ", 95, 2, DAY, ""),  # a repost, better scored
            ("n3", "north", "Ops", None, 85, 3, DAY, ""), ("n4", "north", "QA", "", 69, 4, DAY, ask), ("n5", "north", "QB", "", 69, 5, DAY, ""),
            ("n6", "north", "QC", "", 39, 6, DAY, ask), ("n7", "north", "QD", "", None, 7, DAY, ask), ("n8", "north", "QE", "", 71, 8, DAY, ""),
            ("s1", "south", "Dev", "A", 60, 9, DAY, ""), ("s2", "south", "Ops", "A", 99, 10, DAY, ""), ("w1", "west", "Dev", "A", 99, 11, DAY, "")]
    letters = spark.createDataFrame([("s2",)], "uid string")
    bars = profile().frame(spark)
    jobs = jobs_frame(spark, rows)
    found = selection.run_letters(jobs, bars, letters, 4).orderBy("tier", "source").collect()
    assert [(r.uid, r.tier) for r in found] == [("n2", 1), ("s1", 1), ("n3", 2), ("n8", 3)]
    letters = spark.createDataFrame([("n1",), ("s2",), ("w1",)], "uid string")
    back = selection.backfill_letters(jobs, bars, letters).collect()
    assert [r.uid for r in back] == ["n3", "n8", "n4", "s1"]  # n2 is n1's repost
    assert [r.uid for r in selection.backfill_letters(jobs, bars, letters, 2).collect()] == ["n3", "n8"]
    reasons = {r.uid: r.draft_reason for r in selection.qualifying(jobs, bars).collect()}
    assert reasons["n3"] == "score 85 at or above north draft_at 70"
    assert reasons["n4"] == "the advert asks for a cover letter, and score 69 clears north draft_if_asked_at 40"


def test_one_repost_group_with_most_of_the_rows(spark):
    """A third of all rows are copies of one advert; the result stays whole."""
    rows = [(f"n{n}", "north", "Dev" if n % 3 == 0 else f"T{n}", "A", n % 100, n, DAY, "") for n in range(3000)]
    found = {r.uid: r for r in selection.collapse_reposts(jobs_frame(spark, rows)).collect()}
    assert len(found) == 2001
    assert (found["n99"].score, found["n99"].first_arrival) == (99, 0)


def test_prefix_lookup(spark):
    rows = jobs_frame(spark, [(u, "north", "T", "", 1, 1, DAY, "") for u in ("a:1", "a:12", "a:13", "b_1", "bx1", "c%")])
    assert selection.find_job(rows, "a:1").uid == "a:1"
    assert selection.find_job(rows, "a:12").uid == "a:12"
    assert selection.find_job(rows, "b_").uid == "b_1"
    assert selection.find_job(rows, "c").uid == "c%"
    assert selection.find_job(rows, "%") is None
    with pytest.raises(LookupError):
        selection.find_job(rows, "a")


def test_reports_never_pool_boards(spark):
    jobs = spark.createDataFrame([("a", "north", 50, 50), ("b", "north", 40, 40), ("c", "south", 9, 9), ("d", "west", 1, 1)],
                                 "uid string, source string, score int, score_raw int").withColumns(
        {"title": F.col("uid"), "company": F.lit("x"), "created_at": now()})
    asks = spark.createDataFrame([("a", "degree", True, "d"), ("b", "degree", False, "e"), ("c", "degree", True, "f"), ("z", "degree", True, "g")],
                                 "uid string, kind string, mandatory boolean, detail string")
    tally = [tuple(r) for r in reports.ask_tally(jobs, asks, profile()).collect()]
    assert tally == [("north", "degree", 2, 1, 2, 100.0, True), ("south", "degree", 1, 1, 1, 100.0, True)]
    assert sorted(map(tuple, reports.coverage(jobs, asks).collect())) == [("north", 2, 2), ("south", 1, 1), ("west", 0, 1)]
    assert sorted((r.source, r.blocked) for r in reports.blocked_today(jobs, asks, profile()).collect()) == [
        ("north", 1), ("south", 1), ("west", 0)]
    with pytest.raises(ValueError, match="unknown kind"):
        reports.ask_detail(jobs, asks, "hobby")


def test_digest_sections(spark):
    rows = spark.createDataFrame([
        ("a", "north", 90, dt.datetime(2026, 8, 28, 12), "strong", True), ("b", "north", 90, dt.datetime(2026, 8, 27, 12, 0, 1), "maybe", False),
        ("c", "north", 90, dt.datetime(2026, 8, 27, 12), "no", True), ("d", "north", 49, DAY, "no", True), ("e", "north", None, DAY, "unscored", True),
        ("f", "south", 20, dt.datetime(2020, 1, 1), "no", False)],
        "uid string, source string, score int, posted timestamp, verdict string, clears_inbound boolean").withColumn("arrival", F.lit(1))
    found = reports.digest_sections(rows, profile().frame(spark), now())
    assert {r.uid: r.section for r in found.collect()} == {"a": "kept", "b": "kept", "c": "stale", "d": "below", "e": "kept", "f": "kept"}
    assert {r.uid: r.part for r in reports.digest_rows(found).collect()} == {
        "a": "worth the ask", "b": "apply now", "e": "worth the ask", "f": "apply now"}
    assert [r.uid for r in reports.digest_fallback(found).collect()] == ["d"]


def test_serving_upsert_keeps_triage(spark):
    names = [*serving.REFRESHED, *serving.FIRST_GIVEN]
    old = spark.createDataFrame([("a", "Old", "applied", "north", 1)], "uid string, title string, state string, source string, score int")
    for name in names:
        if name not in old.columns:
            kind = "timestamp" if name in ("posted_at", "first_seen", "state_updated_at") else "int" if name == "score_raw" else "string"
            old = old.withColumn(name, F.lit(None).cast(kind))
    new = spark.createDataFrame([("a", "New", "south", 2, 1), ("b", "", None, 3, 2), ("b", "Two", "east", 4, 3), (None, "x", "y", 5, 4)],
                                "uid string, title string, source string, score int, place long")
    for name in vocab.EXPORT_FIELDS:
        if name not in new.columns:
            new = new.withColumn(name, F.lit(None).cast(old.schema[name].dataType if name in old.columns else "string"))
    found = {r.uid: r for r in serving.take_in_jobs(old, new, now()).collect()}
    assert set(found) == {"a", "b"}
    assert (found["a"].title, found["a"].score, found["a"].state, found["a"].source) == ("New", 2, "applied", "north")
    assert (found["b"].title, found["b"].score, found["b"].state, found["b"].source) == ("Two", 4, "new", "unknown")


def test_export_is_an_allow_list(spark):
    row = {name: "x" for name in vocab.EXPORT_FIELDS} | {"description": "secret", "created_at": "2026-09-04 00:00:00"}
    jobs = spark.createDataFrame([tuple(row.values())], list(row)).withColumn("created_at", F.to_timestamp("created_at"))
    assert serving.export_jobs(jobs).columns == vocab.EXPORT_FIELDS
    assert serving.export_jobs(jobs, now()).count() == 0


def test_versions_survive_a_write_that_never_ended(spark, tmp_path):
    table = store.VersionedTable(spark, str(tmp_path / "t"))
    assert table.read() is None and table.version() == 0
    table.upsert(spark.createDataFrame([("a", 1), ("b", 1)], "uid string, n int"), store.upsert_rows)
    table.upsert(spark.createDataFrame([("b", 2, "x")], "uid string, n int, added string"), store.upsert_rows)
    expected = [("a", 1, None), ("b", 2, "x")]
    assert sorted(map(tuple, table.read().collect())) == expected
    # Data without a pointer is what a dead writer leaves behind.
    spark.createDataFrame([("z", 9)], "uid string, n int").write.parquet(str(tmp_path / "t" / "data" / "version=3" / "part=all"))
    assert sorted(map(tuple, table.read().collect())) == expected
    # A replayed batch writes its own version again.
    table.upsert(spark.createDataFrame([("b", 2, "x")], "uid string, n int, added string"), store.upsert_rows, version=2)
    assert sorted(map(tuple, table.read().collect())) == expected and table.version() == 2


def test_only_touched_parts_are_rewritten(spark, tmp_path):
    table = store.VersionedTable(spark, str(tmp_path / "t"), F.col("month"))

    def rows(*values):
        return spark.createDataFrame(values, "uid string, month string, n int")

    table.upsert(rows(("a", "2026/01", 1), ("b", "2026/02", 1), ("c", "2026/03", 1)), store.upsert_rows)
    table.upsert(rows(("b", "2026/03", 2)), store.upsert_rows)  # b moves, its old month is empty now
    assert sorted(map(tuple, table.read().collect())) == [("a", "2026/01", 1), ("b", "2026/03", 2), ("c", "2026/03", 1)]
    assert sorted(p.name for p in (tmp_path / "t" / "data" / "version=2").glob("part=*")) == ["part=2026-03"]
    table.upsert(rows(("b", "2026/03", 2)), store.upsert_rows, version=2)
    assert len(table.read().collect()) == 3
    table.upsert(rows(("b", "2026/03", 2)).limit(0), store.upsert_rows)  # an empty batch changes nothing
    assert len(table.read().collect()) == 3
    table.replace(rows(("z", "2026/02", 5)))
    assert sorted(map(tuple, table.read().collect())) == [("z", "2026/02", 5)]


@pytest.mark.parametrize("runs, since", [
    ([], "2026-09-02 12:00:00"), ([(1, "2026-09-03 00:00:00", False)], "2026-09-02 12:00:00"),
    ([(1, "2026-09-03 00:00:00", True), (2, "2026-09-04 00:00:00", False)], "2026-09-03 00:00:00"),
    ([(1, "2026-09-04 11:30:00", True)], "2026-09-04 11:00:00"), ([(1, "2026-01-01 00:00:00", True)], "2026-08-21 12:00:00"),
])
def test_next_since(spark, runs, since):
    ledger = spark.createDataFrame(runs, "run_id int, at string, ok boolean").withColumn("started_at", F.to_timestamp("at"))
    assert str(store.next_since(ledger, now()).first().since) == since


def test_recovery_fills_only_what_is_missing(spark):
    jobs = spark.createDataFrame([("a", "north", "", 5), ("b", "north", None, 5), ("c", "south", "", 5), ("d", "north", "kept", 5),
                                  ("e", "west", "", 5)], "uid string, source string, description string, score int").withColumns(
        {"title": F.col("uid"), "company": F.lit(""), "posted_at": F.lit(DAY)})
    wanted = recovery.targets(jobs)
    assert sorted(r.uid for r in wanted.collect()) == ["a", "b", "c", "e"]
    fetched = spark.createDataFrame([("a", 1, " "), ("a", 2, "first"), ("a", 3, "second"), ("d", 4, "no")], "uid string, arrival long, description string")
    capped = spark.createDataFrame([("north", False), ("south", True)], "source string, hit_page_cap boolean")
    filled = recovery.fill(wanted, fetched, capped, ["north", "south"])
    assert {r.uid: (r.status, r.text) for r in filled.collect()} == {
        "a": ("recovered", "first"), "b": ("gone", None), "c": ("not reached", None), "e": ("not refetchable", None)}
    assert {r.uid: r.description for r in recovery.apply_fill(jobs, filled).collect()} == {
        "a": "first", "b": None, "c": "", "d": "kept", "e": ""}


def test_hydrate_keeps_the_teaser_where_the_page_is_missing(spark):
    rows = one(spark).unionByName(one(spark, arrival=2, uid="north:2", description="Teaser")).unionByName(
        one(spark, arrival=3, uid="north:3", description="Beyond")).withColumn("salary_text", F.lit("$5"))
    pages = spark.createDataFrame([("north:1", "Must be based in X."), ("north:2", ""), ("north:3", "full")], "uid string, body string")
    found = {r.uid: r for r in hydrate.hydrate(rows, pages, ["north"], 2).collect()}
    assert found["north:1"].description == "Stated pay: $5\n\nMust be based in X."
    assert found["north:1"].eligibility_notes == ["Must be based in X."]
    assert [found[u].description for u in ("north:2", "north:3")] == ["Teaser", "Beyond"]


def test_order_of_partitions_does_not_matter(spark):
    rows = [(f"n{n}", "north", f"T{n % 40}", "A", n % 90, n, DAY, "") for n in range(500)]
    letters = spark.createDataFrame([], "uid string")
    results = []
    for seed in range(3):
        random.Random(seed).shuffle(rows)
        jobs = jobs_frame(spark, rows)
        results.append((sorted(map(tuple, selection.collapse_reposts(jobs).collect())),
                        [r.uid for r in selection.backfill_letters(jobs, profile().frame(spark), letters).collect()]))
    assert results[0] == results[1] == results[2]


def test_policy_frame_of_many_boards_is_not_broadcast(spark, monkeypatch):
    monkeypatch.setattr(policies, "MAX_BROADCAST_BOARDS", 1)
    boards = [BoardPolicy(str(n), 1, 1, 1, 1.0) for n in range(2)]
    assert "ResolvedHint" not in policy_frame(spark, boards)._jdf.queryExecution().analyzed().toString()


def test_scores_and_asks_as_scorers_send_them(spark):
    asks = ['{"kind": " degree ", "mandatory": 1, "detail": 5}', '"junk"', "7", "null", '{"kind": 3, "mandatory": true}', '{"mandatory": true}',
            '{"kind": "references", "mandatory": "false", "detail": ["a"]}', '{"kind": "equipment", "mandatory": "", "detail": null}',
            '{"kind": "test_task", "mandatory": []}', '{"kind": "video_intro", "mandatory": 0.0}', '{"kind": "certification", "mandatory": {"a": 1}}']
    body = (f'[{{"i": 0, "score": 87.5, "requirements": [{", ".join(asks)}]}}, {{"i": 1, "score": "60", "requirements": "none"}},'
            ' {"i": 2, "score": "high", "requirements": {"kind": "degree"}}, {"i": 3, "score": -0.5}]')
    answers = spark.createDataFrame([(0, body)], "batch long, body string")
    found = {r.i: r.result for r in scoring.parse_responses(answers).collect()}
    assert [found[n].score for n in range(4)] == [87, 60, None, 0]
    assert [(a.kind.strip(), a.mandatory) for a in found[0].requirements] == [
        ("degree", True), ("3", True), ("references", True), ("equipment", False), ("test_task", False), ("video_intro", False), ("certification", True)]
    assert found[0].requirements[0].detail == "5" and found[0].requirements[3].detail is None
    assert not found[1].requirements and not found[2].requirements


def test_a_missing_state_is_no_total(spark):
    when = dt.datetime(2026, 9, 3)
    jobs = spark.createDataFrame([("a", "x", when), ("a", None, when), ("b", None, when)], "source string, state string, posted_at timestamp")
    windows = spark.createDataFrame([], "source string, max_age_days int")
    found = reports.triage_tally(jobs, windows, F.lit(dt.datetime(2026, 9, 4)))
    assert sorted(map(tuple, found.collect()), key=str) == sorted(
        [("(all)", "(all)", 3), ("a", "(all)", 2), ("a", None, 1), ("a", "x", 1), ("b", "(all)", 1), ("b", None, 1)], key=str)


def test_two_copies_in_a_batch_and_rows_without_a_part(spark, tmp_path):
    table = store.VersionedTable(spark, str(tmp_path / "t"), F.col("board"))
    rows = [("a", "x", 1), ("a", "x", 2), ("b", None, 1), ("c", "y", 3)]
    for _ in range(2):
        table.upsert(spark.createDataFrame(rows, "uid string, board string, n int"), store.upsert_rows)
        assert sorted(map(tuple, table.read().select("uid", "board", "n").collect()), key=str) == [("a", "x", 2), ("b", None, 1), ("c", "y", 3)]
    table.upsert(spark.createDataFrame([("b", None, 5)], "uid string, board string, n int"), store.upsert_rows)
    assert sorted((r.uid, r.n) for r in table.read().collect()) == [("a", 2), ("b", 5), ("c", 3)]


@pytest.mark.parametrize("partitions", [1, 3, 7])
def test_order_over_several_columns(spark, partitions):
    rows = [(f"f{n // 100:02d}", n // 10 % 10, n % 10, n) for n in range(1, 1000, 3)]
    frame = spark.createDataFrame(rows[::-1], "file string, page int, pos int, n int").repartition(partitions)
    found = numbering.with_order(frame, "file", "page", "pos").orderBy("arrival").collect()
    assert [r.n for r in found] == [r[3] for r in rows] and [r.arrival for r in found] == list(range(len(rows)))
    assert numbering.with_order(frame.limit(0), "file", "page").count() == 0


def test_all_mistakes_of_a_settings_file_are_told():
    settings = {"identity": {}, "regions": {}, "timezone": {}, "roles": {"exclude": ["("]}, "rate": {"target_hourly_usd": 5, "absolute_floor_hourly_usd": 20},
                "deliverables": {"cannot_provide": ["degree", "degre"], "needs_manual_step": ["degree"]}, "boards": {"a": 3}}
    assert [where for where, _ in policies.violations(settings)] == [
        "scoring", "rate", "roles.exclude", "deliverables.cannot_provide", "deliverables", "boards.a"]
