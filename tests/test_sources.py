"""Readers over files written by hand."""

import datetime as dt
import json
import time

import pytest
from pyspark.sql import functions as F

from postfunnel.plans import sample
from postfunnel.sources import boards, capture, cards, feed, files, markup, pages, readers  # noqa: F401


def at(text):
    return F.to_timestamp(F.lit(text))


def rows_of(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


ITEM = {"guid": "g1", "applicationLink": "https://a/1", "title": " Dev ", "companyName": " Org ", "pubDate": 1788393600,
        "excerpt": "<b>x</b>" * 400, "description": "<p>Hi &amp; bye</p>", "locationRestrictions": [" Kenya ", "", " "],
        "timezoneRestrictions": [3, "4", "junk", None], "minSalary": 0, "maxSalary": 5000, "salaryPeriod": "",
        "currency": "USD", "categories": ["a"], "expiryDate": "bad", "somethingNew": {"a": 1}}


def test_feed_files(spark, tmp_path):
    items = [ITEM, {**ITEM, "guid": None, "applicationLink": "https://a/2"}, {**ITEM, "guid": "", "applicationLink": None},
             {**ITEM, "guid": "g4", "title": "  "}, {**ITEM, "guid": "g5", "pubDate": "soon"}, {"guid": "g6"}]
    (tmp_path / "p1.json").write_text(json.dumps({"jobs": items, "nextCursor": "c"}))
    (tmp_path / "p2.json").write_text("{broken")
    (tmp_path / "p3.json").write_text(json.dumps({"jobs": None}))
    found = feed.read_feed(spark, str(tmp_path))
    assert rows_of(found, "uid") == [("himalayas:g1",), ("himalayas:https://a/2",)]
    row = found.filter("source_id = 'g1'").first()
    assert (row.title, row.company, row.description, row.url) == ("Dev", "Org", "Hi & bye", "https://a/1")
    assert (row.location_restrictions, row.timezone_restrictions) == (["Kenya"], [3, 4])
    assert (row.salary_min, row.salary_max, row.salary_period, row.expires) == (None, 5000, None, None)
    assert row.posted == dt.datetime(2026, 9, 3) and len(row.excerpt) == 600 and row.seniority == []


def capture_row(key, **changes):
    return {"jobkey": key, "title": "T " + str(key), "company": None, "country": "PH", "pub_date": 1788393600000,
            "expired": False, "salary_text": None, "salary_min": None, "salary_max": None, "salary_period": None,
            "url": None, "date_posted": "2026-09-02T09:12:44.117Z", "valid_through": None, "description": "<p>d</p>", **changes}


def test_captures(spark, tmp_path):
    def save(name, taken, *results):
        (tmp_path / name).write_text(json.dumps({"captured_at": taken, "site": "s.example", "results": list(results)}, indent=1))

    save("indeed-1.json", "2026-09-01T00:00:00Z", capture_row("a", title="old a"), capture_row("b", title="old b"),
         capture_row("c", date_posted="2026-09-02T00:00:00Z"))
    save("indeed-2.json", "2026-09-03T00:00:00Z", capture_row("a", title="new a"), capture_row("b", title=" "),
         capture_row("c", date_posted="2026-01-01"), capture_row(""), capture_row("d", expired=True),
         capture_row("e", date_posted=None), capture_row("f", date_posted=None, pub_date=None))
    save("indeed-3.json", "2026-08-01T00:00:00Z", capture_row("z"))
    save("indeed-4.json", None, capture_row("y"))
    save("other.json", "2026-09-03T00:00:00Z", capture_row("x"))
    (tmp_path / "indeed-5.json").write_text('{"captured_at": "2026-09')

    now, since = at("2026-09-04 00:00:00"), at("2026-08-20 00:00:00")
    checked = capture.with_freshness(capture.read_files(spark, str(tmp_path)), now)
    assert rows_of(capture.file_counts(checked), "status", "files") == [
        ("no capture time", 1), ("too old", 1), ("unreadable", 1), ("usable", 2)]
    found = capture.read_captures(spark, str(tmp_path), since, now)
    # The newest copy of c is too old to be wanted, and must not let the older one back in.
    assert rows_of(found, "uid", "title") == [("indeed:a", "new a"), ("indeed:b", "old b"), ("indeed:e", "T e")]
    row = found.filter("source_id = 'a'").first()
    assert (row.url, row.location_restrictions) == ("https://s.example/viewjob?jk=a", ["Philippines"])


def card(link, body, inside=False):
    box = f'<div style="x" class="jobpost-cat-box wide">{"<a href=" + chr(34) + link + chr(34) + "></a>" if inside else ""}{body}</div>'
    return box if inside else f'<a href="{link}" style="y">{box}</a>'


PARTS = ('<h4 class="t">Data &amp; ETL <span class="badge full">Full Time</span></h4>'
         '<img src="l.png" class="jobpost-cat-box-logo" alt="Acme" />'
         '<p data-temp="2026-08-30 19:54:57" data-temp-2="2026-08-30 11:54:57"><em>x</em></p>'
         '<dl class="row fs-14"><dd class="col">$7&ndash;</dd></dl>'
         '<div class="desc fs-14">Join <div>us</div> today&#8230; <a href="/j">See More</a> </div><div>tail</div>')


def test_cards(spark):
    html = ("<html><nav><a href='/jobseekers/job/menu-1'>menu</a></nav>" + card("/jobseekers/job/data-etl-77?x=1", PARTS)
            + card("/jobseekers/job/in-88/", PARTS.replace("$7&ndash;", "$300").replace("Full Time", "Gig"), inside=True)
            + card("/jobseekers/job/no-stamp-99", PARTS.replace("data-temp-2", "data-other"))
            + card("/jobseekers/job/no-number", PARTS) + card("/jobseekers/job/x-5", PARTS.replace("Data &amp; ETL", " ")) + "</html>")
    frame = spark.createDataFrame([(1, html), (2, None), (3, "<html>no cards</html>")], "page int, html string")
    found = {r.source_id: r for r in cards.postings_from(cards.cards_of(frame, "page"), "b", "page", base_url="https://b").collect()}
    assert set(found) == {"77", "88"}
    first = found["77"]
    assert (first.title, first.company, first.categories) == ("Data & ETL", "Acme", ["Full Time"])
    assert first.url == "https://b/jobseekers/job/data-etl-77?x=1" and first.posted == dt.datetime(2026, 8, 30, 11, 54, 57)
    assert first.description == "Stated pay: $7–\n\nJoin us\n today…"
    assert (first.salary_max, first.salary_period, first.location_restrictions) == (7 * 2080, "annual", ["Philippines"])
    assert (found["88"].salary_max, found["88"].salary_period, found["88"].categories) == (None, None, ["Gig"])


CARD = "<div class='jobpost-cat-box'>%s</div>"


@pytest.mark.parametrize("page, field, value", [
    (CARD % """<img class=jobpost-cat-box-logo alt="Joe's Diner">""", "company", "Joe's Diner"),
    (CARD % "<img alt='T &eacute; &#xe9; &#233; &amp;amp;' class='x jobpost-cat-box-logo'>", "company", "T é é é &amp;"),
    (CARD % "<h4>A <b>b</b>c<i class='badge'>Gig <u>now</u></i> d</h4> e", "title", "A b c d"),
    (CARD % "<h4>A <i class='badge'>Gig <u>now</u></i> d</h4> e", "job_type", "Gig now"),
    (CARD % "<h4>A <i class='badges'>Gig</i></h4><b class='badge'>out</b>", "job_type", ""),
    ("<a href='/x-1'><p><b>" + CARD % "<a href='/jobseekers/job/y-2'></a>", "href", "/x-1"),
    ("<a href='/x-1'></a>" + CARD % "<a href='/other'></a><a href=/jobseekers/job/y-2>", "href", "/jobseekers/job/y-2"),
    ("<a>" + CARD % "<a href='/jobseekers/job/y-2'>", "href", ""),
    (CARD % "<!-- <h4>no</h4> --><script>var x = '<h4>no</h4>'</script><style>h4</style><h4>yes</h4>", "title", "yes"),
    (CARD % "<dd class=col>a<dd>b</dd>", "pay", "a"),
    (CARD % "<dd class=col>a</dd><dl class='row fs-14'><dd class='col'>b</dl>", "pay", "b"),
    (CARD % "<dl class='row'><dd class='col'>a</dl>", "pay", "a"),
    (CARD % "<p data-temp-2 = ' 2026-08-30 11:54:57 '>", "stamp", " 2026-08-30 11:54:57 "),
    (CARD % "<div class=desc>a<div>b</div>&eacute; &lt;i&gt; <br/>c</div>d", "teaser", "a<div>b</div>é &lt;i&gt; <br/>c"),
    (CARD % "<div class=desc>never closed <b>x", "teaser", "never closed <b>x"),
    ("<DIV CLASS=JOBPOST-CAT-BOX></DIV>" + CARD % "<H4>up</H4>", "title", "up"),
    (CARD % "<h4>1 < 2 & 3 > 2</h4>", "title", "1 < 2 & 3 > 2"),
    (CARD % "<h4>x</h4" + "<", "title", "x <"),
])
def test_card_markup(page, field, value):
    assert [c[field] for c in markup.cards(page)] == [value]


def test_pages_without_an_end_are_read_in_linear_time():
    start = "<div class='jobpost-cat-box'><h4>"
    for rest in ('<a "' * 50_000, "<!--" * 50_000, "<b>" * 50_000 + "</i>" * 50_000, "<" * 100_000, "<a x=" * 50_000, "<a x='>" * 50_000):
        begin = time.monotonic()
        assert len(markup.cards(start + rest)) == 1
        assert time.monotonic() - begin < 5


@pytest.mark.parametrize("html, body", [
    ('<div id="job-description"><p>All <div>of</div> it</p></div><div>not this</div>', "All of\n it"),
    ("<section class='a job-description b'>text</section>", "text"),
    ('<div class="job-description"> </div>', None),
    ('<div class="my-job-descriptions">x</div>', None),
    ('<div id="job-description">never closed <b>x</b>', "never closed x"),
    ("<p>none</p>", None), ("", None), (None, None),
])
def test_detail_body(spark, html, body):
    assert spark.createDataFrame([(html,)], "h string").select(cards.detail_body(F.col("h"))).first()[0] == body


def ld(value):
    return f'<script type="application/ld+json">{value if isinstance(value, str) else json.dumps(value)}</script>'


POSTING = {"@type": "JobPosting", "title": "Eng", "hiringOrganization": {"name": "Acme"}, "datePosted": "2026-09-01",
           "description": "<p>Do</p>", "baseSalary": {"currency": "usd", "value": {"minValue": 10, "maxValue": "20.5", "unitText": "HOUR"}},
           "applicantLocationRequirements": {"@type": "Country", "name": "Kenya"}, "jobLocation": {"address": {"addressCountry": "KE"}}}


@pytest.mark.parametrize("html, expected", [
    (ld(POSTING), ("Eng", "Acme", 10, 20, "hourly", "USD", ["Kenya", "KE"])),
    (ld({"@graph": [{"@type": "WebSite"}, POSTING]}), ("Eng", "Acme", 10, 20, "hourly", "USD", ["Kenya", "KE"])),
    (ld([{"@type": ["A", "jobposting"], "title": "L"}]), ("L", "", None, None, None, None, [])),
    (ld("{bad") + ld({"a": [{"b": {"c": {"d": POSTING}}}]}), ("Eng", "Acme", 10, 20, "hourly", "USD", ["Kenya", "KE"])),
    (ld({"@type": "JobPosting", "baseSalary": {"currency": "EUR", "value": {"value": 5, "unitText": "WEEK"}}}),
     ("(untitled)", "", 5, 5, None, "EUR", [])),
    (ld({"@type": "JobPosting", "baseSalary": {"currency": "eur", "value": 5}}), ("(untitled)", "", None, None, None, "eur", [])),
    (ld({"@type": "Article"}), None), ("<p>x</p>", None),
])
def test_json_ld(spark, html, expected):
    frame = spark.createDataFrame([("u", html)], "url string, html string")
    found = pages.from_json_ld(frame, at("2026-09-04 00:00:00")).select(
        "title", "company", "salary_min", "salary_max", "salary_period", "currency", "location_restrictions").collect()
    assert [tuple(r) for r in found] == ([expected] if expected else [])


def test_pages_fall_back_to_their_text(spark):
    frame = spark.createDataFrame([
        ("u1", ld(POSTING)), ("u2", "<title> T </title><nav>menu</nav><p>Body</p><script>x()</script>"),
        ("u3", '<meta property="og:title" content="OG"><title>T</title><p>B</p>'), ("u4", "<p>First line</p>second"),
        ("u5", "<title>Just a moment...</title>")], "url string, html string")
    found = pages.from_pages(frame, at("2026-09-04 00:00:00"))
    assert rows_of(found, "url", "title") == [("u1", "Eng"), ("u2", "T"), ("u3", "OG"), ("u4", "First line")]


def test_walk_and_selection(spark):
    day = dt.datetime
    rows = [("a", 1, day(2026, 9, 3)), ("a", 1, day(2026, 8, 1)), ("a", 2, day(2026, 8, 1)), ("a", 3, day(2026, 9, 3)),
            ("b", 1, day(2026, 9, 3)), ("b", 2, day(2026, 9, 2)), ("b", 3, day(2026, 9, 2)), ("c", 1, day(2026, 9, 3)),
            ("c", 3, day(2026, 9, 3))]
    frame = spark.createDataFrame(rows, "source string, page_no int, posted timestamp")
    since = at("2026-09-01 00:00:00")
    assert rows_of(boards.walk(frame, since, 2), "source", "page_no") == [("a", 1), ("b", 1), ("b", 2), ("c", 1)]
    assert rows_of(boards.walk_ends(frame, since, 2), "source", "pages", "hit_page_cap") == [
        ("a", 2, False), ("b", 2, True), ("c", 1, False)]
    with pytest.raises(ValueError, match="no source named 'zz'"):
        boards.only_source(frame, "zz", ["a", "b"])
    with pytest.raises(ValueError, match="no source named 'zz'"):
        boards.read_board(spark, "zz", "/nowhere", since, since)


def test_capabilities_default(spark):
    rows = boards.with_capabilities(
        spark.createDataFrame([("machinery",), ("building",), ("other",)], "source string"), sample.capabilities(spark))
    assert rows_of(rows, "source", "regions_authoritative", "salary_authoritative", "publishes_expiry") == [
        ("building", False, True, False), ("machinery", True, True, False), ("other", True, True, False)]


def feed_folder(tmp_path):
    def item(n):
        return {**ITEM, "guid": f"g{n}"}

    folder = tmp_path / "feed"
    (folder / "sub").mkdir(parents=True)
    (folder / "p1.json").write_text(json.dumps({"jobs": [item(1), item(2)]}, indent=2))
    (folder / "p2.json").write_text("\n".join(json.dumps({"jobs": [item(n)]}) for n in (3, 4)) + "\n\n")
    (folder / "p3.json").write_text(json.dumps({"jobs": [item(5)]}, indent=2)[:-30])
    (folder / "p4.json").write_text(" \n")
    (folder / "sub" / "p5.json").write_text(json.dumps({"jobs": [item(6)]}))
    return str(folder)


def test_feed_pages_over_many_lines_arrive_in_order(spark, tmp_path):
    path = feed_folder(tmp_path)
    want = [(0, "g1"), (1, "g2"), (2, "g3"), (3, "g4"), (4, "g6")]
    for size in ("2k", "128m"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        assert rows_of(feed.read_feed(spark, path), "arrival", "source_id") == want
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    states = {r.file.rsplit("/", 1)[1]: r.state for r in feed.file_states(spark, path).collect()}
    assert states == {"p1.json": "read", "p2.json": "read", "p3.json": "bad", "p4.json": "empty", "p5.json": "read"}


def test_boards_that_fail_do_not_cost_the_others(spark, tmp_path):
    (tmp_path / "caps").mkdir()
    (tmp_path / "caps" / "indeed-1.json").write_text("{broken")
    inputs = [("indeed", str(tmp_path / "caps")), ("himalayas", feed_folder(tmp_path)), ("onlinejobs", str(tmp_path / "nowhere")), ("zz", "x")]
    rows, status = boards.read_boards(spark, inputs, at("2026-08-20 00:00:00"), at("2026-09-04 00:00:00"))
    assert rows_of(rows, "arrival", "source_id") == [(0, "g1"), (1, "g2"), (2, "g3"), (3, "g4"), (4, "g6")]
    told = {r.source: r for r in status.collect()}
    assert {b: r.ok for b, r in told.items()} == {"indeed": False, "himalayas": True, "onlinejobs": False, "zz": False}
    feeds = told["himalayas"]
    assert (feeds.files, feeds.read, feeds.bad, feeds.empty, feeds.error) == (5, 3, 1, 1, "1 of 5 files bad")
    assert "nowhere" in told["onlinejobs"].error and "no source named" in told["zz"].error
    assert boards.run_ok(status).first().ok
    nothing, status = boards.read_boards(spark, [("zz", "x")], at("2026-08-20 00:00:00"), at("2026-09-04 00:00:00"))
    assert nothing.count() == 0 and not boards.run_ok(status).first().ok


def test_saved_result_pages_are_read_whole(spark, tmp_path):
    for n in (2, 1):
        page = "<html>\n" + card(f"/jobseekers/job/a-{n}0", PARTS.replace("><", ">\n<")) + "\n" + card(f"/jobseekers/job/b-{n}1", PARTS) + "</html>"
        (tmp_path / f"page{n}.html").write_text(page)
    (tmp_path / "page3.html").write_text("<html>changed</html>")
    rows, status = boards.read_boards(spark, [("onlinejobs", str(tmp_path))], at("2026-08-20 00:00:00"), at("2026-09-04 00:00:00"))
    assert rows_of(rows, "arrival", "source_id") == [(0, "10"), (1, "11"), (2, "20"), (3, "21")]
    assert rows_of(status, "files", "read", "bad", "ok") == [(3, 2, 1, True)]
