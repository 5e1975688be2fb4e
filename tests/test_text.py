"""Text, advert, time and region functions on hand-made cases."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from postfunnel.functions import adverts, dates, regions, text


def values(spark, cases, column, kind="string"):
    rows = spark.createDataFrame([(n, c) for n, c in enumerate(cases)], f"n int, x {kind}").repartition(3)
    return [r.y for r in rows.select("n", column.alias("y")).orderBy("n").collect()]


def test_strip_html(spark):
    cases = {
        "<p>One</p><p>Two</p>": "One\nTwo",
        "a<br/>b<BR>c": "a\nb\nc",
        "x &amp; y &lt;z&gt; &quot;q&quot; &#39;s&#39; &nbsp;end": "x & y <z> \"q\" 's' end",
        "caf&#233; &#8230; &#128512;": "café … 😀",
        "&#99999999999; &#55296; &#x41;": "&#99999999999; &#55296; &#x41;",
        "<div>a</div>\n\n\n <div>b</div>": "a\n\nb",
        "tab\there  and there": "tab here and there",
        None: "",
        "": "",
        "&#&#65;": "&#A",
    }
    found = values(spark, list(cases), text.strip_html(F.col("x")))
    # Block ends leave the blank of the next open tag behind the line break.
    assert [f.replace("\n ", "\n") for f in found] == list(cases.values())


def test_clip_keeps_both_ends(spark):
    short, long = "a" * 1200, "h" * 800 + "m" * 500 + "t" * 400
    assert values(spark, [short, long, None], text.clip(F.col("x"))) == [
        short, "h" * 800 + "\n[...]\n" + "t" * 400, ""]


def test_file_slug(spark):
    found = values(spark, ["a:b", "a-b", "::", "x" * 200], text.file_slug(F.col("x")))
    assert found[0].startswith("a-b-") and found[1].startswith("a-b-") and found[0] != found[1]
    assert found[2].startswith("job-") and len(found[3]) == 89


def test_region_label(spark):
    cases = {"[]": "worldwide", None: "worldwide", "": "worldwide", '["A"]': "A", '["A","B","C","D"]': "A, B, C +1",
             "[broken": None, '{"a": 1}': "worldwide", "5": "worldwide"}
    assert values(spark, list(cases), text.region_label(F.col("x"))) == list(cases.values())


def test_web_links(spark):
    cases = {"https://a.b/c": True, "HTTP://a.b": True, "javascript:alert(1)": False, "nothing": False, None: False}
    assert values(spark, list(cases), text.is_web_link(F.col("x"))) == list(cases.values())


def test_scrub_links(spark):
    found = values(spark, ["<p>See https://x.y/z?a=1 or www.foo.bar now</p>"], text.scrub_links(F.col("x")))
    assert found == ["See or now"]


@pytest.mark.parametrize("body, asked", [
    ("Kindly include a cover letter.", True),
    ("Resume plus covering letter please", True),
    ("A letter of motivation is welcome", True),
    ("Write a letter  of\ninterest", True),
    ("No cover letter, thanks", False),
    ("You do not need to add a cover letter", False),
    ("Portfolio rather than a cover letter", False),
    ("cover letters are not needed", False),
    ("Cover letter optional", False),
    ("A cover letter isn't required", False),
    ("We are not a bank. Send a cover letter.", True),
    ("No cover letter. But do send a motivation letter!", True),
    ("Anyone without a cover letter is ignored", False),  # known miss: a double negative
    ("Great team", False),
    ("   ", False),
    (None, False),
    # 60 characters of the same clause reach, 61 do not.
    ("no " + "x" * 58 + " cover letter", False),
    ("no " + "x" * 59 + " cover letter", True),
    ("cover letter " + "x" * 58 + " optional", False),
    ("cover letters " + "x" * 60 + " optional", True),
])
def test_asks_for_letter(spark, body, asked):
    assert values(spark, [body], adverts.asks_for_letter(F.col("x"))) == [asked]


@pytest.mark.parametrize("body, asked", [
    ("cover letter not" + " " * 9 + "required", False),
    ("cover letter is" + "\n" * 40 + "not needed", False),
    ("cover letter is" + " " * 80 + "not needed", True),  # beyond the window of 80 characters
    ("Portfolio rather" + " " * 9 + "than a cover letter", False),
    ("Portfolio rather" + " " * 50 + "than a cover letter", False),
    ("Portfolio rather" + " " * 80 + "than a cover letter", True),
    ("No cover" + " " * 12 + "letter of application", False),
    ("\U0001F600" * 90 + " send a cover letter", True),
    ("no \U0001F600" + "\U0001F600" * 50 + " cover letter", False),
    ("No cover letter, no cover letter. " + "x" * 100 + " covering letter", True),
])
def test_asks_for_letter_with_long_blanks(spark, body, asked):
    assert values(spark, [body], adverts.asks_for_letter(F.col("x"))) == [asked]


def test_eligibility_sentences(spark):
    advert = ("Great job. You MUST be located in Peru! Perks: tea.\nWe   cannot sponsor visas. "
              "you must be located in peru! Only hire locals? Right to work. Residents of X, eligible to work.")
    found = values(spark, [advert, "Nothing here", None], adverts.eligibility_sentences(F.col("x")))
    assert found[0] == ["You MUST be located in Peru!", "We cannot sponsor visas.", "Only hire locals?", "Right to work."]
    assert found[1:] == [[], []]


def test_eligibility_needs_no_punctuation(spark):
    long = "word " * 50_000 + "must reside here"
    found = values(spark, [long], adverts.eligibility_sentences(F.col("x")))
    assert found[0][0].endswith("must reside here")


def test_times(spark):
    utc = dt.datetime
    cases = {"2026-09-02T09:12:44.117Z": utc(2026, 9, 2, 9, 12, 44, 117000), "2026-09-02": utc(2026, 9, 2),
             "2026-09-02T10:00:00+02:00": utc(2026, 9, 2, 8), "2026-09-02T10:00:00+0200": utc(2026, 9, 2, 8),
             "2026": None, "soon": None, "": None, None: None, "2026-02-30": None}
    found = values(spark, list(cases), F.date_format(dates.iso_time(F.col("x")), "yyyy-MM-dd HH:mm:ss.SSS"))
    assert found == [c and c.strftime("%Y-%m-%d %H:%M:%S.") + f"{c.microsecond // 1000:03d}" for c in cases.values()]
    shown = F.date_format(dates.epoch_seconds(F.col("x")), "yyyy-MM-dd")
    assert values(spark, ["86400", "0", "", "x", None, "86400.7", "99999999999999"], shown) == [
        "1970-01-02", None, None, None, None, "1970-01-02", None]
    assert values(spark, ["86400000"], F.date_format(dates.epoch_millis(F.col("x")), "yyyy-MM-dd")) == ["1970-01-02"]


@pytest.mark.parametrize("window", [0, 7, 21, None])
def test_staleness_in_two_forms(spark, window):
    """Whole elapsed days above the window, and elapsed time from window + 1 on."""
    now = dt.datetime(2026, 9, 4, 12)
    ages = [0, 0.5, 0.999, 1, 6.99, 7, 7.99, 8, 21, 21.99, 22, 400]
    posted = [str(now - dt.timedelta(days=a)) for a in ages]
    stale = dates.is_stale(F.col("x").cast("timestamp"), F.lit(window).cast("int"), F.lit(str(now)).cast("timestamp"))
    found = values(spark, posted + [None], stale)
    assert found == [window is not None and int(a) > window for a in ages] + [False]


def test_regions(spark):
    allowed = regions.region_allowed(F.col("x"), ["Kenya", "EMEA region"], ["Kenya South"])
    cases = {"KENYA": True, "kenya (nairobi)": True, "Kenya South": False, "emea": True, "France": False, " ": True, "": True}
    assert values(spark, list(cases), allowed) == list(cases.values())
    local = regions.all_local(F.col("x"), ["Kenya"])
    assert values(spark, [["Kenya"], ["Kenya", "France"], []], local, "array<string>") == [True, False, False]
    assert values(spark, ["ph", " US ", "DE", None], regions.country_regions(F.col("x"))) == [
        ["Philippines"], ["United States"], [], []]
    assert values(spark, [["8", "x", None, "-5"], None], regions.offsets(F.col("x")), "array<string>") == [[8, -5], []]
    assert values(spark, ["2026-09-01T09:12:44.1234567Z", "2026-09-01 09:12:44,123456789"],
                  F.unix_micros(dates.iso_time(F.col("x"))) % 1_000_000) == [123456, 123456]


def test_lists_of_patterns(spark):
    cases = ["Senior Intern", "sales intern", "dev"]
    assert values(spark, cases, regions.first_pattern(F.col("x"), ["sales", "intern"])) == ["intern", "sales", None]
    assert values(spark, cases, regions.first_match(F.col("x"), [r"\bint\w+"])) == ["Intern", "intern", None]
    assert values(spark, cases, regions.first_pattern(F.col("x"), [])) == [None, None, None]
    names = regions.first_name_in(F.col("x"), ["Strasse", "Acme"])
    assert values(spark, ["ACME Straße", "acme", "", None], names) == ["Strasse", "Acme", None, None]
