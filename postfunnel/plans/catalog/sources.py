"""Readers and what surrounds them, over views shaped like the boards' data."""

from __future__ import annotations

from pyspark.sql import functions as F

from postfunnel import policy as policies
from postfunnel.functions import jsonld
from postfunnel.functions.regions import named
from postfunnel.plans import sample, views
from postfunnel.plans.catalog import query
from postfunnel.plans.catalog.duck import NOW, html_text, sql, strip
from postfunnel.plans.catalog.text import PAID, PAY_STEPS, STRUCTURED
from postfunnel.schema import FEED_PAGE
from postfunnel.session import shared_dir
from postfunnel.sources import boards, capture, cards, feed, files, pages
from postfunnel import vocab


def feed_items(spark, d):
    """The feed view as the JSON a board sends, read back with its schema."""
    f = views.view(spark, d, "feed")
    zones = F.array(F.lit("8"), F.lit("junk"), F.lit("-5"))
    item = F.struct(
        F.col("guid"), F.col("link").alias("applicationLink"), "title", F.col("company").alias("companyName"),
        F.col("html").alias("excerpt"), F.col("html").alias("description"), F.col("pub_date").alias("pubDate"),
        F.col("pub_date").alias("expiryDate"),
        F.when(~F.col("anywhere"), F.transform("places", lambda p: F.concat(F.lit(" "), p))).alias("locationRestrictions"),
        zones.alias("timezoneRestrictions"), F.col("salary_max").alias("minSalary"), F.col("salary_max").alias("maxSalary"),
        F.col("salary_period").alias("salaryPeriod"), "currency", F.array("category").alias("categories"),
    )
    page = F.concat(F.lit('{"jobs":['), F.to_json(item), F.lit("]}"))
    return feed.items_of(f.select("arrival", F.from_json(page, FEED_PAGE).alias("_page")).select("arrival", "_page.*"), "arrival")


@query("s01_feed_postings", sql("""
    SELECT 'feed:' || coalesce(nullif(guid, ''), link) AS uid, trim(title) AS title, trim(coalesce(company, '')) AS company,
      coalesce(link, guid) AS url, strftime(make_timestamp(CAST(pub_date AS BIGINT) * 1000000), '%Y-%m-%d %H:%M:%S') AS posted,
      'Pay & terms: ' || title || chr(10) || chr(10) || 'one' || chr(10) || ' two …' AS raw_text,
      CASE WHEN anywhere THEN '' ELSE array_to_string(places, ',') END AS places,
      '8,-5' AS zones, nullif(salary_max, 0) AS salary_max, salary_period, currency, category
    FROM (SELECT * REPLACE (title AS title), trim(title) AS t FROM feed)
    WHERE coalesce(nullif(guid, ''), link) IS NOT NULL AND trim(title) <> '' AND nullif(try_cast(pub_date AS BIGINT), 0) IS NOT NULL
    """, "feed").replace("|| title ||", "|| trim(title) ||"))
def feed_postings(spark, d):
    rows = feed.postings_from(feed_items(spark, d), "feed", "arrival")
    return rows.select(
        "uid", "title", "company", "url", sample.stamp("posted").alias("posted"), F.col("description").alias("raw_text"),
        sample.joined("location_restrictions").alias("places"), sample.joined("timezone_restrictions").alias("zones"),
        "salary_max", "salary_period", "currency", F.element_at("categories", 1).alias("category"))


def capture_files(spark, d):
    """Each advert's copies as small capture files of their own."""
    c = views.view(spark, d, "captures")
    row = F.struct("jobkey", "title", "company", "country", "pub_date", "expired", "salary_text", "salary_period",
                   "salary_min", "salary_max", F.lit(None).cast("string").alias("url"), "date_posted",
                   F.lit("2001-12-31").alias("valid_through"), F.lit("<p>Hello</p>").alias("description"))
    when = F.when(F.col("arrival") % 50 != 49, F.col("captured_at"))
    return c.select(F.concat_ws("/", "site", F.col("copy_no").cast("string")).alias("path"),
                    when.alias("captured_at"), "site", F.array(row).alias("results"))


def captures(spark, d):
    return capture.rows_of(capture.with_freshness(capture_files(spark, d), sample.now()))


_COPY = f"""
  SELECT *, 'cap:' || jobkey AS uid, CAST(replace(captured_at, 'Z', '') AS TIMESTAMP) AS taken,
    coalesce(try_cast(replace(date_posted, 'Z', '') AS TIMESTAMP), make_timestamp(CAST(pub_date AS BIGINT) * 1000)) AS posted,
    {STRUCTURED}
  FROM captures WHERE arrival % 50 <> 49"""
_FRESH = "date_diff('microsecond', taken, {now}) <= CAST(14 AS BIGINT) * 86400000000".format(now=NOW)
_USABLE = f"{_FRESH} AND NOT expired AND posted IS NOT NULL"
_COPY_COLUMNS = f"""uid, copy_no, title, coalesce(company, '') AS company, 'https://' || site || '/viewjob?jk=' || jobkey AS url,
  strftime(posted, '%Y-%m-%d %H:%M:%S') AS posted,
  CASE upper(trim(country)) WHEN 'PH' THEN 'Philippines' WHEN 'US' THEN 'United States' ELSE '' END AS places,
  CASE WHEN {PAID} AND salary_min <> 0 THEN CAST(round_even(salary_min * rate, 0) AS BIGINT) END AS salary_min,
  CASE WHEN {PAID} THEN CAST(round_even(salary_max * rate, 0) AS BIGINT) END AS salary_max,
  CASE WHEN {PAID} THEN per END AS salary_period"""


def _copies(rows):
    return rows.select(
        "uid", F.element_at(F.split("path", "/"), 2).cast("int").alias("copy_no"), "title", "company", "url",
        sample.stamp("posted").alias("posted"), sample.joined("location_restrictions").alias("places"),
        "salary_min", "salary_max", "salary_period")


@query("s02_capture_postings", sql(f"SELECT {_COPY_COLUMNS} FROM ({_COPY}) WHERE {_USABLE}", "captures"))
def capture_postings(spark, d):
    return _copies(capture.postings_from(captures(spark, d), "cap", "path", "taken", "pos"))


@query("s03_capture_freshness", sql(f"""
    SELECT CASE WHEN arrival % 50 = 49 THEN 'no capture time'
      WHEN date_diff('microsecond', CAST(replace(captured_at, 'Z', '') AS TIMESTAMP), {NOW}) > CAST(14 AS BIGINT) * 86400000000 THEN 'too old'
      ELSE 'usable' END AS status, count(*) AS files
    FROM captures GROUP BY 1""", "captures"))
def capture_freshness(spark, d):
    return capture.file_counts(capture.with_freshness(capture_files(spark, d), sample.now()))


@query("s04_newest_copies", sql(f"""
    SELECT {_COPY_COLUMNS} FROM (SELECT *, row_number() OVER (PARTITION BY uid ORDER BY taken DESC, site || '/' || copy_no) AS n
      FROM ({_COPY}) WHERE {_USABLE})
    WHERE n = 1 AND posted >= TIMESTAMP '1998-02-01'""", "captures"))
def newest_copies(spark, d):
    since = F.to_timestamp(F.lit("1998-02-01 00:00:00"))
    return _copies(capture.fetch(captures(spark, d), since, "cap"))


@query("s05_card_postings", sql("""
    SELECT 'cards:' || arrival AS uid, title, coalesce(company, '') AS company,
      'https://base.example.com/jobseekers/job/' || replace(title, ' ', '-') || '-' || arrival || '?x=1' AS url,
      strftime(day, '%Y-%m-%d') || ' 12:30:00' AS posted, job_type,
      CASE WHEN p = '' THEN '' ELSE 'Stated pay: ' || p || chr(10) || chr(10) END
        || 'Join ' || source || ' now' || chr(10) || chr(10) || 'and grow…' AS description, 'Philippines' AS places
    FROM (SELECT c.*, p.source, p.posted AS day, regexp_replace(trim(coalesce(c.pay, '')), '\\s+', ' ', 'g') AS p
      FROM cards c JOIN postings p USING (arrival)) WHERE arrival % 15 <> 1""", "cards", "postings"))
def card_postings(spark, d):
    rows = cards.postings_from(cards.cards_of(views.view(spark, d, "cards"), "arrival"), "cards", "arrival",
                               base_url="https://base.example.com")
    kind = F.coalesce(F.try_element_at("categories", F.lit(1)), F.lit(""))
    return rows.select("uid", "title", "company", "url", sample.stamp("posted").alias("posted"), kind.alias("job_type"),
                       "description", sample.joined("location_restrictions").alias("places"))


@query("s05_card_pay", sql("", "cards", "pay_text").rstrip() + f""", {PAY_STEPS}
    SELECT arrival, CAST(round_even(list_min(ns) * f, 0) AS BIGINT) AS salary_min,
      CAST(round_even(list_max(ns) * f, 0) AS BIGINT) AS salary_max,
      CASE WHEN round_even(list_max(ns) * f, 0) <> 0 THEN 'annual' END AS salary_period
    FROM rated WHERE arrival % 15 <> 1""")
def card_pay(spark, d):
    rows = cards.postings_from(cards.cards_of(views.view(spark, d, "cards"), "arrival"), "cards", "arrival")
    return rows.select("arrival", "salary_min", "salary_max", "salary_period")


_ODD_CARD = """'<p data-temp-2="2001-01-02 03:04:05"><div class="other"><a href="/jobseekers/job/outer-' || source_id || '">'
  || '<!-- <div class="jobpost-cat-box"><h4>not this</h4></div> --><em><DIV data-x="a>b" class=''wide jobpost-cat-box''>'
  || '<img class=jobpost-cat-box-logo alt="' || coalesce(company, '') || '''s &eacute;t&#xe9; &amp; co" /><h4>' || title || ' &lt;' || source || '&gt;<b class="badge x">Full &mdash; time</b> now</h4>'
  || CASE WHEN arrival % 3 = 0 THEN '<dd class="col">first' ELSE '' END
  || '<span data-temp-2=''2001-02-03 04:05:06''></span><dl class="fs-14 row"><dd class="col">$' || (1 + arrival % 90) || ' &#x2F; hour<dd class="col">no</dl>'
  || '<section class="desc">A &lt;b&gt;, <p>two &rsquo;s &copy; <a href="/jobseekers/job/x-1">See More</a></section><div class="desc">other</div></div></em></a>'"""


@query("s05_card_markup", sql("""
    SELECT 'cards:' || source_id AS uid, title || ' <' || source || '> now' AS title, 'Full — time' AS job_type,
      coalesce(company, '') || '''s été & co' AS company, 'https://base.example.com/jobseekers/job/outer-' || source_id AS url,
      '2001-02-03 04:05:06' AS posted, '$' || (1 + arrival % 90) || ' / hour' AS pay,
      'Stated pay: $' || (1 + arrival % 90) || ' / hour' || chr(10) || chr(10) || 'A <b>, two ’s ©' AS description,
      CAST((1 + arrival % 90) * 2080 AS BIGINT) AS salary_max
    FROM postings WHERE arrival % 5 = 0""", "postings"))
def card_markup(spark, d):
    """Markup as a board may send it: either quotes, none, a link around, entities of all kinds, what is never closed."""
    page = F.concat(F.expr(_ODD_CARD), F.lit("<div>the end"))
    rows = views.view(spark, d, "postings").filter("arrival % 5 = 0").select("arrival", page.alias("html"))
    found = cards.postings_from(cards.cards_of(rows, "arrival"), "cards", "arrival", base_url="https://base.example.com")
    return found.select("uid", "title", F.element_at("categories", 1).alias("job_type"), "company", "url", sample.stamp("posted").alias("posted"),
                        F.col("salary_text").alias("pay"), "description", "salary_max")


def feed_files(spark, d):
    """The feed as files of pages: each seventh page is cut off, each second written over many lines."""
    root = shared_dir(spark, "feed-files")
    items = views.view(spark, d, "feed").filter("guid <> '' AND trim(title) <> '' AND pub_date NOT IN ('soon', '0')")
    item = F.struct("guid", "title", F.col("pub_date").alias("pubDate"))
    page = F.lpad(F.floor(F.col("arrival") / 500).cast("string"), 9, "0").alias("page")
    listed = items.groupBy(page).agg(F.array_sort(F.collect_list(F.struct("arrival", F.to_json(item).alias("json")))).alias("rows"))
    number = F.col("page").cast("long")
    lines = [F.array_join("rows.json", comma) for comma in (",", ",\n\n  ")]
    text = F.concat(F.lit('{"jobs": ['), F.when(number % 2 == 0, lines[1]).otherwise(lines[0]), F.lit("]}"))
    text = F.when(number % 7 == 3, F.substr(text, F.lit(1), F.length(text) - 9)).otherwise(text)
    listed.select("page", text.alias("value")).repartition("page").write.partitionBy("page").text(root)
    return root


_PAGED = "(SELECT *, CAST(floor(arrival / 500) AS BIGINT) AS page FROM feed WHERE guid <> '' AND trim(title) <> '' AND pub_date NOT IN ('soon', '0'))"


@query("s01_feed_files", sql(f"""
    SELECT '{vocab.BOARD_FEED}:' || guid AS uid, row_number() OVER (ORDER BY arrival) - 1 AS arrival FROM {_PAGED} WHERE page % 7 <> 3""", "feed"))
def feed_file_postings(spark, d):
    """Read from files of one line and of many; the arrival follows files and places in them."""
    return feed.read_feed(spark, feed_files(spark, d)).select("uid", "arrival")


@query("s15_file_states", sql(f"""
    SELECT '{vocab.BOARD_FEED}' AS source, count(DISTINCT page) AS files, count(DISTINCT page) FILTER (WHERE page % 7 <> 3) AS read,
      count(DISTINCT page) FILTER (WHERE page % 7 = 3) AS bad, CAST(0 AS BIGINT) AS empty, true AS ok FROM {_PAGED}""", "feed"))
def file_states(spark, d):
    found = feed.file_states(spark, feed_files(spark, d)).withColumn("source", F.lit(vocab.BOARD_FEED))
    return files.board_states(found)


_LD = """CASE page_id % 6
  WHEN 0 THEN '<script type="application/ld+json">{"@type": "JobPosting", "title": " T' || page_id || ' ", "hiringOrganization": {"name": "Org ' || page_id || '"}, "datePosted": "2001-03-04", "validThrough": "2001-05-06T07:08:09Z", "description": "<p>Do it</p>", "baseSalary": {"currency": "usd", "value": {"minValue": "1,' || (100 + page_id % 900) || '", "maxValue": 5000.7, "unitText": "MONTH"}}, "jobLocation": [{"address": {"addressCountry": "PH"}}, {"name": "Cebu"}]}</script>'
  WHEN 1 THEN '<script type="application/ld+json">{broken</script><script type=''application/ld+json''>{"@graph": [{"@type": "WebPage", "name": "x"}, {"@type": ["Thing", "jobPosting"], "title": "G' || page_id || '", "applicantLocationRequirements": [{"@type": "Country", "name": "Kenya"}, {"name": "Kenya"}], "baseSalary": {"salaryCurrency": "EUR", "value": {"value": 30, "unitText": "DAY"}}}]}</script>'
  WHEN 2 THEN '<script type="application/ld+json">[{"@type": "Organization"}, {"a": {"b": {"c": {"d": {"@type": "JOBPOSTING", "hiringOrganization": ["A", {"name": "B"}], "baseSalary": 5}}}}}]</script>'
  WHEN 3 THEN '<script type="application/ld+json">{"@type": "Article"}</script>'
  ELSE '' END"""


def ld_pages(spark, d):
    return views.view(spark, d, "pages").select("page_id", "url", F.concat("html", F.expr(_LD)).alias("html"))


@query("s06_json_ld_postings", sql(f"""
    SELECT 'manual:' || url AS uid, CASE page_id % 6 WHEN 0 THEN 'T' || page_id WHEN 1 THEN 'G' || page_id ELSE '(untitled)' END AS title,
      CASE page_id % 6 WHEN 0 THEN 'Org ' || page_id WHEN 1 THEN '' ELSE 'A, B' END AS company,
      CASE page_id % 6 WHEN 0 THEN '2001-03-04 00:00:00' ELSE strftime({NOW}, '%Y-%m-%d %H:%M:%S') END AS posted,
      CASE page_id % 6 WHEN 0 THEN '2001-05-06 07:08:09' END AS expires,
      CASE page_id % 6 WHEN 0 THEN 'Do it' ELSE '' END AS description,
      CASE page_id % 6 WHEN 0 THEN 'PH|Cebu' WHEN 1 THEN 'Kenya' ELSE '' END AS places,
      CASE page_id % 6 WHEN 0 THEN 1000 + 100 + page_id % 900 WHEN 1 THEN 30 END AS salary_min,
      CASE page_id % 6 WHEN 0 THEN 5000 WHEN 1 THEN 30 END AS salary_max,
      CASE page_id % 6 WHEN 0 THEN 'monthly' END AS salary_period,
      CASE page_id % 6 WHEN 0 THEN 'USD' WHEN 1 THEN 'EUR' END AS currency
    FROM pages WHERE page_id % 6 < 3"""))
def json_ld_postings(spark, d):
    rows = pages.from_json_ld(ld_pages(spark, d), sample.now())
    return rows.select(
        "uid", "title", "company", sample.stamp("posted").alias("posted"), sample.stamp("expires").alias("expires"),
        "description", sample.joined("location_restrictions", "|").alias("places"),
        "salary_min", "salary_max", "salary_period", "currency")


@query("f24_json_ld_regions", sql("""
    SELECT page_id, CASE page_id % 6 WHEN 0 THEN 'PH|Cebu' WHEN 1 THEN 'Kenya' ELSE '' END AS places
    FROM pages WHERE page_id % 6 < 3"""))
def json_ld_regions(spark, d):
    rows = ld_pages(spark, d).filter(F.col("html").rlike("(?i)jobposting"))
    return jsonld.with_posting(rows).select("page_id", sample.joined("p.regions", "|").alias("places"))


@query("f37_json_ld_pay", sql("""
    SELECT page_id, CASE page_id % 6 WHEN 0 THEN 1100 + page_id % 900 WHEN 1 THEN 30 END AS low,
      CASE page_id % 6 WHEN 0 THEN 5000 WHEN 1 THEN 30 END AS high,
      CASE page_id % 6 WHEN 0 THEN 'monthly' END AS period, CASE page_id % 6 WHEN 0 THEN 'USD' WHEN 1 THEN 'EUR' END AS currency
    FROM pages WHERE page_id % 6 < 3"""))
def json_ld_pay(spark, d):
    rows = ld_pages(spark, d).filter(F.col("html").rlike("(?i)jobposting"))
    found = jsonld.with_posting(rows)
    return found.select("page_id", F.col("p.salary_min").alias("low"), F.col("p.salary_max").alias("high"),
                        named(vocab.JSONLD_UNITS, F.col("p.unit")).alias("period"), "p.currency")


def _page_text(x: str) -> str:
    for tag in ("script", "style", "nav", "header", "footer"):
        x = f"regexp_replace({x}, '(?is)<{tag}[^>]*>.*?</{tag}>', ' ', 'g')"
    return html_text(x)


@query("s07_plain_pages", sql(f"""
    SELECT 'manual:' || url AS uid, coalesce(nullif({strip(r"regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)")}, ''), '(untitled)') AS title,
      length(t) AS n_chars, md5(t) AS digest, md5(substring(t, 1, 280)) AS short
    FROM (SELECT *, {_page_text("html")} AS t FROM pages)"""))
def plain_pages(spark, d):
    rows = pages.from_plain_pages(views.view(spark, d, "pages"), sample.now())
    return rows.select("uid", "title", F.length("description").cast("bigint").alias("n_chars"),
                       F.md5("description").alias("digest"), F.md5("excerpt").alias("short"))


@query("s08_pasted_text", sql(rf"""
    SELECT doc_id, coalesce(substring(list_filter(list_transform(regexp_split_to_array(t, '[\n\r\x0B\f]'),
        lambda x: {strip('x')}), lambda x: x <> '')[1], 1, 120), '(untitled)') AS title,
      substring(t, 1, 280) AS excerpt, length(t) AS n_chars
    FROM (SELECT doc_id, {strip('CASE WHEN doc_id % 50 = 0 THEN repeat(chr(10), 3) ELSE text END')} AS t FROM documents)"""))
def pasted_text(spark, d):
    body = F.when(F.col("doc_id") % 50 == 0, F.lit("\n\n\n")).otherwise(F.col("text"))
    rows = views.view(spark, d, "documents").select(F.col("doc_id").cast("string").alias("url"), body.alias("body"))
    return pages.from_text(rows, sample.now()).select(
        F.col("source_id").cast("bigint").alias("doc_id"), "title", "excerpt", F.length("description").cast("bigint").alias("n_chars"))


_CHALLENGE = """CASE page_id % 7 WHEN 0 THEN '<title>Just a Moment...</title>' || html
  WHEN 1 THEN html || repeat(' ', 4000) || 'security check' WHEN 2 THEN substring(html, 1, 3000) || 'Challenge-Platform' ELSE html END"""


@query("s09_challenge_pages", sql(f"""
    SELECT page_id, regexp_matches(lower(substring(h, 1, 4000)),
      'just a moment|cf-browser-verification|challenge-platform|enable javascript and cookies|security check') AS challenge
    FROM (SELECT page_id, {_CHALLENGE} AS h FROM pages)"""))
def challenge_pages(spark, d):
    rows = views.view(spark, d, "pages").select("page_id", F.expr(_CHALLENGE).alias("html"))
    return rows.select("page_id", pages.is_challenge(F.col("html")).alias("challenge"))


@query("s11_union_of_boards", sql("""
    SELECT source, coalesce(regions_authoritative, true) AS regions_authoritative, true AS salary_authoritative,
      coalesce(publishes_expiry, false) AS publishes_expiry, count(*) AS n, count(salary_max) AS paid
    FROM (SELECT source, salary_max FROM postings UNION ALL SELECT source, NULL FROM adverts) LEFT JOIN capabilities USING (source)
    GROUP BY ALL""", "postings", "adverts", "capabilities"))
def union_of_boards(spark, d):
    both = boards.union_boards([
        sample.postings(spark, d), views.view(spark, d, "adverts").select("arrival", "source", "uid", "description")])
    flags = list(vocab.CAPABILITY_DEFAULTS)
    rows = boards.with_capabilities(both, sample.capabilities(spark))
    return rows.groupBy("source", *flags).agg(F.count(F.lit(1)).alias("n"), F.count("salary_max").alias("paid"))


@query("s12_since_watermark", sql("SELECT uid FROM postings WHERE posted >= TIMESTAMP '2001-05-20 02:00:00'", "postings"))
def since_watermark(spark, d):
    return boards.since_watermark(sample.postings(spark, d), F.to_timestamp(F.lit("2001-05-20 02:00:00"))).select("uid")


_WALK = """
  SELECT *, coalesce(min(fresh) OVER (PARTITION BY source ORDER BY page_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true)
    AND row_number() OVER (PARTITION BY source ORDER BY page_no) = page_no AS reached
  FROM (SELECT source, page_no, bool_or(posted >= TIMESTAMP '{since}') AS fresh FROM page_walk {cut} GROUP BY ALL)"""


@query("s13_page_walk", sql(f"""
    SELECT w.uid FROM page_walk w JOIN ({_WALK.format(since='1999-11-11', cut='')}) p USING (source, page_no)
    WHERE p.reached AND w.posted >= TIMESTAMP '1999-11-11'""", "page_walk"))
def page_walk(spark, d):
    since = F.to_timestamp(F.lit("1999-11-11 00:00:00"))
    return boards.walk(views.view(spark, d, "page_walk"), since).select("uid")


@query("s13_walk_ends", sql(f"""
    SELECT source, CAST(max(page_no) AS INT) AS pages, bool_or(page_no = 40 AND fresh) AS hit_page_cap
    FROM ({_WALK.format(since='1999-05-20', cut='WHERE page_no <= 40')}) WHERE reached GROUP BY source""", "page_walk"))
def walk_ends(spark, d):
    since = F.to_timestamp(F.lit("1999-05-20 00:00:00"))
    return boards.walk_ends(views.view(spark, d, "page_walk"), since, vocab.CARDS_PAGE_CAP)


@query("s13_whole_walk", sql(f"""
    SELECT w.uid FROM page_walk w JOIN ({_WALK.format(since='1999-05-20', cut='')}) p USING (source, page_no)
    WHERE p.reached AND w.posted >= TIMESTAMP '1999-05-20'""", "page_walk"))
def whole_walk(spark, d):
    """A walk that goes past page 40, as nothing but the time ends it."""
    return boards.walk(views.view(spark, d, "page_walk"), F.to_timestamp(F.lit("1999-05-20 00:00:00"))).select("uid")


@query("s14_one_source", sql("SELECT uid FROM postings WHERE source = 'furniture'", "postings"))
def one_source(spark, d):
    return boards.only_source(sample.postings(spark, d), "furniture", sample.BOARDS).select("uid")


_BAD = "arrival % 13 = 0 OR source = 'household'"


@query("s15_source_status", sql(f"""
    SELECT source, count(*) FILTER (WHERE NOT ({_BAD})) AS rows, count(*) FILTER (WHERE {_BAD}) AS bad_rows,
      bool_or(NOT ({_BAD})) AS ok FROM postings GROUP BY source""", "postings"))
def source_status(spark, d):
    return boards.source_status(sample.postings(spark, d), F.expr(_BAD))


@query("s15_run_ok", sql(f"""
    SELECT bool_or(ok) AS ok, count(*) FILTER (WHERE NOT ok) AS failed_sources
    FROM (SELECT source, bool_or(NOT ({_BAD})) AS ok FROM postings GROUP BY source)""", "postings"))
def run_ok(spark, d):
    return boards.run_ok(source_status(spark, d))


@query("s16_policy_resolution", sql("""
    SELECT source, display_threshold, draft_at, CAST(coalesce(draft_if_asked_at, draft_at) AS INT) AS draft_if_asked_at, floor_hourly, max_age_days
    FROM (SELECT source, CAST(coalesce(display_threshold, 60) AS INT) AS display_threshold, draft_if_asked_at,
      CAST(coalesce(draft_at, display_threshold, 60) AS INT) AS draft_at, coalesce(floor_hourly, CAST(30 AS DOUBLE)) AS floor_hourly,
      CAST(coalesce(max_age_days, 21) AS INT) AS max_age_days FROM raw_policy)""", "raw_policy"))
def policy_resolution(spark, d):
    defaults = {"display_threshold": 60, "floor_hourly": 30.0, "max_age_days": 21}
    return policies.resolve_policies(views.view(spark, d, "raw_policy"), defaults)


@query("s16_unknown_kinds", sql("SELECT kind, count(*) AS n FROM raw_asks WHERE kind = 'made_up' GROUP BY kind", "raw_asks"))
def unknown_kinds(spark, d):
    return policies.unknown_kinds(views.view(spark, d, "raw_asks")).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query("s16_policy_violations", sql("""
    SELECT source, 'the floor is above the target' AS problem FROM raw_policy WHERE floor_hourly > 18
    UNION ALL SELECT source, 'an advert that asks for a letter needs a higher score than one that does not' FROM raw_policy
      WHERE draft_if_asked_at > coalesce(draft_at, 45)""", "raw_policy"))
def policy_violations(spark, d):
    raw = views.view(spark, d, "raw_policy").withColumn("draft_at", F.coalesce("draft_at", F.lit(45)))
    return policies.policy_violations(raw, 18.0)


@query("s16_overlapping_kinds", sql("""
    SELECT DISTINCT kind FROM raw_asks WHERE mandatory AND kind IN (SELECT kind FROM raw_asks WHERE NOT mandatory)""", "raw_asks"))
def overlapping_kinds(spark, d):
    asks = views.view(spark, d, "raw_asks")
    return policies.overlapping_kinds(asks.filter("mandatory"), asks.filter("NOT mandatory"))


@query("s17_missing_policies", sql("""
    SELECT DISTINCT source FROM adverts WHERE source NOT IN (SELECT source FROM policy)""", "adverts", "policy"))
def missing_policies(spark, d):
    return policies.missing_policies(views.view(spark, d, "adverts"), sample.profile().frame(spark))
