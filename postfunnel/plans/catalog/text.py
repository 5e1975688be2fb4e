"""Scalar functions over texts, times, pay and lists."""

from __future__ import annotations

from pyspark.sql import functions as F

from postfunnel import vocab
from postfunnel.functions import adverts, dates, money, regions, text
from postfunnel.operators import funnel
from postfunnel.plans import sample, views
from postfunnel.plans.catalog import query
from postfunnel.plans.catalog.duck import ANNUAL, NOW, SPACE, html_text, sql, squeeze, strip


def _md5(x: str) -> str:
    return f"md5({x})"


@query("f01_strip_html", sql(
    f"SELECT page_id, length(t) AS n_chars, md5(t) AS digest FROM (SELECT page_id, {html_text('html')} AS t FROM pages)"))
def strip_html(spark, d):
    pages = views.view(spark, d, "pages").select("page_id", text.strip_html(F.col("html")).alias("t"))
    return pages.select("page_id", F.length("t").cast("bigint").alias("n_chars"), F.md5("t").alias("digest"))


@query("f01_decimal_entities", sql("""
    SELECT doc_id, 'x' || substring(text, 1, 40) || ' … A ☃ 😀 &#99999999; &#x41; &#;' AS t
    FROM (SELECT doc_id, trim(regexp_replace(replace(replace(text, '<', ''), '&', ''), '[^a-z]+', '', 'g')) AS text FROM documents)"""))
def decimal_entities(spark, d):
    letters = F.regexp_replace("text", "[^a-z]+", "")
    raw = F.concat(F.lit("x"), F.substring(letters, 1, 40), F.lit(" &#8230; &#65; &#9731; &#128512; &#99999999; &#x41; &#;"))
    return views.view(spark, d, "documents").select("doc_id", text.strip_html(raw).alias("t"))


@query("f02_row_id", sql("SELECT o_orderkey, o_orderstatus || ':' || o_orderkey AS uid FROM orders"))
def row_id(spark, d):
    orders = views.view(spark, d, "orders")
    return orders.select("o_orderkey", text.row_id(F.col("o_orderstatus"), F.col("o_orderkey").cast("string")).alias("uid"))


@query("f03_clip", sql(f"""
    SELECT doc_id, CASE WHEN length(t) <= 1200 THEN t
      ELSE substring(t, 1, 800) || chr(10) || '[...]' || chr(10) || right(t, 400) END AS clipped
    FROM (SELECT doc_id, {strip('text')} AS t FROM documents)"""))
def clip(spark, d):
    return views.view(spark, d, "documents").select("doc_id", text.clip(F.col("text")).alias("clipped"))


@query("f04_excerpt", sql("SELECT doc_id, substring(text, 1, 600) AS long, substring(text, 1, 280) AS short FROM documents"))
def excerpt(spark, d):
    return views.view(spark, d, "documents").select(
        "doc_id", text.excerpt(F.col("text"), 600).alias("long"), text.excerpt(F.col("text"), 280).alias("short"))


@query("f05_teaser_and_pay", sql(f"""
    SELECT doc_id, md5(CASE WHEN lang = 'en' THEN {strip("'Stated pay: ' || source || chr(10) || chr(10) || t")} ELSE t END) AS digest
    FROM (SELECT doc_id, lang, source, {strip('text')} AS t FROM documents)"""))
def teaser_and_pay(spark, d):
    rows = views.view(spark, d, "documents")
    body = text.drop_teaser_tail(F.concat("text", F.lit("  See More \n")))
    pay = F.when(F.col("lang") == "en", F.col("source"))
    return rows.select("doc_id", F.md5(text.with_stated_pay(pay, body)).alias("digest"))


@query("f06_trailing_id", sql(r"""
    SELECT page_id, nullif(regexp_extract(split_part(replace(url, '/en/', '/en-'), '?', 1), '-([0-9]+)/?$', 1), '') AS id FROM pages"""))
def trailing_id(spark, d):
    href = F.replace(F.col("url"), F.lit("/en/"), F.lit("/en-"))
    return views.view(spark, d, "pages").select("page_id", text.trailing_id(href).alias("id"))


@query("f07_resolve_url", sql("""
    SELECT uid, CASE WHEN starts_with(url, '/') THEN 'https://base.example.com' || url ELSE url END AS resolved,
      CASE WHEN arrival % 3 = 0 THEN 'https://' || source || '/viewjob?jk=' || source_id ELSE url END AS canonical
    FROM postings""", "postings"))
def resolve_url(spark, d):
    given = F.when(F.col("arrival") % 3 != 0, F.col("url"))
    return sample.postings(spark, d).select(
        "uid", text.absolute_url(F.col("url"), "https://base.example.com").alias("resolved"),
        text.link_or_canonical(given, F.col("source"), F.col("source_id")).alias("canonical"))


_LINKS = """CASE page_id % 6 WHEN 0 THEN 'javascript:alert(1)' WHEN 1 THEN 'ftp://x.example.com/a'
  WHEN 2 THEN replace(url, 'http', 'HTTP') WHEN 3 THEN 'no link' ELSE url END"""


@query("f08_web_link", sql(
    f"SELECT page_id, regexp_matches(lower({_LINKS}), '^https?://') AS is_link FROM pages"))
def web_link(spark, d):
    return views.view(spark, d, "pages").select("page_id", text.is_web_link(F.expr(_LINKS)).alias("is_link"))


def _scrubbed(x: str) -> str:
    out = f"regexp_replace({x}, '(?i)<(br|/p|/li|/h[1-6]|/div)[^>]*>', chr(10), 'g')"
    out = f"regexp_replace({out}, '<[^>]*>', ' ', 'g')"
    out = f"regexp_replace({out}, '(?i)https?://[^{SPACE}]+', ' ', 'g')"
    out = rf"regexp_replace({out}, '(?i)\bwww\.[^{SPACE}]+', ' ', 'g')"
    out = f"replace(replace({out}, '&nbsp;', ' '), '&amp;', '&')"
    out = rf"regexp_replace({out}, '[ \t]+', ' ', 'g')"
    return strip(rf"regexp_replace({out}, '\n[{SPACE}]*\n[{SPACE}]*', chr(10)||chr(10), 'g')")


@query("f09_scrub_links", sql(
    f"""SELECT page_id, md5({_scrubbed("html || ' see ' || url || ' or www.Example.com/a?b=c&amp;d now'")}) AS digest FROM pages"""))
def scrub_links(spark, d):
    raw = F.concat("html", F.lit(" see "), "url", F.lit(" or www.Example.com/a?b=c&amp;d now"))
    return views.view(spark, d, "pages").select("page_id", F.md5(text.scrub_links(raw)).alias("digest"))


@query("f10_file_slug", sql(r"""
    SELECT page_id, coalesce(nullif(rtrim(substring(trim(regexp_replace(u, '[^A-Za-z0-9._-]+', '-', 'g'), '-._'), 1, 80), '-._'), ''), 'job')
      || '-' || substring(sha256(u), 1, 8) AS slug
    FROM (SELECT page_id, CASE WHEN page_id % 9 = 0 THEN '::' WHEN page_id % 9 = 1 THEN url || repeat('/x-', 30) ELSE 'board:' || url END AS u FROM pages)"""))
def file_slug(spark, d):
    uid = F.expr("CASE WHEN page_id % 9 = 0 THEN '::' WHEN page_id % 9 = 1 THEN url || repeat('/x-', 30) ELSE 'board:' || url END")
    return views.view(spark, d, "pages").select("page_id", text.file_slug(uid).alias("slug"))


@query("f12_repost_signature", sql("""
    SELECT sig_source, sig_title, sig_company, count(*) AS copies FROM (
      SELECT source AS sig_source, lower(trim(title)) AS sig_title, lower(trim(coalesce(company, ''))) AS sig_company FROM postings)
    GROUP BY ALL""", "postings"))
def repost_signature(spark, d):
    keys = text.repost_signature(F.col("source"), F.col("title"), F.col("company"))
    return sample.postings(spark, d).groupBy(*keys).agg(F.count(F.lit(1)).alias("copies"))


def _case(table: dict[str, str], key: str) -> str:
    quoted = {k: v.replace("'", "''") for k, v in table.items()}
    return f"CASE {key} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in quoted.items()) + f" ELSE {key} END"


@query("f13_phrases", sql(f"""
    SELECT uid, kind, {_case(vocab.REQUIREMENT_KINDS, 'kind')} || ', mystery' AS described,
      {_case(vocab.REQUIREMENT_LABELS, 'kind')} AS label
    FROM (SELECT DISTINCT uid, kind FROM raw_asks)""", "raw_asks"))
def phrases(spark, d):
    rows = views.view(spark, d, "raw_asks").select("uid", "kind").distinct()
    return rows.select(
        "uid", "kind", text.describe(F.array("kind", F.lit("mystery"))).alias("described"),
        F.element_at(text.phrases(F.array("kind")), 1).alias("label"))


_REGIONS_JSON = """CASE arrival % 8 WHEN 0 THEN '[]' WHEN 1 THEN '["' || source || '"]'
  WHEN 2 THEN '["' || source || '","b"]' WHEN 3 THEN '["' || source || '","b","c","d","e"]'
  WHEN 4 THEN NULL WHEN 5 THEN '' WHEN 6 THEN '["broken' ELSE '["a","' || source || '","c"]' END"""


@query("f14_region_label", sql("""
    SELECT uid, CASE WHEN arrival % 8 IN (0, 4, 5) THEN 'worldwide' WHEN arrival % 8 = 1 THEN source
      WHEN arrival % 8 = 2 THEN source || ', b' WHEN arrival % 8 = 3 THEN source || ', b, c +2'
      WHEN arrival % 8 = 7 THEN 'a, ' || source || ', c' END AS label FROM postings""", "postings"))
def region_label(spark, d):
    return sample.postings(spark, d).select("uid", text.region_label(F.expr(_REGIONS_JSON)).alias("label"))


@query("f15_band_and_salary_label", sql("""
    SELECT uid, CASE WHEN score >= 65 THEN 'high' WHEN score >= 45 THEN 'middle' ELSE 'low' END AS band,
      CASE salary_signal WHEN 'above' THEN 'above floor' WHEN 'below' THEN 'below floor' END AS pay FROM jobs""", "jobs"))
def band_and_salary_label(spark, d):
    return views.view(spark, d, "jobs").select(
        "uid", text.score_band(F.col("score")).alias("band"), text.salary_label(F.col("salary_signal")).alias("pay"))


_WORDS = r"(?i)\b(" + vocab.ELIGIBILITY_WORDS + r")\b"


@query("f17_eligibility_sentences", sql(rf"""
    SELECT uid, array_to_string(list_transform(list_sort(list_filter(firsts, lambda f: true))[1:4], lambda f: f.s), ' | ') AS notes
    FROM (
      SELECT uid, list({{'n': n, 's': s}}) FILTER (WHERE s IS NOT NULL) AS firsts FROM (
        SELECT uid, min(n) AS n, arg_min(s, n) AS s FROM (
          SELECT uid, generate_subscripts(hits, 1) AS n, unnest(hits) AS s FROM (
            SELECT uid, list_filter(list_transform(list_filter(
              regexp_extract_all(description, '[^.!?\n]*[.!?]?'), lambda x: regexp_matches(x, '{_WORDS}')),
              lambda x: {squeeze('x')}), lambda x: length(x) > 12) AS hits FROM adverts))
        GROUP BY uid, lower(s))
      GROUP BY uid)
    UNION ALL BY NAME
    SELECT uid, '' AS notes FROM adverts WHERE len(list_filter(regexp_extract_all(description, '[^.!?\n]*[.!?]?'),
      lambda x: regexp_matches(x, '{_WORDS}') AND length({squeeze('x')}) > 12)) = 0""", "adverts"))
def eligibility_sentences(spark, d):
    notes = adverts.eligibility_sentences(F.col("description"))
    return views.view(spark, d, "adverts").select("uid", sample.joined(notes, " | ").alias("notes"))


_ASKED = r"((cover|covering|application|motivation|motivational)\s+letters?|letters?\s+of\s+(application|interest|motivation))"
_BEFORE = r"\b(no|not|without|dont|don''t|do\s+not|does\s+not|skip|omit|avoid|never|rather\s+than|instead\s+of)\b[^.;:!?]{0,60}"
_AFTER = r"[^.;:!?]{0,60}\b(not\s+(required|needed|necessary)|unnecessary|un-?needed|optional|is\s+not|are\s+not|isn''t|aren''t)\b"
ASKS_SQL = (f"regexp_matches(regexp_replace(regexp_replace(description, '(?i){_BEFORE}{_ASKED}', '', 'g'), "
            f"'(?i){_ASKED}{_AFTER}', '', 'g'), '(?i){_ASKED}')")


@query("f18_asks_for_letter", sql(f"SELECT uid, {ASKS_SQL} AS asks FROM adverts", "adverts"))
def asks_for_letter(spark, d):
    return views.view(spark, d, "adverts").select("uid", adverts.asks_for_letter(F.col("description")).alias("asks"))


@query("f23_country_regions", sql("""
    SELECT arrival, copy_no, CASE upper(trim(country)) WHEN 'PH' THEN 'Philippines' WHEN 'US' THEN 'United States' ELSE '' END AS regions
    FROM captures""", "captures"))
def country_regions(spark, d):
    return views.view(spark, d, "captures").select(
        "arrival", "copy_no", sample.joined(regions.country_regions(F.col("country"))).alias("regions"))


@query("f25_epoch_times", sql("""
    SELECT arrival, strftime(make_timestamp(nullif(try_cast(pub_date AS BIGINT), 0) * 1000000), '%Y-%m-%d %H:%M:%S') AS from_seconds,
      strftime(make_timestamp(nullif(try_cast(pub_date AS BIGINT), 0) * 1000), '%Y-%m-%d %H:%M:%S') AS from_millis
    FROM feed""", "feed"))
def epoch_times(spark, d):
    return views.view(spark, d, "feed").select(
        "arrival", sample.stamp(dates.epoch_seconds(F.col("pub_date"))).alias("from_seconds"),
        sample.stamp(dates.epoch_millis(F.col("pub_date"))).alias("from_millis"))


_DAY = "substring(CAST(posted AS STRING), 1, 10)"
_ISO_TEXT = f"""CASE arrival % 9 WHEN 0 THEN {_DAY} WHEN 1 THEN {_DAY} || 'T01:02:03Z' WHEN 2 THEN {_DAY} || ' 01:02:03'
  WHEN 3 THEN {_DAY} || 'T01:02:03.250+05:30' WHEN 4 THEN 'soon' WHEN 5 THEN '' WHEN 6 THEN NULL
  WHEN 7 THEN '2001-13-45T00:00:00Z' ELSE {_DAY} || 'T23:30-02:00' END"""


@query("f26_iso_times", sql(f"""
    SELECT uid, strftime(CASE arrival % 9 WHEN 0 THEN day WHEN 1 THEN day + INTERVAL '1 hour 2 minutes 3 seconds'
      WHEN 2 THEN day + INTERVAL '1 hour 2 minutes 3 seconds' WHEN 3 THEN day + INTERVAL '1 hour 2 minutes 3 seconds' - INTERVAL '5 hours 30 minutes'
      WHEN 8 THEN day + INTERVAL '25 hours 30 minutes' END, '%Y-%m-%d %H:%M:%S') AS t
    FROM (SELECT uid, arrival, date_trunc('day', posted) AS day FROM postings)""", "postings"))
def iso_times(spark, d):
    return sample.postings(spark, d).select("uid", sample.stamp(dates.iso_time(F.expr(_ISO_TEXT))).alias("t"))


@query("f27_posted_time", sql("""
    SELECT arrival, copy_no, strftime(coalesce(try_cast(replace(date_posted, 'Z', '') AS TIMESTAMP),
      make_timestamp(CAST(pub_date AS BIGINT) * 1000)), '%Y-%m-%d %H:%M:%S') AS posted FROM captures""", "captures"))
def posted_time(spark, d):
    return views.view(spark, d, "captures").select(
        "arrival", "copy_no", sample.stamp(dates.posted_time(F.col("date_posted"), F.col("pub_date"))).alias("posted"))


@query("f28_staleness", sql(f"""
    SELECT uid, coalesce(date_diff('microsecond', posted_at, {NOW}) // 86400000000 > max_age_days, false) AS stale
    FROM jobs LEFT JOIN policy USING (source)""", "jobs", "policy"))
def staleness(spark, d):
    rows = funnel.with_policy(views.view(spark, d, "jobs"), sample.profile().frame(spark), "max_age_days")
    return rows.select("uid", dates.is_stale(F.col("posted_at"), F.col("max_age_days"), sample.now()).alias("stale"))


@query("f30_annual_usd_max", sql(f"SELECT uid, {ANNUAL} AS annual_usd FROM postings", "postings"))
def annual_usd_max(spark, d):
    return funnel.with_annual(sample.postings(spark, d)).select("uid", "annual_usd")


_PESO, _AUD = r"(?i)php|₱|\bpesos?\b", r"(?i)aud|\ba\$"
_CUR = f"CASE WHEN regexp_matches({{0}}, '{_PESO}') THEN 'PHP' WHEN regexp_matches({{0}}, '{_AUD}') THEN 'AUD' ELSE 'USD' END"
_PERIOD = "CASE " + " ".join(f"WHEN regexp_matches(seg, '(?i){p}') THEN '{n}'" for n, p in vocab.PERIOD_WORDS) + " END"
_NUMS = (r"list_transform(regexp_extract_all(seg, '\d[\d,]*(?:\.\d+)?\s*[kK]?'), lambda t: "
         r"CAST(regexp_replace(t, '[,\skK]', '', 'g') AS DOUBLE) * CASE WHEN regexp_matches(t, '[kK]$') THEN 1000 ELSE 1 END)")
PAY_STEPS = f"""
  tidy AS (SELECT *, translate({squeeze("coalesce(pay, '')")}, '–—~', '---') AS t FROM pay_text),
  segs AS (SELECT *, list_filter(string_split(t, '|'), lambda s: trim(s) <> '') AS ss FROM tidy),
  picked AS (SELECT *, CASE WHEN t = '' OR regexp_matches(t, '(?i){vocab.PIECEWORK}') THEN NULL ELSE coalesce(
    list_filter(ss, lambda s: regexp_matches(s, '\\d') AND {_CUR.format('s')} = 'USD')[1], ss[1]) END AS seg FROM segs),
  nums AS (SELECT *, list_filter({_NUMS}, lambda n: n > 0) AS ns, {_PERIOD} AS stated, {_CUR.format('seg')} AS cur FROM picked),
  per AS (SELECT *, coalesce(stated, CASE WHEN lower(trim(job_type)) = 'gig' THEN NULL
    WHEN list_max(ns) < 200 THEN 'hourly' ELSE 'monthly' END) AS per FROM nums),
  rated AS (SELECT *, CAST(CASE per WHEN 'hourly' THEN 2080 WHEN 'weekly' THEN 52 WHEN 'monthly' THEN 12 WHEN 'annual' THEN 1 END AS DOUBLE)
    * CASE cur WHEN 'USD' THEN CAST(1 AS DOUBLE) WHEN 'PHP' THEN CAST(1 AS DOUBLE) / CAST(58.5 AS DOUBLE) ELSE CAST(0.66 AS DOUBLE) END AS f FROM per)"""


def _pay_check(body: str) -> str:
    head = sql("", "pay_text").rstrip()
    return f"{head}, {PAY_STEPS} {body}"


@query("f31_parse_pay", _pay_check("""
    SELECT arrival, CAST(round_even(list_min(ns) * f, 0) AS BIGINT) AS pay_min, CAST(round_even(list_max(ns) * f, 0) AS BIGINT) AS pay_max
    FROM rated"""))
def parse_pay(spark, d):
    return money.parse_pay(views.view(spark, d, "pay_text"), "pay", "job_type").select("arrival", "pay_min", "pay_max")


@query("f32_free_text_currency", _pay_check(f"SELECT arrival, {_CUR.format('t')} AS currency FROM tidy"))
def free_text_currency(spark, d):
    return views.view(spark, d, "pay_text").select(
        "arrival", money.free_text_currency(money.tidy_pay(F.col("pay"))).alias("currency"))


@query("f33_capture_currency", sql(r"""
    SELECT arrival, copy_no, CASE WHEN contains(salary_text, '$') THEN 'USD'
      WHEN regexp_matches(salary_text, '(?i)php|₱|\bpesos?\b') THEN 'PHP' END AS currency FROM captures""", "captures"))
def capture_currency(spark, d):
    return views.view(spark, d, "captures").select(
        "arrival", "copy_no", money.capture_currency(F.col("salary_text")).alias("currency"))


@query("f34_amounts", _pay_check(
    "SELECT arrival, len(nums) AS n, coalesce(list_sum(nums), 0) AS total FROM (SELECT arrival, "
    + _NUMS.replace("seg", "t0") + " AS nums FROM (SELECT arrival, t AS t0 FROM tidy))"))
def amounts(spark, d):
    nums = money.amounts(money.tidy_pay(F.col("pay")))
    total = F.aggregate(nums, F.lit(0.0), lambda a, n: a + n)
    return views.view(spark, d, "pay_text").select("arrival", F.size(nums).cast("bigint").alias("n"), total.alias("total"))


@query("f35_period_and_piecework", _pay_check(
    f"SELECT arrival, {_PERIOD} AS period, regexp_matches(seg, '(?i){vocab.PIECEWORK}') AS piecework "
    "FROM (SELECT arrival, t AS seg FROM tidy)"))
def period_and_piecework(spark, d):
    pay = money.tidy_pay(F.col("pay"))
    return views.view(spark, d, "pay_text").select(
        "arrival", money.stated_period(pay).alias("period"), money.is_piecework(pay).alias("piecework"))


STRUCTURED = """
  CASE upper(salary_period) WHEN 'YEARLY' THEN 'annual' WHEN 'MONTHLY' THEN 'monthly' WHEN 'HOURLY' THEN 'hourly' END AS per,
  CASE WHEN contains(salary_text, '$') THEN CAST(1 AS DOUBLE)
    WHEN regexp_matches(salary_text, '(?i)php|\\bpesos?\\b') THEN CAST(1 AS DOUBLE) / CAST(58.5 AS DOUBLE) END AS rate"""
PAID = "salary_max <> 0 AND per IS NOT NULL AND rate IS NOT NULL"


@query("f36_structured_pay", sql(f"""
    SELECT arrival, copy_no, CASE WHEN {PAID} AND salary_min <> 0 THEN CAST(round_even(salary_min * rate, 0) AS BIGINT) END AS salary_min,
      CASE WHEN {PAID} THEN CAST(round_even(salary_max * rate, 0) AS BIGINT) END AS salary_max,
      CASE WHEN {PAID} THEN per END AS salary_period, CASE WHEN {PAID} THEN 'USD' END AS currency
    FROM (SELECT *, {STRUCTURED} FROM captures)""", "captures"))
def structured_pay(spark, d):
    rows = views.view(spark, d, "captures")
    return rows.select("arrival", "copy_no", money.structured_pay(F.struct(*rows.columns)).alias("_pay")).select(
        "arrival", "copy_no", "_pay.*")


@query("f38_salary_signal", sql("SELECT uid, salary_signal, clears_inbound FROM tagged", "tagged"))
def salary_signal(spark, d):
    p, annual = sample.profile(), F.col("annual_usd")
    return funnel.with_annual(sample.postings(spark, d)).select(
        "uid", money.salary_signal(annual, p.target_hourly).alias("salary_signal"),
        money.clears_inbound(annual, p.inbound_hourly).alias("clears_inbound"))


@query("f39_offsets", sql("""
    SELECT uid, CASE WHEN any_zone THEN '' ELSE zones[1] || ',' || zones[2] || ',7' END AS offsets FROM postings""", "postings"))
def offsets(spark, d):
    zones = F.transform("zones", lambda z: z.cast("string"))
    junk = F.concat(F.array(F.lit("x")), zones, F.array(F.lit(" 7 "), F.lit("1.5"), F.lit(None).cast("string")))
    stated = F.when(~F.col("any_zone"), junk)
    return views.view(spark, d, "postings").select("uid", sample.joined(regions.offsets(stated)).alias("offsets"))


@query("f40_tidy_list", sql("""
    SELECT uid, array_to_string(list_filter(places, lambda x: x IS NOT NULL), ',') || '|' AS names FROM postings""", "postings"))
def tidy_list(spark, d):
    padded = F.concat(F.array(F.lit("  "), F.lit("")), F.transform("places", lambda p: F.concat(F.lit(" "), p, F.lit(" "))))
    names = sample.joined(regions.tidy_list(padded))
    return views.view(spark, d, "postings").select("uid", F.concat(names, F.lit("|")).alias("names"))


@query("f41_lists_as_json", sql("""
    SELECT uid, CASE WHEN arrival % 2 = 1 THEN '["degree","named_clients"]' ELSE '["equipment"]' END AS blockers,
      CASE WHEN anywhere THEN 0 ELSE len(regions) END AS n_regions FROM jobs""", "jobs"))
def lists_as_json(spark, d):
    rows = sample.stored(spark, d)
    back = F.from_json(F.to_json("regions"), "array<string>")
    return rows.select("uid", F.to_json(F.sort_array("blockers")).alias("blockers"),
                       F.size(back).cast("bigint").alias("n_regions"))
