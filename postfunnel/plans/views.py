"""The given tables seen as postings, asks, scores and so on.

Each view is one SELECT in SQL that Spark and DuckDB both understand, so the
input of a query is the same for the engine and for its check.  Only the views
are shared; what a query then does with them is written twice, as operators
here and as SQL in ``oracle``.

Three words stand for what the dialects write differently: ``ARR(...)`` is an
array, ``DAYS(t)`` the whole days from a time to the clock, ``COPIES(n)`` one
row for each number from 0 to n.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from postfunnel import vocab

CLOCK = "2001-08-02 00:00:00"
TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "pages"]

_KIND_OF = "CASE l_partkey % 17 " + " ".join(
    f"WHEN {n} THEN '{k}'" for n, k in enumerate(vocab.REQUIREMENT_KINDS)
) + " END"

VIEWS: dict[str, str] = {
    # One row per order: the advert of a board (market segment) by a company.
    "postings": """
        SELECT
          o.o_orderkey AS arrival,
          lower(c.c_mktsegment) AS source,
          CAST(o.o_orderkey AS STRING) AS source_id,
          lower(c.c_mktsegment) || ':' || CAST(o.o_orderkey AS STRING) AS uid,
          p.p_name || ' ' || lower(p.p_type) AS title,
          CASE WHEN o.o_orderkey % 10 = 3 THEN NULL WHEN o.o_orderkey % 10 = 4 THEN '' ELSE s.s_name END AS company,
          CASE WHEN o.o_orderkey % 6 = 5 THEN '/jobs/' ELSE 'https://jobs.example.com/' END
            || CAST(o.o_orderkey AS STRING) AS url,
          CAST(o.o_orderdate + INTERVAL '1' MINUTE * CAST(o.o_orderkey % 1440 AS INT) AS TIMESTAMP) AS posted,
          CASE WHEN o.o_orderkey % 11 = 0
            THEN CAST(o.o_orderdate + INTERVAL '30' DAY AS TIMESTAMP) END AS expires,
          CASE o.o_orderkey % 4
            WHEN 0 THEN ARR(CAST(NULL AS STRING))
            WHEN 1 THEN ARR(r.r_name)
            WHEN 2 THEN ARR(n.n_name, r.r_name)
            ELSE ARR(n.n_name) END AS places,
          o.o_orderkey % 4 = 0 AS anywhere,
          CASE o.o_orderkey % 3
            WHEN 0 THEN ARR(CAST(NULL AS INT))
            ELSE ARR(CAST(c.c_nationkey % 12 AS INT), CAST(c.c_nationkey % 12 - 7 AS INT)) END AS zones,
          o.o_orderkey % 3 = 0 AS any_zone,
          CASE WHEN o.o_orderkey % 5 = 0 THEN NULL WHEN o.o_orderkey % 7 = 0 THEN 0
            WHEN o.o_orderkey % 5 = 2 THEN CAST(floor(o.o_totalprice / 40) AS BIGINT)
            WHEN o.o_orderkey % 5 = 3 THEN CAST(floor(o.o_totalprice / 5000) AS BIGINT)
            ELSE CAST(floor(o.o_totalprice / 4) AS BIGINT) END AS salary_max,
          CASE o.o_orderkey % 9 WHEN 7 THEN NULL WHEN 8 THEN 'EUR' WHEN 6 THEN 'usd' ELSE 'USD' END AS currency,
          CASE o.o_orderkey % 5 WHEN 1 THEN 'annual' WHEN 2 THEN 'Monthly' WHEN 3 THEN 'hourly'
            WHEN 4 THEN CASE WHEN o.o_orderkey % 2 = 0 THEN 'weekly' ELSE NULL END END AS salary_period,
          o.o_orderpriority AS category,
          o.o_totalprice AS price
        FROM orders o
        JOIN customer c ON c.c_custkey = o.o_custkey
        JOIN nation n ON n.n_nationkey = c.c_nationkey
        JOIN region r ON r.r_regionkey = n.n_regionkey
        JOIN part p ON p.p_partkey = o.o_custkey
        JOIN supplier s ON s.s_suppkey = CAST(floor(o.o_custkey / 15.0) AS BIGINT)
    """,
    # The invented prose of the documents with one sentence appended.
    "adverts": """
        SELECT doc_id AS arrival, source, source || ':' || CAST(doc_id AS STRING) AS uid,
          text || CASE doc_id % 12
            WHEN 0 THEN ' Please send a cover letter with your CV.'
            WHEN 1 THEN ' No cover letter needed, just your work.'
            WHEN 2 THEN ' Cover letters are not required for this role.'
            WHEN 3 THEN ' You must be located in Nigeria or Ghana.'
            WHEN 4 THEN ' We cannot sponsor. We  cannot sponsor. Only hire residents of Ontario!'
            WHEN 5 THEN ' Attach a letter of interest. We do not offer visa sponsorship'
            WHEN 6 THEN ' A covering letter is optional. Include a letter of motivation!'
            WHEN 7 THEN ' Applications without a cover letter will not be read.'
            WHEN 8 THEN ' We do not relocate. Please send an application letter; eligible to work in the EU?'
            WHEN 9 THEN ' Right to work? RIGHT TO WORK? right to work? Residents of X, residing in Y. No sponsorship. Must live here. Must reside there. Authorized to work.'
            ELSE '' END AS description,
          (doc_id * 37) % 101 AS score
        FROM documents
    """,
    # Scored rows as stored by earlier runs, priced under an older policy.
    "jobs": """
        SELECT p.arrival, p.uid, p.source, p.title, p.company, p.url, p.posted AS posted_at,
          p.places AS regions, p.anywhere,
          CASE p.arrival % 4 WHEN 0 THEN 'above' WHEN 1 THEN 'below' ELSE 'unknown' END AS salary_signal,
          CAST(CASE WHEN p.arrival % 13 = 0 THEN NULL
            WHEN p.arrival % 2 = 1 THEN greatest(0, (p.arrival * 37) % 101 - 30)
            ELSE (p.arrival * 37) % 101 END AS INT) AS score,
          CAST(CASE WHEN p.arrival % 13 = 0 OR p.arrival % 2 = 0 THEN NULL
            ELSE (p.arrival * 37) % 101 END AS INT) AS score_raw,
          CASE WHEN p.arrival % 13 = 0 THEN 'unscored' WHEN (p.arrival * 37) % 101 >= 70 THEN 'strong'
            WHEN (p.arrival * 37) % 101 >= 40 THEN 'maybe' ELSE 'no' END AS verdict,
          'because ' || CAST(p.arrival % 50 AS STRING) AS why,
          CASE WHEN p.arrival % 2 = 1 THEN ARR('named_clients', 'degree') ELSE ARR('equipment') END AS blockers,
          CASE WHEN p.arrival % 6 = 0 THEN NULL WHEN p.arrival % 6 = 1 THEN '' ELSE 'text of ' || p.uid END AS description,
          CAST(p.posted + INTERVAL '2' HOUR AS TIMESTAMP) AS created_at,
          CASE p.arrival % 5 WHEN 0 THEN 'interested' WHEN 1 THEN 'applied' WHEN 2 THEN 'passed' ELSE 'new' END AS state
        FROM postings p
    """,
    # What each advert asks for, as the scorer returned it: repeats included.
    "raw_asks": f"""
        SELECT p.uid, l.l_linenumber * CAST(1000000000000 AS BIGINT) + l.l_partkey AS position,
          CASE WHEN l.l_partkey % 41 = 0 THEN 'made_up' ELSE {_KIND_OF} END AS kind,
          l.l_returnflag = 'R' AS mandatory,
          CASE WHEN l.l_suppkey % 7 = 0 THEN ''
            ELSE ' Wanted: item ' || CAST(l.l_suppkey % 50 AS STRING) || ' ' END AS detail
        FROM (
          SELECT l_orderkey, l_linenumber, l_partkey, min(l_suppkey) AS l_suppkey, max(l_returnflag) AS l_returnflag
          FROM lineitem GROUP BY l_orderkey, l_linenumber, l_partkey
        ) l
        JOIN postings p ON p.arrival = l.l_orderkey
    """,
    # The same, one row per (uid, kind).
    "asks": """
        SELECT uid, kind, bool_or(mandatory) AS mandatory, max(trim(detail)) AS detail,
          kind IN ('degree', 'named_clients') AND bool_or(mandatory) AS blocking
        FROM raw_asks WHERE kind <> 'made_up' GROUP BY uid, kind
    """,
    "letters": """
        SELECT uid, CASE WHEN arrival % 34 = 0 THEN '  ' ELSE 'Dear ' || source END AS body,
          CAST(posted_at + INTERVAL '3' DAY AS TIMESTAMP) AS drafted_at
        FROM jobs WHERE arrival % 17 = 0
    """,
    # Free-text pay in every wording the parser has to read.
    "pay_text": """
        SELECT o_orderkey AS arrival,
          CASE WHEN o_orderkey % 4 = 1 THEN 'Gig' WHEN o_orderkey % 4 = 2 THEN 'Full Time' ELSE '' END AS job_type,
          CASE o_orderkey % 20
            WHEN 0 THEN 'TBD'
            WHEN 1 THEN '$' || CAST(CAST(floor(o_totalprice / 500) AS BIGINT) AS STRING)
            WHEN 2 THEN '$' || CAST(o_orderkey % 30 AS STRING) || '.50 - $' || CAST(o_orderkey % 30 + 9 AS STRING) || ' an hour'
            WHEN 3 THEN CAST(CAST(floor(o_totalprice / 10) AS BIGINT) AS STRING) || 'PHP'
            WHEN 4 THEN '$1,900-2,400/mo | PHP 120,000-150,000/mo'
            WHEN 5 THEN '$' || CAST(o_orderkey % 90 AS STRING) || ' per listing'
            WHEN 6 THEN 'PHP' || CAST(o_orderkey % 200 AS STRING) || 'k monthly'
            WHEN 7 THEN CAST(o_orderkey % 40 AS STRING) || 'hrly'
            WHEN 8 THEN CAST(o_orderkey % 900 AS STRING) || ' / week'
            WHEN 9 THEN CAST(o_orderkey % 9 AS STRING) || ' aud/hr'
            WHEN 10 THEN '$6.00 ~ $' || CAST(o_orderkey % 50 AS STRING) || ' / HR'
            WHEN 11 THEN '?'
            WHEN 12 THEN '   '
            WHEN 13 THEN CAST(o_orderkey % 300 AS STRING)
            WHEN 14 THEN '$20 fixed price for this page'
            WHEN 15 THEN '60k - 90k   a year'
            WHEN 16 THEN 'P 500 pesos a month | ' || CAST(o_orderkey % 4000 AS STRING) || '$ / month ( DEPENDS)'
            WHEN 17 THEN '0'
            WHEN 18 THEN NULL
            ELSE '$4.per hour to start plus bonus' END AS pay
        FROM orders
    """,
    # Feed items, some of them unusable.
    "feed": """
        SELECT p.arrival,
          CASE WHEN p.arrival % 19 = 0 THEN NULL WHEN p.arrival % 19 = 1 THEN '' ELSE 'g' || p.source_id END AS guid,
          CASE WHEN p.arrival % 38 = 0 THEN NULL ELSE 'https://feed.example.com/' || p.source_id END AS link,
          CASE WHEN p.arrival % 23 = 0 THEN '  ' ELSE ' ' || p.title || ' ' END AS title,
          p.company,
          CASE WHEN p.arrival % 29 = 0 THEN 'soon' WHEN p.arrival % 29 = 1 THEN '0'
            ELSE CAST(900000000 + p.arrival * 3600 AS STRING) END AS pub_date,
          p.places, p.anywhere, p.salary_max, p.salary_period, p.currency, p.category,
          '<p>Pay &amp; terms&#58; ' || p.title || '</p><br/><ul><li>one</li><li>two &#8230;</li></ul>' AS html
        FROM postings p
    """,
    # Three captures of every advert; every ninth copy is broken.
    "captures": """
        SELECT p.arrival, p.copy_no, p.source_id AS jobkey, p.source AS site, p.title, p.company,
          CASE p.copy_no WHEN 0 THEN '2001-08-01T06:00:00.000Z' WHEN 1 THEN '2001-07-25T06:00:00Z'
            ELSE '2001-07-18T23:59:59.999Z' END AS captured_at,
          (p.arrival + p.copy_no) % 9 = 0 AS expired,
          CASE WHEN (p.arrival + p.copy_no) % 14 = 3 THEN NULL
            WHEN (p.arrival + p.copy_no) % 14 = 4 THEN 'last week'
            ELSE substring(CAST(p.posted AS STRING), 1, 10) || 'T08:00:00Z' END AS date_posted,
          CASE WHEN p.arrival % 14 = 4 THEN NULL ELSE CAST((900000000 + p.arrival * 600) * 1000 AS STRING) END AS pub_date,
          CASE p.arrival % 4 WHEN 0 THEN 'PH' WHEN 1 THEN ' us ' WHEN 2 THEN 'DE' ELSE NULL END AS country,
          CASE p.arrival % 6 WHEN 0 THEN 'PHP ' || CAST(p.salary_max AS STRING) || ' a month'
            WHEN 1 THEN '$' || CAST(p.salary_max AS STRING) WHEN 2 THEN 'EUR 30'
            WHEN 3 THEN '5 pesos' WHEN 4 THEN NULL ELSE '$ and PHP' END AS salary_text,
          CASE p.arrival % 5 WHEN 0 THEN 'YEARLY' WHEN 1 THEN 'MONTHLY' WHEN 2 THEN 'HOURLY'
            WHEN 3 THEN 'WEEKLY' ELSE 'hourly' END AS salary_period,
          CAST(p.salary_max AS DOUBLE) AS salary_max,
          CASE WHEN p.arrival % 8 = 0 THEN CAST(0 AS DOUBLE) ELSE CAST(p.salary_max AS DOUBLE) / 2 END AS salary_min
        FROM (SELECT arrival, source_id, source, title, company, posted, salary_max, COPIES(arrival % 3) AS copy_no FROM postings) p
    """,
    # Pages of a newest-first listing: twenty days to a page.
    "page_walk": """
        SELECT arrival, uid, source, posted,
          CAST(floor(date_diff_days / 20) AS INT) + 1 AS page_no
        FROM (SELECT arrival, uid, source, posted, DAYS(posted) AS date_diff_days FROM postings)
        WHERE NOT (source = 'furniture' AND floor(date_diff_days / 20) = 30)
    """,
    # Result-page cards, assembled as HTML.
    "cards": """
        SELECT t.arrival, t.pay, t.job_type, p.title, p.company,
          '<html><body>'
          || '<a href="/jobseekers/job/' || replace(p.title, ' ', '-') || '-' || p.source_id || '?x=1" style="color:inherit;">'
          || '<div style="position: relative;" class="jobpost-cat-box latest-job-post">'
          || '<img src="/logo.png" class="jobpost-cat-box-logo" alt="' || coalesce(p.company, '') || '" />'
          || '<h4 class="fs-16">' || p.title || CASE WHEN t.job_type = '' THEN '' ELSE
             ' <span class="badge full-time">' || t.job_type || '</span>' END || ' </h4>'
          || CASE WHEN t.arrival % 15 = 1 THEN '' ELSE '<p data-temp="' || substring(CAST(p.posted AS STRING), 1, 10)
             || ' 20:30:00" data-temp-2="' || substring(CAST(p.posted AS STRING), 1, 10) || ' 12:30:00"></p>' END
          || '<dl class="row fs-14"><dd class="col">' || coalesce(t.pay, '') || '</dd></dl>'
          || '<div class="desc fs-14">' || CASE WHEN t.arrival % 3 = 0 THEN '<div>Join ' ELSE '<p>Join ' END || p.source || ' now<br />'
          || CASE WHEN t.arrival % 3 = 0 THEN '</div>' ELSE '</p>' END || 'and grow&#8230; <a href="/jobseekers/job/x-1">See More</a></div>'
          || '</div></a></body></html>' AS html
        FROM pay_text t JOIN postings p ON p.arrival = t.arrival
    """,
    # Detail pages for some of the postings, a few of them blank.
    "details": """
        SELECT p.uid,
          CASE WHEN p.arrival % 9 = 4 THEN '<div id="job-description"> </div>'
            WHEN p.arrival % 9 = 5 THEN '<div class="other">none</div>'
            WHEN p.arrival % 9 = 6 THEN '<section class="x job-description y"><p>Part ' || p.title || '</p></section> after'
            ELSE '<html><div id="job-description"><div>Full ' || p.title || '</div><p>Must be located in '
              || p.source || '.</p></div><div>footer</div></html>' END AS html
        FROM postings p WHERE p.arrival % 2 = 0
    """,
    # Score responses: missing, repeated and out-of-range indexes.
    "responses": """
        SELECT CAST(floor(arrival / 12.0) AS BIGINT) AS batch, arrival % 12 AS i, arrival,
          CASE WHEN arrival % 31 = 0 THEN '99' WHEN arrival % 37 = 0 THEN 'x'
            ELSE CAST(arrival % 12 AS STRING) END AS said,
          (arrival * 37) % 101 AS score, arrival % 10 = 0 AS twice
        FROM postings
    """,
    # Triage clicks.
    "clicks": """
        SELECT event_id AS change_no, ts AS changed_at, user_id,
          CASE event_type WHEN 'view' THEN 'new' WHEN 'click' THEN 'interested' WHEN 'purchase' THEN 'applied'
            WHEN 'error' THEN 'passed' ELSE 'deleted' END AS state
        FROM events
    """,
    # Runs of the day: an opening and a closing row per run.
    "run_events": """
        SELECT CAST(floor(event_id / 2.0) AS BIGINT) AS run_id, event_id AS event_no,
          ts AS started_at, CASE WHEN event_id % 2 = 1 THEN ts END AS finished_at,
          event_id % 2 = 1 AND event_type <> 'error' AS ok,
          user_id AS fetched, CASE WHEN event_type = 'error' THEN 'boom' END AS error
        FROM events
    """,
    # Policies as rows, partly filled in; numbers follow the board's customers.
    "raw_policy": """
        SELECT lower(c_mktsegment) || '-' || CAST(c_nationkey AS STRING) AS source,
          CASE WHEN count(*) % 3 = 0 THEN NULL ELSE CAST(30 + count(*) % 40 AS INT) END AS display_threshold,
          CASE WHEN count(*) % 2 = 0 THEN NULL ELSE CAST(50 + count(*) % 30 AS INT) END AS draft_at,
          CASE WHEN count(*) % 5 < 3 THEN NULL ELSE CAST(40 + count(*) % 10 AS INT) END AS draft_if_asked_at,
          CASE WHEN count(*) % 4 = 1 THEN NULL ELSE CAST(10 + count(*) % 20 AS DOUBLE) END AS floor_hourly,
          CASE WHEN count(*) % 7 = 0 THEN NULL ELSE CAST(count(*) % 60 AS INT) END AS max_age_days
        FROM customer GROUP BY lower(c_mktsegment) || '-' || CAST(c_nationkey AS STRING)
    """,
}

_NAME = re.compile(r"\b(?:FROM|JOIN)\s+([a-z_]+)", re.I)


def needs(name: str) -> list[str]:
    return [n for n in dict.fromkeys(_NAME.findall(VIEWS[name])) if n in VIEWS or n in TABLES]


def view(spark: SparkSession, sf_dir: str, name: str, _seen: dict | None = None) -> DataFrame:
    """A view or a given table as a DataFrame.  Nothing is run or stored."""
    seen = {} if _seen is None else _seen
    if name not in seen:
        if name in VIEWS:
            parts = {n: view(spark, sf_dir, n, seen) for n in needs(name)}
            seen[name] = spark.sql(_spark_text(name), **parts)
        else:
            seen[name] = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return seen[name]


def _spark_text(name: str) -> str:
    text = VIEWS[name].replace("ARR(", "array(")
    text = text.replace("DAYS(posted)", f"datediff(TIMESTAMP '{CLOCK}', posted)")
    text = re.sub(r"COPIES\(([^)]*)\)", r"explode(sequence(0, CAST(\1 AS INT)))", text)
    return re.sub(r"\b(FROM|JOIN)\s+([a-z_]+)",
                  lambda m: f"{m[1]} {{{m[2]}}}" if m[2] in VIEWS or m[2] in TABLES else m[0], text)


def duck_text(name: str) -> str:
    text = VIEWS[name].replace("ARR(", "list_value(")
    text = text.replace("DAYS(posted)", f"date_diff('day', posted, TIMESTAMP '{CLOCK}')")
    return re.sub(r"COPIES\(([^)]*)\)", r"CAST(unnest(range(0, \1 + 1)) AS INT)", text)


def duck_with(*names: str) -> list[str]:
    """The views a check needs, each after the ones it is built on."""
    ordered: list[str] = []

    def visit(name: str) -> None:
        if name in VIEWS and name not in ordered:
            for other in needs(name):
                visit(other)
            ordered.append(name)

    for name in names:
        visit(name)
    return [f"{name} AS ({duck_text(name)})" for name in ordered]
