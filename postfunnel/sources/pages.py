"""Single pages and pasted text, added by hand."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from postfunnel import vocab
from postfunnel.functions import dates, jsonld
from postfunnel.functions.regions import named
from postfunnel.functions.text import blank_to_null, excerpt, first_line, row_id, strip, strip_html


def is_challenge(html: Column) -> Column:
    """Is the page a bot challenge instead of an advert?"""
    start = F.lower(F.substring(F.coalesce(html, F.lit("")), 1, vocab.CHALLENGE_PREFIX))
    marks = F.array(*[F.lit(m) for m in vocab.CHALLENGE_MARKERS])
    return F.exists(marks, lambda m: F.contains(start, m))


def without_challenges(pages: DataFrame) -> DataFrame:
    return pages.filter(~is_challenge(F.col("html")))


def page_text(html: Column) -> Column:
    """Readable text of a page without its furniture."""
    return strip_html(F.regexp_replace(html, vocab.PAGE_FURNITURE, " "))


def page_title(html: Column) -> Column:
    """og:title, else the title tag; null where the page has neither."""
    og = F.regexp_extract(html, vocab.OG_TITLE, 1)
    tag = F.regexp_extract(html, vocab.TITLE_TAG, 1)
    return blank_to_null(strip(F.when(og != "", og).otherwise(tag)))


def from_text(rows: DataFrame, now: Column, body: str = "body", url: str = "url",
              title: Column | None = None, board: str = vocab.BOARD_MANUAL) -> DataFrame:
    """Pasted advert text as a posting, titled by its first line if need be."""
    text = strip(F.coalesce(F.col(body), F.lit("")))
    heading = first_line(text)
    if title is not None:
        heading = F.coalesce(blank_to_null(title), heading)
    return rows.select(
        F.lit(board).alias("source"),
        F.col(url).alias("source_id"),
        row_id(F.lit(board), F.col(url)).alias("uid"),
        F.coalesce(blank_to_null(heading), F.lit(vocab.UNTITLED)).alias("title"),
        F.lit("").alias("company"),
        F.col(url).alias("url"),
        now.alias("posted"),
        text.alias("description"),
        excerpt(text, 280).alias("excerpt"),
    )


def from_plain_pages(pages: DataFrame, now: Column, board: str = vocab.BOARD_MANUAL) -> DataFrame:
    """Pages without structured data: their own text and title."""
    rows = pages.select("url", page_text(F.col("html")).alias("body"), page_title(F.col("html")).alias("_title"))
    return from_text(rows, now, title=F.col("_title"), board=board)


def from_json_ld(pages: DataFrame, now: Column, board: str = vocab.BOARD_MANUAL) -> DataFrame:
    """Pages with a JSON-LD job posting; the others are dropped."""
    # Pages without a block never reach the Python helper.
    marked = pages.select("url", "html").filter(F.coalesce(jsonld.json_ld_blocks(F.col("html")).isNotNull(), F.lit(False)))
    return _postings(jsonld.with_posting(marked).filter(F.col("p.title").isNotNull()), now, board)


def _postings(pages: DataFrame, now: Column, board: str) -> DataFrame:
    """Rows (url, html, p) as postings: by the posting ``p`` found in the page,
    or by the page's own text and title where its fields are null."""
    structured = F.col("p.title").isNotNull()
    text = F.when(structured, strip_html(F.col("p.description"))).otherwise(
        strip(F.coalesce(page_text(F.col("html")), F.lit(""))))
    rows = pages.withColumn("_text", text)
    own_title = F.coalesce(page_title(F.col("html")), blank_to_null(first_line(F.col("_text"))))
    title = F.when(structured, blank_to_null(F.col("p.title"))).otherwise(own_title)
    return rows.select(
        F.lit(board).alias("source"),
        F.col("url").alias("source_id"),
        row_id(F.lit(board), F.col("url")).alias("uid"),
        F.coalesce(title, F.lit(vocab.UNTITLED)).alias("title"),
        F.coalesce("p.company", F.lit("")).alias("company"),
        "url",
        # No date means it was found today, the only honest answer.
        F.coalesce(dates.iso_time(F.col("p.date_posted")), now).alias("posted"),
        dates.iso_time(F.col("p.valid_through")).alias("expires"),
        F.col("_text").alias("description"),
        excerpt(F.col("_text"), 280).alias("excerpt"),
        F.col("p.regions").alias("location_restrictions"),
        F.col("p.salary_min").alias("salary_min"),
        F.col("p.salary_max").alias("salary_max"),
        # A day or week rate has no period here, and is then read as annual.
        named(vocab.JSONLD_UNITS, F.col("p.unit")).alias("salary_period"),
        F.col("p.currency").alias("currency"),
    )


def from_pages(pages: DataFrame, now: Column, board: str = vocab.BOARD_MANUAL) -> DataFrame:
    """Each page by its structured data, else by its text: one scan, told apart
    row by row."""
    readable = without_challenges(pages).select("url", "html")
    return _postings(jsonld.with_posting(readable), now, board)
