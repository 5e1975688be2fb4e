"""JSON feed pages: one object per page with a list of items."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from postfunnel import vocab
from postfunnel.functions import dates, regions
from postfunnel.functions.text import blank_to_null, excerpt, row_id, strip, strip_html
from postfunnel.operators.numbering import with_order
from postfunnel.schema import FEED_PAGE, as_posting
from postfunnel.sources import files


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Pages as read, with their file and place in it; one that is no JSON keeps its text in _corrupt_record.

    A file whose first line is a whole object has one page a line, any other is
    one page over all its lines.
    """
    raw = spark.read.text(path, wholetext=True, recursiveFileLookup=True)
    raw = raw.select(F.col("_metadata.file_path").alias("file"), "value")
    by_line = F.col("value").rlike(r"\A\s*\{[^\r\n]*\}[ \t]*(?:\r?\n|\z)")
    texts = F.when(by_line, F.split("value", r"\r?\n")).otherwise(F.array("value"))
    texts = raw.select("file", F.posexplode(F.filter(texts, lambda text: strip(text) != "")).alias("page", "_text"))
    return texts.select("file", "page", F.from_json("_text", FEED_PAGE).alias("_page")).select("file", "page", "_page.*")


def items_of(pages: DataFrame, *keep: str) -> DataFrame:
    return pages.select(*keep, F.posexplode("jobs").alias("pos", "item"))


def _or_null(column):
    return F.when(column != 0, column.try_cast("bigint"))


def postings_from(items: DataFrame, board: str = vocab.BOARD_FEED, *keep: str) -> DataFrame:
    """Feed items as postings; one without an id, title or date is dropped.

    ``items`` has a struct column ``item``; ``arrival`` and other columns named
    in ``keep`` are carried along.
    """
    item = F.col("item")
    guid = F.coalesce(blank_to_null(item["guid"]), blank_to_null(item["applicationLink"]))
    title = strip(F.coalesce(item["title"], F.lit("")))
    rows = items.select(
        *keep,
        F.lit(board).alias("source"),
        guid.alias("source_id"),
        row_id(F.lit(board), guid).alias("uid"),
        title.alias("title"),
        strip(F.coalesce(item["companyName"], F.lit(""))).alias("company"),
        F.coalesce(blank_to_null(item["applicationLink"]), guid).alias("url"),
        dates.epoch_seconds(item["pubDate"]).alias("posted"),
        dates.epoch_seconds(item["expiryDate"]).alias("expires"),
        excerpt(strip_html(item["excerpt"]), 600).alias("excerpt"),
        strip_html(item["description"]).alias("description"),
        regions.tidy_list(item["locationRestrictions"]).alias("location_restrictions"),
        regions.offsets(item["timezoneRestrictions"]).alias("timezone_restrictions"),
        _or_null(item["minSalary"]).alias("salary_min"),
        _or_null(item["maxSalary"]).alias("salary_max"),
        blank_to_null(item["salaryPeriod"]).alias("salary_period"),
        blank_to_null(item["currency"]).alias("currency"),
        item["seniority"].alias("seniority"),
        item["categories"].alias("categories"),
    )
    usable = F.col("source_id").isNotNull() & (F.col("title") != "") & F.col("posted").isNotNull()
    return rows.filter(usable)


def read_feed(spark: SparkSession, path: str, board: str = vocab.BOARD_FEED) -> DataFrame:
    """All postings of a folder of feed pages, in the order of files, pages and items."""
    order = ("file", "page", "pos")
    return as_posting(with_order(postings_from(items_of(read_pages(spark, path), "file", "page"), board, *order), *order))


def file_states(spark: SparkSession, path: str) -> DataFrame:
    """Every file of a folder and whether it could be read."""
    pages = read_pages(spark, path).select("file", F.col("_corrupt_record").isNotNull().alias("bad"))
    return files.states(files.listing(spark, path), pages)
