"""Capture files: what a browser session wrote down of a search page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from postfunnel import vocab
from postfunnel.functions import dates, money, regions
from postfunnel.functions.text import blank_to_null, excerpt, link_or_canonical, row_id, strip, strip_html
from postfunnel.operators.numbering import with_order
from postfunnel.schema import CAPTURE_FILE, as_posting


PATTERN = "indeed-*.json"


def read_files(spark: SparkSession, path: str, pattern: str = PATTERN) -> DataFrame:
    """Capture files with their path; an unreadable file keeps only its text."""
    return (
        spark.read.schema(CAPTURE_FILE).option("multiLine", True).option("mode", "PERMISSIVE")
        .option("pathGlobFilter", pattern).json(path)
        .withColumn("path", F.col("_metadata.file_path"))
    )


def with_freshness(files: DataFrame, now: Column, max_age_days: float = vocab.CAPTURE_MAX_AGE_DAYS) -> DataFrame:
    """Add the capture time and what to do with the file.

    A capture is a photograph: past its age it contributes nothing, and says so.
    """
    taken = dates.iso_time(F.col("captured_at"))
    age = dates.age_in_days(F.col("taken"), now)
    corrupt = F.col("_corrupt_record").isNotNull() if "_corrupt_record" in files.columns else F.lit(False)
    return files.withColumn("taken", taken).withColumn(
        "status",
        F.when(corrupt, "unreadable").when(F.col("taken").isNull(), "no capture time")
        .when(age > max_age_days, "too old").otherwise("usable"),
    )


def file_counts(checked: DataFrame) -> DataFrame:
    """Files per outcome; every file that could be parsed counts as read."""
    return checked.groupBy("status").agg(F.count(F.lit(1)).alias("files"))


def rows_of(checked: DataFrame) -> DataFrame:
    usable = checked.filter(F.col("status") == "usable")
    return usable.select("path", "taken", "site", F.posexplode("results").alias("pos", "row"))


def postings_from(rows: DataFrame, board: str = vocab.BOARD_CAPTURE, *keep: str) -> DataFrame:
    """Capture rows as postings; one without a key, title or date, and one
    marked expired, is dropped."""
    row = F.col("row")
    key, site = row["jobkey"], F.coalesce(blank_to_null(F.col("site")), F.lit(vocab.CAPTURE_SITE))
    out = rows.select(
        *keep,
        F.lit(board).alias("source"),
        key.alias("source_id"),
        row_id(F.lit(board), key).alias("uid"),
        strip(F.coalesce(row["title"], F.lit(""))).alias("title"),
        strip(F.coalesce(row["company"], F.lit(""))).alias("company"),
        link_or_canonical(row["url"], site, key).alias("url"),
        dates.posted_time(row["date_posted"], row["pub_date"]).alias("posted"),
        dates.iso_time(row["valid_through"]).alias("expires"),
        strip_html(row["description"]).alias("description"),
        regions.country_regions(row["country"]).alias("location_restrictions"),
        money.structured_pay(row).alias("_pay"),
        F.coalesce(row["expired"], F.lit(False)).alias("_expired"),
    )
    usable = (
        (F.col("source_id") != "") & ~F.col("_expired") & (F.col("title") != "") & F.col("posted").isNotNull()
    )
    return out.filter(usable).select(
        *[c for c in out.columns if not c.startswith("_")],
        excerpt(F.col("description"), 600).alias("excerpt"), "_pay.*",
    )


def newest_copies(postings: DataFrame) -> DataFrame:
    """Of one key in several captures, the newest copy that could be read.

    The rows were filtered before, so a bad copy in the newest capture cannot
    shadow a good older one.
    """
    newest = W.partitionBy("source", "source_id").orderBy(F.desc("taken"), "path", "pos")
    return postings.withColumn("_n", F.row_number().over(newest)).filter(F.col("_n") == 1).drop("_n")


def fetch(rows: DataFrame, since: Column, board: str = vocab.BOARD_CAPTURE) -> DataFrame:
    """Postings since a time.  The time is applied after the copies are
    settled: an older copy must not come back because the newest is too old."""
    keep = ["path", "taken", "pos"]
    return newest_copies(postings_from(rows, board, *keep)).filter(F.col("posted") >= since)


def read_captures(spark: SparkSession, path: str, since: Column, now: Column,
                  board: str = vocab.BOARD_CAPTURE) -> DataFrame:
    rows = rows_of(with_freshness(read_files(spark, path), now))
    return as_posting(with_order(fetch(rows, since, board), "path", "pos"))
