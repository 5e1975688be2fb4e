"""The built-in readers, in the one shape ``boards.read_board`` expects."""

from __future__ import annotations

from pyspark.sql import functions as F

from postfunnel import vocab
from postfunnel.operators.numbering import with_order
from postfunnel.sources import boards, capture, cards, feed, files, markup, pages


def _feed(spark, path, since, now):
    return boards.since_watermark(feed.read_feed(spark, path), since)


def _captures(spark, path, since, now):
    return capture.read_captures(spark, path, since, now)


def _cards(spark, path, since, now):
    """A folder of saved result pages, one file per page."""
    saved = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("html"))
    rows = cards.postings_from(cards.cards_of(saved, "file"), vocab.BOARD_CARDS, "file", "pos")
    return boards.since_watermark(with_order(rows, "file", "pos"), since)


def _manual(spark, path, since, now):
    """A Parquet table of pages (url, html) that a person picked."""
    rows = pages.from_pages(spark.read.parquet(path).select("url", "html"), now)
    return with_order(rows, "uid", "title", "description")


def _capture_states(spark, path):
    bad = F.col("_corrupt_record").isNotNull() & F.col("results").isNull()
    records = capture.read_files(spark, path).select(F.col("path").alias("file"), bad.alias("bad"))
    return files.states(files.listing(spark, path, capture.PATTERN), records)


def _card_states(spark, path):
    saved = spark.read.text(path, wholetext=True)
    # A saved page is bad when it has no card: the markup has changed, or it is no result page.
    records = saved.select(F.col("_metadata.file_path").alias("file"), (~F.contains("value", F.lit(markup.CARD))).alias("bad"))
    return files.states(files.listing(spark, path), records)


for _board, _reader in {
    vocab.BOARD_FEED: _feed,
    vocab.BOARD_CAPTURE: _captures,
    vocab.BOARD_CARDS: _cards,
    vocab.BOARD_MANUAL: _manual,
}.items():
    boards.register(_board, _reader)

boards.STATES.update({vocab.BOARD_FEED: feed.file_states, vocab.BOARD_CAPTURE: _capture_states, vocab.BOARD_CARDS: _card_states})
