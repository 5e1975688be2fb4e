"""Putting the boards' rows together: capabilities, selection, failures, walks."""

from __future__ import annotations

from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from postfunnel import vocab
from postfunnel.operators.numbering import with_position
from postfunnel.schema import as_posting
from postfunnel.sources import files

# A reader takes (spark, path, since, now) and returns posting rows.  A board
# of one's own is one more entry.
READERS: dict = {}
# How to tell, for a board read from files, which of them could be read: takes (spark, path).
STATES: dict = {}
_STATUS = "source string, files long, read long, bad long, empty long, ok boolean, error string"


def register(board: str, reader) -> None:
    READERS[board] = reader


def read_board(spark: SparkSession, board: str, path: str, since: Column, now: Column) -> DataFrame:
    if board not in READERS:
        raise ValueError(f"no source named {board!r}; known: {', '.join(sorted(READERS))}")
    return as_posting(READERS[board](spark, path, since, now))


def union_boards(frames: list[DataFrame]) -> DataFrame:
    """All boards in one frame; a column a board lacks is null there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def read_boards(spark: SparkSession, inputs: list[tuple[str, str]], since: Column, now: Column) -> tuple[DataFrame, DataFrame]:
    """The rows of all boards that can be read, and the status of each board.

    ``inputs`` are (board, path), in the order in which their rows arrive; the
    arrival is unique over all boards and the same however files are split.  A
    board that cannot be read gives no rows and its error; a broken file of a
    board is counted and costs no other's rows.
    """
    frames, states, errors = [], [], []
    for rank, (board, path) in enumerate(inputs):
        try:
            rows = read_board(spark, board, path, since, now)
            state = STATES[board](spark, path).withColumn("source", F.lit(board)) if board in STATES else None
        except (AnalysisException, ValueError) as problem:
            errors.append((board, 0, 0, 0, 0, False, str(problem).splitlines()[0][:500]))
            continue
        frames.append(rows.withColumn("_rank", F.lit(rank)))
        if state is None:
            errors.append((board, 0, 0, 0, 0, True, None))
        else:
            states.append(state)
    status = spark.createDataFrame(errors, _STATUS)
    if states:
        told = F.when(F.col("bad") > 0, F.format_string("%d of %d files bad", "bad", "files"))
        status = status.unionByName(files.board_states(union_boards(states)).withColumn("error", told))
    if not frames:
        return as_posting(spark.createDataFrame([], "arrival long")), status
    rows = with_position(union_boards(frames), "arrival", ("_rank",))
    return as_posting(rows.withColumn("arrival", F.col("position"))), status


def with_capabilities(postings: DataFrame, capabilities: DataFrame) -> DataFrame:
    """What each board can be trusted on; an undeclared flag takes its default.

    ``capabilities`` has one row per board.  It is joined without a hint: a
    declared list is small and known to be, so the planner broadcasts it.
    """
    flags = [c for c in vocab.CAPABILITY_DEFAULTS if c in capabilities.columns]
    rows = postings.join(capabilities.select("source", *flags), "source", "left")
    for flag, default in vocab.CAPABILITY_DEFAULTS.items():
        value = F.coalesce(flag, F.lit(default)) if flag in flags else F.lit(default)
        rows = rows.withColumn(flag, value)
    return rows


def since_watermark(postings: DataFrame, since: Column) -> DataFrame:
    """Inclusive, and a plain comparison so that it reaches the file scan."""
    return postings.filter(F.col("posted") >= since)


def only_source(postings: DataFrame, name: str, known: list[str]) -> DataFrame:
    if name not in known:
        raise ValueError(f"no source named {name!r}; known: {', '.join(sorted(known))}")
    return postings.filter(F.col("source") == name)


def walk(rows: DataFrame, since: Column, page_cap: int | None = None) -> DataFrame:
    """Rows a page-by-page read would have reached.

    Pages are newest first.  The read takes pages up to and including the first
    one without a row since the time (or a given last page) and keeps the rows since it.
    ``rows`` has (source, page_no from 1, posted).
    """
    reached = _pages(rows, since, page_cap).filter("reached").select("source", "page_no")
    return rows.filter(F.col("posted") >= since).join(reached, ["source", "page_no"], "left_semi")


def walk_ends(rows: DataFrame, since: Column, page_cap: int) -> DataFrame:
    """Per board: pages read, and whether the cap ended the read too early."""
    pages = _pages(rows, since, page_cap).filter("reached")
    return pages.groupBy("source").agg(
        F.max("page_no").alias("pages"),
        F.max((F.col("page_no") == page_cap) & F.col("fresh")).alias("hit_page_cap"),
    )


def _pages(rows: DataFrame, since: Column, page_cap: int | None) -> DataFrame:
    """Each page of each board up to a given last one, whether it holds a fresh
    row, and whether the read gets to it (all pages before it did)."""
    pages = (
        (rows if page_cap is None else rows.filter(F.col("page_no") <= page_cap)).groupBy("source", "page_no")
        .agg(F.max(F.col("posted") >= since).alias("fresh"))
    )
    before = W.partitionBy("source").orderBy("page_no")
    earlier = before.rowsBetween(W.unboundedPreceding, -1)
    all_fresh = F.coalesce(F.min("fresh").over(earlier), F.lit(True))
    # An empty page ends the read too, so the page numbers must have no gap.
    unbroken = F.row_number().over(before) == F.col("page_no")
    return pages.withColumn("reached", all_fresh & unbroken)


def source_status(rows: DataFrame, failed: Column) -> DataFrame:
    """Per board: usable and unusable records, and whether it delivered at all.
    One board's failure never costs another's rows."""
    return rows.groupBy("source").agg(
        F.count_if(~failed).alias("rows"),
        F.count_if(failed).alias("bad_rows"),
        F.max(~failed).alias("ok"),
    )


def run_ok(status: DataFrame) -> DataFrame:
    """A run is bad only if every board failed."""
    return status.agg(F.bool_or("ok").alias("ok"), F.count_if(~F.col("ok")).alias("failed_sources"))
