"""Incremental ingest: each run takes what is new since the last one.

The checkpoint is the watermark of the runs: a day that was missed is caught
up, a run that failed is read again.  Results carry their batch number, and a
batch that is replayed writes the same folder again, so nothing is counted
twice whenever an executor or the driver is lost.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery

from postfunnel.operators import funnel
from postfunnel.operators.store import VersionedTable, latest, upsert_rows
from postfunnel.policy import Profile


def file_stream(spark: SparkSession, path: str, schema: T.StructType | None = None,
                files_per_batch: int | None = None, bytes_per_batch: int | None = None) -> DataFrame:
    """New Parquet files of a folder; the size of a batch bounds its memory."""
    reader = spark.readStream.schema(schema or spark.read.parquet(path).schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    if bytes_per_batch:
        reader = reader.option("maxBytesPerTrigger", bytes_per_batch)
    return reader.parquet(path)


def run_available(rows: DataFrame, process, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Process all that is there now, batch by batch, then stop."""
    query = (
        rows.writeStream.foreachBatch(process).outputMode(mode)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return query


def append_available(rows: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """The same for a stream whose rows are only ever added to."""
    query = (
        rows.writeStream.format("parquet").outputMode("append").option("path", path)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return query


class FunnelRun:
    """Postings through the funnel into one results table.

    A row counts as seen once its batch is written, never before: a batch that
    fails half way leaves nothing behind and is read again.
    """

    def __init__(self, spark: SparkSession, root: str, profile: Profile, now: Column,
                 rescore: bool = False):
        self.spark, self.root = spark, root.rstrip("/")
        self.profile, self.now, self.rescore = profile, now, rescore

    @property
    def path(self) -> str:
        return f"{self.root}/results"

    def results(self, before: int | None = None) -> DataFrame | None:
        try:
            rows = self.spark.read.parquet(self.path)
        except AnalysisException:
            return None
        return rows if before is None else rows.filter(F.col("batch") < before)

    def process(self, batch: DataFrame, batch_id: int) -> None:
        # Of two copies in one batch the later one, also when it is replayed.
        rows = latest(batch, ["uid"], [F.desc("arrival")])
        earlier = self.results(before=batch_id)
        if earlier is not None and not self.rescore:
            rows = funnel.unseen(rows, earlier)
        tagged = funnel.tag(rows, self.profile, self.now)
        tagged.withColumn("outcome", F.when(F.col("rejected_by").isNull(), "survivor").otherwise("reject")) \
            .write.mode("overwrite").partitionBy("outcome").parquet(f"{self.path}/batch={batch_id}")

    def run(self, postings: DataFrame) -> DataFrame:
        run_available(postings, self.process, f"{self.root}/checkpoint")
        return self.results()


def upsert_available(rows: DataFrame, table: VersionedTable, checkpoint: str, merge=upsert_rows,
                     mode: str = "append") -> DataFrame:
    """Fold a stream into a table; a batch's number is the version it writes."""
    def process(batch: DataFrame, batch_id: int) -> None:
        table.upsert(batch, merge, version=batch_id + 1)

    run_available(rows, process, checkpoint, mode)
    return table.read()


def without_repeats(rows: DataFrame, key: str, event_time: str, delay: str) -> DataFrame:
    """Each key once, as long as its copies arrive within the delay.  State is
    dropped after it; older copies are caught by the stored history."""
    return rows.withWatermark(event_time, delay).dropDuplicatesWithinWatermark([key])


def stage_counters(rows: DataFrame, event_time: str, stage: str, delay: str = "2 days") -> DataFrame:
    """Rows per day and stage; rows later than the delay are not counted."""
    return (
        rows.withWatermark(event_time, delay)
        .groupBy(F.window(event_time, "1 day").alias("day"), F.col(stage).alias("stage"))
        .agg(F.count(F.lit(1)).alias("n"))
        .select(F.col("day.start").alias("day"), "stage", "n")
    )


def replace_counters(old: DataFrame, new: DataFrame) -> DataFrame:
    """A counter sent again replaces the one it grew from."""
    kept = old.join(new.select("day", "stage"), ["day", "stage"], "left_anti")
    return kept.unionByName(new)
