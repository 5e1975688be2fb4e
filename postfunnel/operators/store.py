"""The run's own tables: what was scored, asked, rejected, and when it ran.

A table is a folder of versions.  Writing makes a new version next to the ones
that are being read and then appends its number to a small pointer table, so a
job that dies half way leaves the current rows untouched.
"""

from __future__ import annotations

import json

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F, types as T

from postfunnel import vocab


class VersionedTable:
    """A Parquet table whose parts are replaced one version at a time.

    ``part`` is an expression that names the part a row belongs to, such as its
    board and month.  An upsert then rewrites only the parts that hold an old
    copy of a new row or receive a new one; all others are not even read,
    except for their keys.  Without it the table is one part.
    """

    def __init__(self, spark: SparkSession, root: str, part: Column | None = None, key: str = "uid"):
        self.spark, self.root, self.key = spark, root.rstrip("/"), key
        # Rows that name no part have one of their own.
        self.part = F.lit("all") if part is None else F.coalesce(F.regexp_replace(part, "[^A-Za-z0-9._-]", "-"), F.lit("~none"))

    def _pointer(self, before: int | None = None) -> DataFrame | None:
        try:
            pointer = self.spark.read.parquet(f"{self.root}/pointer")
        except AnalysisException:
            return None
        return pointer if before is None else pointer.filter(F.col("version") < before)

    def _parts(self, before: int | None = None) -> dict[str, int]:
        """Current version of every part: as many rows as there are parts."""
        pointer = self._pointer(before)
        if pointer is None:
            return {}
        last = pointer.groupBy("part").agg(F.max(F.struct("version", "present")).alias("_last"))
        return {r.part: r._last.version for r in last.collect() if r._last.present}

    def version(self) -> int:
        pointer = self._pointer()
        return 0 if pointer is None else pointer.agg(F.max("version").alias("v")).first().v or 0

    def _rows(self, parts: dict[str, int]) -> DataFrame | None:
        paths = [f"{self.root}/data/version={version}/part={part}" for part, version in sorted(parts.items())]
        if not paths:
            return None
        reader = self.spark.read.option("basePath", f"{self.root}/data").option("mergeSchema", True)
        return reader.parquet(*paths).drop("version")

    def read(self, before: int | None = None) -> DataFrame | None:
        """The table, or None before anything was written."""
        rows = self._rows(self._parts(before))
        if rows is not None:
            return rows.drop("part")
        pointer = self._pointer(before)
        last = None if pointer is None else pointer.orderBy(F.desc("version")).first()
        return last and self.spark.createDataFrame([], T.StructType.fromJson(json.loads(last.columns)))

    def _publish(self, rows: DataFrame, touched: set[str], version: int) -> None:
        path = f"{self.root}/data/version={version}"
        rows.withColumn("part", self.part).write.mode("overwrite").partitionBy("part").parquet(path)
        written = self.spark.read.option("basePath", path).schema("part string").parquet(path)
        present = {r.part for r in written.select("part").distinct().collect()}
        columns = rows.schema.json()
        pointers = [(version, part, part in present, columns) for part in sorted(touched | present) or ["all"]]
        self.spark.createDataFrame(
            pointers, "version int, part string, present boolean, columns string"
        ).coalesce(1).write.mode("append").parquet(f"{self.root}/pointer")

    def replace(self, rows: DataFrame, version: int | None = None) -> None:
        """Put ``rows`` in the place of all there is."""
        new = self.version() + 1 if version is None else version
        self._publish(rows, set(self._parts(new)), new)

    def upsert(self, rows: DataFrame, merge, version: int | None = None) -> None:
        """Merge new rows in.  Writing a version again (a replayed batch) starts
        from what was there before it, so the result is the same."""
        new = self.version() + 1 if version is None else version
        parts = self._parts(new)
        old = self._rows(parts)
        if old is None:
            return self._publish(merge(rows.limit(0), rows), set(), new)
        held = old.join(rows.select(self.key), self.key, "left_semi").select("part")
        given = rows.select(self.part.alias("part"))
        touched = {r.part for r in held.union(given).distinct().collect()}
        if not touched:
            return None  # nothing came in
        kept = self._rows({p: v for p, v in parts.items() if p in touched})
        merged = rows if kept is None else merge(kept.drop("part"), rows)
        return self._publish(merged, touched, new)


def latest(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The last row of every key; each partition drops the others before the
    shuffle, so many copies of one key stay cheap."""
    window = W.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(window)).filter(F.col("_n") == 1).drop("_n")


def upsert_rows(old: DataFrame, new: DataFrame, key: str = "uid", order: list[Column] | None = None) -> DataFrame:
    """Whole-row replace: nothing of the old row survives, not even its age.
    Columns either side lacks are added as null, and none is dropped."""
    kept = old.join(new.select(key), key, "left_anti")
    return kept.unionByName(settled(new, key, order), allowMissingColumns=True)


def settled(new: DataFrame, key: str = "uid", order: list[Column] | None = None) -> DataFrame:
    """One row of each key: the first in ``order``, or, where rows come in none,
    the greatest by its columns from left to right, so that a replay picks the same."""
    return latest(new, [key], order or [F.desc_nulls_last(c) for c in new.columns if c != key] or [F.lit(0)])


def replace_asks(old: DataFrame, jobs: DataFrame, asks: DataFrame) -> DataFrame:
    """The asks of every re-scored job are replaced, also by none at all; of
    two with one kind the one written last stays."""
    kept = old.join(jobs.select("uid"), "uid", "left_anti")
    new = latest(asks, ["uid", "kind"], [F.desc("position")]).drop("position")
    return kept.unionByName(new, allowMissingColumns=True)


def stored_jobs(priced: DataFrame, run_id: int, now: Column) -> DataFrame:
    """Survivors in the stored shape, whatever their score."""
    return priced.select(
        "uid", "source", "title", "company", "url", F.col("posted").alias("posted_at"),
        F.col("location_restrictions").alias("regions"), "salary_signal", "score", "verdict", "why",
        "cv_variant", "description", F.lit(run_id).alias("run_id"), now.alias("created_at"),
        "score_raw", F.sort_array("blockers").alias("blockers"),
    )


def stored_asks(priced: DataFrame) -> DataFrame:
    rows = priced.select("uid", "blockers", F.posexplode("requirements").alias("position", "r"))
    return rows.select(
        "uid", F.col("r.kind").alias("kind"), F.col("r.mandatory").alias("mandatory"),
        F.coalesce("r.detail", F.lit("")).alias("detail"),
        F.array_contains("blockers", F.col("r.kind")).alias("blocking"), "position",
    )


def stored_rejects(tagged: DataFrame, run_id: int) -> DataFrame:
    """One row per (uid, run): of a uid that was rejected twice, the last."""
    rows = tagged.filter(F.col("rejected_by").isNotNull())
    last = latest(rows, ["uid"], [F.desc("arrival")])
    return last.select(
        "uid", F.col("rejected_by").alias("stage"), "reason", "title",
        F.col("posted").alias("posted_at"), F.lit(run_id).alias("run_id"),
    )


def append_rejects(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").partitionBy("stage").parquet(path)


def append_digest(rows: DataFrame, path: str, when: Column) -> None:
    """Digest rows of a run are added to the day's, never put in their place."""
    rows.withColumn("day", F.to_date(when)).write.mode("append").partitionBy("day").parquet(path)


def run_ledger(events: DataFrame) -> DataFrame:
    """The current state of each run from its opening and closing rows."""
    return latest(events, ["run_id"], [F.desc("event_no")])


def last_run(ledger: DataFrame) -> DataFrame:
    return ledger.orderBy(F.desc("run_id")).limit(1)


def next_since(ledger: DataFrame, now: Column) -> DataFrame:
    """Where the next run starts reading: the last good run's start, neither
    too long ago nor too recent; the very first run looks back a fixed time."""
    def hours(n: int) -> Column:
        return F.make_dt_interval(hours=F.lit(n))

    floor, ceiling = now - hours(vocab.MAX_LOOKBACK_HOURS), now - hours(vocab.MIN_LOOKBACK_HOURS)
    last = ledger.agg(F.max_by("started_at", F.when(F.col("ok"), F.col("run_id"))).alias("last"))
    return last.select(
        F.coalesce(
            F.when(F.col("last").isNotNull(), F.greatest(floor, F.least(F.col("last"), ceiling))),
            now - hours(vocab.FIRST_RUN_LOOKBACK_HOURS),
        ).alias("since")
    )


def results_as_json(priced: DataFrame) -> DataFrame:
    """A run's results as one JSON text per row."""
    fields = ["uid", "title", "company", "url", F.col("location_restrictions").alias("regions"),
              "salary_signal", "score", "score_raw", "verdict", "why", "cv_variant", "blockers"]
    return priced.select("uid", F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias("json"))
