"""Which files of a folder could be read, and what that says of a board."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def listing(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """The files of a folder by name; none of them is opened."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path)
    return found.select(F.col("_metadata.file_path").alias("file"))


def states(files: DataFrame, records: DataFrame) -> DataFrame:
    """Each file as read, bad (some record of it is none) or empty (nothing came of it).

    ``records`` has (file, bad), a row for each record that the reader saw.  The
    listing is the measure: a file the reader passed over is there as empty.
    """
    seen = records.groupBy("file").agg(F.max("bad").alias("_bad"))
    state = F.when(F.col("_bad").isNull(), "empty").when(F.col("_bad"), "bad").otherwise("read")
    return files.join(seen, "file", "left").select("file", state.alias("state"))


def board_states(by_file: DataFrame) -> DataFrame:
    """Per board how many files were read, bad and empty; a board is well while one could be read or none was bad."""
    count = {state: F.count_if(F.col("state") == state) for state in ("read", "bad", "empty")}
    out = by_file.groupBy("source").agg(F.count(F.lit(1)).alias("files"), *[c.alias(n) for n, c in count.items()])
    return out.withColumn("ok", (F.col("read") > 0) | (F.col("bad") == 0))
