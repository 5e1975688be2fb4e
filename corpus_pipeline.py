"""A corpus from raw documents to packed sequences: five stages, each written and read again.

Every stage but the last returns the columns of its documents.  Columns beyond
the known ones are set aside under neutral names while a stage works, so that
none of them can clash with a name of its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from postfunnel.llm import decontaminate, jaccard, lines, packing, toxicity
from postfunnel.llm.common import bound_batches, table, written
from postfunnel.llm.queries import CAPACITY, TOXIC_AT, remainder, vocabulary

KNOWN = ("doc_id", "text", "lang", "source", "n_chars")


def _aside(stage):
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        neutral = [c if c in KNOWN else f"set_aside_{n}" for n, c in enumerate(docs.columns)]
        return stage(bound_batches(spark), docs.toDF(*neutral), sf_dir).select(neutral).toDF(*docs.columns)
    run.__doc__ = stage.__doc__
    return run


@_aside
def drop_toxic(spark, docs, sf_dir):
    """Documents scored as toxic go."""
    held_out = F.coalesce(remainder(F.col("doc_id"), 3) == 1, F.lit(False))
    return toxicity.score_toxicity(docs, table(spark, sf_dir, "labels"), held_out).where(F.col("score") < TOXIC_AT)


@_aside
def drop_lines(spark, docs, sf_dir):
    """Lines that ten documents share go; n_chars follows the text."""
    out = lines.drop_shared_lines(docs).withColumn("text", F.col("kept_text"))
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


@_aside
def drop_near_duplicates(spark, docs, sf_dir):
    """Of every group of near duplicates the document with the least doc_id stays."""
    return jaccard.keep_first(docs)


@_aside
def drop_leaks(spark, docs, sf_dir):
    """Documents that leak a benchmark item go."""
    return decontaminate.drop_leaking(docs, table(spark, sf_dir, "benchmark"))


def pack(spark, docs, sf_dir):
    """The pieces of all that is left, packed."""
    bound_batches(spark)
    return packing.pack(packing.cut(docs, vocabulary(), capacity=CAPACITY), CAPACITY)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_lines),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_leaks),
    ("packing", pack),
]

#: Scores, similarity joins and token ids are beyond SQL; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
