"""Line dedup: lines that many documents share are dropped from all of them.

Lines are exploded with their key's hash, distinct documents are counted per
hash, and what is left is put together again by position.  A key that a third
of all rows holds is counted by (key, document) first, so no task gets all of
its rows.  Only hashes and positions are shuffled per line, never line texts.

Defined results: a null or empty text is one empty line.  A repeated doc_id
counts once towards a key; rows without doc_id count towards none, but lose
lines like any other.  Equal rows get equal results.  Other columns pass
through unchanged, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from postfunnel.functions.text import let
from postfunnel.llm.common import written

#: What is stripped at both ends of a line: ASCII white space.
BLANKS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def split_lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    return F.translate(F.trim(line, F.lit(BLANKS)), UPPER, LOWER)


def _hash(key: Column) -> Column:
    """128 bits, as two hashes with different starts."""
    return F.struct(F.xxhash64(F.lit(17), key).alias("a"), F.xxhash64(F.lit(-23), key).alias("b"))


def _row(prefix: str) -> list[Column]:
    """What tells different rows apart: a hash of the id and the text."""
    return [F.xxhash64(F.lit(n), "doc_id", F.col("doc_id").isNull(), F.coalesce("text", F.lit(""))).alias(f"{prefix}{n}")
            for n in (1, 2)]


def frequent_lines(docs: DataFrame, min_docs: int, min_chars: int) -> DataFrame:
    """Hashes (h) of the keys that at least ``min_docs`` documents hold."""
    keys = docs.where("doc_id IS NOT NULL").select(
        "doc_id", F.explode(F.array_distinct(F.transform(split_lines(F.col("text")), line_key))).alias("key"))
    pairs = keys.where(F.length("key") >= min_chars).select(_hash(F.col("key")).alias("h"), "doc_id").distinct()
    return pairs.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_docs).select("h")


def drop_shared_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1) -> DataFrame:
    """The rows of ``docs`` with ``kept_text``, ``n_lines`` and ``n_dropped`` added."""
    shared = written(frequent_lines(docs, min_docs, min_chars), "frequent-lines")
    # A select of its own: beside the explode, the whole text would be hashed again for each of its lines.
    lines = docs.select(*_row("_k"), "text").select("_k1", "_k2", F.posexplode(split_lines(F.col("text"))).alias("_at", "_line"))
    dropped = (
        lines.withColumn("_line", line_key(F.col("_line"))).where(F.length("_line") >= min_chars)
        .select("_k1", "_k2", "_at", _hash(F.col("_line")).alias("h"))
        .join(shared, "h", "left_semi")
        .groupBy("_k1", "_k2").agg(F.collect_set("_at").alias("_gone"))
    )
    own = docs.select(*[F.col(f"`{c}`").alias(f"in_{n}") for n, c in enumerate(docs.columns)], F.col("text").alias("_text"), *_row("_k"))
    placed = own.join(dropped, ["_k1", "_k2"], "left")
    # Places are taken out by a hash set, once per text, however many go.
    left = let(split_lines(F.col("_text")), lambda own_lines: F.array_join(F.transform(
        F.array_except(F.sequence(F.lit(0), F.size(own_lines) - F.lit(1)), F.col("_gone")), lambda at: F.get(own_lines, at)), "\n"))
    kept = F.when(F.col("_gone").isNull(), F.coalesce("_text", F.lit(""))).otherwise(left)
    added = {"kept_text": kept, "n_lines": F.size(split_lines(F.col("_text"))).cast("long"),
             "n_dropped": F.coalesce(F.size("_gone"), F.lit(0)).cast("long")}
    return placed.select(
        *[F.col(f"in_{n}").alias(c) for n, c in enumerate(docs.columns) if c not in added],
        *[value.alias(name) for name, value in added.items()])
