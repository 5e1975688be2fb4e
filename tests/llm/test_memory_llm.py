"""What a Python worker holds at a time."""

from __future__ import annotations

import tracemalloc

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

import corpus_pipeline
from postfunnel.llm import common


def test_hashing_a_long_text_holds_little_beside_it():
    texts = pa.array(["some words " * 500_000, None, "x" * (3 * common.HASH_BYTES) + " END", ""])
    data, starts, ends, bounds = common.word_spans(texts)
    tracemalloc.start()
    got = common.hash_spans(data, starts, ends)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    # The hashes themselves, what mix() works with, and tables as long as the longest word or stretch.
    assert peak < 8 * 8 * len(starts) + 8 * 8 * 3 * common.HASH_BYTES < 8 * 10 * len(data)
    some, words = common.word_hashes(pa.array(["some", "words"]))[0]
    assert (got[:1_000_000:2] == some).all() and (got[1:1_000_000:2] == words).all()
    assert (got[1_000_000:] == np.concatenate([common.word_hashes(pa.array([t]))[0] for t in ("X" * (3 * common.HASH_BYTES), "end")])).all()
    assert bounds.tolist() == [0, 1_000_000, 1_000_000, 1_000_002, 1_000_002]


def test_stages_get_batches_bounded_by_bytes(spark, monkeypatch):
    def sizes(batches):
        for batch in batches:
            yield batch.set_column(batch.schema.get_field_index("text"), "text", pa.array([str(batch.nbytes)] * batch.num_rows))

    text = F.repeat(F.lit("word "), 1 << 16)  # 320 KB
    docs = spark.range(40).coalesce(1).select(F.col("id").alias("doc_id"), text.alias("text"))
    seen = {}
    monkeypatch.setattr(corpus_pipeline.packing, "cut", lambda docs, *a, **b: docs)
    monkeypatch.setattr(corpus_pipeline.packing, "pack", lambda docs, *a: docs.mapInArrow(sizes, docs.schema))
    for name, stage in (("aside", corpus_pipeline._aside(lambda s, d, _: d.mapInArrow(sizes, d.schema))), ("pack", corpus_pipeline.pack)):
        spark.conf.unset(common.BATCH_KEY)
        seen[name] = [(r["doc_id"], int(r["text"])) for r in stage(spark, docs, "").collect()]
    for rows in seen.values():
        assert sorted(d for d, _ in rows) == list(range(40))
        assert max(n for _, n in rows) < (4 << 20) + (1 << 19)
    # A session's own bound stays.
    spark.conf.set(common.BATCH_KEY, "1m")
    assert common.bound_batches(spark).conf.get(common.BATCH_KEY) == "1m"
    spark.conf.unset(common.BATCH_KEY)
