"""The pipeline's stages, one after the other, on the smallest tables."""

from __future__ import annotations

from pyspark.sql import functions as F

import brute
import corpus_pipeline
from postfunnel.llm.common import table, written

D = "/root/testdata/sf0.001"


def test_stages_act_on_what_is_left(spark):
    docs = table(spark, D, "documents").withColumn("score", F.lit("own")).withColumn("h", F.lit(1))
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        out = written(stage(spark, docs, D), f"test-{name}")
        seen[name] = (docs, out)
        if name != "packing":
            assert out.columns == docs.columns and {r[0] for r in out.select("score").distinct().collect()} <= {"own"}
        docs = out
    before, after = ([(r["doc_id"], r["text"]) for r in f.collect()] for f in seen["line_dedup"])
    assert sorted(after) == sorted((d, t) for d, _, _, t in brute.drop_lines(before))
    assert seen["line_dedup"][1].where("n_chars <> length(text)").isEmpty()
    before, after = ([(r["doc_id"], r["text"]) for r in f.collect()] for f in seen["near_duplicates"])
    assert sorted(d for d, _ in after) == sorted({c for _, _, c in brute.components(before)})
    assert seen["decontamination"][1].count() < seen["decontamination"][0].count()
    assert {r[0] for r in docs.select("doc_id").collect()} == {r[0] for r in seen["decontamination"][1].select("doc_id").collect()}


def test_run_on_empty_tables(spark, tmp_path):
    for name in ("documents", "labels", "benchmark"):
        table(spark, D, name).limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_nulls_do_not_end_a_stage(spark):
    docs = spark.createDataFrame([(None, None, None, None, None), (1, None, "en", "s", None), (2, "", None, None, 0), (2, "", None, None, 0), (3, "x\ny", "en", "s", 3)],
                                 "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, D), f"nulls-{name}")
    assert docs.count() >= 4
