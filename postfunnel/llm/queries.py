"""One registered query per operator, over its whole table with production parameters."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from postfunnel.llm import align, chat, decontaminate, hyperminhash, jaccard, lines, lm, packing, periods, shards, topk, toxicity, urls
from postfunnel.llm.catalog import query
from postfunnel.llm.common import table, written

TOXIC_AT = 0.7
SHARDS = 40
CAPACITY = 4096


def vocabulary() -> str:
    """The public word vocabulary of the packing contract."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def remainder(doc_id: Column, by: int) -> Column:
    return F.crc32(doc_id.cast("string")) % by


@query("op1_benchmark_decontamination")
def benchmark_decontamination(spark, d):
    return decontaminate.find_leaks(table(spark, d, "documents"), table(spark, d, "benchmark"))


@query("op2_toxicity")
def toxicity_scores(spark, d):
    held_out = F.coalesce(remainder(F.col("doc_id"), 3) == 1, F.lit(False))
    docs = table(spark, d, "documents").select("doc_id", "text")
    scored = toxicity.score_toxicity(docs, table(spark, d, "labels"), held_out)
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= TOXIC_AT).cast("int").alias("predicted"))


@query("op3_chat_formatting")
def chat_formatting(spark, d):
    rows = table(spark, d, "conversations").select("conv_id", "turn", "role", "text")
    ok = F.lit("</s>[INST] ok [/INST]")
    more = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
                                 F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), ok.alias("text"))
    back = chat.read_back(chat.format_chats(rows.unionByName(more)))
    line = F.lit("\n")
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], line, t["text"], line)), "")
    loss = F.array_join("targets", "")
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(F.encode(told, "UTF-8"), 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"), F.sha2(F.encode(loss, "UTF-8"), 256).alias("loss_sha256"), "formatted_chars")


_KEY = "translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


@query("op4_line_dedup", f"""
    WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS a FROM documents),
    l AS (SELECT r, doc_id, unnest(a) AS line, generate_subscripts(a, 1) AS pos FROM d),
    k AS (SELECT r, doc_id, pos, line, {_KEY} AS key FROM l),
    f AS (SELECT key FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10),
    m AS (SELECT r, pos, line, key IN (SELECT key FROM f) AS gone FROM k)
    SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
      sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
    FROM m JOIN d USING (r) GROUP BY r""")
def line_dedup(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    return lines.drop_shared_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2(F.encode("kept_text", "UTF-8"), 256).alias("kept_sha256"))


URL_RULES = [
    ("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"), ("com", "/de/", "block"),
]


@query("op5_url_filters")
def url_filters(spark, d):
    return urls.judge_urls(table(spark, d, "pages"), URL_RULES).select("page_id", "host", "path", "rule", "verdict")


@query("op6_lm_scoring")
def lm_scoring(spark, d):
    return lm.score_texts(table(spark, d, "documents"), remainder(F.col("doc_id"), 7) == 2)


@query("op7_best_fit_packing")
def best_fit_packing(spark, d):
    return packing.pack(packing.cut(table(spark, d, "documents"), vocabulary(), capacity=CAPACITY), CAPACITY)


@query("op8_sharding")
def sharding(spark, d):
    return shards.assign_shards(table(spark, d, "documents"), SHARDS)


@query("op9_ngram_jaccard_join")
def ngram_jaccard_join(spark, d):
    return jaccard.near_duplicates(table(spark, d, "documents")).select("doc_id", "n_shingles", "component_id")


@query("op10_exact_topk_search", """
    WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v FROM embeddings
      WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
    SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5""")
def exact_topk_search(spark, d):
    return topk.top_k(table(spark, d, "embeddings"), F.col("vec_id") % 50 == 0)


def with_planted_runs(docs):
    """doc_id and text; of each tenth row the words from a place on repeat the first ones from there."""
    words = F.regexp_extract_all("text", F.lit(r"([^\x20\x09-\x0D]+)"), 1)
    n = F.size("words")
    rows = docs.select("doc_id", "text", F.crc32(F.col("doc_id").cast("string")).alias("h"))
    rows = rows.withColumn("words", F.when(F.col("h") % 10 == 0, words))
    g = F.floor(F.col("h") / 10)
    rows = rows.withColumn("a", F.when(n > 0, (g % n).cast("int")))
    rows = rows.withColumn("p", (1 + F.floor((n - F.col("a")) / (3 + g % 8))).cast("int"))
    turns = F.ceil((n - F.col("a")) / F.col("p")).cast("int")
    cycle = F.flatten(F.array_repeat(F.slice("words", F.col("a") + 1, F.col("p")), turns))
    told = F.array_join(F.slice(F.concat(F.slice("words", F.lit(1), F.col("a")), cycle), F.lit(1), n), " ")
    return rows.select("doc_id", F.when(n > 0, told).otherwise(F.col("text")).alias("text"))


@query("op12_periodic_run_detection")
def periodic_run_detection(spark, d):
    found = periods.find_runs(with_planted_runs(table(spark, d, "documents")))
    line = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    # a / b > c / d as a d > c b: exact whole numbers.
    best = F.reduce("runs", F.get("runs", F.lit(0)), lambda m, r: F.when(r["length"] * m["period"] > m["length"] * r["period"], r).otherwise(m))
    found = found.withColumn("best", best)
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.floor(1000 * F.col("best.length") / F.col("best.period")).alias("exponent_milli"),
        F.sha2(F.concat(F.array_join(line, "\n"), F.when(F.size("runs") > 0, "\n").otherwise("")), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"))


def tokenizers() -> align.Tokenizers:
    """The public vocabularies of the alignment contract."""
    import public_tokenizers

    return align.Tokenizers(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN, public_tokenizers.path("piece_bpe_32k.model"))


@query("op11_cross_tokenizer_alignment")
def cross_tokenizer_alignment(spark, d):
    aligned = align.align(table(spark, d, "documents"), tokenizers())
    digest = F.when(F.col("n_groups") > 0, F.sha2("groups", 256)).otherwise("")
    return align.score_links(written(aligned.withColumn("groups_sha256", digest).drop("groups"), "aligned"))


@query("op13_minhash_near_dedup")
def minhash_near_dedup(spark, d):
    found = hyperminhash.near_duplicates(table(spark, d, "documents"))
    return found.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))
