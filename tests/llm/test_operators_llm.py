"""The operators against plain Python versions, on edge cases and on the smallest tables."""

from __future__ import annotations

import collections
import hashlib
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import brute
from postfunnel.llm import chat, components, decontaminate, jaccard, lines, lm, meet, packing, queries, shards, topk, toxicity, urls
from postfunnel.llm.common import table

D = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string"


def words(n, seed, size=400):
    own = random.Random(seed)
    return " ".join(f"w{own.randrange(size)}" for _ in range(n))


def edge_docs():
    """Nulls, empties, a very long text, ties, repeats, near copies."""
    base = words(120, 1).split()
    rows = [(1, None), (2, ""), (3, " \t\n"), (None, "no id here at all, really"), (None, None), (4, "A b"), (5, "a B"), (6, "a b c d e"),
            (7, " ".join(base)), (8, " ".join(base)), (9, " ".join([*base[:60], "x", *base[61:]])), (10, " ".join(base[:115])),
            (11, words(30_000, 5, 5000)), (12, "same"), (12, "same"), (13, "ü ß É é"), (14, "Ü SS é É")]
    for n in range(40):  # a chain of near copies
        rows.append((100 + n, " ".join(base[n:] + [f"y{m}" for m in range(n)])))
    return rows


def edge_frame(spark, rows=None):
    return spark.createDataFrame(edge_docs() if rows is None else rows, DOCS)


def test_line_dedup_matches_brute_force(spark):
    shared = ["Footer", " footer\t", "FOOTER\x0b", "ÀFOOTER"]
    rows = edge_docs() + [(200 + n, f"line {n}\n{shared[n % 3]}\n\n{shared[3]} {n}") for n in range(12)] + [(300, "footer\nfooter"), (None, "Footer\nx")]
    got = lines.drop_shared_lines(edge_frame(spark, rows)).select("doc_id", "n_lines", "n_dropped", "kept_text").collect()
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted(map(tuple, got), key=key) == sorted(brute.drop_lines(rows), key=key)


def test_line_dedup_keeps_other_columns_and_takes_an_empty_table(spark):
    docs = edge_frame(spark).withColumn("h", F.lit(1)).withColumn("key", F.lit("k"))
    out = lines.drop_shared_lines(docs)
    assert out.columns == ["doc_id", "text", "h", "key", "kept_text", "n_lines", "n_dropped"] and out.count() == docs.count()
    assert lines.drop_shared_lines(edge_frame(spark, [])).count() == 0


def test_line_dedup_of_many_dropped_lines(spark):
    own = F.transform(F.sequence(F.lit(0), F.lit(79_999)), lambda n: F.when(n % 40_000 == 7, F.concat_ws(" ", F.lit("own"), "doc_id", n)).otherwise(
        F.concat_ws(" ", F.lit("shared"), n)))
    docs = spark.range(10).withColumnRenamed("id", "doc_id").withColumn("text", F.array_join(own, "\n"))
    out = sorted(map(tuple, lines.drop_shared_lines(docs).select("doc_id", "n_lines", "n_dropped", "kept_text").collect()))
    assert out == [(n, 80_000, 79_998, f"own {n} 7\nown {n} 40007") for n in range(10)]


def test_jaccard_matches_brute_force_on_edges(spark):
    rows = edge_docs()
    got = jaccard.near_duplicates(edge_frame(spark, rows)).select("doc_id", "n_shingles", "component_id").collect()
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted(map(tuple, got), key=key) == sorted(brute.components(rows), key=key)
    assert jaccard.near_duplicates(edge_frame(spark, [])).count() == 0


def test_jaccard_matches_brute_force_on_a_table(spark):
    rows = [tuple(r) for r in table(spark, D, "documents").select("doc_id", "text").collect()]
    got = queries.ngram_jaccard_join(spark, D).collect()
    assert sorted(map(tuple, got)) == sorted(brute.components(rows))


def test_open_groups_are_handled_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(meet, "BLOCK", 3)
    rows = [tuple(r) for r in table(spark, D, "documents").select("doc_id", "text").collect()] + edge_docs()[8:]
    got = jaccard.near_duplicates(edge_frame(spark, rows)).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(map(tuple, got)) == sorted(brute.components(rows))


@pytest.mark.parametrize("seed", range(12))
def test_similar_sets_share_a_signature(seed):
    own = np.random.default_rng(seed)
    size = int(own.integers(1, 400))
    common = own.integers(1, 2 ** 63, size, dtype=np.uint64)
    sets = []
    for _ in range(2):  # as far apart as the threshold allows
        extra = own.integers(1, 2 ** 63, int(own.integers(0, max(1, size // 6) + 1)), dtype=np.uint64)
        sets.append(np.unique(np.concatenate((common, extra))))
    a, b = sets
    both = len(np.intersect1d(a, b))
    if 100 * both < 75 * (len(a) + len(b) - both):
        return
    sig, who, guest = jaccard.signatures(np.concatenate(sets), np.array([0, len(a), len(a) + len(b)]))
    own_band = set(sig[(who == 0) & ~guest]) & set(sig[who == 1]) | set(sig[who == 0]) & set(sig[(who == 1) & ~guest])
    assert own_band


def test_sets_similar_to_their_equals_only_have_no_signature():
    sets = np.random.default_rng(9).integers(1, 2 ** 63, 40 * (1 + 2 + 3), dtype=np.uint64)
    sizes = np.repeat([1, 2, 3], 40)
    _, who, _ = jaccard.signatures(sets, np.r_[0, np.cumsum(sizes)])
    assert set(who.tolist()) == set(range(80, 120))
    assert not len(jaccard.signatures(sets, np.arange(len(sets) + 1))[0])


def test_sketches_never_hide_a_link():
    own = np.random.default_rng(3)
    a = np.unique(own.integers(1, 2 ** 63, 3000, dtype=np.uint64))
    b = np.unique(np.concatenate((a[:2700], own.integers(1, 2 ** 63, 200, dtype=np.uint64))))
    left, right = jaccard.sketches(np.concatenate((a, b)), np.array([0, len(a), len(a) + len(b)]))
    assert jaccard.bits_apart([left], [right])[0] <= len(np.setxor1d(a, b))
    assert jaccard.bits_apart([jaccard._fold(left, 64)], [right])[0] <= len(np.setxor1d(a, b))


def test_near_copies_leave_one_of_each_group(spark):
    docs = edge_frame(spark).withColumn("text_hash", F.lit(0))
    out = jaccard.keep_first(docs)
    assert out.columns == docs.columns
    want = {c for d, _, c in brute.components(edge_docs()) if d is not None}
    ids = [r[0] for r in out.collect()]
    assert sorted(x for x in ids if x is not None) == sorted(want) and ids.count(None) == 2


def test_components_of_a_long_chain(spark):
    links = spark.range(200).select((F.col("id") * 7 % 211).alias("u"), ((F.col("id") + 1) * 7 % 211).alias("v"))
    got = {r[0]: r[1] for r in components.components(links).collect()}
    assert set(got.values()) == {min(got)} and len(got) == 201


ITEM = "the quick brown fox jumps over the lazy dog near the quiet river bank today"


@pytest.mark.parametrize("text, share", [
    (f"before {ITEM} after", 1.0), (ITEM.upper().replace(" ", ", "), 1.0), ("x " + " ".join(ITEM.split()[8:] + ["y"] + ITEM.split()[:8]), 1.0),
    (" ".join(ITEM.split()[:8]), 8 / 15), (" ".join(ITEM.split()[:7]), None), ("the quick brown dog jumps", None), (None, None), ("", None)])
def test_leaks(spark, text, share):
    items = spark.createDataFrame([(5, ITEM), (6, None), (7, ""), (8, "two words"), (None, ITEM)], "item_id long, text string")
    got = decontaminate.find_leaks(edge_frame(spark, [(1, text)]), items).collect()
    assert [(r["doc_id"], r["item_id"], r["coverage"]) for r in got] == ([(1, 5, share)] if share else [])


def test_leaks_by_blocks_of_items_and_empty_tables(spark):
    docs, items = table(spark, D, "documents"), table(spark, D, "benchmark")
    one = sorted(map(tuple, decontaminate.find_leaks(docs, items).collect()))
    assert one == sorted(map(tuple, decontaminate.find_leaks(docs, items, block_bytes=2000).collect()))
    flat = {r["item_id"]: " ".join(brute.words(r["text"])) for r in items.collect()}
    whole = {(r["doc_id"], i) for r in docs.collect() for i, t in flat.items() if t in " ".join(brute.words(r["text"]))}
    assert whole <= {(r[0], r[1]) for r in one}
    assert decontaminate.find_leaks(docs.limit(0), items).count() == 0 and decontaminate.find_leaks(docs, items.limit(0)).count() == 0
    assert {r["doc_id"] for r in docs.select("doc_id").collect()} - {r["doc_id"] for r in decontaminate.drop_leaking(docs, items).collect()} == {r[0] for r in one}


def test_tiles_are_longest_first_and_do_not_overlap():
    own = random.Random(4)
    for _ in range(60):
        item = np.array([own.randrange(6) for _ in range(own.randrange(1, 40))], np.uint64)
        text = np.array([own.randrange(6) for _ in range(own.randrange(1, 120))], np.uint64)
        tiles = decontaminate.tile(item, text, 3)
        used_i, used_t = set(), set()
        for n, i, t in tiles:
            assert (item[i:i + n] == text[t:t + n]).all() and n >= 3
            assert not used_i & set(range(i, i + n)) and not used_t & set(range(t, t + n))
            used_i |= set(range(i, i + n))
            used_t |= set(range(t, t + n))
        left_i = [i for i in range(len(item) - 2) if not used_i & set(range(i, i + 3))]
        left_t = [t for t in range(len(text) - 2) if not used_t & set(range(t, t + 3))]
        assert not any((item[i:i + 3] == text[t:t + 3]).all() for i in left_i for t in left_t)


def test_toxicity_learns_from_its_labels_only(spark):
    own = random.Random(2)
    rows, labels = [], []
    for n in range(600):
        bad = n % 6 == 0
        text = words(60, n).split() + [own.choice(["zgrim", "vlokken", "vlokter"])] * bad
        own.shuffle(text)
        rows.append((n, " ".join(text)))
        labels.append((n, int(bad)))
    rows += [(None, "zgrim zgrim vlokken"), (1000, None), (1001, "")]
    docs, frame = edge_frame(spark, rows), spark.createDataFrame(labels, "doc_id long, toxic int")
    held = queries.remainder(F.col("doc_id"), 3) == 1
    got = [tuple(r) for r in toxicity.score_toxicity(docs.withColumn("entry", F.lit(1)), frame, held).select("doc_id", "score").collect()]
    assert len(got) == len(rows) and all(0 <= s <= 1 for _, s in got)
    known = dict(labels)
    assert all((s >= 0.7) == bool(known.get(d, d is None)) for d, s in got)
    # Turned labels of held-out rows change nothing.
    turned = frame.withColumn("toxic", F.when(held, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert sorted(got, key=str) == sorted(((r[0], r[1]) for r in toxicity.score_toxicity(docs, turned, held).select("doc_id", "score").collect()), key=str)
    assert {r["score"] for r in toxicity.score_toxicity(docs, frame.limit(0), held).collect()} == {0.0}


def test_label_model_discounts_repeated_voters():
    # Two voters that always agree, one that is its own.
    masks = np.array([0b000, 0b011, 0b100, 0b111])
    post = toxicity.label_model(masks, np.array([900, 40, 10, 50]))
    assert post[0] < 0.5 < post[3] and post[3] >= post[1] and post[3] >= post[2]


def test_chats_read_back(spark):
    rows = [(1, 0, "system", "be <s>kind</s>"), (1, 1, "user", "a\\b <\\s> [INST]"), (1, 2, "assistant", "x " * 500), (1, 3, "assistant", "<<SYS>> \\\\ <</SYS>>"),
            (1, 4, "user", "u " * 900), (1, 5, "assistant", "é\n\n"), (2, 0, "system", "alone"), (3, None, None, None), (3, 1, "odd role\n", ""),
            (None, 0, "user", "no id"), (None, 1, "assistant", "y"), (4, 0, "assistant", "same"), (4, 0, "assistant", "same")]
    rows += [(5, n, ("user", "assistant")[n % 2], words(40, n)) for n in range(700)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("window", F.lit("w"))
    out = chat.format_chats(frame, budget=600, history_turns=2, history_tokens=120)
    windows = out.collect()
    assert all(w["tokens"] <= 600 or len(w["text"].split("</s>")) <= 4 for w in windows)
    assert all(c not in w["text"].replace("<s>", "").replace("</s>", "") for w in windows for c in ("[INST]", "<<SYS>>"))
    told = collections.defaultdict(list)
    for c, t, r, x in sorted(rows, key=lambda r: (str(r[0]), -1 if r[1] is None else r[1], r[2] or "", r[3] or "")):
        told[c].append((r or "", x or ""))
    back = chat.read_back(out).collect()
    assert {r["conv_id"]: [tuple(t) for t in r["turns"]] for r in back} == told
    assert {r["conv_id"]: r["targets"] for r in back} == {c: [x for r, x in t if r == "assistant"] for c, t in told.items()}
    assert any(w["n_repeated"] > 0 for w in windows) and max(w["window"] for w in windows if w["conv_id"] == 5) > 10


def test_registered_chats(spark):
    told = collections.defaultdict(list)
    for r in table(spark, D, "conversations").orderBy("conv_id", "turn").collect():
        told[r["conv_id"]].append((r["role"], r["text"] or ""))
    told[-7] = [(r, "</s>[INST] ok [/INST]") for r in ("user", "assistant")]
    for r in queries.chat_formatting(spark, D).collect():
        turns = told.pop(r["conv_id"])
        loss = "".join(t for role, t in turns if role == "assistant")
        assert (r["n_turns"], r["loss_chars"], r["loss_sha256"]) == (len(turns), len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert r["turns_sha256"] == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
    assert not told


@pytest.mark.parametrize("url, host, path, rule, verdict", [
    ("https://A.Example.ORG/es/1?x", "a.example.org", "/es/1", "example.org/es/", "block"), ("http://example.org/en/17", "example.org", "/en/17", "example.org/en/1", "block"),
    ("http://example.org", "example.org", "", None, "block"), ("x://m.org/#a", "m.org", "/", "org/", "allow"), ("http://notexample.org/es/", "notexample.org", "/es/", "org/", "allow"),
    ("http://b.com/de/", "b.com", "/de/", "com/de/", "block"), ("b.com/de/", "", "", None, "allow"), (None, "", "", None, "allow"), ("http://c.net?u=http://b.com/de/", "c.net", "", None, "allow")])
def test_urls(spark, url, host, path, rule, verdict):
    rows = [(1, url, None), (2, "http://example.org/es/9", ""), (3, "http://example.org/es/8", '<a href="/x">')]
    got = urls.judge_urls(spark.createDataFrame(rows, "page_id long, url string, html string"), queries.URL_RULES).where("page_id = 1").first()
    assert (got["host"], got["path"], got["rule"], got["verdict"]) == (host, path, rule, verdict)


def test_distrust_goes_against_links_and_trust_along_them(spark):
    rows = [(1, "http://bad.com/de/1", ""), (2, "http://farm.net/", '<a href="http://bad.com/de/1"> <a class=x href=//bad.com/>'),
            (3, "http://good.org/1", "<a href='https://linked.net/y'>"), (4, "http://linked.net/", "<a href='mailto:a@b.c'>"), (5, "http://far.net/", None)]
    got = {r["host"]: r["verdict"] for r in urls.judge_urls(spark.createDataFrame(rows, "page_id long, url string, html string"), queries.URL_RULES).collect()}
    assert got == {"bad.com": "block", "farm.net": "block", "good.org": "allow", "linked.net": "allow", "far.net": "allow"}


def test_distrust_reaches_hosts_over_many_links(spark):
    rows = [(n, f"http://h{n}.net/", f'<a href="http://h{n + 1}.net/">') for n in range(40)] + [(40, "http://h40.net/", '<a href="http://bad.com/">'), (41, "http://bad.com/de/", "")]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert {r["verdict"] for r in urls.judge_urls(frame, queries.URL_RULES).collect()} == {"block"}


def test_ranks_far_below_a_millionth_settle_too(spark):
    """One ring of four hosts among so many seeds that none of its ranks is a millionth of the walk."""
    seeds = spark.range(8).select(F.concat(F.lit("s"), "id").alias("host"), F.lit(10 ** 9).alias("allowed"), F.lit(10 ** 9).alias("blocked"))
    one = spark.createDataFrame([("a", 1, 0), ("d", 0, 1)], "host string, allowed long, blocked long")
    edges = spark.createDataFrame([("a", "b", 1), ("b", "c", 1), ("c", "d", 1), ("d", "a", 1)], "src string, dst string, n long")
    got = {r["host"]: r for r in urls.propagate(edges, seeds.unionByName(one)).collect()}
    whole = 8 * 10 ** 9 + 1
    for far, host in enumerate("abcd"):
        # Around the ring, with and against the links.
        assert got[host]["trust"] / urls.UNIT * whole == pytest.approx(0.15 * 0.85 ** far / (1 - 0.85 ** 4), rel=1e-6)
        assert got[host]["distrust"] / urls.UNIT * whole == pytest.approx(0.15 * 0.85 ** (3 - far) / (1 - 0.85 ** 4), rel=1e-6)


def test_page_rank_matches_power_iteration(spark):
    own = random.Random(1)
    edges = [(f"h{own.randrange(12)}", f"h{own.randrange(12)}", own.randrange(1, 5)) for _ in range(40)]
    edges = [(a, b, n) for (a, b), n in {(a, b): n for a, b, n in edges}.items()]
    seeds = [("h1", 3, 0), ("h2", 1, 1)]
    got = {r[0]: (r[1] / urls.UNIT, r[2] / urls.UNIT) for r in urls.propagate(
        spark.createDataFrame(edges, "src string, dst string, n long"), spark.createDataFrame(seeds, "host string, allowed long, blocked long"), rounds=40).collect()}
    for side, links, start in ((0, edges, {"h1": 0.75, "h2": 0.25}), (1, [(b, a, n) for a, b, n in edges], {"h2": 1.0})):
        total = collections.Counter()
        for a, _, n in links:
            total[a] += n
        rank = dict(start)
        for _ in range(60):
            new = {h: 0.15 * s for h, s in start.items()}
            for a, b, n in links + [(h, h, 1) for h in start if not total[h]]:
                new[b] = new.get(b, 0) + 0.85 * rank.get(a, 0) * n / (total[a] or 1)
            rank = new
        for h, r in rank.items():
            assert got.get(h, (0, 0))[side] == pytest.approx(r, abs=3e-3)


def test_lm_counts_and_scores(spark):
    rows = [(n, words(80, n, 60)) for n in range(60)] + [(100, None), (101, ""), (None, "W1 w2"), (102, "never seen before"), (7, rows_text := words(80, 7, 60))]
    docs = edge_frame(spark, rows)
    got = lm.score_texts(docs, queries.remainder(F.col("doc_id"), 7) == 2, bucket_bytes=4000).collect()
    assert len(got) == len(rows) and rows_text
    tokens = lambda t: brute.words(t) + ["</end>"]
    out = lambda d: d is not None and zlib.crc32(str(d).encode()) % 7 == 2
    count = collections.Counter(x for d, t in rows if not out(d) for x in tokens(t))
    n, v = sum(count.values()), len(count)
    want = sorted(((d is None, d, out(d), len(tokens(t)), sum(x in count for x in tokens(t)), n,
                    round(sum(math.log10((count[x] + 1) / (n + v + 1)) for x in tokens(t)), 6)) for d, t in rows), key=str)
    assert sorted(((r["doc_id"] is None, r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got), key=str) == want
    again = lm.score_texts(docs, queries.remainder(F.col("doc_id"), 7) == 2, bucket_bytes=4000).collect()
    assert sorted((str(r["doc_id"]), r["score"]) for r in got) == sorted((str(r["doc_id"]), r["score"]) for r in again)
    assert lm.score_texts(edge_frame(spark, []), F.lit(False)).count() == 0


def test_lm_is_a_distribution_and_beats_the_base(spark):
    got = queries.lm_scoring(spark, D).toPandas()
    held = got[got.held_out]
    assert held.score.sum() > held.base_score.sum() and (got.score < 0).all()
    # After one context, the known words and one unseen share all probability.
    rows = [(n, "b a " * 5 + "c") for n in range(20) if zlib.crc32(str(n).encode()) % 7 != 2]
    probe = [(1000 + n, w) for n, w in enumerate(("a", "b", "c", "zz"))]
    held = F.col("doc_id") >= 1000
    ends = {r["doc_id"]: r for r in lm.score_texts(edge_frame(spark, rows + probe + [(2000, "")]), held).collect()}
    start = [ends[1000 + n]["score"] for n in range(4)]
    empty = 10 ** ends[2000]["score"]  # the end right after the start
    assert 0 < empty < 1 and all(s < 0 for s in start)


def test_seating_is_within_bounds():
    draw = np.random.default_rng(0)
    customers = np.array([1, 2, 5, 100, 100_000])
    tables = lm.seat(customers, np.full(5, 0.5), 0.7, draw)
    assert (tables >= 1).all() and (tables <= customers).all() and tables[0] == 1 and 1 < tables[4] < 50_000


def test_seating_follows_the_restaurant():
    """Tables of 6 customers against all ways to seat them, one after the other."""
    discount, weights = 0.4, [0.0, 0.7, 0.9, 1.1, 1.3, 1.5]
    ways = {(1,): 1.0}
    for _ in range(5):
        more = collections.Counter()
        for tables, p in ways.items():
            for k, size in enumerate(tables):
                more[tables[:k] + (size + 1,) + tables[k + 1:]] += p * (size - discount)
            more[tables + (1,)] += p * weights[len(tables)]
        ways = more
    want = np.zeros(7)
    for tables, p in ways.items():
        want[len(tables)] += p
    n = 200_000
    got = lm.seat(np.full(n, 6), lambda rows, t: np.full(len(rows), weights[int(np.max(t))]), discount, np.random.default_rng(1))
    assert np.abs(np.bincount(got, minlength=7) / n - want / want.sum()).max() < 0.005


def test_lm_tells_words_before_apart(spark):
    """Whole words are contexts: two that end alike are followed by different words."""
    text = "xxend a yyend b " * 20
    rows = [(n, text) for n in range(30)] + [(n, "a b c") for n in range(30, 33)]
    probe = ["xxend a", "xxend b", "yyend a", "yyend b"]
    docs = edge_frame(spark, rows + [(1000 + n, t) for n, t in enumerate(probe)])
    got = {r["doc_id"]: r for r in lm.score_texts(docs, F.col("doc_id") >= 1000, bucket_bytes=300).collect()}
    score = [got[1000 + n]["score"] for n in range(len(probe))]
    assert score[0] > score[1] + 1 and score[3] > score[2] + 1


def test_lm_held_out_perplexity(spark):
    """Contexts of the whole word before reached 3,058 in a plain count; classes of words 5,423."""
    got = queries.lm_scoring(spark, "/root/testdata/sf0.01").where("held_out").agg(F.sum("score"), F.sum("n_tokens")).first()
    assert 10 ** (-got[0] / got[1]) < 3058


def test_packing_round_trip(spark):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(queries.vocabulary())
    rows = edge_docs() + [(500, "<|endoftext|> İ ﬁ A<|ENDOFTEXT|>, don't ab., x\x1cy"), (501, "one. " * 9000)]
    pieces = packing.cut(edge_frame(spark, rows), queries.vocabulary(), capacity=256)
    out = packing.pack(pieces, 256, group=50).collect()
    want = collections.Counter()
    for d, t in rows:
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [1]
        for k in range(0, len(ids), 256):
            want[(d, k // 256, k, len(ids[k:k + 256]), zlib.crc32(np.array(ids[k:k + 256], "<u4").tobytes()))] += 1
    assert collections.Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in out) == want
    by = collections.defaultdict(list)
    for r in out:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in by.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 256
    assert packing.pack(packing.cut(edge_frame(spark, []), queries.vocabulary())).count() == 0


def test_kept_words_turn_over(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(packing, "CACHE", 40)
    own, rng = packing._Encoder(queries.vocabulary()), np.random.default_rng(5)
    odd = ["a", "Don't", "x.", "...", ".", "état,", "naïve", "İstanbul", "ß.", "3.14", "日本", "e\u0301", "<|endoftext|>", "B2B", "z,", "word.word", "\u200b"]
    for _ in range(30):
        picked = rng.integers(0, 120, 60).tolist()
        texts = [" ".join(odd[p] if p < len(odd) else f"W{chr(97 + p % 26)}{chr(97 + p % 7)}{chr(97 + p // 26)}"[:2 + p % 3] + (".", "", ",")[p % 3]
                          for p in picked[a:a + 20]) for a in (0, 20, 40)] + [None, "", " \n\t"]
        whole = [own.tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]
        assert [x.tolist() for x in own.encode(pa.array(texts, pa.string()))] == whole
    assert len(own.known.keys) <= 40 + 120 and len(own.before.keys) > 40


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_best_fit_obeys_every_capacity(rule):
    own = np.random.default_rng(1)
    lengths = np.sort(own.integers(1, 400, 600))[::-1].astype(np.int64)
    home, offset = packing.best_fit(lengths, (1000, 4, 500_000), rule=rule)
    for b in range(home.max() + 1):
        at = home == b
        assert lengths[at].sum() <= 1000 and at.sum() <= 4 and (lengths[at] ** 2).sum() <= 500_000
        assert (np.cumsum(lengths[at]) - lengths[at] == offset[at]).all()


def test_sharding(spark):
    rows = edge_docs()
    out = shards.assign_shards(edge_frame(spark, rows).withColumn("shard", F.lit("x")), 40).collect()
    data = lambda t: (t or "").encode()
    assert sorted((str(r["doc_id"]), r["size"], r["text_crc32"]) for r in out) == sorted((str(d), len(data(t)) + 16, zlib.crc32(data(t))) for d, t in rows)
    by = collections.defaultdict(list)
    for r in out:
        by[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    assert brute.jump_hash_moves([r["shard"] for r in out], [r["grown_shard"] for r in out], 40)
    many = spark.range(20_000).select(*[shards.jump(F.col("id"), n).alias(f"s{n}") for n in (1, 7, 8, 40)]).toPandas()
    assert set(many.s1) == {0} and brute.jump_hash_moves(many.s7, many.s8, 7)
    for n in (1, 7, 8, 9, 24, 300):
        moved = spark.range(5_000).select(shards.jumps(F.col("id"), n).alias("j"), shards.jump(F.col("id"), n + 1).alias("more"))
        assert moved.where("NOT j.done OR j.grown <> more OR j.shard NOT BETWEEN 0 AND {0} - 1 OR j.grown <> j.shard AND j.grown <> {0}".format(n)).isEmpty()
    assert 0.1 < (many.s8 == 7).mean() < 0.15 and 400 < many.s40.value_counts().min() <= many.s40.value_counts().max() < 600


def test_top_k_edges(spark):
    inf = float("inf")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.5, 0.5]), (3, None), (4, [inf, 1.0]), (5, [None, 1.0]), (6, [1.0]), (7, [1e-3, -1e-3]), (None, [9.0, 9.0]),
            (50, [-1.0, 2.5]), (100, []), (150, [7.0])] + [(1000 + n, [1.0, 0.0]) for n in range(1, 40)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit(0))
    usable = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    want = []
    for q, a in usable:
        if q % 50 == 0:
            found = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in usable if i != q and len(b) == len(a))
            want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(found[:5])]
    for block in (1, 1024):
        assert sorted(map(tuple, topk.top_k(frame, F.col("vec_id") % 50 == 0, block=block).collect())) == sorted(want)
    assert topk.top_k(frame.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_top_k_beyond_exact_floats():
    a, b = np.array([[2.0 ** 40, 1.0]]), np.array([[2.0 ** 20, 3.0]])
    assert topk._products(a, b).tolist() == [[2 ** 60 + 3]]
