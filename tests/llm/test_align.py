"""Cross-tokenizer alignment against a plain version with sets of offsets."""

from __future__ import annotations

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from postfunnel.llm import align, queries
from postfunnel.llm.common import table, written

D = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def plain():
    """text -> groups of ids, by the two libraries as the contract calls them."""
    import public_tokenizers
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    byte = align.byte_of_character()

    def piece(n):
        p = b.id_to_piece(n)
        return bytes([int(p[3:5], 16)]) if b.is_byte(n) else p.replace("▁", " ").encode()

    def groups(text):
        if not text:
            return []
        x, y = a.encode(" " + text, add_special_tokens=False), b.encode(text)
        xs, ys = [bytes(byte[c] for c in t) for t in x.tokens], [piece(n) for n in y]
        if b"".join(xs) != (" " + text).encode() or b"".join(ys) != (" " + text).encode():
            return []
        ends = [np.cumsum([len(t) for t in s]).tolist() for s in (xs, ys)]
        shared, out, i, j = set(ends[0]) & set(ends[1]), [], 0, 0
        for cut in sorted(shared):
            p, q = ends[0].index(cut, i) + 1, ends[1].index(cut, j) + 1
            out.append((x.ids[i:p], y[j:q]))
            i, j = p, q
        return out
    return groups


def brute(rows, groups):
    told = [(doc_id, groups(text)) for doc_id, text in rows]
    links = [Counter((a, b) for xs, ys in g for a in xs for b in ys) for _, g in told]
    count = Counter(pair for own in links for pair in own)
    most = defaultdict(int)
    for (a, _), n in count.items():
        most[a] = max(most[a], n)
    out = []
    for (doc_id, g), own in zip(told, links):
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in g)
        out.append((doc_id, sum(len(x) for x, _ in g), sum(len(y) for _, y in g), len(g), sum(own.values()),
                    sum(n for p, n in own.items() if count[p] == most[p[0]]), sum(n * count[p] for p, n in own.items()),
                    hashlib.sha256(text.encode()).hexdigest() if g else ""))
    return out


def by_value(rows):
    return sorted((tuple(r) for r in rows), key=lambda r: tuple((x is None, x) for x in r))


def result(docs):
    digest = F.when(F.col("n_groups") > 0, F.sha2("groups", 256)).otherwise("")
    aligned = align.align(docs, queries.tokenizers()).withColumn("groups_sha256", digest).drop("groups")
    columns = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    return align.score_links(written(aligned, "aligned")).select(columns).collect()


ODD = ["", None, " ", "   a  b", "a\n\n\tb \r\n c", "<|endoftext|> <s> </s> <unk>", "▁a▁b", "<0x0A>", "日本語の文章とemoji 🙂🙂🏽 done", "naïve Ünïcödé ſtrange", "  x",
       "a\x00b", "ﬁ ½ Ａ", "é é", "1234567890 3.14159", "x" * 3000, " " * 2500 + "end", "aé" * 1500, "the the the", "the the the", "don't we'll I'm", "def f(x):\n    return x\n"]


def test_query_matches_a_plain_version(spark, plain):
    rows = [tuple(r) for r in table(spark, D, "documents").select("doc_id", "text").collect()]
    got = queries.cross_tokenizer_alignment(spark, D).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256").collect()
    assert by_value(got) == by_value(brute(rows, plain))


def test_odd_texts_repeats_and_missing_ids(spark, plain, monkeypatch):
    r = random.Random(4)
    alphabet = "ab eé日🙂\n\t.,<>0▁  "
    rows = [(n, t) for n, t in enumerate(ODD)] + [(None, "the end"), (None, None), (7, "again"), (7, "again")]
    rows += [(100 + n, "".join(r.choice(alphabet) for _ in range(r.randrange(60)))) for n in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("block", F.lit("x")).withColumn("n_a", F.lit(1))
    assert by_value(result(docs)) == by_value(brute(rows, plain))
    assert result(docs.limit(0)) == []


def test_blocks_of_a_few_texts_give_the_same_counts(plain, monkeypatch):
    """Counts by block and in pieces add up to the counts of the whole."""
    monkeypatch.setattr(align, "HELD", 5)
    r = random.Random(2)
    texts = [" ".join(r.choice(["the", "cat", "sat", "überall", "日本"]) for _ in range(r.randrange(12))) for _ in range(60)]
    own = align.encoders(queries.tokenizers())
    columns = align.aligned_slice(pa.array(texts), own)
    blocks = pa.array(np.repeat(np.arange(6), 10))
    batches = [pa.RecordBatch.from_arrays([blocks, columns["codes"]], ["block", "codes"]).slice(n, 7) for n in range(0, 60, 7)]
    got = Counter()
    for b in align._counted(batches):
        for code, n in zip(b.column("code").to_pylist(), b.column("n").to_pylist()):
            got[code] += n
    want = Counter(x for t in texts for x in {a << 16 | b for xs, ys in plain(t) for a in xs for b in ys})
    assert got == want


@pytest.mark.parametrize("seed", range(6))
def test_cuts_are_all_shared_ends(seed):
    r = np.random.default_rng(seed)
    a_ends, b_ends, a_bounds, b_bounds, base = [], [], [0], [0], 0
    for _ in range(30):
        size = int(r.integers(0, 80))
        if size:
            for ends in (a_ends, b_ends):
                inner = np.flatnonzero(r.random(size - 1) < r.choice([0.05, 0.3, 0.9])) + 1
                ends.extend((base + np.append(inner, size)).tolist())
        base += size
        a_bounds.append(len(a_ends))
        b_bounds.append(len(b_ends))
    a, b = np.array(a_ends), np.array(b_ends)
    got = align.shared_cuts(a, b, np.array(a_bounds), np.array(b_bounds))
    want = sorted(set(a_ends) & set(b_ends))
    assert a[got[0]].tolist() == want and b[got[1]].tolist() == want


def test_large_groups_are_counted_by_different_ids(monkeypatch):
    r = np.random.default_rng(3)
    a, b = r.integers(0, 9, 400), r.integers(0, 9, 300)
    a_last, b_last, owner = np.array([99, 100, 399]), np.array([80, 200, 299]), np.array([0, 2, 2])
    want = align._links(a, b, a_last, b_last, owner, 3)
    monkeypatch.setattr(align, "MANY", 0)
    for x, y in zip(want, align._links(a, b, a_last, b_last, owner, 3)):
        assert x.tolist() == y.tolist()
    own = [Counter(), Counter(), Counter()]
    i = j = 0
    for p, q, t in zip(a_last + 1, b_last + 1, owner):
        own[t].update(x << 16 | y for x in a[i:p].tolist() for y in b[j:q].tolist())
        i, j = p, q
    codes, times, edge = want
    assert [dict(zip(codes[x:y].tolist(), times[x:y].tolist())) for x, y in zip(edge[:-1], edge[1:])] == [dict(c) for c in own]
