"""Periodic runs against a plain search, on random strings, edge cases and the smallest table."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest

from postfunnel.llm import periods, queries
from postfunnel.llm.common import table

D = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_runs(w, least=24, turns=3):
    """(start, length, period) of all runs: each period's maximal equal stretches, the least period of each."""
    out = {}
    for p in range(1, len(w) // turns + 1):
        i = 0
        while i < len(w) - p:
            j = i
            while j < len(w) - p and w[j] == w[j + p]:
                j += 1
            if j > i and j + p - i >= max(least, turns * p):
                out.setdefault((i, j + p), p)
            i = max(j, i + 1)
    return sorted((s, e - s, p) for (s, e), p in out.items())


def brute_collapsed(w, runs):
    gone = {i for s, n, p in runs for i in range(s + p, s + n)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def some_text(r):
    k, n = r.choice([1, 2, 3, 30]), r.randrange(120)
    w = [r.choice("abcdefghijklmnopqrstuvwxyzABCD"[:k]) for _ in range(n)]
    if n and r.random() < 0.8:
        a = r.randrange(n)
        p, end = 1 + r.randrange((n - a) // 3 + 1), r.randrange(a, n + 1)
        for i in range(a + p, end):
            w[i] = w[a + (i - a) % p]
    return " ".join(w)


@pytest.mark.parametrize("seed", range(8))
def test_runs_match_a_plain_search(seed):
    r = random.Random(seed)
    texts = [r.choice([None, "", some_text(r), some_text(r), some_text(r)]) for _ in range(120)]
    for least in (24, 3):
        sizes, lists, collapsed = periods.runs_of(pa.array(texts, pa.string()), least)
        for text, n, got, kept in zip(texts, sizes, lists.to_pylist(), collapsed.to_pylist()):
            w = (text or "").split()
            want = brute_runs(w, least)
            assert n == len(w) and [tuple(x.values()) for x in got] == want
            assert kept == brute_collapsed(w, want)


def test_candidates_are_cut_into_chunks(monkeypatch):
    monkeypatch.setattr(periods, "CHUNK", 7)
    r = random.Random(3)
    texts = [some_text(r) for _ in range(40)]
    got = periods.runs_of(pa.array(texts), 6)[1].to_pylist()
    assert [[tuple(x.values()) for x in g] for g in got] == [brute_runs(t.split(), 6) for t in texts]


def test_grammar_gives_the_string_back_and_agrees_exactly():
    r = np.random.default_rng(1)
    for size in (1, 2, 50, 400):
        inner = r.integers(0, 3, size)
        s = np.concatenate(([3], np.repeat(inner, r.integers(1, 5, size)), [4])).astype(np.int32)
        levels = periods.recompress(s)
        assert len(levels[-1].symbols) == 1
        for low, high in zip(levels, levels[1:]):  # equal symbols stand for equal stretches
            meaning = {}
            for n, name in enumerate(high.symbols.tolist()):
                own = tuple(low.symbols[low.first[n]:low.first[n + 1]].tolist())
                assert meaning.setdefault(name, own) == own
        x = r.integers(0, len(s), 300)
        y = r.integers(0, len(s), 300)
        x, y = x[x != y], y[x != y]
        for step in (1, -1):
            for a, b, n in zip(x.tolist(), y.tolist(), periods.agree(levels, x, y, step).tolist()):
                m = 0
                while s[a + step * m] == s[b + step * m]:
                    m += 1
                assert n == m


def test_long_texts_of_few_words():
    r = random.Random(5)
    texts = [" ".join(["a"] * 200_000), " ".join("x" if i % 3 == 0 else str(r.randrange(10**6)) for i in range(100_000)), " ".join("ab"[(i * 7 // 5) % 2] for i in range(50_000))]
    sizes, lists, collapsed = periods.runs_of(pa.array(texts))
    got = lists.to_pylist()
    assert got[0] == [{"start": 0, "length": 200_000, "period": 1}] and collapsed[0].as_py() == "a"
    assert got[1] == [] and collapsed[1].as_py() == texts[1]
    assert got[2] == [{"start": 0, "length": 50_000, "period": 10}]


def test_edges_in_a_table(spark):
    again = " ".join(["Ab", "ab", "é"] * 9)
    rows = [(1, None, "x"), (2, "", "x"), (3, " \t\n", "x"), (None, again, None), (4, again, "y"), (4, again, "y"), (5, "  " * 30, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs string").withColumn("collapsed", queries.F.lit(1))
    got = {(r.doc_id, r.n_words): r for r in periods.find_runs(docs).collect()}
    assert len(got) == 6 and periods.find_runs(docs).count() == 7
    for key in ((1, 0), (2, 0), (3, 0)):
        assert got[key].runs == [] and got[key].collapsed == ""
    for key in ((None, 27), (4, 27)):
        assert [tuple(r) for r in got[key].runs] == [(0, 27, 3)] and got[key].collapsed == "Ab ab é"
    assert [tuple(r) for r in got[(5, 30)].runs] == [(0, 30, 1)]
    assert periods.find_runs(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        periods.find_runs(docs, turns=2)


def planted(doc_id, text):
    w = WORD.findall(text or "")
    h = zlib.crc32(str(doc_id).encode())
    if h % 10 == 0 and w:
        n, g = len(w), h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    return w


def test_query_matches_a_plain_search(spark):
    texts = {r.doc_id: r.text for r in table(spark, D, "documents").select("doc_id", "text").collect() if len(r.text or "") < 20_000}
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    seen = 0
    for r in queries.periodic_run_detection(spark, D).collect():
        if r.doc_id not in texts:
            continue
        w = planted(r.doc_id, texts[r.doc_id])
        runs = brute_runs(w)
        best = min(runs, key=lambda x: (-Fraction(x[1], x[2]), x[0], x[2]), default=(None, None, None))
        seen += len(runs)
        assert (r.n_runs, r.start, r.length, r.period) == (len(runs), *best)
        assert r.exponent_milli == (best[0] if best[0] is None else 1000 * best[1] // best[2])
        assert r.runs_sha256 == digest("".join(f"{s},{n},{p}\n" for s, n, p in runs))
        assert r.collapsed_sha256 == digest(brute_collapsed(w, runs))
    assert seen > 5
