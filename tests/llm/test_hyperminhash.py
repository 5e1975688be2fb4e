"""HyperMinHash registers and the groups they make, against plain versions."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import brute
from postfunnel.llm import components, hyperminhash as hm, meet, queries
from postfunnel.llm.common import table

D = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string"


def by_value(rows):
    return sorted(map(tuple, rows), key=lambda r: tuple((x is None, x) for x in r))


def family(seed, members, words, swapped):
    """Texts that differ from one base in some words: similar to each other about as often as not."""
    r = random.Random(seed)
    base = [f"b{seed}x{n}" for n in range(words)]
    out = []
    for m in range(members):
        own = list(base)
        for at in r.sample(range(words), swapped):
            own[at] = f"m{m}x{at}"
        out.append(" ".join(own))
    return out


def odd_rows():
    rows = [(1, None), (2, ""), (3, " \t\n"), (None, "no id here at all"), (None, None), (4, "A b"), (5, "a B"), (6, "a"), (7, "A"), (8, "a b c d e"), (9, "a b c d e f"),
            (10, "same words again"), (10, "same words again"), (11, "ü ß É é"), (12, "Ü SS é É"), (13, " ".join(f"w{n % 977}" for n in range(40_000)))]
    rows += [(100 + n, " ".join([f"c{m}" for m in range(n, 60)] + [f"y{m}" for m in range(n)])) for n in range(30)]  # a chain
    return rows


def test_matches_brute_force_on_odd_rows(spark):
    rows = odd_rows()
    docs = spark.createDataFrame(rows, DOCS).withColumn("key", F.lit("x")).withColumn("sketch", F.lit(1))
    got = hm.near_duplicates(docs).select("doc_id", "n_shingles", "component_id").collect()
    assert by_value(got) == by_value(brute.components(rows, 2, 80))
    assert hm.near_duplicates(docs.limit(0)).count() == 0


def test_query_matches_brute_force_on_a_table(spark):
    rows = [tuple(r) for r in table(spark, D, "documents").select("doc_id", "text").collect()]
    got = queries.minhash_near_dedup(spark, D).collect()
    assert by_value([r[:3] for r in got]) == by_value(brute.components(rows, 2, 80))
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


@pytest.mark.parametrize("block", [2048, 5])
def test_families_about_the_threshold(spark, monkeypatch, block):
    """Groups that stay open: many sets, some pairs of them similar, none of all pairs handed on."""
    monkeypatch.setattr(meet, "BLOCK", block)
    texts = family(1, 60, 100, 9) + family(2, 40, 60, 5) + family(3, 50, 30, 2)
    rows = list(enumerate(texts))
    got = hm.near_duplicates(spark.createDataFrame(rows, DOCS)).select("doc_id", "n_shingles", "component_id").collect()
    want = brute.components(rows, 2, 80)
    assert by_value(got) == by_value(want)
    assert 3 < len({c for _, _, c in want}) < len(rows)


def test_compressed_keeps_zeros_and_the_bits_behind():
    r = np.random.default_rng(1)
    values = r.integers(0, 2 ** 64, 2000, dtype=np.uint64) >> r.integers(0, 20, 2000).astype(np.uint64)
    for x, got in zip(values.tolist(), hm.compressed(values).tolist()):
        zeros = 64 - x.bit_length()
        bits = (x << zeros + 1 & (1 << 64) - 1) >> 64 - hm.MANTISSA
        assert got == (zeros << hm.MANTISSA | bits if zeros < hm.ZEROS else hm.ZEROS << hm.MANTISSA) != hm.EMPTY
    assert hm.compressed(np.zeros(1, np.uint64))[0] == hm.ZEROS << hm.MANTISSA


@pytest.mark.parametrize("size", [5, 40, 300, 5000])
def test_estimate_follows_the_similarity(size):
    r = np.random.default_rng(size)
    told, real = [], []
    for n in range(60):
        common = r.integers(1, 2 ** 63, size, dtype=np.uint64)
        own = [np.unique(np.concatenate((common, r.integers(1, 2 ** 63, size // 10, dtype=np.uint64)))) for _ in range(2)]
        classes = np.repeat(hm.set_class(np.array([max(map(len, own))])), 2)
        rows = hm.registers(np.concatenate(own), np.cumsum([0, *map(len, own)]), classes)
        told.append(hm.estimate(float(len(own[0])), rows[:1], float(len(own[1])), rows[1:])[0][0])
        real.append(len(np.intersect1d(*own)) / len(np.union1d(*own)))
        assert hm._may(float(len(own[0])), rows[:1], float(len(own[1])), rows[1:])[0]
    assert abs(np.mean(told) - np.mean(real)) < 0.02


def test_chance_agreements_are_corrected(monkeypatch):
    """With few bits kept, different sets' registers look alike as often as the correction says."""
    monkeypatch.setattr(hm, "MANTISSA", 1)
    r = np.random.default_rng(2)
    told = []
    for _ in range(200):
        sets = np.sort(r.integers(1, 2 ** 63, 4000, dtype=np.uint64).reshape(2, -1), axis=1)
        rows = hm.registers(sets.ravel(), np.array([0, 2000, 4000]), np.array([10, 10]))
        told.append(hm.estimate(2000.0, rows[:1], 2000.0, rows[1:])[0][0])
        assert (rows[0] == rows[1]).mean() > 0.02
    assert abs(np.mean(told)) < 0.01


@pytest.mark.parametrize("size", [4, 5, 9, 50, 700])
def test_pairs_at_the_threshold_share_a_signature(size):
    r = np.random.default_rng(size)
    for _ in range(40):
        extra = size // 4
        a = np.unique(r.integers(1, 2 ** 63, size, dtype=np.uint64))
        b = np.unique(np.concatenate((a, r.integers(1, 2 ** 63, extra, dtype=np.uint64))))
        sizes = np.array([len(a), len(b)])
        sketches = hm.sketched(np.concatenate((a, b)), np.cumsum([0, *sizes]))
        sig, who, guest = hm.signatures(sizes, sketches)
        assert set(sig[(who == 0) & ~guest]) & set(sig[who == 1]) | set(sig[who == 0]) & set(sig[(who == 1) & ~guest])
        assert hm._may_pair(sizes[:1], sketches[:1], sizes[1:], sketches[1:])[0]


def test_links_of_two_blocks_join_what_all_pairs_would():
    r = np.random.default_rng(5)
    base = r.integers(1, 2 ** 62, 40, dtype=np.uint64) << np.uint64(1)
    sets = [np.unique(np.concatenate((r.choice(base, 30, False), r.integers(1, 2 ** 63, 3, dtype=np.uint64)))) for _ in range(50)]
    roots = r.integers(0, 40, 50)
    block = (np.arange(50), roots, np.array([len(x) for x in sets]), [meet.packed(x) for x in sets])
    kept = [meet.unpacked(x) for x in block[3]]

    def joined(links):
        label = {int(x): int(x) for x in roots}
        for u, v in links:
            a, b = label[int(roots[u])], label[int(roots[v])]
            label = {k: a if x == b else x for k, x in label.items()}
        return sorted(sorted(k for k in label if label[k] == x) for x in set(label.values()))

    every = [(u, v) for u in range(50) for v in range(u) if 100 * len(np.intersect1d(kept[u], kept[v])) >= 60 * len(np.union1d(kept[u], kept[v]))]
    similar = hm.SIMILAR._replace(percent=60)
    own = list(meet._links(similar, block, block, True))
    assert joined(own) == joined(every) and len(own) < 40 < len(every)
    halves = [tuple(x[part] if not isinstance(x, list) else x[part] for x in block) for part in (slice(0, 20), slice(20, 50))]
    parts = [*meet._links(similar, halves[0], halves[0], True), *meet._links(similar, halves[1], halves[1], True), *meet._links(similar, *halves, False)]
    assert joined(parts) == joined(every)


def test_large_groups_come_in_chunks(monkeypatch):
    monkeypatch.setattr(meet, "CHUNK", 4)
    sig = np.repeat(np.array([2, 4, 6], np.uint64), [11, 2, 1])
    key = np.r_[np.arange(11), 50, 60, 70]
    rows = [r for b in meet._groups(sig, key) for r in b.to_pylist()]
    own = {r["name"] for r in rows}
    assert len(own) == 2 and sorted(len(r["keys"]) for r in rows) == [2, 3, 4, 4]
    assert sorted(x for r in rows for x in r["keys"]) == [*range(11), 50, 60]
    assert {(r["size"], r["least"]) for r in rows} == {(11, 0), (2, 50)}
    assert all(r["keys"][0] == r["at"] for r in rows if r["size"] == 11)


def test_hubs_are_dealt_to_several_tasks(spark, monkeypatch):
    monkeypatch.setattr(components, "HUB", 5)
    links = spark.createDataFrame([(1000, n) for n in range(500)] + [(n, n + 1) for n in range(2000, 2040)] + [(499, 2040), (5000, 5001)], "u long, v long")
    got = {r[0]: r[1] for r in components.components(links).collect()}
    assert len(got) == 501 + 41 + 2 and {got[n] for n in (1000, 3, 499, 2000, 2040)} == {0} and got[5001] == 5000
