"""What the language model shuffles, and how it reads it back."""

from __future__ import annotations

import types

import numpy as np
import pyarrow as pa
import pytest

from postfunnel.llm import lm


@pytest.mark.parametrize("values, size", [
    ([], 1), ([0, 255], 1), ([256], 2), ([1 << 16], 4), ([1 << 32, 3], 8), ([(1 << 53) - 1], 8), ([2.0, 7.0], 1), ([0.25, 3.0], 8), ([-1.0, 3.0], 8)])
def test_packed_numbers_come_back(values, size):
    kind = np.float64 if any(isinstance(v, float) for v in values) else np.int64
    data = lm.packed(np.array(values, kind))
    assert len(data) == 1 + size * len(values)
    assert lm.unpacked(data, kind).tolist() == values


def test_alike_finds_the_same_as_unique():
    rng = np.random.default_rng(2)
    for n in (0, 1, 5000):
        values = rng.integers(0, 700, n).astype(np.uint64) << np.uint64(50)
        first, at = lm._alike(values)
        known, inverse = np.unique(values, return_inverse=True)
        assert (values[first] == known).all() and (at == inverse).all()


def test_a_text_costs_a_bucket_few_bytes(monkeypatch):
    """Of a text with tokens in many buckets each bucket hears in two bytes or so, and reads the same tokens."""
    rng, buckets = np.random.default_rng(3), 16
    texts = [" ".join(f"w{n}" for n in rng.integers(0, 10**6, 60)) for _ in range(300)] + [None, ""]
    held = np.arange(len(texts)) % 7 == 2
    batch = pa.RecordBatch.from_pydict({"doc_id": pa.array(range(len(texts))), "text": pa.array(texts, pa.string()), "held_out": pa.array(held)})
    monkeypatch.setattr(lm, "TaskContext", types.SimpleNamespace(get=lambda: types.SimpleNamespace(partitionId=lambda: 5)))
    common = np.array([lm.START, lm.END], np.uint64)
    head = lm.Head(common[1:], common[:1])
    rows = [r for out in lm._emit(buckets, types.SimpleNamespace(value=head))([batch]) for r in zip(*(c.to_pylist() for c in out.columns))]
    token, context, doc = lm.tokens_of(batch.column("text"))
    tail = lm.cell_of(token, context) != head.cell[0]
    bucket = lm._place(lm.cell_of(token, context), buckets)
    runs = len(np.unique(bucket[tail] * 1000 + doc[tail]))
    assert sum(len(r[2]) + len(r[3]) for r in rows if r[1] == lm._TAIL) < 3 * runs
    learned = 0
    for b in range(buckets):
        own = lm.Bucket(b, [(b, r[1:]) for r in rows if r[0] == b], head, buckets)
        inside = tail & (bucket == b)
        assert np.repeat(own.uid, own.counts).tolist() == ((5 << 40) + doc[inside]).tolist()
        assert own.count.sum() == (~held[doc])[bucket == b].sum()
        learned += own.count.sum()
    assert learned == (~held[doc]).sum()


def test_places_of_hashes():
    rng = np.random.default_rng(4)
    for keys in (np.zeros(0, np.uint64), np.array([7], np.uint64), np.arange(50, dtype=np.uint64), np.unique(rng.integers(0, 1 << 63, 3000).astype(np.uint64) * np.uint64(2))):
        asked = np.concatenate([keys, keys + np.uint64(1), np.array([0, (1 << 64) - 1], np.uint64)])
        known = {k: n for n, k in enumerate(keys.tolist())}
        assert lm.Places(keys).find(asked).tolist() == [known.get(k, -1) for k in asked.tolist()]
