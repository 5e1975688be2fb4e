"""Benchmark decontamination by greedy string tiling.

A document shares a seed with an item when a run of ``least`` words stands in
both.  For each such pair the longest runs that still lie unmarked in both are
found by running Karp-Rabin hashes and marked, again and again, so that moved
passages count as well as whole ones.  An item is leaked by a document when
marked words make up ``coverage`` of it.

Words are compared with A-Z lowered and ASCII punctuation left out.  The item
set is given to the tasks in blocks of bounded size, so documents are scanned
once per block, never shuffled, and no pair of rows is made without a seed.

Defined results: null and empty texts leak nothing; items of fewer than
``least`` words are never found; rows repeat as often as their document does.
Rows without doc_id are judged like others.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from postfunnel.llm.common import slices, windows, word_hashes

LEAKS = "doc_id long, item_id long, coverage double, n_tiles int, longest int, item_words int"
_BASE = 0x100000001B3


def _runs(words: np.ndarray, free: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Rolling hashes of the unmarked runs of ``size`` words, and where they start."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    hashes = np.zeros(n, np.uint64)
    for j in range(size):
        hashes = hashes * np.uint64(_BASE) + words[j:j + n]
    taken = np.concatenate(([0], np.cumsum(~free)))
    at = np.flatnonzero(taken[size:] == taken[:-size])
    return hashes[at], at


def _matches(item, text, free_i, free_t, size):
    """(length, item start, text start) of the maximal unmarked common runs of at least ``size`` words."""
    hi, ai = _runs(item, free_i, size)
    ht, at = _runs(text, free_t, size)
    order = np.argsort(hi, kind="stable")
    low, high = np.searchsorted(hi[order], ht, "left"), np.searchsorted(hi[order], ht, "right")
    n = high - low
    t = np.repeat(at, n)
    i = ai[order[np.repeat(low, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]]
    before = (i > 0) & (t > 0)
    before[before] = (item[i[before] - 1] == text[t[before] - 1]) & free_i[i[before] - 1] & free_t[t[before] - 1]
    i, t = i[~before], t[~before]
    same = np.ones(len(i), bool)
    for j in range(size):  # equal hashes are checked word by word
        same &= item[i + j] == text[t + j]
    i, t = i[same], t[same]
    length, more = np.full(len(i), size), np.ones(len(i), bool)
    while more.any():
        more &= (i + length < len(item)) & (t + length < len(text))
        at_i, at_t = i[more] + length[more], t[more] + length[more]
        more[more] = (item[at_i] == text[at_t]) & free_i[at_i] & free_t[at_t]
        length[more] += 1
    return sorted(zip((-length).tolist(), i.tolist(), t.tolist()))


def tile(item: np.ndarray, text: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """The tiles (length, item start, text start), longest first, no word in two of them."""
    free_i, free_t = np.ones(len(item), bool), np.ones(len(text), bool)
    tiles, size = [], max(least, 20)
    while True:
        found = _matches(item, text, free_i, free_t, size)
        if found and -found[0][0] > 2 * size:
            size = -found[0][0]
            continue
        for length, i, t in found:
            length = -length
            if free_i[i:i + length].all() and free_t[t:t + length].all():
                free_i[i:i + length] = free_t[t:t + length] = False
                tiles.append((length, i, t))
        if found:
            continue  # what a mark cut off may hold further runs of this size
        if size == least:
            return tiles
        size = max(least, size // 2)


class Index:
    """The words and seeds of a block of items."""

    def __init__(self, items: list[tuple[int, str | None]], least: int):
        self.least, self.ids = least, [i for i, _ in items]
        words, bounds = word_hashes(pa.array([t for _, t in items], pa.string()), marks=False)
        self.words = [words[a:b] for a, b in zip(bounds, bounds[1:])]
        seeds, owner, place = windows(words, bounds, least)
        whole = np.array([len(w) >= least for w in self.words], bool)[owner] if len(owner) else np.zeros(0, bool)
        order = np.argsort(seeds[whole], kind="stable")
        self.seeds, self.owner, self.place = seeds[whole][order], owner[whole][order], place[whole][order]

    def leaks(self, texts: pa.Array, coverage: float) -> list[list[tuple]]:
        """For each text the items it leaks: (item_id, coverage, tiles, longest, words)."""
        out: list[list[tuple]] = [[] for _ in range(len(texts))]
        words, bounds = word_hashes(texts, marks=False)
        if not len(self.seeds) or not len(words):
            return out
        seeds, owner, _ = windows(words, bounds, self.least)
        low = np.searchsorted(self.seeds, seeds, "left")
        hit = self.seeds[np.minimum(low, len(self.seeds) - 1)] == seeds
        low, owner = low[hit], owner[hit]
        n = np.searchsorted(self.seeds, seeds[hit], "right") - low
        at = np.repeat(low, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        # Each pair of a text and an item with the item's places that seeds touch.
        met = np.unique(np.stack([np.repeat(owner, n), self.owner[at], self.place[at]], 1), axis=0)
        starts = np.flatnonzero(np.r_[True, (met[1:, :2] != met[:-1, :2]).any(1)]) if len(met) else []
        for a, b in zip(starts, [*starts[1:], len(met)]):
            doc, item = met[a, 0], met[a, 1]
            own = self.words[item]
            touched = np.zeros(len(own) + 1, np.int64)
            np.add.at(touched, met[a:b, 2], 1)
            np.add.at(touched, met[a:b, 2] + self.least, -1)
            if (np.cumsum(touched)[:-1] > 0).sum() < coverage * len(own):
                continue  # tiles are made of seeds, so they cannot cover enough
            tiles = tile(own, words[bounds[doc]:bounds[doc + 1]], self.least)
            covered = sum(t[0] for t in tiles)
            if covered >= coverage * len(own):
                out[doc].append((self.ids[item], covered / len(own), len(tiles), tiles[0][0], len(own)))
        return out


def _blocks(benchmark: DataFrame, least: int, block_bytes: int) -> list[Index]:
    """The items in blocks of about ``block_bytes`` of text, one of which a task holds at a time."""
    items = benchmark.where("item_id IS NOT NULL AND text IS NOT NULL").select("item_id", "text")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-size // block_bytes))
    block = F.pmod(F.xxhash64("item_id", "text"), F.lit(n))
    return [Index(sorted((r[0], r[1]) for r in items.where(block == b).collect()), least) for b in range(n)]


def find_leaks(docs: DataFrame, benchmark: DataFrame, least: int = 4, coverage: float = 0.5,
               block_bytes: int = 8 << 20) -> DataFrame:
    """One row for each document and item it leaks."""
    names = [c.split()[0] for c in LEAKS.split(", ")]
    kinds = (pa.int64(), pa.int64(), pa.float64(), pa.int32(), pa.int32(), pa.int32())

    def scan(index: Index) -> DataFrame:
        def run(batches):
            for batch in batches:
                for part in slices(batch, "text"):
                    rows = [(d, *leak) for d, found in zip(part.column("doc_id").to_pylist(), index.leaks(part.column("text"), coverage)) for leak in found]
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)
        return docs.select("doc_id", "text").mapInArrow(run, LEAKS)

    return reduce(DataFrame.unionByName, map(scan, _blocks(benchmark, least, block_bytes)))


def drop_leaking(docs: DataFrame, benchmark: DataFrame, least: int = 4, coverage: float = 0.5,
                 block_bytes: int = 8 << 20) -> DataFrame:
    """The documents that leak no item, with all their columns."""
    for index in _blocks(benchmark, least, block_bytes):
        def run(batches, index=index):
            for batch in batches:
                for part in slices(batch, "text"):
                    clean = [not found for found in index.leaks(part.column("text"), coverage)]
                    yield part.filter(pa.array(clean, pa.bool_()))
        docs = docs.mapInArrow(run, docs.schema)
    return docs
