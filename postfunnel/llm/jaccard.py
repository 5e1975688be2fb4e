"""Exact n-gram Jaccard join by PartEnum signatures.

Documents are sets of word shingles; equal sets are one node from the start.
Sets of sizes a <= b are similar enough (intersection at least 3/4 of the union)
only if they differ in at most (a + b) / 7 shingles and b <= 4 a / 3.  Sizes are
cut into bands with ends 4/3 apart, so similar sets lie in one band or in two
next to each other, and every set takes part in its own band's scheme and, as a
guest, in the next one's.  Two guests of a scheme meet in their own band's, so
a signature that only guests share is dropped.

A scheme for at most k differences deals the whole shingle domain into groups by
hash and every group into three parts.  Some group holds at most one difference,
so among the three ways to leave one part out there is one where both sets agree
on the other two: its hash is a signature they share.  Empty projections give no
signature.  A set for which that could hide every shared signature takes part
in the scheme again with the domain dealt anew, and after ``DEALS`` times in a
signature that all such sets share.  A set so small that only its equals are
similar has no signature.  So each similar pair of different sets shares a
signature, without exception.

Sets that share a signature are linked only after their shingles were compared,
and only pairs across components are (``py``).  A bit sketch, whose
differing bits never exceed the differing shingles, spares most of the
comparisons that fail.

Shingles are compared as 64-bit hashes.  Defined results: without words, or
with a null text, the set is empty and linked with nothing.  Rows without
doc_id get n_shingles and no component.  Equal rows get equal results.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from postfunnel.llm.common import mix, slices, windows, word_hashes, written
from postfunnel.llm.meet import PACKED, Packer, Similar, buckets_for, classes, groups_of, known_sets, settle, sums

WORDS = 5
PERCENT = 75
DEALS = 8
SKETCH_BITS = 1024
#: Bytes of the short sketch that goes where many of them are needed.
BRIEF = 128
_U = np.uint64
_HASH = "_near_text_hash"


def bands(largest: int) -> list[int]:
    """The last size of each band, up to the band after that of ``largest``."""
    ends, start = [], 1
    while not ends or start <= largest or len(ends) < 2 or ends[-2] < largest:
        ends.append(start * 4 // 3)
        start = ends[-1] + 1
    return ends


def shingle_sets(texts: pa.Array, size: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """The different shingles of all texts, sorted within each, and the bounds of the texts."""
    words, bounds = word_hashes(texts)
    runs, owner, _ = windows(words, bounds, size)
    order = np.lexsort((runs, owner))
    runs, owner = runs[order], owner[order]
    first = np.ones(len(runs), bool)
    first[1:] = (runs[1:] != runs[:-1]) | (owner[1:] != owner[:-1])
    runs, owner = runs[first], owner[first]
    return runs, np.searchsorted(owner, np.arange(len(texts) + 1))


def set_keys(sets: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """One number for each set (as signed, for Spark); sets are equal when it is."""
    return mix(sums(mix(sets ^ _U(0x5851F42D4C957F2D)), bounds) + np.diff(bounds).astype(_U)).view(np.int64)


def sketches(sets: np.ndarray, bounds: np.ndarray) -> list[bytes]:
    """Parity of the shingles that fall on each bit; at least two bits a shingle, a power of two of them."""
    sizes = np.diff(bounds)
    bits = np.maximum(SKETCH_BITS, 1 << np.ceil(np.log2(2 * np.maximum(sizes, 1))).astype(np.int64))
    owner = np.repeat(np.arange(len(sizes)), sizes)
    start = np.cumsum(bits) - bits
    at = start[owner] + (mix(sets ^ _U(77)) & (bits[owner] - 1).astype(_U)).astype(np.int64)
    packed = np.packbits((np.bincount(at, minlength=int(bits.sum())) & 1).astype(np.uint8))
    return [packed[a // 8:(a + n) // 8].tobytes() for a, n in zip(start.tolist(), bits.tolist())]


def bits_apart(left: list[bytes], right: list[bytes]) -> np.ndarray:
    """In how many bits each two sketches differ, the longer one folded to the shorter one's length."""
    out = np.zeros(len(left), np.int64)
    sizes = np.array([min(len(a), len(b)) for a, b in zip(left, right)])
    for size in np.unique(sizes):
        at = np.flatnonzero(sizes == size)
        own = [np.frombuffer(b"".join(_fold(side[n], size) for n in at.tolist()), np.uint8).reshape(-1, size) for side in (left, right)]
        out[at] = np.bitwise_count(own[0] ^ own[1]).sum(1, dtype=np.int64)
    return out


def _fold(sketch: bytes, size: int) -> bytes:
    if len(sketch) == size:
        return sketch
    return np.bitwise_xor.reduce(np.frombuffer(sketch, np.uint8).reshape(-1, size), axis=0).tobytes()


def signatures(sets: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All signatures of all sets, the set of each, and whether it is a guest there."""
    sizes = np.diff(bounds)
    if not sizes.any():
        return np.zeros(0, _U), np.zeros(0, np.int64), np.zeros(0, bool)
    ends = np.array(bands(int(sizes.max())))
    band = np.searchsorted(ends, sizes)
    out, owners, guest = [], [], []
    for next_band in (0, 1):
        scheme = band + next_band
        end = ends[scheme]
        k = 2 * end // 7
        groups = np.ceil(1.06 * (k // 2 + 1)).astype(np.int64) + 2
        # Whom this scheme pairs a set with bounds their differences.
        partner = np.minimum(end, sizes * 4 // 3)
        own_k = np.minimum(k, (sizes + partner) // 7)
        # Where no difference is allowed only equal sets are similar, and those are one node already.
        todo = np.flatnonzero(own_k > 0)
        for deal in range(DEALS):
            todo, sig, who = _deal(sets, bounds, todo, scheme, groups, own_k, deal)
            out.append(sig)
            owners.append(who)
            if not len(todo):
                break
        if len(todo):
            out.append(mix(scheme[todo].astype(_U) + _U(0xABCDEF12345)))
            owners.append(todo)
        guest.append(np.full(sum(map(len, out)) - sum(map(len, guest)), next_band == 1))
    return np.concatenate(out), np.concatenate(owners), np.concatenate(guest)


def _deal(sets, bounds, todo, scheme, groups, own_k, deal):
    """Signatures of the sets ``todo`` under one deal, and those of them that need another."""
    sizes = np.diff(bounds)[todo]
    start = np.cumsum(sizes) - sizes
    at = np.repeat(bounds[todo] - start, sizes) + np.arange(sizes.sum())
    owner = np.repeat(np.arange(len(todo)), sizes)
    value = mix(sets[at] + _U((deal + 1) * 0x632BE59BD9B4E019 & (1 << 64) - 1))
    cells = 3 * groups[todo]
    first = np.cumsum(cells) - cells
    # The high half picks the cell, a further scramble is what is summed.
    cell = first[owner] + ((value >> _U(32)) * cells[owner].astype(_U) >> _U(32)).astype(np.int64)
    sums = np.zeros(cells.sum(), _U)
    np.add.at(sums, cell, mix(value))
    full = np.bincount(cell, minlength=len(sums)).reshape(-1, 3) > 0
    sums = sums.reshape(-1, 3)
    own = np.repeat(np.arange(len(todo)), groups[todo])
    number = np.arange(len(own)) - np.repeat(np.cumsum(groups[todo]) - groups[todo], groups[todo])
    salt = mix((scheme[todo][own].astype(_U) << _U(40)) + (_U(deal) << _U(32)) + number.astype(_U))
    sig, who, fails = [], [], np.zeros(len(own), bool)
    for gone in range(3):
        a, b = [j for j in range(3) if j != gone]
        some = full[:, a] | full[:, b]
        fails |= ~some
        sig.append(mix(sums[some, a] + sums[some, b] + salt[some] * _U(2 * gone + 1)))
        who.append(todo[own[some]])
    bad = np.bincount(own[fails], minlength=len(todo))
    # Groups with two differences or more are at most own_k / 2; one more must be usable.
    again = todo[bad >= groups[todo] - own_k[todo] // 2]
    return again, np.concatenate(sig), np.concatenate(who)


def _emit(buckets: int, size: int):
    def run(batches):
        seen, packer = set(), Packer(buckets)
        for batch in batches:
            for part in slices(batch, "text"):
                sets, bounds = shingle_sets(part.column("text"), size)
                names = set_keys(sets, bounds)
                new = []
                for n, name in enumerate(names.tolist()):  # copies within a task are one set
                    if name not in seen:
                        seen.add(name)
                        new.append(n)
                if not new:
                    continue
                sizes = np.diff(bounds)[new]
                at = np.repeat(bounds[:-1][new] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
                sig, who, guest = signatures(sets[at], np.r_[0, np.cumsum(sizes)])
                yield from packer.add(sig, names[new][who], guest)
        yield from packer.flush()
    return run


def _sets(size: int):
    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                sets, bounds = shingle_sets(part.column("text"), size)
                long = sketches(sets, bounds)
                yield pa.RecordBatch.from_pydict({
                    "doc_id": part.column("doc_id"), "text_hash": part.column("text_hash"), "n_shingles": pa.array(np.diff(bounds), pa.int64()), "key": pa.array(set_keys(sets, bounds)),
                    "sketch": pa.array(long, pa.binary()), "brief": pa.array([_fold(x, BRIEF) for x in long], pa.binary())})
    return run


def _may_pair(n_a, left, n_b, right):
    """Do the sketches allow enough common shingles?"""
    return 7 * np.maximum(bits_apart(left, right), abs(n_a - n_b)) <= n_a + n_b


def _may_row(n, row, others, rows):
    return 7 * np.bitwise_count(rows ^ row).sum(1, dtype=np.int64) <= others + n


def _matrix(sizes, sketches, width):
    return np.frombuffer(b"".join([_fold(x, width) for x in sketches]), np.uint8).reshape(-1, width)


def _width(sizes, sketches):
    """The sketches of a group are folded to the shortest one's length."""
    return min(map(len, sketches))


SIMILAR = Similar(PERCENT, (("brief", _may_pair), ("sketch", _may_pair)), "sketch", _width, _matrix, _may_row)


def keyed_sets(size: int):
    def sets_of(texts):
        sets, bounds = shingle_sets(texts, size)
        return sets, bounds, set_keys(sets, bounds)
    return sets_of


def near_duplicates(docs: DataFrame, size: int = WORDS) -> DataFrame:
    """doc_id, n_shingles and component_id of every row of ``docs`` (doc_id, text).

    ``text_hash`` is xxhash64 of the text; ``is_first`` marks the row that stands
    for its component, the least by doc_id and text_hash (equal rows alike).
    """
    docs = docs.select("doc_id", "text")
    nodes = written(docs.withColumn("text_hash", F.xxhash64("text")).mapInArrow(
        _sets(size), "doc_id long, text_hash long, n_shingles long, key long, sketch binary, brief binary"), "shingle-sets")
    # A set has about as many signatures as shingles, and a few more.
    rows, total = nodes.agg(F.count("*"), F.sum("n_shingles")).first()
    buckets = buckets_for(docs.sparkSession, (total or 0) + 20 * rows)
    groups = groups_of(docs.where("doc_id IS NOT NULL").mapInArrow(_emit(buckets, size), PACKED), buckets)
    known = known_sets(nodes, groups, "sketch", "brief")
    roots = settle(groups, known, docs, keyed_sets(size), SIMILAR)
    return classes(nodes, roots)


def keep_first(docs: DataFrame, size: int = WORDS) -> DataFrame:
    """The rows of ``docs`` that stand for their component, each once; rows without doc_id stay."""
    classes = near_duplicates(docs, size)
    rows = written(classes.select("doc_id", "text_hash", "is_first"), "classes").where("doc_id IS NOT NULL")
    marked = docs.withColumn(_HASH, F.xxhash64("text"))
    on = lambda d: d.select("doc_id", F.col("text_hash").alias(_HASH)).distinct()
    kept = marked.join(on(rows.where("NOT is_first")), ["doc_id", _HASH], "left_anti")
    # Only rows that stand in the table more than once are grouped.
    again = rows.where("is_first").groupBy("doc_id", "text_hash").count().where("count > 1")
    if not again.isEmpty():
        twice = on(again)
        kept = (kept.join(twice, ["doc_id", _HASH], "left_anti")
                .unionByName(kept.join(twice, ["doc_id", _HASH], "left_semi").dropDuplicates(["doc_id", _HASH])))
    return kept.select(docs.columns)
