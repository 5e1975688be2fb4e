"""MinHash near-dedup by HyperMinHash registers.

A document is a set of word shingles.  Every shingle's hash names one of
``REGISTERS`` buckets, and a bucket stores of the least second hash that fell
into it the count of leading zeros and the next ``MANTISSA`` bits: 8 bits in
place of 64.  Two sets' registers agree where the least shingle of their union
is in both, that is with the chance of their Jaccard similarity, or where two
different hashes look alike.

So that no bucket of a small set stays empty, the shingles of a set of 2**c to
2**(c+1) count as several each, under different hashes, as many as class c
needs.  A set within reach of the next class has registers there too, as a
guest; two guests meet in their own class.

``ROWS`` registers in a row are a band, and the hash of its registers a
signature.  A pair at the threshold of 0.8 shares one of the 64 bands but with a
chance of (1 - 0.8**6)**64, 4 in 10**9, and a pair of 0.1 does so once in 8,000.
Pairs that share one get an estimate, the share of equal registers corrected
for the expected chance agreements; one ``SPREAD`` standard deviations under the
threshold (2 in 10**8 of the pairs at the threshold) is not looked at further.
All others are compared by their whole sets, and only pairs across components
are (``meet.py``).  So links are exact, and one that is there is missed with
less than a chance of 10**-7.

Defined results: without words, or with a null text, the set is empty and linked
with nothing.  Rows without doc_id get n_shingles, no component, and are kept.
Equal rows get equal results.  A set of less than 4 shingles is only ever linked
with its equals, which are one node from the start.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from postfunnel.llm.common import mix, slices, written
from postfunnel.llm.jaccard import keyed_sets
from postfunnel.llm.meet import PACKED, Packer, Similar, buckets_for, classes, filtered, groups_of, known_sets, settle

WORDS = 2
PERCENT = 80
ROWS = 6
BANDS = 64
REGISTERS = ROWS * BANDS
MANTISSA = 4
#: Counts of leading zeros from this on are one, 4 bits hold them; a bucket needs 2**15 elements to get there.
ZEROS = 15
#: Shingles, or copies of them, that a bucket gets on average at least.
FILL = 4
SPREAD = 5.5
LEAST = 4
#: What no hash looks like: an empty bucket.
EMPTY = 0xFF
WIDE = REGISTERS
_U = np.uint64


def set_class(sizes: np.ndarray) -> np.ndarray:
    """The whole part of each size's binary logarithm."""
    return np.frexp(np.maximum(sizes, 1).astype(np.float64))[1] - 1


def copies(classes: np.ndarray) -> np.ndarray:
    """As how many different elements each shingle counts in a class."""
    return np.maximum(1, -(-FILL * REGISTERS // (1 << classes.astype(np.int64))))


def compressed(least: np.ndarray) -> np.ndarray:
    """Leading zeros and the bits behind the first one, of 64-bit numbers."""
    part, power = np.frexp((least >> _U(11)).astype(np.float64))
    bits = np.floor((2 * part - 1) * (1 << MANTISSA)).astype(np.int64)
    return np.where(power > 53 - ZEROS, (53 - power) << MANTISSA | bits, ZEROS << MANTISSA).astype(np.uint8)


def registers(sets: np.ndarray, bounds: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """The registers of each set, one row each; ``classes`` says how often its shingles count."""
    sizes, times = np.diff(bounds), copies(classes)
    # A copy's number is a salt of the shingle's hash.
    shingle = np.repeat(np.arange(len(sets)), np.repeat(times, sizes))
    owner = np.repeat(np.arange(len(sizes)), sizes * times)
    per_set = np.repeat(times, sizes)
    copy = np.arange(len(shingle)) - np.repeat(np.cumsum(per_set) - per_set, per_set)
    value = mix(sets[shingle] + copy.astype(_U) * _U(0x632BE59BD9B4E019))
    bucket = owner * REGISTERS + ((value >> _U(32)) * _U(REGISTERS) >> _U(32)).astype(np.int64)
    least = np.full(len(sizes) * REGISTERS, ~_U(0))
    np.minimum.at(least, bucket, mix(value ^ _U(0xD6E8FEB86659FD93)))
    out = compressed(least)
    some = np.zeros(len(least), bool)
    some[bucket] = True
    out[~some] = EMPTY
    return out.reshape(-1, REGISTERS)


def sketched(sets: np.ndarray, bounds: np.ndarray) -> list[bytes]:
    """Each set's registers in its class, and behind them those of the next class where it is a guest there."""
    sizes = np.diff(bounds)
    out = [b""] * len(sizes)
    classes = set_class(sizes)
    able = sizes >= LEAST
    guest = able & (100 * sizes >= PERCENT * (2 << classes.astype(np.int64)))
    for some, up in ((able, 0), (guest, 1)):
        at = np.flatnonzero(some)
        # Some sets' worth of copies at a time.
        work = np.cumsum(sizes[at] * copies(classes[at] + up))
        for part in np.split(at, np.searchsorted(work, np.arange(1 << 21, work[-1], 1 << 21))) if len(at) else ():
            size = sizes[part]
            first = np.cumsum(size) - size
            own = sets[np.repeat(bounds[:-1][part] - first, size) + np.arange(size.sum())]
            for n, row in zip(part.tolist(), registers(own, np.append(first, size.sum()), classes[part] + up)):
                out[n] += row.tobytes()
    return out


def signatures(sizes: np.ndarray, sketches: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The hashes of all bands of all sets, the set of each, and whether it is a guest there."""
    sig, who, guest = [np.zeros(0, _U)], [np.zeros(0, np.int64)], [np.zeros(0, bool)]
    classes = set_class(sizes)
    for up in (0, 1):
        at = np.flatnonzero([len(x) > up * WIDE for x in sketches])
        if not len(at):
            continue
        own = np.frombuffer(b"".join([sketches[n][up * WIDE:(up + 1) * WIDE] for n in at.tolist()]), np.uint8).reshape(len(at), BANDS, ROWS)
        hashed = mix((classes[at] + up).astype(_U)[:, None] * _U(0x9E3779B97F4A7C15) + np.arange(BANDS, dtype=_U))
        for row in range(ROWS):
            hashed = mix(hashed + own[:, :, row].astype(_U) + _U(1))
        full = (own != EMPTY).any(2)  # a band of empty buckets says nothing
        sig.append(hashed[full])
        who.append(np.repeat(at, full.sum(1)))
        guest.append(np.full(int(full.sum()), up == 1))
    return np.concatenate(sig), np.concatenate(who), np.concatenate(guest)


def estimate(n_a, left: np.ndarray, n_b, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The Jaccard similarity by equal registers, corrected for chance agreements, and how many registers tell it.

    The least of x and of y different elements look alike with a chance of
    x y / (x + y)**2 / (2 ln 2) / 2**MANTISSA: the square of the density of both
    at a place times the mean width of what looks alike there.
    """
    used = ((left != EMPTY) | (right != EMPTY)).sum(1)
    equal = ((left == right) & (left != EMPTY)).sum(1)
    chance = n_a * n_b / (n_a + n_b) ** 2 / (2 * np.log(2)) / (1 << MANTISSA)
    return (equal / np.maximum(used, 1) - chance) / (1 - chance), used


def _may(n_a, left, n_b, right):
    told, used = estimate(n_a, left, n_b, right)
    share = PERCENT / 100
    return told >= share - SPREAD * np.sqrt(share * (1 - share) / np.maximum(used, 1))


def _rows(sizes: np.ndarray, sketches: list[bytes], classes: np.ndarray) -> np.ndarray:
    """Each set's registers in the class given, empty where it has none there."""
    out = np.full((len(sizes), REGISTERS), EMPTY, np.uint8)
    up = classes - set_class(sizes)
    for n, (x, step) in enumerate(zip(sketches, up.tolist())):
        part = x[step * WIDE:(step + 1) * WIDE] if 0 <= step <= 1 else b""
        if part:
            out[n] = np.frombuffer(part, np.uint8)
    return out


def _may_pair(n_a, left, n_b, right):
    n_a, n_b = n_a.astype(np.float64), n_b.astype(np.float64)
    common = set_class(np.maximum(n_a, n_b))
    fit = 100 * np.minimum(n_a, n_b) >= PERCENT * np.maximum(n_a, n_b)
    return fit & _may(n_a, _rows(n_a, left, common), n_b, _rows(n_b, right, common))


def _matrix(sizes, sketches, common):
    return _rows(sizes, sketches, np.full(len(sizes), common))


def _common(sizes, sketches):
    """The class of the largest set is the one that all sets of a group have registers in."""
    return set_class(np.array([max(sizes)]))[0]


def _may_row(n, row, others, rows):
    return _may(float(n), row[None, :], others.astype(np.float64), rows)


SIMILAR = Similar(PERCENT, (("sketch", _may_pair),), "sketch", _common, _matrix, _may_row, 2 * WIDE)


def _sketches(size: int):
    sets_of = keyed_sets(size)

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                sets, bounds, keys = sets_of(part.column("text"))
                yield pa.RecordBatch.from_pydict({
                    "doc_id": part.column("doc_id"), "text_hash": part.column("text_hash"), "n_shingles": pa.array(np.diff(bounds), pa.int64()),
                    "key": pa.array(keys), "sketch": pa.array(sketched(sets, bounds), pa.binary())})
    return run


def _emit(buckets: int):
    def run(batches):
        seen, packer = set(), Packer(buckets)
        for batch in batches:
            keys = batch.column("key").to_numpy()
            new = [n for n, key in enumerate(keys.tolist()) if key not in seen and not seen.add(key)]  # copies within a task are one set
            for start in range(0, len(new), 1000):
                part = new[start:start + 1000]
                rows = batch.column("sketch").take(pa.array(part)).to_pylist()
                sig, who, guest = signatures(batch.column("n_shingles").to_numpy()[part], rows)
                yield from packer.add(sig, keys[part][who], guest)
        yield from packer.flush()
    return run


def near_duplicates(docs: DataFrame, size: int = WORDS) -> DataFrame:
    """doc_id, n_shingles, component_id, text_hash and is_first of every row of ``docs`` (doc_id, text).

    ``is_first`` marks the row that stands for its component, the least by
    doc_id and text_hash (xxhash64 of the text).
    """
    docs = docs.select("doc_id", "text")
    nodes = written(docs.withColumn("text_hash", F.xxhash64("text")).mapInArrow(
        _sketches(size), "doc_id long, text_hash long, n_shingles long, key long, sketch binary"), "register-sketches")
    # At most a set's bands in its own class and as a guest.
    buckets = buckets_for(docs.sparkSession, 2 * BANDS * nodes.count())
    able = nodes.where(f"doc_id IS NOT NULL AND n_shingles >= {LEAST}").select("n_shingles", "key", "sketch")
    groups = groups_of(able.mapInArrow(_emit(buckets), PACKED), buckets)
    known = known_sets(filtered(nodes, groups), groups, "sketch")
    return classes(nodes, settle(groups, known, docs, keyed_sets(size), SIMILAR))
