"""Sets that share a signature: brought together, compared and connected, without all pairs of a group.

Signatures travel packed by bucket; there are as many buckets as their bytes
need.  A group is the different sets that share a signature.  It stands in rows
of at most ``CHUNK`` keys each, with the group's least key beside them.  The
groups are settled in three steps, each of which only looks at pairs whose sets
are of different components so far:

1. every set is compared with one least set of a group of its,
2. then with the least sets of its other groups,
3. then the groups that still hold several components are taken apart, those
   with the same least set together: blocks of sets are held against each other
   by their sketches, which leaves the sets that may have a partner; these come
   with all their shingles, and a block's task hands on only links that join two
   of its components.

So a step hands on as many rows as there are sets in the groups, or in pairs of
blocks of a large one, never all pairs of similar sets.  Sketches must never
rule out a similar pair (or, for sampled ones, only with a stated chance).

Shingles are compared as hashes of which ``KEPT`` bytes are kept: 4000 different
shingles meet by chance once in 10**7 pairs.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from postfunnel.llm.common import mix, partitions, slices, written
from postfunnel.llm.components import components, joined

KEPT = 6
#: Sets of a block at most, and bytes of their shingles.
BLOCK = 2048
BLOCK_BYTES = 8 << 20
FILTER_BITS = 1 << 23
#: Packed signatures of a bucket, and bytes of one.
BUCKET_BYTES = 32 << 20
SIGNATURE_BYTES = 13
#: Signatures that a task packs at a time.
FLUSH = 500_000
#: A bucket's signatures are sorted in so many parts; its highest of 40 bits tell them apart.
PARTS = 16
CHUNK = 4096
PACKED = "bucket int, keys binary, counts binary, low binary, high binary"
_U = np.uint64


class Similar(NamedTuple):
    """What similar means, and the sketches that spare comparisons.

    ``pairs`` are tests (column of the sketches, function of sizes and sketches
    of both sides) for pairs, the cheapest first.  For two blocks of sets,
    ``common`` finds (from sizes and sketches) in what form their sketches can be
    compared, ``matrix`` makes rows of that form, and ``may`` tells which rows may
    be similar to one.  ``width`` is a sketch's length in bytes, where all have the
    same.
    """

    percent: int
    pairs: tuple[tuple[str, Callable], ...]
    sketch: str
    common: Callable
    matrix: Callable
    may: Callable
    width: int | None = None

    def sizes(self, n, others):
        """Which sizes allow the similarity."""
        return 100 * np.minimum(n, others) >= self.percent * np.maximum(n, others)


def sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The sum of the values between each two bounds, as unsigned numbers that wrap."""
    total = np.concatenate((np.zeros(1, _U), np.cumsum(values, dtype=_U)))
    return total[bounds[1:]] - total[bounds[:-1]]


def buckets_for(spark: SparkSession, signatures: int) -> int:
    """How many buckets so many signatures need."""
    return max(partitions(spark), -(-signatures * SIGNATURE_BYTES // BUCKET_BYTES))


class Packer:
    """Collects signatures, the keys of their sets and whether those are guests, and packs them by bucket."""

    def __init__(self, n: int):
        self.n, self.parts, self.held = n, [], 0

    def add(self, sig: np.ndarray, key: np.ndarray, guest: np.ndarray):
        self.parts.append((sig & ~_U(1 << 24) | guest.astype(_U) << _U(24), key))
        self.held += len(sig)
        if self.held >= FLUSH:
            yield from self.flush()

    def flush(self):
        if self.held:
            sig, key = (np.concatenate(x) for x in zip(*self.parts))
            self.parts, self.held = [], 0
            yield _packed_signatures(sig, key, self.n)


def _packed_signatures(sig: np.ndarray, key: np.ndarray, n: int):
    """Rows of a bucket, its sets, how many signatures each has there, and 40 bits of every signature.

    The lowest of the 40 tells the guests.
    """
    bucket = ((sig & _U(0xFFFFFF)) * _U(n) >> _U(24)).astype(np.int64)
    order = np.lexsort((key, bucket))
    bucket, key, high = bucket[order], key[order], (sig >> _U(24))[order]
    run = np.flatnonzero(np.r_[True, (bucket[1:] != bucket[:-1]) | (key[1:] != key[:-1])])
    count = np.diff(np.r_[run, len(key)]).astype("<u4")
    edge = np.searchsorted(bucket, np.arange(n + 1))
    of_run = np.searchsorted(run, edge)
    low, top = (high & _U(0xFFFFFFFF)).astype("<u4"), (high >> _U(32)).astype(np.uint8)
    rows = [(b, key[run[of_run[b]:of_run[b + 1]]].tobytes(), count[of_run[b]:of_run[b + 1]].tobytes(), low[edge[b]:edge[b + 1]].tobytes(), top[edge[b]:edge[b + 1]].tobytes())
            for b in np.unique(bucket).tolist()]
    kinds = (pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], ["bucket", "keys", "counts", "low", "high"])


def groups_of(packed_rows: DataFrame, n: int) -> DataFrame:
    """name, size, least, at and keys of the sets that share a signature; groups of the same sets are one."""
    dealt = packed_rows.repartition(n, "bucket").sortWithinPartitions("bucket")
    found = dealt.mapInArrow(_collide, "name long, size long, least long, at long, keys array<long>")
    return written(found.dropDuplicates(["name", "at"]), "signature-groups")


def _collide(batches):
    """The different sets of sets that share a signature, bucket by bucket."""
    now, rows = None, []
    for batch in batches:
        for bucket, *row in zip(*(c.to_pylist() for c in batch.columns)):
            if bucket != now:
                yield from _shared(rows)
                now, rows = bucket, []
            rows.append(row)
    yield from _shared(rows)


def _shared(rows):
    if not rows:
        return
    sig = np.concatenate([np.frombuffer(low, "<u4").astype(_U) | np.frombuffer(high, np.uint8).astype(_U) << _U(32) for _, _, low, high in rows])
    key = np.concatenate([np.repeat(np.frombuffer(keys, np.int64), np.frombuffer(counts, "<u4")) for keys, counts, _, _ in rows])
    rows.clear()
    for part in range(PARTS):
        at = np.flatnonzero(sig >> _U(36) == _U(part))
        yield from _groups(sig[at], key[at])


def _groups(sig: np.ndarray, key: np.ndarray):
    order = np.argsort(sig)
    sig, key = sig[order], key[order]
    guest, sig = (sig & _U(1)).astype(bool), sig >> _U(1)
    start = np.flatnonzero(np.r_[np.ones(min(1, len(sig)), bool), sig[1:] != sig[:-1]])
    count = np.diff(np.r_[start, len(sig)])
    # A signature's guests stand behind its other sets.
    several = np.repeat((count > 1) & ~guest[start], count)
    sig, key = sig[several], key[several]
    order = np.lexsort((key, sig))
    sig, key = sig[order], key[order]
    fresh = np.ones(len(sig), bool)
    fresh[1:] = (sig[1:] != sig[:-1]) | (key[1:] != key[:-1])
    sig, key = sig[fresh], key[fresh]
    if not len(sig):
        return
    start = np.flatnonzero(np.r_[True, sig[1:] != sig[:-1]])
    stop = np.r_[start[1:], len(sig)]
    name = mix(sums(mix(key.view(_U)), np.r_[start, len(sig)]) + (stop - start).astype(_U))
    several = np.flatnonzero(stop - start > 1)
    _, pick = np.unique(name[several], return_index=True)
    several = several[pick]
    chunks = -(-(stop - start)[several] // CHUNK)
    group = np.repeat(several, chunks)
    at = CHUNK * (np.arange(len(group)) - np.repeat(np.cumsum(chunks) - chunks, chunks))
    for n in range(0, len(group), 2000):
        own, place = group[n:n + 2000], at[n:n + 2000]
        yield pa.RecordBatch.from_pydict({
            "name": pa.array(name[own].view(np.int64)), "size": pa.array(stop[own] - start[own]), "least": pa.array(key[start[own]]), "at": pa.array(place),
            "keys": pa.array([key[start[g] + x:min(stop[g], start[g] + x + CHUNK)] for g, x in zip(own.tolist(), place.tolist())], pa.list_(pa.int64()))})


def packed(values: np.ndarray) -> bytes:
    """The highest bytes of 64-bit hashes."""
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, 8 - KEPT:]).tobytes()


def unpacked(data) -> np.ndarray:
    out = np.zeros((len(data) // KEPT, 8), np.uint8)
    out[:, 8 - KEPT:] = np.frombuffer(data, np.uint8).reshape(-1, KEPT)
    return out.view("<u8").ravel()


def _filter(rows) -> np.ndarray:
    table = np.zeros(FILTER_BITS // 64, np.int64)
    for at, bits in rows:
        table[at] = bits
    return table.view(_U)


def key_filter(wanted: DataFrame):
    """The keys ``wanted``, as a broadcast filter of fixed size, which only lets through more than needed when it fills up."""
    bit = F.col("key").bitwiseAND(F.lit(FILTER_BITS - 1))
    # At most FILTER_BITS / 64 rows, whatever the number of keys.
    marks = wanted.groupBy(F.shiftright(bit, 6).alias("at")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (bit % 64).cast("int"))).alias("bits"))
    return wanted.sparkSession.sparkContext.broadcast(_filter(marks.collect()))


def passing(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which keys the filter lets through."""
    at = keys & (FILTER_BITS - 1)
    return (table[at >> 6] >> (at & 63).astype(_U) & _U(1)).astype(bool)


def whole_sets(wanted: DataFrame, docs: DataFrame, sets_of: Callable) -> DataFrame:
    """key and packed shingles of the sets whose key is ``wanted``, a few more beside them."""
    mask = key_filter(wanted)

    def run(batches):
        table, seen = mask.value, set()
        for batch in batches:
            for part in slices(batch, "text"):
                sets, bounds, keys = sets_of(part.column("text"))
                some = [n for n in np.flatnonzero(passing(table, keys)).tolist() if keys[n] not in seen and not seen.add(keys[n])]
                if some:
                    yield pa.RecordBatch.from_pydict({
                        "key": pa.array(keys[some]), "set": pa.array([packed(sets[bounds[n]:bounds[n + 1]]) for n in some], pa.binary())})

    blobs = docs.where("doc_id IS NOT NULL").select("text").mapInArrow(run, "key long, set binary")
    return written(blobs, "sets").groupBy("key").agg(F.first("set").alias("set"))


def compare(pairs: DataFrame, docs: DataFrame, sets_of: Callable, percent: int) -> DataFrame:
    """The pairs (a, b) of keys whose sets are similar, as links (u, v)."""
    def run(batches):
        for batch in batches:
            keep = []
            for a, b in zip(batch.column("set_a"), batch.column("set_b")):
                a, b = unpacked(a.as_buffer()), unpacked(b.as_buffer())
                both = len(np.intersect1d(a, b, assume_unique=True))
                keep.append(100 * both >= percent * (len(a) + len(b) - both))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["u", "v"]).filter(pa.array(keep, pa.bool_()))

    blobs = whole_sets(pairs.select(F.explode(F.array("a", "b")).alias("key")), docs, sets_of)
    sides = [blobs.select(F.col("key").alias(s), F.col("set").alias(f"set_{s}")) for s in ("a", "b")]
    return pairs.join(sides[1], "b").join(sides[0], "a").select("a", "b", "set_a", "set_b").mapInArrow(run, "u long, v long")


def _sifted(pairs: DataFrame, known: DataFrame, column: str, test: Callable) -> DataFrame:
    """The pairs whose sketches allow enough common shingles."""
    def run(batches):
        for batch in batches:
            if batch.num_rows:
                n_a, n_b = (batch.column(c).to_numpy() for c in ("n_a", "n_b"))
                keep = test(n_a, batch.column("sketch_a").to_pylist(), n_b, batch.column("sketch_b").to_pylist())
                yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(keep))

    for s in ("a", "b"):
        pairs = pairs.join(known.select(F.col("key").alias(s), F.col("n").alias(f"n_{s}"), F.col(column).alias(f"sketch_{s}")), s)
    return pairs.select("a", "b", "n_a", "n_b", "sketch_a", "sketch_b").mapInArrow(run, "a long, b long")


def _rooted(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """The pairs whose sets are of different components so far."""
    for s in ("a", "b"):
        pairs = pairs.join(roots.select(F.col("node").alias(s), F.col("root").alias(f"root_{s}")), s, "left")
    return pairs.where(F.coalesce("root_a", "a") != F.coalesce("root_b", "b")).select("a", "b")


def _block(rows: pa.Array, row: int) -> tuple:
    """Keys, roots, sizes and payloads of one block, by key."""
    own = rows[row].values
    key = own.field("key").to_numpy()
    order = np.argsort(key)
    return key[order], own.field("root").to_numpy()[order], own.field("n").to_numpy()[order], own.field("data").take(pa.array(order)).to_pylist()


def _candidates(similar: Similar):
    """Of two blocks the sets that may be similar to one of another component."""
    def run(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                same = batch.column("same")[row].as_py()
                left = _block(batch.column("left"), row)
                right = left if same else _block(batch.column("right"), row)
                form = similar.common([*left[2], *right[2]], left[3] + right[3])
                a_rows, b_rows = (similar.matrix(n, data, form) for _, _, n, data in (left, right))
                a_out, b_out = np.zeros(len(left[0]), bool), np.zeros(len(right[0]), bool)
                for n, (root, size) in enumerate(zip(left[1], left[2])):
                    start = n + 1 if same else 0
                    at = start + np.flatnonzero((right[1][start:] != root) & similar.sizes(size, right[2][start:]))
                    if len(at):
                        at = at[similar.may(size, a_rows[n], right[2][at], b_rows[at])]
                        a_out[n] |= len(at) > 0
                        b_out[at] = True
                keys = np.unique(np.concatenate((left[0][a_out], right[0][b_out])))
                if len(keys):
                    yield pa.RecordBatch.from_arrays([pa.array([batch.column("name")[row].as_py()] * len(keys), pa.int64()), pa.array(keys)], ["name", "key"])
    return run


def _joining(similar: Similar):
    """Of two blocks the links that join components, one for each two that get joined."""
    def run(batches):
        for batch in batches:
            u, v = [], []
            for row in range(batch.num_rows):
                same = batch.column("same")[row].as_py()
                left = _block(batch.column("left"), row)
                right = left if same else _block(batch.column("right"), row)
                for a, b in _links(similar, left, right, same):
                    u.append(a)
                    v.append(b)
            if u:
                yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])
    return run


def _links(similar: Similar, left, right, same: bool):
    roots = np.unique(np.concatenate((left[1], right[1])))
    label = np.arange(len(roots))  # the component, by now, of each component that came
    a_own, b_own = (np.searchsorted(roots, side[1]) for side in (left, right))
    sets = [[unpacked(x) for x in side[3]] for side in (left, right)]
    names, flat = np.unique(np.concatenate(sets[0] + sets[1]), return_inverse=True)
    cut = sum(map(len, sets[0]))
    a_flat, b_flat = flat[:cut], flat[cut:]
    a_edge, b_edge = (np.concatenate(([0], np.cumsum([len(x) for x in side]))) for side in sets)
    hit = np.zeros(len(names), bool)
    for n in range(len(left[0])):
        start = n + 1 if same else 0
        at = start + np.flatnonzero((label[b_own[start:]] != label[a_own[n]]) & similar.sizes(left[2][n], right[2][start:]))
        if not len(at):
            continue
        own = a_flat[a_edge[n]:a_edge[n + 1]]
        hit[own] = True
        size = b_edge[at + 1] - b_edge[at]
        first = np.cumsum(size) - size
        shared = np.add.reduceat(hit[b_flat[np.repeat(b_edge[at] - first, size) + np.arange(size.sum())]], first, dtype=np.int64)
        hit[own] = False
        linked = at[100 * shared >= similar.percent * (len(own) + size - shared)]
        # One link to each component that this set joins.
        _, pick = np.unique(label[b_own[linked]], return_index=True)
        for m in linked[pick].tolist():
            label[label == label[b_own[m]]] = label[a_own[n]]
            yield left[0][n], right[0][m]


def _gathered(members: DataFrame) -> DataFrame:
    """The members (name, key) of groups that have the same least member, as one group; a set that shares
    signatures with another in many groups comes once for all of them."""
    least = members.groupBy("name").agg(F.min("key").alias("to"))
    return members.join(least, "name").drop("name").withColumnRenamed("to", "name").distinct()


def _blocked(members: DataFrame, data: DataFrame, width: int | None = None) -> DataFrame:
    """Pairs of blocks of a group's sets, as name, same, left and right.

    ``members`` has name, key and root, ``data`` has key, n and data.  A group is
    dealt to as many blocks as its sets and their bytes (``width`` each, or as they
    come) need; the pairs of a group grow with the square of its blocks, not of its sets.
    """
    rows = members.join(data, "key")
    size = F.count("*") * width if width else F.sum(F.octet_length("data"))
    need = F.greatest(F.count("*") / BLOCK, size / BLOCK_BYTES)
    several = written((members if width else rows).groupBy("name").agg(F.ceil(need).alias("parts")).where("parts > 1"), "large-groups")
    block = F.pmod(F.xxhash64("key"), F.coalesce("parts", F.lit(1)))
    blocks = rows.join(several, "name", "left").groupBy("name", block.alias("block")).agg(F.collect_list(F.struct("key", "root", "n", "data")).alias("sets"))
    blocks = written(blocks, "blocks")
    # A block held against itself needs one side only.
    pairs = blocks.select("name", F.lit(True).alias("same"), F.col("sets").alias("left"), F.slice("sets", 1, 1).alias("right"))
    if several.isEmpty():
        return pairs
    parts = blocks.join(several.select("name"), "name", "left_semi")
    left = parts.select("name", F.col("block").alias("x"), F.col("sets").alias("left"))
    right = parts.select("name", F.col("block").alias("y"), F.col("sets").alias("right"))
    return pairs.unionByName(left.join(right, "name").where("x < y").select("name", F.lit(False).alias("same"), "left", "right"))


def settle(groups: DataFrame, known: DataFrame, docs: DataFrame, sets_of: Callable, similar: Similar) -> DataFrame:
    """node and root (its component's least key) of all sets that are similar to another.

    ``groups`` has name, size, least, at and keys (the keys from place ``at``
    on); ``known`` has key, n and the sketches of the sets that stand in groups.
    ``sets_of`` gives shingles, bounds and keys of texts.
    """
    stars = groups.select(F.col("least").alias("a"), F.explode("keys").alias("b")).where("a <> b").distinct()
    for column, test in similar.pairs:
        stars = _sifted(stars, known, column, test)
    stars = written(stars, "pairs")
    first = written(stars.groupBy("b").agg(F.min("a").alias("a")).select("a", "b"), "pairs")
    roots = written(components(compare(first, docs, sets_of, similar.percent)), "roots")
    late = written(_rooted(stars, roots), "pairs")
    if not late.isEmpty():
        roots = written(joined(roots, compare(late, docs, sets_of, similar.percent)), "roots")

    # Groups whose sets are not all connected yet; the least set of each has been compared with all others.
    members = groups.where("size > 2").select("name", "least", F.explode("keys").alias("key")).where("key <> least")
    members = members.join(roots.withColumnRenamed("node", "key"), "key", "left").select("name", "key", F.coalesce("root", "key").alias("root"))
    open_names = members.groupBy("name").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("name")
    members = written(_gathered(members.join(open_names, "name", "left_semi")), "open-groups")
    data = known.select("key", "n", F.col(similar.sketch).alias("data"))
    found = _blocked(members, data, similar.width).mapInArrow(_candidates(similar), "name long, key long").distinct()
    found = written(_gathered(found), "candidates")
    if found.isEmpty():
        return roots
    sets = whole_sets(found.select("key").distinct(), docs, sets_of).join(known.select("key", "n"), "key")
    sets = written(sets.select("key", "n", F.col("set").alias("data")), "sets")
    found = found.join(members.select("key", "root").distinct(), "key")
    links = _blocked(found, sets).mapInArrow(_joining(similar), "u long, v long")
    return written(joined(roots, links), "roots")


def filtered(nodes: DataFrame, groups: DataFrame) -> DataFrame:
    """The rows of ``nodes`` whose sets stand in groups, a few more beside them: spares shuffling the others' sketches."""
    mask = key_filter(groups.select(F.explode("keys").alias("key")))

    def run(batches):
        for batch in batches:
            yield batch.filter(pa.array(passing(mask.value, batch.column("key").to_numpy())))

    return nodes.mapInArrow(run, nodes.schema)


def known_sets(nodes: DataFrame, groups: DataFrame, *sketches: str) -> DataFrame:
    """key, n and sketches of the different sets that stand in groups; ``nodes`` has a row for each text."""
    sets = nodes.where("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("key").agg(
        F.first("n_shingles").alias("n"), *[F.first(c).alias(c) for c in sketches])
    return written(sets.join(groups.select(F.explode("keys").alias("key")).distinct(), "key", "left_semi"), "candidate-sets")


def classes(nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """The rows of ``nodes`` (doc_id, text_hash, n_shingles, key) with component_id, the least doc_id of the component.

    ``is_first`` marks the row that stands for its component, the least by
    doc_id and text_hash.  Rows without doc_id are in no component, empty sets
    are alone in theirs.
    """
    own = F.struct("doc_id", "text_hash")
    sets = nodes.where("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("key").agg(F.min(own).alias("row"))
    named = sets.join(roots.withColumnRenamed("node", "key"), "key", "left").select("key", "row", F.coalesce("root", "key").alias("root"))
    class_of = named.join(named.groupBy("root").agg(F.min("row").alias("least")), "root").select("key", "least")
    return (
        nodes.select("doc_id", "text_hash", "n_shingles", "key").join(class_of, "key", "left")
        .withColumn("least", F.coalesce("least", own))
        .select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("least.doc_id")).alias("component_id"),
                "text_hash", (F.col("doc_id").isNull() | (own == F.col("least"))).alias("is_first")))
