"""Best-fit packing by a vector of capacities.

A text's token ids and the id that ends it form one run; only a run longer than
a sequence is cut, into full pieces and a last shorter one.  A sequence has
three capacities: tokens, documents, and attention cost (the sum of squared
piece lengths).  The longest piece goes first; of the sequences with room in
all three it takes the one that fits best: by default the smallest weighted
norm of what would be left, or the largest weighted dot product of the piece
with what is left.

Full pieces are sequences of their own.  The others are dealt by the hash of
their row and piece into groups of about ``group`` pieces, each packed in one
task, so equal ids and copies spread evenly.  A group wastes less than one
sequence more than the whole would.  Only lengths and checksums are shuffled.

Defined results: a null text is empty and has only the ending id.  Rows without
doc_id are packed like others; equal rows are packed once each.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from postfunnel.llm.common import hash_spans, slices, word_spans, worker_state, written

SLICE = 2 << 20
PIECES = "uid long, doc_id long, piece int, start long, length long, ids_crc32 long"
#: Words a worker keeps the ids of, some 20 bytes each: those met since the last turn, and as many from before it.
CACHE = 1_500_000
JOINED = 256
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True


def _gather(pool: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The runs of ``pool`` that start at ``starts``, end to end."""
    ends = np.cumsum(sizes)
    return pool[np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)]


class _Known:
    """Ids of words by the words' hashes: sorted hashes, and for each the run of one pool that holds its ids."""

    def __init__(self, kind):
        self.keys, self.starts, self.sizes = np.zeros(0, np.uint64), np.zeros(0, np.uint32), np.zeros(0, np.uint32)
        self.pool = np.zeros(0, kind)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which keys are known, and the place of those."""
        at = np.searchsorted(self.keys, keys)
        hit = np.zeros(len(keys), bool)
        inside = at < len(self.keys)
        hit[inside] = self.keys[at[inside]] == keys[inside]
        return hit, at[hit]

    def ids(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sizes = self.sizes[at].astype(np.int64)
        return _gather(self.pool, self.starts[at].astype(np.int64), sizes), sizes

    def add(self, keys: np.ndarray, ids: np.ndarray, sizes: np.ndarray) -> None:
        starts = len(self.pool) + np.cumsum(sizes) - sizes
        merged = np.concatenate((self.keys, keys))
        order = np.argsort(merged, kind="stable")
        self.keys = merged[order]
        self.starts = np.concatenate((self.starts, starts.astype(np.uint32)))[order]
        self.sizes = np.concatenate((self.sizes, sizes.astype(np.uint32)))[order]
        self.pool = np.concatenate((self.pool, ids))

    def full(self) -> bool:
        return len(self.keys) > CACHE or len(self.pool) > 8 * CACHE


class _Encoder:
    """Token ids of texts for word-ending vocabularies that drop white space and case.

    ASCII white space ends a word in such a vocabulary, so a text's ids are its
    words' ids in a row.  The different words of a slice are looked up by their
    hash, and only words not met before are encoded.
    """

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one task, one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[n for token, n in vocabulary.items() if token.endswith("</w>")]] = True
        self.kind = np.uint16 if len(self.ends) <= 1 << 16 else np.uint32
        self.known, self.before = _Known(self.kind), _Known(self.kind)

    def _ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _encode_words(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the words end to end and each word's number of ids.

        Words of ASCII letters, with or without a mark at the end, go through many at a time.
        """
        blob = data.tobytes()
        letters = np.concatenate(([0], np.cumsum(_LETTER[data])))
        marked = np.isin(data[ends - 1], [44, 46]) & (ends - starts > 1)
        plain = letters[ends] - letters[starts] == ends - starts - marked
        words = [blob[a:z].decode("utf-8") for a, z in zip(starts.tolist(), ends.tolist())]
        sizes = np.zeros(len(words), np.int64)
        found: list[tuple[np.ndarray, np.ndarray]] = []  # places of words, their ids end to end
        odd = [np.flatnonzero(~plain)]
        smooth = np.flatnonzero(plain)
        for at in range(0, len(smooth), JOINED):
            part = smooth[at:at + JOINED]
            ids = np.array(self._ids([" ".join([words[n] for n in part.tolist()])])[0], self.kind)
            last = np.flatnonzero(self.ends[ids]) + 1
            pieces = np.cumsum(1 + marked[part])  # letters are one piece, a mark after them another
            if len(last) == pieces[-1]:
                sizes[part] = np.diff(last[pieces - 1], prepend=0)
                found.append((part, ids))
            else:
                odd.append(part)
        rest = np.concatenate(odd)
        for at in range(0, len(rest), JOINED):
            part = rest[at:at + JOINED]
            lists = self._ids([words[n] for n in part.tolist()])
            sizes[part] = [len(x) for x in lists]
            found.append((part, np.array([i for x in lists for i in x], self.kind)))
        order = np.concatenate([part for part, _ in found] or [np.zeros(0, np.int64)])
        pool = np.concatenate([ids for _, ids in found] or [np.zeros(0, self.kind)])
        place = np.empty(len(words), np.int64)
        place[order] = np.cumsum(sizes[order]) - sizes[order]
        return _gather(pool, place, sizes), sizes

    def _look_up(self, keys: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of different words end to end and each word's number of ids."""
        if self.known.full():
            self.before, self.known = self.known, _Known(self.kind)
        hit, at = self.known.find(keys)
        late = np.flatnonzero(~hit)
        older, place = self.before.find(keys[late])
        fresh = late[~older]
        parts = [(np.flatnonzero(hit), *self.known.ids(at)), (late[older], *self.before.ids(place)),
                 (fresh, *self._encode_words(data, starts[fresh], ends[fresh]))]
        order = np.concatenate([p[0] for p in parts])
        pool = np.concatenate([p[1] for p in parts])
        sizes, begin = np.empty(len(keys), np.int64), np.empty(len(keys), np.int64)
        sizes[order] = np.concatenate([p[2] for p in parts])
        begin[order] = np.cumsum(sizes[order]) - sizes[order]
        self.known.add(keys[late], _gather(pool, begin[late], sizes[late]), sizes[late])
        return _gather(pool, begin, sizes), sizes

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """The ids of each text."""
        data, starts, ends, bounds = word_spans(texts)
        keys, first, word = np.unique(hash_spans(data, starts, ends), return_index=True, return_inverse=True)
        pool, sizes = self._look_up(keys, data, starts[first], ends[first])
        length = sizes[word]
        place = np.concatenate(([0], np.cumsum(length)))
        flat = _gather(pool, (np.cumsum(sizes) - sizes)[word], length).astype("<u4")
        out = [flat[place[a]:place[z]] for a, z in zip(bounds[:-1], bounds[1:])]
        # The hashes drop case, special tokens do not.
        for n in pc.indices_nonzero(pc.fill_null(pc.match_substring(texts, "<|"), False)).to_pylist():
            out[n] = np.array(self._ids([texts[n].as_py()])[0], "<u4")
        return out


def encoder(path: str) -> _Encoder:
    state = worker_state()
    if getattr(state, "encoder_path", None) != path:
        state.encoder, state.encoder_path = _Encoder(path), path
    return state.encoder


def cut(docs: DataFrame, vocabulary: str, end_id: int = 1, capacity: int = 4096) -> DataFrame:
    """The pieces of all texts.  ``vocabulary`` is a tokenizers file that every executor has."""
    def run(batches):
        own, row = encoder(vocabulary), TaskContext.get().partitionId() << 36
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                out = []
                for doc_id, ids in zip(part.column("doc_id").to_pylist(), own.encode(part.column("text"))):
                    ids = np.append(ids, np.array(end_id, "<u4"))
                    for n, at in enumerate(range(0, len(ids), capacity)):
                        piece = ids[at:at + capacity]
                        out.append((row, doc_id, n, at, len(piece), zlib.crc32(piece.tobytes())))
                    row += 1
                columns = list(zip(*out))
                kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], [c.split()[0] for c in PIECES.split(", ")])

    return docs.select("doc_id", "text").mapInArrow(run, PIECES)


def best_fit(lengths: np.ndarray, capacity: tuple[float, float, float], weights=(1.0, 0.05, 0.05), rule: str = "norm"):
    """The sequence of each piece and its offset there; pieces are taken as given, longest first."""
    need = np.stack([lengths, np.ones_like(lengths), lengths * lengths], 1) / np.array(capacity)
    left = np.ones((len(lengths), 3))
    filled = np.zeros(len(lengths), np.int64)
    # Exact room in whole numbers beside the scaled one that ranks.
    room = np.tile(np.array(capacity, np.int64), (len(lengths), 1))
    exact = np.stack([lengths, np.ones_like(lengths), lengths * lengths], 1).astype(np.int64)
    home, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    live, opened = np.zeros(0, np.int64), 0
    least = lengths.min() if len(lengths) else 0
    w = np.array(weights)
    for n in range(len(lengths)):
        fits = live[(room[live] >= exact[n]).all(1)]
        if len(fits):
            if rule == "norm":
                at = fits[np.argmin((w * (left[fits] - need[n]) ** 2).sum(1))]
            else:
                at = fits[np.argmax((w * left[fits] * need[n]).sum(1))]
        else:
            at, opened = opened, opened + 1
            live = np.append(live, at)
        home[n], offset[n] = at, filled[at]
        filled[at] += lengths[n]
        left[at] -= need[n]
        room[at] -= exact[n]
        if room[at][0] < least or room[at][1] < 1:
            live = live[live != at]
    return home, offset


def pack(pieces: DataFrame, capacity: int = 4096, max_docs: int | None = None, max_cost: int | None = None,
         group: int = 8192, rule: str = "norm") -> DataFrame:
    """The pieces with sequence_id and offset.

    ``max_docs`` and ``max_cost`` bound the documents and the attention cost of
    a sequence; unset, they are as wide as the token capacity allows.
    """
    limits = (capacity, max_docs or capacity, max_cost or capacity * capacity)
    pieces = written(pieces, "pieces")
    loose = pieces.where(F.col("length") < capacity)
    groups = max(1, -(-loose.count() // group))
    out = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    names = [c.split()[0] for c in out.split(", ")]

    def run(key, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["length", "uid", "piece"], ascending=[False, True, True])
        home, offset = best_fit(frame["length"].to_numpy(np.int64), limits, rule=rule)
        # Even numbers; odd ones are the full pieces'.
        return frame.assign(sequence_id=2 * (home * groups + int(key[0])), offset=offset)[names]

    packed = loose.withColumn("_group", F.pmod(F.xxhash64("uid", "piece"), F.lit(groups))).groupBy("_group").applyInPandas(run, out)
    full = pieces.where(F.col("length") >= capacity).select(
        *names[:5], (2 * F.monotonically_increasing_id() + 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return packed.unionByName(full)
