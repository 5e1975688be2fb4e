"""Two tokenizers' tokens aligned at the byte offsets where both end one.

Every text is encoded by a byte-level vocabulary (A, a space put before it) and
by a piece model (B, which puts its own).  The ends of both token rows are byte
offsets in the same string.  Divide and conquer finds the shared ones: in every
interval the end of A's middle token is looked for among B's ends by bisection,
then those of its neighbours to either side in turn; the first shared one cuts
the interval in two, and an interval without one is a leaf, a group of tokens
of A and of B that stand for the same bytes.  All intervals of a slice of texts
that lie equally deep are cut at the same time.

Links are all pairs of a token of A and one of B in a group.  How many texts of
the corpus hold an id pair linked is counted in three steps: within blocks of
some ``BLOCK_BYTES`` of text, over the blocks by a sum that is shuffled, and back,
by a join, as one small dictionary for each block, which then meets the block's
texts in one task.  So no task holds the counts of all pairs, and the pair that
stands in every text is one row a block.  The highest count of each id of A
(as many rows as A has ids) is broadcast.

Defined results: a null or empty text, and one whose tokens of A or of B do not
spell the space and the text, has no tokens, groups and links.  Rows are counted
one by one, repeated rows and rows without doc_id included.  A text is handled
in one task, in memory in proportion to its tokens and different links.
"""

from __future__ import annotations

import json
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from postfunnel.llm.common import partitions, raw, slices, worker_state, written

BLOCK_BYTES = 16 << 20
#: Blocks that a task scores one after the other, on average.
BLOCKS = 4
#: A link's code is A's id times this plus B's id.
SHIFT = 16
#: Words or white space of more bytes go to the tokenizer that takes n log n for them.
LONG_PIECE = 1000
#: Groups with more links than this are counted by different ids first.
MANY = 4096
#: Different links that a count holds before it is handed on.
HELD = 1 << 22
ALIGNED = ("doc_id long, block long, n_a long, n_b long, n_groups long, n_links long, groups string, codes binary, times binary")


class Tokenizers(NamedTuple):
    """Files of the two vocabularies, and the pattern that cuts texts into pieces for A."""

    byte_level: str
    pattern: str
    pieces: str


def byte_of_character() -> dict[str, int]:
    """Byte-level vocabularies write a byte as its character where that is printable, else as one from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + n): b for n, b in enumerate(rest)}


class _Encoders:
    def __init__(self, files: Tokenizers):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one task, one core
        import sentencepiece
        import tiktoken
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(files.byte_level)
        self.whole.encode_special_tokens = True
        with open(files.byte_level, encoding="utf-8") as f:
            told = json.load(f)
        special = {t["content"] for t in told["added_tokens"]}
        byte = byte_of_character()
        ranks = {bytes(byte[c] for c in token): n for token, n in told["model"]["vocab"].items() if token not in special}
        self.a_bytes = [b""] * (max(told["model"]["vocab"].values(), default=0) + 1)
        for token, n in ranks.items():
            self.a_bytes[n] = token
        # Ids in the order of the merges are ranks: the same tokens, several times faster.
        self.fast = tiktoken.Encoding("ranks", pat_str=files.pattern, mergeable_ranks=ranks, special_tokens={})
        self.pieces = sentencepiece.SentencePieceProcessor(model_file=files.pieces)
        self.b_bytes = [self._piece(n) for n in range(self.pieces.get_piece_size())]
        self.a_size, self.b_size = (np.array([len(x) for x in own], np.int64) for own in (self.a_bytes, self.b_bytes))

    def _piece(self, n: int) -> bytes:
        if self.pieces.is_byte(n):
            return bytes([int(self.pieces.id_to_piece(n)[3:5], 16)])
        if self.pieces.is_control(n) or self.pieces.is_unknown(n):
            return b""
        return self.pieces.id_to_piece(n).replace("▁", " ").encode()

    def encode(self, texts: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
        """The ids of A and of B of each text; none where they do not spell it."""
        none = np.zeros(0, np.int64)
        out = [(none, none)] * len(texts)
        long = _long_pieces(texts)
        some = [n for n, text in enumerate(texts.to_pylist()) if text]
        for n, b in zip(some, self.pieces.encode([texts[n].as_py() for n in some], num_threads=1)):
            text = " " + texts[n].as_py()
            a = self.whole.encode(text, add_special_tokens=False).ids if long[n] else self.fast.encode_ordinary(text)
            spelt = text.encode()
            if b"".join([self.a_bytes[x] for x in a]) == spelt and b"".join([self.b_bytes[x] for x in b]) == spelt:
                out[n] = np.array(a, np.int64), np.array(b, np.int64)
        return out


def _long_pieces(texts: pa.Array) -> np.ndarray:
    """Which texts have very long words or stretches of white space."""
    data, bounds = raw(texts)
    out = np.zeros(len(texts), bool)
    if len(data):
        blank = (data == 32) | (data - np.uint8(9) < 5)
        for alike in (~blank, blank | (data > 127)):  # other characters may be white space as well
            turn = np.flatnonzero(np.concatenate(([True], alike[1:] != alike[:-1], [True])))
            at, to = turn[:-1], turn[1:]
            wide = alike[at] & (to - at > LONG_PIECE)
            for x, y in zip(at[wide], to[wide]):
                out[np.searchsorted(bounds, x, "right") - 1:np.searchsorted(bounds, y, "left")] = True
    return out


def encoders(files: Tokenizers) -> _Encoders:
    state = worker_state()
    if getattr(state, "aligned_by", None) != files:
        state.aligners, state.aligned_by = _Encoders(files), files
    return state.aligners


def shared_cuts(a_ends: np.ndarray, b_ends: np.ndarray, a_bounds: np.ndarray, b_bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The last token of A and of B of every group, in order.

    The ends of all texts' tokens are offsets in the texts put end to end, so
    each text's last ends are shared.
    """
    a_lo, a_hi, b_lo, b_hi = a_bounds[:-1], a_bounds[1:] - 1, b_bounds[:-1], b_bounds[1:] - 1
    some = a_hi >= a_lo
    a_lo, a_hi, b_lo, b_hi = a_lo[some], a_hi[some], b_lo[some], b_hi[some]
    a_cuts, b_cuts = [a_hi], [b_hi]
    while len(a_lo):
        # The ends before the last are what may cut an interval.
        open_ = (a_hi > a_lo) & (b_hi > b_lo)
        a_lo, a_hi, b_lo, b_hi = a_lo[open_], a_hi[open_], b_lo[open_], b_hi[open_]
        middle = (a_lo + a_hi - 1) // 2
        a_cut, b_cut = np.full(len(a_lo), -1), np.full(len(a_lo), -1)
        seek, far = np.arange(len(a_lo)), 0
        while len(seek):
            for step in ((far, -far) if far else (0,)):
                place = middle[seek] + step
                inside = (place >= a_lo[seek]) & (place < a_hi[seek])
                at, place = seek[inside], place[inside]
                found = np.searchsorted(b_ends, a_ends[place])
                hit = b_ends[found] == a_ends[place]
                a_cut[at[hit]], b_cut[at[hit]] = place[hit], found[hit]
                seek = seek[a_cut[seek] < 0]
            far += 1
            seek = seek[(middle[seek] - far >= a_lo[seek]) | (middle[seek] + far < a_hi[seek])]
        cut = a_cut >= 0
        a_cut, b_cut = a_cut[cut], b_cut[cut]
        a_cuts.append(a_cut)
        b_cuts.append(b_cut)
        a_lo, a_hi = np.concatenate((a_lo[cut], a_cut + 1)), np.concatenate((a_cut, a_hi[cut]))
        b_lo, b_hi = np.concatenate((b_lo[cut], b_cut + 1)), np.concatenate((b_cut, b_hi[cut]))
    return np.sort(np.concatenate(a_cuts)), np.sort(np.concatenate(b_cuts))


def _digits(limit: int) -> tuple[np.ndarray, np.ndarray]:
    """The decimal digits of all numbers below ``limit`` and how many each has."""
    told = [str(n).encode() for n in range(limit)]
    width = len(told[-1])
    return np.frombuffer(b"".join(x.ljust(width) for x in told), np.uint8).reshape(-1, width), np.array([len(x) for x in told])


def _told(a, b, a_last, b_last, owner, n_texts) -> pa.Array:
    """``a1,a2|b1;a3|b2,b3`` of every text; ``owner`` is each group's text."""
    state = worker_state()
    if not hasattr(state, "digits"):
        state.digits = _digits(1 << SHIFT)
    digits, width = state.digits
    a_group, b_group = np.searchsorted(a_last, np.arange(len(a))), np.searchsorted(b_last, np.arange(len(b)))
    # A group's tokens of A stand after all tokens of B of the groups before it.
    a_at = np.arange(len(a)) + np.concatenate(([0], b_last + 1))[a_group]
    b_at = np.arange(len(b)) + (a_last + 1)[b_group]
    ids, mark = np.zeros(len(a) + len(b), np.int64), np.full(len(a) + len(b), ord(","), np.uint8)
    ids[a_at], ids[b_at] = a, b
    mark[a_at[a_last]], mark[b_at[b_last]] = ord("|"), ord(";")
    wide = width[ids] + 1
    closing = np.flatnonzero(np.r_[owner[1:] != owner[:-1], np.ones(min(1, len(owner)), bool)])
    final = b_at[b_last[closing]]
    wide[final] -= 1
    edge = np.concatenate(([0], np.cumsum(wide)))
    out = np.zeros(edge[-1] + 1, np.uint8)
    out[edge[:-1] + width[ids]] = mark  # a last mark is written over by the text that follows
    for k in range(digits.shape[1]):
        some = width[ids] > k
        out[edge[:-1][some] + k] = digits[ids[some], k]
    ends = np.concatenate(([0], edge[final + 1]))
    offsets = ends[np.searchsorted(owner[closing], np.arange(n_texts + 1))]
    return pa.StringArray.from_buffers(n_texts, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(out[:edge[-1]].copy()))


def _different(ids, last, large):
    """Ids, how often each stands in its group, and the groups' counts; the ids of ``large`` groups only once each."""
    group = np.searchsorted(last, np.arange(len(ids)))
    times = np.ones(len(ids), np.int64)
    some = large[group]
    if some.any():
        keys, n = np.unique(group[some] << 32 | ids[some], return_counts=True)
        group, ids, times = (np.concatenate((x[~some], y)) for x, y in ((group, keys >> 32), (ids, keys & 0xFFFFFFFF), (times, n)))
        order = np.argsort(group, kind="stable")
        group, ids, times = group[order], ids[order], times[order]
    return ids, times, np.bincount(group, minlength=len(last))


def _links(a, b, a_last, b_last, owner, n_texts):
    """Each text's different links (codes, ascending) and how often each stands there, with the texts' bounds."""
    large = np.diff(a_last, prepend=-1) * np.diff(b_last, prepend=-1) > MANY
    a, a_times, na = _different(a, a_last, large)
    b, b_times, nb = _different(b, b_last, large)
    pairs = na * nb
    group = np.repeat(np.arange(len(pairs)), pairs)
    at = np.arange(len(group)) - np.repeat(np.cumsum(pairs) - pairs, pairs)
    left, right = (np.cumsum(na) - na)[group] + at // nb[group], (np.cumsum(nb) - nb)[group] + at % nb[group]
    key = owner[group] << (2 * SHIFT) | a[left] << SHIFT | b[right]
    order = np.argsort(key)
    key, times = key[order], (a_times[left] * b_times[right])[order]
    first = np.flatnonzero(np.r_[np.ones(min(1, len(key)), bool), key[1:] != key[:-1]])
    times = np.add.reduceat(times, first) if len(first) else times
    key = key[first]
    return key & ((1 << 2 * SHIFT) - 1), times, np.searchsorted(key >> (2 * SHIFT), np.arange(n_texts + 1))


def aligned_slice(texts: pa.Array, own: _Encoders) -> dict[str, pa.Array]:
    """The columns of ``align`` for some texts."""
    ids = own.encode(texts)
    n = len(ids)
    a, b = (np.concatenate([x[side] for x in ids] or [np.zeros(0, np.int64)]) for side in (0, 1))
    a_bounds, b_bounds = (np.concatenate(([0], np.cumsum([len(x[side]) for x in ids], dtype=np.int64))) for side in (0, 1))
    a_last, b_last = shared_cuts(np.cumsum(own.a_size[a]), np.cumsum(own.b_size[b]), a_bounds, b_bounds)
    owner = np.searchsorted(a_bounds, a_last, "right") - 1
    links = np.diff(a_last, prepend=-1) * np.diff(b_last, prepend=-1)
    codes, times, edge = _links(a, b, a_last, b_last, owner, n)

    def packed(values):
        return pa.array([values[x:y].tobytes() for x, y in zip(edge[:-1], edge[1:])], pa.binary())

    counts = {"n_a": np.diff(a_bounds), "n_b": np.diff(b_bounds), "n_groups": np.bincount(owner, minlength=n),
              "n_links": np.bincount(owner, weights=links, minlength=n).astype(np.int64)}
    return ({k: pa.array(v, pa.int64()) for k, v in counts.items()} | {"groups": _told(a, b, a_last, b_last, owner, n)}
            | {"codes": packed(codes.astype("<u4")), "times": packed(times.astype("<u4"))})


def align(docs: DataFrame, files: Tokenizers) -> DataFrame:
    """The groups of every row of ``docs`` (doc_id, text), as text, its numbers, and its different links.

    ``codes`` packs the links (A's id times 65536 plus B's id, 4 bytes each) and
    ``times`` how often each stands in the text; ``block`` tells rows counted together.
    """
    names = [c.split()[0] for c in ALIGNED.split(", ")]

    def run(batches):
        own, block, held = encoders(files), TaskContext.get().partitionId() << 32, 0
        for batch in batches:
            for part in slices(batch, "text"):
                columns = aligned_slice(part.column("text"), own)
                columns |= {"doc_id": part.column("doc_id"), "block": pa.array(np.full(part.num_rows, block))}
                yield pa.RecordBatch.from_arrays([columns[c] for c in names], names)
                held += len(raw(part.column("text"))[0])
                if held >= BLOCK_BYTES:
                    block, held = block + 1, 0

    return docs.select("doc_id", "text").mapInArrow(run, ALIGNED)


def _codes(column: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The unsigned numbers packed in all rows, and how many each row has."""
    rows = column.to_pylist()
    return np.frombuffer(b"".join(rows), "<u4").astype(np.int64), np.array([len(x) // 4 for x in rows], np.int64)


def _counted(batches):
    """Of each block's part in this task its different links and how many rows hold each."""
    def told(block, parts):
        code, n = np.unique(np.concatenate(parts), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(code), block)), pa.array(code), pa.array(n)], ["block", "code", "n"])

    now, parts, held = None, [], 0
    for batch in batches:
        blocks = batch.column("block").to_numpy()
        for at, to in zip(*(np.flatnonzero(x) for x in (np.r_[True, blocks[1:] != blocks[:-1]], np.r_[blocks[1:] != blocks[:-1], True]))) if len(blocks) else ():
            if parts and (blocks[at] != now or held > HELD):
                yield told(now, parts)
                parts, held = [], 0
            now = blocks[at]
            parts.append(_codes(batch.column("codes").slice(at, to - at + 1))[0])
            held += len(parts[-1])
    if parts:
        yield told(now, parts)


def link_counts(aligned: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(code, n, best): the rows that hold each link, and whether no link of its id of A is held by more; and (block, code)."""
    within = written(aligned.select("block", "codes").mapInArrow(_counted, "block long, code long, n long"), "links-of-blocks")
    totals = within.groupBy("code").agg(F.sum("n").alias("n"))
    a = F.shiftright("code", SHIFT)
    totals = written(totals.withColumn("a", a), "link-counts")
    # One row for each id of A.
    most = F.broadcast(totals.groupBy("a").agg(F.max("n").alias("most")))
    return totals.join(most, "a").select("code", "n", (F.col("n") == F.col("most")).alias("best")), within.select("block", "code")


def score_links(aligned: DataFrame) -> DataFrame:
    """The rows of ``align`` with n_best and count_sum in place of their links.

    ``aligned`` is read twice and should be a written table; its other columns are kept.
    """
    counts, used = link_counts(aligned)
    kept = [f for f in aligned.schema.fields if f.name not in ("block", "codes", "times")]

    def run(rows: pa.Table, known: pa.Table) -> pa.Table:
        order = np.argsort(known.column("code").to_numpy())
        code, n, best = (known.column(c).to_numpy()[order] for c in ("code", "n", "best"))
        own, sizes = _codes(rows.column("codes"))
        times = _codes(rows.column("times"))[0]
        at = np.searchsorted(code, own)
        bounds = np.concatenate(([0], np.cumsum(sizes)))

        def total(values):
            summed = np.concatenate(([0], np.cumsum(values)))
            return pa.array(summed[bounds[1:]] - summed[bounds[:-1]], pa.int64())

        out = rows.select([f.name for f in kept])
        return out.append_column("n_best", total(times * best[at])).append_column("count_sum", total(times * n[at]))

    # As many tasks as the blocks need, whatever the session's number of partitions.
    tasks = max(partitions(aligned.sparkSession), -(-aligned.select("block").distinct().count() // BLOCKS))
    known = used.distinct().join(counts, "code").repartition(tasks, "block").groupBy("block")
    told = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept] + ["n_best long", "count_sum long"])
    return aligned.repartition(tasks, "block").groupBy("block").cogroup(known).applyInArrow(run, told)
