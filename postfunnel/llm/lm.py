"""A hierarchical Pitman-Yor language model: seating sampled by Gibbs, scores averaged over samples.

The context of a token is the whole word before it, or the start of the text.
Every context is a restaurant of its own, so their number grows with the corpus;
all of them share one parent, the restaurant of single words, whose own base is
uniform over the words seen and one unseen.  A cell is a word in a context, and
a model is counts, tables per cell, and tables per word in the parent.

Tokens are shuffled once, packed, to buckets of bounded size by the hash of
their cell, so neither a common word nor a common context meets in one place.
Tokens of the commonest cells stay with their texts, and only counts of them,
summed in each task, go to the buckets; a table of at most ``HEAD`` cells scores
them in the end.

What a bucket must know of others are the totals of its contexts (customers and
tables) and of its words (tables, and tables in the parent).  Totals live in
nodes, dealt by the hash of the context or the word.  Before the first sweep a
bucket tells the nodes its keys and counts; in every sweep the nodes answer with
the totals in the order of those keys, and the bucket sends its new tables in
the same order, so keys travel once.  A cell of one customer has one table for
good; only cells of two and more are reseated and take part in sweeps.

A sweep takes the customers of a cell out and seats them anew, given everybody
else: the number of tables is drawn from its distribution (generalised Stirling
numbers times the weights of opening one more table) under the totals less the
cell's own tables.  All cells are reseated at once under the totals of the sweep
before, and the parent's dishes by the same draw.  Of more than ``EXACT`` customers
the first ``EXACT`` are drawn so, and the others join in steps of a sixteenth.
The random numbers of a bucket or node depend on its number and the sweep only,
so a lost task gives the same seating again, and later passes repeat earlier
sweeps instead of keeping them.  The last pass averages each token's probability
over the sampled seatings and adds up per text.

Discounts come from counts of ones and twos over the whole corpus.

Defined results: a null text is empty and has the end as its only token; rows
without doc_id are held out by no rule and so learned from; equal rows are
learned from and scored once each.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import RDD, TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from postfunnel.llm.common import bound_batches, hash_spans, mix, slices, word_spans

SWEEPS = 3
BURN_IN = 1
EXACT = 64
CONCENTRATION = 1.0
FLUSH = 800_000
BUCKET_BYTES = 24 << 20
#: Cells whose tokens go with their texts, and the sample they are chosen from.
HEAD = 1 << 17
SAMPLE_BYTES = 32 << 20
#: Words of head cells that are sent as two bytes; others as this number and their hash.
OTHER = 0xFFFF
END = 0x1F123BB5159A55E5
START = 0x5851F42D4C957F2D
_U = np.uint64
_PACKED = "bucket int, kind int, a binary, b binary, c binary, d binary, e binary"
_NAMES = [c.split()[0] for c in _PACKED.split(", ")]
#: What a row of the shuffle holds: tokens of a bucket, counts of head cells, texts with their head tokens, or totals from a node.
_TAIL, _HEAD, _DOCS, _TOTALS = 0, 1, 2, 3
#: The two kinds of keys that nodes hold, and what the buckets' counts of cells with two customers go under.
_CONTEXT, _WORD, _TWOS = 0, 1, 2
#: uid, doc_id, 1 if held out, 1 if doc_id is null, all tokens, those of head cells
_DOC = np.dtype([("uid", "<i8"), ("doc_id", "<i8"), ("held_out", "u1"), ("no_id", "u1"), ("n", "<u4"), ("n_head", "<u4")])
_PART = np.dtype([("uid", "<i8"), ("known", "<u4"), ("base", "<f8"), ("score", "<f8")])


def tokens_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The tokens of all texts, each with its end, the context of each, and the text of each."""
    data, starts, ends, bounds = word_spans(texts)
    hashes = hash_spans(data, starts, ends)
    n = len(bounds) - 1
    owner = np.repeat(np.arange(n), np.diff(bounds))
    # Each text's words move up by the number of ends before them.
    place = np.arange(len(hashes)) + owner
    token, context = np.full(len(hashes) + n, END, _U), np.full(len(hashes) + n, START, _U)
    token[place] = hashes
    context[place + 1] = hashes
    return token, context, np.repeat(np.arange(n), np.diff(bounds) + 1)


def cell_of(token: np.ndarray, context: np.ndarray) -> np.ndarray:
    return mix(mix(context + _U(1)) + token)


def _place(key: np.ndarray, places: int) -> np.ndarray:
    return ((key & _U(0xFFFFFF)) * _U(places) >> _U(24)).astype(np.int64)


def packed(values: np.ndarray) -> bytes:
    """Numbers after a byte that says how: 0 as they are; else whole ones, none below 0, in so many bytes each."""
    if values.dtype.kind == "f":
        whole = values.astype(np.int64)
        if not (whole == values).all() or (values < 0).any():
            return b"\0" + values.astype("<f8").tobytes()
        values = whole
    top = int(values.max()) if len(values) else 0
    size = next(n for n in (1, 2, 4, 8) if top < 1 << 8 * n)
    return bytes([size]) + values.astype(f"<u{size}").tobytes()


def unpacked(data: bytes, kind) -> np.ndarray:
    return np.frombuffer(data, f"<u{data[0]}" if data[0] else "<f8", offset=1).astype(kind)


def _alike(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A place of each different value, and which of these every value is; as np.unique, but by a faster sort that keeps no order of equals."""
    order = np.argsort(values)
    ordered = values[order]
    first = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]][:len(values)])
    at = np.empty(len(values), np.int64)
    at[order] = np.repeat(np.arange(len(first)), np.diff(np.r_[first, len(values)]))
    return order[first], at


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.int32(), *[pa.binary()] * 5)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], _NAMES)


def _tail_rows(token, context, cell, doc, docs, codes, buckets):
    bucket = _place(cell, buckets)
    # Texts are in order already; two bytes are sorted by counting.
    order = np.argsort(bucket.astype(np.uint16) if buckets <= 1 << 16 else bucket, kind="stable")
    bucket, doc, token, context = bucket[order], doc[order], token[order], context[order]
    codes = [c[order] for c in codes]
    run = np.flatnonzero(np.r_[True, (bucket[1:] != bucket[:-1]) | (doc[1:] != doc[:-1])]) if len(doc) else np.zeros(0, np.int64)
    count = np.diff(np.r_[run, len(doc)])
    # The last bit of the number says whether the text is held out; numbers of a bucket rise, so steps are sent.
    base = docs["uid"][:1]
    uid = (docs["uid"][doc[run]] - base) << 1 | docs["held_out"][doc[run]]
    edge = np.searchsorted(bucket, np.arange(buckets + 1))
    of_run = np.searchsorted(run, edge)
    for b in range(buckets):
        a, z = edge[b], edge[b + 1]
        if a < z:
            own = slice(of_run[b], of_run[b + 1])
            yield (b, _TAIL, base.tobytes() + packed(np.diff(uid[own], prepend=0)), packed(count[own]),
                   *(c[a:z].tobytes() for c in codes), b"".join(x[a:z][c[a:z] == OTHER].tobytes() for x, c in zip((token, context), codes)))


def _head_rows(code, doc, docs, head, buckets):
    """Counts of the training tokens of head cells, for the cells' buckets."""
    codes, counts = np.unique(code[docs["held_out"][doc] == 0], return_counts=True)
    bucket = _place(head.cell, buckets)[codes]
    for b in np.unique(bucket).tolist():
        yield b, _HEAD, packed(np.diff(codes[bucket == b], prepend=0)), packed(counts[bucket == b]), b"", b"", b""


def _doc_rows(code, doc, docs, buckets):
    """Texts with the cells of their head tokens, for the places where texts are added up."""
    target = (mix(docs["uid"].astype(_U)) % _U(buckets)).astype(np.int64)
    order = np.argsort(target[doc].astype(np.uint16) if buckets <= 1 << 16 else target[doc], kind="stable")
    own, code = target[doc][order], code[order]
    rows = np.argsort(target, kind="stable")
    edge, of_row = np.searchsorted(own, np.arange(buckets + 1)), np.searchsorted(target[rows], np.arange(buckets + 1))
    for b in range(buckets):
        if of_row[b] < of_row[b + 1]:
            cells = code[edge[b]:edge[b + 1]]
            yield (buckets + b, _DOCS, docs[rows[of_row[b]:of_row[b + 1]]].tobytes(), (cells & 0xFFFF).astype("<u2").tobytes(), (cells >> 16).astype(np.uint8).tobytes(), b"", b"")


def _emit(buckets: int, sent):
    def run(batches):
        head = sent.value
        uid = TaskContext.get().partitionId() << 40
        held, size = [], 0

        def out():
            start = np.cumsum([0] + [len(h[3]) for h in held[:-1]])
            token, context = (np.concatenate([h[n] for h in held]) for n in (0, 1))
            doc, docs = np.concatenate([h[2] + s for h, s in zip(held, start)]), np.concatenate([h[3] for h in held])
            cell = cell_of(token, context)
            words = head.code(token)
            before = np.where(context == _U(START), head.code(np.array([START], _U)), np.roll(words, 1))
            code = head.find(cell)
            often = code >= 0
            docs["n"] = np.bincount(doc, minlength=len(docs))
            docs["n_head"] = np.bincount(doc[often], minlength=len(docs))
            code = code[often]
            return _batch([*_tail_rows(token[~often], context[~often], cell[~often], doc[~often], docs, (words[~often], before[~often]), buckets),
                           *_head_rows(code, doc[often], docs, head, buckets), *_doc_rows(code, doc[often], docs, buckets)])

        for batch in batches:
            for part in slices(batch, "text"):
                token, context, doc = tokens_of(part.column("text"))
                docs = np.zeros(part.num_rows, _DOC)
                docs["uid"] = uid + np.arange(part.num_rows)
                uid += part.num_rows
                docs["doc_id"] = part.column("doc_id").fill_null(0).to_numpy()
                docs["no_id"] = part.column("doc_id").is_null().to_numpy(zero_copy_only=False)
                docs["held_out"] = part.column("held_out").to_numpy(zero_copy_only=False)
                held.append((token, context, doc, docs))
                size += len(token)
                if size >= FLUSH:
                    yield out()
                    held, size = [], 0
        if held:
            yield out()
    return run


class Places:
    """Where hashes stand among sorted ones: their highest bits tell the few places to look at."""

    def __init__(self, keys: np.ndarray):
        bits = len(keys).bit_length() + 1
        self.keys, self.shift = keys, _U(64 - bits)
        self.start = np.searchsorted(keys, np.arange(1 << bits, dtype=_U) << self.shift)
        self.most = int(np.diff(self.start, append=len(keys)).max())

    def find(self, values: np.ndarray) -> np.ndarray:
        """The place of each value, or -1."""
        out = np.full(len(values), -1)
        at = np.minimum(self.start[values >> self.shift], len(self.keys) - 1)
        for _ in range(self.most):
            hit = np.flatnonzero(self.keys[at] == values)
            out[hit] = at[hit]
            at = np.minimum(at + 1, len(self.keys) - 1)
        return out


class Head:
    """The commonest cells, in the order of their hashes, and their words.  Cells are given commonest first."""

    def __init__(self, token: np.ndarray, context: np.ndarray):
        cell, first = np.unique(cell_of(token, context), return_index=True)
        self.cell, self.token, self.context = cell, token[first], context[first]
        words, first = np.unique(np.stack((token, context), axis=1).ravel(), return_index=True)
        self.words = np.sort(words[np.argsort(first)[:OTHER]])

    def code(self, token: np.ndarray) -> np.ndarray:
        """The words' two bytes."""
        return (self._places("words").find(token) & OTHER).astype("<u2")  # -1 becomes OTHER

    def decode(self, code: np.ndarray, others: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The words of two bytes, and what is left of the others' hashes."""
        other = code == OTHER
        n = int(other.sum())
        out = np.empty(len(code), _U)
        out[other] = others[:n]
        out[~other] = self.words[code[~other]]
        return out, others[n:]

    def find(self, cell: np.ndarray) -> np.ndarray:
        """The number of each cell, or -1."""
        return self._places("cell").find(cell)

    def _places(self, of: str) -> Places:
        """Made where it is first asked for, so it is not sent."""
        if f"places_of_{of}" not in self.__dict__:
            setattr(self, f"places_of_{of}", Places(getattr(self, of)))
        return getattr(self, f"places_of_{of}")


def _frequent(batches):
    for batch in batches:
        for part in slices(batch, "text"):
            token, context, _ = tokens_of(part.column("text"))
            _, first, counts = np.unique(cell_of(token, context), return_index=True, return_counts=True)
            first, counts = first[counts > 1], counts[counts > 1]
            yield pa.RecordBatch.from_pydict({"token": pa.array(token[first].view(np.int64)), "context": pa.array(context[first].view(np.int64)), "n": pa.array(counts)})


def head_cells(docs: DataFrame, size: int) -> Head:
    """The commonest cells of a bounded sample.

    Any choice gives the same model; this one keeps common cells out of the buckets.
    """
    sample = docs.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(max(1, size // SAMPLE_BYTES))) == 0).select("text")
    top = (sample.mapInArrow(_frequent, "token long, context long, n long").groupBy("token", "context").agg(F.sum("n").alias("n"))
           .orderBy(F.col("n").desc(), "token", "context").limit(HEAD).select("token", "context").toArrow())
    return Head(*(top.column(c).to_numpy().astype(np.int64).view(_U) for c in ("token", "context")))


class Keys:
    """The contexts or words of a bucket's cells, node by node."""

    def __init__(self, values: np.ndarray, count: np.ndarray, nodes: int):
        keys, at = np.unique(values, return_inverse=True)
        node = _place(keys, nodes)
        order = np.argsort(node, kind="stable")
        rank = np.empty(len(keys), np.int64)
        rank[order] = np.arange(len(keys))
        self.keys, self.at = keys[order], rank[at]
        self.edge = np.searchsorted(node[order], np.arange(nodes + 1))
        self.customers = np.bincount(self.at, count, len(keys)).astype("<u8")
        self.ones = np.bincount(self.at, count == 1, len(keys)).astype("<u4")
        self.more = np.bincount(self.at, count > 1, len(keys)).astype("<u4")

    def parts(self):
        for p in np.flatnonzero(np.diff(self.edge)).tolist():
            yield p, slice(self.edge[p], self.edge[p + 1])


class Bucket:
    """The tokens of the cells of one bucket, and the seating of its training tokens."""

    def __init__(self, number: int, rows, head: Head, buckets: int):
        word, context, uid, counts, codes, times, self.totals = [], [], [], [], [], [], {}
        for _, (kind, a, b, c, d, e) in rows:
            if kind == _TAIL:
                uid.append((np.frombuffer(a, "<i8", 1) << 1) + np.cumsum(unpacked(a[8:], "<i8")))
                counts.append(unpacked(b, "<u4"))
                own, left = head.decode(np.frombuffer(c, "<u2"), np.frombuffer(e, _U))
                word.append(own)
                context.append(head.decode(np.frombuffer(d, "<u2"), left)[0])
            elif kind == _HEAD:
                codes.append(np.cumsum(unpacked(a, "<i8")).astype("<u4"))
                times.append(unpacked(b, "<u4"))
            else:
                sweep, of, node = a
                self.totals.setdefault((sweep, of), {})[node] = [x for x in (b, c, d, e) if x]
        join = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, kind)
        self.number, uid, self.counts = number, join(uid, "<i8"), join(counts, "<u4")
        self.uid = uid >> 1
        self.head = np.flatnonzero(_place(head.cell, buckets) == number)
        word, context = (np.concatenate((join(x, _U), y[self.head])) for x, y in ((word, head.token), (context, head.context)))
        first, at = _alike(cell_of(word, context))
        learned = np.repeat(uid & 1 == 0, self.counts)
        self.at, self.at_head = at[:len(learned)], at[len(learned):]
        self.count = np.bincount(self.at[learned], minlength=len(first)).astype(np.int64)
        codes = join(codes, "<u4")
        if len(codes):
            self.count += np.bincount(self.at_head[np.searchsorted(self.head, codes)], join(times, "<u4"), len(first)).astype(np.int64)
        word, context = word[first], context[first]
        self.several = np.flatnonzero(self.count > 1)
        self.own = {_CONTEXT: Keys(context, self.count, buckets), _WORD: Keys(word, self.count, buckets)}

    def first_message(self):
        """What nodes must know before any sweep: all keys, their customers, and their cells of one customer and of more."""
        for of, own in self.own.items():
            for p, part in own.parts():
                yield p, (of, self.number, 0, own.keys[part].tobytes(), packed(own.customers[part]), packed(own.ones[part]), packed(own.more[part]))
        yield 0, (_TWOS, self.number, 0, np.array([(self.count == 2).sum()], "<u8").tobytes(), b"", b"", b"")

    def message(self, sweep: int, model: "Model"):
        """The tables of the keys that have cells of several customers, after a sweep."""
        for tables in self.sweeps(model, sweep):
            pass
        for of, own in self.own.items():
            total = np.bincount(own.at[self.several], tables, len(own.keys)).astype("<u4")
            for p, part in own.parts():
                if own.more[part].any():
                    yield p, (of, self.number, sweep, packed(total[part][own.more[part] > 0]), b"", b"", b"")

    def told(self, sweep: int, of: int) -> list[np.ndarray]:
        """What the nodes answered, node after node."""
        answers = self.totals.get((sweep, of), {})
        parts = [answers[p] for p in sorted(answers)]
        return [np.concatenate([unpacked(p, "<f8") for p in x]) for x in zip(*parts)] if parts else [np.zeros(0)] * 3

    def sweeps(self, model: "Model", last: int):
        """Tables of the cells of several customers, before any sweep and after each."""
        several, count = self.several, self.count[self.several]
        tables = np.ones(len(several), np.int64)
        yield tables
        at = {}
        for of, own in self.own.items():
            rank = np.cumsum(own.more > 0) - 1
            at[of] = rank[own.at[several]]
        for n in range(last):
            (here,), (above, top) = self.told(n, _CONTEXT)[:1], self.told(n, _WORD)[:2]
            all_tables, all_tops = model.totals[n]
            here, above, top = (x[at[of]] if len(several) else np.zeros(0) for x, of in ((here, _CONTEXT), (above, _WORD), (top, _WORD)))
            here, above = here - tables, above - tables
            top = np.minimum(top, above)
            base = (CONCENTRATION + model.top_discount * all_tops) / (model.n_words + 1)
            first = above - model.top_discount * np.maximum(top, 1) + base
            weight = lambda rows, t: (CONCENTRATION + model.discount * (here[rows] + t)) * np.maximum(first[rows] + t, base) / (CONCENTRATION + all_tables)  # noqa: E731, B023
            tables = seat(count, weight, model.discount, np.random.default_rng([self.number, n]))
            yield tables

    def probabilities(self, model: "Model") -> tuple[np.ndarray, np.ndarray]:
        """Each cell's probability, averaged over the samples, and how often its word was learned."""
        context, word = self.own[_CONTEXT], self.own[_WORD]
        customers, *here = self.told(SWEEPS + 1, _CONTEXT)
        seen, *above = self.told(SWEEPS + 1, _WORD)
        p, one = np.zeros(len(self.count)), np.minimum(self.count, 1)
        samples = 0
        for n, tables in enumerate(self.sweeps(model, SWEEPS)):
            if n <= BURN_IN:
                continue
            taken = one.copy()
            taken[self.several] = tables
            p += self.count - model.discount * taken + (CONCENTRATION + model.discount * here[samples][context.at]) * above[samples][word.at]
            samples += 1
        return p / samples / (CONCENTRATION + customers[context.at]), seen[word.at].astype(np.int64)

    def score(self, model: "Model") -> np.ndarray:
        """The sums of each text's tokens in this bucket."""
        p, seen = self.probabilities(model)
        # Parts of one text may come in several runs.
        uid, of_run = np.unique(self.uid, return_inverse=True)
        return _sums(uid, np.repeat(of_run, self.counts), p[self.at], seen[self.at], model)

    def head_table(self, model: "Model") -> list[tuple]:
        """The numbers of this bucket's head cells, their probabilities, and how often their words were learned."""
        p, seen = self.probabilities(model)
        return [tuple(bytearray(x.tobytes()) for x in (self.head, p[self.at_head], seen[self.at_head]))]


class Node:
    """The totals of some contexts and words, from the messages of all buckets."""

    def __init__(self, number: int, rows, sweeps: int):
        self.number, first, later, self.twos = number, {_CONTEXT: [], _WORD: []}, {}, 0
        for _, (of, bucket, sweep, a, b, c, d) in rows:
            if of == _TWOS:
                self.twos += int(np.frombuffer(a, "<u8")[0])
            elif sweep == 0:
                first[of].append((bucket, np.frombuffer(a, _U), *(unpacked(x, t) for x, t in ((b, "<u8"), (c, "<u4"), (d, "<u4")))))
            else:
                later[of, sweep, bucket] = unpacked(a, "<u4")
        self.senders, self.customers, self.ones, self.tables = {}, {}, {}, {}
        for of, parts in first.items():
            parts.sort(key=lambda x: x[0])
            stack = lambda n, kind: np.concatenate([x[n] for x in parts]) if parts else np.zeros(0, kind)  # noqa: E731, B023
            keys, at = np.unique(stack(1, _U), return_inverse=True)
            total = lambda n: np.bincount(at, stack(n, "<u8"), len(keys))  # noqa: E731, B023
            self.customers[of], self.ones[of] = total(2), total(3)
            self.tables[of] = [self.ones[of] + total(4)]
            start = np.cumsum([0] + [len(x[1]) for x in parts])
            self.senders[of] = [(x[0], at[a:z], x[4] > 0) for x, a, z in zip(parts, start, start[1:])]
        for sweep in range(1, sweeps + 1):
            for of in (_CONTEXT, _WORD):
                tables = self.ones[of].copy()
                for bucket, own, several in self.senders[of]:
                    if (of, sweep, bucket) in later:
                        tables += np.bincount(own[several], later[of, sweep, bucket], len(tables))
                self.tables[of].append(tables)

    def tops(self, sweep: int, model: "Model | None") -> list[np.ndarray]:
        """Tables of the words in the parent, before any sweep and after each."""
        out = [np.minimum(self.customers[_WORD], 1)]
        for n in range(1, sweep + 1):
            tables, top = self.tables[_WORD][n], out[-1]
            alive = np.flatnonzero(tables > 0)
            rest = model.totals[n - 1][1] - top[alive]
            weight = lambda rows, t: (CONCENTRATION + model.top_discount * (rest[rows] + t)) / (model.n_words + 1)  # noqa: E731, B023
            new = np.zeros(len(tables))
            new[alive] = seat(tables[alive].astype(np.int64), weight, model.top_discount, np.random.default_rng([self.number, n, 1]))
            out.append(new)
        return out

    def sums(self, sweep: int, model: "Model | None") -> np.ndarray:
        tables, customers = self.tables[_WORD][sweep], self.customers[_WORD]
        return np.array([tables.sum(), self.tops(sweep, model)[-1].sum(), customers.sum(), (customers > 0).sum(),
                         self.ones[_WORD].sum(), self.twos, (tables == 1).sum(), (tables == 2).sum()])

    def answers(self, sweep: int, model: "Model"):
        """The totals after a sweep, for the buckets' keys with cells of several customers."""
        values = {_CONTEXT: [self.tables[_CONTEXT][sweep]], _WORD: [self.tables[_WORD][sweep], self.tops(sweep, model)[-1]]}
        for of, senders in self.senders.items():
            for bucket, own, several in senders:
                if several.any():
                    yield self._answer(sweep, of, bucket, [v[own[several]] for v in values[of]])

    def last_answers(self, model: "Model"):
        """For all keys, what scoring takes: customers, and tables or the parent's probability in each sample."""
        tops = self.tops(SWEEPS, model)
        samples = range(BURN_IN + 1, SWEEPS + 1)
        values = {_CONTEXT: [self.customers[_CONTEXT], *(self.tables[_CONTEXT][n] for n in samples)],
                  _WORD: [self.customers[_WORD], *(model.parent(n, self.tables[_WORD][n], tops[n]) for n in samples)]}
        for of, senders in self.senders.items():
            for bucket, own, _ in senders:
                yield self._answer(SWEEPS + 1, of, bucket, [v[own] for v in values[of]])

    def _answer(self, sweep: int, of: int, bucket: int, values: list[np.ndarray]):
        parts = [packed(v) for v in values]
        return bucket, (_TOTALS, (sweep, of, self.number), *parts, *[b""] * (4 - len(parts)))


def _sums(uid: np.ndarray, of: np.ndarray, p: np.ndarray, seen: np.ndarray, model: "Model") -> np.ndarray:
    out = np.zeros(len(uid), _PART)
    out["uid"] = uid
    base = np.log10((seen + 1) / (model.n_tokens + model.n_words + 1))
    for name, value in (("known", seen > 0), ("base", base), ("score", np.log10(p))):
        out[name] = np.bincount(of, value, len(uid))
    return out


def _stirling(discount: float) -> np.ndarray:
    """Logarithms of the generalised Stirling numbers: ways to seat n customers at t tables."""
    out = np.full((EXACT + 1, EXACT + 2), -np.inf)
    out[1, 1] = 0
    for n in range(1, EXACT):
        t = np.arange(1, n + 2)
        out[n + 1, t] = np.logaddexp(out[n, t - 1], np.log(np.maximum(n - discount * t, 1e-300)) + out[n, t])
    return out


def seat(customers: np.ndarray, new, discount: float, draw: np.random.Generator) -> np.ndarray:
    """Tables after seating the customers of each dish.

    ``new`` is the weight of one more table for each dish, or a function of dishes and the tables they have.
    """
    weight = new if callable(new) else lambda rows, t: new[rows]
    tables = np.ones(len(customers), np.int64)
    ways = _stirling(discount)
    capped = np.minimum(customers, EXACT)
    order = np.argsort(capped, kind="stable")
    edge = np.searchsorted(capped[order], np.arange(2, EXACT + 2))
    for c, a, z in zip(range(2, EXACT + 1), edge, edge[1:]):
        for start in range(a, z, (1 << 20) // c):
            rows = order[start:min(z, start + (1 << 20) // c)]
            chance = np.empty((len(rows), c))
            chance[:, 0] = 0
            for t in range(1, c):
                chance[:, t] = chance[:, t - 1] + np.log(weight(rows, t))
            chance += ways[c, 1:c + 1]
            chance = np.cumsum(np.exp(chance - chance.max(axis=1, keepdims=True)), axis=1)
            tables[rows] = 1 + (chance[:, :-1] < draw.random(len(rows))[:, None] * chance[:, -1:]).sum(axis=1)
    at, seated = np.flatnonzero(customers > EXACT), EXACT
    while len(at):
        step = max(1, seated // 16)
        width = np.minimum(step, customers[at] - seated)
        opens = weight(at, tables[at])
        tables[at] += draw.binomial(width, opens / (opens + np.maximum(seated - discount * tables[at], 1e-9)))
        seated += step
        at = at[customers[at] > seated]
    return tables


class Model:
    """What all tasks share: sizes, discounts, and how many tables there are before and after each sweep."""

    def __init__(self, sums: np.ndarray):
        tables, tops, self.n_tokens, self.n_words, one, two, top_one, top_two = sums.astype(np.int64).tolist()
        self.discount = float(np.clip(one / max(one + 2 * two, 1), 0.1, 0.95))
        self.top_discount = float(np.clip(top_one / max(top_one + 2 * top_two, 1), 0.1, 0.95))
        self.totals = [(tables, tops)]

    def parent(self, n: int, tables: np.ndarray, tops: np.ndarray) -> np.ndarray:
        """The probability of words in the restaurant of single words after a sweep."""
        all_tables, all_tops = self.totals[n]
        base = (CONCENTRATION + self.top_discount * all_tops) / (self.n_words + 1)
        return (tables - self.top_discount * tops + base) / (CONCENTRATION + all_tables)


def _score_docs(rows, model: Model, p: np.ndarray, seen: np.ndarray):
    """The texts of one place with the sums of their head tokens."""
    for _, (_, a, low, high, _, _) in rows:
        docs = np.frombuffer(a, _DOC)
        code = np.frombuffer(low, "<u2").astype(np.int64) | np.frombuffer(high, np.uint8).astype(np.int64) << 16
        # Cells come text by text in the order of the texts.
        out = _sums(docs["uid"], np.repeat(np.arange(len(docs)), docs["n_head"]), p[code], seen[code], model)
        yield docs, out


def _add_up(batches):
    """The sums of each text, from its head tokens and the parts of all buckets."""
    parts, docs = [], []
    for batch in batches:
        for kind, a, b in zip(*(batch.column(c).to_pylist() for c in ("kind", "a", "b"))):
            parts.append(np.frombuffer(a, _PART))
            if kind == _DOCS:
                docs.append(np.frombuffer(b, _DOC))
    if not docs:
        return
    docs, rows = np.concatenate(docs), np.concatenate(parts)
    docs = docs[np.argsort(docs["uid"])]
    at = np.searchsorted(docs["uid"], rows["uid"])
    total = {n: np.bincount(at, rows[n], len(docs)) for n in ("known", "base", "score")}
    for start in range(0, len(docs), 50_000):
        own = slice(start, start + 50_000)
        yield pa.RecordBatch.from_pydict({
            "doc_id": pa.array(docs["doc_id"][own], mask=docs["no_id"][own] == 1), "held_out": pa.array(docs["held_out"][own] == 1),
            "n_tokens": pa.array(docs["n"][own].astype(np.int64)), "n_known": pa.array(total["known"][own].astype(np.int64)),
            "base_score": pa.array(total["base"][own]), "score": pa.array(total["score"][own])})


def score_texts(docs: DataFrame, held_out: Column, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row.

    A task holds one bucket, the tokens of rarer cells of about ``bucket_bytes`` of text.
    """
    spark = bound_batches(docs.sparkSession)
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(1, -(-size // bucket_bytes))
    rows = docs.select("doc_id", "text", F.coalesce(held_out, F.lit(False)).alias("held_out"))
    head = spark.sparkContext.broadcast(head_cells(docs, size))
    # The one shuffle of the tokens; every pass reads its files again.
    dealt = (rows.mapInArrow(_emit(buckets, head), _PACKED).rdd.map(lambda r: (r[0], (r[1], *map(bytes, r[2:]))))
             .partitionBy(2 * buckets, _as_is))
    told, answered = [], [dealt]

    def each(f):
        """f of every bucket, with the answers it has so far."""
        return _beside(answered).mapPartitionsWithIndex(lambda n, part: f(Bucket(n, part, head.value, buckets)) if n < buckets else [])

    def nodes(f):
        """f of every node, after as many sweeps as it was told of."""
        sweeps = len(told) - 1
        return _beside(told).mapPartitionsWithIndex(lambda n, part: f(Node(n, part, sweeps)) if n < buckets else [])

    model = None
    for sweep in range(SWEEPS + 1):
        now = model
        messages = each(lambda own: own.message(sweep, now)) if sweep else each(Bucket.first_message)  # noqa: B023
        told.append(messages.partitionBy(buckets, _as_is))
        sums = nodes(lambda own: [own.sums(sweep, now)]).treeReduce(np.add, 3)  # noqa: B023
        if sweep:
            model.totals.append(tuple(sums[:2].astype(np.int64).tolist()))
        else:
            model = now = Model(sums)
        if sweep < SWEEPS:
            answered.append(nodes(lambda own: own.answers(sweep, now)).partitionBy(2 * buckets, _as_is))  # noqa: B023
    answered.append(nodes(lambda own: own.last_answers(model)).partitionBy(2 * buckets, _as_is))

    # At most HEAD cells.
    p, seen = np.zeros(len(head.value.cell)), np.zeros(len(head.value.cell), np.int64)
    for number, own, times in each(lambda own: own.head_table(model)).collect():
        number = np.frombuffer(number, np.int64)
        p[number], seen[number] = np.frombuffer(own), np.frombuffer(times, np.int64)
    table = spark.sparkContext.broadcast((p, seen))

    def parts(n, part):
        if n >= buckets:
            return [(n - buckets, _DOCS, bytearray(out.tobytes()), bytearray(docs.tobytes())) for docs, out in _score_docs(part, model, *table.value)]
        out = Bucket(n, part, head.value, buckets).score(model)
        target = (mix(out["uid"].astype(_U)) % _U(buckets)).astype(np.int64)
        order = np.argsort(target, kind="stable")
        edge = np.searchsorted(target[order], np.arange(buckets + 1))
        return [(b, _TAIL, bytearray(out[order[edge[b]:edge[b + 1]]].tobytes()), bytearray()) for b in range(buckets) if edge[b] < edge[b + 1]]

    sums = spark.createDataFrame(_beside(answered).mapPartitionsWithIndex(parts), "target int, kind int, a binary, b binary")
    summed = sums.repartition(buckets, "target").mapInArrow(
        _add_up, "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return summed.withColumn("train_tokens", F.lit(model.n_tokens).cast("long"))


def _beside(rdds: list[RDD]) -> RDD:
    """Tables dealt alike, place by place, without another shuffle."""
    return reduce(RDD.union, rdds)


def _as_is(bucket: int) -> int:
    return bucket
