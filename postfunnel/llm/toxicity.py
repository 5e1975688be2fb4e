"""Toxicity by weak supervision.

1. Lexicon entries (words and word beginnings) are found among labelled rows:
   per task counts, summed by Spark, kept where the log odds are high enough.
2. Voters look at a text only: groups of entries, and patterns (shouting, runs
   of marks, density of entries).  A voter fires or stays silent.
3. A generative label model with a hidden class estimates by EM how often each
   voter fires under either class, and from the voters' covariance within the
   classes how far they repeat each other; a voter that others repeat counts
   for less.  It sees votes, never labels.
4. A logistic classifier over the entries learns the model's posteriors.

Entries and classifier come from a bounded sample of labelled rows: at most
``max_rows`` of either class, those with the smallest hash of doc_id.  Labels,
lang, source and doc_id are never inputs of a score.

Defined results: a null or empty text is scored as one without entries.  Of a
doc_id labelled twice the higher label counts; rows without doc_id or label
are scored, but teach nothing.  Without toxic labelled rows every score is 0.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from postfunnel.llm.common import slices, windows, word_hashes

#: Beginnings of words that count as entries, in bytes; 0 stands for the whole word.
KINDS = (0, 4, 5, 6, 7)
GROUPS = 5
#: ASCII marks are left out of words, A-Z are lowered.
MARKS = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
LOWERED = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def entries_of(text: str | None) -> tuple[set[bytes], int]:
    """The entries of a text (tagged by kind) and its number of words."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(LOWERED, MARKS).split()
    own = set(words)
    found = {b"0" + w for w in own}
    for n in KINDS[1:]:
        tag = b"%d" % n
        found.update([tag + w[:n] for w in own if len(w) >= n])
    return found, len(words)


def _count(batches):
    toxic, clean = Counter(), Counter()
    for batch in batches:
        for text, label in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist()):
            (toxic if label else clean).update(entries_of(text)[0])
    # An entry no toxic text of this task has is of use only if another task needs its clean count.
    names = list({**toxic, **clean})
    for start in range(0, len(names), 100_000):
        part = names[start:start + 100_000]
        yield pa.RecordBatch.from_pydict({
            "entry": pa.array(part, pa.binary()),
            "toxic": pa.array([toxic[x] for x in part], pa.int64()), "clean": pa.array([clean[x] for x in part], pa.int64())})


def _mark(batches):
    """Each text with its least run of five words, which near copies mostly share."""
    for batch in batches:
        for part in slices(batch, "text"):
            runs, owner, _ = windows(*word_hashes(part.column("text")), 5)
            least = np.full(part.num_rows, np.iinfo(np.uint64).max, np.uint64)
            np.minimum.at(least, owner, runs)
            yield part.append_column("mark", pa.array(least.view(np.int64)))


def labelled(docs: DataFrame, labels: DataFrame, held_out: Column, max_rows: int) -> DataFrame:
    """text and toxic of the sample; its ids are at most 2 * max_rows numbers, so they are broadcast."""
    known = (labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
             .where(~F.coalesce(held_out, F.lit(True))))
    picks = [known.where(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows) for y in (0, 1)]
    rows = docs.select("doc_id", "text").join(F.broadcast(picks[0].unionByName(picks[1])), "doc_id").select("text", F.col("toxic").cast("int").alias("toxic"))
    # A group of near copies teaches about once, or all its words would look like entries.
    return rows.mapInArrow(_mark, "text string, toxic int, mark long").groupBy("toxic", "mark").agg(F.min("text").alias("text")).select("text", "toxic")


def find_entries(sample: DataFrame, min_docs: int, min_share: float, min_lift: float, min_precision: float, max_entries: int) -> tuple[list[bytes], int, int]:
    """The entries with the strongest tie to toxic texts, and the sizes of the classes."""
    sizes = {r[0]: r[1] for r in sample.groupBy("toxic").count().collect()}
    n1, n0 = sizes.get(1, 0), sizes.get(0, 0)
    if not n1:
        return [], n1, n0
    counts = sample.mapInArrow(_count, "entry binary, toxic long, clean long").groupBy("entry").agg(
        F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    lift = F.log((F.col("toxic") + 0.5) / (n1 + 1.0)) - F.log((F.col("clean") + 0.5) / (n0 + 1.0))
    best = (counts.where((F.col("toxic") >= max(min_docs, min_share * n1)) & (lift >= min_lift)
                         & (F.col("toxic") >= min_precision * (F.col("toxic") + F.col("clean"))))
            .orderBy((F.col("toxic") * lift).desc(), "entry").limit(max_entries))
    return [bytes(r[0]) for r in best.collect()], n1, n0


def votes(text: str | None, index: dict[bytes, int]) -> tuple[list[int], int]:
    """The entries a text has (sorted) and the mask of the voters that fire."""
    found, n_words = entries_of(text)
    hits = sorted(index[x] for x in found if x in index)
    mask = 0
    names = [x for x in found if x in index]
    for x in names:
        mask |= 1 << (KINDS.index(x[0] - 48) * GROUPS + sum(x) % GROUPS)
    base = len(KINDS) * GROUPS
    whole = sum(x[0] == 48 for x in names)
    text = text or ""
    for n, fires in enumerate((
            whole >= 2, whole >= 4, len(names) >= 2, 100 * len(names) >= n_words > 0, "!!" in text or "??" in text,
            n_words > 3 and text.upper() == text, "***" in text or "@#" in text)):
        mask |= bool(fires) << (base + n)
    return hits, mask


VOTERS = len(KINDS) * GROUPS + 7


def _vote(index):
    def run(batches):
        for batch in batches:
            both = [votes(t, index) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_pydict({
                "hits": pa.array([h for h, _ in both], pa.list_(pa.int32())), "mask": pa.array([m for _, m in both], pa.int64())})
    return run


def label_model(masks: np.ndarray, counts: np.ndarray, rounds: int = 40) -> np.ndarray:
    """The posterior of the hidden class for each pattern of votes.

    EM over P(class), P(voter fires | class); each voter's log odds are divided by
 the root of one plus its positive correlations with the others within the classes.
    """
    v = ((masks[:, None] >> np.arange(VOTERS)) & 1).astype(float)
    n = counts.astype(float)
    lexical = v[:, :len(KINDS) * GROUPS].sum(1)
    post = np.where(lexical > 0, 0.9, 0.02)
    for _ in range(rounds):
        share = np.clip((n * post).sum() / n.sum(), 0.01, 0.99)
        rate, cov = [], np.zeros((VOTERS, VOTERS))
        for w in (n * post, n * (1 - post)):
            p = ((w[:, None] * v).sum(0) + 0.1) / (w.sum() + 1.0)
            rate.append(np.clip(p, 1e-4, 1 - 1e-4))
            d = v - rate[-1]
            cov += (d * w[:, None]).T @ d / n.sum()
        spread = np.sqrt(np.diag(cov)) + 1e-9
        repeats = np.clip(cov / spread[:, None] / spread[None, :], 0, 1)
        weight = 1 / np.sqrt(1 + repeats.sum(1) - np.diag(repeats))
        fires, silent = np.log(rate[0] / rate[1]), np.log((1 - rate[0]) / (1 - rate[1]))
        odds = np.log(share / (1 - share)) + (weight * (v * fires + (1 - v) * silent)).sum(1)
        post = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
    return post


def fit_linear(hits: list[list[int]], target: np.ndarray, weight: np.ndarray, size: int, rounds: int = 2_000) -> np.ndarray:
    """Weights of the entries and, last, the bias: logistic loss against soft labels, by Adam."""
    row = np.repeat(np.arange(len(hits)), [len(h) for h in hits])
    col = np.array([c for h in hits for c in h], dtype=np.int64)
    w, m, s = np.zeros(size + 1), np.zeros(size + 1), np.zeros(size + 1)
    w[-1] = -1.0
    total = weight.sum()
    for t in range(1, rounds + 1):
        odds = w[-1] + np.bincount(row, w[col], len(hits))
        miss = weight * (1 / (1 + np.exp(-np.clip(odds, -30, 30))) - target)
        grad = np.append(np.bincount(col, miss[row], size), miss.sum()) / total + 1e-6 * w
        m, s = 0.9 * m + 0.1 * grad, 0.99 * s + 0.01 * grad * grad
        w -= 0.1 * (1 - t / (rounds + 1)) * (m / (1 - 0.9 ** t)) / (np.sqrt(s / (1 - 0.99 ** t)) + 1e-8)
        w[:-1] = np.maximum(w[:-1], 0)
    return w


def fit(docs: DataFrame, labels: DataFrame, held_out: Column, max_rows: int = 20_000, min_docs: int = 4,
        min_share: float = 0.015, min_lift: float = 3.0, min_precision: float = 0.98, max_entries: int = 4_000) -> tuple[dict[bytes, int], np.ndarray]:
    """The entries and the classifier's weights: of each entry, of having any, and the bias."""
    sample = labelled(docs, labels, held_out, max_rows)
    names, _, _ = find_entries(sample, min_docs, min_share, min_lift, min_precision, max_entries)
    index = {x: n for n, x in enumerate(names)}
    if not index:
        return {}, np.array([0.0, -np.inf])
    # One row for each different set of votes and entries; the sample bounds them.
    seen = sample.select("text").mapInArrow(_vote(index), "hits array<int>, mask long").groupBy("hits", "mask").count().collect()
    seen = sorted((tuple(r["hits"]), r["mask"], r["count"]) for r in seen)
    count = np.array([r[2] for r in seen])
    # No posterior is taken for certain, or the classifier's bias would grow without end.
    post = np.clip(label_model(np.array([r[1] for r in seen], dtype=np.int64), count), 0.01, 0.99)
    # Beside its entries (which never speak for a text) it has one more feature, that it has any.
    return index, fit_linear([[*r[0], len(index)] if r[0] else [] for r in seen], post, count.astype(float), len(index) + 1)


def score(docs: DataFrame, index: dict[bytes, int], weights: np.ndarray) -> DataFrame:
    """The rows of ``docs`` with ``score`` added (in place of a column of that name)."""
    keep = [c for c in docs.columns if c != "score"]
    schema = docs.select(keep).schema.add("score", "double")

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                odds = []
                for t in part.column("text").to_pylist():
                    hits = [weights[index[x]] for x in entries_of(t)[0] if x in index]
                    odds.append(weights[-1] + (sum(hits) + weights[-2] if hits else 0.0))
                value = 1 / (1 + np.exp(-np.clip(np.array(odds), -700, 700)))
                columns = [part.column(c) for c in keep]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(np.where(np.isneginf(odds), 0.0, value))], [*keep, "score"])

    return docs.select(keep).mapInArrow(run, schema)


def score_toxicity(docs: DataFrame, labels: DataFrame, held_out: Column, **settings) -> DataFrame:
    index, weights = fit(docs, labels, held_out, **settings)
    return score(docs, index, weights)
