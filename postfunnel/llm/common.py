"""What the operators share: tables, written intermediates, and words as numbers.

Words are the runs of bytes that are not ASCII white space, with A-Z lowered.
They are hashed to 64 bits for a whole slice of an Arrow column at once.  Two
different words of a corpus of 10**9 share a number with a chance of 3 %; the
operators compare them only within a pair of texts or behind a further hash.
"""

from __future__ import annotations

import sys
import types
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from postfunnel.session import shared_dir

SLICE_BYTES = 1 << 20
#: Bytes of text whose words are hashed at a time, or one longer word.
HASH_BYTES = 1 << 16
BATCH_KEY = "spark.sql.execution.arrow.maxBytesPerBatch"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, label: str) -> DataFrame:
    """The rows, written once to the cluster's shared folder and read from there."""
    path = shared_dir(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bound_batches(spark: SparkSession) -> SparkSession:
    """Arrow batches bounded by bytes where the session bounds them by rows only: 10,000 rows may be all texts of a task."""
    if spark.conf.get(BATCH_KEY, None) is None:
        spark.conf.set(BATCH_KEY, "4m")
    return spark


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def worker_state() -> types.ModuleType:
    """A place that lives as long as the Python worker, for caches and loaded models."""
    return sys.modules.setdefault("_postfunnel_worker", types.ModuleType("_postfunnel_worker"))


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts end to end and the n + 1 bounds; null counts as empty."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    bounds = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    if bounds[0] == bounds[-1]:
        return np.zeros(0, np.uint8), bounds - bounds[0]
    data = np.frombuffer(column.buffers()[2], np.uint8)[bounds[0]:bounds[-1]]
    return data, bounds - bounds[0]


def slices(batch: pa.RecordBatch, text: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of a batch that hold at most ``limit`` bytes of text, or one longer text."""
    sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(sizes)
    start = 0
    while start < len(sizes):
        before = ends[start] - sizes[start]
        stop = max(start + 1, int(np.searchsorted(ends, before + limit, "right")))
        yield batch.slice(start, stop - start)
        start = stop


def mix(x: np.ndarray) -> np.ndarray:
    """A one-to-one scramble of 64-bit numbers."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_STEP = 0x9E3779B97F4A7C15 | 1
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_STEP))[_LOWER]
_BLANK = np.zeros(256, bool)
_BLANK[[32, *range(9, 14)]] = True
#: ASCII characters that are neither letters nor digits.
_MARK = np.array([b < 128 and not chr(b).isalnum() for b in range(256)]) & ~_BLANK


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    state = worker_state()
    if len(getattr(state, "powers", ())) < n:
        size = max(n, HASH_BYTES)
        up, down = np.full(size, _STEP, np.uint64), np.full(size, pow(_STEP, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        state.powers, state.inverse = np.cumprod(up), np.cumprod(down)
    return state.powers[:n], state.inverse[:n]


def word_spans(column: pa.Array, marks: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of all texts, where each word starts and ends, and the n + 1 bounds of the texts among the words.

    With ``marks`` false, ASCII punctuation inside words is left out first.
    """
    data, bounds = raw(column)
    if not marks and len(data):
        keep = ~_MARK[data]
        bounds = np.concatenate(([0], np.cumsum(keep)))[bounds]
        data = data[keep]
    if not len(data):
        none = np.zeros(0, np.int64)
        return data, none, none, np.zeros(len(bounds), np.int64)
    inside = ~_BLANK[data]
    first = np.zeros(len(data) + 1, bool)
    first[bounds] = True
    starts = np.flatnonzero(inside & (first[:-1] | ~np.concatenate(([False], inside[:-1]))))
    ends = np.flatnonzero(inside & (first[1:] | ~np.concatenate((inside[1:], [False])))) + 1
    return data, starts, ends, np.searchsorted(starts, bounds)


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The words' numbers, a stretch of words at a time; words are given in order and do not overlap."""
    out, at = np.empty(len(starts), np.uint64), 0
    while at < len(starts):
        first = starts[at]
        stop = max(at + 1, int(np.searchsorted(ends, first + HASH_BYTES, "right")))
        begin, end = starts[at:stop] - first, ends[at:stop] - first
        up, down = _powers(int(end[-1]))
        total = np.zeros(int(end[-1]) + 1, np.uint64)
        np.cumsum(_BYTE[data[first:ends[stop - 1]]] * up, out=total[1:])
        out[at:stop] = mix((total[end] - total[begin]) * down[begin] + (end - begin).astype(np.uint64))
        at = stop
    return out


def word_hashes(column: pa.Array, marks: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Word numbers of all texts end to end, and the n + 1 bounds of the texts among them."""
    data, starts, ends, bounds = word_spans(column, marks)
    return hash_spans(data, starts, ends), bounds


def windows(hashes: np.ndarray, bounds: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Numbers of all runs of ``size`` words, the text and the place of each; a shorter text is one run."""
    texts = np.diff(bounds)
    owner = np.repeat(np.arange(len(texts)), texts)
    place = np.arange(len(hashes)) - bounds[owner]
    left = texts[owner] - place
    whole = left >= size
    alone = (texts[owner] < size) & (place == 0)
    padded = np.concatenate((hashes, np.zeros(size, np.uint64)))
    run = np.zeros(len(hashes), np.uint64)
    for j in range(size):
        run += np.where(left > j, padded[j:j + len(hashes)], np.uint64(j + 1)) * np.uint64(pow(_STEP, j + 1, 1 << 64))
    keep = whole | alone
    return mix(run + np.minimum(left, size).astype(np.uint64))[keep], owner[keep], place[keep]
