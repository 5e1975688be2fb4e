"""Periodic runs by recompression.

The words of a slice of texts, a word of its own before, between and after
them, are one string of symbols.  Recompression turns it into a run-length
grammar: a round first replaces every block of one symbol by a symbol for that
block, then deals the symbols to two sides by hash and replaces every pair of a
left and a right one next to each other, until one symbol is left.  Equal
stretches are replaced alike but for their edges, so how far two places agree is
answered by climbing the grammar while the symbols are equal, moving past at
most one block or symbol a level, and coming down again where they differ.

A run of period p and three periods or more holds three multiples of p in a row.
So the places k p, (k + 1) p and (k + 2) p of every text and every p with equal
words are the candidates (n log n of them are looked at); the grammar extends
each exactly to both sides.  A stretch found for several periods is a run of the
least, which divides the others.  Candidates inside a run that an earlier one of
the same period gave are not extended again.

A text is handled in one task, in memory in proportion to its length (some 200
bytes a word); there is no shuffle.  Words are compared as 64-bit hashes within
a slice.

Defined results: a null or empty text, or one without words, has no runs and an
empty collapsed text.  Rows are independent: repeated rows and rows without an
id get the same answer as any other.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from postfunnel.llm.common import mix, raw, slices, word_spans

LEAST_WORDS = 24
LEAST_TURNS = 3
#: Candidates that are looked at, and extended, at a time.
CHUNK = 1 << 20
_STEP = 0x9E3779B97F4A7C15
RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


class Level(NamedTuple):
    """A string of the grammar; ``up`` and ``first`` tell how the next one is made of it."""

    symbols: np.ndarray
    up: np.ndarray | None = None      # the next level's place of each symbol
    first: np.ndarray | None = None   # where each symbol of the next level starts here, and the end
    blocks: bool = False


def _named(symbols: np.ndarray, starts: np.ndarray, made: np.ndarray, second: np.ndarray, fresh: int) -> tuple[np.ndarray, int]:
    """The next string: new names for what was ``made`` of a symbol and a second number."""
    out = symbols[starts]
    keys, own = np.unique(out[made].astype(np.int64) << 32 | second, return_inverse=True)
    out[made] = fresh + own
    return out, fresh + len(keys)


def _next(s: np.ndarray, starts: np.ndarray, blocks: bool) -> Level:
    opens = np.zeros(len(s), np.int32)
    opens[starts] = 1
    return Level(s, np.cumsum(opens, dtype=np.int32) - 1, np.append(starts, len(s)).astype(np.int32), blocks)


def recompress(symbols: np.ndarray) -> list[Level]:
    """The levels of the grammar, the given string first and one symbol last."""
    s = symbols.astype(np.int32)
    fresh, levels, salt = int(s.max(initial=0)) + 1, [], 0
    while len(s) > 1:
        starts = np.flatnonzero(np.r_[True, s[1:] != s[:-1]])
        if len(starts) < len(s):
            sizes = np.diff(np.append(starts, len(s)))
            made = sizes > 1
            levels.append(_next(s, starts, True))
            s, fresh = _named(s, starts, made, sizes[made], fresh)
            continue
        salt += 1
        left = (mix(s.astype(np.uint64) + np.uint64(salt * _STEP & (1 << 64) - 1)) >> np.uint64(63)).astype(bool)
        pair = left[:-1] & ~left[1:]
        turned = ~left[:-1] & left[1:]
        if turned.sum() > pair.sum():
            pair = turned
        if not pair.any():
            continue
        starts = np.flatnonzero(np.r_[True, ~pair])
        made = np.append(pair, False)[starts]
        levels.append(_next(s, starts, False))
        s, fresh = _named(s, starts, made, s[starts[made] + 1], fresh)
    return [*levels, Level(s)]


def _edge(level: Level, parent: np.ndarray, step: int) -> np.ndarray:
    """The child of each parent that is met first in a direction."""
    return level.first[parent] if step > 0 else level.first[parent + 1] - 1


def agree(levels: list[Level], x: np.ndarray, y: np.ndarray, step: int) -> np.ndarray:
    """How many symbols are equal from x and y on, going right (step 1) or left (-1); x and y differ.

    The string's first and last symbols must occur nowhere else.
    """
    begin, x, y = x, x.astype(np.int64), y.astype(np.int64)
    act, ends = np.arange(len(x)), []
    for level in levels:
        a, b = x[act], y[act]
        same = level.symbols[a] == level.symbols[b]
        ends.append([act[~same]])
        act, a, b = act[same], a[same], b[same]
        if not len(act):
            break
        pa_, pb = level.up[a], level.up[b]
        inside = (_edge(level, pa_, step) != a) | (_edge(level, pb, step) != b)
        if level.blocks:  # past what is left of the shorter block; unequal rests end the match there
            rest_a = level.first[pa_ + 1] - a if step > 0 else a - level.first[pa_] + 1
            rest_b = level.first[pb + 1] - b if step > 0 else b - level.first[pb] + 1
            move = step * np.where(inside, np.minimum(rest_a, rest_b), 0)
            done = inside & (rest_a != rest_b)
        else:  # past the second half of a pair, which is one's last symbol and the other's
            move, done = step * inside, np.zeros(len(act), bool)
        a, b = a + move, b + move
        x[act[done]], y[act[done]] = a[done], b[done]
        ends[-1].append(act[done])
        act, a, b = act[~done], a[~done], b[~done]
        x[act], y[act] = level.up[a], level.up[b]
    act = np.zeros(0, np.int64)
    for level, ended in zip(reversed(levels[:len(ends)]), reversed(ends)):
        if len(act):
            a, b = x[act], y[act]
            at_a, at_b = _edge(level, a, step).astype(np.int64), _edge(level, b, step).astype(np.int64)
            same = level.symbols[at_a] == level.symbols[at_b]
            if level.blocks:
                same = same * np.minimum(level.first[a + 1] - level.first[a], level.first[b + 1] - level.first[b])
            x[act], y[act] = at_a + step * same, at_b + step * same
        act = np.concatenate((act, *ended))
    return (x - begin) * step


def _candidates(symbols: np.ndarray, starts: np.ndarray, sizes: np.ndarray, least: int, turns: int):
    """Places and periods whose words stand at three grid places in a row, some texts' worth at a time."""
    many = np.where(sizes >= least, sizes // turns, 0)
    text = np.repeat(np.arange(len(sizes)), many)
    period = np.arange(len(text)) - np.repeat(np.cumsum(many) - many, many) + 1
    tests = (sizes[text] - 1) // period - 1
    done = np.concatenate(([0], np.cumsum(tests)))
    at = 0
    while at < len(text):
        stop = max(at + 1, int(np.searchsorted(done, done[at] + CHUNK, "right")) - 1)
        count = tests[at:stop]
        line = np.repeat(np.arange(at, stop), count)
        k = np.arange(len(line)) - np.repeat(done[at:stop] - done[at], count)
        p = period[line]
        place = starts[text[line]] + k * p
        hit = np.flatnonzero(symbols[place] == symbols[place + p])
        hit = hit[symbols[place[hit]] == symbols[place[hit] + 2 * p[hit]]]
        yield line[hit], place[hit], p[hit]
        at = stop


def find(symbols: np.ndarray, starts: np.ndarray, sizes: np.ndarray, least: int = LEAST_WORDS, turns: int = LEAST_TURNS):
    """Start (place in the string), end and period of all runs of the texts, in order."""
    found, levels = [np.zeros((0, 3), np.int64)], None

    def extended(place, p):
        nonlocal levels
        levels = levels or recompress(symbols)
        start = place - agree(levels, place - 1, place + p - 1, -1)
        end = place + p + agree(levels, place, place + p, 1)
        long = end - start >= np.maximum(least, turns * p)
        found.append(np.stack([start, end, p], 1)[long])
        return start, end

    for line, place, p in _candidates(symbols, starts, sizes, least, turns):
        if not len(place):
            continue
        head = np.r_[True, (line[1:] != line[:-1]) | (place[1:] != place[:-1] + p[1:])]
        start, end = extended(place[head], p[head])
        own = np.cumsum(head) - 1
        late = (place < start[own]) | (place >= end[own] - p)
        if late.any():
            extended(place[late], p[late])
    runs = np.concatenate(found)
    runs = runs[np.lexsort((runs[:, 2], runs[:, 1], runs[:, 0]))]
    fresh = np.r_[True, (runs[1:, :2] != runs[:-1, :2]).any(1)] if len(runs) else np.zeros(0, bool)
    runs = runs[fresh]
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


def _symbols(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A number for each word, by its bytes as they are."""
    if not len(starts):
        return np.zeros(0, np.int32)
    byte = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_STEP))
    up = np.full(len(data), _STEP, np.uint64)
    up[0] = 1
    up = np.cumprod(up)
    down = np.full(len(data), pow(_STEP, -1, 1 << 64), np.uint64)
    down[0] = 1
    down = np.cumprod(down)
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(byte[data] * up)))
    key = mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))
    return np.unique(key, return_inverse=True)[1].astype(np.int32)


def _joined(data, starts, ends, kept, bounds) -> pa.Array:
    """The kept words of each text with one space between."""
    owner = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))[kept]
    starts, sizes = starts[kept], (ends - starts)[kept]
    last = np.r_[owner[1:] != owner[:-1], np.ones(min(1, len(owner)), bool)]
    wide = sizes + ~last
    edge = np.concatenate(([0], np.cumsum(wide)))
    out = np.full(edge[-1], 32, np.uint8)
    inner = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out[np.repeat(edge[:-1], sizes) + inner] = data[np.repeat(starts, sizes) + inner]
    offsets = edge[np.searchsorted(owner, np.arange(len(bounds)))]
    return pa.StringArray.from_buffers(len(bounds) - 1, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(out))


def runs_of(texts: pa.Array, least: int = LEAST_WORDS, turns: int = LEAST_TURNS) -> tuple[np.ndarray, pa.Array, pa.Array]:
    """For each text how many words it has, its runs, and the text with each run cut to its first period."""
    data, word_from, word_to, bounds = word_spans(texts)
    data, _ = raw(texts)  # the bytes as they are; word_spans leaves their places unchanged
    sizes = np.diff(bounds)
    n = len(sizes)
    # A symbol of its own stands before each text and after the last.
    starts = bounds[:-1] + np.arange(n) + 1
    symbols = np.zeros(len(word_from) + n + 1, np.int32)
    inner = np.ones(len(symbols), bool)
    edges = np.append(starts - 1, len(symbols) - 1)
    inner[edges] = False
    words = _symbols(data, word_from, word_to)
    symbols[inner] = words
    symbols[edges] = int(words.max(initial=-1)) + 1 + np.arange(n + 1)
    runs = find(symbols, starts, sizes, least, turns)
    owner = np.searchsorted(starts, runs[:, 0], "right") - 1
    cover = np.zeros(len(symbols) + 1, np.int64)
    np.add.at(cover, runs[:, 0] + runs[:, 2], 1)
    np.add.at(cover, runs[:, 1], -1)
    kept = (np.cumsum(cover)[:-1] == 0)[inner]
    columns = (runs[:, 0] - starts[owner], runs[:, 1] - runs[:, 0], runs[:, 2])
    lists = pa.ListArray.from_arrays(
        pa.array(np.searchsorted(owner, np.arange(n + 1)), pa.int32()), pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in columns], fields=list(RUN)))
    return sizes, lists, _joined(data, word_from, word_to, kept, bounds)


def find_runs(docs: DataFrame, least: int = LEAST_WORDS, turns: int = LEAST_TURNS, id_column: str = "doc_id") -> DataFrame:
    """doc_id, n_words, runs (start, length, period; by start, then period) and collapsed text of each row of ``docs``.

    A run has ``least`` words and ``turns`` (3 or more) of its smallest period at
    least.  Of a run the first period stays in ``collapsed``; its words are
    joined by one space.
    """
    if turns < 3:
        raise ValueError("a run found by three grid places has three periods at least")

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                sizes, lists, collapsed = runs_of(part.column("text"), least, turns)
                yield pa.RecordBatch.from_arrays([part.column(id_column), pa.array(sizes, pa.int64()), lists, collapsed], [id_column, "n_words", "runs", "collapsed"])

    kind = docs.schema[id_column].dataType.simpleString()
    return docs.select(id_column, "text").mapInArrow(
        run, f"`{id_column}` {kind}, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string")
