"""Failure throttle per key, as a stateful stream.

The first failure opens a fixed window.  A success closes it, a lapsed window
starts again at one, and with enough failures in an open window every further
attempt is turned away unseen, whatever it would have been.
"""

from __future__ import annotations

import sys

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

# Workers get this module's code with the task, so they need no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

OUTPUT = "key string, attempt_no long, at long, outcome string, fails int, turn long"
STATE = "fails int, opened long, turn long, ats array<long>, numbers array<long>, failed array<boolean>"


def step(fails: int, opened: int, at: int, failed: bool, window: int, most: int):
    """One attempt: what becomes of it, and the state after it."""
    is_open = fails > 0 and at - opened <= window
    if is_open and fails >= most:
        return "throttled", fails, opened
    if not failed:
        return "ok", 0, 0
    return ("failed", fails + 1, opened) if is_open else ("failed", 1, at)


def _handler(window: int, most: int):
    def handle(key, frames, state):
        if state.hasTimedOut:
            state.remove()
            return
        fails, opened, turn, *held = state.get if state.exists else (0, 0, 0, [], [], [])
        rows = pd.concat(list(frames))
        new = set(zip(rows["at"].tolist(), rows["attempt_no"].tolist(), rows["failed"].tolist()))
        attempts = sorted(new.union(zip(*held)))
        # Before this moment nothing can come any more, so what is older is settled.
        settled_to = state.getCurrentWatermarkMs() * 1000
        first, told, kept = min(new), [], []
        now = (fails, opened)
        for attempt in attempts:
            at, number, failed = attempt
            outcome, *now = step(*now, at, failed, window, most)
            if attempt >= first:  # the others were told before, and nothing changed for them
                told.append((key[0], number, at, outcome, now[0], turn + 1))
            if at < settled_to:
                fails, opened = now
            else:
                kept.append(attempt)
        closes = (max(attempts[-1][0], opened) + window) // 1000 + 1
        if closes > state.getCurrentWatermarkMs():
            state.update((fails, opened, turn + 1, *([list(c) for c in zip(*kept)] or [[], [], []])))
            state.setTimeoutTimestamp(closes)
        elif state.exists:
            state.remove()
        names = [part.split()[0] for part in OUTPUT.split(", ")]
        yield pd.DataFrame(told, columns=names).astype({"fails": "int32"})

    return handle


def throttle(attempts: DataFrame, window_minutes: int, most: int) -> DataFrame:
    """Outcome of every attempt, by the time it was made, whatever the order in which attempts arrive.

    ``attempts`` is a stream of (key, attempt_no, ts, at, failed) with a
    watermark on ``ts``; ``at`` is the same moment in microseconds.  Attempts are
    kept until the watermark has passed them, so one that arrives late changes
    what became of those after it: these are told again, with a higher ``turn``
    (see ``last_told``).  State goes when the last window lapses.
    """
    return attempts.groupBy("key").applyInPandasWithState(
        _handler(window_minutes * 60_000_000, most), OUTPUT, STATE, "append",
        GroupStateTimeout.EventTimeTimeout,
    )


def last_told(outcomes: DataFrame) -> DataFrame:
    """The outcome of each attempt as it was told last."""
    rest = [c for c in outcomes.columns if c not in ("key", "attempt_no", "turn")]
    last = outcomes.groupBy("key", "attempt_no").agg(F.max_by(F.struct(*rest), "turn").alias("_last"))
    return last.select("key", "attempt_no", "_last.*")
