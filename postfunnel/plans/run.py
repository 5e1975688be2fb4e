"""One run from postings to stored results.

    read -> drop seen -> funnel -> full text -> scores -> price -> store

The funnel's output is written once, to the shared folder: survivors, rejects
and counters all read it, and a lost executor re-reads a file instead of
working the sources out again.
"""

from __future__ import annotations

import datetime
import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from postfunnel import vocab
from postfunnel.operators import funnel, hydrate, scoring, selection, store
from postfunnel.policy import Profile, require_policies
from postfunnel.session import shared_dir
from postfunnel.sources import boards


class RunStore:
    """The tables one operator keeps between runs."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        # A run touches the months it has rows of; the rest of the history stays.
        month = F.concat_ws("_", "source", F.date_format("posted_at", "yyyy-MM"))
        self.jobs = store.VersionedTable(spark, f"{self.root}/jobs", month)
        self.asks = store.VersionedTable(spark, f"{self.root}/asks")

    def _appended(self, name: str) -> DataFrame | None:
        try:
            return self.spark.read.option("mergeSchema", True).parquet(f"{self.root}/{name}")
        except AnalysisException:
            return None

    def rejects(self) -> DataFrame | None:
        return self._appended("rejects")

    def ledger(self) -> DataFrame | None:
        events = self._appended("ledger")
        return None if events is None else store.run_ledger(events)

    def log(self, run_id: int, event_no: int, **values) -> None:
        """One row of the ledger; a later row of a run replaces an earlier one."""
        schema = ("run_id long, event_no int, started_at timestamp, finished_at timestamp, ok boolean, "
                  "fetched long, scored long, funnel string, model string, error string")
        names = [part.split()[0] for part in schema.split(", ")]
        row = {"run_id": run_id, "event_no": event_no, **values}
        frame = self.spark.createDataFrame([tuple(row.get(n) for n in names)], schema)
        frame.coalesce(1).write.mode("append").parquet(f"{self.root}/ledger")

    def next_run(self) -> int:
        ledger = self.ledger()
        return 1 if ledger is None else (ledger.agg(F.max("run_id").alias("n")).first().n or 0) + 1

    def since(self, now: Column) -> Column:
        """Where this run starts reading; a literal, so that it reaches the scans."""
        ledger = self.ledger()
        if ledger is None:
            return now - F.make_dt_interval(hours=F.lit(vocab.FIRST_RUN_LOOKBACK_HOURS))
        return F.lit(store.next_since(ledger, now).first().since)

    def seen(self) -> list[DataFrame]:
        return [t for t in (self.jobs.read(), self.rejects()) if t is not None]


@dataclass
class Outcome:
    run_id: int
    tagged: DataFrame
    priced: DataFrame
    counts: DataFrame
    line: str


class NoSource(RuntimeError):
    """No board of a run could be read."""


def run(spark: SparkSession, postings: DataFrame, profile: Profile, now: Column, kept: RunStore,
        capabilities: DataFrame | None = None, details: DataFrame | None = None,
        hydratable: list[str] = (vocab.BOARD_CARDS,),
        scorer: Callable[[DataFrame], DataFrame] | None = None,
        rescore: bool = False, model: str = "none", status: DataFrame | None = None) -> Outcome:
    """One run over all boards' rows.

    ``scorer`` takes the rendered batches (batch, n, text) and returns the
    responses (batch, body); without one every survivor is stored unscored.
    ``status`` is what ``boards.read_boards`` said of the boards: what failed is
    kept in the ledger, and the run fails only if all of them did.  The ledger
    has a closing row of every run, also of one that broke off.
    """
    policy = profile.frame(spark)
    require_policies(postings, policy)
    run_id, started = kept.next_run(), spark.range(1).select(now.alias("t")).first().t
    kept.log(run_id, 1, started_at=started, ok=False)
    clock = time.monotonic()

    def close(ok: bool, **values) -> None:
        finished = started + datetime.timedelta(seconds=time.monotonic() - clock)
        kept.log(run_id, 2, started_at=started, finished_at=finished, ok=ok, **values)

    try:
        failures = None if status is None else _failures(status)
        outcome = _run(spark, postings, profile, now, kept, policy, run_id, capabilities, details, hydratable, scorer, rescore)
    except Exception as problem:
        close(False, error=f"{type(problem).__name__}: {problem}"[:1000], model=model)
        raise
    row = outcome.counts.select("fetched", "to_score").first()
    close(True, fetched=row.fetched, scored=row.to_score, funnel=outcome.line, model=model, error=failures)
    return outcome


def _failures(status: DataFrame) -> str | None:
    """What went wrong, as one text; raises if nothing went well.  As many rows as there are boards."""
    told = [f"{r.source}: {r.error}" for r in status.where("error IS NOT NULL").orderBy("source").collect()]
    if not boards.run_ok(status).first().ok:
        raise NoSource("every source failed: " + "; ".join(told))
    return "; ".join(told) or None


def _run(spark, postings, profile, now, kept, policy, run_id, capabilities, details, hydratable, scorer, rescore) -> Outcome:
    rows = postings.withColumn("regions_authoritative", F.lit(True))
    if capabilities is not None:
        rows = boards.with_capabilities(postings, capabilities)
    rows = rows.withColumn("seen", F.lit(False)) if rescore or not kept.seen() else funnel.mark_seen(rows, *kept.seen())
    path = shared_dir(spark, "tagged")
    funnel.tag(rows, profile, now, policy).write.parquet(path)
    tagged = spark.read.parquet(path)
    fresh = tagged.filter(~F.col("seen"))

    passed = funnel.survivors(fresh)
    passed = hydrate.hydrate(passed, details, list(hydratable)) if details is not None else funnel.with_notes(passed)
    if scorer is None:
        results = scoring.unscored(passed)
    else:
        batched = scoring.with_batches(passed, sorted(profile.boards))
        answers = shared_dir(spark, "responses")
        scorer(scoring.render_batches(batched)).write.parquet(answers)
        results = scoring.merge_responses(batched, scoring.parse_responses(spark.read.parquet(answers)))
    path = shared_dir(spark, "priced")
    scoring.price(results, profile).write.parquet(path)
    priced = spark.read.parquet(path)

    # Of two copies of one advert in a run the later one is stored, with its asks.
    last = store.settled(priced, "uid", [F.desc("arrival")])
    jobs, asks = store.stored_jobs(last, run_id, now), store.stored_asks(last)
    old_asks = kept.asks.read()
    kept.asks.replace(store.replace_asks(asks.drop("position").limit(0) if old_asks is None else old_asks, jobs, asks))
    kept.jobs.upsert(jobs, store.upsert_rows)
    store.append_rejects(store.stored_rejects(fresh, run_id), f"{kept.root}/rejects")

    counts = funnel.funnel_counts(tagged)
    line = counts.select(funnel.funnel_line().alias("line")).first().line
    return Outcome(run_id, tagged, priced, counts, line)


def letters_for(outcome: Outcome, profile: Profile, letters: DataFrame) -> DataFrame:
    """Rows of this run that get a letter now."""
    return selection.run_letters(outcome.priced, profile.frame(letters.sparkSession), letters)
