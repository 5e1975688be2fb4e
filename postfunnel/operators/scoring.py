"""Attaching scores from outside, and pricing them against the policy.

``score_raw`` is what the scorer said and never changes; ``score`` follows from
it and the current profile.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from postfunnel import vocab
from postfunnel.functions.dates import whole_number
from postfunnel.functions.text import clip, let, strip
from postfunnel.operators.numbering import with_position
from postfunnel.policy import Profile
from postfunnel.schema import ASK, SAID_RESULT, SCORE_RESULT


def source_rank(sources: list[str]) -> Column:
    """Place of a board in the configured order."""
    place = F.array_position(F.array(*[F.lit(s) for s in sources]), F.col("source"))
    return F.coalesce(place, F.lit(0)).cast("int")


def with_batches(rows: DataFrame, sources: list[str], size: int = vocab.SCORE_BATCH_SIZE) -> DataFrame:
    """Number survivors by board order and arrival, and cut them into batches."""
    ranked = rows.withColumn("_rank", source_rank(sources))
    placed = with_position(ranked, "arrival", ("_rank",))
    return (
        placed.withColumn("batch", F.floor(F.col("position") / size))
        .withColumn("i", (F.col("position") % size).cast("int"))
        .drop("_rank", "position")
    )


def scoring_block() -> Column:
    """One posting as the scorer reads it."""
    places = F.array_join("location_restrictions", ", ")
    region = (
        F.when(places != "", places)
        .when(F.col("region_unverified"),
              "none stated, and this board's region field is not reliable -- do NOT assume worldwide")
        .otherwise("none stated (worldwide)")
    )
    pay = F.when(
        F.col("annual_usd") != 0,
        F.concat(F.lit("up to "), F.format_number("annual_usd", 0), F.lit(" USD/yr")),
    ).otherwise("not stated")
    company = F.when(F.coalesce("company", F.lit("")) != "", F.col("company")).otherwise("unknown")
    body = F.when(F.coalesce("description", F.lit("")) != "", F.col("description")).otherwise(F.col("excerpt"))
    return F.concat_ws(
        "\n",
        F.concat(F.lit("["), F.col("i").cast("string"), F.lit("] "), F.col("title")),
        F.concat(F.lit("  company: "), company),
        F.concat(F.lit("  hiring regions: "), region),
        F.concat(F.lit("  salary: "), pay, F.lit(" ("), F.col("salary_signal"), F.lit(")")),
        F.concat(F.lit("  FLAGGED EMPLOYER: "), F.col("flagged_employer"), F.lit(" (rate-anchoring intermediary)")),
        F.when(F.size("eligibility_notes") > 0,
               F.concat(F.lit("  eligibility text found: "), F.array_join("eligibility_notes", " | "))),
        F.concat(F.lit("  description: "), clip(body)),
    )


def render_batches(batched: DataFrame) -> DataFrame:
    """One text per batch; a batch holds a dozen rows, so its group is bounded."""
    blocks = batched.select("batch", F.struct("i", scoring_block().alias("block")).alias("_b"))
    grouped = blocks.groupBy("batch").agg(F.array_sort(F.collect_list("_b")).alias("_bs"))
    return grouped.select(
        "batch", F.size("_bs").alias("n"), F.array_join(F.col("_bs.block"), "\n\n").alias("text")
    )


def parse_responses(responses: DataFrame, size: int = vocab.SCORE_BATCH_SIZE) -> DataFrame:
    """Results keyed by the index each one echoes, never by its place.

    ``responses`` holds (batch, body), the body a JSON list.  An item without a
    usable index is dropped; of two with one index the later wins.  A score with
    a fraction is cut to its whole part, and an ask that is no object with a
    ``kind`` is left out without costing the others.
    """
    items = responses.select("batch", F.posexplode(F.from_json("body", "array<string>")).alias("pos", "item"))
    rows = items.select(
        "batch", "pos",
        F.from_json("item", SAID_RESULT).alias("said"),
    ).withColumn("i", whole_number(F.col("said.i")))
    rows = rows.filter((F.col("i") >= 0) & (F.col("i") < size))
    last = W.partitionBy("batch", "i").orderBy(F.desc("pos"))
    return (
        rows.withColumn("_n", F.row_number().over(last)).filter(F.col("_n") == 1)
        .select("batch", F.col("i").cast("int").alias("i"), _as_result(F.col("said")).alias("result"))
    )


def _as_result(said: Column) -> Column:
    """What a scorer said, in the result's types."""
    read = {"score": whole_number(said["score"]).try_cast("int"), "requirements": _asks_said(said["requirements"])}
    fields = [read.get(f.name, said[f.name]).cast(f.dataType).alias(f.name) for f in SCORE_RESULT.fields]
    return F.when(said.isNotNull(), F.struct(*fields))


def _asks_said(items: Column) -> Column:
    """Asks from JSON texts, one by one: an item that cannot be read leaves the others as they are."""
    def ask(item: Column) -> Column:
        def read(value: Column) -> Column:
            detail = F.variant_get(value, "$.detail", "variant")
            return F.struct(
                F.try_variant_get(value, "$.kind", "string").alias("kind"),
                truthy(F.variant_get(value, "$.mandatory", "variant")).alias("mandatory"),
                F.when(truthy(detail), F.try_variant_get(value, "$.detail", "string")).alias("detail"))

        return let(F.try_parse_json(item), lambda v: F.when(F.startswith(F.schema_of_variant(v), F.lit("OBJECT<")), read(v)))

    return F.filter(F.transform(items, ask), lambda a: a["kind"].isNotNull())


def truthy(value: Column) -> Column:
    """Does a JSON value count as yes: neither missing, false, zero nor empty?"""
    kind = F.schema_of_variant(value)
    number = F.try_variant_get(value, "$", "double")
    return (
        F.when(value.isNull() | (kind == "VOID"), F.lit(False))
        .when(kind == "BOOLEAN", F.try_variant_get(value, "$", "boolean"))
        .when(kind == "STRING", F.try_variant_get(value, "$", "string") != "")
        .when(F.startswith(kind, F.lit("ARRAY")) | F.startswith(kind, F.lit("OBJECT")), ~F.to_json(value).isin("[]", "{}"))
        .otherwise(F.coalesce(number != 0, F.lit(True)))
    )


def merge_responses(batched: DataFrame, results: DataFrame) -> DataFrame:
    """Every posting with its result; one the scorer left out is 'unscored'."""
    joined = batched.join(results, ["batch", "i"], "left")
    missing = F.col("result").isNull()
    none = F.lit(None)
    return (
        joined.withColumn("score", F.col("result.score"))
        .withColumn("verdict", F.when(missing, "unscored").otherwise(F.col("result.verdict")))
        .withColumn("why", F.when(missing, vocab.UNSCORED_WHY).otherwise(F.col("result.why")))
        .withColumn("cv_variant", F.when(missing, vocab.DEFAULT_CV).otherwise(F.col("result.cv_variant")))
        .withColumn("requirements", F.when(missing, none).otherwise(F.col("result.requirements")))
        .withColumn("scored", ~missing)
        .drop("result")
    )


def unscored(rows: DataFrame) -> DataFrame:
    """A run without a scorer: every survivor is kept, explicitly unscored."""
    return (
        rows.withColumn("score", F.lit(None).cast("int"))
        .withColumn("verdict", F.lit("unscored"))
        .withColumn("why", F.lit(""))
        .withColumn("cv_variant", F.lit(vocab.DEFAULT_CV))
        .withColumn("requirements", F.lit(None).cast(SCORE_RESULT["requirements"].dataType))
    )


def normalise_asks(requirements: Column) -> Column:
    """Known kinds only, the first of each kind, details trimmed and short."""
    empty = F.expr(f"cast(array() as array<{ASK.simpleString()}>)")
    known = F.filter(
        F.coalesce(requirements, empty), lambda r: strip(r["kind"]).isin(*vocab.REQUIREMENT_KINDS)
    )
    rows = F.transform(known, lambda r: F.struct(
        strip(r["kind"]).alias("kind"),
        F.coalesce(r["mandatory"], F.lit(False)).alias("mandatory"),
        F.substring(strip(F.coalesce(r["detail"], F.lit(""))), 1, 200).alias("detail"),
    ))
    return F.aggregate(
        rows, empty,
        lambda kept, r: F.when(F.exists(kept, lambda k: k["kind"] == r["kind"]), kept)
        .otherwise(F.array_append(kept, r)),
    )


def first_asks(asks: DataFrame) -> DataFrame:
    """The same rule over a flat table of asks in (uid, position) order."""
    known = asks.withColumn("kind", strip(F.col("kind"))).filter(
        F.col("kind").isin(*vocab.REQUIREMENT_KINDS)
    )
    first = W.partitionBy("uid", "kind").orderBy("position")
    return (
        known.withColumn("_n", F.row_number().over(first)).filter(F.col("_n") == 1)
        .select("uid", "kind", F.coalesce("mandatory", F.lit(False)).alias("mandatory"),
                F.substring(strip(F.coalesce("detail", F.lit(""))), 1, 200).alias("detail"))
    )


def _kinds(asks: Column, keep) -> Column:
    return F.transform(F.filter(asks, keep), lambda r: r["kind"])


def penalised(raw: Column, n_blockers: Column, penalty: int) -> Column:
    """A penalty per blocker, never below zero; no score stays no score."""
    docked = F.greatest(F.lit(0), raw - n_blockers * penalty)  # skips nulls, hence the test
    return F.when(raw.isNotNull() & (n_blockers > 0), docked).otherwise(raw).cast("int")


def price(rows: DataFrame, profile: Profile) -> DataFrame:
    """Blockers, soft blockers, manual steps and the score they lead to."""
    cannot, manual = profile.cannot_provide, profile.needs_manual_step
    asks = F.col("requirements")
    priced = (
        rows.withColumn("requirements", normalise_asks(asks))
        .withColumn("blockers", _kinds(asks, lambda r: r["mandatory"] & r["kind"].isin(*cannot)))
        .withColumn("soft_blockers", _kinds(asks, lambda r: ~r["mandatory"] & r["kind"].isin(*cannot)))
        .withColumn("manual_steps", _kinds(asks, lambda r: r["kind"].isin(*manual)))
        .withColumn("score_raw", F.col("score"))
    )
    new = penalised(F.col("score_raw"), F.size("blockers"), profile.blocker_penalty)
    return priced.withColumn("score", new)


def blockers_per_job(asks: DataFrame, profile: Profile) -> DataFrame:
    """Sorted blocking kinds per uid: at most as many as the vocabulary has."""
    hard = asks.filter(F.col("mandatory") & F.col("kind").isin(*profile.cannot_provide))
    return hard.groupBy("uid").agg(F.sort_array(F.collect_set("kind")).alias("blocking"))


def reprice(jobs: DataFrame, asks: DataFrame, profile: Profile) -> DataFrame:
    """All stored rows priced anew.  A row stored before raw scores were kept
    was never penalised, so its score is its raw score.  Flags are always
    recomputed, so a row whose score does not move cannot keep stale ones."""
    joined = jobs.drop("blockers").join(blockers_per_job(asks, profile), "uid", "left")
    blocking = F.coalesce("blocking", F.expr("cast(array() as array<string>)"))
    out = (
        joined.withColumn("blockers", blocking).drop("blocking")
        .withColumn("old_score", F.col("score"))
        .withColumn("score_raw", F.coalesce("score_raw", "score"))
    )
    new = penalised(F.col("score_raw"), F.size("blockers"), profile.blocker_penalty)
    return out.withColumn("score", new).withColumn(
        "changed", ~F.col("score").eqNullSafe(F.col("old_score"))
    )


def reflag(asks: DataFrame, profile: Profile) -> DataFrame:
    """The stored per-ask flag, recomputed from the current profile."""
    return asks.withColumn(
        "blocking", F.col("mandatory") & F.col("kind").isin(*profile.cannot_provide)
    )


def live_kinds(stored: Column, current: list[str]) -> Column:
    """Stored keys the current profile still lists, in stored order."""
    return F.filter(stored, lambda k: k.isin(*current))


def run_summary(scored: DataFrame, policy: DataFrame) -> DataFrame:
    """Per board: how many rows reach that board's own threshold."""
    rows = scored.join(policy.select("source", "display_threshold"), "source")
    return rows.groupBy("source", "display_threshold").agg(
        F.count_if(F.coalesce("score", F.lit(0)) >= F.col("display_threshold")).alias("above"),
        F.count(F.lit(1)).alias("scored"),
    )


def pairing(batched: DataFrame, results: DataFrame) -> DataFrame:
    """Per batch: postings sent, results that came back, and those left out."""
    keys = results.select("batch", "i", F.lit(True).alias("_found"))
    joined = batched.select("batch", "i").join(keys, ["batch", "i"], "left")
    return joined.groupBy("batch").agg(
        F.count(F.lit(1)).alias("sent"), F.count("_found").alias("scored"),
        F.count_if(F.col("_found").isNull()).alias("unscored"),
    )
