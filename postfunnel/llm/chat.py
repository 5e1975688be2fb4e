"""Chat formatting in windows of a token budget.

A turn is written as ``<s>role``, a line break, its text and ``</s>``.  Control
strings inside texts get a backslash after their first character, backslashes
are doubled, so the format reads back without loss; a role that is not a plain
word is written as ``=`` and the hex digits of its bytes.

Prefix sums of turn tokens cut a conversation into spans of whole turns.  Each
window holds the system turn (a first turn with that role), up to
``history_turns`` turns before its span (as far as ``history_tokens`` allow)
and the span.  It keeps to ``budget`` tokens, unless a single turn alone is
longer: turns are never cut.  The loss mask covers the assistant texts of the
span only, so a target that is repeated as history is masked out there.

Prefix sums are taken over blocks of ``BLOCK`` turn numbers first, so no task
sorts a whole long conversation; only its token counts are brought together to
choose the spans.  Texts meet again window by window.

Defined results: a null text or role is empty; turns are ordered by turn
(null first), then role, then text; equal rows are turns of their own; rows
without conv_id are one conversation.  A token is a run of characters that are
not ASCII white space; every turn has ``OVERHEAD`` more.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from postfunnel.llm.common import written

OVERHEAD = 4
BLOCK = 256
#: The control strings, fixed values.
CONTROLS = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
_CONTROL = r"(<)(?=s>|/s>|<SYS>>|</SYS>>)|(\[)(?=INST\]|/INST\])"


def escape(text: Column) -> Column:
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), _CONTROL, r"$1$2\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(\\)|\\", "$1")


def _role_out(role: Column) -> Column:
    return F.when(F.rlike(role, F.lit("^[A-Za-z0-9_]+$")), role).otherwise(F.concat(F.lit("="), F.hex(F.encode(role, "UTF-8"))))


def _role_in(role: Column) -> Column:
    return F.when(F.startswith(role, F.lit("=")), F.decode(F.unhex(F.substr(role, F.lit(2))), "UTF-8")).otherwise(role)


def count_tokens(text: Column) -> Column:
    return F.size(F.regexp_extract_all(text, F.lit(r"[^\x20\x09-\x0D]+"), 0)) + F.lit(OVERHEAD)


def number_turns(rows: DataFrame) -> DataFrame:
    """conv (a struct, so that null is a key too), at (from 0), role, text, tokens and upto, their prefix sum."""
    turns = rows.select(
        F.struct("conv_id").alias("conv"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
        F.coalesce(F.floor(F.col("turn") / BLOCK), F.lit(-(1 << 60))).alias("block"))
    turns = turns.withColumn("tokens", count_tokens(F.col("text")).cast("long"))
    totals = turns.groupBy("conv", "block").agg(F.count(F.lit(1)).alias("n"), F.sum("tokens").alias("t"))
    earlier = W.partitionBy("conv").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    starts = totals.select("conv", "block", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("n0"), F.coalesce(F.sum("t").over(earlier), F.lit(0)).alias("t0"))
    inside = W.partitionBy("conv", "block").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    return turns.join(starts, ["conv", "block"]).select(
        "conv", (F.col("n0") + F.row_number().over(inside) - 1).alias("at"), "role", "text", "tokens",
        (F.col("t0") + F.sum("tokens").over(inside.rowsBetween(W.unboundedPreceding, 0))).alias("upto"))


def choose_spans(turns: DataFrame, budget: int, history_turns: int, history_tokens: int) -> DataFrame:
    """conv, window, system (tokens of the system turn, else 0), first and last turn of the span, first turn of its history."""
    per = turns.groupBy("conv").agg(
        F.sort_array(F.collect_list(F.struct("at", "upto"))).alias("sums"),
        F.coalesce(F.max(F.when((F.col("at") == 0) & (F.col("role") == "system"), F.col("tokens"))), F.lit(0)).alias("system"))
    upto = F.concat(F.array(F.lit(0).cast("long")), F.transform("sums", lambda s: s["upto"]))
    per = per.select("conv", "system", F.size("sums").alias("n"), upto.alias("upto"))
    first = F.when(F.col("system") > 0, 1).otherwise(0)

    def step(state: Column, at: Column) -> Column:
        starts = state["starts"]
        room = F.lit(budget) - F.col("system") - F.when(F.size(starts) == 1, 0).otherwise(history_tokens)
        over = (F.element_at("upto", at + 2) - F.element_at("upto", state["start"] + 1) > room) & (at > state["start"])
        return F.struct(F.when(over, F.concat(starts, F.array(at))).otherwise(starts).alias("starts"),
                        F.when(over, at).otherwise(state["start"]).alias("start"))

    # A conversation of the system turn alone has one window without a span.
    whole = F.when(F.col("n") > first, F.sequence(first, F.col("n") - 1)).otherwise(F.array().cast("array<int>"))
    starts = F.aggregate(whole, F.struct(F.array(first).alias("starts"), first.alias("start")), step)["starts"]
    spans = per.select("conv", "system", "n", "upto", first.alias("least"), starts.alias("starts")).select(
        "*", F.posexplode("starts").alias("window", "first"))
    last = F.coalesce(F.get("starts", F.col("window") + 1), F.col("n")) - 1
    back = F.lit(0)
    for n in range(1, history_turns + 1):
        fits = (F.col("first") - n >= F.col("least")) & (F.element_at("upto", F.col("first") + 1) - F.get("upto", F.col("first") - n) <= history_tokens)
        back = F.when(fits, n).otherwise(back)
    return spans.select("conv", "window", "system", "first", last.alias("last"), (F.col("first") - back).alias("from"))


def format_chats(rows: DataFrame, budget: int = 1024, history_turns: int = 2, history_tokens: int = 256) -> DataFrame:
    """conv_id, window, text, n_repeated (leading turns that earlier windows hold), tokens, and mask (start and length in code points)."""
    turns = written(number_turns(rows), "turns")
    spans = written(choose_spans(turns, budget, history_turns, history_tokens), "spans")
    span = F.when(F.col("from") <= F.col("last"), F.sequence("from", "last")).otherwise(F.array().cast("array<int>"))
    wanted = spans.select("conv", "window", "first", F.explode(F.concat(F.when(F.col("system") > 0, F.array(F.lit(0))).otherwise(F.array().cast("array<int>")), span)).alias("at"))
    # The system turn counts as new in the first window.
    own = (F.col("at") >= F.col("first")) | ((F.col("window") == 0) & (F.col("at") == 0))
    # With a text, the place where it starts within the written turn is known.
    placed = wanted.join(turns, ["conv", "at"]).select(
        "conv", "window", "tokens", F.struct("at", own.alias("own"), ((F.col("role") == "assistant") & (F.col("at") >= F.col("first"))).alias("target"),
                                   F.concat(F.lit("<s>"), _role_out(F.col("role")), F.lit("\n")).alias("head"), escape(F.col("text")).alias("body")).alias("t"))
    windows = placed.groupBy("conv", "window").agg(F.sort_array(F.collect_list("t")).alias("ts"), F.sum("tokens").alias("tokens"))

    def step(state: Column, t: Column) -> Column:
        start = state["at"] + F.length(t["head"])
        size = F.length(t["body"])
        spot = F.struct(start.alias("start"), size.alias("length"))
        return F.struct((start + size + F.lit(len("</s>"))).alias("at"), F.when(t["target"], F.concat(state["mask"], F.array(spot))).otherwise(state["mask"]).alias("mask"))

    mask = F.aggregate("ts", F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("mask")), step)["mask"]
    text = F.array_join(F.transform("ts", lambda t: F.concat(t["head"], t["body"], F.lit("</s>"))), "")
    return windows.select(
        F.col("conv.conv_id").alias("conv_id"), "window", text.alias("text"), F.size(F.filter("ts", lambda t: ~t["own"])).alias("n_repeated"),
        "tokens", mask.alias("mask"))


def read_back(windows: DataFrame) -> DataFrame:
    """conv_id, turns (role and text, each once and in order) and targets (texts under the masks), from texts and masks alone."""
    parts = F.slice(F.split("text", "</s>", -1), F.lit(1), F.size(F.split("text", "</s>", -1)) - 1)
    fresh = F.slice(parts, F.col("n_repeated") + 1, F.size(parts))
    turn = lambda p: F.struct(
        _role_in(F.substr(F.substring_index(p, "\n", 1), F.lit(4))).alias("role"),
        unescape(F.substr(p, F.length(F.substring_index(p, "\n", 1)) + F.lit(2))).alias("text"))
    own = windows.select(
        F.struct("conv_id").alias("conv"), "window", F.transform(fresh, turn).alias("turns"), F.length("text").cast("long").alias("chars"),
        F.transform("mask", lambda m: unescape(F.substr("text", m["start"] + 1, m["length"]))).alias("targets"))
    per = own.groupBy("conv").agg(F.sort_array(F.collect_list(F.struct("window", "turns", "targets"))).alias("w"), F.sum("chars").alias("formatted_chars"))
    return per.select(
        F.col("conv.conv_id").alias("conv_id"), F.flatten(F.transform("w", lambda w: w["turns"])).alias("turns"),
        F.flatten(F.transform("w", lambda w: w["targets"])).alias("targets"), "formatted_chars")
