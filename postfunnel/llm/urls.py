"""URL filters: stated rules first, then trust and distrust over the host graph.

Rules (host, path, verdict) fit a host and its subdomains where the url's path
starts with theirs; the longest one wins.  For all other urls the host decides:
trust spreads from hosts with allowed pages along links, distrust spreads from
hosts with blocked pages against them, both as personalised PageRank, and a
host is blocked when its distrust exceeds ``ratio`` times its trust.

Links are summed per pair of hosts before any join, ranks are whole numbers, so
sums do not depend on their order.  Every few rounds the ranks are written.  The
walk goes on until verdicts and ranks have settled, however far its links lead;
ranks below 10**-18 of the whole walk count as that much.

Defined results: a null url, or one without ``://``, has the empty host and
path, which no rule fits; a host without seeds in reach is allowed.  Relative
links point to the page's own host.  A host without links points to itself.
Null html has no links.  Equal rows get equal results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from postfunnel.llm.common import written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
UNIT = 10 ** 18
#: The part of its own rank by which a settled host may still grow in the last rounds.
SETTLED = 1e-9
LINK = r"""(?i)<a\s[^>]*?href\s*=\s*["']?([^"'\s>]+)"""

Rule = tuple[str, str, str]


def _rest(url: Column) -> Column:
    """What follows the first ``://``; null where there is none."""
    return F.when(F.contains(url, F.lit("://")), F.substr(url, F.length(F.substring_index(url, "://", 1)) + F.lit(4)))


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(_rest(url), "^[^/?#]*", 0), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_rest(url), "^[^/?#]*([^?#]*)", 1), F.lit(""))


def match_rules(host: Column, path: Column, rules: list[Rule]) -> tuple[Column, Column]:
    """The longest rule that fits, as text, and its verdict; null where none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for own_host, own_path, says in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == own_host) | F.endswith(host, F.lit("." + own_host))) & F.startswith(path, F.lit(own_path))
        rule, verdict = F.when(fits, F.lit(own_host + own_path)).otherwise(rule), F.when(fits, F.lit(says)).otherwise(verdict)
    return rule, verdict


def host_edges(pages: DataFrame) -> DataFrame:
    """src, dst and the number of links between hosts."""
    links = pages.where("host <> ''").select("host", F.explode(F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(LINK), 1)).alias("link"))
    link = F.col("link")
    target = (F.when(F.startswith(link, F.lit("//")), host_of(F.concat(F.lit("x:"), link)))
              .when(F.rlike(link, F.lit("^[A-Za-z][A-Za-z0-9+.-]*://")), host_of(link))
              .when(F.rlike(link, F.lit("^[A-Za-z][A-Za-z0-9+.-]*:")), F.lit(None))
              .otherwise(F.col("host")))
    return links.select(F.col("host").alias("src"), target.alias("dst")).where("dst <> ''").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))


def _share(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """The part of a host's rank that each of its links hands on."""
    total = edges.groupBy("src").agg(F.sum("n").alias("all"))
    linked = edges.join(total, "src").select("src", "dst", (F.col("n") / F.col("all")).alias("share"))
    alone = seeds.join(total, seeds.host == total.src, "left_anti").select(F.col("host").alias("src"), F.col("host").alias("dst"), F.lit(1.0).alias("share"))
    return linked.unionByName(alone)


def _units(x: Column) -> Column:
    """Whole units, rounded up: what reaches a host never rounds to nothing, however far it came."""
    return F.ceil(x).cast("long")


def propagate(edges: DataFrame, seeds: DataFrame, damping: float = 0.85, rounds: int | None = None, step: int = 4,
              ratio: float = 1.0) -> DataFrame:
    """host, trust and distrust, in units of 10**-18, of the hosts that either reaches.

    ``seeds`` has host, allowed and blocked (numbers of pages).  What a host
    hands to itself is solved for, not walked.  Ranks grow from the seeds' own
    part and never fall, so the rounds have an end: when in ``step`` rounds no
    host is new, no verdict changes, and no rank grows by more than ``SETTLED``
    of itself.  ``rounds`` ends them earlier where a caller gives it.
    """
    turned = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "n")
    share = written(
        _share(edges, seeds.where("allowed > 0")).withColumn("kind", F.lit("trust"))
        .unionByName(_share(turned, seeds.where("blocked > 0")).withColumn("kind", F.lit("distrust"))), "host-links")
    total = seeds.agg(F.sum("allowed"), F.sum("blocked")).first()
    start = None
    for kind, column, whole in (("trust", "allowed", total[0]), ("distrust", "blocked", total[1])):
        part = seeds.where(F.col(column) > 0).select(
            F.lit(kind).alias("kind"), "host", (F.col(column) / F.lit(float(whole or 1)) * F.lit(float(UNIT))).alias("rank"))
        start = part if start is None else start.unionByName(part)
    kept = share.where("src = dst").select("kind", F.col("src").alias("host"), (1 - F.lit(damping) * F.col("share")).alias("left"))
    left = F.coalesce("left", F.lit(1.0))
    start = written(start.join(kept, ["kind", "host"], "left").select(
        "kind", "host", _units(F.col("rank") * F.lit(1 - damping) / left).alias("rank")), "host-seeds")
    flows = written(share.where("src <> dst").join(kept.withColumnRenamed("host", "dst"), ["kind", "dst"], "left").select(
        "kind", F.col("src").alias("host"), "dst", (F.col("share") * F.lit(damping) / left).alias("share")), "host-flows")
    rank, last, n = start, start, 0
    while rounds is None or n < rounds:
        n += 1
        flow = (rank.join(flows, ["kind", "host"])
                .select("kind", F.col("dst").alias("host"), _units(F.col("rank") * F.col("share")).alias("rank")))
        rank = flow.unionByName(start).groupBy("kind", "host").agg(F.sum("rank").alias("rank"))
        if n % step == 0:
            rank = written(rank, "host-ranks")
            if not _moved(last, rank, ratio):
                break
            last = rank
    return _both(rank, "rank").withColumnsRenamed({"rank_trust": "trust", "rank_distrust": "distrust"})


def _both(ranks: DataFrame, *columns: str) -> DataFrame:
    """One row of a host, with trust and distrust of each column."""
    return ranks.groupBy("host").agg(*(
        F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col(c))), F.lit(0)).alias(f"{c}_{kind}")
        for c in columns for kind in ("trust", "distrust")))


def _blocked(trust: Column, distrust: Column, ratio: float) -> Column:
    return distrust > trust * F.lit(ratio)


def _moved(last: DataFrame, rank: DataFrame, ratio: float) -> bool:
    """Is a host new, its verdict another, or one of its ranks not settled?"""
    none = F.lit(0).cast("long")
    both = _both(last.select("kind", "host", F.col("rank").alias("old"), none.alias("now"))
                 .unionByName(rank.select("kind", "host", none.alias("old"), F.col("rank").alias("now"))), "old", "now")
    # A new host grows from nothing, which is more than any part of itself.
    grows = lambda kind: F.col(f"now_{kind}") - F.col(f"old_{kind}") > F.col(f"now_{kind}") * F.lit(SETTLED)
    turns = _blocked(F.col("old_trust"), F.col("old_distrust"), ratio) != _blocked(F.col("now_trust"), F.col("now_distrust"), ratio)
    return not both.where(grows("trust") | grows("distrust") | turns).isEmpty()


def judge_urls(pages: DataFrame, rules: list[Rule], ratio: float = 1.0) -> DataFrame:
    """page_id, host, path, rule and verdict of every row, with the host's trust and distrust."""
    parsed = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), "html")
    rule, verdict = match_rules(F.col("host"), F.col("path"), rules)
    judged = parsed.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("by_rule"))
    seeds = judged.where("host <> ''").groupBy("host").agg(
        F.count(F.when(F.col("by_rule") == "allow", 1)).alias("allowed"), F.count(F.when(F.col("by_rule") == "block", 1)).alias("blocked"))
    ranks = propagate(written(host_edges(parsed), "host-edges"), written(seeds.where("allowed + blocked > 0"), "host-pages"), ratio=ratio)
    by_host = F.when(_blocked(F.coalesce("trust", F.lit(0)), F.coalesce("distrust", F.lit(0)), ratio), "block").otherwise("allow")
    return judged.join(ranks, "host", "left").select(
        "page_id", "host", "path", "rule", F.coalesce("by_rule", by_host).alias("verdict"),
        F.coalesce("trust", F.lit(0)).alias("trust"), F.coalesce("distrust", F.lit(0)).alias("distrust"))
