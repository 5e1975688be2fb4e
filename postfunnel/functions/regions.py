"""Rules over lists of names: regions, employers and title patterns.

The lists come from the profile.  They are short and known when the plan is
built, so each becomes a chain of literal tests inside one expression.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

from postfunnel import vocab
from postfunnel.functions.text import fold, let, strip


def fold_text(text: str) -> str:
    return text.lower().replace("ß", "ss")


def any_of(tests: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, tests, F.lit(False))


def region_allowed(restriction: Column, allow: list[str], deny: list[str]) -> Column:
    """Does one stated restriction admit the person?  Names match as substrings
    in either direction, because boards share no vocabulary."""
    def decide(name: Column) -> Column:
        denied = any_of([F.contains(name, F.lit(fold_text(d))) for d in deny])
        admitted = any_of(
            [F.contains(name, F.lit(fold_text(a))) | F.contains(F.lit(fold_text(a)), name) for a in allow]
        )
        return (name == "") | (~denied & admitted)

    return let(fold(strip(restriction)), decide)


def all_local(restrictions: Column, anchors: list[str]) -> Column:
    return (F.size(restrictions) > 0) & F.forall(
        restrictions,
        lambda r: let(fold(r), lambda name: any_of([F.contains(name, F.lit(fold_text(a))) for a in anchors])),
    )


def first_name_in(company: Column, names: list[str]) -> Column:
    """First configured name that occurs in the company; null when none does."""
    def first(text: Column) -> Column:
        hits = [F.when((text != "") & F.contains(text, F.lit(fold_text(n))), F.lit(n)) for n in names]
        return F.coalesce(*hits)

    return let(fold(company), first) if names else F.lit(None).cast("string")


def first_pattern(text: Column, patterns: list[str]) -> Column:
    """First pattern of an ordered list that the text matches, else null."""
    def first(t: Column) -> Column:
        return F.coalesce(*[F.when(t.rlike("(?iU)" + p), F.lit(p)) for p in patterns])

    return let(text, first) if patterns else F.lit(None).cast("string")


def first_match(text: Column, patterns: list[str]) -> Column:
    """Text matched by the first pattern that matches at all, else null."""
    def first(t: Column) -> Column:
        return F.coalesce(*[
            F.when(t.rlike("(?iU)" + p), F.regexp_extract(t, "(?iU)" + p, 0)) for p in patterns
        ])

    return let(text, first) if patterns else F.lit(None).cast("string")


def country_regions(country: Column) -> Column:
    """A code we can name becomes a region; any other states nothing."""
    code = F.upper(strip(F.coalesce(country, F.lit(""))))
    names = [F.when(code == c, F.lit(name)) for c, name in vocab.COUNTRY_NAMES.items()]
    return F.array_compact(F.array(F.coalesce(*names)))


def offsets(values: Column) -> Column:
    """Whole-hour offsets; items that are no number are skipped."""
    items = F.transform(values, lambda v: F.btrim(v.cast("string")).try_cast("int"))
    return F.coalesce(F.array_compact(items), F.expr("cast(array() as array<int>)"))


def tidy_list(values: Column) -> Column:
    """Trimmed items without the blank ones."""
    items = F.filter(F.transform(values, strip), lambda v: v != "")
    return F.coalesce(items, F.expr("cast(array() as array<string>)"))


def named(table: dict[str, str], key: Column) -> Column:
    pairs = [F.lit(x) for pair in table.items() for x in pair]
    return F.try_element_at(F.create_map(*pairs), key)


__all__ = [
    "all_local", "any_of", "country_regions", "first_match", "first_name_in",
    "first_pattern", "fold_text", "named", "offsets", "region_allowed", "tidy_list",
]
