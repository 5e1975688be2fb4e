"""Result pages: cards of a search page, and the detail page behind a card."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from postfunnel import vocab
from postfunnel.functions import money
from postfunnel.functions.text import (
    absolute_url, blank_to_null, drop_teaser_tail, excerpt, let, row_id, squeeze, strip_html,
    trailing_id, with_stated_pay,
)
from postfunnel.sources import markup

# -- fixed values: how the board marks up a detail page ---------------------
BODY_MARK = "job-description"


def _class(name: str) -> str:
    """The class attribute of an open tag, holding ``name`` as a whole word."""
    return rf"""\bclass\s*=\s*["'](?:[^"']*\s)?{name}(?:\s[^"']*)?["']"""


def inner_html(html: Column, mark: str) -> Column:
    """What stands inside the first tag with a mark, up to its own close tag.

    Null when there is no such tag.  A node without a tag of its own name
    inside ends at the first close tag; only otherwise are the tags counted.
    """
    opening = rf"(?is)^.*?<([a-z][a-z0-9]*)\b[^>]*{mark}[^>]*>"
    cut = F.regexp_replace(html, opening, "$1\u0001")
    node = let(cut, lambda c: F.when(F.contains(c, F.lit("\u0001")), F.struct(
        F.lower(F.substring_index(c, "\u0001", 1)).alias("name"),
        F.substr(c, F.instr(c, "\u0001") + 1).alias("rest"),
    )))

    def inside(n: Column) -> Column:
        def by_first_close(low: Column) -> Column:
            size = F.position(F.concat(F.lit("</"), n["name"]), low) - 1
            nested = F.contains(F.substr(low, F.lit(1), size), F.concat(F.lit("<"), n["name"]))
            simple = (size >= 0) & (F.length(low) == F.length(n["rest"])) & ~nested
            return F.when(simple, F.substr(n["rest"], F.lit(1), size)).otherwise(
                _balanced(n["name"], n["rest"]))

        return let(F.lower(n["rest"]), by_first_close)

    return let(node, lambda n: F.when(n.isNotNull(), inside(n)))


def _balanced(name: Column, rest: Column) -> Column:
    """The text up to the close tag that brings the count of open tags to zero."""
    opens, closes = F.concat(F.lit("<"), name), F.concat(F.lit("</"), name)

    def step(piece: Column) -> Column:
        tag = F.lower(F.regexp_extract(piece, "^</?[a-zA-Z][a-zA-Z0-9]*", 0))
        return let(tag, lambda t: F.when(t == opens, 1).when(t == closes, -1).otherwise(0))

    def walk(pieces: Column) -> Column:
        # Depth after each piece, kept at zero once the node is closed.
        start = F.struct(F.lit(1).alias("depth"), F.lit(0).alias("used"))
        walked = F.aggregate(pieces, start, lambda at, piece: F.when(at["depth"] == 0, at).otherwise(
            F.struct((at["depth"] + step(piece)).alias("depth"), (at["used"] + 1).alias("used"))))
        used = let(walked, lambda w: F.when(w["depth"] == 0, w["used"] - 1).otherwise(w["used"]))
        return F.array_join(F.slice(pieces, F.lit(1), used), "")

    return let(F.split(rest, "(?=<)"), walk)


def cards_of(pages: DataFrame, *keep: str, html: str = "html") -> DataFrame:
    """One row per card, in page order, with its place and its fields as text.

    A page is walked once (``markup.cards``); everything after that is column
    expressions over the card's short fields.
    """
    picked = pages.select(*keep, F.col(html).cast("string").alias("_html"))
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in picked.schema.fields[:-1])
    card = ", ".join(f"{name}: string" for name in markup.FIELDS)
    return picked.mapInArrow(markup.read_cards, f"{kept}{', ' if kept else ''}pos int, card struct<{card}>")


def card_fields(cards: DataFrame) -> DataFrame:
    """The card's fields, tidied: a text's blanks squeezed, the stamp as a time, the teaser flattened."""
    c = F.col("card")
    return cards.select(
        *[n for n in cards.columns if n != "card"],
        c["href"].alias("href"),
        squeeze(c["job_type"]).alias("job_type"),
        squeeze(c["title"]).alias("title"),
        F.try_to_timestamp(F.btrim(c["stamp"])).alias("posted"),
        squeeze(c["company"]).alias("company"),
        squeeze(c["pay"]).alias("salary_text"),
        drop_teaser_tail(strip_html(c["teaser"])).alias("teaser"),
    )


def postings_from(cards: DataFrame, board: str = vocab.BOARD_CARDS, *keep: str,
                  base_url: str = vocab.CARDS_BASE_URL) -> DataFrame:
    """Cards as postings; one without an id, title or UTC stamp is dropped.

    The board hires in one country only, so its region is stated, not read.
    """
    rows = money.parse_pay(card_fields(cards), "salary_text", "job_type")
    described = with_stated_pay(F.col("salary_text"), F.col("teaser"))
    none = F.expr("cast(array() as array<string>)")
    paid = F.coalesce(F.col("pay_max"), F.lit(0)) != 0
    out = rows.select(
        *keep,
        F.lit(board).alias("source"),
        trailing_id(F.col("href")).alias("source_id"),
        row_id(F.lit(board), trailing_id(F.col("href"))).alias("uid"),
        "title", "company",
        absolute_url(F.col("href"), base_url).alias("url"),
        "posted",
        excerpt(described, 600).alias("excerpt"),
        described.alias("description"),
        F.array(F.lit(vocab.CARDS_REGION)).alias("location_restrictions"),
        F.expr("cast(array() as array<int>)").alias("timezone_restrictions"),
        F.col("pay_min").alias("salary_min"),
        F.col("pay_max").alias("salary_max"),
        F.when(paid, "annual").alias("salary_period"),
        F.when(paid, "USD").alias("currency"),
        F.when(F.col("job_type") != "", F.array("job_type")).otherwise(none).alias("categories"),
        "salary_text",
    )
    return out.filter(
        F.col("source_id").isNotNull() & (F.col("title") != "") & F.col("posted").isNotNull()
    )


def detail_body(html: Column) -> Column:
    """The advert's full text on its own page, or null."""
    by_id = inner_html(html, rf"""\bid\s*=\s*["']{BODY_MARK}["']""")
    by_class = inner_html(html, _class(BODY_MARK))
    return blank_to_null(strip_html(F.coalesce(by_id, by_class)))
