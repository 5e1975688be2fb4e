"""Text and HTML column functions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from postfunnel import vocab

# Unicode white space, as a regex class body and as a character list for trim.
SPACE_CLASS = r"\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
SPACES = "".join(
    chr(c)
    for span in ((9, 13), (28, 32), (0x85, 0x85), (0xA0, 0xA0), (0x1680, 0x1680),
                 (0x2000, 0x200A), (0x2028, 0x2029), (0x202F, 0x202F), (0x205F, 0x205F),
                 (0x3000, 0x3000))
    for c in range(span[0], span[1] + 1)
)


def let(value: Column, body) -> Column:
    """``body(value)`` with the value worked out once.

    A column used several times in one expression is evaluated several times;
    a lambda's variable is not.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def strip(column: Column) -> Column:
    return F.btrim(column, F.lit(SPACES))


def squeeze(column: Column) -> Column:
    """Runs of white space become one blank, and the ends are trimmed.

    A single blank, by far the most common case, is not matched at all.
    """
    return strip(F.regexp_replace(column, f"[{SPACE_CLASS}]{{2,}}|[{SPACE_CLASS}&&[^ ]]", " "))


def fold(column: Column) -> Column:
    """Case-insensitive form; the sharp s is the one letter lower() leaves alone."""
    return F.replace(F.lower(column), F.lit("ß"), F.lit("ss"))


def blank_to_null(column: Column) -> Column:
    return F.when(column != "", column)


def code_point(number: Column) -> Column:
    """The character of a code point (chr() only covers the first 256)."""
    return F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32")


def _decimal_entities(text: Column) -> Column:
    """Replace each decimal entity; one that names no character stays as written."""
    def char(code: Column) -> Column:
        number = code.try_cast("bigint")
        usable = number.between(1, 0xD7FF) | number.between(0xE000, 0x10FFFF)
        return F.when(usable, code_point(number)).otherwise(F.concat(F.lit("&#"), code, F.lit(";")))

    # Every piece but the first starts with the digits of an entity.
    def piece(part: Column, place: Column) -> Column:
        code = F.regexp_extract(part, "^([0-9]+);", 1)
        rest = F.regexp_replace(part, "^[0-9]+;", "")
        return F.when(place == 0, part).otherwise(F.concat(char(code), rest))

    def rebuilt(column: Column) -> Column:
        pieces = F.transform(F.split(column, "&#(?=[0-9]+;)"), piece)
        return F.when(F.contains(column, F.lit("&#")), F.array_join(pieces, "")).otherwise(column)

    return let(text, rebuilt)


def strip_html(raw: Column) -> Column:
    """Display HTML flattened to readable text."""
    text = F.coalesce(raw, F.lit(""))
    text = F.regexp_replace(text, r"(?i)<(br|/p|/li|/h[1-6]|/div)[^>]*>", "\n")
    text = F.regexp_replace(text, "<[^>]+>", " ")
    for entity, char in vocab.ENTITIES:
        text = F.replace(text, F.lit(entity), F.lit(char))
    text = _decimal_entities(text)
    text = F.regexp_replace(text, r"[ \t\r\f\x0B]{2,}|[\t\r\f\x0B]", " ")
    text = F.regexp_replace(text, rf"\n[{SPACE_CLASS}]*\n[{SPACE_CLASS}]*", "\n\n")
    return strip(text)


def scrub_links(raw: Column) -> Column:
    """Flatten HTML and drop every URL before the text is kept anywhere."""
    text = F.coalesce(raw, F.lit(""))
    text = F.regexp_replace(text, r"(?i)<(br|/p|/li|/h[1-6]|/div)[^>]*>", "\n")
    text = F.regexp_replace(text, "<[^>]*>", " ")
    text = F.regexp_replace(text, rf"(?i)https?://[^{SPACE_CLASS}]+", " ")
    text = F.regexp_replace(text, rf"(?i)\bwww\.[^{SPACE_CLASS}]+", " ")
    text = F.replace(text, F.lit("&nbsp;"), F.lit(" "))
    text = F.replace(text, F.lit("&amp;"), F.lit("&"))
    text = F.regexp_replace(text, r"[ \t]{2,}|\t", " ")
    text = F.regexp_replace(text, rf"\n[{SPACE_CLASS}]*\n[{SPACE_CLASS}]*", "\n\n")
    return strip(text)


def row_id(source: Column, source_id: Column) -> Column:
    return F.concat(source, F.lit(":"), source_id)


def clip(text: Column, head: int = 800, tail: int = 400) -> Column:
    """Both ends of a long text: the conditions of a job sit at its bottom."""
    body = strip(F.coalesce(text, F.lit("")))
    return F.when(F.length(body) <= head + tail, body).otherwise(
        F.concat(F.substring(body, 1, head), F.lit("\n[...]\n"), F.right(body, F.lit(tail)))
    )


def excerpt(text: Column, size: int) -> Column:
    return F.substring(text, 1, size)


def drop_teaser_tail(text: Column) -> Column:
    return strip(F.regexp_replace(text, rf"[{SPACE_CLASS}]*See More[{SPACE_CLASS}]*$", ""))


def with_stated_pay(pay: Column, body: Column) -> Column:
    """Put the pay as the employer typed it in front of the text."""
    stated = F.concat(F.lit("Stated pay: "), pay, F.lit("\n\n"), body)
    return F.when(F.coalesce(pay, F.lit("")) != "", strip(stated)).otherwise(body)


def trailing_id(href: Column) -> Column:
    path = F.element_at(F.split(F.coalesce(href, F.lit("")), r"\?", 2), 1)
    return blank_to_null(F.regexp_extract(path, r"-([0-9]+)/?$", 1))


def absolute_url(href: Column, base: str) -> Column:
    return F.when(F.startswith(href, F.lit("/")), F.concat(F.lit(base), href)).otherwise(href)


def link_or_canonical(url: Column, site: Column, key: Column) -> Column:
    built = F.concat(F.lit("https://"), site, F.lit("/viewjob?jk="), key)
    return F.coalesce(blank_to_null(url), built)


def is_web_link(url: Column) -> Column:
    """Only http and https are links; anything else must not be rendered as one."""
    scheme = F.lower(F.try_parse_url(url, F.lit("PROTOCOL")))
    return F.coalesce(scheme.isin("http", "https"), F.lit(False))


def file_slug(uid: Column) -> Column:
    """A file-safe stem; the hash of the original keeps two like stems apart."""
    stem = F.regexp_replace(uid, "[^A-Za-z0-9._-]+", "-")
    stem = F.btrim(stem, F.lit("-._"))
    stem = F.rtrim(F.substring(stem, 1, 80), F.lit("-._"))
    stem = F.coalesce(blank_to_null(stem), F.lit("job"))
    return F.concat(stem, F.lit("-"), F.substring(F.sha2(uid, 256), 1, 8))


def repost_signature(source: Column, title: Column, company: Column) -> list[Column]:
    """Two listings with the same three values are one advert posted twice."""
    return [
        source.alias("sig_source"),
        F.lower(strip(F.coalesce(title, F.lit("")))).alias("sig_title"),
        F.lower(strip(F.coalesce(company, F.lit("")))).alias("sig_company"),
    ]


def _lookup(table: dict[str, str], key: Column) -> Column:
    pairs = [F.lit(item) for pair in table.items() for item in pair]
    return F.try_element_at(F.create_map(*pairs), key)


def phrases(kinds: Column, table: dict[str, str] | None = None) -> Column:
    """Requirement keys as phrases; an unknown key is shown as it is."""
    table = vocab.REQUIREMENT_LABELS if table is None else table
    return F.transform(kinds, lambda k: F.coalesce(_lookup(table, k), k))


def describe(kinds: Column) -> Column:
    return F.array_join(phrases(kinds, vocab.REQUIREMENT_KINDS), ", ")


def region_label(raw: Column) -> Column:
    """Label of a JSON list of regions; text that is not a JSON list is null.

    A JSON value that parses but is no list reads as "worldwide", like an
    empty list.
    """
    source = F.coalesce(blank_to_null(raw), F.lit("[]"))
    parsed = F.try_parse_json(source)
    names = F.from_json(source, "array<string>")
    count = F.coalesce(F.size(names), F.lit(0))
    short = F.array_join(F.slice(names, 1, 3), ", ")
    return (
        F.when(parsed.isNull(), F.lit(None).cast("string"))
        .when(names.isNull() | (count == 0), F.lit("worldwide"))
        .when(count > 3, F.concat(short, F.lit(" +"), (count - 3).cast("string")))
        .otherwise(short)
    )


def score_band(score: Column) -> Column:
    return F.when(score >= 65, "high").when(score >= 45, "middle").otherwise("low")


def salary_label(signal: Column) -> Column:
    return _lookup(vocab.SALARY_LABELS, signal)


def first_line(body: Column, size: int = 120) -> Column:
    """First non-blank line, shortened; null where there is none."""
    lines = F.transform(F.split(body, r"\r\n|[\n\r\x0B\f\x1c-\x1e\x85\u2028\u2029]"), strip)
    kept = F.filter(lines, lambda line: line != "")
    return F.substring(F.try_element_at(kept, F.lit(1)), 1, size)
