"""Cards of a result page, found in one pass over its tags.

The page is read as tags and texts, once from start to end, with a stack of the
tags that are open: a close tag ends what is open inside its partner, one
without a partner is skipped, and what the page never closes ends with it.
Comments, scripts and styles are passed over.  Attribute values may be quoted
either way or not at all, and entities are read as a browser reads them.  The
work is linear in the page; only a card inside a card is walked for both.
"""

from __future__ import annotations

import html
import re
import sys
from collections import Counter

import pyarrow as pa
from pyspark import cloudpickle

# Workers get this module's code with the task, so they need no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# -- fixed values: how the board marks up its pages, and what HTML says of tags --
CARD, LOGO, JOB_PATH, STAMP = "jobpost-cat-box", "jobpost-cat-box-logo", "/jobseekers/job/", "data-temp-2"
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
ENDED_BY = {"dd": {"dd", "dt"}, "dt": {"dd", "dt"}, "li": {"li"}, "p": {"p"}, "option": {"option"}}

FIELDS = ["href", "title", "job_type", "stamp", "company", "pay", "teaser"]
CARD_TYPE = pa.struct([(name, pa.string()) for name in FIELDS])

_VALUE = r"""(?:"[^"]*+"|'[^']*+'|[^\s>"'][^\s>]*+)"""
_TOKEN = re.compile(
    r"<!--(?:(?!-->).)*+(?:-->)?|<(/?)([A-Za-z][^\s/>]*+)"
    rf"(?:((?:[\s/=]++|[^\s=/>][^\s=/>]*+(?:\s*+=\s*+{_VALUE}?+)?+)*+)>|([^>]*+)>)", re.S)
_ATTRIBUTE = re.compile(rf"([^\s=/>][^\s=/>]*+)(?:\s*+=\s*+({_VALUE}))?+")
_RAW_END = {name: re.compile(rf"</{name}\b", re.I) for name in ("script", "style")}
_ENTITY = re.compile(r"&(?:#[0-9]+|#[xX][0-9a-fA-F]+|[A-Za-z][A-Za-z0-9]*);?")
_KEPT = {"&": "&amp;", "<": "&lt;", ">": "&gt;"}


def attributes(text: str) -> dict[str, str]:
    """The attributes of a tag by name; of two with one name the first counts."""
    out: dict[str, str] = {}
    for name, value in _ATTRIBUTE.findall(text):
        if value[:1] in ('"', "'"):
            value = value[1:-1]
        out.setdefault(name.lower(), html.unescape(value))
    return out


def plain_entities(markup: str) -> str:
    """Markup with every entity as its character, but for those of the three signs that mean something in it."""
    return _ENTITY.sub(lambda m: "".join(_KEPT.get(c, c) for c in html.unescape(m[0])), markup)


class _Card:
    """What has been seen of a card so far."""

    def __init__(self, around: str | None, inside: bool):
        self.href, self.linked = around or "", inside
        self.values: dict[str, str] = {}
        self.texts: dict[str, list[str]] = {}
        self.heading = False     # is its heading open?
        self.pay_row = 0         # how many pay rows are open
        self.sure = False        # was the pay found inside one?

    def row(self) -> dict[str, str]:
        told = {name: " ".join(parts) for name, parts in self.texts.items()}
        return {name: (self.href if name == "href" else told.get(name, self.values.get(name, ""))) for name in FIELDS}


def cards(page: str) -> list[dict[str, str]]:
    """The fields of every card of a page, in page order, as text ("" where a card lacks one)."""
    found: list[_Card] = []
    inside: list[_Card] = []              # cards that are open
    stack: list[tuple[str, list]] = []    # open tags and what to do when they close
    open_names: Counter = Counter()
    links: list[str] = []                 # addresses of the open links
    sinks: list[list[str]] = []           # where texts go
    at, last = 0, page.rfind(">") + 1     # no tag ends behind the last sign that ends one

    def close(depth: int, where: int) -> None:
        while len(stack) > depth:
            name, ends = stack.pop()
            open_names[name] -= 1
            for end in ends:
                end(where)

    def collect(card: _Card, field: str, ends: list) -> None:
        parts = card.texts[field] = []
        sinks.append(parts)
        ends.append(lambda _: sinks.remove(parts) if any(s is parts for s in sinks) else None)

    def enter(card: _Card, name: str, given: dict[str, str], start: int, ends: list) -> None:
        classes = given.get("class", "").split()
        if name == "a" and not card.linked and JOB_PATH in given.get("href", ""):
            card.href, card.linked = given["href"], True
        if STAMP in given:
            card.values.setdefault("stamp", given[STAMP])
        if name == "img" and LOGO in classes:
            card.values.setdefault("company", given.get("alt", ""))
        if name in VOID:
            return
        if name == "h4" and "title" not in card.texts:
            collect(card, "title", ends)
            card.heading = True
            ends.append(lambda _: setattr(card, "heading", False))
        elif "badge" in classes and card.heading and "job_type" not in card.texts:
            title = card.texts["title"]
            paused = [n for n, s in enumerate(sinks) if s is title]
            for n in paused:
                del sinks[n]
            collect(card, "job_type", ends)
            if paused:
                ends.append(lambda _: sinks.append(title) if card.heading else None)
        elif name == "dl" and {"row", "fs-14"} <= set(classes):
            card.pay_row += 1
            ends.append(lambda _: setattr(card, "pay_row", card.pay_row - 1))
        elif name == "dd" and "col" in classes and not card.sure and ("pay" not in card.texts or card.pay_row):
            collect(card, "pay", ends)
            card.sure = card.pay_row > 0
        if "desc" in classes and "teaser" not in card.values:
            card.values["teaser"] = ""
            ends.append(lambda where: card.values.update(teaser=plain_entities(page[start:where])))

    while True:
        token = _TOKEN.search(page, at, last)
        if sinks:
            text = html.unescape(page[at:token.start() if token else len(page)]).strip()
            if text:
                for sink in sinks:
                    sink.append(text)
        if token is None:
            break
        at = token.end()
        if token[2] is None:
            continue
        name = token[2].lower()
        if token[1]:
            if open_names[name]:
                depth = len(stack) - 1
                while stack[depth][0] != name:
                    depth -= 1
                close(depth, token.start())
            continue
        if stack and stack[-1][0] in ENDED_BY.get(name, ()):
            close(len(stack) - 1, token.start())
        ends: list = []
        told = token[3] or token[4] or ""
        given = attributes(told) if inside or name == "a" or CARD in told else {}
        for card in inside:
            enter(card, name, given, at, ends)
        if name == "div" and CARD in given.get("class", "").split():
            card = _Card(links[-1] if links else None, bool(links))
            found.append(card)
            inside.append(card)
            ends.append(lambda _, card=card: inside.remove(card))
        if name == "a":
            links.append(given.get("href", ""))
            ends.append(lambda _: links.pop())
        if name not in VOID:
            stack.append((name, ends))
            open_names[name] += 1
        if name in _RAW_END:
            end = _RAW_END[name].search(page, at)
            at = end.start() if end else len(page)
    close(0, len(page))
    return [card.row() for card in found]


def read_cards(batches):
    """Of batches whose last column is a page: the other columns, the card's place and its fields, one row a card."""
    for batch in batches:
        kept = batch.select(batch.schema.names[:-1])
        rows, places, told = [], [], []
        for n, page in enumerate(batch.column(batch.num_columns - 1).to_pylist()):
            own = cards(page) if page and CARD in page else []
            rows.extend([n] * len(own))
            places.extend(range(len(own)))
            told.extend(own)
        columns = [c.take(pa.array(rows, pa.int64())) for c in kept.columns]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(places, pa.int32()), pa.array(told, CARD_TYPE)], [*kept.schema.names, "pos", "card"])
