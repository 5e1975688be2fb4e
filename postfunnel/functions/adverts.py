"""What an advert's text says about who may apply and what to send."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from postfunnel import vocab
from postfunnel.functions.text import fold, let, squeeze, strip


def eligibility_sentences(text: Column, limit: int = 4) -> Column:
    """Sentences that state who may be hired: first of each wording, in order.

    The text is cut into sentences before the words are looked for, so the work
    stays linear in the length of the text, and texts without any of the words
    are not cut at all.
    """
    words = rf"(?iU)\b(?:{vocab.ELIGIBILITY_WORDS})\b"
    body = F.coalesce(text, F.lit(""))
    sentences = F.filter(F.split(body, r"(?<=[.!?])|\n"), lambda s: s.rlike(words))
    tidy = F.filter(F.transform(sentences, squeeze), lambda s: F.length(s) > 12)
    none = F.expr("cast(array() as array<string>)")
    first = F.aggregate(
        tidy,
        none,
        lambda kept, s: F.when(
            (F.size(kept) >= limit) | F.exists(kept, lambda k: fold(k) == fold(s)), kept
        ).otherwise(F.array_append(kept, s)),
    )
    return F.when(body.rlike(words), first).otherwise(none)


def _negated(before: Column, after: Column) -> Column:
    """Does a negation in the same clause end the text before, or start the text after?"""
    # (?d): only a line feed counts as the last line's end.
    return before.rlike(f"(?iUd){vocab.LETTER_NEG_BEFORE}") | after.rlike(f"(?iUd){vocab.LETTER_NEG_AFTER}")


def asks_for_letter(text: Column) -> Column:
    """Does the advert ask for a letter?  A negation in the same clause, on
    either side of the phrase, cancels it; one phrase left standing is enough.

    A negation counts within the window of characters next to the phrase.
    Windows are cut only from texts that have a phrase.
    """
    asked = vocab.LETTER_ASK
    n = vocab.LETTER_WINDOW
    # The cheap look at the phrase comes first; the window before it is whole, or starts with the text.  Java bounds
    # a look-behind in units of UTF-16, of which a character may have two: the last branch only widens that bound.
    before = rf"(\A[\s\S]{{0,{n - 1}}}|[\s\S]{{{n}}})|(?!)[\s\S]{{{2 * n}}}"
    windows = rf"(?iU)(?={asked})(?<={before})(?:{asked})(?=([\s\S]{{0,{n}}}))"
    body = strip(F.coalesce(text, F.lit("")))

    def standing(b: Column) -> Column:
        before, after = (F.regexp_extract_all(b, F.lit(windows), F.lit(group)) for group in (1, 2))
        return F.exists(F.arrays_zip(before.alias("before"), after.alias("after")), lambda w: ~_negated(w["before"], w["after"]))

    return let(body, lambda b: F.when(b.rlike("(?iU)" + asked), standing(b)).otherwise(F.lit(False)))
