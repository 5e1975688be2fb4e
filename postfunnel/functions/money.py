"""Pay, always three-valued: a pay that cannot be read is null, never zero."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from postfunnel import vocab
from postfunnel.functions.text import blank_to_null, squeeze

_FLAGS = "(?iU)"


def first_word(text: Column, words: list[tuple[str, str]]) -> Column:
    """Name of the first listed pattern found in the text, else null."""
    found = None
    for name, pattern in words:
        hit = text.rlike(_FLAGS + pattern)
        found = F.when(hit, name) if found is None else found.when(hit, name)
    return found


def annual_usd_max(salary_max: Column, currency: Column, period: Column) -> Column:
    """Upper end of the stated pay in dollars a year; null when unknown.

    A missing currency is accepted, a foreign one is not converted, and a
    period without a fixed number of hours in a year (weekly too) is unknown.
    """
    named = F.lower(F.coalesce(blank_to_null(period), F.lit("annual")))
    factor = None
    for name, times in vocab.STRUCTURED_PERIODS.items():
        factor = F.when(named == name, times) if factor is None else factor.when(named == name, times)
    dollars = F.coalesce(F.upper(blank_to_null(currency)), F.lit("USD")) == "USD"
    return F.when(dollars & (salary_max != 0), F.try_multiply(salary_max, factor).try_cast("bigint"))


def free_text_currency(text: Column) -> Column:
    """No word boundary before a code: people write 25,000PHP."""
    return (
        F.when(text.rlike(_FLAGS + vocab.PESO_WORDS), "PHP")
        .when(text.rlike(_FLAGS + vocab.AUD_WORDS), "AUD")
        .otherwise("USD")
    )


def capture_currency(text: Column) -> Column:
    """Currency by what the text says, never by the site it came from."""
    return F.when(F.contains(text, F.lit("$")), "USD").when(
        text.rlike(_FLAGS + vocab.PESO_WORDS), "PHP"
    )


def amounts(text: Column) -> Column:
    """Every number in the text, thousands marks and a k suffix understood."""
    tokens = F.regexp_extract_all(text, F.lit(f"({vocab.NUMBER})"), F.lit(1))

    def value(token: Column) -> Column:
        digits = F.regexp_replace(token, r"[,\skK]", "").try_cast("double")
        return digits * F.when(token.rlike("[kK]$"), F.lit(1000.0)).otherwise(F.lit(1.0))

    return F.array_compact(F.transform(tokens, value))


def stated_period(text: Column) -> Column:
    return first_word(text, vocab.PERIOD_WORDS)


def is_piecework(text: Column) -> Column:
    return text.rlike(_FLAGS + vocab.PIECEWORK)


def whole_dollars(amount: Column) -> Column:
    """Half-even rounding to whole dollars; an amount beyond a long is unknown."""
    return F.rint(amount).try_cast("bigint")


def tidy_pay(text: Column) -> Column:
    tidy = squeeze(F.coalesce(text, F.lit("")))
    return F.translate(tidy, "–—~", "---")


def pick_segment(text: Column) -> Column:
    """Of a pay written twice, the first dollar half with a number in it."""
    parts = F.filter(F.split(text, r"\|"), lambda s: squeeze(s) != "")
    parts = F.when(F.size(parts) > 0, parts).otherwise(F.array(text))
    in_dollars = F.filter(parts, lambda s: (free_text_currency(s) == "USD") & s.rlike(r"\d"))
    return F.coalesce(F.try_element_at(in_dollars, F.lit(1)), F.element_at(parts, 1))


def parse_pay(df, text: str, job_type: str | None = None):
    """Add ``pay_min`` and ``pay_max`` in dollars a year, read from free text.

    Steps are separate columns because each is used several times: as one
    nested expression the segment would be worked out again for every use.
    """
    kind = F.col(job_type) if job_type else F.lit("")
    out = df.withColumn("_pay", tidy_pay(F.col(text)))
    out = out.withColumn("_seg", F.when((F.col("_pay") != "") & ~is_piecework(F.col("_pay")),
                                        pick_segment(F.col("_pay"))))
    out = out.withColumn("_nums", F.filter(amounts(F.col("_seg")), lambda n: n > 0))
    out = out.withColumn("_top", F.array_max("_nums"))
    gig = F.lower(squeeze(F.coalesce(kind, F.lit("")))) == "gig"
    assumed = F.when(gig, F.lit(None).cast("string")).when(
        F.col("_top") < vocab.BARE_AMOUNT_IS_MONTHLY_AT, "hourly"
    ).otherwise("monthly")
    out = out.withColumn("_per", F.coalesce(stated_period(F.col("_seg")), assumed))
    out = out.withColumn("_cur", free_text_currency(F.col("_seg")))
    factor = _literal_map(vocab.FREE_TEXT_PERIODS, F.col("_per")) * _literal_map(
        vocab.FX_TO_USD, F.col("_cur")
    )
    out = out.withColumn("pay_min", whole_dollars(F.array_min("_nums") * factor))
    out = out.withColumn("pay_max", whole_dollars(F.col("_top") * factor))
    return out.drop("_pay", "_seg", "_nums", "_top", "_per", "_cur")


def _literal_map(table: dict[str, float], key: Column) -> Column:
    found = None
    for name, value in table.items():
        hit = key == name
        found = F.when(hit, float(value)) if found is None else found.when(hit, float(value))
    return found


def structured_pay(row: Column) -> Column:
    """A capture row's pay as one struct; unknown period or currency is no pay."""
    named = F.upper(F.coalesce(row["salary_period"], F.lit("")))
    period = None
    for code, name in vocab.CAPTURE_PERIODS.items():
        period = F.when(named == code, name) if period is None else period.when(named == code, name)
    rate = _literal_map(vocab.FX_TO_USD, capture_currency(row["salary_text"]))
    top = row["salary_max"].try_cast("double")
    low = row["salary_min"].try_cast("double")
    known = (top != 0) & period.isNotNull() & rate.isNotNull()
    return F.struct(
        F.when(known & (low != 0), whole_dollars(low * rate)).alias("salary_min"),
        F.when(known, whole_dollars(top * rate)).alias("salary_max"),
        F.when(known, period).alias("salary_period"),
        F.when(known, F.lit("USD")).alias("currency"),
    )


def salary_signal(annual: Column, target_hourly: float) -> Column:
    target = target_hourly * vocab.HOURS_PER_YEAR
    return F.when(annual.isNull(), "unknown").when(annual >= target, "above").otherwise("below")


def clears_inbound(annual: Column, inbound_hourly: float) -> Column:
    """An unstated pay is one worth asking about, so it clears the line."""
    return F.coalesce(annual >= inbound_hourly * vocab.HOURS_PER_YEAR, F.lit(True))
