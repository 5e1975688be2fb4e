"""Times: everything is UTC, and what cannot be read is null."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from postfunnel.functions.text import let

DAY_MICROS = 86_400_000_000
_FIRST_SECOND = -62_135_596_800
_LAST_SECOND = 253_402_300_799
_ISO = (
    r"^\d{4}-\d{2}-\d{2}"
    r"([T ]\d{2}:\d{2}(:\d{2}([.,]\d+)?)?(Z|z|[+-]\d{2}:?\d{2})?)?$"
)


def whole_number(value: Column) -> Column:
    """A number or numeric text as bigint, dropping any fraction."""
    text = F.btrim(value.cast("string"))
    number = text.try_cast("double")
    number = F.when(F.abs(number) < 1e15, number)
    toward_zero = F.when(number < 0, F.ceil(number)).otherwise(F.floor(number))
    return F.coalesce(text.try_cast("bigint"), toward_zero)


def epoch_seconds(value: Column) -> Column:
    seconds = whole_number(value)
    usable = (seconds != 0) & seconds.between(_FIRST_SECOND, _LAST_SECOND)
    return F.when(usable, F.timestamp_seconds(seconds))


def epoch_millis(value: Column) -> Column:
    millis = whole_number(value)
    usable = (millis != 0) & millis.between(_FIRST_SECOND * 1000, _LAST_SECOND * 1000)
    return F.when(usable, F.timestamp_millis(millis))


def iso_time(value: Column) -> Column:
    """ISO text as a time; text without a zone is UTC, junk is null, and what is finer than a microsecond is cut."""
    def read(text: Column) -> Column:
        plain = F.regexp_replace(F.replace(F.upper(text), F.lit(","), F.lit(".")), r"(\.\d{6})\d+", "$1")
        zoned = F.regexp_replace(plain, r"([+-]\d{2})(\d{2})$", "$1:$2")
        timed = F.regexp_replace(zoned, r"^(.{11}\d{2}:\d{2})(?!:)", "$1:00")
        # A bare date ends in -dd, which the zone rewrite must leave alone.
        return F.when(text.rlike(_ISO), F.try_to_timestamp(F.when(F.length(text) <= 10, plain).otherwise(timed)))

    return let(F.btrim(value.cast("string")), read)


def posted_time(date_posted: Column, pub_date: Column) -> Column:
    return F.coalesce(iso_time(date_posted), epoch_millis(pub_date))


def is_stale(posted: Column, max_age_days: Column, now: Column) -> Column:
    """More whole days old than the board's window.  No window or no date is
    never stale; exactly the window is kept."""
    elapsed = F.unix_micros(now) - F.unix_micros(posted)
    limit = (max_age_days.cast("bigint") + 1) * F.lit(DAY_MICROS)
    return F.coalesce(elapsed >= limit, F.lit(False))


def age_in_days(moment: Column, now: Column) -> Column:
    return (F.unix_micros(now) - F.unix_micros(moment)) / F.lit(float(DAY_MICROS))
