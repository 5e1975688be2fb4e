"""Pay: what a wording means, and that unknown never becomes zero."""

import pytest
from pyspark.sql import functions as F

from postfunnel.functions import money

HOURS = 2080
CASES = [
    # wording, job type, lower and upper end in dollars a year
    ("$3.00 - $4.50 an hour", "", 3 * HOURS, 4.5 * HOURS),
    ("$12–$20 USD/Hour", "", 12 * HOURS, 20 * HOURS),
    ("$6 ~ $9 / HR", "", 6 * HOURS, 9 * HOURS),
    ("7hrly", "", 7 * HOURS, 7 * HOURS),
    ("$150 USD/Weekly", "", 150 * 52, 150 * 52),
    ("900 month", "", 900 * 12, 900 * 12),
    ("$1,200.50 a month", "", 14406, 14406),
    ("40k - 55k per year", "", 40000, 55000),
    ("30,000PHP monthly", "", round(30000 * 12 / 58.5), round(30000 * 12 / 58.5)),
    ("PHP50k month", "", round(50000 * 12 / 58.5), round(50000 * 12 / 58.5)),
    ("500 pesos an hour", "", round(500 * HOURS / 58.5), round(500 * HOURS / 58.5)),
    ("4 aud/hr", "", round(4 * HOURS * 0.66), round(4 * HOURS * 0.66)),
    ("$1,000-1,500/mo | PHP 60k/mo", "", 12000, 18000),
    ("PHP 60k/mo | $1,000-1,500/mo", "", 12000, 18000),
    ("199", "", 199 * HOURS, 199 * HOURS),
    ("200", "", 2400, 2400),
    ("0 - 5 an hour", "", 5 * HOURS, 5 * HOURS),
    ("$250", "Gig", None, None),
    ("$100/week", " gig ", 5200, 5200),
    ("$15 fixed price", "", None, None),
    ("$3 per article", "", None, None),
    ("$9 / task", "", None, None),
    ("TBD", "", None, None),
    ("?", "", None, None),
    ("", "", None, None),
    (None, "", None, None),
    ("0", "", None, None),
    ("|", "", None, None),
]


def test_free_text_pay(spark):
    rows = spark.createDataFrame([(n, c[0], c[1]) for n, c in enumerate(CASES)], "n int, pay string, kind string")
    found = money.parse_pay(rows, "pay", "kind").orderBy("n").collect()
    assert [(r.pay, r.pay_min, r.pay_max) for r in found] == [(c[0], c[2], c[3]) for c in CASES]


@pytest.mark.parametrize("top, currency, period, annual", [
    (1000, "USD", "monthly", 12000), (1000, None, None, 1000), (1000, "", "", 1000), (50, "usd", "Hourly", 104000),
    (1000, "EUR", "annual", None), (1000, "USD", "weekly", None), (0, "USD", "annual", None),
    (None, "USD", "annual", None), (90000, "USD", "yearly", 90000),
])
def test_annual_ceiling(spark, top, currency, period, annual):
    row = spark.createDataFrame([(top, currency, period)], "t long, c string, p string")
    assert row.select(money.annual_usd_max(F.col("t"), F.col("c"), F.col("p"))).first()[0] == annual


@pytest.mark.parametrize("text, low, top, period, expected", [
    ("PHP 585 a month", 0.0, 585.0, "MONTHLY", (None, 10, "monthly", "USD")),
    ("$8 - $12 an hour", 8.0, 12.0, "hourly", (8, 12, "hourly", "USD")),
    ("$5 (PHP 300)", 5.0, 5.0, "YEARLY", (5, 5, "annual", "USD")),
    ("EUR 5", 5.0, 5.0, "YEARLY", (None, None, None, None)),
    ("$5", 5.0, 5.0, "WEEKLY", (None, None, None, None)),
    ("$5", 5.0, 0.0, "YEARLY", (None, None, None, None)),
    ("$5", 2.5, 3.5, "YEARLY", (2, 4, "annual", "USD")),  # half-even
    (None, 5.0, 5.0, "YEARLY", (None, None, None, None)),
])
def test_structured_pay(spark, text, low, top, period, expected):
    row = spark.createDataFrame([(text, low, top, period)], "salary_text string, salary_min double, salary_max double, salary_period string")
    found = row.select(money.structured_pay(F.struct(*row.columns)).alias("_p")).select("_p.*").first()
    assert tuple(found) == expected


def test_unknown_pay_clears_the_inbound_line(spark):
    row = spark.createDataFrame([(None,), (83200,), (83199,)], "a long")
    found = row.select(money.salary_signal(F.col("a"), 40.0), money.clears_inbound(F.col("a"), 40.0)).collect()
    assert [tuple(r) for r in found] == [("unknown", True), ("above", True), ("below", False)]


def test_pay_beyond_a_long_is_unknown(spark):
    from postfunnel.functions import money

    text = spark.createDataFrame([("$99999999999999999999 per month",)], "pay string")
    assert tuple(money.parse_pay(text, "pay").select("pay_min", "pay_max").first()) == (None, None)
    huge = spark.createDataFrame([(9 * 10 ** 18, "USD", "hourly")], "top long, currency string, period string")
    assert huge.select(money.annual_usd_max(F.col("top"), F.col("currency"), F.col("period"))).first()[0] is None
