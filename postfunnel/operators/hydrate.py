"""Late fetch of the full advert, for survivors only."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from postfunnel.functions import adverts
from postfunnel.functions.text import blank_to_null, excerpt, with_stated_pay


def hydrate(rows: DataFrame, details: DataFrame, boards: list[str], cap: int | None = None) -> DataFrame:
    """Swap the teaser for the detail page's text, of all rows of the boards.

    With a ``cap`` only that many rows, in arrival order, are looked up; the
    rest keep their teaser.  ``details`` holds (uid, body).  The funnel is not run again: a row that
    passed stays, only its eligibility notes are worked out anew.
    """
    chosen = rows.filter(F.col("source").isin(*boards))
    if cap is not None:
        chosen = chosen.orderBy("arrival").limit(cap)
    chosen = chosen.select("uid")
    pages = (
        details.join(chosen, "uid", "left_semi")
        .groupBy("uid").agg(F.min(blank_to_null(F.col("body"))).alias("_body"))
        .filter(F.col("_body").isNotNull())
    )
    found = rows.join(pages, "uid", "left")
    pay = F.col("salary_text") if "salary_text" in rows.columns else F.lit(None).cast("string")
    text = F.when(F.col("_body").isNotNull(), with_stated_pay(pay, F.col("_body")))
    return (
        found.withColumn("hydrated", F.col("_body").isNotNull())
        .withColumn("excerpt", F.coalesce(excerpt(text, 600), F.col("excerpt")))
        .withColumn("description", F.coalesce(text, F.col("description")))
        .withColumn("eligibility_notes", adverts.eligibility_sentences(F.col("description")))
        .drop("_body")
    )
