"""The record types every operator agrees on."""

from pyspark.sql import functions as F, types as T

POSTING = T.StructType([
    T.StructField("arrival", T.LongType()),
    T.StructField("source", T.StringType()),
    T.StructField("source_id", T.StringType()),
    T.StructField("uid", T.StringType()),
    T.StructField("title", T.StringType()),
    T.StructField("company", T.StringType()),
    T.StructField("url", T.StringType()),
    T.StructField("posted", T.TimestampType()),
    T.StructField("expires", T.TimestampType()),
    T.StructField("excerpt", T.StringType()),
    T.StructField("description", T.StringType()),
    T.StructField("location_restrictions", T.ArrayType(T.StringType())),
    T.StructField("timezone_restrictions", T.ArrayType(T.IntegerType())),
    T.StructField("salary_min", T.LongType()),
    T.StructField("salary_max", T.LongType()),
    T.StructField("salary_period", T.StringType()),
    T.StructField("currency", T.StringType()),
    T.StructField("seniority", T.ArrayType(T.StringType())),
    T.StructField("categories", T.ArrayType(T.StringType())),
])

# An empty list means "nothing stated"; a reader never leaves these null.
LIST_COLUMNS = ["location_restrictions", "timezone_restrictions", "seniority", "categories"]
TEXT_COLUMNS = ["company", "excerpt", "description"]

ASK = T.StructType([
    T.StructField("kind", T.StringType()),
    T.StructField("mandatory", T.BooleanType()),
    T.StructField("detail", T.StringType()),
])

SCORE_RESULT = T.StructType([
    T.StructField("i", T.StringType()),
    T.StructField("score", T.IntegerType()),
    T.StructField("verdict", T.StringType()),
    T.StructField("why", T.StringType()),
    T.StructField("matched_skills", T.ArrayType(T.StringType())),
    T.StructField("concerns", T.ArrayType(T.StringType())),
    T.StructField("cv_variant", T.StringType()),
    T.StructField("requirements", T.ArrayType(ASK)),
])

# The same as a scorer may say it: numbers with fractions, asks of any form.
SAID_RESULT = T.StructType([
    T.StructField(f.name, {"score": T.StringType(), "requirements": T.ArrayType(T.StringType())}.get(f.name, f.dataType))
    for f in SCORE_RESULT.fields
])

FEED_ITEM = T.StructType([
    T.StructField("guid", T.StringType()),
    T.StructField("applicationLink", T.StringType()),
    T.StructField("title", T.StringType()),
    T.StructField("companyName", T.StringType()),
    T.StructField("excerpt", T.StringType()),
    T.StructField("description", T.StringType()),
    T.StructField("pubDate", T.StringType()),
    T.StructField("expiryDate", T.StringType()),
    T.StructField("locationRestrictions", T.ArrayType(T.StringType())),
    T.StructField("timezoneRestrictions", T.ArrayType(T.StringType())),
    T.StructField("minSalary", T.DoubleType()),
    T.StructField("maxSalary", T.DoubleType()),
    T.StructField("salaryPeriod", T.StringType()),
    T.StructField("currency", T.StringType()),
    T.StructField("seniority", T.ArrayType(T.StringType())),
    T.StructField("categories", T.ArrayType(T.StringType())),
])
FEED_PAGE = T.StructType([
    T.StructField("jobs", T.ArrayType(FEED_ITEM)),
    T.StructField("nextCursor", T.StringType()),
    T.StructField("_corrupt_record", T.StringType()),
])

CAPTURE_ROW = T.StructType([
    T.StructField("jobkey", T.StringType()),
    T.StructField("title", T.StringType()),
    T.StructField("company", T.StringType()),
    T.StructField("country", T.StringType()),
    T.StructField("pub_date", T.StringType()),
    T.StructField("expired", T.BooleanType()),
    T.StructField("salary_text", T.StringType()),
    T.StructField("salary_period", T.StringType()),
    T.StructField("salary_min", T.DoubleType()),
    T.StructField("salary_max", T.DoubleType()),
    T.StructField("url", T.StringType()),
    T.StructField("date_posted", T.StringType()),
    T.StructField("valid_through", T.StringType()),
    T.StructField("description", T.StringType()),
])
CAPTURE_FILE = T.StructType([
    T.StructField("captured_at", T.StringType()),
    T.StructField("site", T.StringType()),
    T.StructField("results", T.ArrayType(CAPTURE_ROW)),
    T.StructField("_corrupt_record", T.StringType()),
])


def empty_list(kind: str):
    return F.expr(f"cast(array() as array<{kind}>)")


def as_posting(df):
    """Give a reader's output the posting columns, filling what it does not state."""
    picked = []
    for field in POSTING.fields:
        if field.name in df.columns:
            column = F.col(field.name).cast(field.dataType)
        else:
            column = F.lit(None).cast(field.dataType)
        if field.name in LIST_COLUMNS:
            column = F.coalesce(column, empty_list(field.dataType.elementType.simpleString()))
        elif field.name in TEXT_COLUMNS:
            column = F.coalesce(column, F.lit(""))
        picked.append(column.alias(field.name))
    return df.select(*picked)
