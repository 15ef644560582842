"""Row shapes shared by readers, operators and reports."""

from pyspark.sql import types as T

RAW_MESSAGE = T.StructType([
    T.StructField("original_id", T.StringType(), False),
    T.StructField("raw", T.BinaryType(), True),
])

PARSED_MESSAGE = T.StructType([
    T.StructField("original_id", T.StringType(), False),
    T.StructField("subject", T.StringType(), True),
    T.StructField("body", T.StringType(), True),
    T.StructField("had_html", T.BooleanType(), True),
])

EMAIL = T.StructType([
    T.StructField("id", T.StringType(), False),
    T.StructField("text", T.StringType(), True),
    T.StructField("subject", T.StringType(), True),
    T.StructField("body", T.StringType(), True),
    T.StructField("label", T.IntegerType(), False),
    T.StructField("source", T.StringType(), False),
    T.StructField("split", T.StringType(), False),
    T.StructField("original_id", T.StringType(), False),
    T.StructField("had_html", T.BooleanType(), True),
])
EMAIL_COLUMNS = tuple(EMAIL.names)

USAGE = T.StructType([
    T.StructField("input_tokens", T.LongType()),
    T.StructField("output_tokens", T.LongType()),
    T.StructField("cache_read_input_tokens", T.LongType()),
    T.StructField("cache_creation_input_tokens", T.LongType()),
])

REWRITE = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("original_id", T.StringType()),
    T.StructField("source", T.StringType()),
    T.StructField("severity", T.DoubleType()),
    T.StructField("provider", T.StringType()),
    T.StructField("model", T.StringType()),
    T.StructField("temperature", T.DoubleType()),
    T.StructField("prompt_hash", T.StringType()),
    T.StructField("input_text_sha", T.StringType()),
    T.StructField("rewrite_subject", T.StringType()),
    T.StructField("rewrite_body", T.StringType()),
    T.StructField("rewrite_text", T.StringType()),
    T.StructField("had_html", T.BooleanType()),
    T.StructField("refused", T.BooleanType()),
    T.StructField("n_orig_urls", T.IntegerType()),
    T.StructField("missing_urls", T.ArrayType(T.StringType())),
    T.StructField("retained_urls", T.BooleanType()),
    T.StructField("usage", USAGE),
    T.StructField("ts", T.TimestampType()),
])

EXTERNAL_CSV = T.StructType([
    T.StructField("subject", T.StringType()),
    T.StructField("body", T.StringType()),
    T.StructField("date", T.StringType()),
    T.StructField("label", T.IntegerType()),
])

SCORE = T.StructType([
    T.StructField("set", T.StringType()),
    T.StructField("corpus", T.StringType()),
    T.StructField("generator", T.StringType()),
    T.StructField("training", T.StringType()),
    T.StructField("condition", T.StringType()),
    T.StructField("model", T.StringType()),
    T.StructField("severity", T.DecimalType(3, 2)),
    T.StructField("row_id", T.StringType()),
    T.StructField("label", T.IntegerType()),
    T.StructField("score", T.DoubleType()),
])


def severity_key(column):
    """Exact join / grouping key for a severity (avoids comparing floats)."""
    return column.cast(T.DecimalType(3, 2))
