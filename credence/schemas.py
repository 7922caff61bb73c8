"""Explicit schemas of the data model; no column type is ever inferred."""

from pyspark.sql import types as T

SITE_LIST = T.StructType([T.StructField("site", T.StringType(), False)])

SITE_SEEDS = T.StructType([
    T.StructField("site", T.StringType(), False),
    T.StructField("group", T.StringType(), False),
])

SITE_SCORES = T.StructType([
    T.StructField("site", T.StringType(), False),
    T.StructField("sentiment", T.IntegerType(), False),
])

EXCLUDED_HOSTS = T.StructType([T.StructField("host", T.StringType(), False)])

PAGES = T.StructType([
    T.StructField("site", T.StringType()),
    T.StructField("url", T.StringType()),
    T.StructField("html", T.StringType()),
])

ARTICLES = T.StructType([
    T.StructField("sha1", T.StringType()),
    T.StructField("site", T.StringType()),
    T.StructField("url", T.StringType()),
    T.StructField("text", T.StringType()),
    T.StructField("sentiment", T.IntegerType()),
    T.StructField("polarity", T.IntegerType()),
    T.StructField("corpus", T.StringType()),
])

PROCESSED = T.StructType([
    T.StructField("name", T.StringType()),
    T.StructField("sha1", T.StringType()),
    T.StructField("sentiment", T.IntegerType()),
    T.StructField("polarity", T.IntegerType()),
    T.StructField("text", T.StringType()),
    T.StructField("corpus", T.StringType()),
])

LABELLED = T.StructType([
    T.StructField("sentence", T.StringType()),
    T.StructField("sentiment", T.IntegerType()),
    T.StructField("polarity", T.IntegerType()),
])

EXAMPLES = T.StructType([
    T.StructField("text_a", T.StringType()),
    T.StructField("text_b", T.StringType()),
    T.StructField("label", T.IntegerType()),
])

VOCABULARY = T.StructType([
    T.StructField("token", T.StringType(), False),
    T.StructField("id", T.IntegerType(), False),
])

FEATURES = T.StructType([
    T.StructField("input_ids", T.ArrayType(T.IntegerType(), False)),
    T.StructField("input_mask", T.ArrayType(T.IntegerType(), False)),
    T.StructField("segment_ids", T.ArrayType(T.IntegerType(), False)),
    T.StructField("label_id", T.IntegerType()),
])

PREDICTIONS = T.StructType([
    T.StructField("sentence", T.StringType()),
    T.StructField("log_probs", T.ArrayType(T.DoubleType())),
    T.StructField("label", T.IntegerType()),
])

TOKEN_COUNTS = T.StructType([
    T.StructField("token", T.StringType()),
    T.StructField("count", T.LongType()),
])
