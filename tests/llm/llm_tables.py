"""Small tables for the tests of the training-data operators."""

from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                     T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
                     T.StructField("n_chars", T.LongType())])


def documents(spark, rows):
    """Rows of (doc_id, text[, lang[, source]]) as a documents table."""
    full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "a",
             len(r[1]) if r[1] else 0) for r in rows]
    return spark.createDataFrame(full, DOCS)
