"""Small tables that hold the awkward cases."""

from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])


def documents(spark, rows, extra=False):
    """rows: (doc_id, text[, lang]); ``extra`` adds columns whose names operators use inside."""
    full = [(r[0], r[1], r[2] if len(r) > 2 else "en", "src0", len(r[1] or "")) for r in rows]
    df = spark.createDataFrame(full, DOCS)
    if extra:
        for name in ("score", "kept", "digest", "fp", "leaf", "line", "word", "bit_at", "in_bitmap", "keep_id", "component_id", "row", "doc", "h", "y", "x"):
            df = df.selectExpr("*", f"'other' as {name}")
    return df


LONG = "lorem ipsum dolor sit amet, " * 5000
AWKWARD = [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, LONG), (6, "Same text here today friend."), (6, "Same text here today friend."), (7, "Same text here today friend."), (None, "no id on this one"), (8, "1234 5678 !!!")]
