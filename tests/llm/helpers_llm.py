"""Small tables for the operators' tests."""

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, texts, extra=False):
    """Ids are places; a tuple gives its own id."""
    rows = [(t if isinstance(t, tuple) else (i, t)) for i, t in enumerate(texts)]
    df = spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in rows], SCHEMA)
    if extra:
        from pyspark.sql import functions as F

        for name in ("node", "n", "token", "t1", "hash", "score", "size", "label", "bytes", "anchor", "id"):
            df = df.withColumn(name, F.lit("clash"))
    return df
