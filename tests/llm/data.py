"""Small tables with the awkward cases: nulls, empty and long texts, ties, repeated rows, clashing extra columns."""

PROSE = "The quick brown fox jumps over the lazy dog and runs along the river bank until the sun goes down behind the hills. "


def awkward(spark, extra=True):
    rows = [
        (1, PROSE * 5, "en", "a"), (2, PROSE * 5, "en", "a"), (2, PROSE * 5, "en", "a"), (3, None, None, None), (4, "", "en", "b"), (5, "word", "en", "b"), (6, "deux mots", "fr", "c"),
        (None, "no id here", "en", "a"), (7, PROSE * 400, "en", "a"), (8, "x" * 30000, None, "a"), (9, " \t\n ", "de", "b"), (10, "émoji 😀 Σίσυφος ẞ " * 9, "fr", "c"), (11, PROSE * 5 + "and a little more at the end", "en", "b"),
    ]
    df = spark.createDataFrame([(*r, len(r[1]) if r[1] else 0) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    if extra:  # names that the operators use themselves
        from pyspark.sql import functions as F

        for name in ("size", "score", "node", "ids", "feature", "labels"):
            df = df.withColumn(name, F.lit("mine"))
    return df


def empty(spark):
    return awkward(spark).filter("doc_id = -1")
