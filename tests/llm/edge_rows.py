"""Rows that every operator must stand."""

import pytest

EDGE = [(1, "A b c d e f g h i j.\nA b c d e f g h i j.", "en", "s1"), (2, None, None, None), (None, "no id here", "en", "s1"),
        (3, "", "en", None), (4, " \t\n \n", "de", "s2"), (5, "one", "en", "s1"), (6, "one", "en", "s1"), (6, "one", "en", "s1"),
        (7, "long " * 30_000, "fr", "s1"), (8, "İ ſ ß \U0001F600 é́ x\x0by\x0cz w\x85v", "en", "s2"), (9, "the cat sat\non the mat", "en", "s1")]


@pytest.fixture()
def edge(spark):
    """Rows with NULLs, empty and long texts, ties, repeated rows, and columns whose names clash
    with those of the results."""
    df = spark.createDataFrame(EDGE, "doc_id long, text string, lang string, source string")
    from pyspark.sql import functions as F
    return df.withColumn("n_chars", F.length("text").cast("long")).withColumn("n_words", F.lit("clash")) \
        .withColumn("shard", F.lit(7)).withColumn("kept", F.lit("x")).withColumn("R", F.lit(1)).withColumn("key", F.lit(2)).withColumn("k", F.lit(3))
SMALL = "/root/testdata/sf0.001"
