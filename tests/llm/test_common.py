from pyspark.sql import functions as F

from corpusprep.llm.common import fixed, small_side


def test_broadcasts_are_bounded_in_rows_and_bytes(spark):
    df = fixed(spark.range(100).select("id", F.repeat(F.lit("x"), 1000).alias("s"), F.array(F.struct("id", F.lit("yy").alias("t"))).alias("a"),
                                       F.array(F.lit(1), F.lit(2)).alias("n"), F.lit(None).cast("array<string>").alias("none")))
    assert small_side(df, 100, 1 << 20) is not df
    assert small_side(df, 99, 1 << 20) is df and small_side(df, 100, 100_000) is df
    assert small_side(df.limit(0)) is not None
