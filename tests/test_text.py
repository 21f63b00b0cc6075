"""Hand goldens for the text scalars."""

from pyspark.sql import functions as F

from corpusprep.functions import text as tx
from corpusprep.operators.external import build_prompt, clean_numbered


def one(spark, expr, value):
    return spark.createDataFrame([(value,)], "t string").select(expr.alias("o")).first()["o"]


def test_split_punctuation(spark):
    assert one(spark, tx.split_punctuation("t"), "Hi, you.") == "Hi ,  you ."
    assert one(spark, tx.split_punctuation("t"), "...") == " .  .  ."
    # trailing Unicode whitespace (as Python's rstrip) is removed, inner/leading kept
    assert one(spark, tx.split_punctuation("t"), "a \x1c") == "a"
    assert one(spark, tx.split_punctuation("t"), " x!\u3000") == " x !"


def test_tokens_unicode_whitespace(spark):
    assert one(spark, tx.tokens("t"), "a\x85b\xa0c d") == ["a", "b", "c", "d"]
    assert one(spark, tx.tokens("t"), "  ") == []


def test_detokenise(spark):
    assert one(spark, tx.detokenise("t", "regex"), "lo@@ w@@") == "low@@"
    assert one(spark, tx.detokenise("t", "strip"), "lo@@ w@@") == "low"


def test_truncate_and_lowercase(spark):
    assert one(spark, tx.truncate_tokens("t", 2), " a  b c ") == "a b"
    assert one(spark, tx.lowercase("t"), "ÉCOLE Ab") == "école ab"


def test_run_step(spark):
    df = spark.createDataFrame([("results/output_12/preds_m_step_384.txt",), ("x/y.txt",)], "path string")
    r = df.select(tx.run_of("path").alias("run"), tx.step_of("path").alias("step")).collect()
    assert (r[0].run, r[0].step) == ("output_12", 384)
    assert (r[1].run, r[1].step) == ("", None)


def test_clean_numbered(spark):
    df = spark.createDataFrame([(1, "1. a\n\n12.  b\n")], "b int, resp string")
    rows = clean_numbered(df, "resp").orderBy("pos").collect()
    assert [r.line for r in rows] == ["a", "b"]


def test_build_prompt_numbering(spark):
    df = spark.createDataFrame([(0, 0, "x"), (0, 1, "y")], "b int, i long, t string")
    p = build_prompt(df, "t", "i", ["b"], header="H:").first()["prompt"]
    assert p == "H:\n\n1. x\n\n2. y"
    p2 = build_prompt(df, "t", "i", ["b"], header="H:", first=2).first()["prompt"]
    assert p2 == "H:\n\n2. x\n\n3. y"
