"""Corpus mixing: pair normalisation (T3), empty-pair filter (T12), concatenation (U1) and
training-variant building (U2)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusprep.functions import text as tx

# The four training variants as (variant, corpus) memberships. Corpus A is the
# main (record-line) corpus, B the key-aligned one and C the back-translated one. Only the
# train split is mixed; dev and test always come from A.
VARIANT_RECIPE = [
    ("original", "A"),
    ("bible", "A"), ("bible", "B"),
    ("backtranslated", "A"), ("backtranslated", "C"),
    ("all", "A"), ("all", "B"), ("all", "C"),
]


def normalise_pairs(df: DataFrame, split_punctuation: bool = False, lowercase: bool = False,
                    cols: tuple[str, str] = ("src", "tgt")) -> DataFrame:
    """T1 then T2 on both sides, each by flag."""
    out = df
    for c in cols:
        e = F.col(c)
        if split_punctuation:
            e = tx.split_punctuation(e)
        if lowercase:
            e = tx.lowercase(e)
        out = out.withColumn(c, e)
    return out


def drop_empty_pairs(df: DataFrame, cols: tuple[str, str] = ("src", "tgt")) -> DataFrame:
    """Keep pairs whose sides both have at least one token."""
    cond = None
    for c in cols:
        k = F.size(tx.tokens(c)) > 0
        cond = k if cond is None else cond & k
    return df.filter(cond)


def count_empty_pairs(df: DataFrame, cols: tuple[str, str] = ("src", "tgt")) -> int:
    """The warning count of T12 (one aggregate action)."""
    cond = None
    for c in cols:
        k = F.size(tx.tokens(c)) == 0
        cond = k if cond is None else cond | k
    return df.filter(cond).count()


def concat_corpora(dfs: list[DataFrame], order_col: str = "line_no") -> DataFrame:
    """Bag union keeping argument order: ``corpus_ord`` + the input position give the order
    key ``(corpus_ord, line_no)``."""
    out = None
    for i, d in enumerate(dfs):
        x = d.withColumn("corpus_ord", F.lit(i))
        out = x if out is None else out.unionByName(x, allowMissingColumns=True)
    return out


def recipe_frame(spark: SparkSession, recipe=None) -> DataFrame:
    rows = [(v, c, i) for i, (v, c) in enumerate(recipe or VARIANT_RECIPE)]
    return spark.createDataFrame(rows, "variant string, corpus string, ord int")


def build_variants(corpora: DataFrame, recipe=None, punct_corpora: tuple[str, ...] = ("A",)) -> DataFrame:
    """``(variant, corpus, split, line_no, src, tgt)``. Train rows of each corpus go to every
    variant whose recipe lists it; dev/test rows only from the first corpus of the recipe (A).
    Punctuation splitting applies to ``punct_corpora`` only; no lowercasing.

    The recipe is a handful of rows (its size is fixed by the caller, not by the data), so it
    is broadcast; the corpus table is read once, with no copies per variant.
    """
    spark = corpora.sparkSession
    r = recipe_frame(spark, recipe)
    base = corpora.withColumn("src", F.when(F.col("corpus").isin(*punct_corpora), tx.split_punctuation("src"))
                              .otherwise(F.col("src"))) \
        .withColumn("tgt", F.when(F.col("corpus").isin(*punct_corpora), tx.split_punctuation("tgt"))
                    .otherwise(F.col("tgt")))
    first = (recipe or VARIANT_RECIPE)[0][1]
    j = base.join(F.broadcast(r), "corpus")
    keep = (F.col("split") == "train") | (F.col("corpus") == first)
    return j.filter(keep).select("variant", "corpus", "split", "line_no", "src", "tgt")
