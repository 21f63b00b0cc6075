"""Flagship plan (E1 of the survey): build the training variants, learn BPE merges per
(variant, side) on the train split in one loop for all groups, segment every split with its
group's merges and report corpus statistics per (variant, side, split)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusprep.operators.bpe_apply import apply_bpe_groups
from corpusprep.operators.bpe_learn import learn_bpe
from corpusprep.operators.stats import corpus_stats
from corpusprep.operators.variants import build_variants
from corpusprep.plans import fixtures as fx
from corpusprep.session import cut_lineage
from corpusprep.sources.sinks import write_prepared

GROUPS = ["variant", "side"]
NUM_MERGES = 10_000  # as the reference learns


def sides(variants: DataFrame) -> DataFrame:
    """One row per (pair, side): ``(variant, side, split, corpus, line_no, text)``."""
    cols = ["variant", "split", "corpus", "line_no"]
    return variants.select(*cols, F.lit("src").alias("side"), F.col("src").alias("text")).unionByName(
        variants.select(*cols, F.lit("tgt").alias("side"), F.col("tgt").alias("text")))


def prepare(spark: SparkSession, sf_dir: str, num_merges: int = NUM_MERGES) -> tuple[DataFrame, DataFrame]:
    long = sides(build_variants(cut_lineage(fx.corpora(spark, sf_dir))))  # read for both sides, to learn and to segment
    merges = learn_bpe(long.filter(F.col("split") == "train"), "text", num_merges=num_merges, group_cols=GROUPS)
    encoded = apply_bpe_groups(long, "text", merges, GROUPS, out_col="enc")
    return merges, encoded


def prepare_files(spark: SparkSession, sf_dir: str, path: str, num_merges: int = NUM_MERGES, mode: str = "errorifexists") -> DataFrame:
    """The dataset on disk: codes, segmented and plain text per variant, side and split, all of it or
    nothing; returns the pairs that cannot be lines."""
    return write_prepared(*prepare(spark, sf_dir, num_merges), path, GROUPS, mode=mode)


def flagship(spark: SparkSession, sf_dir: str, num_merges: int = NUM_MERGES) -> DataFrame:
    _, encoded = prepare(spark, sf_dir, num_merges)
    return corpus_stats(encoded, "enc", ["variant", "side", "split"])
