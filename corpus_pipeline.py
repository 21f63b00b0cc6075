"""The corpus pipeline: quality rules, line dedup, near duplicates, decontamination, packing.

Each stage gets what its predecessor kept, as written Parquet; all but the last return the columns
of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusprep.llm.common import free_name, table
from corpusprep.llm.decontam import decontaminate
from corpusprep.llm.jaccard import keep_one
from corpusprep.llm.line_templates import drop_templates
from corpusprep.llm.packing import pack
from corpusprep.llm.quality import quality
from corpusprep.llm.queries import tokenizer_path
from corpusprep.session import ensure_checkpoint_dir, ship_package


def _like(changed: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of ``docs``, with ``n_chars`` following the text."""
    out = changed.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else changed
    return out.select(*docs.columns)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the line rules keep, without their failing lines."""
    ship_package(spark)
    judged = quality(docs.select(F.struct(*docs.columns).alias("row"), F.col("text"))).where("kept")
    return _like(judged.select("row.*", F.col("clean_text").alias(clean := free_name(docs, "clean"))).withColumn("text", F.col(clean)), docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines of recurring templates; one left without any word goes."""
    ship_package(spark)
    left = drop_templates(docs.select(F.struct(*docs.columns).alias("row"), F.col("text"))).where(F.col("text").rlike(r"\S"))
    return _like(left.select("row.*", F.col("text").alias(clean := free_name(docs, "clean"))).withColumn("text", F.col(clean)), docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document (the smallest id) of each group linked by five-word shingles at 0.8."""
    ship_package(spark)
    return keep_one(docs, n=5, threshold=(80, 100))


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    ship_package(spark)
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the training sequences."""
    ship_package(spark)
    return pack(docs, tokenizer_path()).drop("padded_length")


STAGES = [("quality_rules", quality_rules), ("line_dedup", line_dedup), ("near_duplicates", near_duplicates),
          ("benchmark_decontamination", benchmark_decontamination), ("packing", packing)]

#: The tokenizer and the tiling have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. Between stages, Parquet in the shared checkpoint folder."""
    from uuid import uuid4

    base = f"{ensure_checkpoint_dir(spark).rstrip('/')}/pipeline-{uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.parquet(f"{base}/{k}-{name}")
            docs = spark.read.parquet(f"{base}/{k}-{name}")
    return docs
