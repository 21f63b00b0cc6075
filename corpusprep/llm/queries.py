"""The registered queries of the operators: whole tables, production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusprep.llm.common import table
from corpusprep.llm.oracles import OP1, OP4, OP11, OP12, OP13


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpusprep.llm.quality import quality

    d = quality(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return d.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
                    "n_lines", "lost_symbol", "lost_navigation", "lost_boilerplate", "lost_unfinished",
                    F.length("clean_text").cast("long").alias("clean_chars"))


def op2_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpusprep.llm.decontam import contaminated_pairs

    return contaminated_pairs(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpusprep.llm.jaccard import jaccard_components

    return jaccard_components(table(spark, sf_dir, "documents"), n=3, threshold=(90, 100))


def op8_hilbert_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpusprep.llm.sharding import hilbert_shards

    d = hilbert_shards(table(spark, sf_dir, "documents"))
    return d.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "curve")


def op9_cost_balanced_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpusprep.llm.packing import pack

    return pack(table(spark, sf_dir, "documents"), tokenizer_path()).drop("padded_length")


def op10_line_template_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpusprep.llm.line_templates import drop_templates

    return drop_templates(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_lines", "n_dropped", "dropped", "text")


def op3_pii_feistel(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpusprep.llm.pii import KINDS, pseudonymise

    d = pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return d.select("doc_id", *[f"n_{k}" for k in KINDS], "text")


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpusprep.llm.secrets import digest, secret_spans

    return digest(secret_spans(table(spark, sf_dir, "documents"), tokenizer_path()))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpusprep.llm.language import identify

    return identify(table(spark, sf_dir, "pages"), table(spark, sf_dir, "documents"))


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpusprep.llm.html_text import extract

    return extract(table(spark, sf_dir, "pages"))


def op11_overlapped_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpusprep.llm.resample import resample

    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_seekable_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpusprep.llm.warc import archive

    return archive(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op13_multi_index_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpusprep.llm.hard_negatives import mine

    return mine(table(spark, sf_dir, "embeddings"))


QUERIES = {f.__name__: f for f in (op1_quality_rules, op2_benchmark_decontamination, op3_pii_feistel, op4_ngram_jaccard_join,
                                   op5_secret_scan, op6_language_id, op7_html_extraction, op8_hilbert_sharding,
                                   op9_cost_balanced_packing, op10_line_template_dedup, op11_overlapped_resample, op12_seekable_warc,
                                   op13_multi_index_negatives)}
ORACLES: dict[str, str] = {"op1_quality_rules": OP1, "op4_ngram_jaccard_join": OP4, "op11_overlapped_resample": OP11,
                           "op12_seekable_warc": OP12, "op13_multi_index_negatives": OP13}
