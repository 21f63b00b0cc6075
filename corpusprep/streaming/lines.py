"""Streaming entry points for the row-wise operators.

The reference is a batch pipeline; its row-wise steps (punctuation split, tokenisation,
detokenisation, BPE segmentation with a fixed merge table, log-metric extraction) keep no
state, so the same Column expressions and the narrow BPE UDF run unchanged on a streaming
DataFrame. Files dropped into a directory are picked up by the file source; results go to a
Parquet sink with a checkpoint location (exactly-once file sink). No watermark is needed
because nothing is aggregated across rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from corpusprep.functions import text as tx
from corpusprep.operators.bpe_apply import apply_bpe
from corpusprep.operators.logs import extract_metrics


def read_line_stream(spark: SparkSession, directory: str, max_files_per_trigger: int | None = None) -> DataFrame:
    """New text files of ``directory`` as ``(path, text)`` rows (line positions inside a file
    are not tracked on a stream; batch jobs use ``sources.lines.read_lines``)."""
    r = spark.readStream.format("text")
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", str(max_files_per_trigger))
    return r.load(directory).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def normalise_stream(lines: DataFrame, split_punctuation: bool = True, lowercase: bool = False) -> DataFrame:
    """T1/T2 on a stream of lines."""
    t = F.col("text")
    if split_punctuation:
        t = tx.split_punctuation(t)
    if lowercase:
        t = tx.lowercase(t)
    return lines.withColumn("text", t)


def segment_stream(lines: DataFrame, merges, **kw) -> DataFrame:
    """B6 on a stream: the merge table is broadcast once when the query starts."""
    return apply_bpe(lines, "text", merges, out_col="enc", **kw)


def metrics_stream(logs: DataFrame) -> DataFrame:
    """L1 on a stream of training-log lines; the run id comes from the file path."""
    return extract_metrics(logs.withColumn("run", tx.run_of("path")), "text", keep=["run", "path"])


def to_parquet(df: DataFrame, path: str, checkpoint: str, available_now: bool = False) -> StreamingQuery:
    """Start an append-mode Parquet sink; ``available_now`` processes what is there and stops."""
    w = df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint) \
        .outputMode("append")
    if available_now:
        w = w.trigger(availableNow=True)
    return w.start()
