"""Line-oriented sources.

Every source yields an explicit position column, because line order is data in this library.
Parsers are split from readers: ``parse_*`` works on any ``(line_no, text)`` DataFrame, so the
same code runs on files, on tables and on streams.
"""

from __future__ import annotations

import ast
import re

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusprep.functions.text import one_spaced, run_of, step_of, tokens
from corpusprep.operators.align import last_per_key
from corpusprep.operators.order import ordered_scan


def read_lines(spark: SparkSession, path: str, with_path: bool = False) -> DataFrame:
    """One row per line with its exact 0-based position in its file.

    The text source reads each file split by one task in order, so (file, split start,
    ``monotonically_increasing_id``) orders the lines of a file; ``ordered_scan`` then turns that
    into a dense position without a single-task window. Works for any number/size of files.
    """
    raw = spark.read.text(path).select(
        F.col("value").alias("text"),
        F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_block_start").alias("__blk"),
        F.monotonically_increasing_id().alias("__mid"))
    out = ordered_scan(raw, ["__blk", "__mid"], groups=["path"], index="line_no")
    cols = (["path"] if with_path else []) + ["line_no", "text"]
    return out.select(*cols)


# ---------------------------------------------------------------------------------------------
# S2 keyed TSV
# ---------------------------------------------------------------------------------------------

def parse_keyed_lines(df: DataFrame, col: str = "text") -> DataFrame:
    """Drop ``#`` comment lines; split the rest on TAB into ``key``, ``text``. No quoting.
    A line without exactly two fields (or an empty line) is kept with ``reason='bad_arity'``
    and NULL key/text instead of aborting the job."""
    body = df.filter(~F.col(col).startswith("#"))
    parts = F.split(F.col(col), "\t", -1)
    good = F.size(parts) == 2
    keep = [c for c in df.columns if c != col]
    return body.select(*keep,
                       F.when(good, F.get(parts, 0)).alias("key"),
                       F.when(good, F.get(parts, 1)).alias("text"),
                       F.when(~good, F.lit("bad_arity")).alias("reason"))


def read_keyed_tsv(spark: SparkSession, path: str) -> DataFrame:
    return parse_keyed_lines(read_lines(spark, path), "text")


# ---------------------------------------------------------------------------------------------
# S3 record lines (Python dict literals)
# ---------------------------------------------------------------------------------------------

def parse_records(df: DataFrame, col: str, fields: list[str]) -> DataFrame:
    """S3: each line is a Python dict literal; pick ``fields`` (strings) into columns.
    A line that is no dict literal, misses a field or has a non-string value gets a ``reason``.
    Arrow-batched pandas UDF (``ast.literal_eval`` has no JVM equivalent)."""
    schema = T.StructType([T.StructField(f, T.StringType()) for f in fields] +
                          [T.StructField("reason", T.StringType())])

    @F.pandas_udf(schema)
    def _parse(s: pd.Series) -> pd.DataFrame:
        out = {f: [] for f in fields}
        reasons = []
        for line in s:
            vals, reason = [None] * len(fields), None
            try:
                obj = ast.literal_eval(line) if line is not None else None
                if not isinstance(obj, dict):
                    reason = "not_a_dict"
                else:
                    for i, f in enumerate(fields):
                        v = obj.get(f)
                        if v is None:
                            reason = reason or f"missing:{f}"
                        elif not isinstance(v, str):
                            reason = reason or f"not_string:{f}"
                        else:
                            vals[i] = v
            except (ValueError, SyntaxError, MemoryError, RecursionError, TypeError):
                reason = "unparsable"
            if reason:
                vals = [None] * len(fields)
            for f, v in zip(fields, vals):
                out[f].append(v)
            reasons.append(reason)
        out["reason"] = reasons
        return pd.DataFrame(out)

    keep = [c for c in df.columns if c != col]
    return df.select(*keep, _parse(F.col(col)).alias("__r")).select(*keep, "__r.*")


# ---------------------------------------------------------------------------------------------
# S4 merge table, S6 vocabulary, S7 word counts
# ---------------------------------------------------------------------------------------------

_VERSION_LINE = re.compile(r"#version:\s*([0-9]+(?:\.[0-9]+)*)")


def merges_version(df: DataFrame, col: str = "text") -> tuple[int, ...]:
    """Version of a merge table from its first line (``#version: a.b``; trailing ``.0`` groups
    dropped); a table without header is version 0.1. Reads one row."""
    first = df.filter(F.col("line_no") == 0).select(col).first()
    found = _VERSION_LINE.match(first[0] or "") if first else None
    if not found:
        return (0, 1)
    numbers = [int(x) for x in found[1].split(".")]
    while len(numbers) > 1 and numbers[-1] == 0:
        numbers.pop()
    return tuple(numbers)


def parse_merges(df: DataFrame, col: str = "text", has_header: bool | None = None) -> DataFrame:
    """``(rank, left, right)`` from merge-table lines ``(line_no, text)``.

    With a header the first line is skipped and ranks start at 0 on the next line. A rule is
    the whitespace fields of a line; only two-field rules can match a symbol pair, others are
    dropped. A repeated rule keeps its first (lowest) rank.
    """
    if has_header is None:
        has_header = _first_is_header(df, col)
    off = 1 if has_header else 0
    lines = df.filter(F.col("line_no") >= off).select(
        (F.col("line_no") - off).cast("long").alias("rank"), one_spaced(col).alias("__rule"))
    rules = lines.groupBy("__rule").agg(F.min("rank").alias("rank")).select("rank", F.split("__rule", " ", -1).alias("__f"))
    # the fields are told apart after equal rules have met, and in a generator: Spark would move a
    # filter, and with it the work on the text, back to the lines
    rule = F.when(F.size("__f") == 2, F.array(F.struct(F.get("__f", 0).alias("left"), F.get("__f", 1).alias("right"))))
    return rules.select("rank", F.inline(rule).alias("left", "right"))


def _first_is_header(df: DataFrame, col: str) -> bool:
    first = df.filter(F.col("line_no") == 0).select(col).first()
    return bool(first and first[0] and first[0].startswith("#version:"))


def read_merges(spark: SparkSession, path: str) -> tuple[DataFrame, tuple[int, ...]]:
    lines = read_lines(spark, path)
    return parse_merges(lines), merges_version(lines)


def parse_counts(df: DataFrame, col: str = "text", name: str = "word", order: str = "line_no") -> DataFrame:
    """``name count`` lines -> ``(order, name, freq)``; lines of another shape are dropped."""
    f = tokens(col)
    ok = (F.size(f) == 2) & F.get(f, 1).rlike(r"^[0-9]+$")
    return df.select(order, f.alias("__f")).filter(ok) \
        .select(order, F.get("__f", 0).alias(name), F.get("__f", 1).try_cast("long").alias("freq"))


def parse_vocab(df: DataFrame, col: str = "text", threshold: int | None = None) -> DataFrame:
    """``token count`` lines; keep a token when no threshold is given or count >= threshold."""
    v = parse_counts(df, col, "token")
    if threshold is not None:
        v = v.filter(F.col("freq") >= threshold)
    return v.groupBy("token").agg(F.max("freq").alias("freq"))


def parse_word_counts(df: DataFrame, col: str = "text", order: str = "line_no") -> DataFrame:
    """``word count`` lines; a repeated word keeps its last count (max over the order,
    a partial aggregate)."""
    return last_per_key(parse_counts(df, col, "word", order), "word", order, "freq")


def read_vocab(spark: SparkSession, path: str, threshold: int | None = None) -> DataFrame:
    return parse_vocab(read_lines(spark, path), "text", threshold)


def read_word_counts(spark: SparkSession, path: str) -> DataFrame:
    return parse_word_counts(read_lines(spark, path), "text")


# ---------------------------------------------------------------------------------------------
# S10 predictions, S11 logs
# ---------------------------------------------------------------------------------------------

def with_run_step(df: DataFrame, path_col: str = "path") -> DataFrame:
    """T13 on a path column: ``run`` (``output_N``) and ``step`` (``..._step_N``)."""
    return df.withColumn("run", run_of(path_col)).withColumn("step", step_of(path_col))


def read_predictions(spark: SparkSession, glob: str) -> DataFrame:
    """``(path, run, step, line_no, text)`` for every prediction file of the glob; the
    reference takes glob order (unordered), ours orders by step."""
    return with_run_step(read_lines(spark, glob, with_path=True)) \
        .select("path", "run", "step", "line_no", "text")


def read_logs(spark: SparkSession, glob: str) -> DataFrame:
    """``(run, line_no, text)`` of the training logs of the glob."""
    return read_lines(spark, glob, with_path=True).withColumn("run", run_of("path")) \
        .select("run", "line_no", "text")
