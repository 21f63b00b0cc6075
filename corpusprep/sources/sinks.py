"""Sinks (S5, S8, S9, S12). Every write takes a Spark save mode; the default refuses to
overwrite an existing target, as the reference does without ``--overwrite``.

Outputs of several tables appear together (``write_together``): all are written below a staging
folder beside the target, then a manifest that names them, then the folder takes the target's name
in one rename. A failure before that leaves nothing at the target.

Ordered text is written in parallel: rows are range-partitioned on (groups, order), so the part files
of a folder, read by name, hold its lines in order, and a hot group is spread over many tasks."""

from __future__ import annotations

import json
from collections.abc import Callable
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusprep.session import cut_lineage, make_dirs, move_path, path_exists, remove_path, shuffle_partitions

MANIFEST = "_manifest"


def write_together(spark: SparkSession, path: str, tables: dict[str, Callable[[str], None]], mode: str = "errorifexists") -> None:
    """Call ``tables[name](folder)`` for every table, each to write below its folder, so that
    ``path/name`` of all appear at once or not at all. ``mode``: ``errorifexists`` or ``overwrite``."""
    if mode not in ("error", "errorifexists", "overwrite"):
        raise ValueError(f"mode is 'errorifexists' or 'overwrite', not {mode!r}")
    path = path.rstrip("/")
    if mode != "overwrite" and path_exists(spark, path):
        raise FileExistsError(f"{path} exists")
    stage = f"{path}.staging-{uuid4().hex}"
    make_dirs(spark, stage)
    try:
        for name, write in tables.items():
            write(f"{stage}/{name}")
        spark.createDataFrame([(json.dumps({"tables": sorted(tables)}),)], "value string").coalesce(1).write.text(f"{stage}/{MANIFEST}")
        if path_exists(spark, path):
            old = f"{path}.replaced-{uuid4().hex}"
            move_path(spark, path, old)
            move_path(spark, stage, path)
            remove_path(spark, old)
        else:
            move_path(spark, stage, path)
    except BaseException:
        remove_path(spark, stage)
        raise


def written_tables(spark: SparkSession, path: str) -> list[str]:
    """The tables that a finished ``write_together`` left at ``path``; none if there is no manifest."""
    at = f"{path.rstrip('/')}/{MANIFEST}"
    if not path_exists(spark, at):
        return []
    return json.loads(spark.read.text(at).first()["value"])["tables"]


def write_ordered_text(df: DataFrame, path: str, value: str, order_cols: list[str], group_cols: list[str] | None = None,
                       mode: str = "errorifexists", partitions: int | None = None) -> None:
    """One text output per group (``path/group=...``), lines in order over its part files."""
    g = list(group_cols or [])
    keys = g + list(order_cols)
    p = partitions or shuffle_partitions(df.sparkSession)
    rows = df.select(*g, *order_cols, F.col(value).alias("__value")).repartitionByRange(p, *keys).sortWithinPartitions(*keys)
    rows = rows.select(*g, F.col("__value").alias("value"))
    (rows.write.partitionBy(*g) if g else rows.write).mode(mode).text(path)


def write_merge_groups(merges: DataFrame, path: str, group_cols: list[str], mode: str = "errorifexists", version: str = "0.2") -> None:
    """S5 for the merge tables of many groups: one file with header per group, all in parallel. A
    group has at most ``num_merges`` rules, so it is one task's work; groups share the tasks."""
    rules = merges.select(*group_cols, F.col("rank").cast("long").alias("rank"), F.concat_ws(" ", "left", "right").alias("value"))
    heads = rules.select(*group_cols).distinct().select("*", F.lit(-1).cast("long").alias("rank"), F.lit(f"#version: {version}").alias("value"))
    heads.unionByName(rules).repartition(*[F.col(c) for c in group_cols]).sortWithinPartitions(*group_cols, "rank") \
        .select(*group_cols, "value").write.mode(mode).partitionBy(*group_cols).text(path)


def write_merges(merges: DataFrame, path: str, mode: str = "errorifexists", version: str = "0.2") -> None:
    """``#version: a.b`` header, then ``left right`` per rule in rank order, one text file.
    A merge table has at most ``num_merges`` rows by construction, so one output task is fine."""
    spark = merges.sparkSession
    head = spark.createDataFrame([(-1, f"#version: {version}")], "rank long, value string")
    body = merges.select(F.col("rank").cast("long"), F.concat_ws(" ", "left", "right").alias("value"))
    head.unionByName(body).repartition(1).sortWithinPartitions("rank").select("value") \
        .write.mode(mode).text(path)


def write_parallel(df: DataFrame, path: str, src_col: str = "src", tgt_col: str = "tgt",
                   order_cols: list[str] | None = None, mode: str = "errorifexists",
                   partitions: int | None = None) -> DataFrame:
    """MOSES layout: ``path/src`` and ``path/tgt`` text outputs with equal line counts in the
    same order (part file i of one side holds the same rows as part file i of the other).

    Both sides appear together. The rows are range-partitioned on the order and checkpointed once,
    so both sides are written from one fixed layout (a recomputed range sample could move partition borders).
    Rows with an embedded line break cannot be one line: they are not written and are
    returned (``reason = 'embedded_newline'``)."""
    order = list(order_cols or ["line_no"])
    bad = F.col(src_col).rlike("[\\n\\r]") | F.col(tgt_col).rlike("[\\n\\r]")
    rejects = df.filter(bad).withColumn("reason", F.lit("embedded_newline"))
    good = df.filter(~bad)
    p = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    laid = cut_lineage(good.repartitionByRange(p, *order).sortWithinPartitions(*order))
    write_together(df.sparkSession, path, {
        "src": lambda at: laid.select(F.col(src_col).alias("value")).write.text(at),
        "tgt": lambda at: laid.select(F.col(tgt_col).alias("value")).write.text(at)}, mode)
    return rejects


def write_dataset(df: DataFrame, path: str, mode: str = "errorifexists",
                  partition_cols: tuple[str, ...] = ("variant", "lang", "split")) -> None:
    """The variant x language x split dataset as Parquet partitioned by those columns
    (partition pruning when a trainer reads one variant/split)."""
    df.write.mode(mode).partitionBy(*partition_cols).parquet(path)


def write_prepared(merges: DataFrame, encoded: DataFrame, path: str, group_cols: list[str] | None = None,
                   order_cols: list[str] | None = None, mode: str = "errorifexists") -> DataFrame:
    """S9 as files: what ``prepare`` returns, all of it or nothing. ``path/codes`` holds a merge table
    per (variant, side), ``path/bpe`` and ``path/detok`` the segmented and the plain text per (variant,
    side, split) in the order of ``order_cols``, line by line the same rows on both sides and in both
    texts. Pairs with a line break in either side cannot be lines: they are in no output and are
    returned."""
    g = list(group_cols or ["variant", "side"])
    order = list(order_cols or ["corpus", "line_no"])
    pair = [c for c in g if c != "side"] + ["split", *order]
    held = cut_lineage(encoded.select(*dict.fromkeys([*g, "split", *order]), "text", "enc"))
    broken = held.where(F.col("text").rlike("[\\n\\r]") | F.col("enc").rlike("[\\n\\r]")).select(*pair).distinct()
    broken = cut_lineage(broken)
    match = None
    for c in pair:
        same = held[c].eqNullSafe(broken[c])
        match = same if match is None else match & same
    good = held.join(broken, match, "left_anti")
    write_together(held.sparkSession, path, {
        "codes": lambda at: write_merge_groups(merges, at, g),
        "bpe": lambda at: write_ordered_text(good, at, "enc", order, [*g, "split"]),
        "detok": lambda at: write_ordered_text(good, at, "text", order, [*g, "split"])}, mode)
    return broken


def write_scores(scores: DataFrame, best: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """The full score series as flat rows ``(run, metric, ordinal, value)`` partitioned by
    metric, and the per-run best table as JSON lines. Series stay flat (no per-run list), so a
    long series never has to fit one row."""
    scores.select("run", "metric", "ordinal", "value").write.mode(mode).partitionBy("metric") \
        .parquet(f"{path}/series")
    best.write.mode(mode).json(f"{path}/best")


def score_json(scores: DataFrame, metric: str) -> DataFrame:
    """The lines ``(section, run, at, value)`` of one JSON document with the series and the maximum of
    every run: ``{"<metric> scores": {run: [...]}, "<metric> scores max": {run: x}}``. A value is a
    line, so no row holds a series; NULL and NaN are ``null`` and never the maximum."""
    rows = scores.where(F.col("metric") == metric).select("run", "ordinal", F.when(~F.isnan("value"), F.col("value")).alias("value"))
    runs = rows.groupBy("run").agg(F.min("ordinal").alias("first"), F.max("value").alias("most"))
    runs = cut_lineage(runs)
    least = runs.agg(F.min("run")).first()[0]
    name = F.to_json(F.array("run"))
    name = F.concat(F.when(F.col("run") == least, "").otherwise(", "), F.substring(name, F.lit(2), F.length(name) - 2))
    number = lambda c: F.coalesce(F.to_json(F.array(c)), F.lit("[null]"))
    plain = lambda c: F.regexp_replace(number(c), r"^\[|\]$", "")
    line = lambda df, section, at, value: df.select(F.lit(section).alias("section"), "run", at.alias("at"), value.alias("value"))
    opening = F.col("first").cast("long") - 1
    values = rows.join(runs.select(F.col("run").alias("r"), "first"), F.col("run") == F.col("r")) \
        .select(F.lit(1).alias("section"), "run", F.col("ordinal").cast("long").alias("at"),
                F.concat(F.when(F.col("ordinal") == F.col("first"), "").otherwise(", "), plain("value")).alias("value"))
    series, most = json.dumps(f"{metric} scores"), json.dumps(f"{metric} scores max")
    frame = scores.sparkSession.createDataFrame([(0, "", 0, f"{{{series}: {{"), (2, "", 0, f"}}, {most}: {{"), (4, "", 0, "}}")],
                                                "section int, run string, at long, value string")
    ends = F.lit(2**63 - 1).cast("long")
    return frame.unionByName(line(runs, 1, opening, F.concat(name, F.lit(": [")))).unionByName(values) \
        .unionByName(line(runs, 1, ends, F.lit("]"))).unionByName(line(runs, 3, ends, F.concat(name, F.lit(": "), plain("most"))))


def write_score_json(scores: DataFrame, path: str, metrics: list[str], mode: str = "errorifexists", partitions: int | None = None) -> None:
    """S12 as JSON: ``path/<metric>`` is one document, its part files read one after the other (one
    file with ``partitions=1``). All metrics appear together."""
    def writer(metric: str):
        return lambda at: write_ordered_text(score_json(scores, metric), at, "value", ["section", "run", "at"], partitions=partitions)
    write_together(scores.sparkSession, path, {m: writer(m) for m in metrics}, mode)
