"""Training-log metrics (L1, L2), score ordinals (W4), best score per run (A10), report."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusprep.functions.text import WS_CLASS
from corpusprep.operators.order import ordered_scan

# Metric name and the case-sensitive label that precedes its value in the log.
METRIC_PATTERNS = [
    ("bleu", "validation BLEU"),
    ("ppl", "Validation perplexity"),
    ("acc", "Validation accuracy"),
    ("train_ppl", "Train perplexity"),
    ("train_acc", "Train accuracy"),
]


def extract_metrics(df: DataFrame, col: str = "text", patterns: list[tuple[str, str]] | None = None,
                    keep: list[str] | None = None) -> DataFrame:
    """L1: ``(keep..., metric, value)``: for each pattern, the first ``label:\\s*(nan|[0-9.]+)``
    of a line; several patterns may hit one line. ``nan`` is NaN; a number Python cannot parse
    (``1.2.3``, ``.``) is NULL instead of an error (``try_cast``; ANSI mode is on)."""
    pats = patterns or METRIC_PATTERNS
    keep = keep if keep is not None else [c for c in df.columns if c != col]
    hits = F.array(*[F.struct(F.lit(name).alias("metric"),
                              F.regexp_extract(F.col(col), _quote(label) + ":" + WS_CLASS + "*(nan|[0-9.]+)", 1).alias("raw"))
                     for name, label in pats])
    x = df.select(*keep, F.explode(hits).alias("h")).filter(F.col("h.raw") != "")
    value = F.when(F.col("h.raw") == "nan", F.lit(float("nan"))).otherwise(F.col("h.raw").try_cast("double"))
    return x.select(*keep, F.col("h.metric").alias("metric"), value.alias("value"))


def _quote(s: str) -> str:
    return "".join("\\" + c if not (c.isalnum() or c == " ") else c for c in s)


def with_ordinal(scores: DataFrame, groups: list[str] | None = None, order: str = "line_no") -> DataFrame:
    """1-based position of each score inside its (run, metric) series, by a range-
    partitioned scan (a run holding a third of all rows is still spread over many tasks)."""
    g = groups or ["run", "metric"]
    return ordered_scan(scores, [order], groups=g, index="ordinal").withColumn("ordinal", F.col("ordinal") + 1)


def best_per_run(scores: DataFrame, groups: list[str] | None = None) -> DataFrame:
    """A10: per series the maximum over non-missing values (NaN and NULL ignored) and the first
    ordinal reaching it; ``n_values`` counts the whole series. Partial aggregates only."""
    g = groups or ["run", "metric"]
    v = F.when(F.isnan("value"), F.lit(None)).otherwise(F.col("value"))
    best = F.max(F.when(v.isNotNull(), F.struct(v.alias("v"), (-F.col("ordinal")).alias("o"))))
    return scores.groupBy(*g).agg(best.alias("b"), F.count(F.lit(1)).alias("n_values")) \
        .select(*g, F.col("b.v").alias("max_value"), (-F.col("b.o")).cast("long").alias("best_ordinal"), "n_values")


def report(configs: DataFrame, best: DataFrame, settings: list[str], metric: str = "bleu",
           out: str = "max_bleu") -> DataFrame:
    """Configuration columns plus the best score of its run, sorted by the settings."""
    b = best.filter(F.col("metric") == metric).select("run", F.col("max_value").alias(out))
    return configs.join(b, "run", "left").select("run", *settings, out).orderBy(*settings)


def summarise_runs(logs: DataFrame, configs: DataFrame, settings: list[str], metric: str = "bleu") -> DataFrame:
    """L2: L1 -> W4 -> A10 -> J8. A run without scores gets NULL (the reference raises)."""
    scores = with_ordinal(extract_metrics(logs, "text", keep=["run", "line_no"]))
    return report(configs, best_per_run(scores), settings, metric)
