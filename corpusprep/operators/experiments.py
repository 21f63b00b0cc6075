"""Experiment-plan operators.

A configuration grid is a product of a few short value lists, so its size is fixed by the
caller, not by the data. It is generated from ``spark.range`` with mixed-radix arithmetic (no
cross join), and every pick is a deterministic hash, so plans are reproducible and stable
under repartitioning (``DataFrame.sample`` is not).
"""

from __future__ import annotations

import itertools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusprep.operators.order import ordered_scan

# Settings whose value is taken from another setting whatever their own value
# (the ``-1`` placeholder of the reference's grid).
DEFAULT_LINKS = {
    "DATASET_NAME_VALID": "DATASET_NAME_TRAIN",
    "WORD_VEC_SIZE": "HIDDEN_SIZE",
    "DEC_LAYERS": "ENC_LAYERS",
}
# The per-run output directory placeholder, substituted before the settings.
OUTPUT_KEY = "OUTPUT_PATH_PER_RUN"
_P53 = 2 ** 53


def _lit_type(values: Sequence) -> str:
    kinds = {type(v) for v in values}
    if kinds <= {int}:
        return "bigint"
    if kinds <= {int, float}:
        return "double"
    return "string"


def _value_col(values: Sequence, idx: Column) -> Column:
    t = _lit_type(values)
    arr = F.array(*[F.lit(v if t != "string" else str(v)).cast(t) for v in values])
    return F.element_at(arr, (idx + 1).cast("int"))


def config_grid(spark: SparkSession, settings: dict[str, list]) -> DataFrame:
    """Every combination, first setting slowest (``itertools.product`` order);
    ``config_id`` is the mixed-radix index of the combination."""
    names = list(settings)
    sizes = [len(settings[n]) for n in names]
    total = 1
    for s in sizes:
        total *= s
    cols = []
    stride = total
    for n, s in zip(names, sizes):
        stride //= s
        idx = F.floor(F.col("id") / F.lit(stride)) % F.lit(s)
        cols.append(_value_col(settings[n], idx).alias(n))
    return spark.range(total).select(F.col("id").alias("config_id"), *cols)


def freeze(df: DataFrame, frozen: dict) -> DataFrame:
    """Keep configurations equal to every frozen setting present; unknown names are
    ignored; a collection as value is an error (a string is allowed)."""
    cond = None
    for k, v in frozen.items():
        if isinstance(v, (list, tuple, set, dict)):
            raise ValueError(f"setting {k!r} is frozen to {type(v).__name__}: give one value")
        if k not in df.columns:
            continue
        c = F.col(k) == F.lit(v)
        cond = c if cond is None else cond & c
    return df if cond is None else df.filter(cond)


def _u01(id_col: str, seed: int) -> Column:
    return F.pmod(F.xxhash64(F.col(id_col), F.lit(seed)), F.lit(_P53)) / F.lit(float(_P53))


def sample_configs(df: DataFrame, perc: float, seed: int = 0, id_col: str = "config_id") -> DataFrame:
    """Bernoulli sample: keep when a hash-uniform of (id, seed) is below ``perc``;
    ``perc = 1`` keeps all, ``0`` none."""
    return df.filter(_u01(id_col, seed) < F.lit(float(perc)))


def must_include(grid: DataFrame, must: dict[str, list], frozen: dict | None = None, seed: int = 0,
                 respect_frozen: bool = False, id_col: str = "config_id") -> DataFrame:
    """For every combination of required values, one matching configuration picked by
    the smallest hash of (id, seed); combinations without a match add nothing. The reference
    picks from the whole grid (frozen settings may be violated); ``respect_frozen`` restricts
    the pick to the frozen grid."""
    frozen = frozen or {}
    for k, v in must.items():
        if not isinstance(v, list):
            raise ValueError(f"setting {k!r}: give the required values as a list, not as {type(v).__name__}")
    for k, v in frozen.items():
        if k in must and v not in must[k]:
            raise ValueError(f"setting {k!r} is frozen to {v!r}, which is not among its required values")
    if not must:
        return grid.limit(0)
    spark = grid.sparkSession
    combos = config_grid(spark, must).withColumnRenamed("config_id", "__combo")
    pool = freeze(grid, frozen) if respect_frozen else grid
    keys = list(must)
    j = pool.join(combos, keys, "inner")
    pick = j.groupBy("__combo").agg(F.min_by(F.col(id_col), F.xxhash64(F.col(id_col), F.lit(seed))).alias("__pick"))
    return grid.join(pick.select(F.col("__pick").alias(id_col)), id_col, "left_semi")


def dedupe_configs(df: DataFrame, settings: list[str]) -> DataFrame:
    """One row per distinct configuration, sorted by the settings (empty stays empty)."""
    return df.dropDuplicates(settings).orderBy(*settings)


def plan_experiments(spark: SparkSession, settings: dict[str, list], perc: float = 1.0, frozen: dict | None = None,
                     must: dict[str, list] | None = None, seed: int = 0, respect_frozen: bool = False) -> DataFrame:
    """U4: grid -> freeze -> sample -> union must-include picks -> de-duplicate. ``run`` is
    ``output_{i}`` with ``i`` the 0-based position in the settings-sorted result."""
    names = list(settings)
    grid = config_grid(spark, settings)
    base = sample_configs(freeze(grid, frozen or {}), perc, seed)
    if must:
        base = base.unionByName(must_include(grid, must, frozen, seed, respect_frozen))
    uniq = base.dropDuplicates(names)
    ranked = ordered_scan(uniq, names, index="__pos", partitions=1)
    return ranked.select(F.concat(F.lit("output_"), F.col("__pos").cast("string")).alias("run"), "config_id", *names)


def resolve_links(df: DataFrame, links: dict[str, str] | None = None) -> DataFrame:
    """A linked setting takes the value of its source setting (``-1`` placeholders)."""
    out = df
    for dst, src in (DEFAULT_LINKS if links is None else links).items():
        if dst in out.columns and src in out.columns:
            out = out.withColumn(dst, F.col(src).cast(out.schema[dst].dataType)
                                 if out.schema[dst].dataType == out.schema[src].dataType else F.col(src))
    return out


def _py_str(v) -> str:
    return str(v)


def _quote_repl(s: str) -> str:
    return s.replace("\\", "\\\\").replace("$", "\\$")


def render_template(df: DataFrame, template: str, settings: dict[str, list], links: dict[str, str] | None = None,
                    run_col: str = "run") -> DataFrame:
    """One rendered text per configuration: whole-word ``\\bKEY\\b`` substitution, the run
    directory first, then the settings in order (a linked setting takes its source's value).
    Values are rendered as Python ``str`` would (the lookup table is built on the driver from
    the few grid values), so ``1e-05`` stays ``1e-05``."""
    links = DEFAULT_LINKS if links is None else links
    text = F.regexp_replace(F.lit(template), r"\b" + OUTPUT_KEY + r"\b", F.col(run_col))
    for key in settings:
        src = links.get(key, key)
        if src not in settings:
            src = key
        vals = settings[src]
        t = _lit_type(vals)
        rendered = F.lit(None).cast("string")
        for v in vals:
            lv = F.lit(v if t != "string" else str(v)).cast(t)
            rendered = F.when(F.col(src) == lv, F.lit(_quote_repl(_py_str(v)))).otherwise(rendered)
        text = F.regexp_replace(text, r"\b" + key + r"\b", rendered)
    return df.select(run_col, "config_id", text.alias("config_text"))


def grid_rows(settings: dict[str, list]) -> list[dict]:
    """The grid as Python dicts in product order (small by construction; for tests)."""
    names = list(settings)
    return [dict(zip(names, vals)) for vals in itertools.product(*settings.values())]
