"""Batching: fixed-size batches (W2), batch flattening (W7); char-budget (W1) and
token-budget (W3) batches live in ``budget``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fixed_batches(df: DataFrame, index_col: str, n: int = 5, name: str = "batch_no") -> DataFrame:
    """Batch number ``floor(index / n)`` from a dense 0-based position (S1), no window."""
    return df.withColumn(name, F.floor(F.col(index_col) / F.lit(n)).cast("long"))


def collect_batches(df: DataFrame, batch_cols: list[str], index_col: str, text_col: str = "text") -> DataFrame:
    """Texts of each batch in position order as an array (batches are bounded by construction:
    ``n`` lines for W2, the char budget for W1)."""
    items = F.sort_array(F.collect_list(F.struct(F.col(index_col).alias("i"), F.col(text_col).alias("t"))))
    return df.groupBy(*batch_cols).agg(F.transform(items, lambda x: x["t"]).alias("texts"),
                                       F.count(F.lit(1)).alias("n_lines"))


def flatten_batches(df: DataFrame, key_cols: list[str] | str, list_col: str = "outputs") -> DataFrame:
    """One row per element ``(keys..., pos, line)``; order is (keys, pos)."""
    keys = [key_cols] if isinstance(key_cols, str) else list(key_cols)
    return df.select(*keys, F.posexplode(list_col).alias("pos", "line")) \
        .select(*keys, F.col("pos").cast("long").alias("pos"), "line")
