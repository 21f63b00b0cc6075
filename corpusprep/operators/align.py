"""Alignment operators: key alignment with a reject report, positional zip, resume filter.

All joins are equi-joins; Catalyst/AQE chooses broadcast or sort-merge at runtime from the
measured sizes, and AQE's skew-join split covers hot keys on the large side.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusprep.functions.text import lowercase as _lower


def last_per_key(df: DataFrame, key: str | list[str], order: str, value: str | list[str]) -> DataFrame:
    """The value(s) of the row with the greatest ``order`` per key (last line wins).

    ``max(struct(order, value))`` is a partial aggregate, so a hot key is combined map-side
    before the shuffle instead of landing whole in one task.
    """
    keys = [key] if isinstance(key, str) else list(key)
    vals = [value] if isinstance(value, str) else list(value)
    best = F.max(F.struct(F.col(order).alias("__o"), *[F.col(v) for v in vals])).alias("__b")
    return df.groupBy(*keys).agg(best).select(*keys, *[F.col(f"__b.{v}").alias(v) for v in vals])


def align_by_key(src: DataFrame, tgt: DataFrame, lowercase: bool = False) -> DataFrame:
    """Inner alignment of two keyed line tables ``(line_no, key, text)``.

    Target duplicates: the last line wins; source duplicates are all kept. A pair is dropped
    when the source text is empty, its key is absent from the target, or the target text is
    empty. Result ``(pair_id, key, src, tgt)`` with ``pair_id`` = source ``line_no`` (the order).
    """
    t = last_per_key(tgt, "key", "line_no", "text").withColumnRenamed("text", "tgt")
    s = src.select(F.col("line_no").alias("pair_id"), "key", F.col("text").alias("src"))
    out = s.filter(F.col("src") != "").join(t.filter(F.col("tgt") != ""), "key", "inner")
    if lowercase:
        out = out.select("pair_id", "key", _lower("src").alias("src"), _lower("tgt").alias("tgt"))
    return out.select("pair_id", "key", "src", "tgt")


def alignment_rejects(src: DataFrame, tgt: DataFrame) -> DataFrame:
    """Source rows dropped by J1 with the reason, in the reference's test order:
    ``src_empty`` -> ``not_in_target`` -> ``tgt_empty``. A source row that already carries a
    ``reason`` (a line that the keyed source rejected) keeps it."""
    t = last_per_key(tgt, "key", "line_no", "text").withColumnRenamed("text", "tgt")
    t = t.withColumn("__found", F.lit(True))
    before = F.col("reason") if "reason" in src.columns else F.lit(None).cast("string")
    s = src.select("line_no", "key", F.col("text").alias("src"), before.alias("__before"))
    j = s.join(t, "key", "left")
    reason = (F.when(F.col("__before").isNotNull(), F.col("__before"))
              .when(F.col("src") == "", "src_empty")
              .when(F.col("__found").isNull(), "not_in_target")
              .when(F.col("tgt") == "", "tgt_empty"))
    return j.select("line_no", "key", reason.alias("reason")).filter(F.col("reason").isNotNull())


class UnalignedLinesError(ValueError):
    pass


def zip_lines(a: DataFrame, b: DataFrame, on: list[str] | str = "line_no", strict: bool = True,
              a_name: str = "a", b_name: str = "b") -> DataFrame:
    """Positional zip of two line tables ``(*on, text)`` by their position columns.

    A one-sided row gets ``status`` ``a_only`` / ``b_only``; with ``strict`` the first such
    row raises (checked with one ``isEmpty`` action, not a collect).
    """
    keys = [on] if isinstance(on, str) else list(on)
    j = a.select(*keys, F.col("text").alias(a_name), F.lit(True).alias("__a")).join(
        b.select(*keys, F.col("text").alias(b_name), F.lit(True).alias("__b")), keys, "full_outer")
    status = (F.when(F.col("__a").isNull(), "b_only").when(F.col("__b").isNull(), "a_only")
              .otherwise("ok"))
    out = j.select(*keys, a_name, b_name, status.alias("status"))
    if strict and not out.filter(F.col("status") != "ok").isEmpty():
        raise UnalignedLinesError("line tables differ in length / positions")
    return out


def pending_batches(batches: DataFrame, done: DataFrame, key: str = "batch_id") -> DataFrame:
    """Batches without a stored, non-empty output (a stored empty list counts as not done)."""
    finished = done.filter(F.col("outputs").isNotNull() & (F.size("outputs") > 0)).select(key)
    return batches.join(finished, key, "left_anti")
