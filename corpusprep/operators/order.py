"""Global positions and prefix sums without a single-partition window.

Order is data in this library (line order is the join key of everything downstream), but a
``Window.orderBy`` without ``partitionBy`` moves every row into one task. ``ordered_scan``
instead range-partitions the rows on the order, numbers them inside each range partition, and
adds per-partition offsets taken from a table with at most one row per (partition, group):

1. ``repartitionByRange(P, groups..., order...)`` and checkpoint, so the partition of every row
   is fixed (range bounds come from a sample and could move on recomputation);
2. a window partitioned by (partition id, groups) gives local positions / running sums;
3. ``groupBy(partition id, groups)`` gives per-partition totals; a window over that small
   table (≤ P rows per group) turns them into offsets, joined back on (partition id, groups).

A hot group (a third of all rows) is spread over many range partitions, so no task holds more
than about 1/P of the data.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusprep.session import cut_lineage, shuffle_partitions


def ordered_scan(df: DataFrame, order: list, groups: list[str] | None = None,
                 sums: dict[str, str] | None = None, index: str = "idx",
                 partitions: int | None = None) -> DataFrame:
    """Add ``index`` (0-based position in ``order`` within ``groups``) and, for each
    ``out: col`` in ``sums``, the exclusive prefix sum of ``col`` in that order.

    ``order`` entries are column names or sort Columns (``F.col('x').desc()``); they should be
    unique within a group, otherwise positions among ties are arbitrary.
    """
    groups = list(groups or [])
    sums = dict(sums or {})
    spark = df.sparkSession
    p = partitions or shuffle_partitions(spark)
    sort_cols = [F.col(c) if isinstance(c, str) else c for c in order]
    ranged = df.repartitionByRange(p, *[F.col(g) for g in groups], *sort_cols) \
        .withColumn("__pid", F.spark_partition_id())
    ranged = cut_lineage(ranged)

    w = Window.partitionBy("__pid", *groups).orderBy(*sort_cols)
    wrun = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = ranged.withColumn("__i", F.row_number().over(w) - 1)
    for out, col in sums.items():
        local = local.withColumn(f"__s_{out}", F.sum(col).over(wrun) - F.col(col))

    aggs = [F.count(F.lit(1)).alias("__n")] + [F.sum(col).alias(f"__t_{out}") for out, col in sums.items()]
    totals = ranged.groupBy("__pid", *groups).agg(*aggs)
    # at most P rows per group here, so an unpartitioned window is bounded by the partition count
    wo = (Window.partitionBy(*groups) if groups else Window).orderBy("__pid") \
        .rowsBetween(Window.unboundedPreceding, -1)
    offs = totals.select(F.col("__pid").alias("__p"), *[F.col(c).alias(f"__g{i}") for i, c in enumerate(groups)],
                         F.coalesce(F.sum("__n").over(wo), F.lit(0)).alias("__on"),
                         *[F.coalesce(F.sum(f"__t_{out}").over(wo), F.lit(0)).alias(f"__o_{out}")
                           for out in sums])
    same = F.col("__pid") == F.col("__p")
    for i, c in enumerate(groups):
        same &= local[c].eqNullSafe(F.col(f"__g{i}"))  # NULL is a group of its own
    res = local.join(offs, same, "inner")
    res = res.withColumn(index, (F.col("__on") + F.col("__i")).cast("long"))
    for out in sums:
        res = res.withColumn(out, (F.col(f"__o_{out}") + F.col(f"__s_{out}")).cast("long"))
    drop = ["__pid", "__p", "__i", "__on"] + [f"__g{i}" for i in range(len(groups))] + [f"__s_{o}" for o in sums] + [f"__o_{o}" for o in sums]
    return res.drop(*drop)


def forward_fill(df: DataFrame, order: list[str], value: str, out: str, partitions: int | None = None) -> DataFrame:
    """``out`` = the last non-NULL ``value`` at or before each row in ``order`` (an as-of
    lookup), computed per range partition and completed with a carry from the preceding
    partitions (a table of at most one row per partition)."""
    spark = df.sparkSession
    p = partitions or shuffle_partitions(spark)
    cols = [F.col(c) for c in order]
    ranged = cut_lineage(df.repartitionByRange(p, *cols).withColumn("__pid", F.spark_partition_id()))
    w = Window.partitionBy("__pid").orderBy(*cols).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = ranged.withColumn("__f", F.last(value, ignorenulls=True).over(w))
    key = F.struct(*cols)
    tail = ranged.filter(F.col(value).isNotNull()).groupBy("__pid") \
        .agg(F.max_by(F.col(value), key).alias("__t"))
    # P rows at most: an unpartitioned window over them is bounded by the partition count
    wc = Window.orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)
    pids = ranged.select("__pid").distinct()
    carry = pids.join(tail, "__pid", "left").withColumn("__c", F.last("__t", ignorenulls=True).over(wc)) \
        .select("__pid", "__c")
    res = local.join(carry, "__pid", "left")
    return res.withColumn(out, F.coalesce(F.col("__f"), F.col("__c"))).drop("__pid", "__f", "__c")
