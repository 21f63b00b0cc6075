"""Hilbert-curve sharding.

Metadata dimensions are quantised to ``BITS`` bits each, rows are sorted by their index on the
Hilbert curve through that grid, and the sorted rows are cut into runs of equal row count (at most
one apart). Rows of a shard are neighbours in all dimensions at once, so a filter on any of them
needs few shards: ``shard_ranges`` gives each shard's ranges and ``prune`` the shards that a filter
can match.

Numbers are quantised at their quantiles (2**BITS - 1 cut points, whatever the size of the data),
other values by hash (equal values share a cell). The order is made by range partitioning on the
curve index, then a text checksum and the id, so a hot value spreads over partitions; positions
come from the number inside a partition plus the counts of the partitions before (one row per
partition). Only narrow columns are shuffled, never texts.

Edge cases: a NULL dimension is the lowest cell; a NULL text has size 1 and checksum 0; NULL ids
sort first; repeated rows get a place each; with fewer rows than shards some shards are empty; an
empty table gives no row. Extra columns are ignored unless named as dimensions.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusprep.llm.common import fixed, text_of

BITS = 8
DIMENSIONS = ("lang", "source", "n_chars")


def hilbert_index(cells: np.ndarray, bits: int) -> np.ndarray:
    """Index on the Hilbert curve of each row of ``cells`` (rows x dimensions). By Skilling's
    transform: undo the rotations from the top bit down, Gray-encode, interleave the bits."""
    x = cells.astype(np.int64).T.copy()
    dims = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        low = q - 1
        for i in range(dims):
            high = (x[i] & q) > 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(high, low, swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    flip = np.zeros(x.shape[1], np.int64)
    q = 1 << (bits - 1)
    while q > 1:
        flip ^= np.where((x[-1] & q) > 0, q - 1, 0)
        q >>= 1
    x ^= flip
    out = np.zeros(x.shape[1], np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            out = (out << 1) | ((x[i] >> b) & 1)
    return out


def _below(value: Column, cuts: list) -> Column:
    """How many of the ascending ``cuts`` are at most ``value``."""
    if not cuts:
        return F.lit(0)
    return F.size(F.filter(F.array(*[F.lit(v) for v in cuts]), lambda cut: cut <= value))


def _cells(df: DataFrame, dimensions: list[str], bits: int) -> list[Column]:
    """The cell of each dimension, 0 for NULL."""
    top = (1 << bits) - 1
    numbers = [c for c in dimensions if isinstance(df.schema[c].dataType, T.NumericType)]
    cuts = {}
    if numbers:
        at = [(k + 1) / (top + 1) for k in range(top)]
        row = df.agg(*[F.percentile_approx(c, at, 1000).alias(f"q{i}") for i, c in enumerate(numbers)]).first()
        cuts = {c: sorted(set(row[i] or [])) for i, c in enumerate(numbers)}
    out = []
    for c in dimensions:
        if c in cuts:
            cell = _below(F.col(c), cuts[c])
        else:
            cell = F.pmod(F.xxhash64(F.col(c).cast("string")), F.lit(top + 1))
        out.append(F.when(F.col(c).isNull(), 0).otherwise(F.least(cell, F.lit(top))).cast("int"))
    return out


def hilbert_shards(docs: DataFrame, shards: int = 16, dimensions: tuple[str, ...] = DIMENSIONS,
                   doc_id: str = "doc_id", text: str = "text", bits: int = BITS) -> DataFrame:
    """One row per document: ``doc_id``, ``size`` (UTF-8 bytes and 1), ``text_crc32``, the
    dimensions as ``dim_<name>``, ``curve``, ``shard`` and ``slot`` in it."""
    dims = list(dimensions)
    if bits * len(dims) > 62:
        raise ValueError("bits times dimensions must be 62 at most")

    @F.pandas_udf("long")
    def curve(cells):
        import pandas as pd

        return pd.Series(hilbert_index(np.stack(cells.to_numpy()), bits) if len(cells) else np.zeros(0, np.int64))

    cells = _cells(docs, dims, bits)
    narrow = docs.select(F.col(doc_id).alias("doc_id"), (F.octet_length(text_of(text)) + 1).cast("long").alias("size"),
                         F.crc32(text_of(text)).alias("text_crc32"), *[F.col(c).alias(f"dim_{c}") for c in dims],
                         F.array(*cells).alias("cells"))
    narrow = narrow.withColumn("curve", curve("cells")).drop("cells")
    order = ["curve", "text_crc32", "doc_id", "size"]
    # the id counts rows inside a partition in its lower 33 bits; written once, so places are fixed
    placed = fixed(narrow.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()))
    part, inside = F.shiftright("at", 33), F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    counts = {r["p"]: r["n"] for r in placed.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()}  # a row for each partition
    before, total = {}, 0
    for p in sorted(counts):
        before[p] = total
        total += counts[p]
    starts = docs.sparkSession.createDataFrame([(p, n) for p, n in before.items()], "p long, before long")
    rank = F.col("before") + inside
    small, large = divmod(total, shards)  # the first `large` shards have a row more
    edge = large * (small + 1)
    shard = F.when(rank < edge, F.floor(rank / (small + 1))).otherwise(large + F.floor((rank - edge) / max(small, 1)))
    first = F.when(F.col("shard") <= large, F.col("shard") * (small + 1)).otherwise(edge + (F.col("shard") - large) * small)
    return placed.join(F.broadcast(starts), part == F.col("p")).withColumn("rank", rank) \
        .withColumn("shard", shard.cast("int")).withColumn("slot", (F.col("rank") - first).cast("long")) \
        .drop("at", "p", "before", "rank")


def shard_ranges(sharded: DataFrame) -> DataFrame:
    """Rows, bytes and the range of every dimension, by shard."""
    dims = [c for c in sharded.columns if c.startswith("dim_")]
    return sharded.groupBy("shard").agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum("size").alias("bytes"),
        *[f(c).alias(f"{name}_{c[4:]}") for c in dims for name, f in (("min", F.min), ("max", F.max))])


def prune(ranges: DataFrame, dimension: str, low, high) -> DataFrame:
    """The shards that can hold a value of ``dimension`` between ``low`` and ``high``."""
    return ranges.where((F.col(f"max_{dimension}") >= F.lit(low)) & (F.col(f"min_{dimension}") <= F.lit(high)))
