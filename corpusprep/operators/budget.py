"""Budget batching: sequential greedy char-budget batches (W1) and token-budget batches inside
length buckets (W3).

W1 semantics: walk the lines in order; open a new batch when ``used + len(line) > budget``
(exactly ``budget`` fits; ``len`` counts the newline by default). A line longer than the
budget gets a batch of its own. With ``shard_cols`` every shard packs on its own (a shard
border closes a batch). If the very first line is over budget the reference emits an empty
batch 0 first; ``keep_empty=True`` reproduces that in the batch summary.

W1 plan (exact; a fixed number of jobs, whatever the number of batches):

1. the rows are range-partitioned in order and checkpointed (``laid_out``);
2. one pass turns every range partition into a function: how full the open batch is on entry ->
   how full it is on exit, and the batches opened in between. What follows a batch start inside the
   partition does not depend on the entry, so the function is a table over the first lines that an
   entry can reach: at most ``budget + 1`` rows;
3. the functions are applied one after the other (a few numbers per partition, on the driver), which
   gives every partition its entry, first batch and first position;
4. one pass numbers the rows of every partition by the plain greedy walk from its entry.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusprep.operators.order import ordered_scan
from corpusprep.session import cut_lineage, shuffle_partitions


def _lengths(df: DataFrame, text_col: str | None, len_col: str | None, newline: bool):
    if len_col:
        return F.col(len_col).cast("long")
    return (F.length(text_col) + F.lit(1 if newline else 0)).cast("long")


def scan_function(lens, cuts, budget: int):
    """The function of one partition. ``lens``: lengths of its lines; ``cuts``: positions at which a
    new shard begins (0 is never one). Returns ``(whole, opened0, exit0, fits, opened, exits)``:
    ``whole`` is the length of the partition, or None where a shard begins inside; ``opened0`` and
    ``exit0`` hold if the first line opens a batch; entry k continues the open batch
    while it has at least ``fits[k]`` characters left but fewer than ``fits[k + 1]``; then
    ``opened[k]`` batches are opened and the last one has ``exits[k]`` characters (-1: the entry's
    batch goes on beyond the partition)."""
    import numpy as np

    n = len(lens)
    total = np.concatenate([[0], np.cumsum(lens)])
    ends = np.array([*cuts, n])
    seg_end = ends[np.searchsorted(ends, np.arange(n), side="right")] if n else ends[:0]
    # the line after the batch that starts at each line
    nxt = np.minimum(np.maximum(np.searchsorted(total, total[:n] + budget, side="right") - 1, np.arange(n) + 1), seg_end).tolist()
    opened, last = [0] * (n + 1), [n] * (n + 1)
    for i in range(n - 1, -1, -1):
        j = nxt[i]
        if j < n:
            opened[i], last[i] = opened[j] + 1, last[j]
        else:
            opened[i], last[i] = 1, i
    reach = int(seg_end[0]) if n else 0
    fits, out_opened, exits = [], [], []
    for j in range(reach + 1):
        if total[j] > budget:
            break
        if fits and fits[-1] == total[j]:  # lines of no length stay with what fits
            fits.pop(), out_opened.pop(), exits.pop()
        fits.append(int(total[j]))
        out_opened.append(opened[j] if j < n else 0)
        exits.append(int(total[n] - total[last[j]]) if j < n else -1)
    return int(total[n]) if reach == n else None, opened[0], int(total[n] - total[last[0]]), fits, out_opened, exits


def laid_out(df: DataFrame, keys: list[str]) -> DataFrame:
    """``df`` range-partitioned and sorted by ``keys``, with its partition ``__pid``; fixed, since
    range bounds are sampled."""
    p = shuffle_partitions(df.sparkSession)
    return cut_lineage(df.repartitionByRange(p, *keys).sortWithinPartitions(*keys).withColumn("__pid", F.spark_partition_id()))


def budget_batches(df: DataFrame, order_cols: list[str], text_col: str | None = "text", budget: int = 5000,
                   shard_cols: list[str] | None = None, newline: bool = True, len_col: str | None = None) -> DataFrame:
    """Every input row with ``idx`` (global position), ``len`` and ``batch_id`` (global,
    0-based, in order; batches never span shards)."""
    import bisect

    from pyspark.sql import types as T

    from pyspark.sql.pandas.types import to_arrow_schema

    spark = df.sparkSession
    piece = to_arrow_schema(T.StructType.fromDDL(PIECE))
    shards = list(shard_cols or [])
    rows = laid_out(df.withColumn("len", _lengths(df, text_col, len_col, newline)), shards + list(order_cols))
    shard = F.to_json(F.struct(*shards), {"ignoreNullFields": "false"}) if shards else F.lit("")

    def describe(batches):
        import numpy as np
        import pyarrow as pa

        pid, first, last, lens, cuts = None, None, None, [], []
        for b in batches:
            pids, names, ls = (c.to_pylist() for c in b.columns)
            for p, name, n in zip(pids, names, ls):
                if pid is None:
                    pid, first = p, name
                elif name != last:
                    cuts.append(len(lens))
                last = name
                lens.append(n or 0)
        if pid is not None:
            row = (pid, len(lens), first, last, *scan_function(np.array(lens, dtype="i8"), cuts, budget))
            yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, piece)], schema=piece)

    pieces = rows.select("__pid", shard.alias("shard"), "len").mapInArrow(describe, PIECE)
    # a row per partition, each with at most budget + 1 numbers
    entry, used, batch, idx, before = {}, None, -1, 0, None
    for r in sorted(pieces.collect(), key=lambda r: r["pid"]):
        fresh = used is None or r["first"] != before
        entry[r["pid"]] = (fresh, used or 0, batch, idx)
        if fresh:
            batch, used = batch + r["opened0"], r["exit0"]
        else:
            k = bisect.bisect_right(r["fits"], budget - used) - 1
            if k < 0:  # more than full: the next line opens a batch
                batch, used = batch + r["opened0"], r["exit0"]
            elif r["exits"][k] < 0:
                used += r["whole"]
            else:
                batch, used = batch + r["opened"][k], r["exits"][k]
        idx, before = idx + r["n"], r["last"]
    sent = spark.sparkContext.broadcast(entry)

    def number(batches):
        import pyarrow as pa

        state = None
        for b in batches:
            names, ls = b.column(b.num_columns - 1).to_pylist(), b.column(b.schema.get_field_index("len")).to_pylist()
            if not names:
                continue
            if state is None:
                fresh, used, at, idx = sent.value[b.column(b.schema.get_field_index("__pid"))[0].as_py()]
                state = names[0]
            ids = []
            for name, n in zip(names, ls):
                n = n or 0
                if fresh or name != state or used + n > budget:
                    at, used, fresh, state = at + 1, 0, False, name
                used += n
                ids.append(at)
            keep = [k for k, f in enumerate(b.schema) if f.name not in ("__pid", "__shard")]
            cols = [b.column(k) for k in keep] + [pa.array(range(idx, idx + len(ids)), pa.int64()), pa.array(ids, pa.int64())]
            idx += len(ids)
            yield pa.RecordBatch.from_arrays(cols, names=[b.schema.field(k).name for k in keep] + ["idx", "batch_id"])

    schema = T.StructType([f for f in rows.schema.fields if f.name != "__pid"]
                          + [T.StructField("idx", T.LongType()), T.StructField("batch_id", T.LongType())])
    return rows.withColumn("__shard", shard).mapInArrow(number, schema)


#: A partition as a function; ``opened0``, ``exit0``: if its first line opens a batch.
PIECE = ("pid int, n long, first string, last string, whole long, opened0 long, exit0 long, fits array<long>, opened array<long>, "
         "exits array<long>")


def batch_summary(batched: DataFrame, keep_empty: bool = False, budget: int = 5000) -> DataFrame:
    """``(batch_id, char_count, n_lines)``; with ``keep_empty`` and a first line over budget,
    an empty batch 0 is emitted first and the others shift by one (reference behaviour)."""
    s = batched.groupBy("batch_id").agg(F.sum("len").cast("long").alias("char_count"),
                                        F.count(F.lit(1)).alias("n_lines"))
    if not keep_empty:
        return s
    first = batched.filter(F.col("idx") == 0).select("len").first()
    if first is None or first[0] <= budget:
        return s
    spark = batched.sparkSession
    empty = spark.createDataFrame([(0, 0, 0)], "batch_id long, char_count long, n_lines long")
    return empty.unionByName(s.withColumn("batch_id", F.col("batch_id") + 1))


# ---------------------------------------------------------------------------------------------
# Token-budget batches inside fixed-size length buckets
# ---------------------------------------------------------------------------------------------

def token_batches(df: DataFrame, order_cols: list[str], len_col: str, budget: int = 8192,
                  bucket: int = 8192) -> DataFrame:
    """Examples are cut into buckets of ``bucket`` consecutive examples (by a dense
    position), sorted by length inside the bucket, and packed greedily so that
    ``max_len * n_examples <= budget`` (padded size; an example over budget gets its own batch).
    A bucket has exactly ``bucket`` rows, so ``applyInPandas`` per bucket is bounded; buckets
    run in parallel; only positions and lengths go through pandas. Result: input rows plus
    ``bucket_id``, ``batch_no`` (inside the bucket)."""
    idx = ordered_scan(df, order_cols, index="__pos").withColumn("bucket_id", F.floor(F.col("__pos") / bucket).cast("long"))

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["n", "at"], kind="stable").reset_index(drop=True)
        out, b, cnt, mx = [], 0, 0, 0
        for v in pdf["n"].tolist():
            new_mx = max(mx, v)
            if cnt and new_mx * (cnt + 1) > budget:
                b += 1
                cnt, mx = 1, v
            else:
                cnt, mx = cnt + 1, new_mx
            out.append(b)
        pdf["batch_no"] = pd.Series(out, dtype="int64")
        return pdf[["at", "batch_no"]]

    packed = idx.select("bucket_id", F.col("__pos").alias("at"), F.col(len_col).cast("double").alias("n")) \
        .groupBy("bucket_id").applyInPandas(pack, "at long, batch_no long")
    return idx.join(packed, F.col("__pos") == F.col("at")).drop("__pos", "at")
