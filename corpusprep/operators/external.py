"""Batched calls to a caller-supplied function (X1-X4) and the numbered-prompt text ops.

The remote translator / chat model of the reference is not part of the library: the caller
passes a plain Python function. Calls run in ``mapInPandas`` tasks; the number of partitions
bounds the number of concurrent callers. The function must be idempotent per batch (a task may
be retried or speculated); results are stored per ``batch_id`` so a rerun only calls what is
missing. What a task had noted before it was lost is called again by its retry, not by a rerun.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusprep.functions.text import WS_CLASS
from corpusprep.operators.align import last_per_key, pending_batches
from corpusprep.session import make_dirs, path_exists, qualified, remove_path

# Line boundaries of Python's str.splitlines, as a regex (Java and RE2).
LINE_BREAKS = r"\r\n|[\n\r\x{0B}\x{0C}\x{1C}-\x{1E}\x{85}\x{2028}\x{2029}]"
_WS = WS_CLASS

RESULT_SCHEMA = T.StructType([
    T.StructField("batch_id", T.LongType()),
    T.StructField("outputs", T.ArrayType(T.StringType())),
    T.StructField("status", T.StringType()),
    T.StructField("error", T.StringType()),
])


def build_prompt(df: DataFrame, text_col: str, index_col: str, batch_cols: list[str],
                 header: str, first: int = 1) -> DataFrame:
    """Per batch, ``header`` then ``"{n}. {line}"`` items, all joined by a blank line.
    ``n`` is the 0-based ``index_col`` plus ``first`` (the reference numbers from ``first=2``).
    Batches hold a fixed, small number of lines, so the ordered list per batch is bounded."""
    items = F.sort_array(F.collect_list(F.struct(F.col(index_col).alias("i"), F.col(text_col).alias("t"))))
    numbered = F.transform(items, lambda x: F.concat((x["i"] + F.lit(first)).cast("string"), F.lit(". "), x["t"]))
    return df.groupBy(*batch_cols).agg(
        F.concat(F.lit(header + "\n\n"), F.array_join(numbered, "\n\n")).alias("prompt"),
        F.count(F.lit(1)).alias("n_lines"))


def _numbered_lines(col) -> F.Column:
    """T7 on a column: the non-blank lines of a response without their leading ``N.``."""
    c = F.regexp_replace(F.regexp_replace(col, r"\A" + _WS + "+", ""), _WS + r"+\z", "")
    kept = F.filter(F.split(c, LINE_BREAKS, -1), lambda x: F.regexp_replace(x, _WS, "") != "")
    return F.transform(kept, lambda x: F.regexp_replace(x, r"^\p{Nd}+\." + _WS + "*", ""))


def clean_numbered(df: DataFrame, col: str) -> DataFrame:
    """A numbered response -> one row per non-blank line, leading ``N.`` and the
    whitespace after it removed; ``pos`` is the position among the kept lines."""
    keep = [x for x in df.columns if x != col]
    return df.select(*keep, F.posexplode(_numbered_lines(F.col(col))).alias("pos", "line")) \
        .select(*keep, F.col("pos").cast("long").alias("pos"), "line")


def map_batches(df: DataFrame, fn: Callable[[list[str]], list[str]], batch_col: str = "batch_id",
                texts_col: str = "texts", partitions: int | None = None) -> DataFrame:
    """Call ``fn(texts) -> outputs`` once per batch row. A wrong output count or an
    exception becomes a row with ``status`` (``length_mismatch`` / ``error``), never an abort
    and never a lost batch (the reference drops every batch after a failure)."""
    src = df.select(F.col(batch_col).cast("long").alias("batch_id"), F.col(texts_col).alias("texts"))
    if partitions:
        src = src.repartition(partitions, "batch_id")
    return _map_rows(src, lambda _, texts: _outcome(fn, texts))


def _map_rows(src: DataFrame, call, partitions: int | None = None) -> DataFrame:
    """``call(batch_id, texts)`` -> (outputs, status, error) for every row of ``src``."""
    if partitions:
        src = src.repartition(partitions, "batch_id")

    def run(it):
        for pdf in it:
            got = [call(int(i), texts) for i, texts in zip(pdf["batch_id"], pdf["texts"])]
            outs, status, errs = zip(*got) if got else ((), (), ())
            yield pd.DataFrame({"batch_id": pdf["batch_id"], "outputs": list(outs), "status": list(status), "error": list(errs)})

    return src.mapInPandas(run, RESULT_SCHEMA)


PROGRESS = "_progress"
_PROGRESS_SCHEMA = "batch_id long, outputs array<string>, status string, error string, attempt long"


def _noting(fn: Callable[[list[str]], list[str]], folder: str, attempt: int):
    """``fn`` over rows ``(batch_id, texts)``, each result written to a file of its own below
    ``folder`` as soon as it is there: under another name first, so that no half-written file counts."""

    def call(batch_id: int, texts: list[str]):
        import json
        from uuid import uuid4

        from pyarrow import fs

        outputs, status, error = _outcome(fn, texts)
        files, root = fs.FileSystem.from_uri(folder)
        name = f"{batch_id}-{attempt}-{uuid4().hex}.json"
        with files.open_output_stream(f"{root}/.{name}", compression=None) as f:
            f.write((json.dumps({"batch_id": batch_id, "outputs": outputs, "status": status, "error": error, "attempt": attempt}) + "\n").encode())
        files.move(f"{root}/.{name}", f"{root}/{name}")
        return outputs, status, error
    return call


def _outcome(fn, texts) -> tuple:
    """(outputs, status, error) of one call."""
    texts = [] if texts is None else list(texts)
    try:
        res = fn(texts)
        res = None if res is None else [None if r is None else str(r) for r in res]
    except Exception as e:  # noqa: BLE001 - failures are data here
        return None, "error", f"{type(e).__name__}: {e}"
    if res is None or len(res) != len(texts):
        return res, "length_mismatch", f"{len(texts)} in, {0 if res is None else len(res)} out"
    return res, "ok", None


def run_resumable(batches: DataFrame, store_path: str, fn: Callable[[list[str]], list[str]],
                  batch_col: str = "batch_id", texts_col: str = "texts",
                  partitions: int | None = None, waves: int = 1, commit: str = "batch") -> DataFrame:
    """J4 against the store -> X1 on the pending batches -> append to the store (Parquet,
    one row per attempt). Returns the current store view: per batch the last attempt wins.
    Rerunning is idempotent: finished batches are never called again.

    With ``commit="batch"`` a task notes every result in ``store_path/_progress`` as soon as its
    call returns, so a run that dies loses only the calls that were under way; the next run takes the
    notes into the store first. This needs a store that ``pyarrow.fs`` can address (``file``, ``s3``,
    ``gs``, ``hdfs``). ``commit="wave"`` works with any store of Spark's: the pending batches go in
    ``waves`` (by a hash of the batch id), each committed before the next begins, and a run that dies
    loses the calls of one wave."""
    if commit not in ("batch", "wave"):
        raise ValueError(f"commit is 'batch' or 'wave', not {commit!r}")
    spark = batches.sparkSession
    b = batches.select(F.col(batch_col).cast("long").alias("batch_id"), F.col(texts_col).alias("texts"))
    notes = f"{qualified(spark, store_path)}/{PROGRESS}"
    if commit == "batch":
        _take_in(spark, store_path, notes)
    attempt = 1
    if path_exists(spark, store_path):
        attempt = (spark.read.parquet(store_path).agg(F.max("attempt")).first()[0] or 0) + 1
    for wave in range(waves):
        todo = b if waves == 1 else b.filter(F.pmod(F.xxhash64("batch_id"), F.lit(waves)) == wave)
        if path_exists(spark, store_path):
            done = last_per_key(spark.read.parquet(store_path), "batch_id", "attempt", ["outputs", "status"])
            todo = pending_batches(todo, done.filter(F.col("status") == "ok"))
        if commit == "batch":
            make_dirs(spark, notes)
            res = _map_rows(todo, _noting(fn, notes, attempt), partitions)
        else:
            res = map_batches(todo, fn, "batch_id", "texts", partitions)
        res.withColumn("attempt", F.lit(attempt).cast("long")).write.mode("append").parquet(store_path)
        if commit == "batch":
            remove_path(spark, notes)
    return last_per_key(spark.read.parquet(store_path), "batch_id", "attempt", ["outputs", "status", "error"])


def _take_in(spark, store_path: str, notes: str) -> None:
    """Append the notes of a run that died to the store, each batch once, and delete them."""
    if not path_exists(spark, notes):
        return
    left = spark.read.schema(_PROGRESS_SCHEMA).json(notes)
    # an attempt retried by Spark may have noted a batch twice
    once = left.groupBy("batch_id", "attempt").agg(F.max(F.struct((F.col("status") == "ok").alias("good"), "outputs", "status", "error")).alias("r"))
    once = once.select("batch_id", "r.outputs", "r.status", "r.error", "attempt")
    once.write.mode("append").parquet(store_path)
    remove_path(spark, notes)


def to_pairs(lines: DataFrame, outputs: DataFrame, key_cols: list[str], pos_col: str = "pos") -> DataFrame:
    """Synthetic pairs: batch outputs zipped with the original lines on (batch key, position
    in batch). Lines: ``(*key_cols, pos, text)``; outputs: one row per batch ``(*key_cols, outputs,
    status)``. Result ``(*key_cols, pos, src, tgt, status)`` with a row for every line: ``src`` is
    the output, NULL where its batch failed (the batch's status), was not run (``no_batch``) or
    came back too short (``no_output``)."""
    o = outputs.select(*key_cols, F.col("outputs").alias("__o"), F.col("status").alias("__s"))
    j = lines.select(*key_cols, pos_col, F.col("text").alias("tgt")).join(o, key_cols, "left")
    src = F.when(F.col("__s") == "ok", F.get("__o", F.col(pos_col).cast("int")))
    status = F.when(F.col("__s").isNull(), "no_batch").when((F.col("__s") == "ok") & src.isNull(), "no_output").otherwise(F.col("__s"))
    return j.select(*key_cols, pos_col, src.alias("src"), "tgt", status.alias("status"))


def rewrite_lines(df: DataFrame, fn: Callable[[str], str], text_col: str, index_col: str,
                  batch_cols: list[str], header: str, first: int = 1,
                  partitions: int | None = None) -> DataFrame:
    """W2 batches (given as ``batch_cols``) -> T8 prompt -> ``fn(prompt) -> response`` via
    X1 -> T7 cleanup. Every output line carries ``n_in`` / ``n_out`` and the ``status`` of its batch,
    and ``shifted`` when the counts differ. A batch that failed or came back empty is one row
    with NULL ``pos`` and ``line`` and ``n_out`` 0; ``fn`` is called once for each batch."""
    from corpusprep.operators.order import ordered_scan
    prompts = build_prompt(df, text_col, index_col, batch_cols, header, first)
    # an exact dense batch id (a 64-bit hash of the keys could collide at billions of batches)
    keyed = ordered_scan(prompts, list(batch_cols), index="batch_id")

    def call(texts: list[str]) -> list[str]:
        return [fn(t) for t in texts]

    res = map_batches(keyed.select("batch_id", F.array("prompt").alias("texts")), call, partitions=partitions)
    res = res.select("batch_id", _numbered_lines(F.get("outputs", F.lit(0))).alias("__l"), "status")
    joined = keyed.select(*batch_cols, "batch_id", F.col("n_lines").alias("n_in")).join(res, "batch_id")
    n_out = F.coalesce(F.size("__l"), F.lit(0)).cast("long")
    return joined.select(*batch_cols, "n_in", n_out.alias("n_out"), "status", F.posexplode_outer("__l").alias("pos", "line")) \
        .select(*batch_cols, "n_in", "status", F.col("pos").cast("long").alias("pos"), "line", "n_out", (F.col("n_in") != F.col("n_out")).alias("shifted"))
