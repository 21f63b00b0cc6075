"""Helpers shared by the operators of this package."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusprep.session import cut_lineage

#: White space that separates words in the contracts: space and tab to carriage return.
SPACE = r"[\x20\x09-\x0D]"
NOT_SPACE = r"[^\x20\x09-\x0D]"

#: Rows of one narrow table (a key and a few numbers) that may be broadcast; beyond it the
#: same join runs as a shuffle join. Likewise for its bytes.
BROADCAST_ROWS = 500_000
BROADCAST_BYTES = 64 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(col: str = "text") -> Column:
    """The text, NULL read as empty."""
    return F.coalesce(F.col(col), F.lit(""))


def fixed(df: DataFrame) -> DataFrame:
    """Write ``df`` to the reliable checkpoint folder and read it from there, so that it is
    computed once and survives lost executors."""
    return cut_lineage(df)


def _width(c: Column, kind) -> Column:
    """About the bytes of a value."""
    from pyspark.sql import types as T

    if isinstance(kind, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(c), F.lit(0)) + 16
    if isinstance(kind, T.StructType):
        return sum((_width(c[f.name], f.dataType) for f in kind.fields), F.lit(8))
    if isinstance(kind, T.ArrayType):
        if isinstance(kind.elementType, (T.StringType, T.BinaryType, T.StructType, T.ArrayType)):
            each = F.transform(c, lambda x: _width(x, kind.elementType).cast("long"))
            return F.coalesce(F.aggregate(each, F.lit(16).cast("long"), lambda n, x: n + x), F.lit(16))
        return F.greatest(F.size(c), F.lit(0)) * 8 + 16
    return F.lit(8)


def small_side(df: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``max_rows`` rows and about ``max_bytes``
    (both measured here; pass something cheap to read, such as a checkpoint), else ``df`` as it is
    for a shuffle join."""
    size = sum((_width(F.col(f"`{f.name}`"), f.dataType) for f in df.schema.fields), F.lit(8)).cast("long")
    n, total = df.limit(max_rows + 1).agg(F.count(F.lit(1)), F.coalesce(F.sum(size), F.lit(0))).first()
    return F.broadcast(df) if n <= max_rows and total <= max_bytes else df


def text_key(col: str = "text") -> Column:
    """Two 64-bit hashes as one value: the identity of a text in joins on content."""
    t = text_of(col)
    return F.struct(F.xxhash64(t).alias("a"), F.xxhash64(F.lit(1), t, F.octet_length(t)).alias("b"))


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores put before it until no column of ``df`` is called so."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def give_back() -> None:
    """Return what a finished task has freed to the system: Python workers stay alive between
    tasks, and an idle one should not hold the caches of its last task."""
    import ctypes
    import gc

    gc.collect()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc
    if trim is not None:
        trim(0)


def map_rows(df: DataFrame, fn, schema: str) -> DataFrame:
    """``fn`` gets an iterator over tuples of the rows of a partition and yields tuples of
    ``schema``; both sides travel as Arrow batches, so NULLs and wide integers stay as they are."""
    from pyspark.sql import types as T
    from pyspark.sql.pandas.types import to_arrow_schema

    kind = T.StructType.fromDDL(schema)
    arrow = to_arrow_schema(kind)

    def run(batches):
        import pyarrow as pa

        def rows():
            for b in batches:
                yield from zip(*(c.to_pylist() for c in b.columns))

        def batch(out):
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), arrow)], schema=arrow)

        out, size = [], 0
        try:
            for r in fn(rows()):
                out.append(r)
                size += 1 + sum(len(x) // 8 for x in r if isinstance(x, (str, bytes, list)))
                if size >= 100_000:
                    yield batch(out)
                    out, size = [], 0
            if out:
                yield batch(out)
        finally:
            out = r = None
            give_back()

    return df.mapInArrow(run, kind)
