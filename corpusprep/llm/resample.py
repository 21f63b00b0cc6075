"""Importance resampling towards a target distribution by hashed word n-grams.

Every text is brought to words separated by single spaces, and one overlapped regular expression
scan emits, for each word, the spans of the runs that start there (``regex`` module, lookarounds
at the word bounds, ``overlapped=True``). The CRC-32 of a span's bytes is its feature; a feature
falls into one of ``buckets``. The scan runs once: it writes each document's buckets, two bytes a
feature, and each task's own bucket counts, so counting the corpus shuffles numbers only. The
gains of the buckets (a table of ``buckets`` numbers, whatever the input) are broadcast to a second
pass over the written buckets, which gives weights and seeded Gumbel scores. The draw is the head
of one global order, worked out by range partitions.

Defined results: a NULL text has no words, weight 0 and is never drawn; a NULL ``doc_id`` hashes as
the empty string and stands behind all others among equal scores; repeated rows are drawn each on
its own; fewer than ``min_words`` words are scored but never drawn; empty tables give no rows (an
empty target gives gains from the corpus alone). Other columns of the tables are not read.
"""

from __future__ import annotations

import hashlib
import math
from array import array
from uuid import uuid4
from zlib import crc32

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusprep.llm.common import map_rows
from corpusprep.operators.order import ordered_scan
from corpusprep.session import ensure_checkpoint_dir

#: Bytes that separate words, and A-Z, as a table: separators to a space, A-Z to a-z. All other
#: bytes (0-9, a-z, every byte of a character beyond ASCII) belong to words.
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))


def words_line(text: str | None) -> bytes:
    """The words of a text in UTF-8, one space between them."""
    return b" ".join((text or "").encode("utf-8", "surrogatepass").translate(_TABLE).split())


def span_pattern(max_n: int):
    """A pattern that matches at every word the longest run of up to ``max_n`` words; group k ends
    where the run of k words ends."""
    import regex

    body = b""
    for _ in range(max_n - 1):
        body = b"(?:( [^ ]+)" + body + b")?"
    return regex.compile(b"(?<![^ ])([^ ]+)" + body + b"(?![^ ])")


def feature_spans(line: bytes, pattern, max_n: int = 2):
    """(start, end) of all runs of 1 to ``max_n`` words of a line, in the order of their starts."""
    for m in pattern.finditer(line, overlapped=True):
        start = m.start()
        for k in range(1, max_n + 1):
            end = m.end(k)
            if end < 0:
                break
            yield start, end


def scan(df: DataFrame, id_col: str, text: str, buckets: int, max_n: int) -> DataFrame:
    """Rows of kind 0: ``(key, n_words, n, data)`` per row of ``df`` with the buckets of its features
    as little-endian unsigned numbers; rows of kind 1: ``(key = bucket, n)``, the bucket counts of
    each task."""
    code = "H" if buckets <= 1 << 16 else "I"

    def run(rows):
        pattern = span_pattern(max_n)
        total = [0] * buckets
        for key, t in rows:
            line = words_line(t)
            found = array(code, (crc32(line[a:b]) % buckets for a, b in feature_spans(line, pattern, max_n)))
            for b in found:
                total[b] += 1
            yield 0, key, (line.count(b" ") + 1 if line else 0), len(found), found.tobytes()
        for b, n in enumerate(total):
            if n:
                yield 1, b, None, n, None

    return map_rows(df.select(F.col(id_col).cast("long").alias("key"), F.col(text).alias("text")), run,
                    "kind int, key long, n_words long, n long, data binary")


def gain_table(corpus: dict[int, int], target: dict[int, int], buckets: int) -> list[int]:
    """floor(1000 ln of the smoothed share in the target over that in the corpus) per bucket."""
    s_all, t_all = sum(corpus.values()), sum(target.values())
    return [math.floor(1000 * math.log(((target.get(b, 0) + 1) * (s_all + buckets)) / ((corpus.get(b, 0) + 1) * (t_all + buckets))))
            for b in range(buckets)]


def gumbel(seed: int, key) -> int:
    """The seeded noise of a document."""
    h = int(hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def resample(docs: DataFrame, target: DataFrame, buckets: int = 10_000, max_n: int = 2, seed: int = 7, percent: int = 25,
             min_words: int = 20) -> DataFrame:
    """``(doc_id, n_features, weight, score, rank)`` for every row of ``docs``: the first
    ``percent`` of those with ``min_words`` words or more carry their rank."""
    spark = docs.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/features-{uuid4().hex}"
    scan(docs, "doc_id", "text", buckets, max_n).write.partitionBy("kind").parquet(path)
    held = spark.read.schema("key long, n_words long, n long, data binary, kind int").parquet(path)

    def counts(df: DataFrame) -> dict[int, int]:
        # at most one row per bucket
        return {r["key"]: r["n"] for r in df.where("kind = 1").groupBy("key").agg(F.sum("n").alias("n")).collect()}

    gains = gain_table(counts(held), counts(scan(target, "item_id", "text", buckets, max_n)), buckets)
    sent = spark.sparkContext.broadcast(gains)
    kind = "u2" if buckets <= 1 << 16 else "u4"

    def weigh(rows):
        import numpy as np

        table = np.array(sent.value, dtype="i8")
        for key, n_words, n, data in rows:
            w = int(table[np.frombuffer(data, dtype=f"<{kind}")].sum()) // n if n else 0
            yield key, n_words, n, w, w + gumbel(seed, key)

    scored = map_rows(held.where("kind = 0").select("key", "n_words", "n", "data"), weigh,
                      "doc_id long, n_words long, n_features long, weight long, score long")
    n_fit = held.where((F.col("kind") == 0) & (F.col("n_words") >= min_words)).count()
    drawn = percent * n_fit // 100
    # equal rows are interchangeable, so the order is complete
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("n_features"), F.col("weight")]
    ranked = ordered_scan(scored.where(F.col("n_words") >= min_words), order, index="__at")
    rank = F.when(F.col("__at") < drawn, F.col("__at") + 1).cast("long")
    cols = ["doc_id", "n_features", "weight", "score"]
    rest = scored.where(F.col("n_words") < min_words).select(*cols, F.lit(None).cast("long").alias("rank"))
    return ranked.select(*cols, rank.alias("rank")).unionByName(rest)
