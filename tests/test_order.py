"""ordered_scan / forward_fill under skew, and line positions across file splits."""

import os
import random

from pyspark.sql import functions as F

from corpusprep.operators.order import forward_fill, ordered_scan
from corpusprep.sources.lines import read_lines


def test_ordered_scan_hot_group(spark):
    rnd = random.Random(5)
    rows = [("hot" if rnd.random() < 0.8 else f"g{rnd.randint(0, 9)}", rnd.randint(0, 10**9), rnd.randint(0, 50))
            for _ in range(3000)]
    rows = list({(g, o): (g, o, v) for g, o, v in rows}.values())  # unique order within a group
    df = spark.createDataFrame(rows, "g string, o long, v long")
    out = ordered_scan(df, ["o"], groups=["g"], sums={"before": "v"}, index="idx", partitions=7)
    got = {(r.g, r.o): (r.idx, r.before) for r in out.collect()}
    by = {}
    for g, o, v in sorted(rows, key=lambda t: (t[0], t[1])):
        by.setdefault(g, []).append((o, v))
    for g, lst in by.items():
        acc = 0
        for i, (o, v) in enumerate(lst):
            assert got[(g, o)] == (i, acc)
            acc += v


def test_ordered_scan_descending_global(spark):
    df = spark.createDataFrame([(i, i % 3) for i in range(200)], "k long, f long")
    out = ordered_scan(df, [F.col("f").desc(), F.col("k").asc()], index="rank", partitions=5)
    ranks = [r.k for r in out.orderBy("rank").collect()]
    assert ranks == sorted(range(200), key=lambda k: (-(k % 3), k))


def test_forward_fill(spark):
    rows = [(i, i if i % 17 == 0 else None) for i in range(1, 500)]
    df = spark.createDataFrame(rows, "pos long, v long")
    got = {r.pos: r.f for r in forward_fill(df, ["pos"], "v", "f", partitions=6).collect()}
    last = None
    for p, v in rows:
        last = v if v is not None else last
        assert got[p] == last


def test_read_lines_many_splits(spark, tmp):
    path = os.path.join(tmp, "big.txt")
    with open(path, "w") as f:
        for i in range(20000):
            f.write(f"line {i} {'x' * (i % 13)}\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16k")
    try:
        df = read_lines(spark, path)
        assert df.rdd.getNumPartitions() >= 1
        got = [(r.line_no, r.text.split()[1]) for r in df.orderBy("line_no").collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert got == [(i, str(i)) for i in range(20000)]
