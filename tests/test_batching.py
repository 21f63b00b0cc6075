"""Hand goldens and brute-force equality (exact global and sharded packing)."""

import random

from pyspark.sql import functions as F

from corpusprep.operators.batching import fixed_batches, flatten_batches
from corpusprep.operators.budget import batch_summary, budget_batches, token_batches


def brute_budget(lengths, budget):
    out, b, used = [], 0, 0
    for i, n in enumerate(lengths):
        if i and used + n > budget:
            b, used = b + 1, 0
        used += n
        out.append(b)
    return out


def run(spark, rows, budget, shards=False):
    df = spark.createDataFrame(rows, "shard long, pos long, n long")
    out = budget_batches(df, ["pos"], None, budget, shard_cols=["shard"] if shards else None, len_col="n")
    return [r.batch_id for r in out.orderBy("shard", "pos").collect()], out


def test_w1_goldens(spark):
    got, _ = run(spark, [(0, 0, 3000), (0, 1, 2000), (0, 2, 1)], 5000)
    assert got == [0, 0, 1]
    got, out = run(spark, [(0, 0, 6000), (0, 1, 1)], 5000)
    assert got == [0, 1]
    s = sorted((r.batch_id, r.char_count) for r in batch_summary(out, keep_empty=True, budget=5000).collect())
    assert s == [(0, 0), (1, 6000), (2, 1)]


def test_w1_global_equals_brute_force(spark):
    rnd = random.Random(7)
    lengths = [rnd.choice([0, 1, 5, 20, 49, 50, 51, 120]) for _ in range(400)]
    got, _ = run(spark, [(0, i, n) for i, n in enumerate(lengths)], 100)
    assert got == brute_budget(lengths, 100)


def test_w1_sharded_equals_brute_force(spark):
    rnd = random.Random(11)
    rows, expect, base = [], [], 0
    for shard in range(6):
        ls = [rnd.randint(0, 70) for _ in range(rnd.randint(1, 90))]
        rows += [(shard, i, n) for i, n in enumerate(ls)]
        b = brute_budget(ls, 60)
        expect += [x + base for x in b]
        base += max(b) + 1
    got, _ = run(spark, rows, 60, shards=True)
    assert got == expect


def test_fixed_and_flatten(spark):
    df = spark.createDataFrame([(i, f"l{i}") for i in range(12)], "line_no long, text string")
    b = fixed_batches(df, "line_no", 5)
    assert [r.batch_no for r in b.orderBy("line_no").collect()] == [0] * 5 + [1] * 5 + [2] * 2
    out = spark.createDataFrame([(0, ["a", "b"]), (1, ["c"])], "batch_id long, outputs array<string>")
    assert [(r.batch_id, r.pos, r.line) for r in flatten_batches(out, "batch_id").orderBy("batch_id", "pos").collect()] == \
        [(0, 0, "a"), (0, 1, "b"), (1, 0, "c")]


def test_token_batches_brute_force(spark):
    rnd = random.Random(3)
    lens = [rnd.randint(1, 40) for _ in range(50)]
    df = spark.createDataFrame([(i, n) for i, n in enumerate(lens)], "i long, n long")
    got = {r.i: (r.bucket_id, r.batch_no) for r in token_batches(df, ["i"], "n", budget=100, bucket=16).collect()}
    for b0 in range(0, 50, 16):
        idx = sorted(range(b0, min(b0 + 16, 50)), key=lambda i: (lens[i], i))
        b, cnt, mx = 0, 0, 0
        for i in idx:
            nm = max(mx, lens[i])
            if cnt and nm * (cnt + 1) > 100:
                b, cnt, mx = b + 1, 1, lens[i]
            else:
                cnt, mx = cnt + 1, nm
            assert got[i] == (b0 // 16, b)


def test_w1_borders_everywhere(spark):
    """Many layouts: lines of no length, over-long lines, shards inside and across partitions, NULL
    shards, partitions that a batch spans whole."""
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    try:
        for seed in range(12):
            rnd = random.Random(seed)
            budget = rnd.choice([3, 40, 1000])
            rows, expect, base = [], [], 0
            for shard in [None, *range(rnd.choice([0, 1, 12]))] if seed % 2 else [0]:
                ls = [rnd.choice([0, 0, 1, 2, 7, 45]) for _ in range(rnd.randint(1, 120))]
                rows += [(shard, i, n) for i, n in enumerate(ls)]
                b = brute_budget(ls, budget)
                expect += [x + base for x in b]
                base += max(b) + 1
            got, out = run(spark, rows, budget, shards=True)
            assert got == expect, seed
            assert sorted(r.idx for r in out.select("idx").collect()) == list(range(len(rows)))
        assert run(spark, [], 10)[0] == []
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
