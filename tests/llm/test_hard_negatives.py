import math
import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusprep.llm import hard_negatives as hn

from edge_rows import SMALL

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows):
    """By the plain definition, over lists."""
    kept = {}
    for i, v, y in rows:
        if i is None or y is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        r = ((y + 1) % 10 if i % 7 == 0 else y, [math.floor(256 * float(np.float32(x))) for x in v])
        kept[i] = min(kept.get(i, r), r)
    out = []
    for a, (ya, va) in kept.items():
        if a % 50:
            continue
        scored = sorted(((-sum(p * q for p, q in zip(va, v)), i, y) for i, (y, v) in kept.items() if len(v) == len(va)))
        same = [(-s, i) for s, i, y in scored if y == ya and i != a][:5]
        for ps, p in same:
            hits = [(-s, i) for s, i, y in scored if y != ya and 50 * ps <= 100 * -s <= 95 * ps][:3]
            out += [(a, p, k + 1, i, ps, s) for k, (s, i) in enumerate(hits)]
    return sorted(out)


def found(df):
    return sorted(tuple(r) for r in df.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())


def test_query_equals_brute_force(spark):
    from corpusprep.llm.queries import op13_multi_index_negatives
    rows = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet(f"{SMALL}/embeddings.parquet").collect()]
    got = op13_multi_index_negatives(spark, SMALL)
    assert dict(got.dtypes) == {"anchor_id": "bigint", "positive_id": "bigint", "rank": "int", "negative_id": "bigint",
                                "positive_score": "bigint", "negative_score": "bigint"}
    assert found(got) == brute(rows) and found(got)


def test_edge_rows_ties_and_blocks(spark, monkeypatch):
    r = random.Random(2)
    rows = [(i, [float(r.randint(-2, 2)) for _ in range(3)], r.randint(0, 2)) for i in range(300)]
    rows += [(50, rows[50][1], 1), (100, rows[100][1], rows[100][2]), (None, [1.0, 1.0, 1.0], 1), (400, None, 1), (401, [1.0, None, 1.0], 1),
             (402, [1.0, float("nan"), 1.0], 1), (403, [1.0, float("-inf"), 1.0], 1), (450, [1.0, 1.0, 1.0], None), (500, [2.0], 1),
             (501, [2.0], 1), (502, [1.5], 2), (550, [], 1), (551, [], 1), (552, [], 2), (600, [1.0, 2.0], 9)]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("dim", F.lit("clash")).withColumn("vec", F.lit(1)).withColumn("rank", F.lit(2))
    want = brute(rows)
    assert found(hn.mine(df)) == want
    monkeypatch.setattr(hn, "BLOCK_BYTES", 48)  # two anchors of three numbers at a time
    monkeypatch.setattr(hn, "FIT_ROWS", 20)
    assert found(hn.mine(df.where("vec_id < 300"))) == brute([x for x in rows if x[0] is not None and x[0] < 300])
    assert hn.mine(df.limit(0)).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**6), st.integers(2, 9), st.integers(1, 400))
def test_walks_are_exact_and_cells_fall(seed, dim, n):
    r = np.random.default_rng(seed)
    centres = r.integers(-200, 200, (5, dim))
    x = (centres[r.integers(0, 5, n)] + r.integers(-20, 20, (n, dim))).astype(float)
    labels, ids = r.integers(0, 3, n), r.permutation(n)
    index = hn.CellIndex(ids, labels, x, (hn.fit_codebook(x[:50, :dim // 2]), hn.fit_codebook(x[:50, dim // 2:])))
    a = x[0]
    bounds = list(index.walk(a))
    assert [b[0] for b in bounds] == sorted((b[0] for b in bounds), reverse=True)
    assert sum(hi - lo for _, lo, hi in bounds) == n
    assert all((index.x[lo:hi] @ a <= b).all() for b, lo, hi in bounds)
    scores = {int(i): int(s) for i, s in zip(ids, x @ a)}
    label = {int(i): int(y) for i, y in zip(ids, labels)}
    by = sorted(scores, key=lambda i: (-scores[i], i))
    assert [i for _, i in index.positives(int(ids[0]), 1, a, 5)] == [i for i in by if label[i] == 1 and i != ids[0]][:5]
    spans = [(100, 5000), (10**4, 10**5), (5, 4)]
    assert [[i for _, i in w] for w in index.windows(1, a, spans, 3)] == [[i for i in by if label[i] != 1 and lo <= scores[i] <= hi][:3] for lo, hi in spans]


def test_clustered_rows_leave_cells_unvisited():
    r = np.random.default_rng(1)
    centres = r.integers(-3000, 3000, (8, 16))
    x = (centres[np.arange(20_000) % 8] + r.integers(-5, 5, (20_000, 16))).astype(float)
    index = hn.CellIndex(np.arange(20_000), np.zeros(20_000, int), x, (hn.fit_codebook(x[:4096, :8]), hn.fit_codebook(x[:4096, 8:])))
    seen = 0
    orig = index.batches
    index.batches = lambda a: ((b, at, s) for b, at, s in orig(a) if not counts.append(len(at)))
    counts: list[int] = []
    index.positives(0, 0, x[0], 5)
    seen = sum(counts)
    assert 0 < seen < 10_000
