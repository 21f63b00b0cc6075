import random

import numpy as np
from edge_rows import SMALL, edge  # noqa: F401

from corpusprep.llm import queries as Q
from corpusprep.llm.decontam import contaminated_pairs, decontaminate, greedy_tiles, words


def longest_first(item, doc, k):
    """Greedy string tiling by its definition: mark the longest match that is free, again and again."""
    fi, fd, tiles = [True] * len(item), [True] * len(doc), []
    while True:
        best = (0, 0, 0)
        for i in range(len(item)):
            for d in range(len(doc)):
                n = 0
                while i + n < len(item) and d + n < len(doc) and fi[i + n] and fd[d + n] and item[i + n] == doc[d + n]:
                    n += 1
                if n > best[0]:
                    best = (n, i, d)
        n, i, d = best
        if n < k:
            return tiles
        tiles.append((i, d, n))
        fi[i:i + n] = [False] * n
        fd[d:d + n] = [False] * n


def test_tiles_equal_definition():
    rng = random.Random(5)
    for _ in range(1500):
        item = [rng.randrange(4) + 1 for _ in range(rng.randrange(1, 40))]
        doc = [rng.randrange(4) + 1 for _ in range(rng.randrange(1, 60))]
        got = greedy_tiles(np.array(item, np.uint64), np.array(doc, np.uint64), 3, first=rng.choice([3, 4, 8, 32]))
        want = longest_first(item, doc, 3)
        assert got == sorted(longest_first(item, doc, 3))


def test_repetitive_texts_are_no_product():
    """One word again and again on both sides: time and memory follow the sum of the lengths."""
    from time import monotonic

    from corpusprep.llm.decontam import _Block
    block = _Block([(1, "a " * 60), (2, "a b " * 30), (3, "x y z " * 20)], 5)
    start = monotonic()
    assert [(k, n) for k, n, _, _ in block.matches("a " * 200_000, 0.5)] == [(1, 60)]
    assert sorted(k for k, *_ in block.matches("a b " * 50_000 + "a " * 100, 0.5)) == [1, 2]
    assert monotonic() - start < 60


def test_query_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").collect()
    items = spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()
    want = set()
    for r in docs:
        w = words(r["text"])
        grams = {tuple(w[k:k + 5]) for k in range(len(w) - 4)}
        for b in items:
            v = words(b["text"])
            if any(tuple(v[k:k + 5]) in grams for k in range(len(v) - 4)):
                vocab = {x: n for n, x in enumerate({*v, *w}, 1)}
                tiles = greedy_tiles(np.array([vocab[x] for x in v], np.uint64), np.array([vocab[x] for x in w], np.uint64))
                c = sum(n for _, _, n in tiles)
                if 2 * c >= len(v):
                    want.add((r["doc_id"], b["item_id"], c))
    got = {(r["doc_id"], r["item_id"], r["covered_words"]) for r in Q.op2_benchmark_decontamination(spark, SMALL).collect()}
    assert got == want and got
    blocks = contaminated_pairs(spark.read.parquet(f"{SMALL}/documents.parquet"), spark.read.parquet(f"{SMALL}/benchmark.parquet"), block_words=500)
    assert {(r["doc_id"], r["item_id"], r["covered_words"]) for r in blocks.collect()} == want


def test_reordered_and_clean(spark):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma"
    w = item.split()
    moved = " ".join(["intro", *w[12:], "middle words", *w[:6], "more", *w[6:12], "end"])
    docs = spark.createDataFrame([(1, moved), (2, " ".join(w[:6]) + " and then nothing of it"), (3, None), (None, item.upper())], "doc_id long, text string")
    bench = spark.createDataFrame([(1, item), (2, None), (3, "too short"), (4, "")], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"], r["coverage"]) for r in contaminated_pairs(docs, bench).collect()}
    assert got == {(1, 1, 1.0), (None, 1, 1.0)}
    assert sorted(r["doc_id"] for r in decontaminate(docs, bench).collect()) == [2, 3]
    assert contaminated_pairs(docs, bench.limit(0)).count() == 0 and contaminated_pairs(docs.limit(0), bench).count() == 0


def test_short_items_and_scripts_without_spaces(spark):
    zh = "\u4f60\u597d\u4e16\u754c\u4eca\u5929\u5929\u6c14\u5f88\u597d\u6211\u4eec\u53bb\u516c\u56ed"
    assert words("Abc " + zh[:3] + "x1 \u30c6\u30b9\u30c8") == ["abc", *zh[:3], "x1", *"\u30c6\u30b9\u30c8"] and words("\u00e9t\u00e9 x_1") == ["\u00e9t\u00e9", "x_1"]
    docs = spark.createDataFrame([(1, "Well: who wrote Hamlet? he did"), (2, "who never wrote hamlet"), (3, "wrote hamlet"), (4, "\u524d" + zh + "\u540e"),
                                  (5, zh[:6] + "abc"), (6, "x " + zh[2:5] + " y"), (7, None), (8, "")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "Who wrote Hamlet"), (2, zh), (3, zh[2:5]), (4, "..."), (5, "Hamlet")], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): (r["covered_words"], r["coverage"], [tuple(t) for t in r["tiles"]]) for r in contaminated_pairs(docs, bench).collect()}
    assert got == {(1, 1): (3, 1.0, [(0, 1, 3)]), (1, 5): (1, 1.0, [(0, 3, 1)]), (2, 5): (1, 1.0, [(0, 3, 1)]), (3, 5): (1, 1.0, [(0, 1, 1)]),
                   (4, 2): (15, 1.0, [(0, 1, 15)]), (4, 3): (3, 1.0, [(0, 3, 3)]), (5, 3): (3, 1.0, [(0, 2, 3)]), (6, 3): (3, 1.0, [(0, 1, 3)])}
    assert sorted(r["doc_id"] for r in decontaminate(docs, bench).collect()) == [7, 8]


def test_edge_rows(spark, edge):
    bench = spark.createDataFrame([(1, "the cat sat on the mat"), (1, "the cat sat on the mat")], "item_id long, text string")
    assert [(r["doc_id"], r["covered_words"]) for r in contaminated_pairs(edge, bench).collect()] == [(9, 6), (9, 6)]
    assert decontaminate(edge, bench).count() == edge.count() - 1
