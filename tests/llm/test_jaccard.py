import random
import re

import numpy as np

from edge_rows import SMALL, edge  # noqa: F401

from corpusprep.llm import queries as Q
from corpusprep.llm.components import components
from corpusprep.llm.jaccard import jaccard_components, keep_one, linked, may_link, sketch


def shingles(text, n):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i:i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def brute(rows, n, num, den):
    sets = [(i, shingles(t, n)) for i, t in rows]
    label = {i: i for i, _ in sets if i is not None}

    def root(x):
        while label[x] != x:
            x = label[x]
        return x
    for a, (i, s) in enumerate(sets):
        for j, u in sets[:a]:
            if None in (i, j) or not s or not u:
                continue
            both = len(s & u)
            if den * both >= num * (len(s) + len(u) - both):
                x, y = sorted((root(i), root(j)))
                label[y] = x
    return sorted(((i, len(s), None if i is None else root(i)) for i, s in sets), key=str)


def result(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_query_equals_brute_force(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    assert result(Q.op4_ngram_jaccard_join(spark, SMALL)) == brute(docs, 3, 90, 100)


def test_near_copies_equal_brute_force(spark):
    """Texts of all lengths with edits about the threshold, in chains and in groups larger than a block."""
    rng = random.Random(11)
    vocab = [f"w{k}" for k in range(400)]
    rows = []
    for size in [*range(1, 40), 60, 100, 150, 300]:
        base = [rng.choice(vocab) for _ in range(size)]
        for _ in range(4):
            rows.append(" ".join(base))
            if rng.random() < .7:
                base = list(base)
                for _ in range(rng.randrange(1, max(2, size // 40) + 1)):
                    base[rng.randrange(size)] = rng.choice(vocab)
            if rng.random() < .3:
                base = base + [rng.choice(vocab)]
    base = [rng.choice(vocab) for _ in range(80)]
    for _ in range(600):  # one large group, partly below the threshold
        c = list(base)
        for _ in range(rng.randrange(0, 4)):
            c[rng.randrange(80)] = rng.choice(vocab)
        rows.append(" ".join(c))
    rng.shuffle(rows)
    rows = list(enumerate(rows))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert result(jaccard_components(df, n=3, threshold=(90, 100))) == brute(rows, 3, 90, 100)
    assert result(jaccard_components(df, n=2, threshold=(80, 100))) == brute(rows, 2, 80, 100)


def test_edge_rows(spark, edge):
    rows = [(r["doc_id"], r["text"]) for r in edge.collect()]
    assert result(jaccard_components(edge, n=3, threshold=(90, 100))) == brute(rows, 3, 90, 100)
    assert jaccard_components(edge.limit(0)).count() == 0
    kept = keep_one(edge)
    assert kept.columns == edge.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(str(i) for i, _ in rows if i != 6)


def test_components(spark):
    edges = [(k, k + 1) for k in range(50)] + [(100, 60), (61, 60), (61, 100), (7, 7)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{k: 0 for k in range(51)}, 60: 60, 61: 60, 100: 60}


def test_sketches_discard_no_linked_rows():
    rng = np.random.default_rng(5)
    dropped = 0
    for size in [1, 2, 5, 20, 63, 64, 65, 127, 130, 500, 1100] * 20:
        a = np.unique(rng.integers(0, 1 << 63, size, dtype=np.uint64))
        lost = int(rng.integers(0, max(1, size // 3) + 1))
        b = np.unique(np.r_[a[lost:], rng.integers(0, 1 << 63, int(rng.integers(0, max(1, size // 3) + 1)), dtype=np.uint64)])
        for num, den in ((80, 100), (90, 100)):
            may = may_link(len(a), np.frombuffer(sketch(a), np.uint8), len(b), np.frombuffer(sketch(b), np.uint8), num, den)
            if linked(a, b, num, den):
                assert may
            dropped += not may
    assert dropped > 50


def test_shared_passages_equal_brute_force(spark):
    """Different texts that share long passages meet under block keys without being linked; the links
    among them are found all the same, also between components that stars leave apart."""
    rng = random.Random(21)
    vocab = [f"w{k}" for k in range(3000)]
    passages = [[rng.choice(vocab) for _ in range(40)] for _ in range(3)]
    rows = []
    for k in range(450):
        own = [rng.choice(vocab) for _ in range(rng.choice([4, 8, 12, 30]))]
        text = [*passages[k % 3], *own]
        rows.append(" ".join(text))
        if rng.random() < .3:  # a near copy, sometimes just below the threshold
            for _ in range(rng.randrange(1, 4)):
                text[40 + rng.randrange(len(own))] = rng.choice(vocab)
            rows.append(" ".join(text))
    rng.shuffle(rows)
    rows = list(enumerate(rows))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    for n, num in ((5, 80), (3, 90)):
        assert result(jaccard_components(df, n=n, threshold=(num, 100))) == brute(rows, n, num, 100)
