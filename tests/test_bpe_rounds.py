"""The rounds of BPE learning against one merge at a time: the logic of a round over many random
corpora without Spark, then the Spark job with bounds so tight that every form of round occurs."""

import glob
import os
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from corpusprep.operators import bpe_learn as bl
from corpusprep.operators import bpe_rounds as br

from test_bpe import brute_learn, counts_df, learned


def by_rounds(words: dict, k: int, most: int, rows: int, run_rows: int):
    """What the Spark job does, on lists; returns the merges, the rounds and their forms."""
    vocab = [(list(w[:-1]) + [w[-1] + "</w>"], f) for w, f in words.items()]
    out, size, n, forms = [], 4, 0, Counter()
    while len(out) < k:
        n += 1
        count, places = Counter(), Counter()
        for s, f in vocab:
            for p in zip(s, s[1:]):
                count[p] += f
                places[p] += 1
        cands = sorted(((c, *p, places[p]) for p, c in count.items()), reverse=True)[:most + 1]
        rnd = br.plan_round(cands, most, size, rows, 2)
        if rnd is None:
            break
        summary = Counter()
        for s, f in vocab:
            for x in br.cut(s, rnd.hot, rnd.form):
                summary[tuple(x)] += f
        if rnd.form == "runs" and len(summary) > run_rows:
            size //= 2
            continue
        size = min(most, 2 * size) if rnd.form == "runs" else max(size, 1)
        forms[rnd.form] += 1
        got = br.solve([(list(s), f) for s, f in summary.items()], rnd, k - len(out), 2, {a + b for a, b, _ in out})
        assert got  # every round gets on
        out += got
        order = {}
        for i, (a, b, _) in enumerate(got):
            order.setdefault((a, b), []).append(i)
        vocab = [(br.replay(s, order), f) for s, f in vocab]
    return out, n, forms


def test_random_corpora_equal_one_merge_at_a_time(monkeypatch):
    forms, merges, rounds = Counter(), 0, 0
    for seed in range(10_000):
        r = random.Random(seed)
        alphabet = r.choice(["ab", "abc", "abcdef", "abcdefghijkl", "a</w>b", "é\U0001F600z"])
        words = Counter()
        for _ in range(r.randint(1, 40)):
            words["".join(r.choice(alphabet) for _ in range(r.randint(1, 8)))] += r.choice([1, 1, 2, r.randint(1, 40)])
        monkeypatch.setattr(br, "WHOLE_PAIRS", r.choice([1, 2, 8, 64]))
        k = r.choice([5, 40, 300])
        got, n, f = by_rounds(words, k, r.choice([1, 2, 5, 20, 200]), r.choice([0, 5, 30, 1000]), r.choice([1, 3, 10, 1000]))
        assert got == brute_learn(words, k), seed
        forms += f
        merges, rounds = merges + len(got), rounds + n
    assert min(forms[x] for x in ("whole", "runs", "first")) > 1000


def test_a_pair_merged_twice_in_a_round():
    assert br.replay(list("abcabc"), {("a", "b"): [0, 2], ("b", "c"): [1]}) == ["ab", "c", "ab", "c"]
    assert br.joined(list("aaaaa"), "a", "a") == ["aa", "aa", "a"]


@pytest.mark.parametrize("rows,most", [(0, 7), (40, 5), (400, 30)])
def test_the_job_with_tight_bounds(spark, rows, most):
    r = random.Random(rows)
    words = {}
    for _ in range(250):
        w = "".join(r.choice("abcde") for _ in range(r.randint(1, 8)))
        words[w] = words.get(w, 0) + r.randint(1, 9)
    types = bl.word_types(counts_df(spark, words))
    got = learned(bl.learn_from_types(types, num_merges=14, candidates=most, rows=rows))
    assert got == brute_learn(words, 14)


def test_groups_and_base(spark, monkeypatch):
    """Base and young are split every other round; NULL is a group; the store is empty after."""
    monkeypatch.setattr(bl, "BASE_ROUNDS", 2)
    monkeypatch.setattr(bl, "BASE_FACTOR", 1)
    monkeypatch.setattr(bl, "PAIR_ROUNDS", 2)
    monkeypatch.setattr(bl, "GROUPS_AT_ONCE", 2)
    r = random.Random(7)
    per = {g: Counter("".join(r.choice(a) for _ in range(r.randint(1, 7))) for _ in range(250))
           for g, a in (("x", "abc"), ("y", "abcdefg"), (None, "ab"))}
    df = spark.createDataFrame([(g, w, f) for g, ws in per.items() for w, f in ws.items()], "g string, word string, freq long")
    got = bl.learn_from_types(bl.word_types(df, ["g"]), ["g"], num_merges=40, candidates=15, rows=300)
    for g, ws in per.items():
        assert learned(got.where(F.col("g").eqNullSafe(F.lit(g)))) == brute_learn(ws, 40), g
    root = spark.sparkContext.getCheckpointDir().removeprefix("file:")
    assert not [p for p in glob.glob(os.path.join(root, "bpe-*")) if os.path.isdir(p)]
