"""A7/A8/A9/A11 against a small pure-Python implementation of the published definitions."""

import math
import random
import re
from collections import Counter

import numpy as np

from corpusprep.operators import metrics as mt

_SYM = re.compile("([" + "".join(f"{chr(a)}-{chr(b)}" if a != b else chr(a) for a, b in
                                 [(0x7B, 0x7E), (0x5B, 0x60), (0x20, 0x26), (0x28, 0x2B), (0x3A, 0x40), (0x2F, 0x2F)]
                                 ).replace("\\", "\\\\").replace("[-", "\\[-").replace("]", "\\]").replace("^", "\\^") + "])")


def tok(line):
    line = line.rstrip().replace("<skipped>", "").replace("-\n", "").replace("\n", " ")
    for a, b in (("&quot;", '"'), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">")):
        line = line.replace(a, b)
    line = _SYM.sub(r" \1 ", f" {line} ")
    line = re.sub(r"([^0-9])([\.,])", r"\1 \2 ", line)
    line = re.sub(r"([\.,])([^0-9])", r" \1 \2", line)
    line = re.sub(r"([0-9])(-)", r"\1 \2 ", line)
    return line.split()


def grams(units, n, sep):
    return Counter(sep.join(units[i:i + n]) for i in range(len(units) - n + 1))


def py_bleu(hyps, refs):
    m, t = [0] * 4, [0] * 4
    hl = rl = 0
    for h, r in zip(hyps, refs):
        h, r = tok(h), tok(r)
        hl, rl = hl + len(h), rl + len(r)
        for n in range(1, 5):
            gh, gr = grams(h, n, " "), grams(r, n, " ")
            t[n - 1] += sum(gh.values())
            m[n - 1] += sum(min(c, gr[g]) for g, c in gh.items())
    if not any(m):
        return 0.0
    bp = 1.0 if hl >= rl else (math.exp(1 - rl / hl) if hl else 0.0)
    p, k = [0.0] * 4, 0
    for n in range(4):
        if t[n] == 0:
            break
        if m[n] == 0:
            k += 1
            p[n] = 100.0 / (2 ** k * t[n])
        else:
            p[n] = 100.0 * m[n] / t[n]
    return bp * math.exp(sum(math.log(x) if x > 0 else -9999999999 for x in p) / 4)


def py_chrf(hyps, refs, order=6, beta=2):
    st = [[0, 0, 0] for _ in range(order)]
    for h, r in zip(hyps, refs):
        h, r = "".join(h.split()), "".join(r.split())
        for n in range(1, order + 1):
            gh, gr = grams(list(h), n, ""), grams(list(r), n, "")
            st[n - 1][0] += sum(gh.values())
            st[n - 1][1] += sum(gr.values())
            st[n - 1][2] += sum(min(c, gr[g]) for g, c in gh.items())
    ps, rs, eff = 0.0, 0.0, 0
    for hh, rr, mm in st:
        if hh > 0 and rr > 0:
            ps += mm / hh
            rs += mm / rr
            eff += 1
    if not eff:
        return 0.0
    p, r = ps / eff, rs / eff
    return 100 * (1 + beta ** 2) * p * r / (beta ** 2 * p + r) if p + r else 0.0


WORDS = "the a cat sat on mat dog , . 12 3.5 - ( ) & x-ray é ü".split()


def corpus(seed, n=25):
    rnd = random.Random(seed)
    refs = [" ".join(rnd.choice(WORDS) for _ in range(rnd.randint(0, 12))) for _ in range(n)]
    hyps = [" ".join(w for w in r.split() if rnd.random() > 0.3) + (" cat" if rnd.random() > 0.5 else "") for r in refs]
    return hyps, refs


def frame(spark, hyps, refs):
    return spark.createDataFrame([(i, h, r) for i, (h, r) in enumerate(zip(hyps, refs))], "pid long, hyp string, ref string")


def test_bleu_chrf_equal_python(spark):
    for seed in (1, 2, 3):
        hyps, refs = corpus(seed)
        df = frame(spark, hyps, refs)
        b = mt.corpus_bleu(df, "hyp", "ref", pair_cols=["pid"]).first()["bleu"]
        bj = mt.corpus_bleu(df, "hyp", "ref", pair_cols=["pid"], engine="jvm").first()["bleu"]
        assert b == bj
        c = mt.corpus_chrf(df, "hyp", "ref", pair_cols=["pid"]).first()["chrf"]
        cj = mt.corpus_chrf(df, "hyp", "ref", pair_cols=["pid"], engine="jvm").first()["chrf"]
        assert abs(b - round(py_bleu(hyps, refs), 4)) < 1e-9
        assert abs(c - round(py_chrf(hyps, refs), 4)) < 1e-9
        assert c == cj


def test_identity_and_disjoint(spark):
    same = frame(spark, ["a b c d e", "x y"], ["a b c d e", "x y"])
    assert mt.corpus_bleu(same, "hyp", "ref", pair_cols=["pid"]).first()["bleu"] == 100.0
    assert mt.corpus_chrf(same, "hyp", "ref", pair_cols=["pid"]).first()["chrf"] == 100.0
    dis = frame(spark, ["p q r s"], ["a b c d"])
    assert mt.corpus_bleu(dis, "hyp", "ref", pair_cols=["pid"]).first()["bleu"] == 0.0


def test_tokenizer_13a(spark):
    df = spark.createDataFrame([("Hello, world. 3.5 x-ray 1-2 &amp; (a)",)], "t string")
    assert df.select(mt.tokenize_13a("t")).first()[0] == tok("Hello, world. 3.5 x-ray 1-2 &amp; (a)")


def test_compare_scores(spark):
    hyps, refs = corpus(9)
    df = frame(spark, hyps, refs).withColumn("same", __import__("pyspark.sql.functions", fromlist=["col"]).col("ref"))
    got = {r.system: r.bleu for r in mt.compare_scores(df, "ref", ["hyp", "same"], ["pid"]).collect()}
    assert got["same"] == 100.0 and abs(got["hyp"] - round(py_bleu(hyps, refs), 4)) < 1e-9


def test_clipped_matches_equal_counters():
    rnd = random.Random(7)
    for case in range(1500):
        units = rnd.choice([1, 2, 5, 1021, 1022, 1023, 40_000])  # from 1,022 and 32,766 on, order by order
        h = [rnd.randrange(units) for _ in range(rnd.randint(0, 30))]
        r = [rnd.choice(h) if h and rnd.random() < 0.7 else rnd.randrange(units) for _ in range(rnd.randint(0, 30))]
        r = h[rnd.randint(0, 5):] if case % 3 == 0 else r
        for order in (4, 6):
            want = []
            for n in range(1, order + 1):
                a, b = (Counter(tuple(x[i:i + n]) for i in range(len(x) - n + 1)) for x in (h, r))
                want.append(sum(min(c, b[g]) for g, c in a.items()))
            assert mt.clipped_matches(np.array(h, np.int64), np.array(r, np.int64), order) == want


def test_tokens_by_word_equal_tokens_of_the_line(spark):
    rnd = random.Random(3)
    parts = [*"ab5 .,-\t&;<>'\"é!?x0", "<skipped>", "&quot;", "&amp;", "&lt;", "..", ",5", "²", "-\n"]
    lines = ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 14))) for _ in range(1500)]
    tok = mt._py_tokenize_13a()
    for r in spark.createDataFrame([(x,) for x in lines], "t string").select("t", mt.tokenize_13a("t").alias("k")).collect():
        assert tok(r["t"]) == r["k"]


def test_pair_counts_do_not_take_python_objects_for_every_ngram():
    """Counters took over 100 bytes for each n-gram of a text (41 MB here); sorted numbers take few."""
    import tracemalloc
    rnd = random.Random(1)
    text = "".join(rnd.choice("abcdefghijklmnop") for _ in range(100_000))
    row = mt._chrf_row()
    tracemalloc.start()
    got = row(text, text[1:])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got[:3] == [100_000, 99_999, 99_999] and peak < 20_000_000
