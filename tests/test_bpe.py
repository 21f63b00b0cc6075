"""BPE: hand goldens, brute-force equality of the multi-merge rounds, segmentation properties."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from corpusprep.operators import bpe_apply as ba
from corpusprep.operators import bpe_learn as bl
from corpusprep.operators.stats import to_symbols, word_counts

from conftest import SMALL


def brute_learn(words: dict, k: int, min_freq: int = 2):
    """One merge per step over true pair counts (the published definition)."""
    vocab = {tuple(w[:-1]) + (w[-1] + "</w>",): f for w, f in words.items()}
    out = []
    for _ in range(k):
        stats = Counter()
        for sym, f in vocab.items():
            for a, b in zip(sym, sym[1:]):
                stats[(a, b)] += f
        if not stats:
            break
        best = max(stats, key=lambda p: (stats[p], p))
        if stats[best] < min_freq:
            break
        out.append((best[0], best[1], stats[best]))
        new = {}
        for sym, f in vocab.items():
            m, i = [], 0
            while i < len(sym):
                if i < len(sym) - 1 and sym[i] == best[0] and sym[i + 1] == best[1]:
                    m.append(sym[i] + sym[i + 1])
                    i += 2
                else:
                    m.append(sym[i])
                    i += 1
            new[tuple(m)] = new.get(tuple(m), 0) + f
        vocab = new
    return out


def learned(df):
    return [(r.left, r.right, r.freq) for r in df.orderBy("rank").collect()]


def counts_df(spark, words):
    return spark.createDataFrame(list(words.items()), "word string, freq long")


def test_pair_counts_overlap(spark):
    t = bl.word_types(counts_df(spark, {"aaa": 1}))
    got = {(r.l, r.r): r.freq for r in bl.pair_counts(t).collect()}
    assert got == {("a", "a"): 1, ("a", "a</w>"): 1}


def test_best_pair_tie(spark):
    p = spark.createDataFrame([("a", "b", 5), ("a", "c", 5)], "l string, r string, freq long")
    r = bl.best_pair(p).first()
    assert (r.l, r.r) == ("a", "c")


def test_merge_pair_left_to_right(spark):
    df = spark.createDataFrame([(" a  a  a ",)], "s string")
    assert df.select(bl.merge_pair(F.col("s"), "a", "a")).first()[0] == " aa  a "


def test_symbols(spark):
    df = spark.createDataFrame([("héé",)], "w string")
    assert df.select(to_symbols("w")).first()[0] == " h  é  é</w> "


def test_empty_and_one_letter(spark):
    assert bl.learn_bpe_from_counts(counts_df(spark, {"a": 5, "b": 3}), num_merges=10).count() == 0
    empty = spark.createDataFrame([], "text string")
    assert bl.learn_bpe(empty, "text", num_merges=10).count() == 0


@pytest.mark.parametrize("alphabet,seed", [("ab", 1), ("abc", 2), ("abcd", 3)])
def test_rounds_equal_one_merge_at_a_time(spark, alphabet, seed):
    rnd = random.Random(seed)
    words = {}
    for _ in range(300):
        w = "".join(rnd.choice(alphabet) for _ in range(rnd.randint(1, 9)))
        words[w] = words.get(w, 0) + rnd.randint(1, 40)
    got = learned(bl.learn_bpe_from_counts(counts_df(spark, words), num_merges=40, candidates=16))
    assert got == brute_learn(words, 40)


def test_learn_on_documents_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    words = {r.word: r.freq for r in word_counts(docs, "text").collect()}
    got = learned(bl.learn_bpe(docs, "text", num_merges=60))
    assert got == brute_learn(words, 60)


def test_learn_k_is_prefix_of_k_plus_more(spark):
    words = {"lower": 5, "lowest": 3, "newer": 6, "wider": 2, "low": 7}
    a = learned(bl.learn_bpe_from_counts(counts_df(spark, words), num_merges=5))
    b = learned(bl.learn_bpe_from_counts(counts_df(spark, words), num_merges=9))
    assert b[:len(a)] == a


def test_grouped_learning_matches_per_group(spark):
    rows = [("x", "low lower lowest low"), ("y", "newer new newest news new")]
    df = spark.createDataFrame(rows, "g string, text string")
    grouped = bl.learn_bpe(df, "text", num_merges=6, group_cols=["g"])
    for g, text in rows:
        words = Counter(text.split())
        got = [(r.left, r.right, r.freq) for r in grouped.filter(F.col("g") == g).orderBy("rank").collect()]
        assert got == brute_learn(dict(words), 6)


# --- segmentation -----------------------------------------------------------------------------

def test_codec_goldens():
    c = ba.Codec([("a", "b"), ("ab", "c</w>")])
    assert c.encode("abc") == ("abc",)
    assert c.encode("x") == ("x",)            # one letter unchanged
    assert c.segment_line("abc abd") == "abc ab@@ d"
    assert c.segment_line("") == ""
    v = ba.Codec([("a", "b"), ("ab", "c</w>")], vocab={"ab@@", "c"})
    assert v.encode("abc") == ("ab", "c")     # out-of-vocabulary piece backs off
    v01 = ba.Codec([("a", "b"), ("b", "</w>")], version=(0, 1))
    assert v01.encode("ab") == ("ab",)
    assert v01.encode("b") == ("b",)


def test_glossary_docstring_example():
    import re
    assert ba.split_glossary("1934USABUSA", [re.compile("(USA)")]) == ["1934", "USA", "B", "USA"]
    c = ba.Codec([], glossaries=["USA"])
    assert c.segment_line("1934USABUSA") == "1@@ 9@@ 3@@ 4@@ USA@@ B@@ USA"


def test_lowest_rank_loop_not_rank_order():
    # 'abc' has two derivations; the loop takes the lowest rank among present pairs each time
    c = ba.Codec([("b", "c</w>"), ("a", "b"), ("ab", "c</w>")])
    assert c.encode("abc") == ("a", "bc")


def slow_encode(word, merges):
    """One merge of the lowest rank after the other, all its occurrences at a time."""
    s = [*word[:-1], word[-1] + "</w>"]
    rank = {m: i for i, m in reversed(list(enumerate(merges)))}
    while len(s) > 1:
        best = min((rank[p], p) for p in zip(s, s[1:]) if p in rank) if any(p in rank for p in zip(s, s[1:])) else None
        if best is None:
            break
        out = []
        while s:
            if len(s) > 1 and (s[0], s[1]) == best[1]:
                out.append(s[0] + s[1])
                s = s[2:]
            else:
                out.append(s.pop(0))
        s = out
    return tuple([*s[:-1], s[-1].replace("</w>", "")]) if len(word) > 1 else (word,)


def test_encoder_equals_definition_on_thousands_of_merges():
    rng = random.Random(8)
    for alphabet, count in (("ab", 60), ("abcd", 800), ("abcdefgh", 4000)):
        known, merges = [*alphabet, *[c + "</w>" for c in alphabet]], []
        for _ in range(count):
            a, b = rng.choice([k for k in known if not k.endswith("</w>")]), rng.choice(known)
            if len(a + b) < 14:
                merges.append((a, b))
                known.append(a + b)
        merges = list(dict.fromkeys(merges))
        rng.shuffle(merges)
        c = ba.Codec(merges)
        for _ in range(1500):
            w = "".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 16)))
            assert c.encode(w) == slow_encode(w, merges), (w, merges)


def test_back_off_equals_recursion():
    rng = random.Random(9)
    merges = [("a", "b"), ("ab", "c"), ("b", "c"), ("a", "bc"), ("abc", "d</w>"), ("c", "d</w>"), ("ab", "cd</w>"), ("ab", "ab"), ("abab", "c")]

    def split(x, final, vocab):
        if (x if final else x + "@@") in vocab:
            return [x]
        pair = next((m for m in merges if m[0] + m[1] == x + "</w>" * final), None)
        return [x] if pair is None else split(pair[0], False, vocab) + split(pair[1].removesuffix("</w>") if final else pair[1], final, vocab)
    units = ["a", "b", "c", "d", "ab", "bc", "abc", "abcd", "cd", "abab", "ababc"]
    for _ in range(300):
        vocab = {u + rng.choice(["", "@@"]) for u in rng.sample(units, rng.randrange(1, 9))}
        plain, c = ba.Codec(merges), ba.Codec(merges, vocab=vocab)
        for w in ("abcd", "ababc", "abab", "cd", "abcabcd", "bca", "dd"):
            *inside, end = plain.encode(w)
            assert list(c.encode(w)) == [u for x in inside for u in split(x, False, vocab)] + split(end, True, vocab)


def test_groups_with_vocab_and_glossary(spark):
    df = spark.createDataFrame([("x", "lowxlow low"), ("y", "low")], "g string, text string")
    merges = spark.createDataFrame([(g, r, a, b) for g in "xy" for r, (a, b) in enumerate([("l", "o"), ("lo", "w</w>")])],
                                   "g string, rank long, left string, right string")
    vocab = spark.createDataFrame([("x", "lo@@"), ("x", "w"), ("y", "low")], "g string, token string")
    out = {r.g: r.enc for r in ba.apply_bpe_groups(df, "text", merges, ["g"], out_col="enc", vocab=vocab, glossaries=["x"]).collect()}
    assert out == {"x": "lo@@ w@@ x@@ lo@@ w lo@@ w", "y": "low"}


def test_apply_roundtrip_and_layout_invariance(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text")
    merges = bl.learn_bpe(docs, "text", num_merges=30)
    enc = ba.apply_bpe(docs, "text", merges, out_col="enc")
    from corpusprep.functions.text import detokenise, normalise_ws
    bad = enc.filter(~F.col("text").contains("@@")).filter(detokenise("enc", "strip") != normalise_ws("text"))
    assert bad.count() == 0
    one = {r.doc_id: r.enc for r in ba.apply_bpe(docs.repartition(1), "text", merges, out_col="enc").collect()}
    many = {r.doc_id: r.enc for r in ba.apply_bpe(docs.repartition(7), "text", merges, out_col="enc").collect()}
    assert one == many


def test_apply_groups(spark):
    df = spark.createDataFrame([("x", "lower low"), ("y", "lower low")], "g string, text string")
    merges = spark.createDataFrame([("x", 0, "l", "o"), ("x", 1, "lo", "w</w>")], "g string, rank long, left string, right string")
    out = {r.g: r.enc for r in ba.apply_bpe_groups(df, "text", merges, ["g"], out_col="enc").collect()}
    assert out == {"x": "lo@@ w@@ e@@ r low", "y": "l@@ o@@ w@@ e@@ r l@@ o@@ w"}


def test_distinct_plan_equals_narrow(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text")
    merges = bl.learn_bpe(docs, "text", num_merges=25)
    a = {r.doc_id: r.enc for r in ba.apply_bpe(docs, "text", merges, out_col="enc").collect()}
    b = {r.doc_id: r.enc for r in ba.apply_bpe_distinct(docs, "text", ["doc_id"], merges).collect()}
    assert a == b


def test_segmentation_remembers_a_bounded_number_of_words():
    """Caches are bounded for all codecs of a worker together, in words and in characters."""
    codecs = [ba.Codec([("a", "b")], cache=1 / 1000) for _ in range(2)]
    words = [f"ab{i}" for i in range(1000)]
    for c in codecs:
        assert c.segment_line(" ".join(words)) == " ".join(c.segment_word(w) for w in words)
        assert 0 < len(c._words) <= 100 and c._words.chars == sum(len(k) + len(v) for k, v in c._words.items())
        c.segment_line("x" * 10_000)
        assert "x" * 10_000 not in c._words and c._words.chars <= 6000


def test_short_and_long_words_merge_alike():
    rnd = random.Random(4)
    for _ in range(1500):
        syms, rank = list("abc"), {}
        for _ in range(rnd.randint(0, 10)):
            p = (rnd.choice(syms), rnd.choice(syms))
            rank.setdefault(p, rnd.randrange(1000))  # ranks may have gaps
            syms.append("".join(p))
        word = [rnd.choice("abc") for _ in range(rnd.randint(1, 40))]
        assert ba.merge_symbols(list(word), rank) == ba._merge_long(list(word), rank)


def test_preparation_reads_its_corpora_once(spark, tmp_path, monkeypatch):
    from corpusprep.plans import flagship
    rows = [(c, t, "user" if t % 2 == 0 else "assistant", f"ab ba {c} {t}.") for c in range(12) for t in range(4)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    merges = spark.createDataFrame([("all", "src", 0, "a", "b</w>", 2)], "variant string, side string, rank long, left string, right string, freq long")
    monkeypatch.setattr(flagship, "learn_bpe", lambda *a, **k: merges)
    _, encoded = flagship.prepare(spark, str(tmp_path))
    plan = encoded._jdf.queryExecution().optimizedPlan().toString()
    assert "parquet" not in plan.lower() and encoded.count() > 0


def test_new_words_together_equal_word_by_word():
    """Bulk segmentation against the loop over the lowest rank, with and without a vocabulary."""
    bulk = 0
    for seed in range(400):
        r = random.Random(seed)
        alphabet = r.choice(["ab", "abc", "abcdef", "a</w>b", "é\U0001F600z", "xy", "abcdefghijklmnop"])
        word = lambda most: "".join(r.choice(alphabet) for _ in range(r.randint(1, most)))
        words = Counter(word(9) for _ in range(r.randint(1, 40)))
        merges = [(a, b) for a, b, _ in brute_learn(words, r.choice([3, 20, 60]))]
        if r.random() < .3:
            r.shuffle(merges)  # a merge may build what an earlier one joins
        vocab = None
        if r.random() < .6:
            cut = [ba.Codec(merges).pieces(w) for w in words]
            vocab = {u if i == len(p) - 1 else u + "@@" for p in cut for i, u in enumerate(p) if r.random() < .7} or {""}
        codec = ba.Codec(merges, vocab=vocab)
        lines = [" ".join(r.choice([word(9), word(70), *words]) for _ in range(r.randint(0, 30))) for _ in range(4)] + [None, "", "  "]
        assert list(codec.segment_lines(lines)) == [None if x is None else " ".join(map(codec.segment_word, x.split())) for x in lines], seed
        bulk += codec.bulk is not None
    assert 100 < bulk < 400


def test_vocabulary_of_words_is_that_of_the_text(spark, monkeypatch):
    """Each distinct word segmented once and counted as often as it occurs."""
    r = random.Random(2)
    texts = [" ".join(r.choice("abc") * r.randint(1, 3) + r.choice("xyz") for _ in range(r.randint(0, 30))) for _ in range(50)] + [None, "", "\t　x "]
    df = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    words = word_counts(df, "text")
    want = Counter(w for t in texts for w in (t or "").split())
    assert {x.word: x.freq for x in words.collect()} == want
    merges = bl.learn_bpe_from_counts(words, num_merges=6)
    of_text = ba.subword_vocab(ba.apply_bpe(df, "text", merges, out_col="e"), "e")
    of_words = ba.subword_vocab(ba.apply_bpe(words, "word", merges, out_col="e"), "e", times="freq")
    assert of_words.columns == of_text.columns == ["token", "freq"]
    assert sorted(map(tuple, of_words.collect())) == sorted(map(tuple, of_text.collect()))
