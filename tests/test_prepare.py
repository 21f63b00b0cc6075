"""``prepare_dataset`` learns as many merges as the reference, in Spark and in its SQL."""

import random
from collections import Counter

import duckdb

from corpusprep.plans import fixtures as fx
from corpusprep.plans import q_bpe
from corpusprep.plans.flagship import flagship
from corpusprep.plans.registry import oracles, queries

from test_bpe import brute_learn


def test_staged_sql_equals_one_merge_at_a_time():
    """A group per random corpus; strings made in two ways, overlaps, ties, markers in the text."""
    corpora, rows = {}, []
    for seed in range(60):
        r = random.Random(seed)
        alphabet = r.choice(["ab", "abc", "abcdef", "abcdefghijkl", "a</w>b", "é\U0001F600z"])
        words = Counter()
        for _ in range(r.randint(1, 60)):
            words["".join(r.choice(alphabet) for _ in range(r.randint(1, 9)))] += r.choice([1, 1, 2, r.randint(1, 40)])
        corpora[f"g{seed}"] = words
        rows += [(f"g{seed}", w, f) for w, f in words.items()]
    con = duckdb.connect()
    con.execute("CREATE TABLE words (g VARCHAR, word VARCHAR, freq BIGINT)")
    con.executemany("INSERT INTO words VALUES (?, ?, ?)", rows)
    types = f"SELECT g, {q_bpe.d_sym('word')} AS sym, freq FROM words"
    sql = fx.oracle([], 'SELECT g, "left", "right", freq FROM merges ORDER BY g, rank', q_bpe.d_learn_staged(types, 70))
    got = {g: [] for g in corpora}
    for g, left, right, freq in con.execute(sql).fetchall():
        got[g].append((left, right, freq))
    assert any(len(m) == 70 for m in got.values())
    for g, words in corpora.items():
        assert got[g] == brute_learn(words, 70), g


def test_prepare_dataset_learns_all_merges(spark, tmp):
    r = random.Random(5)
    vocab = ["".join(r.choice("abcdeiou") for _ in range(r.randint(2, 7))) for _ in range(60)]
    rows = [(c, t, "user" if t % 2 == 0 else "assistant", " ".join(r.choice(vocab) for _ in range(12)) + r.choice([".", "?", ""]))
            for c in range(30) for t in range(4)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp}/conversations.parquet")
    df = queries()["prepare_dataset"](spark, tmp)
    cols = df.columns
    got = sorted(tuple(x) for x in df.collect())
    few = {(x.variant, x.side, x.split): x.tokens for x in flagship(spark, tmp, num_merges=8).collect()}
    assert all(x[cols.index("tokens")] < few[x[:3]] for x in got)  # 8 merges leave most words in more pieces
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{tmp}/conversations.parquet/*.parquet')")
    res = con.execute(oracles()["prepare_dataset"])
    order = [[d[0] for d in res.description].index(c) for c in cols]
    assert got == sorted(tuple(x[i] for i in order) for x in res.fetchall())
