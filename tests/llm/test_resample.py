import hashlib
import math
import re
from collections import Counter
from zlib import crc32

from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusprep.llm import resample as rs

from edge_rows import SMALL, edge  # noqa: F401


def features(text):
    """The runs of one and two words, by the plain definition."""
    lower = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)
    return w, w + [f"{a} {b}" for a, b in zip(w, w[1:])]


def brute(docs, items):
    bucket = lambda f: crc32(f.encode()) % 10000
    per = [(d, *features(t)) for d, t in docs]
    s = Counter(bucket(f) for _, _, fs in per for f in fs)
    t = Counter(bucket(f) for x in items for f in features(x)[1])
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log(((t[b] + 1) * (big_s + 10000)) / ((s[b] + 1) * (big_t + 10000))))
    rows = []
    for d, w, fs in per:
        weight = sum(gain(bucket(f)) for f in fs) // len(fs) if fs else 0
        h = int(hashlib.sha256(f"7:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        rows.append([d, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(w)])
    fit = sorted((r for r in rows if r[5] >= 20), key=lambda r: (-r[3], r[0] is None, r[0], r[1], r[2]))
    for i, r in enumerate(fit[:25 * len(fit) // 100]):
        r[4] = i + 1
    return sorted((tuple(r[:5]) for r in rows), key=str)


@given(st.text(alphabet="aB9 -éİ\U0001F600\x85\xa0_\t\n", max_size=40))
def test_spans_are_all_runs(text):
    line, pattern = rs.words_line(text), rs.span_pattern(2)
    got = [line[a:b].decode() for a, b in rs.feature_spans(line, pattern)]
    assert sorted(got) == sorted(features(text)[1])


def test_runs_of_three():
    line = rs.words_line("a bb  c-d")
    assert [line[a:b] for a, b in rs.feature_spans(line, rs.span_pattern(3), 3)] == \
        [b"a", b"a bb", b"a bb c", b"bb", b"bb c", b"bb c d", b"c", b"c d", b"d"]


def test_query_equals_brute_force(spark):
    from corpusprep.llm.queries import op11_overlapped_resample
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    items = [r.text for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    got = op11_overlapped_resample(spark, SMALL)
    assert [f.dataType.simpleString() for f in got.schema][:5] == ["bigint"] * 5
    rows = sorted((tuple(r) for r in got.select("doc_id", "n_features", "weight", "score", "rank").collect()), key=str)
    assert rows == brute(docs, items) and sum(r[4] is not None for r in rows) > 20


def test_edge_rows(spark, edge):  # noqa: F811
    more = edge.unionByName(spark.createDataFrame([(50 + i // 2, " ".join(f"w{j}" for j in range(30))) for i in range(8)], "doc_id long, text string"),
                            allowMissingColumns=True)
    target = spark.createDataFrame([(1, "w1 w2 w3", 2), (2, None, 3)], "item_id long, text string, n long")
    docs = [(r.doc_id, r.text) for r in more.collect()]
    assert sorted((tuple(r) for r in rs.resample(more, target).collect()), key=str) == brute(docs, ["w1 w2 w3", None])
    assert rs.resample(more.limit(0), target).count() == 0
    alone = {tuple(r) for r in rs.resample(more.where(F.col("doc_id") == 5), target.limit(0)).collect()}
    assert alone == set(brute([(5, "one")], []))


def test_long_text_and_one_long_word(spark):
    df = spark.createDataFrame([(1, "ab " * 400_000), (2, "x" * 3_000_000)], "doc_id long, text string")
    got = {r.doc_id: r.n_features for r in rs.resample(df, spark.createDataFrame([], "item_id long, text string")).collect()}
    assert got == {1: 799_999, 2: 1}
