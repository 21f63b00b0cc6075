"""``read_merges``: the numbered lines, the rules and the plan of the merge-table query."""

import random
import re

import pytest
from pyspark.sql import functions as F

from corpusprep.functions import text as tx
from corpusprep.plans import q_text
from corpusprep.plans.registry import queries
from corpusprep.sources.lines import parse_merges


def rules_of(docs):
    """What the query gives for ``(doc_id, text)`` in the order of ids, NULL first."""
    out, line = {}, 0
    copies = {}
    for i, text in docs:
        copies.setdefault(i, []).append((text or "").split("\n") if text is not None else [])
    for i in sorted(copies, key=lambda x: (x is not None, x or 0)):
        for n in range(max(map(len, copies[i]))):
            for lines in copies[i]:
                if n < len(lines):
                    t = lines[n].split()
                    for pos, pair in enumerate(zip(t, t[1:])):
                        out.setdefault(pair, line * 1_000_000_000 + pos)
                    line += 1
    return sorted((r, a, b) for (a, b), r in out.items())


def write(spark, path, docs):
    spark.createDataFrame(docs, "doc_id long, text string").repartition(3).write.parquet(f"{path}/documents.parquet")


def some_docs():
    r = random.Random(3)
    word = lambda: r.choice("abcdefé") + r.choice("xyz\U0001F600")
    docs = [(i, "\n".join(r.choice([" ", "\t", "　 ", "  "]).join(word() for _ in range(r.randint(0, 9))) for _ in range(r.randint(1, 5))))
            for i in r.sample(range(1000), 40)]
    return docs + [(2000, None), (2001, ""), (2002, "\n\na b\n")]


@pytest.mark.parametrize("more", [[], [(2002, "\n\na b\n")], [(None, "q r\ns t")], [(None, "q r"), (None, "q r")]])
def test_rules_of_documents(spark, tmp, more):
    docs = some_docs() + more
    write(spark, tmp, docs)
    got = queries()["read_merges"](spark, tmp)
    assert got.columns == ["rank", "left", "right"]
    assert sorted(map(tuple, got.collect())) == rules_of(docs)


def test_lines_of_any_white_space(spark):
    lines = ["#version: 0.2", "a b", " a\t b ", "　c\x85d ", "a", "", "   ", None, "a b c", "é  x", "e    x", "a  b", "x \U0001F600", "x\x1fy"]
    df = spark.createDataFrame(list(enumerate(lines)), "line_no long, text string")
    want = {}
    for i, t in enumerate(lines[1:]):
        f = (t or "").split()
        if len(f) == 2:
            want.setdefault(tuple(f), i)
    assert sorted(map(tuple, parse_merges(df).collect())) == sorted((r, a, b) for (a, b), r in want.items())


def test_one_spaced_is_normalise_ws(spark):
    assert "".join(sorted(tx.WS_CHARS)) == "".join(c for c in map(chr, range(0x110000)) if c.isspace())
    texts = [x + c + y for c in tx.WS_CHARS for x in ("", "a", "é ") for y in ("", "b", " é")] + ["a", "", " a  b   c "]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert df.where(tx.one_spaced("t") != tx.normalise_ws("t")).count() == 0
    assert [r[0] for r in df.select(tx.one_spaced("t")).collect()] == [" ".join(t.split()) for t in texts]


def test_no_text_is_shuffled_and_no_line_goes_with_each_token(spark, tmp):
    write(spark, tmp, some_docs())
    plan = q_text._merge_lines(spark, tmp)._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"Exchange (?!HashedRelation)", plan.replace("BroadcastExchange", "Exchange"))
    carried = re.findall(r"Generate posexplode\([^\n]*\), \[([^\]]*)\], true", plan)
    assert carried and all("," not in c for c in carried)  # the line's number alone, not its words
