import re

import pytest
from edge_rows import SMALL, edge  # noqa: F401

from corpusprep.llm import queries as Q
from corpusprep.llm.quality import clean_lines, quality

W = r"[^\x20\x09-\x0D]+"


def brute(text):
    t = text or ""
    w = re.findall(W, t)
    seen = {}
    for i in range(len(w) - 7):
        seen.setdefault(tuple(w[i:i + 8]), []).append(i)
    inside = {p + k for at in seen.values() if len(at) > 1 for p in at for k in range(8)}
    lines = [x for x in t.split("\n") if re.search(W, x)]
    n = len(w)
    return (n, sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(inside),
            n < 20 or 100 * len(inside) > 30 * n)


COLS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]


def test_stats_equal_brute_force(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    got = Q.op1_quality_rules(spark, SMALL).collect()
    assert len(got) == len(texts)
    for r in got:
        assert tuple(r[c] for c in COLS) == brute(texts[r["doc_id"]]), r["doc_id"]
        assert not (r["base_failed"] and r["kept"])


def test_edge_rows(spark, edge):
    rows = quality(edge).collect()
    assert len(rows) == edge.count()
    for r in rows:
        assert tuple(r[c] for c in COLS) == brute(r["text"])
    assert quality(edge.limit(0)).count() == 0


@pytest.mark.parametrize("line,rule", [
    ("A plain sentence that ends well.", None), ("Home", "navigation"), ("Home | About | Contact", "navigation"),
    ("All rights reserved.", "boilerplate"), ("We use cookies.", "boilerplate"), ("word### other*** more$$$ and%%% so&&&", "symbol"),
    ("A TITLE WITHOUT END", "unfinished"), ("BUY!! NOW!! CHEAP!! PILLS!! HERE!! GO!!", "symbol"),
    ("a long line of prose, with a comma and many words but cut off in the mid", None)])
def test_line_rules(spark, line, rule):
    r = clean_lines(spark.createDataFrame([(line,)], "text string")).first()
    got = [k[5:] for k in r.asDict() if k.startswith("lost_") and k != "lost_share" and r[k]]
    assert got == ([rule] if rule else [])
    assert r["rejected"] == bool(rule) and r["clean_text"] == ("" if rule else line)


def test_labelled_documents(spark):
    """Clean documents stay, junk goes (labels of sf0.01)."""
    d = "/root/testdata/sf0.01"
    got = Q.op1_quality_rules(spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").where("n_words >= 20").collect()
    good, bad = [r for r in got if r["quality"]], [r for r in got if not r["quality"]]
    assert sum(r["kept"] for r in good) >= 0.99 * len(good) and sum(r["kept"] for r in bad) <= 0.1 * len(bad)


def test_trails_of_any_length(spark):
    """Matched by a loop: recursion per cell would end the JVM."""
    rows = [(1, "| a " * 100_000), (2, "| a " * 100_000 + "b" * 60), (3, "a | b"), (4, "a | b | c"), (5, "x" * 41 + " | b | c"), (6, "||"), (7, "a » b\r")]
    got = {r.k: r.lost_navigation for r in clean_lines(spark.createDataFrame(rows, "k int, text string")).collect()}
    assert got == {1: 1, 2: 0, 3: 0, 4: 1, 5: 0, 6: 1, 7: 0}
