import random
from collections import Counter, defaultdict

import pytest

from edge_rows import SMALL, edge  # noqa: F401

from corpusprep.llm import queries as Q
from corpusprep.llm.line_templates import COPY, DEPTH, drop_templates, merge_leaf, parse, sketch


def brute(texts):
    """Text by text: the numbers of the dropped lines. Copies by every pair of texts."""
    hosts, leaves, of = defaultdict(Counter), defaultdict(dict), {}
    sketches = {t: x for t in set(texts) if (x := sketch(t)) is not None}
    host = {t: t for t in set(texts)}
    for a in sketches:
        for b in sketches:
            if host[a] != host[b] and (sketches[a] == sketches[b]).sum() >= COPY:
                host = {t: host[a] if h == host[b] else h for t, h in host.items()}
    for t in set(texts):
        parsed = [parse(x) for x in (t or "").split("\n")]
        for tokens in {tuple(x) for x in parsed if x}:
            hosts[tokens][host[t]] += 1
            leaves[(len(tokens), tokens[:DEPTH])].setdefault(tokens, None)
    for t in set(texts):
        for line in (t or "").split("\n"):
            tokens = tuple(parse(line))
            if tokens:
                old = leaves[(len(tokens), tokens[:DEPTH])][tokens]
                leaves[(len(tokens), tokens[:DEPTH])][tokens] = line if old is None else min(old, line)
    for leaf in leaves.values():
        if len(leaf) > 1 and sum(len(hosts[x]) for x in leaf) >= 3:
            for tokens, template, _ in merge_leaf([(x, list(x)) for x in sorted(leaf, key=lambda x: leaf[x])]):
                of[tokens] = template
    total = defaultdict(Counter)
    for tokens, c in hosts.items():
        total[of.get(tokens, tokens)].update(c)
    bad = {k for k, c in total.items() if len(c) >= 3}
    return {t: [n for n, x in enumerate((t or "").split("\n")) if parse(x) and of.get(tuple(parse(x)), tuple(parse(x))) in bad] for t in set(texts)}


def test_query_equals_brute_force(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    want = brute(list(texts.values()))
    got = Q.op10_line_template_dedup(spark, SMALL).collect()
    assert len(got) == len(texts) and any(r["n_dropped"] for r in got)
    for r in got:
        t = texts[r["doc_id"]]
        assert r["dropped"] == want[t] and r["n_dropped"] == len(want[t])
        assert r["text"] == "\n".join(x for n, x in enumerate(t.split("\n")) if n not in want[t])


def test_templates_and_copies(spark):
    own = "sentence number is told here in many different words by author"
    docs = []
    for k in range(6):
        name = "abcdef"[k] * 4
        docs.append((k, f"{name} {own} {name} {name} and more of it\nPosted by user {name} in the news section today\nPage {k} of 9\n{name} {own} again"))
    copied = "a document of its own that was copied often and edited a little at the end"
    docs += [(10 + k, f"{copied} {'x' * k}\nits second line stands in all copies\nits third line too") for k in range(5)]
    docs += [(20 + k, "an exact copy stands here with a line\nof its own") for k in range(9)]
    docs += [(None, None), (30, ""), (31, "\n\n")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r["doc_id"]: r for r in drop_templates(df).collect()}
    for k in range(6):
        assert got[k]["dropped"] == [1, 2], got[k]
    for k in (*range(10, 15), *range(20, 29), 30, 31):
        assert got[k]["n_dropped"] == 0 and got[k]["text"] == dict(docs)[k]
    assert got[None]["text"] is None and got[None]["n_lines"] == 0


def test_repeated_longest_line_and_copies(spark):
    """A notice that is the longest line of different documents goes, also where it and a footer
    stand in a large group of copies; the copies' own lines stay."""
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(7))
    line = lambda: " ".join(word() for _ in range(10))
    notice = " ".join(f"notice{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(60))
    docs = [(k, "\n".join([line(), notice, line(), "Share this page with friends", line()])) for k in range(40)]
    own = [line() for _ in range(12)]
    for k in range(300):  # one or two lines edited in each copy
        copy = list(own)
        for at in rng.sample(range(12), 1 + k % 2):
            copy[at] = " ".join([word(), *copy[at].split()[1:]])
        docs.append((1000 + k, "\n".join([*copy[:6], notice, *copy[6:], "Share this page with friends"])))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r["doc_id"]: r["dropped"] for r in drop_templates(df).collect()}
    assert {tuple(got[k]) for k in range(40)} == {(1, 3)}
    assert {tuple(v) for k, v in got.items() if k >= 1000} == {(6, 13)}
    # without the other documents the copies are one host
    assert all(not r["dropped"] for r in drop_templates(df.where("doc_id >= 1000")).collect())
    assert {tuple(r["dropped"]) for r in drop_templates(df.where("doc_id < 40")).collect()} == {(1, 3)}


@pytest.mark.parametrize("n_own", [3, 6])
def test_boilerplate_heavy_texts(spark, n_own):
    """Different documents of which most lines are the same boilerplate lose exactly these lines."""
    rng = random.Random(n_own)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(6))
    line = lambda: " ".join(word() for _ in range(10))
    shared = [line() for _ in range(4)]
    docs = [(k, "\n".join(shared[:2] + [line() for _ in range(n_own)] + shared[2:])) for k in range(60)]
    own = [line() for _ in range(12)]
    docs += [(100 + k, "\n".join(own[:k] + [own[k] + " edited"] + own[k + 1:])) for k in range(8)]  # near copies stay whole
    got = {r["doc_id"]: r["dropped"] for r in drop_templates(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert {tuple(got[k]) for k in range(60)} == {(0, 1, n_own + 2, n_own + 3)}
    assert all(not got[100 + k] for k in range(8))


def test_sketches_estimate_similarity(monkeypatch):
    rng = random.Random(8)
    off = []
    for _ in range(150):
        a = [f"w{rng.randrange(5000)}" for _ in range(rng.randrange(40, 400))]
        b = [x if rng.random() > 0.05 else f"w{rng.randrange(5000)}" for x in a]
        p, q = ({tuple(x[i:i + 3]) for i in range(len(x) - 2)} for x in (a, b))
        off.append((sketch(" ".join(a)) == sketch("\n".join(b).upper())).mean() - len(p & q) / len(p | q))
    assert abs(sum(off) / len(off)) < 0.02 and max(map(abs, off)) < 0.3
    text = " ".join(f"w{rng.randrange(500)}" for _ in range(2000))
    whole = sketch(text)
    monkeypatch.setattr("corpusprep.llm.line_templates.CHUNK", 700)
    assert (sketch(text) == whole).mean() > 0.9  # only the shingles across cuts are missing
    assert sketch(" \n ") is None and sketch(None) is None and (sketch("one") == sketch("ONE")).all()


def plain_merge(lines):
    """Every line against every template of its leaf."""
    groups = []
    for h, tokens in lines:
        same = [sum(a == b for a, b in zip(g, tokens) if a != "<*>") for g, _ in groups]
        k = same.index(max(same)) if same else None
        if k is not None and same[k] >= max(5, 0.8 * len(tokens)):
            groups[k][0][:] = [a if a == b else "<*>" for a, b in zip(groups[k][0], tokens)]
            groups[k][1].append(h)
        else:
            groups.append((list(tokens), [h]))
    return sorted((h, " ".join(g)) for g, members in groups if len(members) > 1 for h in members)


def test_merge_equals_every_pair():
    rng = random.Random(1)
    for n in range(1, 26):
        for prefix in (["a", "b", "c"], ["a", "<*>", "c"]):
            base = [[rng.choice("xyz") for _ in range(n)] for _ in range(4)]
            lines = {tuple(prefix[:n] + [t if rng.random() > 0.12 else rng.choice(["u", "v", "<*>"]) for t in rng.choice(base)][3:]) for _ in range(120)}
            lines = [(k, list(x)) for k, x in enumerate(sorted(lines))]
            assert sorted((h, name) for h, _, name in merge_leaf(lines)) == plain_merge(lines)


def test_many_names_give_one_template(spark):
    """An over-full leaf: one template of 3,000 names, beside lines that only begin like it."""
    other = "Posted by user {0} {1} about {0}{1} other and {1}{0} things"
    name = lambda k: "".join(chr(97 + k // 26**j % 26) for j in range(4))
    docs = [(k, f"{name(k)} tells a story of {name(k * 7 + 1)} and many others which is long and its own\nPosted by user {name(k)} in the news section today\n"
                + other.format(name(k), name(k + 1))) for k in range(3000)]
    got = drop_templates(spark.createDataFrame(docs, "doc_id long, text string")).select("dropped").distinct().collect()
    assert [r["dropped"] for r in got] == [[1]]


def test_edge_rows(spark, edge):
    out = drop_templates(edge.withColumn("dropped", edge["doc_id"]).withColumn("x", edge["doc_id"])
                         .withColumn("__KEY", edge["doc_id"]).withColumn("__k", edge["doc_id"]).withColumn("__Dropped", edge["doc_id"]))
    assert all(r["__KEY"] == r["__k"] == r["__Dropped"] == r["doc_id"] for r in out.collect())
    assert sorted(str(r["text"]) for r in out.collect()) == sorted(str(r["text"]) for r in edge.collect())
    assert drop_templates(edge.limit(0)).count() == 0
