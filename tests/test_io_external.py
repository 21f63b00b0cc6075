"""Sources, sinks, external calls and streaming."""

import os

import pytest
from pyspark.sql import functions as F

from corpusprep.operators import bpe_learn as bl
from corpusprep.operators.external import map_batches, run_resumable
from corpusprep.sources import lines as src
from corpusprep.sources.sinks import write_merges, write_parallel


def write(path, text):
    with open(path, "w", encoding="utf-8") as f:
        f.write(text)


def test_read_lines_positions(spark, tmp):
    write(os.path.join(tmp, "a.txt"), "".join(f"a{i}\n" for i in range(50)))
    write(os.path.join(tmp, "b.txt"), "b0\nb1\n")
    got = sorted((os.path.basename(r.path), r.line_no, r.text) for r in src.read_lines(spark, tmp, with_path=True).collect())
    assert [x for x in got if x[0] == "a.txt"] == [("a.txt", i, f"a{i}") for i in range(50)]
    assert [x for x in got if x[0] == "b.txt"] == [("b.txt", 0, "b0"), ("b.txt", 1, "b1")]


def test_keyed_tsv(spark, tmp):
    p = os.path.join(tmp, "k.tsv")
    write(p, "# comment\nk1\thello\nbad line\nk2\tx\ty\n")
    got = sorted((r.line_no, r.key, r.text, r.reason) for r in src.read_keyed_tsv(spark, p).collect())
    assert got == [(1, "k1", "hello", None), (2, None, None, "bad_arity"), (3, None, None, "bad_arity")]


def test_merges_io(spark, tmp):
    p = os.path.join(tmp, "codes")
    write(p, "#version: 0.2\na b\nc d\na b\n")
    m, v = src.read_merges(spark, p)
    assert v == (0, 2)
    assert sorted((r.rank, r.left, r.right) for r in m.collect()) == [(0, "a", "b"), (1, "c", "d")]
    p2 = os.path.join(tmp, "codes01")
    write(p2, "x y\n")
    m2, v2 = src.read_merges(spark, p2)
    assert v2 == (0, 1) and [(r.rank, r.left) for r in m2.collect()] == [(0, "x")]
    out = os.path.join(tmp, "out_codes")
    write_merges(m, out)
    back, v3 = src.read_merges(spark, out)
    assert v3 == (0, 2) and sorted(back.collect()) == sorted(m.collect())


def test_vocab_and_word_counts(spark, tmp):
    p = os.path.join(tmp, "v")
    write(p, "ab 5\ncd 1\nef 3\n")
    assert sorted(r.token for r in src.read_vocab(spark, p, threshold=3).collect()) == ["ab", "ef"]
    p2 = os.path.join(tmp, "w")
    write(p2, "a 1\nb 2\na 3\n")
    assert {r.word: r.freq for r in src.read_word_counts(spark, p2).collect()} == {"a": 3, "b": 2}


def test_parse_records(spark):
    df = spark.createDataFrame([(0, "{'nyn_text': 'x', 'eng_text': 'y', 'other': 1}"), (1, "{'nyn_text': 3}"),
                                (2, "not a dict")], "line_no long, line string")
    got = sorted((r.line_no, r.nyn_text, r.eng_text, r.reason) for r in src.parse_records(df, "line", ["nyn_text", "eng_text"]).collect())
    assert got == [(0, "x", "y", None), (1, None, None, "not_string:nyn_text"), (2, None, None, "unparsable")]


def test_write_parallel_aligned(spark, tmp):
    rows = [(i, f"s{i}", f"t{i}") for i in range(40)] + [(99, "bad\nline", "t")]
    df = spark.createDataFrame(rows, "line_no long, src string, tgt string")
    rej = write_parallel(df, os.path.join(tmp, "par"), partitions=3)
    assert rej.count() == 1
    s = spark.read.text(os.path.join(tmp, "par", "src")).collect()
    t = spark.read.text(os.path.join(tmp, "par", "tgt")).collect()
    assert len(s) == len(t) == 40

    def parts(side):
        d = os.path.join(tmp, "par", side)
        return {f[:10]: open(os.path.join(d, f)).read().split() for f in os.listdir(d) if f.startswith("part-")}

    ps, pt = parts("src"), parts("tgt")
    assert sorted(ps) == sorted(pt)
    for k in ps:  # part i of one side holds the same lines, in the same order, as part i of the other
        assert [x[1:] for x in ps[k]] == [x[1:] for x in pt[k]]


def flaky(texts):
    if texts == ["boom"]:
        raise RuntimeError("service failed")
    return [t.upper() for t in texts]


def test_map_batches_failures_are_rows(spark):
    df = spark.createDataFrame([(0, ["a"]), (1, ["boom"]), (2, ["c", "d"])], "batch_id long, texts array<string>")
    got = {r.batch_id: (r.status, r.outputs) for r in map_batches(df, flaky).collect()}
    assert got == {0: ("ok", ["A"]), 1: ("error", None), 2: ("ok", ["C", "D"])}


def test_run_resumable_idempotent(spark, tmp):
    store = os.path.join(tmp, "store")
    df = spark.createDataFrame([(0, ["a"]), (1, ["boom"])], "batch_id long, texts array<string>")
    first = {r.batch_id: r.status for r in run_resumable(df, store, flaky).collect()}
    assert first == {0: "ok", 1: "error"}
    again = run_resumable(df, store, flaky)
    assert spark.read.parquet(store).filter(F.col("batch_id") == 0).count() == 1  # batch 0 not called again
    assert {r.batch_id: r.status for r in again.collect()} == {0: "ok", 1: "error"}


def noted(path, fail=()):
    """A function that notes every call in a file of its own."""
    def call(texts):
        import uuid
        with open(os.path.join(path, uuid.uuid4().hex), "w") as f:
            f.write("|".join(texts))
        if any(x in t for x in fail for t in texts):
            raise RuntimeError("x" * 3000)
        return [t.upper() for t in texts]
    return call


def calls(path):
    return sorted(open(os.path.join(path, f)).read() for f in os.listdir(path))


def test_run_that_dies_loses_one_wave(spark, tmp):
    """The second wave ends the job; what the first wave called is not called again."""
    store, log = os.path.join(tmp, "store"), os.path.join(tmp, "log")
    os.makedirs(log)
    df = spark.createDataFrame([(k, [f"t{k}"]) for k in range(12)], "batch_id long, texts array<string>").repartition(2)
    ok = noted(log)

    def dies(texts):
        raise SystemExit("worker gone")
    wave = df.filter(F.pmod(F.xxhash64("batch_id"), F.lit(3)) == 0)
    run_resumable(wave, store, ok)  # what a run of three waves had committed when it died
    with pytest.raises(Exception):
        run_resumable(df, store, dies, waves=3, commit="wave")
    before = len(calls(log))
    got = run_resumable(df, store, ok, waves=3, commit="wave")
    assert {r.batch_id: r.outputs for r in got.collect()} == {k: [f"T{k}"] for k in range(12)}
    assert before > 0 and calls(log) == sorted(f"t{k}" for k in range(12))


def test_run_that_dies_calls_only_unfinished_batches(spark, tmp):
    """Default arguments; the worker is gone in the middle of the job."""
    store, log = os.path.join(tmp, "store"), os.path.join(tmp, "log")
    os.makedirs(log)
    df = spark.createDataFrame([(k, [f"t{k}"]) for k in range(12)], "batch_id long, texts array<string>").repartition(3, "batch_id")
    ok, at = noted(log, fail=["t4"]), os.path.join(tmp, "dead")

    def dies(texts):
        if texts == ["t9"] and not os.path.exists(at):
            open(at, "w").close()
            os._exit(1)
        return ok(texts)
    with pytest.raises(Exception):
        run_resumable(df, store, dies)
    # tasks of the dead job may still be at a call; wait until none writes any more
    import time
    before = None
    while before != (before := calls(log)):
        time.sleep(3)
    assert 0 < len(before) < 12 and not os.path.exists(os.path.join(store, "_SUCCESS"))
    notes = [f.split("-")[0] for f in os.listdir(os.path.join(store, "_progress")) if f.endswith(".json") and not f.startswith(".")]
    finished = {int(k) for k in notes} - {4}
    assert finished and len(notes) >= len(before) - 2  # at most one call of each other task was under way
    got = {r.batch_id: (r.status, r.outputs) for r in run_resumable(df, store, dies).collect()}
    assert got == {k: ("error", None) if k == 4 else ("ok", [f"T{k}"]) for k in range(12)}
    after = calls(log)
    assert sorted(set(after)) == sorted(f"t{k}" for k in range(12))
    assert all(after.count(f"t{k}") == 1 for k in finished)  # what was finished is never called again
    assert not os.path.exists(os.path.join(store, "_progress"))
    run_resumable(df, store, ok)
    assert len(calls(log)) == len(after) + 1


def test_rewrite_lines_keeps_every_batch_and_calls_once(spark, tmp):
    from corpusprep.operators.external import rewrite_lines
    log = os.path.join(tmp, "log")
    os.makedirs(log)
    inner = noted(log, fail=["boom"])

    def fn(prompt):
        text = inner([prompt])[0]
        return "" if "EMPTY" in text else "1. A" if "SHORT" in text else prompt.split("\n\n", 1)[1]
    rows = [(b, i, f"{w} {i}") for b, w in enumerate(["fine", "boom", "empty", "short"]) for i in range(2)]
    df = spark.createDataFrame(rows, "b int, i long, t string")
    out = rewrite_lines(df, fn, "t", "i", ["b"], "Header:").collect()
    assert len(calls(log)) == 4
    got = sorted((r.b, r.pos, r.line, r.n_in, r.n_out, r.status, r.shifted) for r in out)
    assert got == [(0, 0, "fine 0", 2, 2, "ok", False), (0, 1, "fine 1", 2, 2, "ok", False), (1, None, None, 2, 0, "error", True),
                   (2, None, None, 2, 0, "ok", True), (3, 0, "A", 2, 1, "ok", True)]


def test_to_pairs_keeps_lines_of_failed_batches(spark):
    from corpusprep.operators.external import to_pairs
    lines = spark.createDataFrame([(b, p, f"l{b}{p}") for b in range(4) for p in range(2)], "batch_id long, pos long, text string")
    out = spark.createDataFrame([(0, ["A", "B"], "ok"), (1, None, "error"), (2, ["C"], "ok")], "batch_id long, outputs array<string>, status string")
    got = sorted((r.batch_id, r.pos, r.src, r.tgt, r.status) for r in to_pairs(lines, out, ["batch_id"]).collect())
    assert got == [(0, 0, "A", "l00", "ok"), (0, 1, "B", "l01", "ok"), (1, 0, None, "l10", "error"), (1, 1, None, "l11", "error"),
                   (2, 0, "C", "l20", "ok"), (2, 1, None, "l21", "no_output"), (3, 0, None, "l30", "no_batch"), (3, 1, None, "l31", "no_batch")]


def test_whole_error_text(spark, tmp):
    df = spark.createDataFrame([(0, ["boom"])], "batch_id long, texts array<string>")
    os.makedirs(os.path.join(tmp, "l"))
    assert len(map_batches(df, noted(os.path.join(tmp, "l"), ["boom"])).first()["error"]) > 3000


def test_streaming_row_operators(spark, tmp):
    from corpusprep.streaming.lines import metrics_stream, normalise_stream, read_line_stream, segment_stream, to_parquet
    inbox = os.path.join(tmp, "inbox", "output_3")
    os.makedirs(inbox)
    write(os.path.join(inbox, "train.log"), "validation BLEU: 12.5\nfoo, bar.\n")
    lines = read_line_stream(spark, os.path.join(tmp, "inbox", "*"))
    q = to_parquet(metrics_stream(lines), os.path.join(tmp, "m"), os.path.join(tmp, "cp1"), available_now=True)
    q.awaitTermination(120)
    got = [(r.run, r.metric, r.value) for r in spark.read.parquet(os.path.join(tmp, "m")).collect()]
    assert got == [("output_3", "bleu", 12.5)]
    merges = [("b", "a"), ("ba", "r</w>")]
    q2 = to_parquet(segment_stream(normalise_stream(lines), merges), os.path.join(tmp, "s"),
                    os.path.join(tmp, "cp2"), available_now=True)
    q2.awaitTermination(120)
    enc = sorted(r.enc for r in spark.read.parquet(os.path.join(tmp, "s")).collect())
    assert "f@@ o@@ o , bar ." in enc


def test_dataset_and_score_sinks(spark, tmp):
    from corpusprep.sources.sinks import write_dataset, write_scores
    df = spark.createDataFrame([("all", "eng", "train", 0, "a b"), ("bible", "nyn", "dev", 1, "c")],
                               "variant string, lang string, split string, line_no long, text string")
    write_dataset(df, os.path.join(tmp, "ds"))
    back = spark.read.parquet(os.path.join(tmp, "ds")).filter(F.col("variant") == "bible")
    assert [(r.lang, r.split, r.text) for r in back.collect()] == [("nyn", "dev", "c")]
    scores = spark.createDataFrame([("output_0", "bleu", 1, 3.5), ("output_0", "bleu", 2, 4.0)],
                                   "run string, metric string, ordinal long, value double")
    best = spark.createDataFrame([("output_0", "bleu", 4.0, 2, 2)],
                                 "run string, metric string, max_value double, best_ordinal long, n_values long")
    write_scores(scores, best, os.path.join(tmp, "sc"))
    assert spark.read.parquet(os.path.join(tmp, "sc", "series")).count() == 2
    assert spark.read.json(os.path.join(tmp, "sc", "best")).first()["max_value"] == 4.0


def test_read_predictions_and_logs(spark, tmp):
    d = os.path.join(tmp, "results", "output_7")
    os.makedirs(d)
    write(os.path.join(d, "preds_model_step_256.txt"), "lo@@ w\nx\n")
    write(os.path.join(d, "train.log"), "validation BLEU: 1.5\n")
    p = src.read_predictions(spark, os.path.join(tmp, "results", "output_*", "preds*.txt"))
    assert sorted((r.run, r.step, r.line_no, r.text) for r in p.collect()) == \
        [("output_7", 256, 0, "lo@@ w"), ("output_7", 256, 1, "x")]
    lg = src.read_logs(spark, os.path.join(tmp, "results", "output_*", "*.log"))
    assert [(r.run, r.line_no, r.text) for r in lg.collect()] == [("output_7", 0, "validation BLEU: 1.5")]
