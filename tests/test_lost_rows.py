"""Rows with NULL keys, NULL texts or no partner come back."""


from corpusprep.operators.align import alignment_rejects, zip_lines
from corpusprep.operators.metrics import corpus_bleu, corpus_chrf, score_runs
from corpusprep.operators.order import ordered_scan
from corpusprep.operators.stats import corpus_stats, word_counts
from corpusprep.sources.lines import merges_version, parse_keyed_lines


def test_ordered_scan_keeps_null_groups(spark):
    df = spark.createDataFrame([("a", 1), (None, 2), (None, 3), ("a", 4)], "g string, o long")
    got = sorted(((r.g, r.o, r.idx, r.s) for r in ordered_scan(df, ["o"], ["g"], {"s": "o"}).collect()), key=lambda x: x[1])
    assert got == [("a", 1, 0, 0), (None, 2, 0, 0), (None, 3, 1, 2), ("a", 4, 1, 1)]


def test_corpus_stats_of_a_null_group(spark):
    df = spark.createDataFrame([(None, "a b a"), (None, ""), ("x", "c"), ("x", None), ("y", "")], "g string, t string")
    got = {r.g: (r.lines, r.tokens, r.max_len, r.mean_len, r.distinct_words) for r in corpus_stats(df, "t", ["g"]).collect()}
    assert got[None] == (2, 3, 3, 1.5, 2) and got["y"] == (1, 0, 0, 0.0, 0) and got["x"][0] == 2


def test_rejected_lines_keep_their_reason(spark):
    src = parse_keyed_lines(spark.createDataFrame([(0, "k1\ta"), (1, "no tab"), (2, "k2\tb"), (3, "k3\t")], "line_no long, text string"))
    tgt = spark.createDataFrame([(0, "k1", "x")], "line_no long, key string, text string")
    assert {r.line_no: r.reason for r in alignment_rejects(src, tgt).collect()} == {1: "bad_arity", 2: "not_in_target", 3: "src_empty"}


def test_zip_tells_presence_from_rows(spark):
    a = spark.createDataFrame([(0, None), (1, "x"), (2, None)], "line_no long, text string")
    b = spark.createDataFrame([(0, None), (1, None), (3, None)], "line_no long, text string")
    assert {r.line_no: r.status for r in zip_lines(a, b, strict=False).collect()} == {0: "ok", 1: "ok", 2: "a_only", 3: "b_only"}


def test_score_runs_without_step_and_with_a_line_too_many(spark):
    refs = spark.createDataFrame([(k, f"the cat sat on mat {k}") for k in range(4)], "line_no long, text string")
    preds = spark.createDataFrame([("r", None, k, f"the cat sat on mat {k}") for k in range(5)] + [("r", 5, k, "the cat sat on a mat") for k in range(3)],
                                  "run string, step int, line_no long, text string")
    got = {r.step: r for r in score_runs(preds, refs).collect()}
    assert len(got) == 2 and (got[None].n_extra, got[None].n_missing, got[5].n_extra, got[5].n_missing) == (1, 0, 0, 1)
    assert got[None].bleu == 100.0 and got[None].chrf == 100.0
    plan = score_runs(preds, refs)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1


def test_plans_start_no_job(spark):
    df = spark.createDataFrame([("a b", "a b")], "h string, r string").groupBy("h", "r").count()
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("plan-only", "no job may start here")
    word_counts(df, "h"), corpus_bleu(df, "h", "r"), corpus_chrf(df, "h", "r")
    assert not tracker.getJobIdsForGroup("plan-only")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_version_line(spark):
    for line, want in (("#version: 0.2", (0, 2)), ("#version: 0.2.0", (0, 2)), ("#version: 1.0", (1,)), ("a b", (0, 1)), (None, (0, 1))):
        assert merges_version(spark.createDataFrame([(0, line)], "line_no long, text string")) == want
