"""L1/L2/W4/A10/J8 and the experiment-plan operators."""

import math

import pytest
from pyspark.sql import functions as F

from corpusprep.operators import experiments as ex
from corpusprep.operators import logs as lg


def test_extract_metrics_cases(spark):
    df = spark.createDataFrame([("r", 0, "validation BLEU: nan"), ("r", 1, "Train perplexity: 1e5"),
                                ("r", 2, "validation bleu: 3"), ("r", 3, "Validation accuracy: 1.2.3"),
                                ("r", 4, "validation BLEU: 2 Train accuracy:\t7.5")],
                               "run string, line_no long, text string")
    got = sorted((r.line_no, r.metric, r.value) for r in lg.extract_metrics(df, keep=["run", "line_no"]).collect())
    assert got[0][0:2] == (0, "bleu") and math.isnan(got[0][2])
    assert got[1] == (1, "train_ppl", 1.0)
    assert got[2] == (3, "acc", None)
    assert got[3:] == [(4, "bleu", 2.0), (4, "train_acc", 7.5)]


def test_best_per_run_ignores_nan(spark):
    df = spark.createDataFrame([("r", "bleu", 1, 1.0), ("r", "bleu", 2, float("nan")), ("r", "bleu", 3, 2.0),
                                ("r", "bleu", 4, 2.0)], "run string, metric string, ordinal long, value double")
    r = lg.best_per_run(df).first()
    assert (r.max_value, r.best_ordinal, r.n_values) == (2.0, 3, 4)


def test_with_ordinal(spark):
    df = spark.createDataFrame([("a", "m", 10), ("a", "m", 3), ("b", "m", 7)], "run string, metric string, line_no long")
    got = sorted((r.run, r.line_no, r.ordinal) for r in lg.with_ordinal(df).collect())
    assert got == [("a", 3, 1), ("a", 10, 2), ("b", 7, 1)]


GRID = {"A": ["x", "y"], "B": [1, 2, 3], "C": [0.5]}


def test_grid_order(spark):
    rows = [(r.config_id, r.A, r.B, r.C) for r in ex.config_grid(spark, GRID).orderBy("config_id").collect()]
    assert rows == [(i, *vals) for i, vals in enumerate([(a, b, c) for a in "xy" for b in (1, 2, 3) for c in (0.5,)])]


def test_freeze_and_sample(spark):
    g = ex.config_grid(spark, GRID)
    assert ex.freeze(g, {"A": "x", "UNKNOWN": 3}).count() == 3
    with pytest.raises(ValueError):
        ex.freeze(g, {"A": ["x"]})
    assert ex.sample_configs(g, 1.0).count() == 6
    assert ex.sample_configs(g, 0.0).count() == 0


def test_must_include_and_plan(spark):
    g = ex.config_grid(spark, GRID)
    picks = ex.must_include(g, {"B": [1, 3]}, seed=5)
    assert sorted(r.B for r in picks.collect()) == [1, 3]
    with pytest.raises(ValueError):
        ex.must_include(g, {"B": [1]}, frozen={"B": 2})
    plan = ex.plan_experiments(spark, GRID, perc=1.0, frozen={"A": "y"})
    rows = [(r.run, r.A, r.B) for r in plan.orderBy("run").collect()]
    assert rows == [("output_0", "y", 1), ("output_1", "y", 2), ("output_2", "y", 3)]
    assert ex.dedupe_configs(g.union(g), list(GRID)).count() == 6


def test_render_template_and_links(spark):
    settings = {"LEARNING_RATE": [0.002], "LEARNING_RATE_DECAY": [0.95], "HIDDEN_SIZE": [64], "WORD_VEC_SIZE": [-1]}
    plan = ex.plan_experiments(spark, settings)
    tpl = "OUTPUT_PATH_PER_RUN: LEARNING_RATE LEARNING_RATE_DECAY WORD_VEC_SIZE"
    text = ex.render_template(plan, tpl, settings).first()["config_text"]
    assert text == "output_0: 0.002 0.95 64"
    assert ex.resolve_links(plan).first()["WORD_VEC_SIZE"] == 64
