"""J1-J4, W5 hand cases."""

import pytest

from corpusprep.operators.align import (UnalignedLinesError, align_by_key, alignment_rejects,
                                        last_per_key, pending_batches, zip_lines)

SCHEMA = "line_no long, key string, text string"


def test_align_by_key_and_rejects(spark):
    src = spark.createDataFrame([(0, "k", "a"), (1, "k", "b"), (2, "m", "c"), (3, "n", ""), (4, "s", " ")], SCHEMA)
    tgt = spark.createDataFrame([(0, "k", "x"), (1, "k", "y"), (2, "n", "z"), (3, "s", "w")], SCHEMA)
    pairs = sorted((r.pair_id, r.src, r.tgt) for r in align_by_key(src, tgt).collect())
    assert pairs == [(0, "a", "y"), (1, "b", "y"), (4, " ", "w")]  # last target wins, ' ' is not empty
    rej = sorted((r.key, r.reason) for r in alignment_rejects(src, tgt).collect())
    assert rej == [("m", "not_in_target"), ("n", "src_empty")]


def test_tgt_empty_reason(spark):
    src = spark.createDataFrame([(0, "k", "a")], SCHEMA)
    tgt = spark.createDataFrame([(0, "k", "x"), (1, "k", "")], SCHEMA)
    assert [r.reason for r in alignment_rejects(src, tgt).collect()] == ["tgt_empty"]
    assert align_by_key(src, tgt, lowercase=True).count() == 0


def test_last_per_key(spark):
    df = spark.createDataFrame([(1, "a", "x"), (5, "a", "y"), (3, "a", "z")], SCHEMA)
    assert last_per_key(df, "key", "line_no", "text").first()["text"] == "y"


def test_zip_lines(spark):
    a = spark.createDataFrame([(0, "p"), (1, "q")], "line_no long, text string")
    b = spark.createDataFrame([(0, "P")], "line_no long, text string")
    with pytest.raises(UnalignedLinesError):
        zip_lines(a, b)
    st = {r.line_no: r.status for r in zip_lines(a, b, strict=False).collect()}
    assert st == {0: "ok", 1: "a_only"}


def test_pending_batches(spark):
    b = spark.createDataFrame([(0,), (1,), (2,)], "batch_id long")
    done = spark.createDataFrame([(0, ["x"]), (1, [])], "batch_id long, outputs array<string>")
    assert sorted(r.batch_id for r in pending_batches(b, done).collect()) == [1, 2]
