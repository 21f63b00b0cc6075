"""Outputs of several tables: all or nothing, and round trips through the readers."""

import glob
import json
import os

import pytest
from pyspark.sql import functions as F

from corpusprep.operators.logs import best_per_run
from corpusprep.plans.flagship import prepare
from corpusprep.sources import lines as src
from corpusprep.sources import sinks

from conftest import SMALL


def lines_of(folder):
    """The lines of the part files, read by name."""
    return [x for f in sorted(glob.glob(f"{folder}/part-*")) for x in open(f, encoding="utf-8").read().splitlines()]


def test_nothing_is_visible_after_a_failure(spark, tmp):
    path, df = os.path.join(tmp, "out"), spark.createDataFrame([("a",)], "value string")

    def fails(at):
        raise RuntimeError("disk full")
    with pytest.raises(RuntimeError):
        sinks.write_together(spark, path, {"one": df.write.text, "two": fails})
    assert os.listdir(tmp) == [] and sinks.written_tables(spark, path) == []
    sinks.write_together(spark, path, {"one": df.write.text, "two": df.write.text})
    assert sinks.written_tables(spark, path) == ["one", "two"] and lines_of(f"{path}/two") == ["a"]
    with pytest.raises(FileExistsError):
        sinks.write_together(spark, path, {"one": df.write.text})
    with pytest.raises(RuntimeError):  # the old output stays whole
        sinks.write_together(spark, path, {"one": df.write.text, "two": fails}, "overwrite")
    assert sinks.written_tables(spark, path) == ["one", "two"] and os.listdir(tmp) == ["out"]
    sinks.write_together(spark, path, {"three": df.write.text}, "overwrite")
    assert sinks.written_tables(spark, path) == ["three"] and os.listdir(tmp) == ["out"]


def test_parallel_text_appears_together(spark, tmp, monkeypatch):
    df = spark.createDataFrame([(1, "a", "b")], "line_no long, src string, tgt string")
    real = sinks.move_path
    monkeypatch.setattr(sinks, "move_path", lambda *a: (_ for _ in ()).throw(OSError("no rename")))
    with pytest.raises(OSError):
        sinks.write_parallel(df, os.path.join(tmp, "p"))
    assert os.listdir(tmp) == []
    monkeypatch.setattr(sinks, "move_path", real)
    sinks.write_parallel(df, os.path.join(tmp, "p"))
    assert lines_of(f"{tmp}/p/src") == ["a"] and lines_of(f"{tmp}/p/tgt") == ["b"]


def test_prepared_dataset_round_trip(spark, tmp):
    merges, encoded = prepare(spark, SMALL, num_merges=40)
    encoded = encoded.withColumn("text", F.regexp_replace("text", "[\\n\\r]", " "))
    extra = encoded.limit(1).withColumn("line_no", F.lit(10**9)).withColumn("text", F.lit("two\nlines")).withColumn("enc", F.lit("x"))
    encoded = encoded.unionByName(extra)
    path = os.path.join(tmp, "data")
    broken = sinks.write_prepared(merges, encoded, path)
    assert [r.line_no for r in broken.collect()] == [10**9]
    assert sinks.written_tables(spark, path) == ["bpe", "codes", "detok"]
    groups = {(r.variant, r.side) for r in merges.select("variant", "side").distinct().collect()}
    assert len(groups) == 8
    for v, s in groups:
        back, version = src.read_merges(spark, f"{path}/codes/variant={v}/side={s}")
        assert version == (0, 2)
        want = merges.where((F.col("variant") == v) & (F.col("side") == s))
        assert [(r.rank, r.left, r.right) for r in back.orderBy("rank").collect()] == [(r.rank, r.left, r.right) for r in want.orderBy("rank").collect()]
        assert len(glob.glob(f"{path}/codes/variant={v}/side={s}/part-*")) == 1
        for split in ("train", "dev"):
            rows = encoded.where((F.col("variant") == v) & (F.col("side") == s) & (F.col("split") == split) & (F.col("line_no") < 10**9)) \
                .orderBy("corpus", "line_no").collect()
            if rows:
                at = f"variant={v}/side={s}/split={split}"
                assert lines_of(f"{path}/bpe/{at}") == [r.enc for r in rows]
                assert lines_of(f"{path}/detok/{at}") == [r.text for r in rows]


def test_score_json_equals_best_per_run(spark, tmp):
    rows = [("output_\"1\"", m, i, v) for m in ("bleu", "chrf") for i, v in enumerate([1.5, float("nan"), 3.25, None, 3.25], 1)]
    rows += [("output_2", "bleu", i, i / 4) for i in range(1, 400)] + [("output_3", "bleu", 1, float("nan"))]
    scores = spark.createDataFrame(rows, "run string, metric string, ordinal long, value double")
    path = os.path.join(tmp, "s")
    sinks.write_score_json(scores, path, ["bleu", "chrf", "ppl"], partitions=5)
    best = {(r.metric, r.run): r.max_value for r in best_per_run(scores).collect()}
    for m in ("bleu", "chrf"):
        assert len(glob.glob(f"{path}/{m}/part-*")) > 1 or m == "chrf"
        doc = json.loads("".join(lines_of(f"{path}/{m}")))
        assert doc[f"{m} scores max"] == {r: v for (k, r), v in best.items() if k == m}
        want = {}
        for r, k, i, v in rows:
            if k == m:
                want.setdefault(r, []).append(None if v is None or v != v else v)
        assert doc[f"{m} scores"] == want
    assert json.loads("".join(lines_of(f"{path}/ppl"))) == {"ppl scores": {}, "ppl scores max": {}}
