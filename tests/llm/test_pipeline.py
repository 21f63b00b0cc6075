import corpus_pipeline as cp
import test_jaccard
import test_line_templates
import test_packing
from edge_rows import SMALL, edge  # noqa: F401

from pyspark.sql import functions as F

from corpusprep.llm import queries as Q
from corpusprep.llm.decontam import contaminated_pairs


def rows(df):
    return {r["doc_id"]: r["text"] for r in df.collect()}


def test_stages_against_brute_force(spark, tmp):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    out = []
    for k, (name, stage) in enumerate(cp.STAGES):
        df = stage(spark, docs, SMALL)
        if k < 4:
            assert df.schema.names == ["doc_id", "text", "lang", "source", "n_chars"] and df.dtypes == docs.dtypes
        df.write.parquet(f"{tmp}/{k}")
        docs = spark.read.parquet(f"{tmp}/{k}")
        out.append(docs)
    kept = {r["doc_id"] for r in Q.op1_quality_rules(spark, SMALL).where("kept").collect()}
    first, second, third, fourth = map(rows, out[:4])
    assert set(first) == kept
    drop = test_line_templates.brute(list(first.values()))
    want = {i: "\n".join(x for n, x in enumerate(t.split("\n")) if n not in drop[t]) for i, t in first.items()}
    assert second == {i: t for i, t in want.items() if t.strip()}
    part = test_jaccard.brute(list(second.items()), 5, 80, 100)
    assert third == {i: second[i] for i, _, c in part if i == c}
    bad = {r["doc_id"] for r in contaminated_pairs(out[2], spark.read.parquet(f"{SMALL}/benchmark.parquet")).collect()}
    assert bad and fourth == {i: t for i, t in third.items() if i not in bad}
    assert test_packing.check(out[4].collect(), fourth) == 0
    assert all(r["n_chars"] == len(r["text"]) for r in out[3].collect())


def test_run(spark):
    assert cp.run(spark, SMALL).select("doc_id").distinct().count() > 100


def test_edge_rows(spark, edge):
    """Every stage takes every row, an empty table, and other columns."""
    bench = SMALL
    for name, stage in cp.STAGES[:4]:
        out = stage(spark, edge, bench)
        assert out.columns == edge.columns, name
        assert out.count() <= edge.count() and stage(spark, edge.limit(0), bench).count() == 0


def test_columns_of_any_name_stay(spark):
    names = ["n_lines", "N_DROPPED", "dropped", "__key", "__K", "__gone", "__Bad", "row", "clean", "clean_text", "kept", "component_id", "item_id"]
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").limit(40)
    for k, n in enumerate(names):
        docs = docs.withColumn(n, F.lit(k))
    for name, stage in cp.STAGES[:4]:
        out = stage(spark, docs, SMALL)
        assert out.columns == docs.columns, name
        got = out.collect()
        assert got and all(r[n] == k for r in got for k, n in enumerate(names)), name
