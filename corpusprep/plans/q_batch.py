"""Registered batching queries (W1, W2, W3) with recursive-CTE oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusprep.functions import text as tx
from corpusprep.operators.batching import fixed_batches
from corpusprep.operators.budget import budget_batches, token_batches
from corpusprep.plans import fixtures as fx
from corpusprep.plans.q_text import d_tok
from corpusprep.plans.registry import register

BUDGET = 5000
TOKEN_BUDGET = 8192
BUCKET = 8192


@register("fixed_batches", oracle=fx.oracle(["lines"], "SELECT doc_id, line_no, CAST(line_no // 5 AS BIGINT) AS batch_no FROM lines"))
def q_fixed_batches(spark, d):
    return fixed_batches(fx.lines(spark, d), "line_no", 5).select("doc_id", "line_no", "batch_no")


_GLOBAL = f"""
    l AS (SELECT doc_id, line_no, CAST(length(text) + 1 AS BIGINT) AS len,
                                row_number() OVER (ORDER BY doc_id, line_no) - 1 AS idx FROM lines),
    r(idx, batch, used) AS (
        SELECT idx, CAST(0 AS BIGINT), len FROM l WHERE idx = 0
        UNION ALL
        SELECT l.idx, CASE WHEN r.used + l.len > {BUDGET} THEN r.batch + 1 ELSE r.batch END,
               CASE WHEN r.used + l.len > {BUDGET} THEN l.len ELSE r.used + l.len END
        FROM r JOIN l ON l.idx = r.idx + 1)
    SELECT doc_id, line_no, batch AS batch_id FROM r JOIN l USING (idx)"""


@register("budget_batches_global", oracle=(fx.duck_with("lines") + ",\n" + _GLOBAL).replace(
    "WITH lines AS", "WITH RECURSIVE lines AS", 1))
def q_budget_batches_global(spark, d):
    out = budget_batches(fx.lines(spark, d), ["doc_id", "line_no"], "text", BUDGET)
    return out.select("doc_id", "line_no", "batch_id")


_SHARDED = f"""
    l AS (SELECT doc_id, line_no, CAST(length(text) + 1 AS BIGINT) AS len FROM lines),
    r(doc_id, line_no, batch, used) AS (
        SELECT doc_id, line_no, CAST(0 AS BIGINT), len FROM l WHERE line_no = 0
        UNION ALL
        SELECT l.doc_id, l.line_no, CASE WHEN r.used + l.len > {BUDGET} THEN r.batch + 1 ELSE r.batch END,
               CASE WHEN r.used + l.len > {BUDGET} THEN l.len ELSE r.used + l.len END
        FROM r JOIN l ON l.doc_id = r.doc_id AND l.line_no = r.line_no + 1)
    SELECT doc_id, line_no, CAST(dense_rank() OVER (ORDER BY doc_id, batch) - 1 AS BIGINT) AS batch_id FROM r"""


@register("budget_batches_sharded", oracle=(fx.duck_with("lines") + ",\n" + _SHARDED).replace(
    "WITH lines AS", "WITH RECURSIVE lines AS", 1))
def q_budget_batches_sharded(spark, d):
    out = budget_batches(fx.lines(spark, d), ["line_no"], "text", BUDGET, shard_cols=["doc_id"])
    return out.select("doc_id", "line_no", "batch_id")


_TOKENS = f"""
    t AS (SELECT corpus, line_no, CAST(greatest(len({d_tok('src')}), len({d_tok('tgt')})) AS BIGINT) AS len,
                 row_number() OVER (ORDER BY corpus, line_no) - 1 AS pos FROM corpora),
    b AS (SELECT *, pos // {BUCKET} AS bucket_id, row_number() OVER (PARTITION BY pos // {BUCKET} ORDER BY len, pos) AS k FROM t),
    r(bucket_id, k, batch_no, cnt, mx) AS (
        SELECT bucket_id, k, CAST(0 AS BIGINT), 1, len FROM b WHERE k = 1
        UNION ALL
        SELECT b.bucket_id, b.k,
               CASE WHEN greatest(r.mx, b.len) * (r.cnt + 1) > {TOKEN_BUDGET} THEN r.batch_no + 1 ELSE r.batch_no END,
               CASE WHEN greatest(r.mx, b.len) * (r.cnt + 1) > {TOKEN_BUDGET} THEN 1 ELSE r.cnt + 1 END,
               CASE WHEN greatest(r.mx, b.len) * (r.cnt + 1) > {TOKEN_BUDGET} THEN b.len ELSE greatest(r.mx, b.len) END
        FROM r JOIN b ON b.bucket_id = r.bucket_id AND b.k = r.k + 1)
    SELECT b.corpus, b.line_no, CAST(b.bucket_id AS BIGINT) AS bucket_id, r.batch_no
    FROM r JOIN b USING (bucket_id, k)"""


@register("token_batches", oracle=(fx.duck_with("corpora") + ",\n" + _TOKENS).replace("WITH ", "WITH RECURSIVE ", 1))
def q_token_batches(spark, d):
    c = fx.corpora(spark, d)
    c = c.withColumn("len", F.greatest(F.size(tx.tokens("src")), F.size(tx.tokens("tgt"))).cast("long"))
    out = token_batches(c, ["corpus", "line_no"], "len", TOKEN_BUDGET, BUCKET)
    return out.select("corpus", "line_no", "bucket_id", "batch_no")
