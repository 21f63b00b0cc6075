"""Registered join/alignment queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusprep.operators.align import align_by_key, alignment_rejects, last_per_key, pending_batches, zip_lines
from corpusprep.operators.batching import collect_batches, fixed_batches, flatten_batches
from corpusprep.operators.variants import build_variants, concat_corpora
from corpusprep.plans import fixtures as fx
from corpusprep.plans.q_text import d_t1
from corpusprep.plans.registry import register


@register("align_by_key", oracle=fx.oracle(["aligned"], "SELECT pair_id, key, src, tgt FROM aligned"))
def q_align_by_key(spark, d):
    return align_by_key(fx.keyed_src(spark, d), fx.keyed_tgt(spark, d))


@register("alignment_rejects", oracle=fx.oracle(["keyed_src", "tgt_last"], """
    SELECT line_no, key, reason FROM (
        SELECT s.line_no, s.key,
               CASE WHEN s.text = '' THEN 'src_empty' WHEN t.key IS NULL THEN 'not_in_target'
                    WHEN t.text = '' THEN 'tgt_empty' END AS reason
        FROM keyed_src s LEFT JOIN tgt_last t ON s.key = t.key)
    WHERE reason IS NOT NULL"""))
def q_alignment_rejects(spark, d):
    return alignment_rejects(fx.keyed_src(spark, d), fx.keyed_tgt(spark, d))


@register("last_per_key", oracle=fx.oracle(["tgt_last"], "SELECT key, text FROM tgt_last"))
def q_last_per_key(spark, d):
    return last_per_key(fx.keyed_tgt(spark, d), "key", "line_no", "text")


_HYP_LINES = ("hyp_lines", """
    SELECT pair_id AS doc_id, CAST(unnest(range(len(l))) AS BIGINT) AS line_no, unnest(l) AS text
    FROM (SELECT pair_id, string_split(hyp, chr(10)) AS l FROM hyp_ref)""")


@register("zip_lines", oracle=fx.oracle(["lines", "hyp_ref"], """
    SELECT doc_id, line_no, a.text AS a, b.text AS b,
           CASE WHEN a.text IS NULL THEN 'b_only' WHEN b.text IS NULL THEN 'a_only' ELSE 'ok' END AS status
    FROM lines a FULL OUTER JOIN hyp_lines b USING (doc_id, line_no)""", [_HYP_LINES]))
def q_zip_lines(spark, d):
    hr = fx.hyp_ref(spark, d)
    hyp_lines = hr.select(F.col("pair_id").alias("doc_id"), F.posexplode(F.split("hyp", "\n", -1)).alias("line_no", "text")) \
        .select("doc_id", F.col("line_no").cast("long").alias("line_no"), "text")
    return zip_lines(fx.lines(spark, d), hyp_lines, on=["doc_id", "line_no"], strict=False)


def _batches(spark, d):
    b = fixed_batches(fx.lines(spark, d), "line_no", 5)
    b = b.withColumn("batch_id", F.col("doc_id") * 1000000000 + F.col("batch_no"))
    return collect_batches(b, ["batch_id", "doc_id", "batch_no"], "line_no", "text")


_D_BATCHES = ("batches", """
    SELECT doc_id * 1000000000 + line_no // 5 AS batch_id, doc_id, line_no // 5 AS batch_no,
           list(text ORDER BY line_no) AS texts, CAST(count(*) AS BIGINT) AS n_lines
    FROM lines GROUP BY doc_id, line_no // 5""")


@register("pending_batches", oracle=fx.oracle(["lines"], """
    SELECT batch_id FROM batches WHERE (doc_id + batch_no) % 3 <> 0""", [_D_BATCHES]))
def q_pending_batches(spark, d):
    b = _batches(spark, d)
    m = (F.col("doc_id") + F.col("batch_no")) % 3
    # a stored progress table: some batches done, some stored with an empty list
    done = b.filter(m != 2).select(
        "batch_id", F.when(m == 0, F.col("texts")).otherwise(F.array().cast("array<string>")).alias("outputs"))
    return pending_batches(b.select("batch_id"), done)


@register("flatten_batches", oracle=fx.oracle(["lines"], """
    SELECT doc_id * 1000000000 + line_no // 5 AS batch_id, CAST(line_no % 5 AS BIGINT) AS pos, text AS line FROM lines"""))
def q_flatten_batches(spark, d):
    return flatten_batches(_batches(spark, d), ["batch_id"], "texts")


@register("concat_corpora", oracle=fx.oracle(["turn_pairs", "aligned"], """
    SELECT 0 AS corpus_ord, pair_id AS line_no, src, tgt FROM turn_pairs
    UNION ALL SELECT 1, pair_id, src, tgt FROM aligned"""))
def q_concat_corpora(spark, d):
    a = fx.turn_pairs(spark, d).select(F.col("pair_id").alias("line_no"), "src", "tgt")
    b = align_by_key(fx.keyed_src(spark, d), fx.keyed_tgt(spark, d)) \
        .select(F.col("pair_id").alias("line_no"), "src", "tgt")
    return concat_corpora([a, b])


@register("build_variants", oracle=fx.oracle(["corpora"], f"""
    SELECT r.variant, c.corpus, c.split, c.line_no,
           CASE WHEN c.corpus = 'A' THEN {d_t1('c.src')} ELSE c.src END AS src,
           CASE WHEN c.corpus = 'A' THEN {d_t1('c.tgt')} ELSE c.tgt END AS tgt
    FROM corpora c JOIN recipe r ON c.corpus = r.corpus
    WHERE c.split = 'train' OR c.corpus = 'A'""", [("recipe", """
    SELECT * FROM (VALUES ('original', 'A'), ('bible', 'A'), ('bible', 'B'), ('backtranslated', 'A'),
        ('backtranslated', 'C'), ('all', 'A'), ('all', 'B'), ('all', 'C')) t(variant, corpus)""")]))
def q_build_variants(spark, d):
    return build_variants(fx.corpora(spark, d))
