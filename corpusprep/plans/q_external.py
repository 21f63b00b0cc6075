"""Registered external-call queries (X1, X3, X4) with deterministic stand-in functions.

The stand-ins are plain module-level functions (picklable, idempotent per batch) so that the
oracle can state their result in SQL: ``tag_lengths`` prefixes every line with its length and
fails on a batch holding an empty line; ``echo_items`` answers a rewrite prompt with its
numbered items.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusprep.operators.batching import collect_batches, fixed_batches
from corpusprep.operators.external import map_batches, rewrite_lines, to_pairs
from corpusprep.plans import fixtures as fx
from corpusprep.plans.q_text import _PROMPTS, D_NUM, HEADER, d_clean
from corpusprep.plans.registry import register


def tag_lengths(texts: list[str]) -> list[str]:
    if any(t == "" for t in texts):
        raise ValueError("empty line in batch")
    return [f"[{len(t)}] {t}" for t in texts]


def echo_items(prompt: str) -> str:
    if "###" in prompt:
        raise ValueError("refused")
    if "!!" in prompt:
        return ""
    return prompt.split("\n\n", 1)[1] if "\n\n" in prompt else ""


def _lines_with_batch(spark, d):
    b = fixed_batches(fx.lines(spark, d), "line_no", 5)
    return b.withColumn("batch_id", F.col("doc_id") * 1000000000 + F.col("batch_no")) \
        .withColumn("pos", (F.col("line_no") % 5).cast("long"))


def _mapped(spark, d):
    lines = _lines_with_batch(spark, d)
    batches = collect_batches(lines, ["batch_id"], "line_no", "text")
    return lines, map_batches(batches, tag_lengths, "batch_id", "texts")


_D_MAP = ("mapped", """
    SELECT doc_id * 1000000000 + line_no // 5 AS batch_id,
           CASE WHEN bool_or(text = '') THEN 'error' ELSE 'ok' END AS status,
           CAST(CASE WHEN bool_or(text = '') THEN 0 ELSE count(*) END AS BIGINT) AS n_out,
           CASE WHEN bool_or(text = '') THEN NULL
                ELSE string_agg('[' || CAST(length(text) AS VARCHAR) || '] ' || text, chr(10) ORDER BY line_no) END AS joined
    FROM lines GROUP BY doc_id, line_no // 5""")


@register("map_batches", oracle=fx.oracle(["lines"], "SELECT * FROM mapped", [_D_MAP]))
def q_map_batches(spark, d):
    _, res = _mapped(spark, d)
    return res.select("batch_id", "status", F.coalesce(F.size("outputs"), F.lit(0)).cast("long").alias("n_out"),
                      F.array_join("outputs", "\n").alias("joined"))


@register("to_pairs", oracle=fx.oracle(["lines"], """
    SELECT l.doc_id * 1000000000 + l.line_no // 5 AS batch_id, CAST(l.line_no % 5 AS BIGINT) AS pos,
           CASE WHEN m.status = 'ok' THEN '[' || CAST(length(l.text) AS VARCHAR) || '] ' || l.text END AS src, l.text AS tgt, m.status
    FROM lines l JOIN mapped m ON m.batch_id = l.doc_id * 1000000000 + l.line_no // 5""", [_D_MAP]))
def q_to_pairs(spark, d):
    lines, res = _mapped(spark, d)
    return to_pairs(lines.select("batch_id", "pos", "text"), res.select("batch_id", "outputs", "status"), ["batch_id"])


@register("rewrite_lines", oracle=fx.oracle(["lines"], f"""
    SELECT doc_id, batch_no, pos, CASE WHEN line IS NOT NULL THEN regexp_replace(line, {D_NUM}, '') END AS line,
           n_in, n_out, n_in <> n_out AS shifted, status FROM (
        SELECT doc_id, batch_no, n_lines AS n_in, status, CAST(len(l) AS BIGINT) AS n_out,
               CAST(unnest(CASE WHEN len(l) = 0 THEN [NULL] ELSE range(len(l)) END) AS BIGINT) AS pos,
               unnest(CASE WHEN len(l) = 0 THEN [NULL] ELSE l END) AS line
        FROM (SELECT doc_id, batch_no, n_lines, status, CASE WHEN resp = '' THEN [] ELSE {d_clean('resp')} END AS l FROM (
              SELECT *, CASE WHEN contains(prompt, '###') THEN 'error' ELSE 'ok' END AS status,
                     CASE WHEN contains(prompt, '###') OR contains(prompt, '!!') THEN ''
                          ELSE substring(prompt, strpos(prompt, chr(10) || chr(10)) + 2) END AS resp FROM prompts)))""", [_PROMPTS]))
def q_rewrite_lines(spark, d):
    b = fixed_batches(fx.lines(spark, d), "line_no", 5)
    return rewrite_lines(b, echo_items, "text", "line_no", ["doc_id", "batch_no"], HEADER)
