"""Registered text-scalar and source-parser queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusprep.functions import text as tx
from corpusprep.operators.external import build_prompt, clean_numbered
from corpusprep.operators.order import ordered_scan
from corpusprep.plans import fixtures as fx
from corpusprep.plans.registry import register
from corpusprep.session import cut_lineage
from corpusprep.sources.lines import parse_keyed_lines, parse_merges, parse_records, parse_vocab, parse_word_counts, with_run_step
from corpusprep.operators.stats import word_counts

WS = tx.WS_CLASS
LB = r"\r\n|[\n\r\x{0B}\x{0C}\x{1C}-\x{1E}\x{85}\x{2028}\x{2029}]"


def d_t1(c):
    return f"regexp_replace(regexp_replace({c}, '([?!.,])', ' \\1 ', 'g'), '{WS}+$', '')"


def d_tok(c):
    return f"list_filter(regexp_split_to_array({c}, '{WS}+'), lambda x: x <> '')"


def d_strip(c):
    return f"regexp_replace(regexp_replace({c}, '^{WS}+', ''), '{WS}+$', '')"


def d_clean(c):
    """DuckDB form of T7 on column ``c``: list of kept, de-numbered lines."""
    kept = f"list_filter(regexp_split_to_array({d_strip(c)}, '{LB}'), lambda x: regexp_replace(x, '{WS}', '', 'g') <> '')"
    return kept


D_NUM = f"'^\\p{{Nd}}+\\.{WS}*'"


# --- T1 / T2 / T3 / T4 / T11 on document lines ---------------------------------------------------

@register("split_punctuation", oracle=fx.oracle(["lines"], f"SELECT doc_id, line_no, {d_t1('text')} AS text FROM lines"))
def q_split_punctuation(spark, d):
    return fx.lines(spark, d).select("doc_id", "line_no", tx.split_punctuation("text").alias("text"))


@register("lowercase", oracle=fx.oracle(["lines"], "SELECT doc_id, line_no, lower(text) AS text FROM lines"))
def q_lowercase(spark, d):
    return fx.lines(spark, d).select("doc_id", "line_no", tx.lowercase("text").alias("text"))


@register("normalise_pairs", oracle=fx.oracle(["turn_pairs"], f"""
    SELECT pair_id, lower({d_t1('src')}) AS src, lower({d_t1('tgt')}) AS tgt FROM turn_pairs"""))
def q_normalise_pairs(spark, d):
    from corpusprep.operators.variants import normalise_pairs
    return normalise_pairs(fx.turn_pairs(spark, d), split_punctuation=True, lowercase=True)


@register("tokens", oracle=fx.oracle(["lines"], f"""
    SELECT doc_id, line_no, CAST(len({d_tok('text')}) AS INTEGER) AS n_tokens,
           array_to_string({d_tok('text')}, '|') AS joined FROM lines"""))
def q_tokens(spark, d):
    t = tx.tokens("text")
    return fx.lines(spark, d).select("doc_id", "line_no", F.size(t).alias("n_tokens"),
                                     F.array_join(t, "|").alias("joined"))


@register("truncate_tokens", oracle=fx.oracle(["lines"], f"""
    SELECT doc_id, line_no, array_to_string(({d_tok('text')})[1:50], ' ') AS text FROM lines"""))
def q_truncate_tokens(spark, d):
    return fx.lines(spark, d).select("doc_id", "line_no", tx.truncate_tokens("text", 50).alias("text"))


# --- T5 / T6 / T13 / S10 on prediction lines ----------------------------------------------------

@register("detok_regex", oracle=fx.oracle(["pred_lines"], f"""
    SELECT path, line_no, regexp_replace(text, '@@{WS}', '', 'g') AS text FROM pred_lines"""))
def q_detok_regex(spark, d):
    return fx.pred_lines(spark, d).select("path", "line_no", tx.detokenise("text", "regex").alias("text"))


@register("detok_strip", oracle=fx.oracle(["pred_lines"], """
    SELECT path, line_no, replace(replace(text, '@@ ', ''), '@@', '') AS text FROM pred_lines"""))
def q_detok_strip(spark, d):
    return fx.pred_lines(spark, d).select("path", "line_no", tx.detokenise("text", "strip").alias("text"))


@register("run_step_of", oracle=fx.oracle(["pred_lines"], """
    SELECT path, regexp_extract(path, 'output_[0-9]+', 0) AS run,
           TRY_CAST(nullif(regexp_extract(path, '_step_([0-9]+)', 1), '') AS INTEGER) AS step,
           CAST(count(*) AS BIGINT) AS n_lines
    FROM pred_lines GROUP BY path"""))
def q_run_step_of(spark, d):
    return with_run_step(fx.pred_lines(spark, d)).groupBy("path", "run", "step") \
        .agg(F.count(F.lit(1)).alias("n_lines"))


# --- T12 -------------------------------------------------------------------------------------------

@register("drop_empty_pairs", oracle=fx.oracle(["raw_pairs"], f"""
    SELECT pair_id, src, tgt FROM raw_pairs WHERE len({d_tok('src')}) > 0 AND len({d_tok('tgt')}) > 0"""))
def q_drop_empty_pairs(spark, d):
    from corpusprep.operators.variants import drop_empty_pairs
    return drop_empty_pairs(fx.raw_pairs(spark, d))


# --- T8 / T7 on 5-line batches of each document ------------------------------------------------------

HEADER = "Rewrite each numbered line:"
_PROMPTS = ("prompts", f"""
    SELECT doc_id, line_no // 5 AS batch_no,
           '{HEADER}' || chr(10) || chr(10) ||
           string_agg(CAST(line_no + 1 AS VARCHAR) || '. ' || text, chr(10) || chr(10) ORDER BY line_no) AS prompt,
           CAST(count(*) AS BIGINT) AS n_lines
    FROM lines GROUP BY doc_id, line_no // 5""")


def _spark_prompts(spark, d):
    from corpusprep.operators.batching import fixed_batches
    b = fixed_batches(fx.lines(spark, d), "line_no", 5)
    return build_prompt(b, "text", "line_no", ["doc_id", "batch_no"], HEADER)


@register("build_prompt", oracle=fx.oracle(["lines"], "SELECT * FROM prompts", [_PROMPTS]))
def q_build_prompt(spark, d):
    return _spark_prompts(spark, d)


@register("clean_numbered", oracle=fx.oracle(["lines"], f"""
    SELECT doc_id, batch_no, CAST(unnest(range(len(l))) AS BIGINT) AS pos,
           regexp_replace(unnest(l), {D_NUM}, '') AS line
    FROM (SELECT doc_id, batch_no, {d_clean('prompt')} AS l FROM prompts)""", [_PROMPTS]))
def q_clean_numbered(spark, d):
    return clean_numbered(_spark_prompts(spark, d).drop("n_lines"), "prompt")


# --- S2 keyed TSV, S3 records, S4 merges, S6 vocab, S7 word counts -----------------------------------

@register("keyed_tsv", oracle=fx.oracle(["tsv_lines"], """
    SELECT line_no,
           CASE WHEN len(string_split(line, chr(9))) = 2 THEN string_split(line, chr(9))[1] END AS key,
           CASE WHEN len(string_split(line, chr(9))) = 2 THEN string_split(line, chr(9))[2] END AS text,
           CASE WHEN len(string_split(line, chr(9))) <> 2 THEN 'bad_arity' END AS reason
    FROM tsv_lines WHERE NOT starts_with(line, '#')"""))
def q_keyed_tsv(spark, d):
    return parse_keyed_lines(fx.tsv_lines(spark, d), "line")


@register("parse_records", oracle=fx.oracle(["turn_pairs"], """
    SELECT pair_id AS line_no, src AS nyn_text, tgt AS eng_text, CAST(NULL AS VARCHAR) AS reason FROM turn_pairs"""))
def q_parse_records(spark, d):
    return parse_records(fx.records(spark, d), "line", ["nyn_text", "eng_text"])


#: Documents whose first line numbers go to every task (about 40 bytes each); more are joined by key.
_NUMBERS_SENT = 4_000_000


def _numbered_lines(spark, d):
    """``(line, text)``: document lines with their position by ``(doc_id, line_no)``. Only the numbers
    of lines are put in order, not the texts, where ``doc_id`` tells the documents apart."""
    docs = fx.table(spark, d, "documents")
    n = F.when(F.col("text").isNull(), 0).otherwise(F.size(F.split("text", "\n", -1))).cast("long")
    sizes = cut_lineage(docs.select("doc_id", n.alias("n")))
    known = sizes.groupBy("doc_id").agg(F.count(F.lit(1)).alias("c")) \
        .agg(F.count("doc_id").alias("ids"), F.coalesce(F.sum("c"), F.lit(0)).alias("rows")).first()
    if known["ids"] < known["rows"]:
        return ordered_scan(fx.lines(spark, d), ["doc_id", "line_no"], index="line")
    first = cut_lineage(ordered_scan(sizes, ["doc_id"], sums={"first": "n"}).select("doc_id", "first"))
    if known["rows"] <= _NUMBERS_SENT:
        first = F.broadcast(first)
    return docs.join(first, "doc_id").select("first", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "text")) \
        .select((F.col("first") + F.col("line_no")).alias("line"), "text")


def _merge_lines(spark, d):
    """A merge-table text: header, then one ``left right`` rule per token and its successor in a
    document line; a line's last token makes a malformed rule."""
    t = F.col("t")
    rules = _numbered_lines(spark, d).select("line", tx.tokens("text").alias("t")) \
        .select("line", F.arrays_zip(t.alias("left"), F.slice(t, 2, F.size(t)).alias("right")).alias("t"))
    # a plain explode would have Spark work out the array a second time, to skip empty ones
    body = rules.select("line", F.posexplode_outer("t").alias("pos", "rule")).where(F.col("pos").isNotNull()) \
        .select((F.col("line") * 1000000000 + F.col("pos") + 1).alias("line_no"),
                F.concat_ws(" ", "rule.left", "rule.right").alias("text"))
    # one partition, the first: the header is found without the others
    head = spark.range(0, 1, 1, 1).select(F.col("id").alias("line_no"), F.lit("#version: 0.2").alias("text"))
    return head.unionByName(body)


@register("read_merges", oracle=fx.oracle(["lines"], f"""
    SELECT CAST(min(line * 1000000000 + pos - 1) AS BIGINT) AS rank, "left", "right" FROM (
        SELECT line, unnest(range(1, len(t))) AS pos, unnest(t[:-2]) AS "left", unnest(t[2:]) AS "right" FROM (
            SELECT row_number() OVER (ORDER BY doc_id, line_no) - 1 AS line, {d_tok('text')} AS t FROM lines) WHERE len(t) > 1)
    GROUP BY ALL"""))
def q_read_merges(spark, d):
    return parse_merges(_merge_lines(spark, d))


@register("read_vocab", oracle=f"""
    SELECT word AS token, CAST(count(*) AS BIGINT) AS freq
    FROM (SELECT unnest({d_tok('text')}) AS word FROM documents) GROUP BY word HAVING count(*) >= 3""")
def q_read_vocab(spark, d):
    wc = word_counts(fx.table(spark, d, "documents"), "text")
    vlines = wc.select(F.lit(0).alias("line_no"), F.concat_ws(" ", "word", F.col("freq").cast("string")).alias("text"))
    return parse_vocab(vlines, "text", threshold=3)


@register("read_word_counts", oracle=fx.oracle(["lines"], f"""
    SELECT word, arg_max(freq, doc_id) AS freq FROM (
        SELECT doc_id, word, CAST(count(*) AS BIGINT) AS freq
        FROM (SELECT doc_id, unnest({d_tok('text')}) AS word FROM lines) GROUP BY doc_id, word) GROUP BY word"""))
def q_read_word_counts(spark, d):
    # one ``word count`` line per document and word; the last document's count holds
    wc = word_counts(fx.lines(spark, d), "text", ["doc_id"])
    wl = wc.select(F.col("doc_id").alias("ord"), F.concat_ws(" ", "word", F.col("freq").cast("string")).alias("text"))
    return parse_word_counts(wl, "text", order="ord")
