"""Registered aggregation queries (A1, A5, A6, W6) and their oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusprep.functions.text import split_punctuation
from corpusprep.operators.stats import build_vocab, corpus_stats, corpus_stats_rollup, vocab_by_freq, word_counts
from corpusprep.plans import fixtures as fx
from corpusprep.plans.q_text import d_t1, d_tok
from corpusprep.plans.registry import register


@register("word_counts", oracle=f"""
    SELECT word, CAST(count(*) AS BIGINT) AS freq
    FROM (SELECT unnest({d_tok(d_t1('text'))}) AS word FROM documents)
    GROUP BY word""")
def q_word_counts(spark, d):
    doc = fx.table(spark, d, "documents")
    return word_counts(doc.select(split_punctuation("text").alias("text")), "text")


_SIDES = ("sides", "SELECT corpus, split, 'src' AS side, src AS text FROM corpora UNION ALL SELECT corpus, split, 'tgt', tgt FROM corpora")


@register("build_vocab", oracle=fx.oracle(["corpora"], f"""
    SELECT side, CAST(rank AS BIGINT) AS rank, token, freq FROM (
        SELECT side, rank, token, CAST(NULL AS BIGINT) AS freq
        FROM (VALUES ('src'), ('tgt')) s(side), (VALUES (0, '<unk>'), (1, '<blank>'), (2, '<s>'), (3, '</s>')) t(rank, token) UNION ALL
        SELECT side, 3 + n, token, freq FROM c WHERE n <= 10000)""", [
    _SIDES,
    ("c", f"""SELECT *, row_number() OVER (PARTITION BY side ORDER BY freq DESC, token ASC) AS n
              FROM (SELECT side, word AS token, CAST(count(*) AS BIGINT) AS freq
                    FROM (SELECT side, unnest({d_tok('text')}) AS word FROM sides) GROUP BY side, word)""")]))
def q_build_vocab(spark, d):
    pairs = fx.corpora(spark, d)
    src, tgt = (build_vocab(pairs, side).select(F.lit(side).alias("side"), "rank", "token", "freq") for side in ("src", "tgt"))
    return src.unionByName(tgt)


@register("corpus_stats", oracle=fx.oracle(["corpora"], f"""
    SELECT per.*, coalesce(dist.distinct_words, 0) AS distinct_words,
           CAST(ceil(per.tokens / 4096) AS BIGINT) AS steps_per_epoch
    FROM per LEFT JOIN dist USING (corpus, split, side)""", [
    _SIDES,
    ("t", f"SELECT corpus, split, side, {d_tok('text')} AS tk FROM sides"),
    ("per", """SELECT corpus, split, side, CAST(count(*) AS BIGINT) AS lines, CAST(sum(len(tk)) AS BIGINT) AS tokens,
                        CAST(max(len(tk)) AS BIGINT) AS max_len, round(avg(len(tk)), 4) AS mean_len
                 FROM t GROUP BY corpus, split, side"""),
    ("dist", """SELECT corpus, split, side, CAST(count(DISTINCT w) AS BIGINT) AS distinct_words
                FROM (SELECT corpus, split, side, unnest(tk) AS w FROM t) GROUP BY corpus, split, side""")]))
def q_corpus_stats(spark, d):
    return corpus_stats(_side_lines(spark, d), "text", ["corpus", "split", "side"])


def _side_lines(spark, d):
    sides = F.explode(F.array(*[F.struct(F.lit(side).alias("side"), F.col(side).alias("text")) for side in ("src", "tgt")]))
    return fx.corpora(spark, d).select("corpus", "split", sides.alias("s")).select("corpus", "split", "s.side", "s.text")


_LEVEL = "3 - GROUPING(corpus) - GROUPING(split) - GROUPING(side)"


@register("corpus_stats_rollup", oracle=fx.oracle(["corpora"], f"""
    SELECT per.*, CAST(coalesce(dist.n, 0) AS BIGINT) AS distinct_words, CAST(ceil(per.tokens / 4096) AS BIGINT) AS steps_per_epoch
    FROM per LEFT JOIN dist ON per.level = dist.level AND per.corpus IS NOT DISTINCT FROM dist.corpus
        AND per.split IS NOT DISTINCT FROM dist.split AND per.side IS NOT DISTINCT FROM dist.side""", [
    _SIDES,
    ("t", f"SELECT corpus, split, side, {d_tok('text')} AS tk FROM sides"),
    ("per", f"""SELECT CAST({_LEVEL} AS INTEGER) AS level, corpus, split, side, CAST(count(*) AS BIGINT) AS lines,
                       CAST(sum(len(tk)) AS BIGINT) AS tokens, CAST(max(len(tk)) AS BIGINT) AS max_len, round(avg(len(tk)), 4) AS mean_len
                FROM t GROUP BY ROLLUP (corpus, split, side)"""),
    ("dist", f"""SELECT {_LEVEL} AS level, corpus, split, side, count(DISTINCT w) AS n
                 FROM (SELECT corpus, split, side, unnest(tk) AS w FROM t) GROUP BY ROLLUP (corpus, split, side)""")]))
def q_corpus_stats_rollup(spark, d):
    return corpus_stats_rollup(_side_lines(spark, d), "text", ["corpus", "split", "side"])


@register("vocab_by_freq", oracle=f"""
    WITH c AS (SELECT word, CAST(count(*) AS BIGINT) AS freq
               FROM (SELECT unnest({d_tok('text')}) AS word FROM documents) GROUP BY word)
    SELECT word, freq, CAST(row_number() OVER (ORDER BY freq DESC, word ASC) - 1 AS BIGINT) AS rank FROM c""")
def q_vocab_by_freq(spark, d):
    return vocab_by_freq(word_counts(fx.table(spark, d, "documents"), "text"))
