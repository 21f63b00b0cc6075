"""Corpus aggregations: word counts, vocabularies, corpus statistics.

All are hash aggregations with map-side partial combine, so a hot word is pre-aggregated per
task before the shuffle.
"""

from __future__ import annotations

from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusprep.functions.text import END_OF_WORD, each_token, tokens
from corpusprep.operators.order import ordered_scan

# Special tokens the trainer puts at the head of each vocabulary.
SPECIALS = ["<unk>", "<blank>", "<s>", "</s>"]

#: Words that a task counts in memory before it lets their counts go; rows that are Python strings at a time.
IN_TASK, ROWS_AT_ONCE = 200_000, 64


def word_counts(df: DataFrame, col: str = "text", group_cols: list[str] | None = None) -> DataFrame:
    """A1: ``(groups..., word, freq)`` over the whitespace tokens of ``col``."""
    g = list(group_cols or [])
    if not g:
        return token_counts(df, col)
    words = df.select(*g, each_token(col).alias("word")).where(F.col("word") != "")
    return words.groupBy(*g, "word").agg(F.count(F.lit(1)).alias("freq"))


def token_counts(df: DataFrame, col: str, times: str | None = None) -> DataFrame:
    """``(word, freq)`` over the whitespace tokens of ``col``, each row as often as ``times`` says. They
    are counted in the task, in Python's own loops, as far as ``IN_TASK`` words go; Spark adds the
    counts up."""

    def run(batches):
        import pyarrow as pa

        def batch():
            return pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], ["word", "freq"])

        held: Counter = Counter()
        for b in batches:
            for at in range(0, b.num_rows, ROWS_AT_ONCE):
                texts, n = (c.slice(at, ROWS_AT_ONCE).to_pylist() for c in b.columns)
                for text, k in zip(texts, n):
                    if text is None:
                        continue
                    if times is None:
                        held.update(text.split())
                    else:
                        for w in text.split():
                            held[w] += k
                    if len(held) >= IN_TASK:
                        yield batch()
                        held.clear()
        if held:
            yield batch()

    n = F.lit(1) if times is None else F.col(times)
    return df.select(F.col(col).alias("text"), n.cast("long").alias("n")).mapInArrow(run, "word string, freq long") \
        .groupBy("word").agg(F.sum("freq").alias("freq"))


def to_symbols(col) -> F.Column:
    """A2: a word as space-wrapped symbols ``' a  b  c</w> '`` (code points; last one carries
    the end-of-word marker). One merge is then a literal ``replace`` (see ``bpe_learn``)."""
    c = F.col(col) if isinstance(col, str) else col
    chars = F.transform(F.sequence(F.lit(1), F.length(c)), lambda i: F.substring(c, i, 1))
    return F.concat(F.lit(" "), F.array_join(chars, "  "), F.lit(END_OF_WORD + " "))


def symbols_array(sym_col) -> F.Column:
    """The symbols of a space-wrapped symbol string as an array."""
    c = F.col(sym_col) if isinstance(sym_col, str) else sym_col
    return F.split(c.substr(F.lit(2), F.length(c) - 2), "  ", -1)


def build_vocab(df: DataFrame, col: str, size: int = 10000, specials: list[str] | None = None) -> DataFrame:
    """A5: ``(rank, token, freq)``: specials first (freq NULL), then the ``size`` most frequent
    tokens by (freq desc, token asc). The limit is the feature (a top-k), planned as
    TakeOrderedAndProject, so only ``size`` rows per task reach the final merge."""
    specials = SPECIALS if specials is None else specials
    spark = df.sparkSession
    top = word_counts(df, col).withColumnRenamed("word", "token") \
        .orderBy(F.col("freq").desc(), F.col("token").asc()).limit(size)
    ranked = ordered_scan(top, [F.col("freq").desc(), F.col("token").asc()], index="rank", partitions=1)
    n_sp = len(specials)
    head = spark.createDataFrame([(i, t) for i, t in enumerate(specials)], "rank long, token string") \
        .withColumn("freq", F.lit(None).cast("long"))
    body = ranked.select((F.col("rank") + n_sp).alias("rank"), "token", "freq")
    return head.unionByName(body)


def _word_table(df: DataFrame, col: str, g: list[str]) -> DataFrame:
    """``(groups..., __w, __lines, __c, __n)``: every word of a group with its lines' counts (a line
    is counted at its first token, or at the one NULL word that a blank line has), its tokens and
    the longest line that holds it."""
    each = df.select(*g, tokens(col).alias("__t")).select(*g, F.size("__t").alias("__n"), F.posexplode_outer("__t").alias("__p", "__w"))
    first = F.when(F.coalesce(F.col("__p"), F.lit(0)) == 0, 1)
    return each.groupBy(*g, "__w").agg(F.count(first).alias("__lines"), F.count("__w").alias("__c"), F.max("__n").alias("__n"))


def _from_words(words: DataFrame, g: list[str], batch_tokens: int) -> DataFrame:
    out = words.groupBy(*g).agg(F.sum("__lines").alias("lines"), F.sum("__c").cast("long").alias("tokens"),
                                F.max("__n").cast("long").alias("max_len"),
                                F.round(F.sum("__c") / F.sum("__lines"), 4).alias("mean_len"),
                                F.count("__w").alias("distinct_words"))
    return out.withColumn("steps_per_epoch", F.ceil(F.col("tokens") / F.lit(batch_tokens)).cast("long"))


def corpus_stats(df: DataFrame, col: str, group_cols: list[str], batch_tokens: int = 4096) -> DataFrame:
    """Lines, tokens, max/mean tokens per line, distinct words and steps per epoch
    (``ceil(tokens / batch_tokens)``) per group, from one two-level aggregation (group, word) ->
    group, so that the input is evaluated once."""
    g = list(group_cols)
    return _from_words(_word_table(df, col, g), g, batch_tokens)


def corpus_stats_rollup(df: DataFrame, col: str, group_cols: list[str], batch_tokens: int = 4096) -> DataFrame:
    """A6 on every level of ``rollup(group_cols)`` in one plan: ``level`` is the number of leading
    group columns that a row keeps, the others are NULL. Words are counted per (group, word) first;
    each of these few rows then goes to every level and meets its word there again, so distinct words
    are right on all levels and the text is evaluated once."""
    g = list(group_cols)
    words = _word_table(df, col, g)
    levels = F.explode(F.array(*[F.struct(F.lit(k).alias("level"), *[F.col(c).alias(c) if i < k else F.lit(None).cast(words.schema[c].dataType).alias(c)
                                                                   for i, c in enumerate(g)]) for k in range(len(g) + 1)]))
    spread = words.select(levels.alias("__x"), "__w", "__lines", "__c", "__n").select("__x.*", "__w", "__lines", "__c", "__n")
    keys = ["level", *g]
    met = spread.groupBy(*keys, "__w").agg(F.sum("__lines").alias("__lines"), F.sum("__c").alias("__c"), F.max("__n").alias("__n"))
    return _from_words(met, keys, batch_tokens)


def vocab_by_freq(counts: DataFrame, word: str = "word", freq: str = "freq") -> DataFrame:
    """The vocabulary in frequency-descending order as an explicit ``rank`` (ties by word),
    numbered by a range-partitioned scan rather than a single-task global sort."""
    return ordered_scan(counts, [F.col(freq).desc(), F.col(word).asc()], index="rank")
