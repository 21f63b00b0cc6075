"""Corpus BLEU and chrF (A7-A11) as distributed aggregations.

Both metrics are sums of per-sentence clipped n-gram statistics, followed by a closed formula
over the corpus sums (computed in the JVM). Two engines produce the per-sentence statistics:

* ``arrow`` (default): an Arrow UDF counts the n-grams of one sentence pair (one sort of 64-bit
  numbers for all orders) and returns a fixed-size array of counts; Spark partitions the rows and
  sums the arrays with a partial aggregate. No n-gram rows exist, so nothing but a handful of longs
  per sentence is shuffled.
* ``jvm``: every sentence emits tagged n-grams (explode positions + ``get``/``concat``,
  codegen); the text is hash-partitioned on (group, sentence) first so the per-sentence
  aggregation runs in-task with no exchange; kept as the all-JVM plan and cross-checked in tests.

Definitions (Papineni et al. 2002; Popović 2015; Post 2018):

* tokenize ``13a``; BLEU orders 1-4, exponential smoothing of zero-match orders,
  brevity penalty ``exp(1 - ref/sys)`` when the hypothesis side is shorter (0 when empty);
* chrF: whitespace removed, character orders 1-6, average precision and recall over orders
  where both sides have n-grams, ``F_beta`` with beta = 2, times 100.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusprep.functions.text import WS_CLASS, tokens

# The 13a tokenizer's symbol class (ASCII ranges {-~, [-`, space-&, (-+, :-@, /).
_SYM_13A = r"([\x{7B}-\x{7E}\x{5B}-\x{60}\x{20}-\x{26}\x{28}-\x{2B}\x{3A}-\x{40}\x{2F}])"
BLEU_ORDER = 4
CHRF_ORDER = 6
CHRF_BETA = 2


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def tokenize_13a(col) -> Column:
    """Token array of the 13a tokenizer (case kept), after a right strip."""
    s = F.regexp_replace(_c(col), WS_CLASS + r"+\z", "")
    for a, b in (("<skipped>", ""), ("-\n", ""), ("\n", " "), ("&quot;", '"'), ("&amp;", "&"),
                 ("&lt;", "<"), ("&gt;", ">")):
        s = F.replace(s, F.lit(a), F.lit(b))
    s = F.concat(F.lit(" "), s, F.lit(" "))
    s = F.regexp_replace(s, _SYM_13A, " $1 ")
    s = F.regexp_replace(s, r"([^0-9])([\.,])", "$1 $2 ")
    s = F.regexp_replace(s, r"([\.,])([^0-9])", " $1 $2")
    s = F.regexp_replace(s, r"([0-9])(-)", "$1 $2 ")
    return tokens(s)


def _gram(units: Column, i: Column, n: int, sep: str) -> Column:
    """The n-gram starting at 1-based position ``i`` (NULL when it runs past the end)."""
    parts = []
    for j in range(n):
        if j:
            parts.append(F.lit(sep))
        parts.append(F.get(units, i - 1 + j))
    return parts[0] if n == 1 else F.concat(*parts)


def ngram_stats(df: DataFrame, hyp_units: Column, ref_units: Column, max_n: int, sep: str,
                group_cols: list[str], pair_cols: list[str]) -> DataFrame:
    """Corpus sums per (group, n): ``hyp`` n-grams, ``ref`` n-grams and clipped ``match``.

    The text rows are hash-partitioned on (group, pair) first: that shuffles text, not the
    ~``2 * max_n`` times larger n-gram stream, and the per-sentence aggregation then runs inside
    each task with no exchange (its keys contain the partitioning keys). N-grams come from
    ``explode(positions)`` + ``get``/``concat`` (whole-stage codegen, linear in length)."""
    g, k = list(group_cols), list(pair_cols)
    p = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    base = df.select(*g, *k, hyp_units.alias("__h"), ref_units.alias("__r")).repartition(p, *g, *k)
    longest = F.greatest(F.size("__h"), F.size("__r"), F.lit(1))
    pos = base.select(*g, *k, "__h", "__r", F.explode(F.sequence(F.lit(1), longest)).alias("__i"))
    i = F.col("__i")
    structs = []
    for arr, hf, rf in (("__h", 1, 0), ("__r", 0, 1)):
        for n in range(1, max_n + 1):
            structs.append(F.struct(F.lit(n).alias("n"), _gram(F.col(arr), i, n, sep).alias("gram"),
                                    F.lit(hf).alias("h"), F.lit(rf).alias("r")))
    grams = pos.select(*g, *k, F.inline(F.array(*structs))).filter(F.col("gram").isNotNull())
    per = grams.groupBy(*g, *k, "n", "gram").agg(F.sum("h").alias("h"), F.sum("r").alias("r"))
    return per.groupBy(*g, "n").agg(F.sum("h").cast("long").alias("hyp"), F.sum("r").cast("long").alias("ref"),
                                    F.sum(F.least("h", "r")).cast("long").alias("match"))


def _pivot(stats: DataFrame, group_cols: list[str], max_n: int) -> DataFrame:
    aggs = []
    for n in range(1, max_n + 1):
        for c in ("hyp", "ref", "match"):
            aggs.append(F.coalesce(F.sum(F.when(F.col("n") == n, F.col(c))), F.lit(0)).cast("long").alias(f"{c}{n}"))
    if group_cols:
        return stats.groupBy(*group_cols).agg(*aggs)
    return stats.agg(*aggs)


def bleu_formula(sys_len: Column, ref_len: Column, m: list[Column], t: list[Column]) -> Column:
    """Corpus BLEU from sums (exp smoothing). Unrounded, as the API returns it."""
    bp = F.when(sys_len >= ref_len, F.lit(1.0)).when(sys_len == 0, F.lit(0.0)) \
        .otherwise(F.exp(F.lit(1.0) - ref_len / sys_len))
    k = F.lit(0)
    logs = []
    for mn, tn in zip(m, t):
        k = k + F.when(mn == 0, 1).otherwise(0)
        p = F.when(mn == 0, F.lit(100.0) / (F.pow(F.lit(2.0), k) * tn)).otherwise(F.lit(100.0) * mn / tn)
        logs.append(F.ln(p))
    zero = (sum_cols(m) == 0) | (t[-1] == 0)
    return F.when(zero, F.lit(0.0)).otherwise(bp * F.exp(sum_cols(logs) / F.lit(float(len(m)))))


def sum_cols(cols: list[Column]) -> Column:
    out = cols[0]
    for c in cols[1:]:
        out = out + c
    return out


# The 13a tokenizer's symbol class written for Python's ``re`` (same ranges but the
# space: more spaces beside a space change no token).
_PY_SYM_13A = "([\\x7b-\\x7e\\x5b-\\x60\\x21-\\x26\\x28-\\x2b\\x3a-\\x40\\x2f])"
#: Rows of an Arrow batch that are Python strings at a time.
ROWS_AT_ONCE = 128
#: Words with marks whose tokens a worker remembers, and the longest of them.
CACHE_WORDS, CACHE_CHARS = 50_000, 40


def _py_tokenize_13a():
    """The 13a tokens of a line. Its rules look at single neighbours and white space is a neighbour
    like any other, so that words are tokenised one by one: a word of letters and digits is a token,
    the others are remembered."""
    import re
    sym = re.compile(_PY_SYM_13A)
    r1, r2, r3 = re.compile(r"([^0-9])([\.,])"), re.compile(r"([\.,])([^0-9])"), re.compile(r"([0-9])(-)")

    class Words(dict):
        def __missing__(self, word: str) -> list[str]:
            line = word
            for x, y in (("&quot;", '"'), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">")):
                line = line.replace(x, y)
            line = sym.sub(r" \1 ", f" {line} ")
            line = r1.sub(r"\1 \2 ", line)
            line = r2.sub(r" \1 \2", line)
            line = r3.sub(r"\1 \2 ", line)
            out = line.split()
            if len(word) <= CACHE_CHARS:
                if len(self) >= CACHE_WORDS:
                    self.clear()
                self[word] = out
            return out

    words = Words()

    def tok(line: str) -> list[str]:
        out: list[str] = []
        for w in line.rstrip().replace("<skipped>", "").replace("-\n", "").split():
            if w.isalnum():
                out.append(w)
            else:
                out += words[w]
        return out
    return tok


class _Numbers(dict):
    """Every word under its number, in the order of first sight."""

    def __missing__(self, word: str) -> int:
        n = self[word] = len(self)
        return n


def clipped_matches(h: np.ndarray, r: np.ndarray, order: int) -> list[int]:
    """The clipped n-gram matches of two unit sequences (as numbers from 0) for n = 1..order.

    The ``order``-grams of both sides are sorted as 64-bit numbers, the first unit on top: equal
    n-grams of every smaller n then lie together too. A side's last grams are filled up with a
    unit that only this side has, so they match nothing. Sequences with too many different units
    for the bits go order by order."""
    bits = 60 // order
    units = int(max(h.max(initial=-1), r.max(initial=-1))) + 1
    if units > (1 << bits) - 2:
        return _wide_matches(h, r, order)
    keys = np.empty(len(h) + len(r), np.int64)
    for side, (x, fill, k) in enumerate(((h, 0, keys[:len(h)]), (r, (1 << bits) - 1, keys[len(h):]))):
        n = len(x)
        p = np.full(n + order - 1, fill, np.int64)
        p[:n] = x
        p[:n] += 1
        k[:] = p[:n]
        for j in range(1, order):
            k <<= bits
            k |= p[j:j + n]
        k <<= 1
        k |= side
    keys.sort()
    n = len(keys)
    ahead = np.cumsum(1 - 2 * (keys & 1))  # hypothesis grams less reference grams so far
    step = np.full(n, np.iinfo(np.int64).max)
    np.bitwise_xor(keys[1:], keys[:-1], out=step[:-1])
    out = []
    for k in range(order, 0, -1):
        last = step >= 1 << 1 + bits * (order - k)  # the last of each group of equal k-grams
        step, ahead = step[last], ahead[last]
        apart = abs(int(ahead[0])) + int(np.abs(ahead[1:] - ahead[:-1]).sum()) if n else 0
        out.append((n - apart) // 2)
    return out[::-1]


def _wide_matches(h: np.ndarray, r: np.ndarray, order: int) -> list[int]:
    """``clipped_matches`` for any number of units: n-grams are numbered from (n-1)-grams."""
    _, x = np.unique(np.concatenate((h, r)), return_inverse=True)
    x = x.astype(np.int64)
    size, gram, out = int(x.max()) + 1, x, []
    for n in range(1, order + 1):
        if n > 1:
            _, gram = np.unique(gram[:-1] * size + x[n - 1:], return_inverse=True)
        a, b = gram[:max(len(h) - n + 1, 0)], gram[len(h):]
        most = int(gram.max(initial=-1)) + 1
        out.append(int(np.minimum(np.bincount(a, minlength=most), np.bincount(b, minlength=most)).sum()))
    return out


def _bleu_row():
    """Statistics of one pair: hypothesis n-gram count and clipped matches for n = 1..4, then the
    reference length (9 longs)."""
    tok = _py_tokenize_13a()

    def row(hyp: str | None, ref: str | None) -> list[int]:
        ht = tok(hyp) if hyp is not None else []
        rt = tok(ref) if ref is not None else []
        x = np.fromiter(map(_Numbers().__getitem__, ht + rt), np.int64, len(ht) + len(rt))
        out = []
        for n, m in enumerate(clipped_matches(x[:len(ht)], x[len(ht):], BLEU_ORDER), 1):
            out += [max(len(ht) - n + 1, 0), m]
        return [*out, len(rt)]

    return row


def _chrf_row(order: int = CHRF_ORDER):
    """Statistics of one pair: for n = 1..order the hypothesis n-gram count, the reference n-gram
    count and the clipped matches (3 * order longs)."""
    bits = 60 // order

    def row(hyp: str | None, ref: str | None) -> list[int]:
        hs = "".join(hyp.split()) if hyp is not None else ""
        rs = "".join(ref.split()) if ref is not None else ""
        x = np.frombuffer((hs + rs).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
        if x.max(initial=0) > (1 << bits) - 3:
            x = np.unique(x, return_inverse=True)[1]
        out = []
        for n, m in enumerate(clipped_matches(x[:len(hs)], x[len(hs):], order), 1):
            out += [max(len(hs) - n + 1, 0), max(len(rs) - n + 1, 0), m]
        return out

    return row


def _pair_stats(*kinds):
    """An Arrow UDF on (hypothesis, reference): the statistics of each of ``kinds`` (functions that
    give a function of one pair), one after the other. A batch stays Arrow; a few rows at a time
    become Python strings. Spark partitions the rows and sums the statistics."""

    @F.arrow_udf("array<long>")
    def stats(h: pa.Array, r: pa.Array) -> pa.Array:
        rows = [kind() for kind in kinds]
        values, ends = [], [0]
        for at in range(0, len(h), ROWS_AT_ONCE):
            part, n = [], 0
            for hyp, ref in zip(h.slice(at, ROWS_AT_ONCE).to_pylist(), r.slice(at, ROWS_AT_ONCE).to_pylist()):
                for row in rows:
                    part += row(hyp, ref)
                ends.append(ends[-1] + len(part) - n)
                n = len(part)
            values.append(np.array(part, np.int64))
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(values) if values else [], pa.int64()))

    return stats


def _bleu_sums(stats: str, tag: str = "") -> list[Column]:
    out = []
    for n in range(1, BLEU_ORDER + 1):
        out.append(F.sum(F.get(stats, 2 * (n - 1))).cast("long").alias(f"{tag}hyp{n}"))
        out.append(F.sum(F.get(stats, 2 * (n - 1) + 1)).cast("long").alias(f"{tag}match{n}"))
    return [*out, F.sum(F.get(stats, 2 * BLEU_ORDER)).cast("long").alias(f"{tag}ref1")]


def _chrf_sums(stats: str, tag: str = "", start: int = 0) -> list[Column]:
    return [F.sum(F.get(stats, start + 3 * (n - 1) + j)).cast("long").alias(f"{tag}{c}{n}")
            for n in range(1, CHRF_ORDER + 1) for j, c in enumerate(("hyp", "ref", "match"))]


def corpus_bleu(df: DataFrame, hyp: str, ref: str, group_cols: list[str] | None = None,
                pair_cols: list[str] | None = None, engine: str = "arrow") -> DataFrame:
    """``(groups..., bleu, sys_len, ref_len)``; ``bleu`` rounded to 4 decimals.

    ``engine="arrow"`` (default): per-sentence statistics in an Arrow UDF and a
    partial ``sum`` per group (no n-gram rows; about 7x faster on sf0.1). ``engine="jvm"``:
    13a tokenisation and n-gram explode in the JVM (``ngram_stats``); ``pair_cols`` identify a
    sentence pair there (clipping is per sentence); default: a row id."""
    g = list(group_cols or [])
    if engine == "arrow":
        st = df.select(*g, _pair_stats(_bleu_row)(F.col(hyp), F.col(ref)).alias("__s"))
        aggs = _bleu_sums("__s")
        st = st.groupBy(*g).agg(*aggs) if g else st.agg(*aggs)
    else:
        k = list(pair_cols or [])
        if not k:
            df = df.withColumn("__pair", F.monotonically_increasing_id())
            k = ["__pair"]
        st = _pivot(ngram_stats(df, tokenize_13a(hyp), tokenize_13a(ref), BLEU_ORDER, " ", g, k), g, BLEU_ORDER)
    m = [F.col(f"match{n}") for n in range(1, BLEU_ORDER + 1)]
    t = [F.col(f"hyp{n}") for n in range(1, BLEU_ORDER + 1)]
    score = bleu_formula(F.col("hyp1"), F.col("ref1"), m, t)
    return st.select(*g, F.round(score, 4).alias("bleu"), F.col("hyp1").alias("sys_len"), F.col("ref1").alias("ref_len"))


def chrf_formula(h: list[Column], r: list[Column], m: list[Column], beta: int = CHRF_BETA) -> Column:
    both = [(hn > 0) & (rn > 0) for hn, rn in zip(h, r)]
    eff = sum_cols([F.when(b, 1).otherwise(0) for b in both])
    prec = sum_cols([F.when(b, mn / hn).otherwise(0.0) for b, mn, hn in zip(both, m, h)])
    rec = sum_cols([F.when(b, mn / rn).otherwise(0.0) for b, mn, rn in zip(both, m, r)])
    p = F.when(eff > 0, prec / eff).otherwise(0.0)
    rr = F.when(eff > 0, rec / eff).otherwise(0.0)
    f2 = float(beta * beta)
    return F.when((p + rr) > 0, F.lit(100.0) * (1 + f2) * p * rr / (f2 * p + rr)).otherwise(0.0)


def corpus_chrf(df: DataFrame, hyp: str, ref: str, group_cols: list[str] | None = None,
                pair_cols: list[str] | None = None, engine: str = "arrow") -> DataFrame:
    """``(groups..., chrf)`` rounded to 4 decimals.

    ``engine="arrow"`` (default): per-sentence statistics in an Arrow UDF, then a
    partial ``sum`` per group (measured about 8x faster on sf0.1 than exploding ~12 rows per
    character). ``engine="jvm"``: the n-gram explode + aggregation of ``ngram_stats``."""
    g = list(group_cols or [])
    if engine == "arrow":
        st = df.select(*g, _pair_stats(_chrf_row)(F.col(hyp), F.col(ref)).alias("__s"))
        aggs = _chrf_sums("__s")
        st = st.groupBy(*g).agg(*aggs) if g else st.agg(*aggs)
    else:
        k = list(pair_cols or [])
        if not k:
            df = df.withColumn("__pair", F.monotonically_increasing_id())
            k = ["__pair"]

        def chars(c):
            return F.split(F.regexp_replace(F.col(c), WS_CLASS + "+", ""), "", -1)

        def nonempty(a):
            return F.filter(a, lambda x: x != "")

        st = _pivot(ngram_stats(df, nonempty(chars(hyp)), nonempty(chars(ref)), CHRF_ORDER, "", g, k), g, CHRF_ORDER)
    h = [F.col(f"hyp{n}") for n in range(1, CHRF_ORDER + 1)]
    r = [F.col(f"ref{n}") for n in range(1, CHRF_ORDER + 1)]
    m = [F.col(f"match{n}") for n in range(1, CHRF_ORDER + 1)]
    return st.select(*g, F.round(chrf_formula(h, r, m), 4).alias("chrf"))


def score_runs(preds: DataFrame, refs: DataFrame, detok: bool = True) -> DataFrame:
    """BLEU and chrF of every prediction file ``(run, step, line_no, text)`` against the
    reference lines ``(line_no, text)``: one join on ``line_no``, one Python pass, one group-by (a
    file without step is one row). ``n_extra``: its lines without a reference, ``n_missing``:
    references without a line of it; the scores are over the pairs, so a file with either is to be
    looked at."""
    from corpusprep.functions.text import detokenise
    p = preds.select("run", "step", "line_no", (detokenise("text") if detok else F.col("text")).alias("hyp"))
    r = refs.select("line_no", F.col("text").alias("ref"), F.lit(1).alias("__r"))
    pair = F.col("__r").isNotNull()
    j = p.join(r, "line_no", "left").select(
        "run", "step", "__r", _pair_stats(_bleu_row, _chrf_row)(F.when(pair, F.col("hyp")), F.col("ref")).alias("__s"))
    st = j.groupBy("run", "step").agg(*_bleu_sums("__s", "b_"), *_chrf_sums("__s", "c_", 2 * BLEU_ORDER + 1), F.count(F.lit(1)).alias("__n"), F.count("__r").alias("__m"))
    total = refs.agg(F.count(F.lit(1))).first()[0]
    of = lambda c, k: [F.col(f"{c}{n}") for n in range(1, k + 1)]
    bleu = bleu_formula(F.col("b_hyp1"), F.col("b_ref1"), of("b_match", BLEU_ORDER), of("b_hyp", BLEU_ORDER))
    chrf = chrf_formula(of("c_hyp", CHRF_ORDER), of("c_ref", CHRF_ORDER), of("c_match", CHRF_ORDER))
    return st.select("run", "step", F.round(bleu, 4).alias("bleu"), F.col("b_hyp1").alias("sys_len"), F.col("b_ref1").alias("ref_len"),
                     F.round(chrf, 4).alias("chrf"), (F.col("__n") - F.col("__m")).alias("n_extra"),
                     (F.lit(total) - F.col("__m")).cast("long").alias("n_missing"))


def compare_scores(df: DataFrame, ref: str, hyp_cols: list[str], pair_cols: list[str],
                   group_cols: list[str] | None = None) -> DataFrame:
    """BLEU of several hypothesis columns against the same references (e.g. before and
    after a rewriting step), one grouped job over the stacked columns."""
    g = list(group_cols or [])
    stacked = None
    for h in hyp_cols:
        x = df.select(*g, *pair_cols, F.lit(h).alias("system"), F.col(h).alias("__hyp"), F.col(ref).alias("__ref"))
        stacked = x if stacked is None else stacked.unionByName(x)
    return corpus_bleu(stacked, "__hyp", "__ref", [*g, "system"], pair_cols)
