"""Quality rules, line first (DataFrame functions only).

Every line is judged on its own: symbol-laden or unfinished punctuation, navigation, and
boilerplate. Failing lines are removed; a document that loses too much of its text that way is
rejected. ``quality_stats`` adds the document statistics that the base rules read.

Everything happens inside the row: no shuffle, no Python. Repeated 8-word windows are found on
64-bit window hashes combined by doubling (1, 2, 4, 8 words); only rows in which a hash occurs
twice go through the exact comparison of the window strings.

Edge cases: a NULL or empty text has no words and no lines, loses nothing, and fails the base
rules for being short. Blank lines are kept in place and never count as lost. Repeated rows are
judged each on its own. Extra columns pass through; an output column replaces an input column of
the same name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusprep.llm.common import NOT_SPACE, SPACE, text_of

SYMBOLS = "#*$%&|<>"

# The patterns of the line rules.
ENDS = r"""[.!?…。！？:;]["'”’»)\]]*[\x20\x09-\x0D]*$"""
LONG_PROSE = r"^(?:[^\x20\x09-\x0D]+[\x20\x09-\x0D]+){11}"
INNER = r"[.,;!?]"
NAVIGATION = (r"(?i)^\W*(?:home|menu|next|previous|prev|back|back to top|top|log ?in|sign ?in|sign ?up|register"
              r"|subscribe|share|tweet|search|read more|learn more|show more|more|contact(?: us)?|about(?: us)?"
              r"|site ?map|skip to content|click here|print|email this|reply|comments?)\W*$")
# possessive: Java's matcher runs such a group as a loop, where it would recurse once a repetition
TRAIL = r"^[^|>»›·•]{0,40}+(?:[|>»›·•][^|>»›·•]{0,40}+){2,}+$"
BOILERPLATE = (r"(?i)all rights reserved|licensed under|released under the .{1,40} licen[cs]e|copyright (?:©|\(c\)|[0-9]{4})"
               r"|terms (?:of|and) (?:use|service|conditions)|privacy policy|cookie policy|uses? cookies"
               r"|accept cookies|enable javascript|javascript (?:is )?(?:required|disabled)|lorem ipsum|powered by")

#: Codes of a line, in the order in which the rules are tried.
BLANK, NAV, SYMBOL, BOILER, UNFINISHED, KEPT = 0, 1, 2, 3, 4, 5
RULES = {"navigation": NAV, "symbol": SYMBOL, "boilerplate": BOILER, "unfinished": UNFINISHED}


def _n(line: Column, outside: str) -> Column:
    return F.length(F.regexp_replace(line, outside, ""))


def line_code(line: Column) -> Column:
    """The first rule that ``line`` fails, else ``KEPT``; ``BLANK`` for a line without a word."""
    n = F.length(line)
    laden = (_n(line, f"[^{SYMBOLS}{{}}]+") * 20 > n) | (_n(line, "[^!?]+") * 12 > n + 24)
    prose = line.rlike(ENDS) | (line.rlike(LONG_PROSE) & line.rlike(INNER))
    return (F.when(~line.rlike(NOT_SPACE), BLANK)
            .when(line.rlike(NAVIGATION) | line.rlike(TRAIL), NAV)
            .when(laden & (n > 4), SYMBOL)
            .when((n <= 300) & line.rlike(BOILERPLATE), BOILER)
            .when(~prose, UNFINISHED)
            .otherwise(KEPT))


def clean_lines(df: DataFrame, text: str = "text", max_lost: float = 0.5) -> DataFrame:
    """Add ``clean_text`` (the kept lines), ``n_lines`` (with a word), ``lost_<rule>`` (lines by
    failed rule), ``lost_share`` (share of the characters of such lines that went) and
    ``rejected`` (``lost_share`` above ``max_lost``)."""
    d = df.withColumn("__lines", F.split(text_of(text), "\n"))
    # code and line side by side: a lambda that refers to another column may get its definition
    # inlined, and would then work it out again for every line
    d = d.withColumn("__coded", F.transform("__lines", lambda x: F.struct(line_code(x).alias("code"), x.alias("x"))))
    code = F.col("__coded.code")
    d = d.withColumn("__kept", F.transform(F.filter("__coded", lambda c: c["code"].isin(BLANK, KEPT)), lambda c: c["x"]))
    chars = F.aggregate("__lines", F.lit(0), lambda a, x: a + F.when(x.rlike(NOT_SPACE), F.length(x)).otherwise(0))
    kept = F.aggregate("__kept", F.lit(0), lambda a, x: a + F.when(x.rlike(NOT_SPACE), F.length(x)).otherwise(0))
    d = d.withColumn("__chars", chars).withColumn("__left", kept)
    count = lambda k: F.size(F.filter(code, lambda c: c == k)).cast("long")
    d = d.withColumns({
        "clean_text": F.array_join("__kept", "\n"),
        "n_lines": F.size(F.filter(code, lambda c: c != BLANK)).cast("long"),
        **{f"lost_{name}": count(k) for name, k in RULES.items()},
        "lost_share": F.when(F.col("__chars") > 0, 1 - F.col("__left") / F.col("__chars")).otherwise(F.lit(0.0)),
    })
    d = d.withColumn("rejected", F.col("lost_share") > max_lost)
    return d.drop("__lines", "__coded", "__kept", "__chars", "__left")


def _doubled(d: DataFrame, src: str, join, tag: str, keep: Column | None = None) -> DataFrame:
    """Columns ``<tag>8``: for each position the combination of the 8 entries of ``src`` from
    there on, built from 2, 4, 8. ``keep``: the rows to do it for."""
    prev = src
    for width in (1, 2, 4):
        a = F.col(prev)
        m = F.size(a) - width
        pairs = F.when(m > 0, F.zip_with(F.slice(a, 1, F.greatest(m, F.lit(0))), F.slice(a, width + 1, F.greatest(m, F.lit(0))), join))
        name = f"{tag}{2 * width}"
        d = d.withColumn(name, pairs if keep is None else F.when(keep, pairs))
        d = d.drop(prev) if prev not in (src,) else d
        prev = name
    return d


def quality_stats(df: DataFrame, text: str = "text") -> DataFrame:
    """Add ``n_words``, ``word_chars``, ``n_symbols``, ``n_dup_lines`` and ``n_repeat_words`` (words
    inside 8-word windows that occur at least twice in the text)."""
    t = text_of(text)
    d = df.withColumn("__w", F.array_remove(F.split(t, SPACE + "+"), ""))
    d = d.withColumn("__l", F.filter(F.split(t, "\n"), lambda x: x.rlike(NOT_SPACE)))
    d = d.withColumns({
        "n_words": F.size("__w").cast("long"),
        "word_chars": F.length(F.regexp_replace(t, SPACE + "+", "")).cast("long"),
        "n_symbols": F.length(F.regexp_replace(t, f"[^{SYMBOLS}]+", "")).cast("long"),
        "n_dup_lines": (F.size("__l") - F.size(F.array_distinct("__l"))).cast("long"),
        "__h": F.transform("__w", lambda w: F.xxhash64(w)),
    }).drop("__l")
    d = _doubled(d, "__h", lambda a, b: F.xxhash64(a, b), "__h").drop("__h")
    twice = F.coalesce(F.size(F.array_distinct("__h8")) < F.size("__h8"), F.lit(False))
    d = d.withColumn("__w", F.when(twice, F.col("__w"))).drop("__h8")
    # from here on only rows with a window hash that occurs twice carry arrays
    d = _doubled(d, "__w", lambda a, b: F.concat(a, F.lit(" "), b), "__s", F.col("__w").isNotNull())
    d = d.withColumn("__s", F.sort_array(F.transform("__s8", lambda s, i: F.struct(s.alias("s"), i.alias("i"))))).drop("__w", "__s8")
    s = F.col("__s")
    same = lambda x, j: F.coalesce(F.get(s, j)["s"] == x["s"], F.lit(False))
    d = d.withColumn("__p", F.sort_array(F.transform(
        F.filter("__s", lambda x, j: same(x, j + 1) | F.when(j > 0, same(x, j - 1)).otherwise(False)), lambda x: x["i"]))).drop("__s")
    p = F.col("__p")
    gaps = F.zip_with(p, F.slice(p, 2, F.greatest(F.size(p), F.lit(1))), lambda a, b: F.least(F.coalesce(b - a, F.lit(8)), F.lit(8)))
    covered = F.aggregate(gaps, F.lit(0), lambda a, g: a + F.coalesce(g, F.lit(0)))
    return d.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")).drop("__p")


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def quality(df: DataFrame, text: str = "text", max_lost: float = 0.5) -> DataFrame:
    """Statistics, line cleaning and the verdict: ``base_failed`` and ``kept``."""
    d = clean_lines(quality_stats(df, text), text, max_lost)
    # The optimizer copies the definition of a column into a filter on it. The definitions here are
    # long; a row number that the verdict refers to keeps such filters above them.
    d = d.withColumn("__row", F.monotonically_increasing_id())
    d = d.withColumn("base_failed", base_failed())
    return d.withColumn("kept", ~F.col("base_failed") & ~F.col("rejected") & (F.col("__row") >= 0)).drop("__row")
