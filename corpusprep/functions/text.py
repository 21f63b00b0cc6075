"""Row-wise text scalars as Spark Column expressions (JVM side, whole-stage codegen).

Every function takes and returns a ``Column``; none holds state, so all of them also work on
streaming DataFrames.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Python's str.split()/strip() whitespace set, written as one regex class that
# Java regex and RE2 both accept. Java's \s is ASCII-only, so the class is explicit.
WS_CLASS = (r"[\x{09}-\x{0D}\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
            r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]")
# The same set as characters.
WS_CHARS = ("".join(map(chr, [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B)]))
            + "\u2028\u2029\u202F\u205F\u3000")
# Punctuation marks split off by the normaliser.
PUNCT_MARKS = "?!.,"
# Subword separator and end-of-word marker of the BPE format.
BPE_SEPARATOR = "@@"
END_OF_WORD = "</w>"


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def split_punctuation(col, marks: str = PUNCT_MARKS) -> Column:
    """Each mark becomes ``' m '``; trailing whitespace is removed, inner/leading kept."""
    cls = "[" + "".join("\\" + m for m in marks) + "]"
    spaced = F.regexp_replace(_c(col), f"({cls})", " $1 ")
    return rstrip(spaced)


def rstrip(col) -> Column:
    return F.regexp_replace(_c(col), WS_CLASS + r"+\z", "")


def strip(col) -> Column:
    return F.regexp_replace(F.regexp_replace(_c(col), r"\A" + WS_CLASS + "+", ""), WS_CLASS + r"+\z", "")


def lowercase(col) -> Column:
    """T2."""
    return F.lower(_c(col))


def tokens(col) -> Column:
    """T4: whitespace tokens (Unicode whitespace, no empty strings)."""
    return F.array_remove(F.split(_c(col), WS_CLASS + "+"), "")


def each_token(col) -> Column:
    """A row per token of ``col``, and one with '' or NULL where there may be none: the caller drops
    these. Spark works out the tokens of a plain ``explode`` twice, once to skip empty arrays."""
    return F.explode_outer(F.split(_c(col), WS_CLASS + "+"))


def normalise_ws(col) -> Column:
    """Tokens re-joined by one space (what ``' '.join(s.split())`` gives)."""
    return F.array_join(tokens(col), " ")


def one_spaced(col) -> Column:
    """``normalise_ws`` for many short texts. Most hold no white space but spaces, which is told
    without a look at each character: one byte a character and none of the control characters."""
    c = _c(col)
    plain = F.length(c) == F.octet_length(c)
    for x in WS_CHARS:
        if x < "\x80" and x != " ":
            plain &= ~F.contains(c, F.lit(x))
    c = F.trim(F.when(plain, c).otherwise(F.translate(c, WS_CHARS, " " * len(WS_CHARS))))
    return F.when(F.contains(c, F.lit("  ")), F.regexp_replace(c, "  +", " ")).otherwise(c)


def detokenise(col, mode: str = "regex", sep: str = BPE_SEPARATOR) -> Column:
    """T5 (``regex``: drop ``sep`` + one whitespace char) and T6 (``strip``: drop ``sep + ' '``
    then any remaining ``sep``)."""
    c = _c(col)
    if mode == "regex":
        return F.regexp_replace(c, _regex_quote(sep) + WS_CLASS, "")
    if mode == "strip":
        return F.replace(F.replace(c, F.lit(sep + " "), F.lit("")), F.lit(sep), F.lit(""))
    raise ValueError(f"unknown detokenise mode {mode!r}")


def truncate_tokens(col, n: int = 50) -> Column:
    """First ``n`` whitespace tokens joined by one space."""
    return F.array_join(F.slice(tokens(col), 1, n), " ")


def run_of(col) -> Column:
    """Run id ``output_N`` from a path ('' when absent)."""
    return F.regexp_extract(_c(col), r"output_\d+", 0)


def step_of(col) -> Column:
    """Checkpoint step from a ``..._step_N`` file name (NULL when absent)."""
    return F.expr("try_cast(nullif(regexp_extract({}, '_step_(\\\\d+)', 1), '') as int)".format(
        _sql_ref(col)))


def _sql_ref(col) -> str:
    if isinstance(col, str):
        return f"`{col}`"
    raise TypeError("step_of needs a column name")


def _regex_quote(s: str) -> str:
    return "".join("\\" + ch if not ch.isalnum() else ch for ch in s)


def is_blank(col) -> Column:
    """True when a text has no token (empty or whitespace only)."""
    return F.size(tokens(col)) == 0
