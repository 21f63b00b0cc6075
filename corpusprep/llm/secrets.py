"""Secret scans with a guess-cost dynamic programme.

Three patterns find secrets by form (assignments to credential names, access key ids, long
lower-case hex runs). Beyond them, values in credential context (wider names, bearer headers,
passwords in URLs, values of mixed characters after such words) are scored by the least number of
guesses that builds them: a minimum-cost segmentation into dictionary words, dates, repeats,
keyboard walks, sequences and brute-force spans, found by dynamic programming over the positions.
A value that costs ``MIN_LOG10`` or more decimal digits of guesses is a secret; "password1" or
"changeme" is not.

The dictionary ranks words by their place in a public tokenizer's vocabulary (merges are learned by
frequency), after a short list of common passwords; the vocabulary's path is a parameter.

One pass over the documents, no shuffle. Edge cases: NULL texts are empty and have no spans; rows
are scanned each, so NULL ids and repeated rows stay; only id and text are read. A value longer
than ``WINDOW`` characters is segmented in full; single parts of it are at most ``WINDOW`` long.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusprep.llm.common import map_rows

MIN_LOG10 = 10.0
WINDOW = 40

# The three base patterns of the contract, in the order in which kinds are listed.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # a run of 24 and more is the whole run
KINDS = ("assign", "access", "hex", "guess")

#: A credential name may follow other words (DB_PASSWORD, dbPassword) and go on (secret_access_key).
_NAME_START = r"(?:(?<![A-Za-z0-9])|(?-i:(?<=[a-z0-9])(?=[A-Z])))"
_NAME_MORE = r"(?:[_.-]?(?:access|api|app|auth|base|client|encryption|key|master|private|secret|shared|signing|token|value))*(?:[_.-]?[0-9]{1,3})?"
#: Credential context of the method: a group ``v`` is the value.
CONTEXT = [
    re.compile(rf"""{_NAME_START}(?:pwd|pass(?:word|wd|phrase|code)?|secrets?|tokens?|api[_.-]?(?:key|secret)|(?:access|auth|private|client|signing|encryption)[_.-]?(?:key|token|secret)|credentials?)"""
               rf"""{_NAME_MORE}\b["']?\x20*(?:[:=]|=>|\bis\b)\x20*["']?(?P<v>[^\s"'<>,;]{{6,}})""", re.I | re.A),
    re.compile(r"""\b(?:bearer|basic)\x20+(?P<v>[A-Za-z0-9+/_.=~-]{8,})""", re.I | re.A),
    re.compile(r"""[a-z][a-z0-9+.-]{1,20}://[^\s/:@]{1,64}:(?P<v>[^\s/@]{4,})@""", re.I | re.A),
]
_WORDS_NEAR = ("pass", "secret", "token", "key", "credential", "pwd", "bearer", "basic", "://")

# Common passwords, most common first.
COMMON = """password 123456 123456789 qwerty 12345678 111111 1234567890 1234567 abc123 password1 iloveyou admin welcome
monkey login letmein dragon master sunshine princess football shadow superman michael trustno1 passw0rd hello freedom
whatever qazwsx changeme secret default root test guest user example sample token none null true false""".split()
ROWS = ("`1234567890-=", "qwertyuiop[]\\", "asdfghjkl;'", "zxcvbnm,./")
LEET = str.maketrans("4301$5!7@", "aeoissita")


def _neighbours() -> dict[str, set[str]]:
    """Keys side by side, or one row apart, on a keyboard."""
    at = {c: (x + 0.5 * y, y) for y, row in enumerate(ROWS) for x, c in enumerate(row)}
    return {a: {b for b, (u, v) in at.items() if a != b and abs(u - x) <= 1 and abs(v - y) <= 1} for a, (x, y) in at.items()}


NEIGHBOURS = _neighbours()
_DATE = re.compile(r"(?:(?:19|20)\d\d[-/.]?(?:0[1-9]|1[0-2])[-/.]?(?:0[1-9]|[12]\d|3[01])|(?:0[1-9]|[12]\d|3[01])[-/.]?(?:0[1-9]|1[0-2])[-/.]?(?:19|20)?\d\d|(?:19|20)\d\d)")


def vocabulary_ranks(path: str) -> dict[str, int]:
    """Words of three and more letters by rank: the common passwords, then the whole words of a
    tokenizer vocabulary in the order of their ids."""
    import json

    with open(path, encoding="utf-8") as f:
        vocab = json.load(f)["model"]["vocab"]
    ranks = {w: k + 1 for k, w in enumerate(COMMON)}
    for piece, _ in sorted(vocab.items(), key=lambda x: x[1]):
        word = piece.removesuffix("</w>")
        if piece.endswith("</w>") and len(word) >= 3 and word.isascii() and word.isalpha():
            ranks.setdefault(word, len(ranks) + 1)
    return ranks


def class_size(part: str) -> int:
    n = 26 * any(c.islower() for c in part) + 26 * any(c.isupper() for c in part) + 10 * any(c.isdigit() for c in part)
    return n + 33 * any(not c.isalnum() for c in part) or 10


def _segment_costs(value: str, ranks: dict[str, int]):
    """(start, end, log10 of guesses, kind) of every pattern in ``value``."""
    low = value.lower()
    plain = low.translate(LEET)
    n = len(value)
    for i in range(n):
        for j in range(i + 3, min(n, i + WINDOW) + 1):
            for form, extra in ((low, 1), (plain, 2)):
                rank = ranks.get(form[i:j])
                if rank:
                    upper = sum(c.isupper() for c in value[i:j])
                    yield i, j, math.log10(rank * extra * (2 ** min(upper, j - i - upper) if upper not in (0, j - i) else 1 + (upper > 0))), "word"
                    break
    for m in re.finditer(rf"(?=({_DATE.pattern}))", value):
        yield m.start(1), m.end(1), math.log10(365 * 100 if len(m[1]) > 4 else 120), "date"
    for m in re.finditer(r"(?=((.{1,8}?)\2{1,40}))", value):
        unit, times = m[2], len(m[1]) // len(m[2])
        if len(m[1]) >= 3:
            yield m.start(1), m.end(1), len(unit) * math.log10(class_size(unit)) + math.log10(times), "repeat"
    for step, kind in ((NEIGHBOURS, "walk"), (None, "sequence")):
        i = 0
        while i < n - 2:
            j, turns, last = i + 1, 1, None
            while j < n:
                if step is not None:
                    if low[j] not in step.get(low[j - 1], ()):
                        break
                    d = ord(low[j]) - ord(low[j - 1])
                    turns += d != last
                    last = d
                else:
                    d = ord(value[j]) - ord(value[j - 1])
                    if abs(d) != 1 or last not in (None, d):
                        break
                    last = d
                j += 1
            if j - i >= 3:
                bits = math.log10(47 * (j - i)) + min(turns, j - i) * math.log10(4.6) if step is not None else math.log10(26 * (j - i) * 2)
                yield i, j, bits, kind
            i = max(i + 1, j - 1)


def guess_cost(value: str, ranks: dict[str, int]) -> tuple[float, list[tuple[int, int, str]]]:
    """log10 of the guesses of the cheapest segmentation, and that segmentation. A segment's
    guesses multiply; every further segment costs an order that the guesser must also try."""
    n = len(value)
    best = np.full(n + 1, np.inf)
    best[0] = 0.0
    back: list = [None] * (n + 1)
    ends: dict[int, list] = {}
    for s in _segment_costs(value, ranks):
        ends.setdefault(s[1], []).append(s)
    unit = math.log10(class_size(value))
    for j in range(1, n + 1):
        # brute force: one character more, joined to a brute-force span before it
        new = back[j - 1] is None or back[j - 1][2] != "brute"
        best[j] = best[j - 1] + unit + (math.log10(2) if new else 0)
        back[j] = (j - 1 if new else back[j - 1][0], j, "brute")
        for i, _, cost, kind in ends.get(j, ()):
            c = best[i] + cost + math.log10(2)
            if c < best[j]:
                best[j], back[j] = c, (i, j, kind)
    parts, j = [], n
    while j:
        parts.append(back[j])
        j = back[j][0]
    return float(best[n]), parts[::-1]


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base matches."""
    out = []
    low = text.lower()
    if any(k in low for k in ("passw", "secret", "token", "api")):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    if _hex_run(text):
        out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


_IS_HEX = np.zeros(256, bool)
_IS_HEX[[*b"0123456789abcdef"]] = True


def _hex_run(text: str) -> bool:
    """Whether 24 hex digits in a row occur."""
    if len(text) < 24:
        return False
    other = np.flatnonzero(~_IS_HEX[np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)])
    if not len(other):
        return True
    size = len(text.encode("utf-8", "surrogatepass"))
    return int(max(other[0], size - 1 - other[-1], (np.diff(other) - 1).max(initial=0))) >= 24


def guess_spans(text: str, base: list[tuple[int, int, int]], ranks: dict[str, int], min_log10: float = MIN_LOG10):
    """(start, kind, end, cost) of costly values in credential context outside the base spans."""
    low = text.lower()
    if not any(k in low for k in _WORDS_NEAR):
        return []
    # what is taken, as disjoint spans in order; base spans of different kinds may overlap
    out, starts, ends = [], [], []
    for s, _, e in base:
        if starts and s < ends[-1]:
            ends[-1] = max(ends[-1], e)
        else:
            starts.append(s)
            ends.append(e)
    for pattern in CONTEXT:
        for m in pattern.finditer(text):
            s, e = m.span("v")
            while e > s and text[e - 1] in ".)]}:!?":
                e -= 1
            at = bisect_left(starts, e)  # spans before it begin before the value ends
            if e - s < 4 or (at and ends[at - 1] > s):
                continue
            cost, _ = guess_cost(text[s:e], ranks)
            if cost >= min_log10:
                starts.insert(at, s)
                ends.insert(at, e)
                out.append((s, 3, e, cost))
    return sorted(out)


def secret_spans(docs: DataFrame, vocabulary: str, doc_id: str = "doc_id", text: str = "text",
                 min_log10: float = MIN_LOG10) -> DataFrame:
    """One row per document: ``doc_id`` and ``spans`` (kind, start, end in code points, and for the
    method's spans the log10 of the guesses), by start, then kind as in ``KINDS``."""
    d = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("t"))

    def scan(rows):
        ranks = vocabulary_ranks(vocabulary)
        for i, t in rows:
            t = t or ""
            base = base_spans(t)
            found = sorted([(s, k, e, None) for s, k, e in base] + guess_spans(t, base, ranks, min_log10), key=lambda x: x[:3])
            yield i, [{"kind": KINDS[k], "start": s, "end": e, "log10_guesses": c} for s, k, e, c in found]

    kind = d.schema["doc_id"].dataType.simpleString()
    return map_rows(d, scan, f"doc_id {kind}, spans array<struct<kind:string,start:int,end:int,log10_guesses:double>>")


def digest(spans: DataFrame) -> DataFrame:
    """The contract's columns from ``secret_spans``."""
    own = F.filter("spans", lambda x: x["kind"] != "guess")
    joined = lambda a: F.array_join(F.transform(a, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    count = lambda k: F.size(F.filter("spans", lambda x: x["kind"] == k)).cast("long")
    return spans.select("doc_id", *[count(k).alias(f"n_{k}") for k in KINDS[:3]], F.sha2(joined(own), 256).alias("base_sha256"),
                        joined(F.col("spans")).alias("spans"), count("guess").alias("n_guess"),
                        F.array_max(F.transform("spans", lambda x: x["log10_guesses"])).alias("max_log10_guesses"))


