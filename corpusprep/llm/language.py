"""Language identification by Bayesian evidence fusion.

For a page and a language l, in logarithms,

    score(l) = host(l) + declared(l) + address(l) + weight * text(l)

* text: character n-grams (1 to 3 letters, hashed) under a multinomial model with additive
  smoothing, fitted on labelled documents. Overlapping n-grams are not independent, so the sum over
  the whole text is tempered: a text counts as at most ``TEXT_UNITS`` independent n-grams.
* declared, address: how often a declared markup language, or an address suffix (top-level domain,
  and a language-like subdomain or first path part), goes with l, counted over all pages against the
  text's own verdict and smoothed.
* host: counts of the text verdicts on the page's host, smoothed towards the counts of its
  registered domain, those towards its top-level domain, those towards all pages. The page's own
  verdict is taken out of every count.

All counts are grouped aggregations over all pages; counts by host are joined back by host as shuffle
joins, so a host with a third of all pages can be split. Fitting reads a bounded sample of labelled
documents (``FIT_ROWS``, by lowest hash): the only bound, and a parameter.

Edge cases: NULL or empty html has no text evidence and is named by its address and host alone; NULL
urls, unknown declarations and unknown suffixes are values of their own; pages are handled row by row;
without labelled documents there are no languages and the result is empty; extra columns are ignored.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusprep.llm.common import fixed, map_rows, small_side
from corpusprep.llm.html_text import Page, host_of

FIT_ROWS = 20_000
BUCKETS = 1 << 16
ALPHA = 0.5
TEXT_UNITS = 60.0
KAPPA = 4.0

_NOT_LETTER = re.compile(r"[\W\d_]+")
_DECLARED = re.compile(r"""<html\b[^>]*?\blang\s*=\s*["']?([A-Za-z]{2,3})""", re.I)
_META = re.compile(r"""<meta\b(?=[^>]*\bhttp-equiv\s*=\s*["']?content-language\b)[^>]*?\bcontent\s*=\s*["']?([A-Za-z]{2,3})\b""", re.I)


def grams(text: str) -> np.ndarray:
    """Buckets of the letter n-grams (1 to 3) of a whole text, words padded by a space."""
    s = " " + _NOT_LETTER.sub(" ", text.lower()).strip() + " "
    if len(s) <= 2:
        return np.zeros(0, np.int64)
    c = np.frombuffer(s.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    with np.errstate(over="ignore"):
        one = c * np.uint64(0x9E3779B97F4A7C15)
        two = (one[:-1] ^ np.uint64(0x51ED270B)) * np.uint64(0xBF58476D1CE4E5B9) + one[1:]
        three = (two[:-1] ^ np.uint64(0x2545F491)) * np.uint64(0x94D049BB133111EB) + one[2:]
    h = np.concatenate([one[c != 32], two, three])
    return ((h >> np.uint64(33)) % np.uint64(BUCKETS)).astype(np.int64)


class TextModel:
    """log P(n-gram | language) as a table of languages x buckets."""

    def __init__(self, languages: list[str], counts: np.ndarray):
        self.languages = languages
        c = counts + ALPHA
        self.logp = np.log(c / c.sum(axis=1, keepdims=True))

    def score(self, text: str) -> tuple[list[float], int]:
        """Tempered log likelihood for each language, and the number of n-grams."""
        g = grams(text)
        if not len(g):
            return [0.0] * len(self.languages), 0
        # a long text goes by its bucket counts, so that memory is that of the table
        total = self.logp[:, g].sum(axis=1) if len(g) <= 1 << 13 else self.logp @ np.bincount(g, minlength=BUCKETS)
        return (total * (min(1.0, TEXT_UNITS / len(g)))).tolist(), len(g)


def fit(documents: DataFrame, text: str = "text", lang: str = "lang", max_rows: int = FIT_ROWS) -> TextModel:
    """The text model from at most ``max_rows`` different labelled texts, those of lowest hash. The
    counts (languages x buckets) have a fixed size, whatever the data."""
    labelled = documents.where(F.col(text).isNotNull() & F.col(lang).isNotNull()).select(F.col(lang).alias("l"), F.col(text).alias("t"), F.xxhash64(text, lang).alias("h"))
    # only hashes meet to find the bound; the texts are read where they lie, equal ones once
    top = labelled.select("h").distinct().orderBy("h").limit(max_rows).agg(F.max("h")).first()[0]
    if top is None:
        return TextModel([], np.zeros((0, BUCKETS)))
    sample = labelled.where(F.col("h") <= top).groupBy("h").agg(F.first("l").alias("l"), F.first("t").alias("t")).select("l", "t")

    def count(rows):
        own: dict[str, np.ndarray] = {}
        for l, t in rows:
            own.setdefault(l, np.zeros(BUCKETS, np.int64))
            own[l] += np.bincount(grams(t), minlength=BUCKETS)
        for l, c in own.items():
            at = np.flatnonzero(c)
            yield from ((l, int(b), int(n)) for b, n in zip(at, c[at]))

    got = map_rows(sample, count, "l string, b int, n long").groupBy("l", "b").agg(F.sum("n").alias("n")) \
        .groupBy("l").agg(F.collect_list("b").alias("b"), F.collect_list("n").alias("n")).collect()
    languages = sorted(r["l"] for r in got)
    counts = np.zeros((len(languages), BUCKETS))
    for r in got:
        counts[languages.index(r["l"]), r["b"]] = r["n"]
    return TextModel(languages, counts)


def address_suffix(url: str | None, host: str) -> str:
    """Top-level domain, language-like subdomain and language-like first part of the path."""
    labels = host.split(".")
    path = re.match(r"[^:]*://[^/?#]*/([A-Za-z]{2}(?:[-_][A-Za-z]{2})?)(?:[/?#]|\Z)", url or "")
    sub = labels[0].lower() if len(labels) > 2 and len(labels[0]) == 2 else ""
    return f"{labels[-1]}|{sub}|{path[1][:2].lower() if path else ''}"


def registered(host: str) -> str:
    """The domain under which a host was registered: two labels, or three below a country's own second
    level (co.uk, com.au, or.jp: at most three letters under two)."""
    labels = host.split(".")
    wide = len(labels) > 2 and len(labels[-1]) == 2 and len(labels[-2]) <= 3
    return ".".join(labels[-3 if wide else -2:])


def declared_language(html: str | None) -> str:
    """The language of the ``html`` element (``lang`` or ``xml:lang``), else of a content-language
    ``meta``; empty if there is none."""
    head = (html or "")
    end = head.lower().find("<body")
    head = head if end < 0 else head[:end]
    m = _DECLARED.search(head) or _META.search(head)
    return m[1].lower() if m else ""


def evidence(pages: DataFrame, model: TextModel, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """One narrow row per page: what speaks for its language, and the text's own verdict."""
    sent = pages.sparkSession.sparkContext.broadcast(model)
    p = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), host_of(url).alias("host"), F.col(html).alias("x"))

    def run(rows):
        model = sent.value
        for i, u, host, x in rows:
            page = Page(x)
            blocks = page.candidates()
            score, n = model.score("\n".join(t for _, t, _ in blocks))
            verdict = model.languages[int(np.argmax(score))] if n else None
            yield i, u, host, registered(host), host.split(".")[-1], declared_language(x), address_suffix(u, host), score, verdict

    kind = p.schema["page_id"].dataType.simpleString()
    return map_rows(p, run, f"page_id {kind}, url string, host string, domain string, tld string, declared string, suffix string, text array<double>, verdict string")


def identify(pages: DataFrame, documents: DataFrame, max_fit_rows: int = FIT_ROWS, page_id: str = "page_id",
             url: str = "url", html: str = "html", model: TextModel | None = None) -> DataFrame:
    """One row per page: ``page_id``, ``url``, ``host``, ``declared``, ``suffix``, ``text_lang`` (by
    the text alone), ``lang`` and its ``posterior``."""
    model = model or fit(documents, max_rows=max_fit_rows)
    languages = model.languages
    e = fixed(evidence(pages, model, page_id, url, html)) if languages else None
    if e is None:
        kind = pages.schema[page_id].dataType.simpleString()
        return pages.sparkSession.createDataFrame([], f"page_id {kind}, url string, host string, declared string, suffix string, text_lang string, lang string, posterior double")
    n = len(languages)
    hit = [F.sum(F.when(F.col("verdict") == l, 1).otherwise(0)).cast("double") for l in languages]

    def counted(key):
        return fixed(e.groupBy(F.col(key).alias(f"by_{key}")).agg(F.array(*hit).alias(f"n_{key}")))

    out = e
    for key in ("host", "domain", "tld", "declared", "suffix"):
        c = counted(key)
        out = out.join(small_side(c, 50_000), F.col(key) == F.col(f"by_{key}"), "left").drop(f"by_{key}")
    everywhere = e.agg(F.array(*hit).alias("n")).first()["n"]  # one number for each language
    out = out.withColumn("n_all", F.array(*[F.lit(float(x or 0)) for x in everywhere]))

    own = F.array(*[F.when(F.col("verdict") == l, 1.0).otherwise(0.0) for l in languages])
    minus = lambda a: F.zip_with(a, own, lambda x, y: x - y)
    smoothed = lambda a, parent, t: F.zip_with(a, parent, lambda x, p: (x + KAPPA * p) / (t + KAPPA))
    rated = lambda a, r: F.zip_with(a, "n_all", lambda x, y: (x + KAPPA * r) / (y + KAPPA))
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    out = out.withColumns({f"n_{k}": minus(F.col(f"n_{k}")) for k in ("host", "domain", "tld", "declared", "suffix", "all")})
    out = out.withColumns({f"t_{k}": total(F.col(f"n_{k}")) for k in ("host", "domain", "tld", "all")})
    # the prior, from all pages down to the host
    out = out.withColumn("p_all", F.transform("n_all", lambda x: (x + 1) / (F.col("t_all") + n)))
    for k, parent in (("tld", "all"), ("domain", "tld"), ("host", "domain")):
        out = out.withColumn(f"p_{k}", smoothed(f"n_{k}", f"p_{parent}", F.col(f"t_{k}")))
    # P(value | l) = (pages of l with it + a share of its rate among all) / pages of l
    for k in ("declared", "suffix"):
        out = out.withColumn(f"r_{k}", (total(F.col(f"n_{k}")) + 1) / (F.col("t_all") + n + 1))
        out = out.withColumn(f"l_{k}", rated(f"n_{k}", F.col(f"r_{k}")))
    score = F.zip_with(F.zip_with(F.zip_with("text", "p_host", lambda t, p: t + F.ln(p)), "l_declared", lambda s, p: s + F.ln(p)), "l_suffix", lambda s, p: s + F.ln(p))
    out = out.withColumn("score", score).withColumn("top", F.array_max("score"))
    names = F.array(*[F.lit(l) for l in languages])
    return out.select("page_id", "url", "host", "declared", "suffix", F.col("verdict").alias("text_lang"),
                      F.get(names, F.array_position("score", F.col("top")).cast("int") - 1).alias("lang"),
                      (1 / F.aggregate("score", F.lit(0.0), lambda s, x: s + F.exp(x - F.col("top")))).alias("posterior"))


