import math

import numpy as np
from edge_rows import SMALL
from pyspark.sql import functions as F

from corpusprep.llm import queries as Q
from corpusprep.llm.language import KAPPA, TextModel, address_suffix, evidence, fit, grams, identify


def test_held_out_accuracy(spark):
    """Documents that the model has not seen, as pages without any other evidence."""
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("length(text) >= 40")
    model = fit(d.where("doc_id % 2 = 0"))
    test = d.where("doc_id % 2 = 1").select(F.col("doc_id").alias("page_id"), F.lit(None).cast("string").alias("url"), F.col("text").alias("html"), "lang")
    got = identify(test, d, model=model).select("page_id", F.col("lang").alias("got")).join(test, "page_id")
    n, right = got.agg(F.count(F.lit(1)), F.sum((F.col("got") == F.col("lang")).cast("int"))).first()
    assert n > 400 and right >= 0.97 * n


def test_fit_is_bounded(spark):
    d = spark.read.parquet(f"{SMALL}/documents.parquet")
    assert set(fit(d, max_rows=30).languages) <= {"de", "en", "es", "fr"}
    assert fit(d.limit(0)).languages == [] and identify(spark.read.parquet(f"{SMALL}/pages.parquet"), d.limit(0)).count() == 0


def test_scores_by_definition(spark):
    """The fused posterior against the formula, page by page."""
    pages = spark.read.parquet(f"{SMALL}/pages.parquet").limit(40)
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    model = fit(docs)
    e = evidence(pages, model).collect()
    langs = model.languages
    n = len(langs)
    got = {r["page_id"]: r for r in identify(pages, docs, model=model).collect()}
    assert len(got) == len(e)
    for r in e:
        others = [x for x in e if x["page_id"] != r["page_id"]]

        def count(key, l):
            return sum(x["verdict"] == l and (key is None or x[key] == r[key]) for x in others)
        score = []
        for k, l in enumerate(langs):
            all_n = sum(count(None, m) for m in langs)
            p = (count(None, l) + 1) / (all_n + n)
            for key in ("tld", "domain", "host"):
                p = (count(key, l) + KAPPA * p) / (sum(count(key, m) for m in langs) + KAPPA)
            s = r["text"][k] + math.log(p)
            for key in ("declared", "suffix"):
                rate = (sum(count(key, m) for m in langs) + 1) / (all_n + n + 1)
                s += math.log((count(key, l) + KAPPA * rate) / (count(None, l) + KAPPA))
            score.append(s)
        top = int(np.argmax(score))
        assert got[r["page_id"]]["lang"] == langs[top]
        assert abs(got[r["page_id"]]["posterior"] - 1 / sum(math.exp(x - max(score)) for x in score)) < 1e-6


def test_evidence_beyond_text(spark):
    """A page without text is named by its host; pages of one host inform each other."""
    docs = spark.createDataFrame([("die und der ist nicht ein zu mit", "de"), ("the and that was not of with", "en")] * 3, "text string, lang string")
    rows = [(k, "https://de.site.example/x", '<html lang="de"><p>die und der ist nicht ein zu mit</p>') for k in range(6)]
    rows += [(20 + k, "https://other.example.com/en/x", "<html lang=en><p>the and that was not of with</p>") for k in range(6)]
    rows += [(10, "https://de.site.example/y", '<html lang="de"><body></body>'), (None, None, None), (11, "nonsense", "<p>xx")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("lang", F.lit("clash")).withColumn("top", F.lit(1))
    got = {r["page_id"]: r for r in identify(df, docs).collect()}
    assert len(got) == 15 and got[10]["lang"] == "de" and got[10]["text_lang"] is None and got[20]["lang"] == "en"
    assert identify(df.limit(0), docs).count() == 0


def test_parts():
    assert address_suffix("http://de.x.com/en-us/a", "de.x.com") == "com|de|en" and address_suffix(None, "?") == "?||"
    assert len(grams("")) == 0 and len(grams("12 34")) == 0 and len(grams("a b")) == 2 + 4 + 3
    m = TextModel(["a"], np.ones((1, 1 << 16)))
    assert m.score("") == ([0.0], 0)


def test_query(spark):
    rows = Q.op6_language_id(spark, SMALL).collect()
    assert len(rows) == 50 and all(r["lang"] in ("de", "en", "es", "fr") for r in rows)
    assert sum(f"/{r['lang']}/" in r["url"] for r in rows) >= 48


def test_declared_and_registered():
    from corpusprep.llm.language import declared_language, registered
    assert [declared_language(x) for x in ("<html lang=de>", '<html xml:lang="fr-CA"><body lang=x>', '<meta content="es" http-equiv="Content-Language">',
                                           "<body><meta http-equiv=content-language content=it>", "<html>", None)] == ["de", "fr", "es", "", "", ""]
    assert [registered(h) for h in ("www.a.co.uk", "a.co.uk", "x.y.example.com", "example.de", "de", "b.a.blog.de")] == \
        ["a.co.uk", "a.co.uk", "example.com", "example.de", "de", "blog.de"]
