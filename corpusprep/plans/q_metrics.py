"""Registered scoring queries (A7-A9, A11) and their DuckDB oracles."""

from __future__ import annotations


from corpusprep.functions import text as tx
from corpusprep.operators import metrics as mt
from corpusprep.plans import fixtures as fx
from corpusprep.plans.q_text import d_t1, d_tok
from corpusprep.plans.registry import register
from corpusprep.sources.lines import with_run_step

WS = tx.WS_CLASS
SYM = r"([\x{7B}-\x{7E}\x{5B}-\x{60}\x{20}-\x{26}\x{28}-\x{2B}\x{3A}-\x{40}\x{2F}])"


def d_13a(c: str) -> str:
    s = f"regexp_replace({c}, '{WS}+$', '')"
    for a, b in (("'<skipped>'", "''"), ("'-' || chr(10)", "''"), ("chr(10)", "' '"), ("'&quot;'", "'\"'"),
                 ("'&amp;'", "'&'"), ("'&lt;'", "'<'"), ("'&gt;'", "'>'")):
        s = f"replace({s}, {a}, {b})"
    s = f"(' ' || {s} || ' ')"
    s = f"regexp_replace({s}, '{SYM}', ' \\1 ', 'g')"
    s = f"regexp_replace({s}, '([^0-9])([\\.,])', '\\1 \\2 ', 'g')"
    s = f"regexp_replace({s}, '([\\.,])([^0-9])', ' \\1 \\2', 'g')"
    s = f"regexp_replace({s}, '([0-9])(-)', '\\1 \\2 ', 'g')"
    return d_tok(s)


def d_chars(c: str) -> str:
    return f"list_filter(string_split(regexp_replace({c}, '{WS}+', '', 'g'), ''), lambda x: x <> '')"


def d_ngram_ctes(units_sql: str, max_n: int, sep: str, keys: str) -> list[tuple[str, str]]:
    """CTEs ``u`` (unit arrays), ``pos`` / ``win`` / ``grams`` (n-grams by ``lead``) and ``piv``
    (per keys-group: hyp, ref, match for each n) from ``units_sql`` selecting
    ``keys..., pair, hu, ru``."""
    gcols = []
    for n in range(1, max_n + 1):
        e = "x"
        for j in range(1, n):
            e += f" || '{sep}' || lead(x, {j}) OVER w"
        gcols.append(f"{e} AS g{n}")
    return [
        ("u", units_sql),
        ("pos", f"""SELECT {keys}, pair, 1 AS h, 0 AS r, unnest(hu) AS x, unnest(range(len(hu))) AS i FROM u
                    UNION ALL
                    SELECT {keys}, pair, 0 AS h, 1 AS r, unnest(ru) AS x, unnest(range(len(ru))) AS i FROM u"""),
        ("win", f"SELECT {keys}, pair, h, r, {', '.join(gcols)} FROM pos WINDOW w AS (PARTITION BY {keys}, pair, h ORDER BY i)"),
        ("grams", f"""SELECT {keys}, pair, h, r, CAST(substr(nn, 2) AS INTEGER) AS n, gram
                      FROM (UNPIVOT win ON {', '.join(f'g{n}' for n in range(1, max_n + 1))} INTO NAME nn VALUE gram)"""),
        ("per", f"SELECT {keys}, pair, n, gram, sum(h) AS h, sum(r) AS r FROM grams GROUP BY {keys}, pair, n, gram"),
        ("nstats", f"""SELECT {keys}, n, CAST(sum(h) AS BIGINT) AS hyp, CAST(sum(r) AS BIGINT) AS ref,
                              CAST(sum(least(h, r)) AS BIGINT) AS match FROM per GROUP BY {keys}, n"""),
        ("piv", f"SELECT {keys}, " + ", ".join(
            f"CAST(coalesce(sum(CASE WHEN n = {n} THEN {c} END), 0) AS BIGINT) AS {c}{n}"
            for n in range(1, max_n + 1) for c in ("hyp", "ref", "match")) + f" FROM nstats GROUP BY {keys}"),
    ]


def d_bleu_select(keys: str) -> str:
    k = ["0"]
    logs = []
    for n in range(1, 5):
        k.append(f"{k[-1]} + CASE WHEN match{n} = 0 THEN 1 ELSE 0 END")
        p = (f"CASE WHEN match{n} = 0 THEN 100.0 / (pow(2.0, {k[-1]}) * hyp{n}) "
             f"ELSE 100.0 * match{n} / hyp{n} END")
        logs.append(f"ln({p})")
    bp = "CASE WHEN hyp1 >= ref1 THEN 1.0 WHEN hyp1 = 0 THEN 0.0 ELSE exp(1.0 - ref1 / hyp1) END"
    score = (f"CASE WHEN match1 + match2 + match3 + match4 = 0 OR hyp4 = 0 THEN 0.0 "
             f"ELSE ({bp}) * exp(({' + '.join(logs)}) / 4.0) END")
    return f"SELECT {keys}, round({score}, 4) AS bleu, hyp1 AS sys_len, ref1 AS ref_len FROM piv"


def d_chrf_select(keys: str) -> str:
    both = [f"(hyp{n} > 0 AND ref{n} > 0)" for n in range(1, 7)]
    eff = " + ".join(f"CASE WHEN {b} THEN 1 ELSE 0 END" for b in both)
    prec = " + ".join(f"CASE WHEN {b} THEN match{n} / hyp{n} ELSE 0.0 END" for n, b in zip(range(1, 7), both))
    rec = " + ".join(f"CASE WHEN {b} THEN match{n} / ref{n} ELSE 0.0 END" for n, b in zip(range(1, 7), both))
    inner = f"""SELECT {keys}, CASE WHEN ({eff}) > 0 THEN ({prec}) / ({eff}) ELSE 0.0 END AS p,
                       CASE WHEN ({eff}) > 0 THEN ({rec}) / ({eff}) ELSE 0.0 END AS rr FROM piv"""
    return f"""SELECT {keys}, round(CASE WHEN p + rr > 0 THEN 100.0 * 5.0 * p * rr / (4.0 * p + rr) ELSE 0.0 END, 4) AS chrf
               FROM ({inner})"""


# --- A7 / A8 on hyp_ref grouped by language -------------------------------------------------------

@register("corpus_bleu", oracle=fx.oracle(["hyp_ref"], d_bleu_select("grp"), d_ngram_ctes(
    f"SELECT grp, pair_id AS pair, {d_13a('hyp')} AS hu, {d_13a('ref')} AS ru FROM hyp_ref", 4, " ", "grp")))
def q_corpus_bleu(spark, d):
    return mt.corpus_bleu(fx.hyp_ref(spark, d), "hyp", "ref", ["grp"], ["pair_id"])


@register("corpus_chrf", oracle=fx.oracle(["hyp_ref"], d_chrf_select("grp"), d_ngram_ctes(
    f"SELECT grp, pair_id AS pair, {d_chars('hyp')} AS hu, {d_chars('ref')} AS ru FROM hyp_ref", 6, "", "grp")))
def q_corpus_chrf(spark, d):
    return mt.corpus_chrf(fx.hyp_ref(spark, d), "hyp", "ref", ["grp"], ["pair_id"])


# --- A9: every prediction file against the references ----------------------------------------------

_PRED = f"""SELECT regexp_extract(p.path, 'output_[0-9]+', 0) AS run,
                   TRY_CAST(nullif(regexp_extract(p.path, '_step_([0-9]+)', 1), '') AS INTEGER) AS step,
                   p.line_no AS pair, regexp_replace(p.text, '@@{WS}', '', 'g') AS hyp, r.text AS ref
            FROM pred_lines p JOIN ref_lines r USING (line_no)"""


@register("score_runs", oracle=fx.oracle(["pred_lines", "ref_lines"], f"""
    SELECT b.run, b.step, b.bleu, b.sys_len, b.ref_len, c.chrf, u.n_extra, u.n_missing
    FROM ({d_bleu_select('run, step')}) b FULL OUTER JOIN (
        WITH {', '.join(f'{n} AS ({body})' for n, body in d_ngram_ctes(
            f"SELECT run, step, pair, {d_chars('hyp')} AS hu, {d_chars('ref')} AS ru FROM pj", 6, "", "run, step"))}
        {d_chrf_select('run, step')}) c USING (run, step) JOIN (
        SELECT run, step, CAST(count(*) - count(ref) AS BIGINT) AS n_extra,
               CAST((SELECT count(*) FROM ref_lines) - count(ref) AS BIGINT) AS n_missing
        FROM ({_PRED.replace('JOIN ref_lines', 'LEFT JOIN ref_lines')}) GROUP BY run, step) u USING (run, step)""",
    [("pj", _PRED)] + d_ngram_ctes(
        f"SELECT run, step, pair, {d_13a('hyp')} AS hu, {d_13a('ref')} AS ru FROM pj", 4, " ", "run, step")))
def q_score_runs(spark, d):
    preds = with_run_step(fx.pred_lines(spark, d))
    return mt.score_runs(preds, fx.references(spark, d))


# --- A11: the same references, hypotheses before and after a rewriting step ---------------------------

@register("compare_scores", oracle=fx.oracle(["hyp_ref"], d_bleu_select("grp, system"), d_ngram_ctes(
    f"""SELECT grp, 'hyp' AS system, pair_id AS pair, {d_13a('hyp')} AS hu, {d_13a('ref')} AS ru FROM hyp_ref
        UNION ALL
        SELECT grp, 'rewritten', pair_id, {d_13a(d_t1('hyp'))}, {d_13a('ref')} FROM hyp_ref""", 4, " ", "grp, system")))
def q_compare_scores(spark, d):
    hr = fx.hyp_ref(spark, d).withColumn("rewritten", tx.split_punctuation("hyp"))
    return mt.compare_scores(hr, "ref", ["hyp", "rewritten"], ["pair_id"], ["grp"])
