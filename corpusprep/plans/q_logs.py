"""Registered training-log queries (L1, L2, W4, A10, J8) over the derived log view."""

from __future__ import annotations

from corpusprep.functions.text import WS_CLASS
from corpusprep.operators import experiments as ex
from corpusprep.operators import logs as lg
from corpusprep.plans import fixtures as fx
from corpusprep.plans.registry import register

# An example search space for the report queries (three settings, twelve configurations).
EXAMPLE_GRID = {
    "corpus_size": ["small", "medium", "large"],
    "dropout": [0.1, 0.3],
    "width": [256, 512],
}

_D_EXTRACT = ("scores", " UNION ALL ".join(
    f"""SELECT run, line_no, '{name}' AS metric,
               CASE WHEN raw = 'nan' THEN CAST('NaN' AS DOUBLE) ELSE TRY_CAST(raw AS DOUBLE) END AS value
        FROM (SELECT run, line_no, regexp_extract(text, '{lg._quote(label)}:{WS_CLASS}*(nan|[0-9.]+)', 1) AS raw FROM log_lines)
        WHERE raw <> ''""" for name, label in lg.METRIC_PATTERNS))
_D_ORD = ("ord", "SELECT *, CAST(row_number() OVER (PARTITION BY run, metric ORDER BY line_no) AS BIGINT) AS ordinal FROM scores")
_D_BEST = ("best", """
    SELECT run, metric, max(v) AS max_value,
           CAST(min(CASE WHEN v = mv THEN ordinal END) AS BIGINT) AS best_ordinal, CAST(count(*) AS BIGINT) AS n_values
    FROM (SELECT *, CASE WHEN isnan(value) THEN NULL ELSE value END AS v,
                 max(CASE WHEN isnan(value) THEN NULL ELSE value END) OVER (PARTITION BY run, metric) AS mv FROM ord)
    GROUP BY run, metric""")


def _d_configs() -> tuple[str, str]:
    rows = sorted(ex.grid_rows(EXAMPLE_GRID), key=lambda r: tuple(r.values()))
    vals = ", ".join("('output_{}', {})".format(i, ", ".join(repr(v) if isinstance(v, str) else str(v) for v in r.values()))
                     for i, r in enumerate(rows))
    cols = ", ".join(EXAMPLE_GRID)
    return ("configs", f"SELECT * FROM (VALUES {vals}) t(run, {cols})")


@register("extract_metrics", oracle=fx.oracle(["log_lines"], "SELECT * FROM scores", [_D_EXTRACT]))
def q_extract_metrics(spark, d):
    return lg.extract_metrics(fx.log_lines(spark, d), "text", keep=["run", "line_no"])


@register("with_ordinal", oracle=fx.oracle(["log_lines"], "SELECT * FROM ord", [_D_EXTRACT, _D_ORD]))
def q_with_ordinal(spark, d):
    return lg.with_ordinal(lg.extract_metrics(fx.log_lines(spark, d), "text", keep=["run", "line_no"]))


@register("best_per_run", oracle=fx.oracle(["log_lines"], "SELECT * FROM best", [_D_EXTRACT, _D_ORD, _D_BEST]))
def q_best_per_run(spark, d):
    scores = lg.with_ordinal(lg.extract_metrics(fx.log_lines(spark, d), "text", keep=["run", "line_no"]))
    return lg.best_per_run(scores)


def _report_sql(metric: str) -> str:
    return f"""
    SELECT c.run, {', '.join('c.' + k for k in EXAMPLE_GRID)}, b.max_value AS max_{metric}
    FROM configs c LEFT JOIN (SELECT * FROM best WHERE metric = '{metric}') b USING (run)"""


@register("summarise_runs", oracle=fx.oracle(["log_lines"], _report_sql("bleu"), [_D_EXTRACT, _D_ORD, _D_BEST, _d_configs()]))
def q_summarise_runs(spark, d):
    configs = ex.plan_experiments(spark, EXAMPLE_GRID)
    return lg.summarise_runs(fx.log_lines(spark, d), configs, list(EXAMPLE_GRID))


@register("report", oracle=fx.oracle(["log_lines"], _report_sql("acc"), [_D_EXTRACT, _D_ORD, _D_BEST, _d_configs()]))
def q_report(spark, d):
    configs = ex.plan_experiments(spark, EXAMPLE_GRID)
    scores = lg.with_ordinal(lg.extract_metrics(fx.log_lines(spark, d), "text", keep=["run", "line_no"]))
    return lg.report(configs, lg.best_per_run(scores), list(EXAMPLE_GRID), metric="acc", out="max_acc")
