"""Scenario projections on trend forecasts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import forecast as P
from ..operators import scenario as C
from . import views as V
from .forecast_sql import all_models_sql, full_outer
from .registry import query, rounded

KEYS = ["Region", "Category"]
LEVERS = (12, 5, -4, 15, 6, 3)

BASE_SQL = all_models_sql(KEYS, full_outer(KEYS, 12)) + """,
b AS (SELECT Region, Category, step, CAST(last_d + to_months(CAST(step AS INTEGER)) AS DATE) AS d, f, 12 AS n
  FROM af JOIN size USING (Region, Category) WHERE model_key = 'linear_trend')"""


def _value(g, s, dd, m, c, ch) -> str:
    return (f"greatest(f * pow(pow(1 + {g} / 100.0::DOUBLE, 1 / 12.0::DOUBLE), step) * (1 + {s} / 100.0::DOUBLE * sin(2 * pi() * (step - 1) / (n - 1)))"
            f" * (1 + {dd} / 100.0::DOUBLE) * CASE WHEN {m} > 0 THEN 1 + {m} / 100.0::DOUBLE * least(step / 3.0::DOUBLE, 1) ELSE 1 END"
            f" * CASE WHEN {c} > 0 THEN greatest(1 - {c} / 100.0::DOUBLE * (step - 1) / n, 0.5::DOUBLE) ELSE 1 END * (1 + {ch} / 100.0::DOUBLE), 0)")


def _preset_values(table) -> str:
    return ", ".join(f"('{k}', {', '.join(f'{x}::DOUBLE' for x in v)})" for k, v in table.items())


def _scenarios_sql(table) -> str:
    return (BASE_SQL + f", scn AS (SELECT * FROM (VALUES {_preset_values(table)}) t(scenario, g, s, dd, m, c, ch)),"
            f"x AS (SELECT b.*, scenario, {_value('g', 's', 'dd', 'm', 'c', 'ch')} AS v FROM b, scn)")


_ALONE = {k: tuple(v if i == j else 0 for j in range(6)) for i, (k, v) in enumerate(zip(C.LEVERS, LEVERS))}
_PRESET_SQL = _scenarios_sql(C.PRESETS)


def _base(spark, d):
    return P.forecast(V.sales(spark, d), "linear_trend", 12, KEYS)


def _all(spark, d):
    return C.apply_scenarios(_base(spark, d), KEYS)


@query("scenario_apply", BASE_SQL + f"""
SELECT Region, Category, step, d AS "Date", round(f, 2) AS "Forecast", round({_value(*LEVERS)}, 2) AS "Value" FROM b""")
def scenario_apply(spark, d):
    out = C.apply_levers(_base(spark, d), dict(zip(C.LEVERS, LEVERS)), KEYS)
    return rounded(out.select(*KEYS, "step", "Date", "Forecast", "Value"))


@query("scenario_presets", _PRESET_SQL + """
SELECT Region, Category, scenario, step, d AS "Date", round(f, 2) AS "Forecast", round(v, 2) AS "Value" FROM x""")
def scenario_presets(spark, d):
    return rounded(_all(spark, d))


@query("lever_breakdown", _scenarios_sql(_ALONE) + """,
t AS (SELECT Region, Category, scenario AS lever, sum(v) - sum(f) AS delta FROM x GROUP BY ALL HAVING abs(sum(v) - sum(f)) > 0.01)
SELECT Region, Category, lever, round(delta, 2) AS delta,
  row_number() OVER (PARTITION BY Region, Category ORDER BY delta DESC, lever) AS rank FROM t""")
def lever_breakdown(spark, d):
    return rounded(C.lever_breakdown(_base(spark, d), LEVERS, KEYS))


@query("lever_drivers", _scenarios_sql(_ALONE) + """,
t AS (SELECT Region, Category, scenario AS lever, sum(v) - sum(f) AS delta FROM x GROUP BY ALL)
SELECT Region, Category, (list(lever ORDER BY delta DESC, lever) FILTER (WHERE delta > 0))[1] AS top_positive,
  round(max(delta) FILTER (WHERE delta > 0), 2) AS top_positive_delta,
  (list(lever ORDER BY delta, lever) FILTER (WHERE delta < 0))[1] AS top_negative,
  round(min(delta) FILTER (WHERE delta < 0), 2) AS top_negative_delta,
  round(sum(greatest(delta, 0)), 2) AS upside, round(sum(greatest(-delta, 0)), 2) AS downside FROM t GROUP BY Region, Category""")
def lever_drivers(spark, d):
    return rounded(C.lever_drivers(_base(spark, d), LEVERS, KEYS))


@query("scenario_summary", _PRESET_SQL + """,
t AS (SELECT Region, Category, scenario, sum(v) AS total, avg(v) AS mean, sum(f) AS base, (list(d ORDER BY v DESC, d))[1] AS peak FROM x GROUP BY ALL)
SELECT Region, Category, scenario, round(total, 2) AS total, round(mean, 2) AS mean, round(total - base, 2) AS delta,
  round((total - base) / base * 100, 4) AS delta_pct, peak AS peak_month,
  round(sum(CASE scenario WHEN 'best' THEN total WHEN 'worst' THEN -total END) OVER (PARTITION BY Region, Category), 2) AS best_worst_spread
FROM t""")
def scenario_summary(spark, d):
    return rounded(C.scenario_summary(_all(spark, d), KEYS), 2, delta_pct=4)


@query("scenario_running", _PRESET_SQL + """
SELECT Region, Category, scenario, step, d AS "Date", round(f, 2) AS "Forecast", round(v, 2) AS "Value",
  round(sum(v) OVER (PARTITION BY Region, Category, scenario ORDER BY step), 2) AS "Cumulative", round(v - f, 2) AS "Difference" FROM x""")
def scenario_running(spark, d):
    return rounded(C.scenario_running(_all(spark, d), KEYS))


@query("break_even", _scenarios_sql({**C.PRESETS, "late": (30, 0, -12, 0, 0, 0)}) + """,
c AS (SELECT *, sum(v - f) OVER (PARTITION BY Region, Category, scenario ORDER BY step) AS gap FROM x),
t AS (SELECT Region, Category, scenario, sum(v) - sum(f) AS delta, min(d) FILTER (WHERE gap > 0) AS first FROM c GROUP BY ALL),
u AS (SELECT *, CASE WHEN delta < 0 THEN 'not_reached' WHEN delta > 0 AND first IS NOT NULL THEN 'reached' ELSE 'already_above' END AS status FROM t)
SELECT Region, Category, scenario, round(delta, 2) AS delta, status, CASE WHEN status = 'reached' THEN first END AS month FROM u""")
def break_even(spark, d):
    table = {**C.PRESETS, "late": (30, 0, -12, 0, 0, 0)}
    return rounded(C.break_even(C.apply_scenarios(_base(spark, d), KEYS, table), KEYS))


@query("scenario_wide", _PRESET_SQL + """
SELECT Region, Category, d AS "Date", round(f, 2) AS "Forecast", """ + ", ".join(
    f"round(max(v) FILTER (WHERE scenario = '{s}'), 2) AS {s}" for s in C.PRESETS)
    + """, strftime(d, '%b %Y') AS "Month" FROM x GROUP BY Region, Category, d, f""")
def scenario_wide(spark, d):
    return rounded(C.scenario_wide(_all(spark, d), KEYS))


@query("assumption_load", """
WITH l AS (SELECT c_custkey, CAST(c_custkey % 41 - 10 AS DOUBLE) AS growth, CAST(c_custkey % 21 - 10 AS DOUBLE) AS seasonality,
  CAST(-(c_custkey % 16) AS DOUBLE) AS discount, CAST(c_custkey % 26 AS DOUBLE) AS marketing, CAST(c_custkey % 13 AS DOUBLE) AS churn,
  CAST(c_custkey % 18 AS DOUBLE) AS new_channel FROM customer),
x AS (SELECT *, abs(growth) * 0.7::DOUBLE + abs(seasonality) * 0.6::DOUBLE + abs(discount) * 0.8::DOUBLE + marketing * 0.7::DOUBLE
  + churn * 1.0::DOUBLE + new_channel * 0.7::DOUBLE AS load FROM l)
SELECT c_custkey, growth, seasonality, discount, marketing, churn, new_channel, round(load, 4) AS load,
  CASE WHEN load < 20 THEN 'Conservative' WHEN load < 45 THEN 'Balanced' WHEN load < 70 THEN 'Aggressive' ELSE 'High Risk' END AS label FROM x""")
def assumption_load(spark, d):
    k = F.col("c_custkey")
    levers = V.table(spark, d, "customer").select(
        "c_custkey", *[v.cast("double").alias(n) for n, v in {
            "growth": k % 41 - 10, "seasonality": k % 21 - 10, "discount": -(k % 16),
            "marketing": k % 26, "churn": k % 13, "new_channel": k % 18}.items()])
    return rounded(C.assumption_load(levers), 4)
