"""Forecasts, evaluation and champions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evaluate as E
from ..operators import forecast as P
from . import views as V
from .forecast_sql import (
    all_models_sql, backtest_outer, champion_and_full_sql, full_outer, holdout_outer, metrics_sql,
)
from .registry import SALES_SQL, facts_sql, query, rounded
from .rule_queries import _month_odd

KEYS = ["Region", "Category"]
_DATE = 'CAST(last_d + to_months(CAST(step AS INTEGER)) AS DATE) AS "Date"'


def _model_sql(model: str, horizon: int, keys=KEYS) -> str:
    k = ", ".join(keys)
    return all_models_sql(keys, full_outer(keys, horizon)) + f"""
SELECT {k}, model_key, step, {_DATE}, round(f, 2) AS "Forecast", round(u, 2) AS "Upper", round(l, 2) AS "Lower"
FROM af JOIN size USING ({k}) WHERE model_key = '{model}'"""


def _register_model(name: str, model: str, horizon: int) -> None:
    @query(name, _model_sql(model, horizon))
    def run(spark, d):
        return rounded(P.forecast(V.sales(spark, d), model, horizon, KEYS))


for _name, _model, _h in (
    ("fc_moving_average", "moving_average", 6), ("fc_linear", "linear_trend", 6),
    ("fc_seasonal_trend", "seasonal_trend", 18), ("fc_seasonal_naive", "seasonal_naive", 14),
    ("fc_exp_smoothing", "exp_smoothing", 6), ("fc_holt", "holts", 6), ("fc_ensemble", "smart_ensemble", 6),
):
    _register_model(_name, _model, _h)


_ITEMS_SQL = """sales AS (SELECT CAST(l_shipdate AS DATE) AS "Date", l_extendedprice AS Sales, p_brand AS Brand, p_type AS Product
  FROM lineitem JOIN part ON l_partkey = p_partkey)"""


@query("fc_brands", all_models_sql(["Brand", "Product"], full_outer(["Brand", "Product"], 3)).replace(SALES_SQL, _ITEMS_SQL) + f"""
SELECT Brand, model_key, {_DATE}, round(sum(f), 2) AS "Forecast", round(sum(u), 2) AS "Upper", round(sum(l), 2) AS "Lower"
FROM af JOIN size USING (Brand, Product) GROUP BY ALL""")
def fc_brands(spark, d):
    out = P.forecast(V.item_sales(spark, d), P.MODELS, 3, ["Brand", "Product"])
    return rounded(out.groupBy("Brand", "model_key", "Date").agg(
        *[F.sum(c).alias(c) for c in ("Forecast", "Upper", "Lower")]))


@query("fc_ensemble_members", all_models_sql(KEYS, full_outer(KEYS, 1)) + """
SELECT Region, Category, model_key, round(mape, 4) AS validation_mape,
  round(w / sum(w) OVER (PARTITION BY Region, Category), 6) AS weight FROM tp""")
def fc_ensemble_members(spark, d):
    out = P.ensemble_members(V.sales(spark, d), KEYS)
    return out.select(*KEYS, "model_key", F.round("validation_mape", 4).alias("validation_mape"),
                      F.round("weight", 6).alias("weight"))


@query("fc_fallback", _model_sql("seasonal_trend", 4))
def fc_fallback(spark, d):
    return rounded(P.forecast_with_fallback(V.sales(spark, d), "seasonal_trend", 4, KEYS))


_CUSTOMERS = 'sales AS (SELECT o_custkey, CAST(o_orderdate AS DATE) AS "Date", o_totalprice AS Sales FROM orders)'


@query("fc_fallback_customers", all_models_sql(["o_custkey"], full_outer(["o_custkey"], 4)).replace(SALES_SQL, _CUSTOMERS) + f"""
SELECT o_custkey, model_key, step, {_DATE}, round(f, 4) AS "Forecast", round(u, 4) AS "Upper", round(l, 4) AS "Lower"
FROM af JOIN size USING (o_custkey) WHERE model_key = CASE WHEN n >= 2 THEN 'seasonal_trend' ELSE 'exp_smoothing' END""")
def fc_fallback_customers(spark, d):
    """Customers with one month can't run the preferred model."""
    orders = V.table(spark, d, "orders").select(
        "o_custkey", F.to_date("o_orderdate").alias("Date"), F.col("o_totalprice").alias("Sales"))
    return rounded(P.forecast_with_fallback(orders, "seasonal_trend", 4, ["o_custkey"]), 4)


_PICK = """SELECT Region, Category, model_key, step, "Date", round(f, 2) AS "Forecast", round(u, 2) AS "Upper", round(l, 2) AS "Lower" FROM pick"""


@query("fc_champion", champion_and_full_sql(KEYS, 6) + _PICK)
def fc_champion(spark, d):
    return rounded(P.forecast_with_best_model(V.sales(spark, d), 6, KEYS, models=P.CANDIDATES))


@query("fc_grouped", champion_and_full_sql(["Nation"], 6) + """
SELECT Nation, round(sum(f) OVER (PARTITION BY Nation), 2) AS "TotalForecast", model_key, step, "Date",
  round(f, 2) AS "Forecast", round(u, 2) AS "Upper", round(l, 2) AS "Lower" FROM pick""")
def fc_grouped(spark, d):
    return rounded(P.forecast_groups(V.sales(spark, d), ["Nation"], 6))


@query("fc_flat_guard", all_models_sql(["Nation"], full_outer(["Nation"], 6)) + f""",
flatp AS (SELECT Nation, o, h, step, avg(f) OVER (PARTITION BY Nation) AS f0, u - f AS w FROM af WHERE model_key = 'holts'),
g AS (SELECT flatp.*, sl, flat, greatest(f0 + 0.45::DOUBLE * sl * (1 - pow(0.88::DOUBLE, step)) / 0.12::DOUBLE, 0) AS nf
  FROM flatp JOIN st USING (Nation, o, h))
SELECT Nation, 'holts' AS model_key, step, {_DATE},
  round(CASE WHEN abs(sl) > flat THEN nf ELSE f0 END, 2) AS "Forecast",
  round(CASE WHEN abs(sl) > flat THEN nf + w ELSE f0 + w END, 2) AS "Upper",
  round(CASE WHEN abs(sl) > flat THEN greatest(nf - w, 0) ELSE greatest(f0 - w, 0) END, 2) AS "Lower"
FROM g JOIN size USING (Nation)""")
def fc_flat_guard(spark, d):
    from ..functions.exprs import per_series
    rows = V.sales(spark, d)
    level = F.avg("Forecast").over(per_series(["Nation"]))
    width = F.col("Upper") - F.col("Forecast")
    flat = P.forecast(rows, "holts", 6, ["Nation"]).withColumns({"_w": width, "_l": level}).select(
        "Nation", "model_key", "step", "Date", F.col("_l").alias("Forecast"), (F.col("_l") + F.col("_w")).alias("Upper"),
        F.greatest(F.col("_l") - F.col("_w"), F.lit(0.0)).alias("Lower"))
    return rounded(P.flat_guard(flat, rows, ["Nation"]))


@query("fc_rescale", all_models_sql(KEYS, full_outer(KEYS, 6)) + f"""
SELECT Region, Category, model_key, step, {_DATE}, round(f, 2) AS "Forecast", round(f + 2.576::DOUBLE / 1.96::DOUBLE * (u - f), 2) AS "Upper",
  round(greatest(f - 2.576::DOUBLE / 1.96::DOUBLE * (u - f), 0), 2) AS "Lower"
FROM af JOIN size USING (Region, Category) WHERE model_key = 'exp_smoothing'""")
def fc_rescale(spark, d):
    return rounded(P.rescale_interval(P.forecast(V.sales(spark, d), "exp_smoothing", 6, KEYS), P.Z_VALUES["99%"]))


@query("fc_steps", all_models_sql(KEYS, full_outer(KEYS, 6)) + f""",
la AS (SELECT Region, Category, y AS last_actual FROM idx WHERE i = n - 1),
x AS (SELECT *, coalesce(lag(f) OVER (PARTITION BY Region, Category ORDER BY step), last_actual) AS b
  FROM af JOIN la USING (Region, Category) WHERE model_key = 'holts')
SELECT Region, Category, model_key, step, {_DATE}, round(f, 2) AS "Forecast", round(u, 2) AS "Upper", round(l, 2) AS "Lower",
  round((f - b) / greatest(b, 1) * 100, 6) AS "MoM" FROM x JOIN size USING (Region, Category)""")
def fc_steps(spark, d):
    rows = V.sales(spark, d)
    out = P.forecast_steps(P.forecast(rows, "holts", 6, KEYS), P.last_actuals(rows, KEYS), KEYS)
    return rounded(out, 2, MoM=6)


_PATH_SQL = all_models_sql(KEYS, full_outer(KEYS, 12)) + """,
la AS (SELECT Region, Category, y AS last_actual FROM idx WHERE i = n - 1),
p AS (SELECT af.*, last_actual, CAST(last_d + to_months(CAST(step AS INTEGER)) AS DATE) AS d,
    f - lag(f) OVER w AS k, lag(f) OVER w AS b, first_value(f) OVER w AS f1
  FROM af JOIN size USING (Region, Category) JOIN la USING (Region, Category) WHERE model_key = 'seasonal_trend'
  WINDOW w AS (PARTITION BY Region, Category ORDER BY step)),
s AS (SELECT Region, Category, model_key, sum(f) AS total, avg(f) AS mean, max(f) FILTER (WHERE step = 12) AS fl, max(f1) AS f1,
  max(last_actual) AS la, (list(d ORDER BY f DESC, d))[1] AS peak_month, max(f) AS peak, (list(d ORDER BY f, d))[1] AS low_month, min(f) AS low,
  (list(d ORDER BY k DESC, d) FILTER (WHERE k IS NOT NULL))[1] AS rise_month, (list(abs(k) / greatest(b, 1) * 100 ORDER BY k DESC, d) FILTER (WHERE k IS NOT NULL))[1] AS rise_pct,
  (list(d ORDER BY k, d) FILTER (WHERE k IS NOT NULL))[1] AS drop_month, (list(abs(k) / greatest(b, 1) * 100 ORDER BY k, d) FILTER (WHERE k IS NOT NULL))[1] AS drop_pct,
  max((u - l) / greatest(f1, 1) * 100) FILTER (WHERE step = 1) AS rw FROM p GROUP BY ALL),
t AS (SELECT *, (fl - f1) / greatest(f1, 1) * 100 AS tc FROM s)
SELECT Region, Category, model_key, round(total, 2) AS total, round(mean, 2) AS mean,
  CASE WHEN tc > 8 THEN 'up' WHEN tc < -8 THEN 'down' ELSE 'steady' END AS direction, round(tc, 4) AS total_change,
  round((f1 - la) / greatest(la, 1) * 100, 4) AS launch_change, peak_month, round(peak, 2) AS peak, low_month, round(low, 2) AS low,
  rise_month, round(rise_pct, 4) AS rise_pct, drop_month, round(drop_pct, 4) AS drop_pct, round(rw, 4) AS range_width_pct FROM t"""


def _path_summary(spark, d, **how):
    rows = V.sales(spark, d)
    out = P.path_summary(P.forecast(rows, "seasonal_trend", 12, KEYS), P.last_actuals(rows, KEYS), KEYS, **how)
    return rounded(out, 2, total_change=4, launch_change=4, rise_pct=4, drop_pct=4, range_width_pct=4)


@query("fc_path_summary", _PATH_SQL)
def fc_path_summary(spark, d):
    return _path_summary(spark, d)


@query("fc_path_facts", _PATH_SQL.replace("tc > 8 THEN", "tc > 2 THEN").replace("tc < -8 THEN", "tc < -2 THEN").replace(
    "(fl - f1) / greatest(f1, 1)", "(fl - f1) / greatest(abs(f1), 1)"))
def fc_path_facts(spark, d):
    """The form of the chat: 2 percent count as a direction."""
    return _path_summary(spark, d, limit=2.0, absolute=True)


@query("fc_export", champion_and_full_sql(KEYS, 6) + """
SELECT Region, Category, strftime("Date", '%b %Y') AS "Month", round(f, 2) AS "Forecast", round(u, 2) AS "Upper",
  round(l, 2) AS "Lower", model_key AS "Model" FROM pick""")
def fc_export(spark, d):
    return P.export_table(P.forecast_with_best_model(V.sales(spark, d), 6, KEYS, models=P.CANDIDATES), KEYS)


# --- evaluation --------------------------------------------------------------

_ACC = "CASE WHEN MAPE < 10 THEN 'Excellent' WHEN MAPE < 20 THEN 'Good' WHEN MAPE < 50 THEN 'Acceptable' ELSE 'Poor' END"


@query("time_split", f"""WITH {SALES_SQL},
m AS (SELECT Nation, CAST(date_trunc('month', "Date") AS DATE) AS d, sum(Sales) AS s FROM sales GROUP BY ALL)
SELECT Nation, d AS "Date", round(s, 2) AS "Sales", CASE WHEN row_number() OVER (PARTITION BY Nation ORDER BY d) <=
  greatest(floor(count(*) OVER (PARTITION BY Nation) * 0.8::DOUBLE), 3) THEN 'train' ELSE 'test' END AS part FROM m""")
def time_split(spark, d):
    from ..operators.rollup import monthly_totals
    return rounded(E.time_split(monthly_totals(V.sales(spark, d), ["Nation"]), ["Nation"]))


@query("eval_holdout", all_models_sql(KEYS, holdout_outer(KEYS)) + "," + metrics_sql(KEYS) + f"""
SELECT Region, Category, model_key, MAE, RMSE, MAPE, R2, {_ACC} AS "Accuracy", rank FROM rk""")
def eval_holdout(spark, d):
    return E.compare_models(V.sales(spark, d), KEYS, P.CANDIDATES)


@query("eval_backtest", all_models_sql(KEYS, backtest_outer(KEYS, "6", 1, 5)) + "," + metrics_sql(KEYS) + """
SELECT Region, Category, model_key, MAE, RMSE, MAPE, R2, Splits AS "Splits", 1 AS "Horizon", rank FROM rk""")
def eval_backtest(spark, d):
    return E.backtest(V.sales(spark, d), KEYS, P.CANDIDATES, max_splits=5)


@query("eval_backtest_h3", all_models_sql(["Nation"], backtest_outer(["Nation"], "24", 3, 8)) + "," + metrics_sql(["Nation"]) + """
SELECT Nation, model_key, MAE, RMSE, MAPE, R2, Splits AS "Splits", 3 AS "Horizon", rank FROM rk""")
def eval_backtest_h3(spark, d):
    return E.backtest(V.sales(spark, d), ["Nation"], P.CANDIDATES, min_train=24, horizon=3)


@query("eval_metrics_floor", """
WITH x AS (SELECT l_returnflag, l_extendedprice AS a, l_quantity * 1500 AS p FROM lineitem)
SELECT l_returnflag, round(avg(abs(a - p)), 4) AS "MAE", round(sqrt(avg((a - p) * (a - p))), 4) AS "RMSE",
  round(avg(abs(a - p) / CASE WHEN abs(a) < 1e-8 THEN 1 ELSE abs(a) END) * 100, 2) AS "MAPE",
  round(1 - avg((a - p) * (a - p)) / var_pop(a), 4) AS "R2" FROM x GROUP BY 1""")
def eval_metrics_floor(spark, d):
    lines = V.table(spark, d, "lineitem").select(
        "l_returnflag", F.col("l_extendedprice").alias("actual"), (F.col("l_quantity") * 1500).alias("predicted"))
    return rounded(E.metrics(lines, ["l_returnflag"], tiny_only=True), 4, MAPE=2)


@query("accuracy_label", all_models_sql(["Nation"], holdout_outer(["Nation"])) + "," + metrics_sql(["Nation"]) + f"""
SELECT {_ACC} AS label, count(*) AS n FROM rk GROUP BY 1""")
def accuracy_label(spark, d):
    return E.compare_models(V.sales(spark, d), ["Nation"], P.CANDIDATES).groupBy(F.col("Accuracy").alias("label")).agg(
        F.count(F.lit(1)).alias("n"))


@query("best_model", all_models_sql(["Nation"], holdout_outer(["Nation"])) + "," + metrics_sql(["Nation"]) + f"""
SELECT Nation, model_key, MAE, RMSE, MAPE, R2, {_ACC} AS "Accuracy" FROM rk WHERE rank = 1""")
def best_model(spark, d):
    return E.best_model(E.compare_models(V.sales(spark, d), ["Nation"], P.CANDIDATES), ["Nation"])


_CH = "SELECT {k}, months, trained_on, model_key, MAE, RMSE, MAPE, R2, judged_by FROM ch"


@query("champion", champion_and_full_sql(KEYS, 1) + _CH.format(k="Region, Category"))
def champion(spark, d):
    return E.champions(V.sales(spark, d), KEYS, P.CANDIDATES)


@query("champion_customers", champion_and_full_sql(["o_custkey"], 1).replace(
    SALES_SQL, 'sales AS (SELECT o_custkey, CAST(o_orderdate AS DATE) AS "Date", o_totalprice AS Sales FROM orders)')
    + "SELECT o_custkey, months, trained_on, model_key, MAPE, R2, judged_by FROM ch")
def champion_customers(spark, d):
    # Holdouts of two months put MAE exactly between two 2-digit values now and then,
    # where the order of a sum decides; `champion` compares MAE and RMSE.
    orders = V.table(spark, d, "orders").select(
        "o_custkey", F.to_date("o_orderdate").alias("Date"), F.col("o_totalprice").alias("Sales"))
    return E.champions(orders, ["o_custkey"], P.CANDIDATES).drop("MAE", "RMSE")


_SCORE = """greatest(100 - CASE WHEN MAPE < 10 THEN 0 WHEN MAPE < 20 THEN 10 WHEN MAPE < 35 THEN 25 ELSE 40 END
  - CASE WHEN cv < 10 THEN 0 WHEN cv < 20 THEN 8 WHEN cv < 35 THEN 18 ELSE 30 END
  - CASE WHEN months >= 24 THEN 0 WHEN months >= 12 THEN 10 WHEN months >= 6 THEN 22 ELSE 35 END
  - CASE WHEN anomalies = 0 THEN 0 WHEN anomalies <= 2 THEN 5 WHEN anomalies <= 5 THEN 12 ELSE 20 END, 0)"""
_LEVEL = "CASE WHEN score IS NULL THEN 'Not rated' WHEN score < 50 THEN 'Low' WHEN score < 75 THEN 'Moderate' ELSE 'High' END"


@query("confidence", champion_and_full_sql(["Nation"], 1) + f""", {_month_odd(1.8, 'Nation')},
f AS (SELECT Nation, max(n) AS months, coalesce(stddev_samp(s) / avg(s) * 100, 0) AS cv FROM m GROUP BY Nation),
x AS (SELECT Nation, f.months, cv, coalesce(odd.n, 0) AS anomalies, ch.model_key, MAPE
  FROM f JOIN ch USING (Nation) LEFT JOIN odd USING (Nation)),
y AS (SELECT *, {_SCORE} AS score FROM x)
SELECT Nation, months, round(cv, 4) AS cv, anomalies, model_key, MAPE, score, {_LEVEL} AS level,
  CASE WHEN MAPE < 20 THEN 'low_error' ELSE 'high_error' END AS reason_error,
  CASE WHEN cv < 20 THEN 'stable_series' ELSE 'volatile_series' END AS reason_series,
  CASE WHEN months >= 12 THEN 'sufficient_history' ELSE 'limited_history' END AS reason_history,
  CASE WHEN anomalies <= 2 THEN 'few_anomalies' ELSE 'many_anomalies' END AS reason_anomalies FROM y""")
def confidence(spark, d):
    return rounded(E.confidence(V.sales(spark, d), ["Nation"], 1.8, models=P.CANDIDATES), 4)


@query("executive_summary", all_models_sql(["Region"], holdout_outer(["Region"])) + "," + metrics_sql(["Region"]) + ", "
       + facts_sql(["Region"]).split("FROM monthly),", 1)[-1].lstrip() + f""", {_month_odd(1.8, 'Region')},
x AS (SELECT facts.*, coalesce(growth_half, growth_3) AS growth, coalesce(odd.n, 0) AS anomalies, rk.model_key, MAPE
  FROM facts LEFT JOIN odd USING (Region) LEFT JOIN (SELECT * FROM rk WHERE rank = 1) rk USING (Region)),
y AS (SELECT *, {_SCORE} AS score FROM x)
SELECT Region, round(total, 2) AS total, best_month, round(best_sales, 2) AS best_sales, worst_month,
  round(worst_sales, 2) AS worst_sales, round(growth, 4) AS growth,
  CASE WHEN growth > 10 THEN 'strong_upward' WHEN growth < -10 THEN 'declining' ELSE 'stable' END AS trend,
  anomalies, model_key AS best_model, MAPE, score, {_LEVEL} AS level FROM y""")
def executive_summary(spark, d):
    return rounded(E.executive_summary(V.sales(spark, d), ["Region"], 1.8, models=P.CANDIDATES), 2, growth=4)
