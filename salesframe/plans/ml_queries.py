"""Regression on monthly panels; forecasts depend on the learners, so their twins state what any learner must keep."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.exprs import attach
from ..operators import evaluate as E
from ..operators import forecast as P
from ..operators import ml as M
from ..operators.anomaly import detect_anomalies
from ..operators.rollup import monthly_totals
from ..sources import champions as S
from . import views as V
from .forecast_sql import all_models_sql, backtest_outer, champion_and_full_sql, holdout_outer, metrics_sql
from .registry import SALES_SQL, query, rounded

KEYS = ["Region", "Category"]

_KEPT = f"""WITH {SALES_SQL},
m AS (SELECT Region, Category, CAST(date_trunc('month', "Date") AS DATE) AS d, sum(Sales) AS s FROM sales GROUP BY ALL)
SELECT Region, Category, 6 AS steps, CAST(max(d) + INTERVAL 1 MONTH AS DATE) AS first_month,
  CAST(max(d) + INTERVAL 6 MONTH AS DATE) AS last_month, true AS bands_hold, true AS not_negative FROM m GROUP BY ALL"""


def _kept(forecasts):
    """Steps, months and order of the bands of each path."""
    c = F.col
    return forecasts.groupBy(*KEYS).agg(
        F.count(F.lit(1)).alias("steps"), F.min("Date").alias("first_month"), F.max("Date").alias("last_month"),
        F.bool_and((c("Lower") <= c("Forecast")) & (c("Forecast") <= c("Upper"))).alias("bands_hold"),
        F.bool_and(c("Forecast") >= 0).alias("not_negative"))


@query("fc_random_forest")
def fc_random_forest(spark, d):
    return rounded(M.random_forest_forecast(V.sales(spark, d), 6, KEYS))


@query("fc_forest_kept", _KEPT)
def fc_forest_kept(spark, d):
    return _kept(P.forecast(V.sales(spark, d), P.FOREST, 6, KEYS))


@query("fc_champion_forest", _KEPT)
def fc_champion_forest(spark, d):
    """Best-model forecasts with the forest among the candidates."""
    return _kept(P.forecast_with_best_model(V.sales(spark, d), 6, KEYS))


@query("eval_holdout_forest")
def eval_holdout_forest(spark, d):
    return E.compare_models(V.sales(spark, d), KEYS)


_BEST = "SELECT Region, Category, {m}, MAE, RMSE, MAPE, R2, true AS holds FROM {t}"
_TREES = "UNION ALL SELECT Region, Category, 'random_forest', NULL, NULL, NULL, NULL, true FROM size WHERE n >= {least}"


def _forest_marked(comparison):
    """Metrics of all models; those of the forest, which no twin can restate, only where they contradict themselves."""
    c = F.col
    sound = (c("RMSE") >= c("MAE")) & (c("MAPE") >= 0) & (c("R2") <= 1) & (c("rank") >= 1)
    return comparison.select(*KEYS, "model_key", *[
        F.when(c("model_key") != P.FOREST, c(m)).alias(m) for m in ("MAE", "RMSE", "MAPE", "R2")], sound.alias("holds"))


@query("eval_holdout_forest_kept", all_models_sql(KEYS, holdout_outer(KEYS)) + "," + metrics_sql(KEYS)
       + _BEST.format(m="model_key", t="rk") + " " + _TREES.format(least=8))
def eval_holdout_forest_kept(spark, d):
    """The holdout comparison with all default candidates."""
    return _forest_marked(E.compare_models(V.sales(spark, d), KEYS))


@query("eval_backtest_forest_kept", all_models_sql(KEYS, backtest_outer(KEYS, "6", 1, 3)) + "," + metrics_sql(KEYS)
       + _BEST.format(m="model_key", t="rk") + " " + _TREES.format(least=8))
def eval_backtest_forest_kept(spark, d):
    """A backtest over three origins with all default candidates: one forest for each origin."""
    return _forest_marked(E.backtest(V.sales(spark, d), KEYS, max_splits=3))


@query("champion_forest_kept", champion_and_full_sql(KEYS, 1) + "SELECT Region, Category, months, trained_on, judged_by, true AS no_worse FROM ch")
def champion_forest_kept(spark, d):
    """Champions with all default candidates err no more than those of the models without the forest."""
    rows = V.sales(spark, d)
    classic = E.champions(rows, KEYS, P.CANDIDATES).select(*KEYS, F.col("MAPE").alias("_classic"))
    return E.champions(rows, KEYS).join(classic, KEYS).select(
        *KEYS, "months", "trained_on", "judged_by", (F.col("MAPE") <= F.col("_classic")).alias("no_worse"))


@query("fc_train_all_forest_kept", all_models_sql(KEYS, holdout_outer(KEYS)) + "," + metrics_sql(KEYS, str(S.CLASSIC))
       + "SELECT Region, Category, last_d AS trained_on, true AS no_worse, true AS has_params FROM rk JOIN size USING (Region, Category) WHERE rank = 1")
def fc_train_all_forest_kept(spark, d):
    """Trained champions with the forest among them err no more than without."""
    rows = V.sales(spark, d)
    classic = S.train_all(rows, KEYS, S.CLASSIC).select(*KEYS, F.col("MAPE").alias("_classic"))
    return S.train_all(rows, KEYS).join(classic, KEYS).select(
        *KEYS, "trained_on", (F.col("MAPE") <= F.col("_classic")).alias("no_worse"), F.col("params").isNotNull().alias("has_params"))


_EXAMPLES = f"""WITH {SALES_SQL},
m AS (SELECT Region, Category, CAST(date_trunc('month', "Date") AS DATE) AS d, sum(Sales) AS s FROM sales GROUP BY ALL),
ft AS (SELECT *, lag(s, 1) OVER w AS lag_1, lag(s, 2) OVER w AS lag_2, lag(s, 3) OVER w AS lag_3 FROM m
  WINDOW w AS (PARTITION BY Region, Category ORDER BY d)),
ex AS (SELECT *, row_number() OVER (PARTITION BY Region, Category ORDER BY d) AS i, count(*) OVER (PARTITION BY Region, Category) AS n
  FROM ft WHERE lag_3 IS NOT NULL),
pt AS (SELECT *, CASE WHEN i <= greatest(floor(n * 0.8::DOUBLE), 3) THEN 'train' ELSE 'test' END AS part FROM ex)"""


@query("feature_importance_kept", """SELECT unnest(['lag_1', 'lag_2', 'lag_3', 'rolling_mean_3', 'rolling_std_3', 'month', 'quarter', 'year']) AS feature,
  unnest(['lag', 'lag', 'lag', 'lag', 'lag', 'calendar', 'calendar', 'calendar']) AS kind, true AS in_range, 1.0::DOUBLE AS whole""")
def feature_importance_kept(spark, d):
    """Shares of features lie between 0 and 1 and sum to 1."""
    rows = M.forest_importance(V.sales(spark, d), KEYS)
    whole = rows.agg(F.round(F.sum("Importance"), 2).alias("whole"))
    return attach(rows.select("feature", "kind", F.col("Importance").between(0, 1).alias("in_range")), whole, ())


@query("regression_normal", _EXAMPLES + """,
tr AS (SELECT * FROM pt WHERE part = 'train'),
nf AS (SELECT count(*) AS n, unnest(['one', 'lag_1', 'lag_2', 'lag_3', 'month', 'year']) AS feature,
  unnest([count(*)::DOUBLE, sum(lag_1), sum(lag_2), sum(lag_3), sum(month(d)), sum(year(d))]) AS feature_sum FROM tr)
SELECT feature, n, round(feature_sum, 1) AS feature_sum, 0.0::DOUBLE AS product FROM nf""")
def regression_normal(spark, d):
    """The linear learner solves the normal equations: residuals of the train part are orthogonal to every feature."""
    train = M.feature_table(V.sales(spark, d), KEYS).filter("part = 'train'")
    rows = M.regressors()["Linear Regression"].fit(train).transform(train).withColumn("_r", F.col("Sales") - F.col("_prediction"))
    names = ["one", "lag_1", "lag_2", "lag_3", "month", "year"]
    value = lambda f: F.lit(1.0) if f == "one" else F.col(f).cast("double")
    size = F.sqrt(F.sum(F.col("Sales") * F.col("Sales")))
    # the cosine of residuals and feature, to three digits
    one = rows.agg(F.count(F.lit(1)).alias("n"), *[e for f in names for e in (
        F.sum(value(f)).alias(f"s_{f}"), (F.sum(F.col("_r") * value(f)) / F.sqrt(F.sum(value(f) * value(f))) / size).alias(f"p_{f}"))])
    return one.select(F.inline(F.array(*[
        F.struct(F.lit(f).alias("feature"), "n", F.round(f"s_{f}", 1).alias("feature_sum"), F.abs(F.round(f"p_{f}", 3)).alias("product")) for f in names])))


@query("regression_kept", _EXAMPLES + """
SELECT model_key, count(*) FILTER (WHERE part = 'test') AS tested, true AS errors_ordered, true AS trees_in_range, true AS ranked,
  count(*) AS examples, count(*) >= 90 AS deep_history, true AS best_named
FROM pt, (SELECT unnest(['Linear Regression', 'Random Forest', 'Gradient Boosting']) AS model_key) GROUP BY model_key""")
def regression_kept(spark, d):
    """What must hold of every learner: MAE no more than RMSE, averages of trees within the sales they learnt from,
    ranks by RMSE, and a summary that names the first and why it suits."""
    table = M.feature_table(V.sales(spark, d), KEYS)
    comparison, fitted = M.compare_regressors(table)
    ends = table.filter("part = 'train'").agg(F.min("Sales").alias("_lo"), F.max("Sales").alias("_hi"))
    found = None
    for name, model in fitted.items():
        rows = attach(model.transform(table.filter("part = 'test'")), ends, ())
        inside = F.bool_and(F.col("_prediction").between(F.col("_lo") - 1e-6, F.col("_hi") + 1e-6)) if name == "Random Forest" else F.lit(True)
        part = rows.agg(F.lit(name).alias("model_key"), F.count(F.lit(1)).alias("tested"), inside.alias("trees_in_range"))
        found = part if found is None else found.unionByName(part)
    place = F.rank().over(Window.orderBy("RMSE"))
    suits = {"Random Forest": "non_linear", "Gradient Boosting": "complex_patterns", "Linear Regression": "close_to_linear"}
    named = F.create_map(*[F.lit(x) for pair in suits.items() for x in pair])
    first = comparison.filter("rank = 1").select(F.col("model_key").alias("_first"))
    said = attach(M.regression_summary(comparison, table), first, ()).select(
        "examples", "deep_history", ((F.col("best") == F.col("_first")) & (F.col("best_rmse") <= F.col("worst_rmse"))
                                     & (F.element_at(named, F.col("best")) == F.col("suits"))).alias("best_named"))
    return attach(found.join(comparison.withColumn("_place", place), "model_key"), said, ()).select(
        "model_key", "tested", (F.col("MAE") <= F.col("RMSE")).alias("errors_ordered"), "trees_in_range",
        (F.col("_place") <= F.col("rank")).alias("ranked"), "examples", "deep_history", "best_named")


@query("feature_importance")
def feature_importance(spark, d):
    return M.forest_importance(V.sales(spark, d), KEYS)


@query("regression_compare")
def regression_compare(spark, d):
    comparison, _ = M.compare_regressors(M.feature_table(V.sales(spark, d), KEYS))
    return comparison


@query("regression_summary")
def regression_summary(spark, d):
    """Best and worst learner, why the best one suits, and whether anomalies call for caution."""
    rows = V.sales(spark, d)
    table = M.feature_table(rows, KEYS)
    comparison, _ = M.compare_regressors(table)
    odd = detect_anomalies(monthly_totals(rows, KEYS), "zscore", keys=KEYS)
    return M.regression_summary(comparison, table, odd)


@query("regression_refit")
def regression_refit(spark, d):
    """Errors on all rows of the best learner, fitted again on all rows."""
    table = M.feature_table(V.sales(spark, d), KEYS)
    comparison, _ = M.compare_regressors(table)
    name, model = M.refit_best(table, comparison)
    return rounded(E.metrics(model.transform(table).select(
        F.lit(name).alias("model_key"), F.col("Sales").alias("actual"), F.col("_prediction").alias("predicted")),
        ["model_key"]), 4)
