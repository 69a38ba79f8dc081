"""Sources, sinks, saved champions and the demo panel."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.forecast import DEFAULTS
from ..operators.rollup import monthly_totals
from ..session import scratch_path
from ..sources import champions as S
from ..sources import tables as T
from . import views as V
from .forecast_queries import KEYS
from .forecast_sql import all_models_sql, full_outer, holdout_outer, metrics_sql
from .registry import SALES_SQL, query, rounded

_MODELS = str(S.CLASSIC)
_MAPS = "CASE model_key " + " ".join(
    f"WHEN '{m}' THEN '{'|'.join(f'{k}={float(v)}' for k, v in sorted(DEFAULTS[m].items()))}'" for m in S.CLASSIC) + " END"


@query("csv_roundtrip", f"""WITH {SALES_SQL}
SELECT o_orderkey, "Date", Sales AS "Sales", Category, Region FROM sales""")
def csv_roundtrip(spark, d):
    path = scratch_path(spark, "csv")
    T.write_table(V.sales(spark, d).select("o_orderkey", "Date", "Sales", "Category", "Region"), path, "csv")
    rows, error = T.read_table(spark, path, "csv", "o_orderkey LONG, Date DATE, Sales DOUBLE, Category STRING, Region STRING")
    if error:
        raise ValueError(error)
    return rows


@query("parquet_roundtrip", f"""WITH {SALES_SQL}
SELECT Region, CAST(date_trunc('month', "Date") AS DATE) AS "Date", round(sum(Sales), 2) AS "Sales" FROM sales GROUP BY ALL""")
def parquet_roundtrip(spark, d):
    path = scratch_path(spark, "parquet")
    T.write_table(monthly_totals(V.sales(spark, d), ["Region"]), path, "parquet", ["Region"])
    rows, error = T.read_table(spark, path, "parquet")
    if error:
        raise ValueError(error)
    return rounded(rows)


_TRAIN = all_models_sql(KEYS, holdout_outer(KEYS)) + "," + metrics_sql(KEYS, _MODELS) + f"""
SELECT Region, Category, model_key, MAE, RMSE, MAPE, R2,
  CASE WHEN MAPE < 10 THEN 'Excellent' WHEN MAPE < 20 THEN 'Good' WHEN MAPE < 50 THEN 'Acceptable' ELSE 'Poor' END AS "Accuracy",
  last_d AS trained_on, {_MAPS} AS params FROM rk JOIN size USING (Region, Category) WHERE rank = 1"""


def _flat_params(df):
    text = F.array_join(F.transform(
        F.array_sort(F.map_entries("params")), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), "|")
    return df.withColumn("params", text)


@query("fc_train_all", _TRAIN)
def fc_train_all(spark, d):
    return _flat_params(S.train_all(V.sales(spark, d), KEYS, S.CLASSIC))


@query("champion_roundtrip", _TRAIN)
def champion_roundtrip(spark, d):
    path = scratch_path(spark, "champions")
    S.save_champions(S.train_all(V.sales(spark, d), KEYS, S.CLASSIC), path)
    return _flat_params(S.load_champions(spark, path))


@query("champion_replaced", all_models_sql(KEYS, holdout_outer(KEYS)) + "," + metrics_sql(KEYS, _MODELS) + f"""
SELECT Region, Category, CASE WHEN Region = 'ASIA' THEN 'holts' ELSE model_key END AS model_key,
  CASE WHEN Region = 'ASIA' THEN h.MAPE ELSE rk.MAPE END AS MAPE
FROM rk JOIN (SELECT Region, Category, MAPE FROM me WHERE model_key = 'holts') h USING (Region, Category) WHERE rank = 1""")
def champion_replaced(spark, d):
    """All champions saved, then those of one region replaced by another choice."""
    path, rows = scratch_path(spark, "champions"), V.sales(spark, d)
    S.save_champions(S.train_all(rows, KEYS, S.CLASSIC), path)
    S.save_champions(S.train_all(rows.filter("Region = 'ASIA'"), KEYS, ["holts"]), path, "replace")
    return S.load_champions(spark, path).select(*KEYS, "model_key", "MAPE")


@query("fc_score_champion", all_models_sql(KEYS, holdout_outer(KEYS) + " UNION ALL " + full_outer(KEYS, 12)) + ","
       # full-history forecasts (o = n) have no month to be judged by, so they fall out of the metrics
       + metrics_sql(KEYS, _MODELS) + """
SELECT rk.Region, rk.Category, rk.model_key, step, CAST(last_d + to_months(CAST(step AS INTEGER)) AS DATE) AS "Date",
  round(f, 2) AS "Forecast", round(u, 2) AS "Upper", round(l, 2) AS "Lower"
FROM rk JOIN size USING (Region, Category) JOIN af ON af.Region = rk.Region AND af.Category = rk.Category
  AND af.model_key = rk.model_key AND af.o = size.n WHERE rank = 1""")
def fc_score_champion(spark, d):
    path = scratch_path(spark, "champions")
    rows = V.sales(spark, d)
    S.save_champions(S.train_all(rows, KEYS, S.CLASSIC), path)
    return rounded(S.score_champions(S.load_champions(spark, path), rows, 12, KEYS))


@query("demo_panel", """
WITH r AS (SELECT s_suppkey, CAST(unnest(generate_series(DATE '2022-01-01', DATE '2024-12-31', INTERVAL 1 DAY)) AS DATE) AS d FROM supplier),
v AS (SELECT s_suppkey, d, round(greatest(8000 + 14000 * (d - DATE '2022-01-01') / 1095.0::DOUBLE
  + 3500 * sin(2 * pi() * dayofyear(d) / 365) + 800 * sin(2 * pi() * (isodow(d) - 1) / 7), 0), 2) AS s FROM r)
SELECT s_suppkey, CAST(date_trunc('month', d) AS DATE) AS "Date", round(sum(s), 1) AS "Sales" FROM v GROUP BY ALL""")
def demo_panel(spark, d):
    series = V.table(spark, d, "supplier").select("s_suppkey")
    panel = T.demo_panel(series, ["s_suppkey"], noise=0.0, segments=False)
    return rounded(monthly_totals(panel, ["s_suppkey"]), 1)


def _u(salt: int) -> str:
    return f"(('0x' || substr(md5(s_suppkey || '|' || d || '|{salt}'), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496"


def _drawn(shares: dict[str, float], salt: int) -> str:
    edge, cases = 0.0, []
    for name, part in list(shares.items())[:-1]:
        edge += part
        cases.append(f"WHEN {_u(salt)} < {edge!r}::DOUBLE THEN '{name}'")
    return f"CASE {' '.join(cases)} ELSE '{list(shares)[-1]}' END"


@query("demo_panel_noise", f"""
WITH r AS (SELECT s_suppkey, CAST(unnest(generate_series(DATE '2022-01-01', DATE '2024-12-31', INTERVAL 1 DAY)) AS DATE) AS d FROM supplier),
v AS (SELECT s_suppkey, d, round(greatest(8000 + 14000 * (d - DATE '2022-01-01') / 1095.0::DOUBLE
  + 3500 * sin(2 * pi() * dayofyear(d) / 365) + 800 * sin(2 * pi() * (isodow(d) - 1) / 7)
  + 600 * sqrt(-2 * ln({_u(42)})) * cos(2 * pi() * {_u(43)}), 0), 2) AS s FROM r)
SELECT {_drawn(T.DEMO_CATEGORIES, 44)} AS "Category", {_drawn(T.DEMO_REGIONS, 45)} AS "Region", round(sum(s), 1) AS "Sales",
  sum(CAST(floor(s / (45 + 40 * {_u(46)})) AS BIGINT)) AS "Orders", sum(CAST(floor(30 * {_u(47)}) AS BIGINT)) AS "Returns", count(*) AS n
FROM v GROUP BY ALL""")
def demo_panel_noise(spark, d):
    """A noisy demo panel with segments, one series per supplier, as category totals.

    Sales are summed as whole cents: a total can lie exactly between two 1-digit values, and the error of a sum
    of doubles, which depends on the order of rows, would then choose.
    """
    panel = T.demo_panel(V.table(spark, d, "supplier").select("s_suppkey"), ["s_suppkey"])
    return rounded(panel.groupBy("Category", "Region").agg(
        (F.sum(F.rint(F.col("Sales") * 100).cast("long")) / 100).alias("Sales"),
        F.sum("Orders").alias("Orders"), F.sum("Returns").alias("Returns"),
        F.count(F.lit(1)).alias("n")), 1)
