"""Named queries over the given tables, each with its SQL twin where SQL can state it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return add


def rounded(df: DataFrame, digits: int = 2, **by_column: int) -> DataFrame:
    """Round every double column: sums of doubles depend on the order of rows.

    Sums of money take 2 digits. Averages take 6: an average of two-digit amounts
    can lie exactly between two 2-digit values.
    """
    return df.select(*[
        F.round(c, by_column.get(c, digits)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes
    ])


# --- SQL fragments ---------------------------------------------------------

SALES_SQL = """sales AS (
  SELECT o_orderkey, CAST(o_orderdate AS DATE) AS "Date", o_totalprice AS Sales,
         c_mktsegment AS Category, r_name AS Region, n_name AS Nation
  FROM orders JOIN customer ON o_custkey = c_custkey
  JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""


def cols(keys, prefix: str = "") -> str:
    """``k1, k2, `` for a select list that goes on."""
    return "".join(f"{prefix}{k}, " for k in keys)


def part(keys) -> str:
    return f"PARTITION BY {', '.join(keys)}" if keys else ""


def monthly_sql(keys=()) -> str:
    return SALES_SQL + f""",
monthly AS (
  SELECT {cols(keys)}CAST(date_trunc('month', "Date") AS DATE) AS d, SUM(Sales) AS s
  FROM sales GROUP BY {cols(keys)}CAST(date_trunc('month', "Date") AS DATE)),
m AS (
  SELECT *, row_number() OVER ({part(keys)} ORDER BY d) AS i, count(*) OVER ({part(keys)}) AS n
  FROM monthly)"""


def facts_sql(keys=(), dims=()) -> str:
    """``facts``: one row per series, same columns as ``business_facts``."""
    group = f"GROUP BY {', '.join(keys)}" if keys else ""
    using = (lambda t: f"JOIN {t} USING ({', '.join(keys)})") if keys else (lambda t: f"CROSS JOIN {t}")
    sql = monthly_sql(keys) + f""",
mf AS (
  SELECT {cols(keys)}count(*) AS months, avg(s) AS month_avg, stddev_samp(s) AS month_std,
    (list(d ORDER BY s DESC, d))[1] AS best_month, max(s) AS best_sales,
    (list(d ORDER BY s, d))[1] AS worst_month, min(s) AS worst_sales,
    max(d) AS latest_month, max(s) FILTER (WHERE i = n) AS latest_sales,
    max(d) FILTER (WHERE i = n - 1) AS previous_month, max(s) FILTER (WHERE i = n - 1) AS previous_sales,
    max(s) FILTER (WHERE i = n - 2) AS before_previous_sales,
    avg(s) FILTER (WHERE i <= 3) AS first3, avg(s) FILTER (WHERE i > n - 3) AS last3,
    avg(s) FILTER (WHERE i > n - 6 AND i <= n - 3) AS prev3,
    CASE WHEN count(*) >= 6 THEN avg(s) FILTER (WHERE i <= n // 2) END AS first_half,
    CASE WHEN count(*) >= 6 THEN avg(s) FILTER (WHERE i > n // 2) END AS second_half
  FROM m {group}),
rf AS (
  SELECT {cols(keys)}count(*) AS "rows", sum(Sales) AS total, avg(Sales) AS row_avg,
    min("Date") AS first_day, max("Date") AS last_day
  FROM sales {group})"""
    for d in dims:
        sql += f""",
t_{d} AS (SELECT {cols(keys)}{d} AS v, sum(Sales) AS s FROM sales WHERE {d} IS NOT NULL GROUP BY {cols(keys)}{d}),
l_{d} AS (
  SELECT {cols(keys)}(list(v ORDER BY s DESC, v))[1] AS top_{d}, max(s) AS top_{d}_sales,
    max(s) / sum(s) * 100 AS top_{d}_share, (list(v ORDER BY s, v))[1] AS weak_{d},
    min(s) AS weak_{d}_sales, min(s) / sum(s) * 100 AS weak_{d}_share, count(*) AS {d}_levels
  FROM t_{d} {group})"""
    sql += f""",
facts AS (
  SELECT *,
    CASE WHEN month_avg > 0 THEN coalesce(month_std / month_avg * 100, 0) ELSE 0 END AS cv,
    CASE WHEN months >= 2 THEN coalesce((last3 - first3) / nullif(first3, 0) * 100, 0) ELSE 0 END AS growth_3,
    CASE WHEN months >= 6 THEN coalesce((second_half - first_half) / nullif(first_half, 0) * 100, 0) END AS growth_half,
    CASE WHEN months >= 4 THEN coalesce((last3 - prev3) / nullif(prev3, 0) * 100, 0) END AS momentum,
    CASE WHEN months >= 2 THEN coalesce((latest_sales - previous_sales) / nullif(previous_sales, 0) * 100, 0) END AS mom
  FROM mf {using('rf')} {' '.join(using('l_' + d) for d in dims)})"""
    return sql
