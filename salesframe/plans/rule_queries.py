"""Rule tables."""

from __future__ import annotations

from ..operators import rules as U
from . import views as V
from .clean_queries import _FENCE
from .registry import SALES_SQL, facts_sql, query, rounded


def _lines(lines, keys=(), most: int | None = None) -> str:
    """Union of (seq rank, condition, code, level, subject, metric) rows over ``facts``, renumbered."""
    k = "".join(f"{x}, " for x in keys)
    rows = " UNION ALL ".join(
        f"SELECT {k}{i} AS p, {code} AS code, {level} AS level, CAST({subject} AS VARCHAR) AS subject, "
        f"CAST({metric} AS DOUBLE) AS metric FROM facts WHERE {cond}"
        for i, (cond, code, level, subject, metric) in enumerate(lines))
    over = f"PARTITION BY {', '.join(keys)} ORDER BY p" if keys else "ORDER BY p"
    cut = f" WHERE seq <= {most}" if most else ""
    return (f"SELECT {k}seq, code, level, subject, round(metric, 4) AS metric FROM ("
            f"SELECT *, row_number() OVER ({over}) AS seq FROM ({rows})){cut}")


def _sig(c: str, limit: float, up: str, down: str, flat: str) -> str:
    return f"CASE WHEN {c} > {limit} THEN '{up}' WHEN {c} < -{limit} THEN '{down}' ELSE '{flat}' END"


def _mon(c: str) -> str:
    return f"strftime({c}, '%Y-%m')"


@query("insights", f"WITH {facts_sql(['Nation'], ['Category'])} " + _lines([
    ("months < 2", "'not_enough_data'", "'neutral'", "NULL", "months"),
    ("months >= 6", _sig("growth_half", 10, "strong_upward", "declining", "stable"),
     _sig("growth_half", 10, "positive", "warning", "neutral"), "NULL", "growth_half"),
    ("months >= 2", "'best_month'", "'positive'", _mon("best_month"), "best_sales"),
    ("months >= 2", "'weakest_month'", "'warning'", _mon("worst_month"), "worst_sales"),
    ("months >= 4", "'recent_momentum'", _sig("momentum", 5, "positive", "warning", "neutral"), "NULL", "momentum"),
    ("months >= 2", "CASE WHEN top_Category_share > 50 THEN 'category_concentration' ELSE 'top_category' END",
     "CASE WHEN top_Category_share > 50 THEN 'warning' ELSE 'positive' END", "top_Category", "top_Category_share"),
    ("months >= 2", "CASE WHEN cv > 30 THEN 'high_volatility' ELSE 'consistent_pattern' END",
     "CASE WHEN cv > 30 THEN 'warning' ELSE 'positive' END", "NULL", "cv"),
], ["Nation"]))
def insights(spark, d):
    return rounded(U.insights(V.sales(spark, d).drop("Region"), ["Nation"]), 4)


@query("insights_overall", f"WITH {facts_sql([], ['Category', 'Region'])} " + _lines([
    ("months >= 6", _sig("growth_half", 10, "strong_upward", "declining", "stable"),
     _sig("growth_half", 10, "positive", "warning", "neutral"), "NULL", "growth_half"),
    ("months >= 2", "'best_month'", "'positive'", _mon("best_month"), "best_sales"),
    ("months >= 2", "'weakest_month'", "'warning'", _mon("worst_month"), "worst_sales"),
    ("months >= 4", "'recent_momentum'", _sig("momentum", 5, "positive", "warning", "neutral"), "NULL", "momentum"),
    ("months >= 2", "CASE WHEN top_Category_share > 50 THEN 'category_concentration' ELSE 'top_category' END",
     "CASE WHEN top_Category_share > 50 THEN 'warning' ELSE 'positive' END", "top_Category", "top_Category_share"),
    ("months >= 2", "'underperforming_region'", "CASE WHEN weak_Region_share < 15 THEN 'warning' ELSE 'neutral' END",
     "weak_Region", "weak_Region_share"),
    ("months >= 2", "CASE WHEN cv > 30 THEN 'high_volatility' ELSE 'consistent_pattern' END",
     "CASE WHEN cv > 30 THEN 'warning' ELSE 'positive' END", "NULL", "cv"),
]))
def insights_overall(spark, d):
    return rounded(U.insights(V.sales(spark, d)), 4)


@query("alerts", f"WITH {facts_sql(['Nation'])} " + _lines([
    ("months >= 3 AND -mom > 10", "'revenue_drop'", "CASE WHEN -mom > 20 THEN 'danger' ELSE 'warning' END", "NULL", "-mom"),
    ("months >= 3 AND before_previous_sales > previous_sales AND previous_sales > latest_sales",
     "'three_falling_months'", "'warning'", "NULL", "NULL"),
], ["Nation"]))
def alerts(spark, d):
    return rounded(U.alerts(V.sales(spark, d), ["Nation"]), 4)


def _reco_sql(anomalies: str) -> str:
    return _lines([
        ("months >= 3 AND prev3 > 0 AND momentum < -5", "'reverse_slowdown'", "'action'", "NULL", "momentum"),
        ("months >= 3 AND prev3 > 0 AND momentum > 5", "'support_demand'", "'action'", "NULL", "momentum"),
        (f"{anomalies} >= 3", "'review_anomalies'", "'action'", "NULL", anomalies),
        ("top_Category_share > 50", "'diversify_categories'", "'action'", "top_Category", "top_Category_share"),
        ("cv > 30", "'separate_effects'", "'action'", "NULL", "cv"),
        ("NOT ((months >= 3 AND prev3 > 0 AND abs(momentum) > 5) OR top_Category_share > 50 OR cv > 30 OR "
         f"{anomalies} >= 3)", "'keep_monitoring'", "'info'", "NULL", "NULL"),
    ], ["Region"])


@query("recommendations", f"""WITH {facts_sql(['Region'], ['Category'])},
w AS (SELECT Region, Sales AS s, avg(Sales) OVER x AS mu, stddev_samp(Sales) OVER x AS sd, count(*) OVER x AS c FROM sales
  WINDOW x AS (PARTITION BY Region ORDER BY "Date", o_orderkey ROWS BETWEEN 5 PRECEDING AND CURRENT ROW)),
odd AS (SELECT Region, count(*) AS n FROM w WHERE c >= 3 AND abs(s - mu) / nullif(sd, 0) > 2.5 GROUP BY Region)
""" + _reco_sql("coalesce((SELECT n FROM odd WHERE odd.Region = facts.Region), 0)"))
def recommendations(spark, d):
    return rounded(U.recommendations(V.sales(spark, d), ["Region"], tiebreak=["o_orderkey"]), 4)


@query("recommendations_rows", f"""WITH {facts_sql(['Region'], ['Category'])},
w AS (SELECT Region, Sales AS s, avg(Sales) OVER x AS mu, stddev_samp(Sales) OVER x AS sd, count(*) OVER x AS c FROM sales
  WINDOW x AS (PARTITION BY Region ORDER BY "Date", o_orderkey ROWS BETWEEN 8 PRECEDING AND CURRENT ROW)),
odd AS (SELECT Region, count(*) AS n FROM w WHERE c >= 3 AND abs(s - mu) / nullif(sd, 0) > 2 GROUP BY Region)
""" + _reco_sql("coalesce((SELECT n FROM odd WHERE odd.Region = facts.Region), 0)"))
def recommendations_rows(spark, d):
    return rounded(U.recommendations(V.sales(spark, d), ["Region"], 2.0, 9, ["o_orderkey"]), 4)


def _month_odd(threshold: float, key: str) -> str:
    return f"""w AS (SELECT {key}, s, avg(s) OVER x AS mu, stddev_samp(s) OVER x AS sd, count(*) OVER x AS c FROM m
  WINDOW x AS (PARTITION BY {key} ORDER BY d ROWS BETWEEN 5 PRECEDING AND CURRENT ROW)),
odd AS (SELECT {key}, count(*) AS n FROM w WHERE c >= 3 AND abs(s - mu) / nullif(sd, 0) > {threshold} GROUP BY {key})"""


_NODD = "coalesce((SELECT n FROM odd WHERE odd.Nation = facts.Nation), 0)"


@query("business_actions", f"WITH {facts_sql(['Nation'], ['Category'])}, {_month_odd(1.8, 'Nation')} " + _lines([
    ("TRUE", "CASE WHEN top_Category_share >= 45 THEN 'reduce_dependency' ELSE 'review_weakest_category' END", "'action'",
     "CASE WHEN top_Category_share >= 45 THEN top_Category ELSE weak_Category END",
     "CASE WHEN top_Category_share >= 45 THEN top_Category_share ELSE weak_Category_share END"),
    ("months >= 2", "'investigate_month'", "'action'", _mon("worst_month"), "worst_sales"),
    (f"{_NODD} > 0", "'explain_anomalies'", "'action'", "NULL", _NODD),
    ("TRUE", "CASE WHEN months < 24 THEN 'collect_more_months' ELSE 'use_history' END", "'action'", "NULL", "months"),
], ["Nation"], 5))
def business_actions(spark, d):
    return rounded(U.business_actions(V.sales(spark, d).drop("Region"), ["Nation"], 1.8), 4)


@query("chat_recommendations", f"WITH {facts_sql([], ['Category', 'Region'])} " + _lines([
    ("TRUE", "'prioritize_category'", "'action'", "top_Category", "top_Category_share"),
    ("Category_levels > 1", "'review_category'", "'action'", "weak_Category", "weak_Category_share"),
    ("TRUE", "'benchmark_region'", "'action'", "top_Region", "top_Region_share"),
    ("TRUE", _sig("growth_3", 5, "protect_growth", "investigate_decline", "create_growth"),
     _sig("growth_3", 5, "growing", "declining", "stable"), "NULL", "growth_3"),
    ("TRUE", "'study_best_month'", "'action'", _mon("best_month"), "best_sales"),
    ("TRUE", "'study_worst_month'", "'action'", _mon("worst_month"), "worst_sales"),
    ("TRUE", "'plan_with_forecast'", "'info'", "NULL", "NULL"),
]))
def chat_recommendations(spark, d):
    return rounded(U.planning_recommendations(V.sales(spark, d)), 4)


@query("upload_insights", f"""WITH {facts_sql()}, {_FENCE.format(v='Sales', t='sales')},
odd AS (SELECT count(*) AS n FROM sales, f WHERE Sales < low OR Sales > high),
p AS (SELECT sum(Sales) FILTER (WHERE "Date" >= x - 30) AS r, sum(Sales) FILTER (WHERE "Date" < x - 30 AND "Date" >= x - 60) AS q
  FROM sales, (SELECT max("Date") AS x FROM sales)) """ + _lines([
    ("(SELECT r IS NOT NULL AND q IS NOT NULL FROM p)", "'last_30_days'", "'message'", "NULL",
     "(SELECT coalesce((r - q) / nullif(q, 0) * 100, 0) FROM p)"),
    ("months >= 2", "'month_comparison'", _sig("mom", 0, "increasing", "decreasing", "stable"), "NULL", "mom"),
    ("months >= 6", "'long_trend'", "'message'", "NULL", "growth_half"),
    ("(SELECT n FROM odd) > 0", "'outliers'", "'message'", "NULL", "(SELECT n FROM odd)"),
    ("\"rows\" < 30", "'small_dataset'", "'suggestion'", "NULL", "\"rows\""),
]))
def upload_insights(spark, d):
    return rounded(U.upload_insights(V.sales(spark, d)), 4)


@query("signals", f"""WITH {facts_sql(['Nation'])}, {_month_odd(1.8, 'Nation')}
SELECT Nation, round(growth_3, 6) AS growth_3, {_sig('growth_3', 5, 'growing', 'declining', 'stable')} AS direction,
  round(coalesce(mom, 0), 6) AS mom, {_sig('coalesce(mom, 0)', 0, 'up', 'down', 'flat')} AS movement,
  {_NODD} AS anomalies, {_NODD} > 0 OR cv > 30 AS forecast_warning FROM facts""")
def signals(spark, d):
    return rounded(U.signals(V.sales(spark, d), ["Nation"], 1.8), 6)


@query("root_cause", f"""WITH {SALES_SQL},
k AS (SELECT Nation, count(*) AS n FROM sales GROUP BY Nation),
c AS (SELECT Nation, CAST(date_trunc('month', "Date") AS DATE) AS d, Category, sum(Sales) AS s FROM sales GROUP BY ALL),
t AS (SELECT Nation, d, sum(s) AS s, row_number() OVER (PARTITION BY Nation ORDER BY d DESC) AS r FROM c GROUP BY Nation, d),
e AS (SELECT Nation, max(d) FILTER (WHERE r = 1) AS now, max(d) FILTER (WHERE r = 2) AS then_,
  max(s) FILTER (WHERE r = 1) - max(s) FILTER (WHERE r = 2) AS total FROM t GROUP BY Nation),
g AS (SELECT Nation, Category, total, sum(CASE WHEN d = now THEN s ELSE -s END) AS ch
  FROM c JOIN e USING (Nation) WHERE d IN (now, then_) GROUP BY ALL),
p AS (SELECT * FROM g WHERE total <> 0 QUALIFY row_number() OVER (PARTITION BY Nation
  ORDER BY CASE WHEN total < 0 THEN ch ELSE -ch END, Category) = 1),
z AS (SELECT Nation, "Date", o_orderkey, round(abs(Sales - avg(Sales) OVER w) / stddev_samp(Sales) OVER w, 2) AS a,
  abs(Sales - avg(Sales) OVER w) / stddev_samp(Sales) OVER w AS raw FROM sales WINDOW w AS (PARTITION BY Nation)),
o AS (SELECT * FROM z WHERE raw > 2.5 QUALIFY row_number() OVER (PARTITION BY Nation ORDER BY a DESC, "Date", o_orderkey) = 1),
x AS (SELECT Nation, 1 AS p, 'not_enough_data' AS code, 'info' AS level, NULL AS subject, CAST(n AS DOUBLE) AS metric FROM k WHERE n < 30
  UNION ALL SELECT Nation, 2, 'category_driver', CASE WHEN total < 0 THEN 'decline' ELSE 'growth' END, Category, ch
    FROM p JOIN k USING (Nation) WHERE n >= 30
  UNION ALL SELECT Nation, 3, 'unusual_sales', CASE WHEN a >= 4 THEN 'high' WHEN a >= 3 THEN 'medium' ELSE 'low' END,
    strftime("Date", '%Y-%m-%d'), a FROM o JOIN k USING (Nation) WHERE n >= 30)
SELECT Nation, row_number() OVER (PARTITION BY Nation ORDER BY p) AS seq, code, level, subject, round(metric, 4) AS metric FROM x""")
def root_cause(spark, d):
    return rounded(U.root_cause(V.sales(spark, d).drop("Region"), ["Nation"], ["o_orderkey"]), 4)
