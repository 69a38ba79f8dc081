"""Roll-ups, rankings and joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import ranking as K
from ..operators import rollup as R
from . import views as V
from .registry import SALES_SQL, facts_sql, query, rounded

REGIONS = ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]
M = "CAST(date_trunc('month', \"Date\") AS DATE)"


def _with(body: str) -> str:
    return f"WITH {SALES_SQL} {body}"


@query("monthly_totals", _with(f"""
SELECT Region, {M} AS "Date", round(sum(Sales), 2) AS "Sales" FROM sales GROUP BY Region, {M}"""))
def monthly_totals(spark, d):
    return rounded(R.monthly_totals(V.sales(spark, d), ["Region"]))


@query("weekly_totals", _with("""
SELECT CAST(date_trunc('week', "Date") AS DATE) AS "Date", round(sum(Sales), 2) AS "Sales"
FROM sales GROUP BY 1"""))
def weekly_totals(spark, d):
    return rounded(R.period_totals(V.sales(spark, d), "week"))


@query("yearly_totals", _with("""
SELECT Category, year("Date") AS "Year", round(sum(Sales), 2) AS "Sales" FROM sales GROUP BY ALL"""))
def yearly_totals(spark, d):
    return rounded(R.period_totals(V.sales(spark, d), "year", ["Category"]))


@query("dim_share", _with("""
SELECT Region, Category, round(sum(Sales), 2) AS "Sales",
  round(sum(Sales) / sum(sum(Sales)) OVER (PARTITION BY Region) * 100, 4) AS "Share"
FROM sales GROUP BY Region, Category"""))
def dim_share(spark, d):
    out = R.dimension_share(V.sales(spark, d), "Category", ["Region"])
    return out.select("Region", "Category", F.round("Sales", 2).alias("Sales"), F.round("Share", 4).alias("Share"))


@query("month_category", _with(f""",
c AS (SELECT {M} AS d, Category, sum(Sales) AS s FROM sales GROUP BY ALL)
SELECT d AS "Date", Category, round(s, 2) AS "Sales",
  row_number() OVER (PARTITION BY d ORDER BY s DESC, Category) AS rank,
  row_number() OVER (ORDER BY s DESC, d, Category) = 1 AS strongest,
  row_number() OVER (ORDER BY d DESC, s DESC, Category) = 1 AS latest_leader FROM c"""))
def month_category(spark, d):
    return rounded(R.month_by_dimension(V.sales(spark, d), "Category"))


@query("category_region_pivot", _with("SELECT Category, " + ", ".join(
    f"round(coalesce(sum(Sales) FILTER (WHERE Region = '{r}'), 0), 2) AS \"{r}\"" for r in REGIONS
) + " FROM sales GROUP BY Category"))
def category_region_pivot(spark, d):
    return rounded(R.cross_tab(V.sales(spark, d), "Category", "Region", REGIONS))


@query("segment_share", _with(f""",
c AS (SELECT Category, {M} AS d, sum(Sales) AS s FROM sales GROUP BY ALL),
t AS (SELECT *, sum(s) OVER (PARTITION BY d) AS t, lag(s) OVER (PARTITION BY Category ORDER BY d) AS p FROM c)
SELECT Category, d AS "Date", round(s, 2) AS "Sales", round(t, 2) AS "Total",
  round(s / t * 100, 2) AS "Share", round((s - p) / p * 100, 2) AS "MoM" FROM t"""))
def segment_share(spark, d):
    return rounded(R.segment_share(V.sales(spark, d), "Category"))


@query("missing_months", """
WITH r AS (SELECT c_custkey AS k, CAST(date_trunc('month', o_orderdate) AS DATE) AS m
           FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL),
g AS (SELECT k, CAST(unnest(generate_series(min(m), max(m), INTERVAL 1 MONTH)) AS DATE) AS m FROM r GROUP BY k)
SELECT k AS o_custkey, m AS "Date" FROM g ANTI JOIN r USING (k, m)""")
def missing_months(spark, d):
    orders = V.table(spark, d, "orders").select(
        "o_custkey", F.to_date("o_orderdate").alias("Date"), F.col("o_totalprice").alias("Sales"))
    return R.missing_periods(orders, ["o_custkey"])


@query("fill_calendar", """
WITH s AS (SELECT o_custkey, CAST(date_trunc('month', o_orderdate) AS DATE) AS m, sum(o_totalprice) AS s
           FROM orders GROUP BY ALL),
g AS (SELECT o_custkey, CAST(unnest(generate_series(min(m), max(m), INTERVAL 1 MONTH)) AS DATE) AS m FROM s GROUP BY 1)
SELECT o_custkey, m AS "Date", round(coalesce(s.s, 0), 2) AS "Sales" FROM g LEFT JOIN s USING (o_custkey, m)""")
def fill_calendar(spark, d):
    orders = V.table(spark, d, "orders").select(
        "o_custkey", F.to_date("o_orderdate").alias("Date"), F.col("o_totalprice").alias("Sales"))
    return rounded(R.fill_calendar(R.monthly_totals(orders, ["o_custkey"]), ["o_custkey"]))


@query("dataset_summary", f"""WITH {facts_sql()}
SELECT "rows", round(total, 2) AS total, round(row_avg, 6) AS row_avg, first_day, last_day, months,
  round(month_avg, 6) AS month_avg, best_month, round(best_sales, 2) AS best_sales, worst_month,
  round(worst_sales, 2) AS worst_sales, latest_month, round(latest_sales, 2) AS latest_sales FROM facts""")
def dataset_summary(spark, d):
    return rounded(R.dataset_summary(V.sales(spark, d)), 6, total=2, best_sales=2, worst_sales=2, latest_sales=2)


def _facts(spark, d, keys, *columns):
    return rounded(R.business_facts(V.sales(spark, d), keys).select(*keys, *columns), 6)


def _facts_sql(keys, *columns):
    from .registry import cols
    return f"WITH {facts_sql(keys)} SELECT {cols(keys)}" + ", ".join(
        f"round({c}, 6) AS {c}" for c in columns) + " FROM facts"


@query("growth_first_last3", _facts_sql(["Nation"], "first3", "last3", "growth_3"))
def growth_first_last3(spark, d):
    return _facts(spark, d, ["Nation"], "first3", "last3", "growth_3")


@query("growth_halves", _facts_sql(["Nation"], "first_half", "second_half", "growth_half"))
def growth_halves(spark, d):
    return _facts(spark, d, ["Nation"], "first_half", "second_half", "growth_half")


@query("momentum3", _facts_sql(["Nation"], "last3", "prev3", "momentum"))
def momentum3(spark, d):
    return _facts(spark, d, ["Nation"], "last3", "prev3", "momentum")


@query("last30_vs_prior30", _with("""
, l AS (SELECT Region, max("Date") AS last_day FROM sales GROUP BY Region),
s AS (SELECT Region, last_day,
  sum(Sales) FILTER (WHERE "Date" >= last_day - 30) AS r,
  sum(Sales) FILTER (WHERE "Date" < last_day - 30 AND "Date" >= last_day - 60) AS p
  FROM sales JOIN l USING (Region) GROUP BY ALL)
SELECT Region, last_day, round(r, 2) AS recent_sales, round(p, 2) AS prior_sales,
  round(CASE WHEN r IS NOT NULL AND p IS NOT NULL THEN coalesce((r - p) / nullif(p, 0) * 100, 0) END, 2) AS change_pct
FROM s"""))
def last30_vs_prior30(spark, d):
    return rounded(R.recent_days(V.sales(spark, d), ["Region"]))


@query("volatility", f"""WITH {facts_sql(["Nation"])}
SELECT Nation, round(month_std, 2) AS month_std, round(cv, 4) AS cv,
  CASE WHEN cv < 10 THEN 'Stable' WHEN cv < 20 THEN 'Moderately Stable' ELSE 'Volatile' END AS label
FROM facts""")
def volatility(spark, d):
    from ..functions.labels import volatility_label
    f = R.business_facts(V.sales(spark, d), ["Nation"])
    return f.select("Nation", F.round("month_std", 2).alias("month_std"), F.round("cv", 4).alias("cv"),
                    volatility_label(F.col("cv")).alias("label"))


@query("histogram30", """
WITH b AS (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem),
c AS (SELECT least(CAST(floor((l_extendedprice - lo) / ((hi - lo) / 30)) AS BIGINT) + 1, 30) AS bin, count(*) AS n
      FROM lineitem, b GROUP BY 1),
g AS (SELECT unnest(range(1, 31)) AS bin)
SELECT g.bin, round(lo + (hi - lo) / 30 * (g.bin - 1), 4) AS bin_start,
  round(lo + (hi - lo) / 30 * g.bin, 4) AS bin_end, coalesce(n, 0) AS n
FROM g CROSS JOIN b LEFT JOIN c USING (bin)""")
def histogram30(spark, d):
    lines = V.table(spark, d, "lineitem").select(F.col("l_extendedprice").alias("Sales"))
    return rounded(R.histogram(lines), 4)


_NUM = ["Sales", "Orders", "Returns"]
_PAIRS = [(a, b) for a in _NUM for b in _NUM]


@query("corr_matrix", _with("""
, li AS (SELECT l_orderkey, count(*) AS o, count(*) FILTER (WHERE l_returnflag = 'R') AS r FROM lineitem GROUP BY 1),
x AS (SELECT Sales, coalesce(o, 0) AS Orders, coalesce(r, 0) AS Returns FROM sales LEFT JOIN li ON l_orderkey = o_orderkey),
p AS (""" + " UNION ALL ".join(
    f"SELECT '{a}' AS column_a, '{b}' AS column_b, corr({a}, {b}) AS r FROM x" for a, b in _PAIRS) + """)
SELECT column_a, column_b, round(r, 6) AS r,
  CASE WHEN abs(r) < 0.3 THEN 'weak' WHEN abs(r) < 0.6 THEN 'moderate' ELSE 'strong' END AS strength,
  CASE WHEN column_a = 'Sales' AND column_b <> 'Sales' THEN
    row_number() OVER (PARTITION BY column_a = 'Sales' AND column_b <> 'Sales' ORDER BY abs(r) DESC, column_b) END AS target_rank
FROM p"""))
def corr_matrix(spark, d):
    return rounded(R.correlation(V.sales_with_items(spark, d), _NUM), 6)


@query("dim_values", _with("SELECT Nation, count(*) AS n FROM sales GROUP BY Nation"))
def dim_values(spark, d):
    return R.level_counts(V.sales(spark, d), "Nation")


@query("uplift", f"""WITH {facts_sql(["Region"])}
SELECT Region, round(total, 2) AS total, round(total * 1.2, 2) AS uplift_total,
  round(total * 1.2 - total, 2) AS extra_total, round(month_avg, 6) AS month_avg,
  round(month_avg * 1.2, 6) AS uplift_month_avg FROM facts""")
def uplift(spark, d):
    return rounded(R.uplift(V.sales(spark, d), ["Region"]), 2, month_avg=6, uplift_month_avg=6)


@query("rank_dim", """
WITH t AS (SELECT r_name AS Region, p_brand AS Brand, sum(l_extendedprice) AS s
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey
  JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
  JOIN region ON n_regionkey = r_regionkey GROUP BY ALL),
r AS (SELECT *, sum(s) OVER (PARTITION BY Region) AS w,
  row_number() OVER (PARTITION BY Region ORDER BY s DESC, Brand) AS b,
  row_number() OVER (PARTITION BY Region ORDER BY s, Brand) AS l FROM t)
SELECT Region, 'best' AS mode, Brand, round(s, 2) AS "Sales", round(s / w * 100, 2) AS "Share" FROM r WHERE b = 1
UNION ALL SELECT Region, 'weakest', Brand, round(s, 2), round(s / w * 100, 2) FROM r WHERE l = 1""")
def rank_dim(spark, d):
    lines = V.table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("o_orderkey"), F.col("l_partkey").alias("p_partkey"),
        F.col("l_extendedprice").alias("Amount"))
    brand = V.table(spark, d, "part").select("p_partkey", F.col("p_brand").alias("Brand"))
    region = V.sales(spark, d).select("o_orderkey", "Region")
    rows = lines.join(brand, "p_partkey").join(region, "o_orderkey")
    return rounded(K.rank_dimension(rows, keys=["Region"], value_col="Amount"))


@query("best_worst_month", f"""WITH {facts_sql(["Nation"])}
SELECT Nation, best_month, round(best_sales, 2) AS best_sales, worst_month, round(worst_sales, 2) AS worst_sales
FROM facts""")
def best_worst_month(spark, d):
    return rounded(K.best_worst_month(V.sales(spark, d), ["Nation"]))


@query("topn_groups", """
SELECT o_custkey, round(sum(o_totalprice), 2) AS "Sales" FROM orders
GROUP BY 1 ORDER BY sum(o_totalprice) DESC, 1 LIMIT 8""")
def topn_groups(spark, d):
    orders = V.table(spark, d, "orders").select("o_custkey", F.col("o_totalprice").alias("Sales"))
    return rounded(K.top_groups(orders, ["o_custkey"]))


@query("topn_rows", """
WITH t AS (SELECT o_custkey FROM orders GROUP BY 1 ORDER BY sum(o_totalprice) DESC, 1 LIMIT 8)
SELECT o_custkey, o_orderkey, o_totalprice AS "Sales" FROM orders SEMI JOIN t USING (o_custkey)""")
def topn_rows(spark, d):
    orders = V.table(spark, d, "orders").select("o_custkey", "o_orderkey", F.col("o_totalprice").alias("Sales"))
    return K.rows_of_top_groups(orders, ["o_custkey"])


@query("preview_last", """
SELECT o_orderkey, CAST(o_orderdate AS DATE) AS "Date", o_totalprice AS "Sales" FROM orders
ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 10""")
def preview_last(spark, d):
    orders = V.table(spark, d, "orders").select(
        "o_orderkey", F.to_date("o_orderdate").alias("Date"), F.col("o_totalprice").alias("Sales"))
    return K.preview(orders, ["Date", "o_orderkey"], last=True)


@query("scope_filter", _with("""
SELECT o_orderkey, "Date", Sales AS "Sales", Category FROM sales WHERE lower(Category) = 'building'"""))
def scope_filter(spark, d):
    from ..operators.clean import scope
    return scope(V.sales(spark, d), "Category", "Building").select("o_orderkey", "Date", "Sales", "Category")
