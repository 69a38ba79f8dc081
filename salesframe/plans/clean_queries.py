"""Cleaning, profiling, features and anomalies."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import repaired
from ..operators import anomaly as N
from ..operators import clean as C
from ..operators import features as W
from ..operators import profile as P
from ..operators.rollup import monthly_totals
from ..session import settle
from . import views as V
from .registry import SALES_SQL, monthly_sql, query, rounded


def _text_sql(unit: int, digits: int, suffix: str) -> str:
    return (f"'₹' || CAST(cents // {unit * 10 ** digits} AS VARCHAR) || '.' || "
            f"lpad(CAST((cents // {unit}) % {10 ** digits} AS VARCHAR), {digits}, '0') || '{suffix}'")


DIRTY_SQL = SALES_SQL + f""",
priced AS (SELECT *, CAST(round(Sales * 100) AS BIGINT) * CASE WHEN o_orderkey % 997 = 0 THEN 20 ELSE 1 END AS cents FROM sales),
dirty AS (
  SELECT o_orderkey AS order_id,
    CASE WHEN o_orderkey % 61 = 0 THEN 'n/a' ELSE CAST("Date" AS VARCHAR) END AS "Order Date",
    CASE WHEN o_orderkey % 37 = 0 THEN NULL ELSE (CASE WHEN o_orderkey % 43 = 0 THEN '-' ELSE '' END) ||
      CASE o_orderkey % 5 WHEN 1 THEN {_text_sql(1000, 2, 'k')} WHEN 2 THEN {_text_sql(10000, 3, 'L')}
        WHEN 3 THEN {_text_sql(100000, 4, 'Cr')} ELSE {_text_sql(1, 2, '')} END END AS Revenue,
    CASE WHEN o_orderkey % 41 = 0 THEN NULL ELSE Category END AS Category, Region,
    CASE WHEN o_orderkey % 29 = 0 THEN NULL ELSE o_orderkey % 50 END AS Units
  FROM priced, LATERAL (SELECT unnest(range(CASE WHEN o_orderkey % 53 = 0 THEN 2 ELSE 1 END)))),
typed AS (
  SELECT order_id, try_cast("Order Date" AS DATE) AS "Order Date",
    try_cast(regexp_replace(Revenue, '[^0-9.-]', '', 'g') AS DOUBLE) * CASE
      WHEN Revenue LIKE '%Cr' THEN 1e7 WHEN Revenue LIKE '%L' THEN 1e5 WHEN Revenue LIKE '%k' THEN 1e3 ELSE 1e0 END AS Revenue,
    Category, Region, Units FROM dirty),
kept AS (SELECT DISTINCT * FROM typed WHERE "Order Date" IS NOT NULL AND Revenue IS NOT NULL),
filled AS (
  SELECT order_id, "Order Date", Revenue,
    coalesce(Category, (SELECT Category FROM kept WHERE Category IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)) AS Category,
    Region, coalesce(CAST(Units AS DOUBLE), (SELECT median(CAST(Units AS DOUBLE)) FROM kept)) AS Units FROM kept)"""


def _dirty(body: str) -> str:
    return f"WITH {DIRTY_SQL} {body}"


@query("currency_parse", _dirty("SELECT order_id, round(Revenue, 2) AS Revenue, Category FROM typed"))
def currency_parse(spark, d):
    return rounded(C.parse_amounts(V.dirty(spark, d)).select("order_id", "Revenue", "Category"))


@query("date_parse", _dirty('SELECT order_id, "Order Date" FROM typed'))
def date_parse(spark, d):
    return C.parse_dates(V.dirty(spark, d)).select("order_id", "Order Date")


@query("dedup", _dirty("SELECT DISTINCT * FROM dirty"))
def dedup(spark, d):
    return C.drop_duplicates(V.dirty(spark, d))


@query("drop_null_keys", _dirty(
    'SELECT * REPLACE (round(Revenue, 2) AS Revenue) FROM typed WHERE "Order Date" IS NOT NULL AND Revenue IS NOT NULL'))
def drop_null_keys(spark, d):
    return rounded(C.drop_missing(V.dirty_typed(spark, d), ["Order Date", "Revenue"]))


@query("fill_median", _dirty("""
SELECT order_id, round(coalesce(Revenue, (SELECT median(Revenue) FROM typed)), 2) AS Revenue,
  coalesce(CAST(Units AS DOUBLE), (SELECT median(CAST(Units AS DOUBLE)) FROM typed)) AS Units FROM typed"""))
def fill_median(spark, d):
    return rounded(C.fill_median(V.dirty_typed(spark, d), ["Revenue", "Units"]).select("order_id", "Revenue", "Units"))


@query("fill_mode", _dirty("""
SELECT order_id, coalesce(Category, (SELECT Category FROM typed WHERE Category IS NOT NULL
  GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)) AS Category FROM typed"""))
def fill_mode(spark, d):
    return C.fill_mode(V.dirty_typed(spark, d), ["Category"]).select("order_id", "Category")


@query("fill_median_nan", _dirty("""
, gap AS (SELECT order_id, CASE WHEN order_id % 7 <> 0 THEN Revenue END AS Revenue FROM typed)
SELECT order_id, round(coalesce(Revenue, (SELECT median(Revenue) FROM gap)), 2) AS Revenue FROM gap"""))
def fill_median_nan(spark, d):
    """NaN is missing, like NULL."""
    return rounded(C.fill_median(V.with_nan(spark, d), ["Revenue"]))


@query("clip_negative", _dirty("SELECT order_id, round(greatest(Revenue, 0), 2) AS Revenue FROM kept"))
def clip_negative(spark, d):
    rows = C.drop_missing(C.drop_duplicates(V.dirty_typed(spark, d)), ["Order Date", "Revenue"])
    return rounded(C.clip_negative(rows, "Revenue").select("order_id", "Revenue"))


@query("rename_canonical", _dirty(
    'SELECT order_id, "Order Date" AS "Date", round(Revenue, 2) AS "Sales", Category, Region, Units FROM typed'))
def rename_canonical(spark, d):
    rows = V.dirty_typed(spark, d)
    return rounded(C.rename_canonical(rows, C.date_column(rows), C.target_column(rows)))


_MEANS = {"rolling_mean_7": 6, "rolling_mean_30": 6}
_CALENDAR_SQL = """year({d}) AS year, month({d}) AS month, day({d}) AS day, dayname({d}) AS weekday,
  quarter({d}) AS quarter, CAST(last_day({d}) = {d} AS BIGINT) AS is_month_end, CAST(day({d}) = 1 AS BIGINT) AS is_month_start"""


def _rolling_sql(v: str, over: str) -> str:
    lags = ", ".join(f"round(lag({v}, {k}) OVER ({over}), 2) AS lag_{k}" for k in (1, 2, 3))
    rolls = ", ".join(
        f"round({f}({v}) OVER ({over} ROWS BETWEEN {w - 1} PRECEDING AND CURRENT ROW), {g}) AS rolling_{n}_{w}"
        for w in (7, 30) for n, f, g in (("mean", "avg", 6), ("std", "stddev_samp", 2)))
    return lags + ", " + rolls


@query("clean_sales", _dirty(f"""
, c AS (SELECT order_id, "Order Date" AS "Date", greatest(Revenue, 0) AS s, Category, Region, Units FROM filled)
SELECT order_id, "Date", round(s, 2) AS "Sales", Category, Region, Units, {_CALENDAR_SQL.format(d='"Date"')},
  {_rolling_sql('s', 'ORDER BY "Date", order_id')} FROM c"""))
def clean_sales(spark, d):
    return rounded(C.clean_sales(V.dirty(spark, d), tiebreak=["order_id"]), **_MEANS)


@query("clean_upload", _dirty("""
SELECT order_id, "Order Date" AS "Date", round(greatest(Revenue, 0), 2) AS "Sales", Category, Region, Units FROM filled"""))
def clean_upload(spark, d):
    return rounded(C.clean_upload(V.dirty_typed(spark, d), "Order Date", "Revenue", ["order_id"]))


_FENCE = """q AS (SELECT quantile_cont({v}, 0.25) AS q1, quantile_cont({v}, 0.75) AS q3 FROM {t}),
f AS (SELECT q3 - q1 AS iqr, q1 - 1.5 * (q3 - q1) AS low, q3 + 1.5 * (q3 - q1) AS high FROM q)"""


@query("cleaning_steps", _dirty(f""", {_FENCE.format(v='Revenue', t='kept')},
n AS (SELECT (SELECT count(*) FROM typed) - (SELECT count(*) FROM (SELECT DISTINCT * FROM typed)) AS a,
  (SELECT count(*) FROM (SELECT DISTINCT * FROM typed WHERE "Order Date" IS NULL OR Revenue IS NULL)) AS b,
  (SELECT count(*) FILTER (WHERE Units IS NULL) FROM kept) AS c, (SELECT count(*) FILTER (WHERE Category IS NULL) FROM kept) AS d,
  (SELECT count(*) FROM kept, f WHERE Revenue < low OR Revenue > high) AS e,
  (SELECT count(*) FILTER (WHERE Revenue < 0) FROM kept) AS g, (SELECT count(*) FROM kept) AS h)
SELECT CAST(step AS BIGINT) AS step, code, n, CASE WHEN n = 0 OR step = 7 THEN 'ok' ELSE 'warn' END AS level FROM (
  SELECT 1 AS step, 'duplicates_removed' AS code, a AS n FROM n UNION ALL SELECT 2, 'rows_dropped', b FROM n
  UNION ALL SELECT 3, 'numeric_filled', c FROM n UNION ALL SELECT 4, 'text_filled', d FROM n
  UNION ALL SELECT 5, 'outliers', e FROM n UNION ALL SELECT 6, 'negatives_clipped', g FROM n
  UNION ALL SELECT 7, 'rows_left', h FROM n)"""))
def cleaning_steps(spark, d):
    return C.cleaning_steps(V.dirty_typed(spark, d), "Order Date", "Revenue")


@query("onehot", """SELECT c_custkey, """ + ", ".join(
    f"CAST(c_mktsegment = '{v}' AS BIGINT) AS \"Segment_{v}\"" for v in ("BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")
) + " FROM customer")
def onehot(spark, d):
    rows = V.table(spark, d, "customer").select("c_custkey", F.col("c_mktsegment").alias("Segment"))
    return W.one_hot(rows)


@query("onehot_vectors", """
WITH v AS (SELECT n_name, row_number() OVER (ORDER BY n_name) AS i, count(*) OVER () AS n FROM (SELECT DISTINCT n_name FROM nation JOIN customer ON c_nationkey = n_nationkey))
SELECT c_custkey, CAST(n - 1 AS INTEGER) AS size, CAST(i - 2 AS INTEGER) AS place
FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN v USING (n_name)""")
def onehot_vectors(spark, d):
    rows = V.table(spark, d, "customer").join(
        V.table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "n_name")
    return W.one_hot_vectors(rows, ["n_name"]).select(
        "c_custkey", F.col("n_name_levels.size").alias("size"), F.coalesce(F.get("n_name_levels.indices", F.lit(0)), F.lit(-1)).alias("place"))


@query("minmax", """
WITH r AS (SELECT min(l_quantity) AS a, max(l_quantity) AS b, min(l_tax) AS c, max(l_tax) AS e FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice AS "Sales", round((l_quantity - a) / (b - a), 6) AS qty,
  round((l_tax - c) / (e - c), 6) AS tax FROM lineitem, r""")
def minmax(spark, d):
    rows = V.table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", F.col("l_extendedprice").alias("Sales"),
        F.col("l_quantity").alias("qty"), F.col("l_tax").alias("tax"))
    return rounded(W.min_max(rows, exclude=["l_orderkey", "l_linenumber", "l_partkey", "Sales"]), 6)


_PLAIN = "text"
for _a, _b in (("’", "''"), ("‘", "''"), ("“", '"'), ("”", '"'), ("–", "-"), ("—", "-"), ("…", "..."), (" ", " ")):
    _PLAIN = f"replace({_PLAIN}, '{_a}', '{_b}')"


@query("text_repair", f"SELECT doc_id, trim(regexp_replace({_PLAIN}, '\\s+', ' ', 'g')) AS text FROM documents")
def text_repair(spark, d):
    return V.table(spark, d, "documents").select("doc_id", repaired(F.col("text")).alias("text"))


def _schema_sql(columns) -> str:
    rows = " UNION ALL ".join(
        f"SELECT {i} AS p, '{c}' AS c, '{t}' AS t, count(*) FILTER (WHERE \"{c}\" IS NULL) AS n, "
        f"CAST(min(\"{c}\") AS VARCHAR) AS s FROM dirty" for i, (c, t) in enumerate(columns, 1))
    return _dirty(f""", r AS ({rows}),
u AS (SELECT (SELECT count(*) FROM dirty) AS a, (SELECT count(*) FROM (SELECT DISTINCT * FROM dirty)) AS b)
SELECT CAST(p AS BIGINT) AS position, c AS "column", t AS dtype, n AS missing, s AS sample, a AS "rows", a - b AS duplicates
FROM r, u""")


@query("schema_summary", _schema_sql([
    ("order_id", "bigint"), ("Order Date", "string"), ("Revenue", "string"),
    ("Category", "string"), ("Region", "string"), ("Units", "bigint")]))
def schema_summary(spark, d):
    return P.schema_summary(V.dirty(spark, d))


_CHECKS = f""", {_FENCE.format(v='Revenue', t='typed')},
z AS (SELECT count(*) AS n,
  count(*) - count("Order Date") + count(*) - count(Revenue) + count(*) - count(Category) + count(*) - count(Units) AS nulls,
  count(*) FILTER (WHERE Revenue < 0) AS neg FROM typed),
y AS (SELECT n, nulls, neg, nulls / (n * 6) * 100 AS share, n - (SELECT count(*) FROM (SELECT DISTINCT * FROM typed)) AS dup FROM z)
SELECT 'rows' AS "check", CASE WHEN n >= 100 THEN 'ok' WHEN n >= 30 THEN 'warn' ELSE 'error' END AS level, CAST(n AS DOUBLE) AS metric FROM y
UNION ALL SELECT 'date_column', 'ok', 1 UNION ALL SELECT 'target_column', 'ok', 1
UNION ALL SELECT 'missing_values', CASE WHEN share = 0 THEN 'ok' WHEN share < 20 THEN 'warn' ELSE 'error' END, nulls FROM y
UNION ALL SELECT 'duplicate_rows', CASE WHEN dup = 0 THEN 'ok' ELSE 'warn' END, dup FROM y
UNION ALL SELECT 'negative_values', CASE WHEN neg = 0 THEN 'ok' ELSE 'warn' END, neg FROM y"""


@query("validation_checks", _dirty(_CHECKS + """
UNION ALL SELECT 'outliers', CASE WHEN count(*) = 0 THEN 'ok' ELSE 'warn' END, count(*) FROM typed, f WHERE Revenue < low OR Revenue > high"""))
def validation_checks(spark, d):
    return P.validation_checks(V.dirty_typed(spark, d), "Order Date", "Revenue")


@query("extra_checks", _dirty(_CHECKS + """
UNION ALL SELECT 'monthly_history', 'ok', count(DISTINCT date_trunc('month', "Order Date")) FROM kept
UNION ALL SELECT 'monthly_gaps', CASE WHEN g = 0 THEN 'ok' ELSE 'warn' END, g FROM (
  SELECT date_diff('month', min("Order Date"), max("Order Date")) + 1 - count(DISTINCT date_trunc('month', "Order Date")) AS g FROM kept)
UNION ALL SELECT 'repeated_date_category', CASE WHEN g = 0 THEN 'ok' ELSE 'warn' END, g FROM (
  SELECT (SELECT count(*) FROM typed) - (SELECT count(*) FROM (SELECT DISTINCT "Order Date", Category FROM typed)) AS g)"""))
def extra_checks(spark, d):
    return P.forecast_checks(V.dirty_typed(spark, d), "Order Date", "Revenue")


@query("cleaning_report", _dirty(f""", {_FENCE.format(v='Revenue', t='typed')},
z AS (SELECT count(*) AS n,
  count(*) - count("Order Date") + count(*) - count(Revenue) + count(*) - count(Category) + count(*) - count(Units) AS nulls FROM typed)
SELECT n AS rows_before, (SELECT count(*) FROM filled) AS rows_after,
  n - (SELECT count(*) FROM (SELECT DISTINCT * FROM typed)) AS duplicates_removed, nulls AS missing_fixed,
  2 AS columns_converted, (SELECT count(*) FROM typed, f WHERE Revenue < low OR Revenue > high) AS outliers_detected FROM z"""))
def cleaning_report(spark, d):
    raw = settle(V.dirty_typed(spark, d), "typed")  # read from text once; the report and the cleaning pass over it
    return P.cleaning_report(raw, C.clean_upload(raw, "Order Date", "Revenue", ["order_id"]), "Order Date", "Revenue")


# --- time features -----------------------------------------------------------

@query("calendar_features", f"""
SELECT l_orderkey, l_linenumber, CAST(l_shipdate AS DATE) AS "Date", {_CALENDAR_SQL.format(d='CAST(l_shipdate AS DATE)')} FROM lineitem""")
def calendar_features(spark, d):
    rows = V.table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", F.to_date("l_shipdate").alias("Date"))
    return W.calendar_features(rows)


def _lag_rows(spark, d):
    return V.sales(spark, d).select("o_orderkey", "Region", "Date", "Sales")


@query("lag_features", f"""WITH {SALES_SQL}
SELECT o_orderkey, Region, "Date", Sales AS "Sales", lag(Sales, 1) OVER w AS lag_1, lag(Sales, 2) OVER w AS lag_2,
  lag(Sales, 3) OVER w AS lag_3 FROM sales WINDOW w AS (PARTITION BY Region ORDER BY "Date", o_orderkey)""")
def lag_features(spark, d):
    return W.lag_features(_lag_rows(spark, d), ["Date", "o_orderkey"], ["Region"])


@query("rolling_features", f"""WITH {SALES_SQL}
SELECT o_orderkey, "Date", Sales AS "Sales", Region, """ + ", ".join(
    f"round({f}(Sales) OVER (ORDER BY \"Date\", o_orderkey ROWS BETWEEN {w - 1} PRECEDING AND CURRENT ROW), {g}) AS rolling_{n}_{w}"
    for w in (7, 30) for n, f, g in (("mean", "avg", 6), ("std", "stddev_samp", 2))) + " FROM sales")
def rolling_features(spark, d):
    return rounded(W.rolling_features(_lag_rows(spark, d), ["Date", "o_orderkey"]), **_MEANS)


@query("model_features", f"""WITH {monthly_sql(["Nation"])},
x AS (SELECT Nation, d, s, lag(s, 1) OVER w AS l1, lag(s, 2) OVER w AS l2, lag(s, 3) OVER w AS l3,
  avg(s) OVER (w ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS a, stddev_samp(s) OVER (w ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS b
  FROM m WINDOW w AS (PARTITION BY Nation ORDER BY d))
SELECT Nation, d AS "Date", round(s, 2) AS "Sales", round(l1, 2) AS lag_1, round(l2, 2) AS lag_2, round(l3, 2) AS lag_3,
  round(a, 2) AS rolling_mean_3, round(b, 2) AS rolling_std_3, month(d) AS month, quarter(d) AS quarter, year(d) AS year
FROM x WHERE l3 IS NOT NULL""")
def model_features(spark, d):
    return rounded(W.model_features(monthly_totals(V.sales(spark, d), ["Nation"]), ["Nation"]))


@query("mom_change", f"""WITH {monthly_sql(["Region"])}
SELECT Region, d AS "Date", round(s, 2) AS "Sales", round((s - lag(s) OVER w) / lag(s) OVER w * 100, 4) AS "MoM",
  round(avg(s) OVER (w ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 4) AS "Rolling3"
FROM m WINDOW w AS (PARTITION BY Region ORDER BY d)""")
def mom_change(spark, d):
    out = W.month_change(monthly_totals(V.sales(spark, d), ["Region"]), ["Region"])
    return out.select("Region", "Date", F.round("Sales", 2).alias("Sales"),
                      F.round("MoM", 4).alias("MoM"), F.round("Rolling3", 4).alias("Rolling3"))


@query("running_total", f"""WITH {monthly_sql(["Region"])}
SELECT Region, d AS "Date", round(s, 2) AS "Sales", round(sum(s) OVER (PARTITION BY Region ORDER BY d), 2) AS "Cumulative" FROM m""")
def running_total(spark, d):
    return rounded(W.running_total(monthly_totals(V.sales(spark, d), ["Region"]), ["Region"]))


@query("recent_growth", f"""WITH {monthly_sql(["Nation"])},
g AS (SELECT *, (s - lag(s) OVER (PARTITION BY Nation ORDER BY d)) / lag(s) OVER (PARTITION BY Nation ORDER BY d) AS r FROM m)
SELECT Nation, round(avg(s) FILTER (WHERE i > n - 6), 6) AS recent_avg,
  round(greatest(least(coalesce(avg(r) FILTER (WHERE i > n - 6), 0), 0.15), -0.15), 6) AS recent_growth FROM g GROUP BY Nation""")
def recent_growth(spark, d):
    out = W.recent_growth(monthly_totals(V.sales(spark, d), ["Nation"]), ["Nation"])
    return out.select("Nation", F.round("recent_avg", 6).alias("recent_avg"), F.round("recent_growth", 6).alias("recent_growth"))


@query("recent_slope", f"""WITH {monthly_sql(["Nation"])}
SELECT Nation, round(regr_slope(s, i) FILTER (WHERE i > n - 6), 2) AS slope FROM m GROUP BY Nation""")
def recent_slope(spark, d):
    return rounded(W.recent_slope(monthly_totals(V.sales(spark, d), ["Nation"]), ["Nation"]))


# --- anomalies ---------------------------------------------------------------

_SEV = "CASE WHEN a >= {h} THEN 'high' WHEN a >= {m} THEN 'medium' ELSE 'low' END"


@query("anomaly_zscore", f"""WITH {monthly_sql(["Nation"])},
z AS (SELECT *, abs((s - avg(s) OVER w) / nullif(stddev_samp(s) OVER w, 0)) AS z FROM m WINDOW w AS (PARTITION BY Nation)),
a AS (SELECT *, round(z, 2) AS a FROM z WHERE z > 2.5)
SELECT Nation, d AS "Date", round(s, 2) AS "Sales", a AS anomaly_score, {_SEV.format(h=4, m=3)} AS severity, 'zscore' AS method FROM a""")
def anomaly_zscore(spark, d):
    return rounded(N.detect_anomalies(monthly_totals(V.sales(spark, d), ["Nation"]), "zscore", keys=["Nation"]))


@query("anomaly_iqr", f"""WITH {monthly_sql(["Nation"])},
q AS (SELECT Nation, quantile_cont(s, 0.25) AS q1, quantile_cont(s, 0.75) AS q3 FROM m GROUP BY Nation),
a AS (SELECT Nation, d, s, round(greatest(abs(s - (q3 + 1.5 * (q3 - q1))), abs(q1 - 1.5 * (q3 - q1) - s)) / greatest(q3 - q1, 1), 2) AS a
  FROM m JOIN q USING (Nation) WHERE q3 > q1 AND (s < q1 - 1.5 * (q3 - q1) OR s > q3 + 1.5 * (q3 - q1)))
SELECT Nation, d AS "Date", round(s, 2) AS "Sales", a AS anomaly_score, {_SEV.format(h=3, m=2)} AS severity, 'iqr' AS method FROM a""")
def anomaly_iqr(spark, d):
    return rounded(N.detect_anomalies(monthly_totals(V.sales(spark, d), ["Nation"]), "iqr", keys=["Nation"]))


def _roll_sql(source: str, key: str, order: str, threshold: float, frame: str) -> str:
    return f"""x AS (SELECT *, avg(s) OVER w AS mu, stddev_samp(s) OVER w AS sd, count(*) OVER w AS c
  FROM {source} WINDOW w AS ({key} ORDER BY {order} ROWS BETWEEN {frame})),
a AS (SELECT *, round(abs(s - mu) / nullif(sd, 0), 2) AS a FROM x WHERE c >= 3 AND abs(s - mu) / nullif(sd, 0) > {threshold})"""


@query("anomaly_rolling", f"""WITH {monthly_sql(["Nation"])}, {_roll_sql('m', 'PARTITION BY Nation', 'd', 1.8, '5 PRECEDING AND CURRENT ROW')}
SELECT Nation, d AS "Date", round(s, 2) AS "Sales", a AS anomaly_score, {_SEV.format(h=4, m=3)} AS severity,
  'rolling_deviation' AS method FROM a""")
def anomaly_rolling(spark, d):
    return rounded(N.detect_anomalies(monthly_totals(V.sales(spark, d), ["Nation"]), "rolling_deviation", 1.8,
                                      keys=["Nation"], by_period=True))


@query("anomaly_rolling_rows", f"""WITH {SALES_SQL}, r AS (SELECT *, Sales AS s FROM sales),
{_roll_sql('r', 'PARTITION BY Region', '"Date", o_orderkey', 2.5, '6 PRECEDING AND 1 PRECEDING')}
SELECT Region, o_orderkey, "Date", round(s, 2) AS "Sales", a AS anomaly_score, {_SEV.format(h=4, m=3)} AS severity,
  'rolling_deviation' AS method FROM a""")
def anomaly_rolling_rows(spark, d):
    return rounded(N.detect_anomalies(V.sales(spark, d), "rolling_deviation", keys=["Region"],
                                      tiebreak=["o_orderkey"], include_current=False))


@query("outliers_iqr", _dirty(f""", {_FENCE.format(v='Revenue', t='kept')}
SELECT order_id, round(Revenue, 2) AS Revenue, round(greatest(abs(Revenue - high), abs(low - Revenue)) / greatest(iqr, 1), 2) AS outlier_score,
  'iqr' AS outlier_method FROM kept, f WHERE iqr > 0 AND (Revenue < low OR Revenue > high)"""))
def outliers_iqr(spark, d):
    rows = C.drop_missing(C.drop_duplicates(V.dirty_typed(spark, d)), ["Order Date", "Revenue"])
    return rounded(N.detect_outliers(rows.select("order_id", "Revenue"), "Revenue", "iqr"))


@query("outliers_iqr_keyed", """
WITH q AS (SELECT event_type, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM events GROUP BY 1),
f AS (SELECT event_type, q3 - q1 AS iqr, q1 - 1.5 * (q3 - q1) AS low, q3 + 1.5 * (q3 - q1) AS high FROM q)
SELECT event_type, event_id, value, round(greatest(abs(value - high), abs(low - value)) / greatest(iqr, 1), 2) AS outlier_score,
  'iqr' AS outlier_method FROM events JOIN f USING (event_type) WHERE iqr > 0 AND (value < low OR value > high)""")
def outliers_iqr_keyed(spark, d):
    rows = V.table(spark, d, "events").select("event_type", "event_id", "value")
    return N.detect_outliers(rows, "value", "iqr", ["event_type"])


@query("outliers_zscore", """
WITH c AS (SELECT avg(value) AS mu, stddev_samp(value) AS sd FROM events)
SELECT event_id, value, round(abs(value - mu) / sd, 2) AS outlier_score, 'zscore' AS outlier_method
FROM events, c WHERE abs(value - mu) / sd > 3""")
def outliers_zscore(spark, d):
    return N.detect_outliers(V.table(spark, d, "events").select("event_id", "value"), "value", "zscore")


_MONTH_ROLL = f"""WITH {monthly_sql(["Nation"])}, {_roll_sql('m', 'PARTITION BY Nation', 'd', 1.5, '5 PRECEDING AND CURRENT ROW')},
v AS (SELECT *, {_SEV.format(h=4, m=3)} AS severity FROM a)"""


def _month_anomalies(spark, d):
    return N.detect_anomalies(monthly_totals(V.sales(spark, d), ["Nation"]), "rolling_deviation", 1.5,
                              keys=["Nation"], by_period=True)


@query("severity_counts", _MONTH_ROLL + """
SELECT Nation, count(*) FILTER (WHERE severity = 'low') AS low, count(*) FILTER (WHERE severity = 'medium') AS medium,
  count(*) FILTER (WHERE severity = 'high') AS high FROM v GROUP BY Nation""")
def severity_counts(spark, d):
    return N.severity_counts(_month_anomalies(spark, d), ["Nation"])


@query("strongest_anomaly", _MONTH_ROLL + """
SELECT Nation, d AS "Date", round(s, 2) AS "Sales", a AS anomaly_score, severity FROM v
QUALIFY row_number() OVER (PARTITION BY Nation ORDER BY a DESC, d) = 1""")
def strongest_anomaly(spark, d):
    return rounded(N.strongest_anomaly(_month_anomalies(spark, d), ["Nation"]))
