"""Questions over the conversation turns, and currency text."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.labels import inr_text
from ..operators import answers as A
from ..operators import questions as Q
from ..operators.cube import roll_up
from ..session import settle
from . import views as V
from .forecast_sql import all_models_sql, champion_outer, holdout_outer, metrics_sql
from .registry import SALES_SQL, facts_sql, query, rounded

IDS = ["conv_id", "turn"]
SCOPES = ["Category", "Region", "Nation"]
_PHRASES = ", ".join("'" + p.replace("'", "''") + "'" for p in V.PHRASES)

ASK_SQL = f"""ask AS (SELECT conv_id, turn, concat_ws(' ', text, ([{_PHRASES}])[(conv_id * 7 + turn) % {len(V.PHRASES)} + 1]) AS question
  FROM conversations)"""


def _any(words, q: str = "q") -> str:
    return "(" + " OR ".join(f"contains({q}, '{w}')" for w in words) + ")"


_W = Q.INTENT_WORDS
_NUM = "|".join(Q.NUMBERS)
INTENT_SQL = f"""cl AS (SELECT *, lower(question) AS q FROM ask),
it AS (SELECT *, CASE
  WHEN {_any(_W['anomaly'])} THEN 'anomaly' WHEN {_any(_W['recommendations'])} THEN 'recommendations'
  WHEN {_any(_W['model_info'])} THEN 'model_info'
  WHEN {_any(_W['project_info'])} OR regexp_matches(q, '(^|[^\\pL\\pN_])app([^\\pL\\pN_]|$)') THEN 'project_info'
  WHEN {_any(_W['data_info'])} THEN 'data_info' WHEN {_any(_W['scenario'])} THEN 'scenario'
  WHEN {_any(_W['forecast'])} OR regexp_matches(q, '(^|[^\\pL\\pN_])next\\s+(\\d+|{_NUM})[-\\s]*(month|months|year|years)([^\\pL\\pN_]|$)') THEN 'forecast'
  WHEN {_any(_W['comparison'])} THEN 'comparison' WHEN {_any(_W['summary'])} THEN 'summary'
  WHEN contains(q, 'region') AND {_any(Q.WEAK)} THEN 'weakest_region' WHEN contains(q, 'category') AND {_any(Q.WEAK)} THEN 'weakest_category'
  WHEN {_any(Q.PRODUCT)} AND {_any(Q.WEAK)} THEN 'weakest_product' WHEN contains(q, 'month') AND {_any(Q.WEAK)} THEN 'weakest_month'
  WHEN {_any(_W['best_month'])} THEN 'best_month' WHEN {_any(_W['best_category'])} THEN 'best_category'
  WHEN {_any(_W['best_product'])} THEN 'best_product' WHEN {_any(_W['best_region'])} THEN 'best_region'
  WHEN {_any(_W['trend'])} THEN 'trend' WHEN {_any(_W['overview'])} THEN 'summary' ELSE 'fallback' END AS intent FROM cl)"""

_N = rf"(\d+|{_NUM}|twenty[- ]four)"


def _num(pattern: str) -> str:
    got = f"regexp_extract(q, '{pattern}', 1)"
    words = " ".join(f"WHEN '{w}' THEN {i}" for i, w in enumerate(Q.NUMBERS, 1))
    return f"nullif(CASE {got} {words} WHEN 'twenty four' THEN 24 WHEN 'twenty-four' THEN 24 ELSE try_cast({got} AS DOUBLE) END, 0)"


HORIZON_SQL = rf"""hz AS (SELECT *, CAST(least(greatest(coalesce(
  CASE WHEN contains(q, 'next month') THEN 1 END, CASE WHEN regexp_matches(q, '\bnext\s+year\b') THEN 12 END,
  {_num(_N + r'[-\s]*(?:year|years|yr|yrs)\b')} * 12, {_num(_N + r'[-\s]*(?:month|months|mo|mos)\b')},
  {_num(r'\bnext\s+' + _N + r'\b')}, 6), 1), 60) AS BIGINT) AS horizon FROM it)"""

FLAGS_SQL = f"""fl AS (SELECT *, intent = 'forecast' AND {_any([*Q.EACH_PRODUCT, *Q.EACH_CATEGORY, 'categories'])} AS groupwise_forecast,
  {_any(Q.EACH_MONTH)} AND {_any(['category', 'categories'])} AND {_any(Q.SALES_WORDS)} AS month_category,
  {_any(Q.EACH_CATEGORY)} AS category_breakdown,
  {_any(Q.EACH_REGION)} AND {_any([*Q.SALES_WORDS, 'performance', 'breakdown'])} AS region_breakdown,
  CASE WHEN horizon < 12 THEN 'none' WHEN horizon < 24 THEN 'planning_note' WHEN horizon < 36 THEN 'two_year' ELSE 'beyond_three_years' END AS caution
  FROM hz)"""

MENTION_SQL = """dv AS (SELECT 'Category' AS dim, c_mktsegment AS value, 0 AS place FROM customer GROUP BY ALL
  UNION ALL SELECT 'Region', r_name, 1 FROM region UNION ALL SELECT 'Nation', n_name, 2 FROM nation),
sv AS (SELECT DISTINCT dim, value, place FROM dv WHERE value IN (SELECT Category FROM sales UNION SELECT Region FROM sales UNION SELECT Nation FROM sales)),
bq AS (SELECT *, '|' || regexp_replace(q, '([^\\pL\\pN_])', '|\\1|', 'g') || '|' AS pieces FROM fl),
bv AS (SELECT *, '|' || regexp_replace(lower(value), '([^\\pL\\pN_])', '|\\1|', 'g') || '|' AS run FROM sv),
mn AS (SELECT conv_id, turn, dim, value FROM bq, bv WHERE contains(pieces, run)
  QUALIFY row_number() OVER (PARTITION BY conv_id, turn ORDER BY
    CASE WHEN contains(q, 'category') AND dim = 'Category' THEN -1
      WHEN NOT contains(q, 'category') AND contains(q, 'region') AND dim = 'Region' THEN -1 ELSE place END, length(value) DESC, value) = 1)"""

_UPTO_FLAGS = f"WITH {ASK_SQL}, {INTENT_SQL}, {HORIZON_SQL}, {FLAGS_SQL}"
_UPTO_MENTIONS = f"WITH {SALES_SQL}, {ASK_SQL}, {INTENT_SQL}, {HORIZON_SQL}, {FLAGS_SQL}, {MENTION_SQL}"


@query("intent", f"WITH {ASK_SQL}, {INTENT_SQL} SELECT conv_id, turn, question, intent FROM it")
def intent(spark, d):
    return Q.classify(V.questions(spark, d), parts=["intent"]).select(*IDS, "question", "intent")


@query("horizon", f"{_UPTO_FLAGS} SELECT conv_id, turn, horizon FROM fl")
def horizon(spark, d):
    return Q.classify(V.questions(spark, d), parts=["horizon"]).select(*IDS, "horizon")


@query("horizon_caution", f"{_UPTO_FLAGS} SELECT horizon, caution, count(*) AS n FROM fl GROUP BY ALL")
def horizon_caution(spark, d):
    return Q.classify(V.questions(spark, d), parts=["caution"]).groupBy("horizon", "caution").agg(F.count(F.lit(1)).alias("n"))


@query("question_flags", f"""{_UPTO_FLAGS}
SELECT conv_id, turn, groupwise_forecast, month_category, category_breakdown, region_breakdown FROM fl""")
def question_flags(spark, d):
    return Q.classify(V.questions(spark, d), parts=["flags"]).select(*IDS, *Q.flags("q"))


@query("dimension_mention", f"""{_UPTO_MENTIONS}
SELECT conv_id, turn, question, dim, value FROM ask LEFT JOIN mn USING (conv_id, turn)""")
def dimension_mention(spark, d):
    values = Q.dimension_values(V.sales(spark, d), ["Category", "Region", "Nation"])
    return Q.mentions(V.questions(spark, d), values, IDS)


ROUTE_SQL = f"""{_UPTO_MENTIONS},
rt AS (SELECT fl.*, dim, value, CASE WHEN intent IN ('data_info', 'model_info', 'recommendations', 'project_info') THEN intent
  WHEN intent = 'forecast' AND dim IS NOT NULL AND NOT groupwise_forecast THEN 'forecast_value'
  WHEN intent = 'forecast' AND groupwise_forecast THEN 'forecast_groups' WHEN intent = 'forecast' THEN 'forecast'
  WHEN month_category THEN 'month_category' WHEN category_breakdown THEN 'category_breakdown' WHEN region_breakdown THEN 'region_breakdown'
  WHEN intent = 'comparison' AND (contains(q, 'last 3') OR contains(q, 'three')) THEN 'comparison_3'
  WHEN intent = 'fallback' THEN 'general' ELSE intent END AS route
  FROM fl LEFT JOIN mn USING (conv_id, turn)),
ro AS (SELECT conv_id, turn, intent, horizon, route,
  CASE route WHEN 'forecast_value' THEN dim WHEN 'forecast_groups' THEN CASE WHEN contains(q, 'category') THEN 'Category'
    WHEN contains(q, 'region') THEN 'Region' ELSE 'Category' END END AS scope_dim,
  CASE WHEN route = 'forecast_value' THEN value END AS scope_value FROM rt)"""


def _routed(spark, d):
    values = Q.dimension_values(V.sales(spark, d), ["Category", "Region", "Nation"])
    return Q.route(V.questions(spark, d), values, IDS)


@query("question_routes", f"{ROUTE_SQL} SELECT * FROM ro")
def question_routes(spark, d):
    return _routed(spark, d).select(*IDS, "intent", "horizon", "route", "scope_dim", "scope_value")


def _fact_lines() -> str:
    mon = lambda c: f"strftime({c}, '%Y-%m')"
    shared = lambda r: [
        (r, "NULL", "rows", '"rows"'), (r, "NULL", "total", "total"), (r, mon("best_month"), "best_month", "best_sales"),
        (r, mon("worst_month"), "worst_month", "worst_sales"), (r, mon("latest_month"), "latest_month", "latest_sales")]
    lines = [
        *shared("summary"), ("summary", "NULL", "row_avg", "row_avg"), *shared("general"),
        ("general", "top_Category", "top_Category", "top_Category_share"), ("general", "top_Region", "top_Region", "top_Region_share"),
        ("trend", "NULL", "first3", "first3"), ("trend", "NULL", "last3", "last3"), ("trend", "NULL", "growth_3", "growth_3"),
        ("comparison", mon("latest_month"), "latest", "latest_sales"), ("comparison", mon("previous_month"), "previous", "previous_sales"),
        ("comparison", "NULL", "mom", "mom"), ("comparison_3", "NULL", "last3", "last3"), ("comparison_3", "NULL", "prev3", "prev3"),
        ("comparison_3", "NULL", "momentum", "momentum"), ("best_month", mon("best_month"), "sales", "best_sales"),
        ("weakest_month", mon("worst_month"), "sales", "worst_sales"), ("scenario", "NULL", "total", "total"),
        ("scenario", "NULL", "uplift_total", "total * 1.2::DOUBLE"), ("scenario", "NULL", "month_avg", "month_avg"),
        ("scenario", "NULL", "uplift_month_avg", "month_avg * 1.2::DOUBLE"),
        *[(f"{m}_{d.lower()}", f"{w}_{d}", k, f"{w}_{d}_{k}") for d in ("Category", "Region")
          for m, w in (("best", "top"), ("weakest", "weak")) for k in ("sales", "share")],
        *[(f"{m}_product", f"{w}_Category", k, f"{w}_Category_{k}")
          for m, w in (("best", "top"), ("weakest", "weak")) for k in ("sales", "share")],
        ("recommendations", "top_Category", "prioritize_category", "top_Category_share"),
        ("recommendations", "weak_Category", "review_category", "weak_Category_share"),
        ("recommendations", "top_Region", "benchmark_region", "top_Region_share"),
        ("recommendations", mon("best_month"), "study_best_month", "best_sales"),
        ("recommendations", mon("worst_month"), "study_worst_month", "worst_sales"),
        ("recommendations", "NULL", "plan_with_forecast", "NULL"),
    ]
    return " UNION ALL ".join(
        f"SELECT '{r}' AS route, CAST({s} AS VARCHAR) AS subject, '{m}' AS metric, CAST({v} AS DOUBLE) AS value FROM facts"
        for r, s, m, v in lines)


_HOLD = all_models_sql(["one"], holdout_outer(["one"])).replace(
    SALES_SQL, SALES_SQL.replace("n_name AS Nation", "n_name AS Nation, 1 AS one")) + "," + metrics_sql(["one"])
FACT_SQL = _HOLD + ", " + facts_sql([], ["Category", "Region"]).split(SALES_SQL + ",", 1)[1].replace(
    "monthly AS", "monthly0 AS").replace("FROM monthly)", "FROM monthly0)").replace(",\nm AS (", ",\nm0 AS (").replace(
    "FROM m )", "FROM m0)") + f""",
w6 AS (SELECT d, abs(s - avg(s) OVER x) / nullif(stddev_samp(s) OVER x, 0) AS z, count(*) OVER x AS c FROM m0
  WINDOW x AS (ORDER BY d ROWS BETWEEN 5 PRECEDING AND CURRENT ROW)),
fx AS ({_fact_lines()}
UNION ALL SELECT 'recommendations', NULL, CASE WHEN growth_3 > 5 THEN 'protect_growth' WHEN growth_3 < -5 THEN 'investigate_decline' ELSE 'create_growth' END, growth_3 FROM facts
UNION ALL SELECT 'category_breakdown', v, 'share', s / sum(s) OVER () * 100 FROM t_Category
UNION ALL SELECT 'region_breakdown', v, 'share', s / sum(s) OVER () * 100 FROM t_Region
UNION ALL SELECT 'month_category', strftime("Date", '%Y-%m') || ' ' || Category, 'sales', sum(Sales) FROM sales GROUP BY ALL
UNION ALL SELECT 'anomaly', NULL, 'count', count(*) FROM w6 WHERE c >= 3 AND z > 2.5
UNION ALL SELECT 'model_info', model_key, 'MAPE', MAPE FROM rk
UNION ALL SELECT 'data_info', unnest(['o_orderkey', 'Date', 'Sales', 'Category', 'Region', 'Nation']), 'missing', 0)"""


# Monthly averages of cents, raised by a fifth, can lie exactly between two 4-digit values.
_ROUNDED = "CASE WHEN metric LIKE '%month_avg' THEN round(value, 5) ELSE round(value, 4) END"


def _digits(df):
    return df.withColumn("value", F.when(F.col("metric").endswith("month_avg"), F.round("value", 5)).otherwise(F.round("value", 4)))


@query("answer_facts", FACT_SQL + f" SELECT route, subject, metric, {_ROUNDED} AS value FROM fx")
def answer_facts(spark, d):
    return _digits(A.answer_facts(V.sales(spark, d)))


_SCOPE = ["scope_dim", "scope_value"]
_SCOPED_SALES = SALES_SQL.replace("sales AS (", "plain AS (") + """,
sales AS (SELECT '' AS scope_dim, '' AS scope_value, "Date", Sales FROM plain
  UNION ALL SELECT 'Category', Category, "Date", Sales FROM plain UNION ALL SELECT 'Region', Region, "Date", Sales FROM plain
  UNION ALL SELECT 'Nation', Nation, "Date", Sales FROM plain)"""
_PATHS = all_models_sql(_SCOPE, champion_outer(_SCOPE) + """ UNION ALL SELECT scope_dim, scope_value, n AS o, horizon AS h
  FROM size, (SELECT DISTINCT horizon FROM asked WHERE starts_with(route, 'forecast'))""").replace(SALES_SQL, _SCOPED_SALES) + "," + metrics_sql(_SCOPE)
_FOUND = "route, scope_dim, scope_value, horizon, questions, subject, coalesce(metric, 'no_result') AS metric, " + _ROUNDED + " AS value"


@query("question_facts", f"""
WITH asked AS MATERIALIZED ({ROUTE_SQL} SELECT route, coalesce(scope_dim, '') AS scope_dim, CASE WHEN route <> 'forecast' THEN lower(scope_value) END AS scope_value,
  CASE WHEN starts_with(route, 'forecast') THEN horizon ELSE 0 END AS horizon FROM ro),
facts AS MATERIALIZED ({FACT_SQL} SELECT route, subject, metric, value FROM fx),
paths AS MATERIALIZED ({_PATHS}
  SELECT s.scope_dim, lower(s.scope_value) AS scope_value, af.h AS horizon, af.model_key AS metric, f AS value,
    strftime(CAST(last_d + to_months(CAST(step AS INTEGER)) AS DATE), '%Y-%m') || CASE s.scope_value WHEN '' THEN '' ELSE ' ' || s.scope_value END AS subject
  FROM size s LEFT JOIN (SELECT * FROM rk WHERE rank = 1) r ON r.scope_dim = s.scope_dim AND r.scope_value = s.scope_value
    JOIN af ON af.scope_dim = s.scope_dim AND af.scope_value = s.scope_value AND af.o = s.n AND af.model_key = coalesce(r.model_key, 'holts')
  WHERE s.n >= 3),
kinds AS (SELECT *, count(*) AS questions FROM asked GROUP BY ALL)
SELECT {_FOUND} FROM kinds LEFT JOIN facts USING (route) WHERE NOT starts_with(route, 'forecast')
UNION ALL
SELECT k.{_FOUND.replace('scope_', 'k.scope_').replace('horizon,', 'k.horizon,')} FROM kinds k LEFT JOIN paths p ON p.scope_dim = k.scope_dim AND p.horizon = k.horizon
  AND (k.route = 'forecast_groups' OR p.scope_value = coalesce(k.scope_value, ''))
WHERE starts_with(route, 'forecast')""")
def question_facts(spark, d):
    """The results that all routed questions ask for, forecasts included, each once."""
    rows = V.sales(spark, d)
    cube = roll_up(rows, (), SCOPES)
    asked = settle(A.asks(Q.route(V.questions(spark, d), cube.values(), IDS), IDS), "asked")
    paths = settle(A.scoped_forecasts(cube, asked, SCOPES), "paths")
    return _digits(A.answers(asked, A.answer_facts(rows, cube=cube), paths))


@query("question_asks", f"""{ROUTE_SQL} SELECT conv_id, turn, route, coalesce(scope_dim, '') AS scope_dim,
  CASE WHEN route <> 'forecast' THEN lower(scope_value) END AS scope_value,
  CASE WHEN starts_with(route, 'forecast') THEN horizon ELSE 0 END AS horizon FROM ro""")
def question_asks(spark, d):
    """Which result answers each question."""
    return A.asks(_routed(spark, d), IDS)


@query("inr_format", """
WITH c AS (SELECT o_custkey, sum(o_totalprice) AS s, sum(o_totalprice) / count(*) / 50 AS a FROM orders GROUP BY 1)
SELECT o_custkey, CASE WHEN s >= 1e7 THEN printf('Rs %.2fCr', s / 1e7) WHEN s >= 1e5 THEN printf('Rs %.2fL', s / 1e5)
  WHEN s >= 1e3 THEN printf('Rs %.1fK', s / 1e3) ELSE printf('Rs %.0f', s) END AS total_text,
  CASE WHEN a >= 1e3 THEN printf('Rs %.1fK', a / 1e3) ELSE printf('Rs %.0f', a) END AS small_text FROM c""")
def inr_format(spark, d):
    sums = V.table(spark, d, "orders").groupBy("o_custkey").agg(
        F.sum("o_totalprice").alias("s"), (F.sum("o_totalprice") / F.count(F.lit(1)) / 50).alias("a"))
    return sums.select("o_custkey", inr_text(F.col("s")).alias("total_text"), inr_text(F.col("a")).alias("small_text"))
