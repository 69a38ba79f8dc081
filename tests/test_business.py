"""Facts, rules, scenarios, questions, sources and learners."""

import math
import re
from decimal import ROUND_HALF_UP, Decimal

import pytest
from pyspark.sql import functions as F

from salesframe.operators import ml as M
from salesframe.operators import questions as Q
from salesframe.operators import rollup as R
from salesframe.operators import rules as U
from salesframe.operators import scenario as S
from salesframe.plans.source_queries import demo_panel_noise
from salesframe.session import scratch_path
from salesframe.sources import champions as H
from salesframe.sources import tables as T


def test_facts_of_short_series(make_monthly):
    rows = make_monthly({"a": [10], "b": [10, 20], "c": [10, 20, 30, 40], "d": [1, 2, 3, 4, 5, 6, 0]})
    f = {r.k: r for r in R.business_facts(rows, ["k"]).collect()}
    assert f["a"].growth_3 == 0 and f["a"].mom is None and f["a"].growth_half is None
    assert f["b"].mom == 100 and f["b"].momentum is None
    assert f["c"].momentum == pytest.approx((30 - 10) / 10 * 100) and f["c"].growth_half is None
    assert f["d"].growth_half == pytest.approx((15 / 4 - 2) / 2 * 100)
    assert (f["d"].best_sales, str(f["d"].worst_month)) == (6, "2022-07-01")


def test_best_month_takes_the_earliest_of_ties(make_monthly):
    f = R.business_facts(make_monthly({"a": [5, 9, 9, 5]}), ["k"]).first()
    assert (str(f.best_month), str(f.worst_month)) == ("2022-02-01", "2022-01-01")


def test_missing_months(make_monthly):
    rows = make_monthly({"a": [1, 2, 3, 4]}).filter("Date <> DATE'2022-02-01'")
    assert [str(r.Date) for r in R.missing_periods(rows, ["k"]).collect()] == ["2022-02-01"]


def test_rules(make_monthly):
    rows = make_monthly({"up": [10, 20, 30, 40, 50, 60], "down": [60, 50, 40, 30, 20, 5], "one": [7]})
    seen = {}
    for r in U.insights(rows, ["k"]).collect():
        seen.setdefault(r.k, []).append(r.code)
    assert seen["up"][0] == "strong_upward" and seen["down"][0] == "declining" and seen["one"] == ["not_enough_data"]
    alerts = {(r.k, r.code): r.level for r in U.alerts(rows, ["k"]).collect()}
    assert alerts == {("down", "revenue_drop"): "danger", ("down", "three_falling_months"): "warning"}
    calm = make_monthly({"calm": [100, 101, 100, 101, 100, 101, 100]})
    assert [r.code for r in U.recommendations(calm, ["k"]).collect()] == ["keep_monitoring"]


def test_root_cause_counts_absent_cells_as_zero(spark):
    rows = [("2024-01-10", 10.0, "A")] * 20 + [("2024-01-11", 10.0, "B")] * 10 + [("2024-02-10", 10.0, "A")] * 19
    df = spark.createDataFrame(rows, "d string, Sales double, Region string").selectExpr("CAST(d AS DATE) AS Date", "Sales", "Region")
    first = U.root_cause(df).orderBy("seq").first()
    assert (first.code, first.level, first.subject, first.metric) == ("region_driver", "decline", "B", -100.0)
    assert U.root_cause(df.limit(5)).first().code == "not_enough_data"


def plain_levers(f, g, s, d, m, c, ch):
    n, out = len(f), []
    for i, v in enumerate(f):
        v *= (1 + g / 100) ** ((i + 1) / 12)
        v *= 1 + s / 100 * (math.sin(2 * math.pi * i / (n - 1)) if n > 1 else 0)
        v *= 1 + d / 100
        v *= 1 + (m / 100 * min((i + 1) / 3, 1) if m > 0 else 0)
        v *= max(1 - c / 100 * i / n, 0.5) if c > 0 else 1
        out.append(max(v * (1 + ch / 100), 0))
    return out


@pytest.mark.parametrize("n", [1, 7])
def test_levers(spark, n):
    base = [100.0 + 10 * i for i in range(n)]
    df = spark.createDataFrame([("a", i + 1, v) for i, v in enumerate(base)], "k string, step long, Forecast double").withColumn(
        "Date", F.add_months(F.lit("2024-01-01").cast("date"), F.col("step").cast("int")))
    table = {**S.PRESETS, "wild": (-30, 20, -150, -5, 90, 4)}
    got = {}
    for r in S.apply_scenarios(df, ["k"], table).orderBy("step").collect():
        got.setdefault(r.scenario, []).append(r.Value)
    for name, levers in table.items():
        assert got[name] == pytest.approx(plain_levers(base, *levers)), name
    assert {r.status for r in S.break_even(S.apply_scenarios(df, ["k"], {"zero": (0,) * 6}), ["k"]).collect()} == {"already_above"}


@pytest.mark.parametrize("text,want", [
    ("show trend", "trend"), ("detect anomaly", "anomaly"), ("forecast next month", "forecast"),
    ("Forecast Electronics category for next 2 years", "forecast"), ("Which model is best and what is MAPE?", "model_info"),
    ("What columns and missing values are in my data?", "data_info"),
    ("What does this project do and what modules are included?", "project_info"),
    ("help me understand what is going on", "fallback"),
    ("Give me business recommendations based on this sales data", "recommendations"),
    ("next five years", "forecast"), ("worst region", "weakest_region"), ("overall", "summary"),
])
def test_intents(spark, text, want):
    assert Q.classify(spark.createDataFrame([(text,)], "question string")).first().intent == want


@pytest.mark.parametrize("text,want", [
    ("forecast next month", 1), ("next year", 12), ("for next 2 years", 24), ("9 months ahead", 9), ("twenty-four months", 24),
    ("next 4", 4), ("nothing said", 6), ("900 months", 60), ("0 months", 6), ("99999999999999999999 years", 60),
])
def test_horizons(spark, text, want):
    assert Q.classify(spark.createDataFrame([(text,)], "question string")).first().horizon == want


def test_mentions_equal_a_search_of_every_value(spark):
    values = [("Category", "Home & Garden"), ("Category", "Garden"), ("Category", "C#"), ("Region", "North"),
              ("Region", "Nord-Est"), ("Brand", "é"), ("Brand", "north"), ("Brand", "#1")]
    texts = ["Forecast Home & Garden now", "garden, please", "is c# ok?", "c#x", "north region", "northern", "nord-est!",
             "café é.", "the category of North", "no1 #1", "no#1", "(#1)", "", "home & gardens", "NORTH garden"]
    dims = spark.createDataFrame(values, "Dim string, v string").selectExpr(
        "CASE WHEN Dim = 'Category' THEN v END AS Category", "CASE WHEN Dim = 'Region' THEN v END AS Region",
        "CASE WHEN Dim = 'Brand' THEN v END AS Brand")
    asked = spark.createDataFrame(list(enumerate(texts)), "i int, question string")
    got = {r.i: (r.dim, r.value) for r in Q.mentions(asked, Q.dimension_values(dims, ["Category", "Region", "Brand"]), ["i"]).collect()}
    for i, text in enumerate(texts):
        q, order = text.lower(), ["Category", "Region", "Brand"]
        if "region" in q and "category" not in q:
            order = ["Region", "Category", "Brand"]
        want = (None, None)
        for dim in order:
            hits = sorted((-len(v), v) for d, v in values if d == dim and re.search(rf"(?<!\w){re.escape(v.lower())}(?!\w)", q))
            if hits:
                want = (dim, hits[0][1])
                break
        assert got[i] == want, text


def test_read_error_is_returned(spark):
    table, error = T.read_table(spark, "/tmp/salesframe-no-such-file.csv")
    assert table is None and "PATH_NOT_FOUND" in error


def test_champion_table_round_trip(spark, make_monthly):
    rows = make_monthly({"a": [100 + 5 * i for i in range(20)], "b": [50, 60, 40] * 8})
    path = scratch_path(spark, "test-champions")
    H.save_champions(H.train_all(rows, ["k"]), path)
    saved = H.load_champions(spark, path)
    assert saved.filter("size(params) > 0 OR model_key = 'linear_trend'").count() == 2
    scored = H.score_champions(saved, rows, 5, ["k"])
    assert scored.count() == 10
    keys = {r.k: r.model_key for r in saved.collect()}
    assert all(keys[r.k] == r.model_key for r in scored.collect())


def test_demo_panel_is_the_same_each_time(spark):
    series = spark.range(3).withColumnRenamed("id", "s")
    one = T.demo_panel(series, ["s"], "2024-01-01", "2024-02-29")
    two = T.demo_panel(series.repartition(7), ["s"], "2024-01-01", "2024-02-29")
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, two.collect()))
    assert one.count() == 180 and one.filter("Sales < 0 OR Returns NOT BETWEEN 0 AND 29").count() == 0


@pytest.mark.parametrize("segments", [True, False])
def test_demo_panel_is_dealt_to_tasks(spark, segments):
    """Keys of few bytes become many costly days: these must not meet in one task."""
    series = spark.range(128).selectExpr("id % 64 AS s")
    panel = T.demo_panel(series, ["s"], "2024-01-01", "2024-01-31", segments=segments)
    sizes = [r["count"] for r in panel.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == 64 * 31 and max(sizes) <= sum(sizes) / 4


@pytest.mark.parametrize("count", [20, 80])
def test_demo_panel_totals_are_exact(spark, tmp_path, count):
    """Totals halfway between two 1-digit values go up, whatever the order in which tasks sum them."""
    series = spark.range(count).withColumnRenamed("id", "s_suppkey")
    series.write.parquet(f"{tmp_path}/supplier.parquet")
    exact = T.demo_panel(series, ["s_suppkey"]).groupBy("Category", "Region").agg(
        F.sum(F.col("Sales").cast("decimal(20,2)")).alias("total")).collect()
    assert any(int(r.total * 100) % 10 == 5 for r in exact)
    want = {(r.Category, r.Region): float(r.total.quantize(Decimal("0.1"), ROUND_HALF_UP)) for r in exact}
    assert {(r.Category, r.Region): r.Sales for r in demo_panel_noise(spark, str(tmp_path)).collect()} == want


def test_forest_forecast(make_monthly):
    rows = make_monthly({"a": [100, 112, 128, 145, 168, 190, 215, 238, 260, 284, 306, 330, 124, 140, 160, 182, 210, 238,
                               270, 300, 330, 362, 395, 430], "short": [1, 2, 3]})
    out = M.random_forest_forecast(rows, 14, ["k"], trees=20).orderBy("step").collect()
    assert {r.k for r in out} == {"a"} and [r.step for r in out] == list(range(1, 15))
    assert len({round(r.Forecast, 2) for r in out}) > 1
    assert all(0 <= r.Lower <= r.Forecast <= r.Upper for r in out)


def test_forest_importance(make_monthly):
    rows = make_monthly({"a": [100 + 7 * i for i in range(20)]})
    table = M.forest_importance(rows, ["k"], trees=10)
    assert table.count() == 8 and table.agg(F.sum("ImportancePct")).first()[0] == pytest.approx(100, abs=0.5)
    assert M.forest_importance(make_monthly({"a": [1, 2, 3, 4]}), ["k"]).count() == 0
