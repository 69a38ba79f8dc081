"""Row-level operators that must hold under a hot key: quantiles, order, cleaning, anomalies."""

import datetime as dt
import random
import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from salesframe.functions.quantiles import exact_quantiles, most_common, sketch_size, sketched_quantiles
from salesframe.operators import anomaly as N
from salesframe.operators import clean as C
from salesframe.operators import features as W
from salesframe.operators import ml as M
from salesframe.operators import ordered
from salesframe.operators import profile as P
from salesframe.operators import questions as Q
from salesframe.operators.cube import roll_up
from salesframe.operators.ordered import over_rows, with_position
from salesframe.operators.rollup import (
    business_facts, dimension_totals, main_driver, month_by_dimension, monthly_totals, recent_days,
)
from salesframe.session import drop_written, passing_scratch, scratch_tables, settle, write_table
from salesframe.sources import champions as H


@pytest.fixture(scope="module")
def skewed(spark):
    r = random.Random(7)
    rows = [("hot" if r.random() < 0.7 else f"k{r.randrange(5)}", i, f"2024-01-{1 + r.randrange(20):02d}",
             round(r.lognormvariate(5, 1), 2) if r.random() < 0.9 else 100.0) for i in range(4000)]
    pdf = pd.DataFrame(rows, columns=["k", "id", "d", "Sales"])
    df = spark.createDataFrame(pdf).selectExpr("k", "id", "CAST(d AS DATE) AS Date", "Sales")
    return pdf, df


def test_exact_quantiles_by_key(skewed):
    pdf, df = skewed
    got = exact_quantiles(df, "Sales", {"a": 0.25, "b": 0.5, "c": 0.99}, ["k"], "n")
    got = {r.k: r for r in got.collect()}
    for key, part in pdf.groupby("k"):
        want = np.percentile(part.Sales, [25, 50, 99])
        assert (got[key].a, got[key].b, got[key].c) == pytest.approx(tuple(want))
        assert got[key].n == len(part)


def test_exact_quantiles_without_keys(skewed):
    pdf, df = skewed
    got = exact_quantiles(df, "Sales", {"m": 0.5}).first()
    assert got.m == pytest.approx(pdf.Sales.median())


def test_most_common_takes_the_smallest_of_ties(spark):
    df = spark.createDataFrame([("b",), ("a",), ("b",), ("a",), ("c",), (None,), (None,), (None,)], "v string")
    assert most_common(df, "v").first().v == "a"


@pytest.mark.parametrize("keys", [[], ["k"]])
def test_positions_are_exact(skewed, keys):
    pdf, df = skewed
    got = with_position(df, ["Date", "id"], keys).toPandas().sort_values(keys + ["_pos"])
    ordered = pdf.sort_values(keys + ["d", "id"])
    assert got["id"].tolist() == ordered["id"].tolist()
    want = ordered.groupby(keys).cumcount() + 1 if keys else pd.Series(range(1, len(pdf) + 1))
    assert got["_pos"].tolist() == want.tolist()


@pytest.mark.parametrize("keys", [[], ["k"]])
def test_windows_cross_block_edges(skewed, keys):
    pdf, df = skewed
    make = lambda frame, ordered: {
        "m": F.avg("Sales").over(frame(-6, 0)), "l": F.lag("Sales", 2).over(ordered)}
    got = over_rows(df, ["Date", "id"], 6, make, keys, block_rows=50).toPandas().set_index("id").sort_index()
    ordered = pdf.sort_values(["d", "id"])
    series = ordered.groupby(keys)["Sales"] if keys else None
    roll = series.transform(lambda s: s.rolling(7, min_periods=1).mean()) if keys else ordered.Sales.rolling(7, min_periods=1).mean()
    lag = series.shift(2) if keys else ordered.Sales.shift(2)
    want = ordered.assign(m=roll, l=lag).set_index("id").sort_index()
    assert len(got) == len(pdf)
    np.testing.assert_allclose(got.m, want.m)
    np.testing.assert_allclose(got.l, want.l)


def test_amounts(spark):
    df = spark.createDataFrame([("₹1,000",), ("₹2.5L",), ("₹1.2Cr",), (" 5K ",), ("-₹7",)], "Sales string")
    got = [r.Sales for r in C.parse_amounts(df).collect()]
    assert got == [1000.0, 250000.0, 12000000.0, 5000.0, -7.0]


def test_amount_column_needs_sixty_percent_of_all_rows(spark):
    df = spark.createDataFrame([("5", "1"), ("6", None), (None, None), ("x", "2"), ("7", "3")], "a string, b string")
    kinds = dict(C.parse_amounts(df).dtypes)
    assert kinds == {"a": "double", "b": "double"}
    worse = df.withColumn("b", F.when(F.col("b") > "1", F.col("b")))
    assert dict(C.parse_amounts(worse).dtypes)["b"] == "string"


def test_clean_keeps_business_columns(spark):
    df = spark.createDataFrame(
        [("2024-01-01", "₹1,000", "Electronics", "North"), ("2024-01-02", "₹1,200", "Apparel", "South"),
         ("2024-01-03", "₹900", "Electronics", "North"), ("2024-01-04", "₹1,100", "Beauty", "West")],
        "`Order Date` string, Revenue string, Category string, Region string")
    out = C.clean_sales(df)
    assert {"Date", "Sales", "Category", "Region", "lag_1", "rolling_mean_7", "weekday"} <= set(out.columns)
    assert "Category_Electronics" not in out.columns
    assert out.agg(F.sum("Sales")).first()[0] == 4200
    encoded = C.clean_sales(df, prepare_model_features=True)
    assert "Category_Electronics" in encoded.columns and "Category" not in encoded.columns
    assert encoded.agg(F.sum("Sales")).first()[0] == 4200


def test_clean_fills_and_clips(spark):
    df = spark.createDataFrame(
        [("2024-01-01", 10.0, "b", 1), ("2024-01-02", -5.0, None, None), ("2024-01-03", 7.0, "b", 4),
         ("2024-01-03", 7.0, "b", 4), ("2024-01-04", None, "a", 2), (None, 3.0, "a", 2)],
        "Date string, Sales double, Category string, Units int").withColumn("Date", F.to_date("Date"))
    out = {str(r.Date): r for r in C.clean_upload(df, "Date", "Sales").collect()}
    assert len(out) == 3
    assert out["2024-01-02"].Sales == 0 and out["2024-01-02"].Category == "b" and out["2024-01-02"].Units == 2.5
    steps = {r.code: r.n for r in C.cleaning_steps(df, "Date", "Sales").collect()}
    assert steps == {"duplicates_removed": 1, "rows_dropped": 2, "numeric_filled": 1, "text_filled": 1,
                     "outliers": 0, "negatives_clipped": 1, "rows_left": 3}


def test_text_repair(spark):
    from salesframe.functions.text import repair_text
    texts = ["CafÃ©", "donâ€™t", "  a \t b ", "“x” – y…", "ﬁne １２", "déjà vu", None, ""]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [r.t for r in repair_text(df).orderBy("i").collect()]
    assert got == ["Café", "don't", "a b", "\"x\" - y...", "fine 12", "déjà vu", None, ""]


def test_column_detection(spark):
    df = spark.createDataFrame([(1, "x", 2.0)], "id int, `Order Date` string, Revenue double")
    assert C.date_column(df) == "Order Date" and C.target_column(df) == "Revenue"


def test_duplicate_count_treats_nulls_as_equal(spark):
    df = spark.createDataFrame([(1, None), (1, None), (1, "a"), (1, "a"), (1, "a")], "a int, b string")
    assert P.schema_summary(df).first().duplicates == 3


@pytest.mark.parametrize("ties", ["id", "name"])
def test_look_back_beyond_a_block_and_null_dates(spark, ties):
    rows = [(i, f"n{i:03d}", None if i % 10 == 9 else f"2024-01-{1 + i // 20:02d}", None if i % 3 == 0 else "k", float(i))
            for i in range(100)]
    df = spark.createDataFrame(rows, "id int, name string, d string, k string, Sales double").selectExpr(
        "*", "CAST(d AS DATE) AS Date")
    make = lambda frame, _: {"s": F.sum("Sales").over(frame(-12, 0))}
    for keys in ([], ["k"]):
        got = {r.id: r.s for r in over_rows(df, ["Date", ties], 12, make, keys, block_rows=5).collect()}
        assert len(got) == 100
        for key in (None, "k") if keys else ("all",):
            own = sorted((r for r in rows if key == "all" or r[3] == key), key=lambda r: (r[2] is None, r[2] or "", r[0]))
            for at, r in enumerate(own):
                assert got[r[0]] == sum(x[4] for x in own[max(0, at - 12):at + 1])


def test_nan_is_missing(spark):
    df = spark.createDataFrame([(1, 10.0, "a"), (2, float("nan"), "a"), (3, 30.0, None)], "i int, Sales double, t string").selectExpr(
        "*", "DATE'2024-01-05' AS Date")
    assert sorted(r.Sales for r in C.fill_median(df, ["Sales"]).collect()) == [10.0, 20.0, 30.0]
    assert monthly_totals(df).first().Sales == 40.0
    seen = {r.column: r.missing for r in P.schema_summary(df).collect()}
    assert seen == {"i": 0, "Sales": 1, "t": 1, "Date": 0}
    assert N.zscore_outliers(df, threshold=0.5).count() == 2


def test_one_hot_vectors_number_any_level(spark):
    df = spark.createDataFrame([(1, "b"), (2, "a"), (3, None), (4, "c")], "i int, t string")
    got = {r.i: (r.t_levels.size, list(r.t_levels.indices), list(r.t_levels["values"])) for r in W.one_hot_vectors(df).collect()}
    assert got == {1: (2, [0], [1.0]), 2: (2, [], []), 3: (2, [], []), 4: (2, [1], [1.0])}


def test_schema_samples_are_whole(spark):
    df = spark.createDataFrame([("x" * 80,), ("x" * 80,)], "t string")
    row = P.schema_summary(df).first()
    assert row.sample == "x" * 80 and row.duplicates == 1


def test_anomaly_methods(spark):
    values = [100.0 + i % 7 for i in range(60)]
    values[30] = 900.0
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, Sales double").selectExpr(
        "DATE'2024-01-01' + i AS Date", "Sales")
    for method in ("zscore", "iqr"):
        out = N.detect_anomalies(df, method).collect()
        assert [str(r.Date) for r in out] == ["2024-01-31"] and out[0].severity == "high"
    rolling = lambda **kw: [str(r.Date) for r in N.detect_anomalies(df, "rolling_deviation", **kw).collect()]
    assert rolling() == []
    assert "2024-01-31" in rolling(include_current=False)
    assert "2024-01-31" in rolling(threshold=2.0)
    with pytest.raises(ValueError):
        N.detect_anomalies(df, "guess")
    assert N.detect_anomalies(df.limit(2), "zscore", 0.1).count() == 0


def test_constant_values_have_no_outliers(spark):
    df = spark.createDataFrame([(5.0,)] * 10, "Sales double")
    assert N.detect_outliers(df).count() == 0 and N.detect_outliers(df, method="zscore").count() == 0


def test_min_max_leaves_constants(spark):
    df = spark.createDataFrame([(1.0, 3.0), (5.0, 3.0)], "a double, b double")
    assert sorted(tuple(r) for r in W.min_max(df).collect()) == [(0.0, 3.0), (1.0, 3.0)]


def test_one_day_spreads_over_ranges(spark):
    rows = [(dt.date(2024, 1, 1), i % 1500, float(i % 7)) for i in range(2000)] + [(dt.date(2024, 1, 1), 5, 1.0)] * 500
    df = spark.createDataFrame(rows, "Date date, id int, Sales double").repartition(5)
    placed = with_position(df, ["Date"])
    sizes = sorted(r["count"] for r in placed.groupBy(F.floor((F.col("_pos") - 1) / 2500)).count().collect())
    assert sizes == [2500]
    parts = ordered_parts(df)
    assert len(parts) == 4 and max(parts) <= 2 * sorted(parts)[2]
    make = lambda frame, ordered: {"m": F.sum("Sales").over(frame(-6, 0)), "l": F.lag("Sales", 2).over(ordered)}
    once = sorted(map(repr, over_rows(df, ["Date"], 6, make, block_rows=300).collect()))
    again = sorted(map(repr, over_rows(df.orderBy(F.rand(3)).repartition(3), ["Date"], 6, make, block_rows=77).collect()))
    assert once == again


def ordered_parts(df):
    """Rows of each range that positions are counted in."""
    seen = []
    original = ordered.settle

    def keep(frame, name="stage"):
        out = original(frame, name)
        seen.extend(r["count"] for r in out.groupBy("_part").count().collect())
        return out
    ordered.settle = keep
    try:
        with_position(df, ["Date"]).count()
    finally:
        ordered.settle = original
    return seen


def test_equal_rows_go_and_others_stay(spark):
    rows = [(i % 50, None if i % 3 else "a", float("nan") if i % 5 == 0 else i % 2 * 1.0, [i % 2, None]) for i in range(500)]
    rows += [(None, None, None, None)] * 40 + [(None, "a", 0.0, [None, 0]), (None, "a", 0.0, [0, None])]
    df = spark.createDataFrame(rows, "id int, t string, `a.v` double, l array<int>").repartition(6)
    want = sorted(map(repr, df.dropDuplicates().collect()))
    assert sorted(map(repr, C.drop_duplicates(df).collect())) == want
    assert C.drop_duplicates(df.where("false")).count() == 0
    assert C.drop_duplicates(spark.createDataFrame([(0.0, 1), (-0.0, 1)], "a double, b int")).count() == 1


def test_cube_gives_what_rows_give(spark):
    rng = random.Random(8)
    rows = [(dt.date(2023, 1 + i % 7, 1 + i % 28) if i % 11 else None, rng.choice(["n", "s", None]), rng.choice(["a", "b", None]),
             rng.choice(["x", "y"]), None if i % 13 == 0 else 1e6 + rng.random()) for i in range(600)]
    df = spark.createDataFrame(rows, "Date date, k string, Category string, Region string, Sales double").repartition(4)
    for keys in ([], ["k"]):
        cube = roll_up(df, keys, ["Category", "Region"])
        shown = lambda d: sorted(repr([round(v, 4) if isinstance(v, float) else v for v in r]) for r in d.select(sorted(set(d.columns) - {"_s", "_y"})).collect())
        assert shown(business_facts(cube, keys, ["Region", "Category"])) == shown(business_facts(df, keys, ["Region", "Category"]))
        for dim in ("Category", "Region"):
            assert shown(dimension_totals(cube.by(dim), [*keys, dim])) == shown(dimension_totals(df, [*keys, dim]))
            assert shown(main_driver(cube.by(dim), dim, keys)) == shown(main_driver(df, dim, keys))
        known = df.filter("k IS NOT NULL") if keys else df
        for r in cube.centre().collect():
            own = [x[4] for x in rows if x[4] is not None and (not keys or x[1] == r.k)]
            n = len([x for x in rows if not keys or x[1] == r.k])
            assert r._n == n and r._mean == pytest.approx(np.mean(own)) and r._std == pytest.approx(np.std(own, ddof=1), rel=1e-6)
        assert known.count() == cube.sizes().agg(F.sum("_rows")).first()[0]
    assert {(r.dim, r.value) for r in cube.values().collect()} == {("Category", "a"), ("Category", "b"), ("Region", "x"), ("Region", "y")}
    days = roll_up(df, (), (), "day")
    assert recent_days(days).first() == recent_days(df).first()
    count = N.iqr_outlier_count(df, "Sales", ["Region"])
    assert {r.Region: r.outliers for r in count.collect()} == {
        r.Region: r["count"] for r in N.iqr_outliers(df, "Sales", ["Region"]).groupBy("Region").count().collect()}


def test_ranks_of_many_values_in_a_month(spark):
    rows = [(dt.date(2024, 1 + i % 2, 3), f"v{i % 300:03d}", float(i % 40)) for i in range(1200)]
    got = month_by_dimension(spark.createDataFrame(rows, "Date date, Category string, Sales double"), "Category").toPandas()
    want = pd.DataFrame(rows, columns=["Date", "Category", "Sales"])
    want["Date"] = [d.replace(day=1) for d in want.Date]
    want = want.groupby(["Date", "Category"], as_index=False).Sales.sum().sort_values(["Date", "Sales", "Category"], ascending=[True, False, True])
    want["rank"] = want.groupby("Date").cumcount() + 1
    both = got.merge(want, on=["Date", "Category"])
    assert len(both) == len(want) == len(got) and (both.rank_x == both.rank_y).all()


def test_sketched_quantiles_stay_within_their_rank_error(spark):
    rng = random.Random(2)
    values = [0.0] * 4000 + [rng.lognormvariate(0, 3) for _ in range(6000)]
    df = spark.createDataFrame([(i % 2, v) for i, v in enumerate(values)] + [(0, None), (1, float("nan")), (2, None)], "k int, v double").repartition(7)
    for keys in ([], ["k"]):
        for r in sketched_quantiles(df, "v", {"a": 0.25, "m": 0.5, "z": 0.99}, 0.02, keys, "n").collect():
            own = sorted(v for i, v in enumerate(values) if not keys or i % 2 == r.k)
            if keys and r.k == 2:
                assert (r.a, r.m, r.z, r.n) == (None, None, None, 0)
                continue
            assert r.n == len(own)
            for q, found in ((0.25, r.a), (0.5, r.m), (0.99, r.z)):
                low, high = np.searchsorted(own, found, "left") / len(own), np.searchsorted(own, found, "right") / len(own)
                assert low - 0.02 <= q <= high + 0.02
    exact = {(r.k, r.v) for r in N.iqr_outliers(df, "v", ["k"]).collect()}
    near = {(r.k, r.v) for r in N.iqr_outliers(df, "v", ["k"], approx=0.005).collect()}
    assert len(exact ^ near) < 0.1 * len(exact)
    filled = C.fill_median(df.select("v"), approx=0.01).filter("v IS NULL").count()
    assert filled == 0 and sketch_size(0.0133) == 200


def test_one_hot_refuses_columns_of_many_levels(spark):
    df = spark.range(500).selectExpr("id", "CAST(id AS STRING) AS many", "IF(id % 2 = 0, 'a', 'b') AS few")
    with pytest.raises(ValueError, match="one_hot_vectors"):
        W.one_hot(df, max_levels=100)
    assert W.one_hot(df, ["few"], max_levels=100).columns == ["id", "many", "few_b"]


def test_mentions_of_values_that_share_words(spark):
    values = [("Product", f"the common item {i}", 2) for i in range(400)] + [
        ("Category", "item", 0), ("Region", "north east", 1), ("Region", "east", 1), ("Product", "c++", 2), ("Product", "the", 2)]
    texts = ["show the common item 37 please", "the north east, region", "category of an item", "north-east", "c++ sales", "nothing here",
             "the common item 4x", None, "", "items", "THE COMMON ITEM 399", "north east item region"]
    frame = spark.createDataFrame(list(enumerate(texts)), "id int, question string").repartition(3)
    got = {r.id: (r.dim, r.value) for r in Q.mentions(frame, spark.createDataFrame(values, "dim string, value string, place int"), ["id"]).collect()}
    assert len(got) == len(texts)

    def brute(text):
        text = (text or "").lower()
        about = "Category" if "category" in text else "Region" if "region" in text else ""
        fits = [(-1 if d == about else p, -len(v), v, d) for d, v, p in values
                if re.search(r"(?<!\w)" + re.escape(v.lower()) + r"(?!\w)", text)]
        return (min(fits)[3], min(fits)[2]) if fits else (None, None)
    assert got == {i: brute(t) for i, t in enumerate(texts)}


def test_champions_are_replaced_by_key(spark, make_monthly, tmp_path):
    rows = make_monthly({"a": [10 + i for i in range(12)], "b": [100 - i for i in range(12)]})
    path = str(tmp_path / "champions")
    H.save_champions(H.train_all(rows, ["k"], ["moving_average"]), path, "replace")
    H.save_champions(H.train_all(rows.filter("k = 'b'"), ["k"], ["holts"]), path, "replace")
    assert {r.k: r.model_key for r in H.load_champions(spark, path).collect()} == {"a": "moving_average", "b": "holts"}
    with pytest.raises(Exception, match="ALREADY_EXISTS"):
        H.save_champions(H.train_all(rows, ["k"], ["holts"]), path)
    H.save_champions(H.train_all(rows, ["k"], ["linear_trend"]), path, "overwrite")
    assert {r.model_key for r in H.load_champions(spark, path).collect()} == {"linear_trend"}


def test_trees_predict_what_the_fitted_forest_does(spark, make_monthly):
    rng = random.Random(6)
    rows = make_monthly({k: [100 + 5 * i + rng.random() * 40 for i in range(30)] for k in "abc"})
    table = W.model_features(monthly_totals(rows, ["k"]), ["k"])
    model = M.forest(15, 5).fit(table)
    trees = M.forest_trees(model, spark)
    told = model.transform(table).toPandas()
    np.testing.assert_allclose(trees.predict(told[M.FEATURES].to_numpy(float)), told["_prediction"], rtol=1e-12)
    out = M.random_forest_forecast(rows, 14, ["k"], trees=15, depth=5)
    assert "ExistingRDD" not in out._jdf.queryExecution().executedPlan().toString()  # no lineage is cut
    one = {r.k: r.Forecast for r in out.filter("step = 1").collect()}
    assert out.count() == 42 and set(one) == set("abc")
    assert M.random_forest_forecast(make_monthly({"a": [1, 2, 3]}), 3, ["k"]).count() == 0


def test_scratch_of_a_scope_goes(spark):
    outer = settle(spark.range(3).toDF("a"), "outer")
    with passing_scratch(spark) as kept:
        inner = settle(spark.range(5).toDF("a"), "inner")
        result, path = write_table(inner.join(outer, "a"), "result")
        kept.add(path)
    assert result.count() == 3 and outer.count() == 3
    left = scratch_tables(spark)
    assert any("result-" in p for p in left) and not any("inner-" in p for p in left)
    drop_written(spark, path)
    assert not any("result-" in p for p in scratch_tables(spark))
