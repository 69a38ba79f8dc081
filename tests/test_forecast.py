import math
import random

import pytest
from pyspark.sql import functions as F

import brute
from salesframe.operators import evaluate as E
from salesframe.operators import forecast as P


def wavy(n, seed):
    r = random.Random(seed)
    return [1000 + 20 * i + 150 * math.sin(i * math.pi / 6) + r.uniform(-90, 90) for i in range(n)]


LENGTHS = (1, 2, 3, 5, 6, 7, 9, 10, 11, 12, 13, 23, 24, 25, 40)


@pytest.fixture(scope="module")
def panel(make_monthly):
    series = {f"n{n:02d}": wavy(n, n) for n in LENGTHS}
    series |= {"flat": [500.0] * 14, "zeros": [0.0] * 26, "step": [10.0] * 12 + [0.0] * 3 + [40.0] * 12}
    return series, make_monthly(series)


@pytest.mark.parametrize("horizon", [1, 14])
def test_every_model_and_length_equals_the_plain_rules(panel, horizon):
    series, rows = panel
    got = {}
    for r in P.forecast(rows, P.MODELS, horizon, ["k"]).collect():
        got.setdefault((r.k, r.model_key), {})[r.step] = (r.Forecast, r.Upper, r.Lower)
    for key, y in series.items():
        for name, rule in brute.MODELS.items():
            want = rule(y, horizon)
            if want is None:
                assert (key, name) not in got
                continue
            have = got[(key, name)]
            assert sorted(have) == list(range(1, horizon + 1))
            for step, triple in enumerate(want, start=1):
                assert have[step] == pytest.approx(triple, rel=1e-9, abs=1e-6), (key, name, step)


def test_panel_equals_single_series(panel):
    series, rows = panel
    whole = P.forecast(rows, "smart_ensemble", 4, ["k"]).filter("k = 'n25'").orderBy("step")
    alone = P.forecast(rows.filter("k = 'n25'").drop("k"), "smart_ensemble", 4).orderBy("step")
    assert [tuple(r)[1:] for r in whole.collect()] == [tuple(r) for r in alone.collect()]


def test_dates_follow_the_last_month(panel):
    _, rows = panel
    out = P.forecast(rows.filter("k = 'n12'"), "holts", 3, ["k"]).orderBy("step").collect()
    assert [str(r.Date) for r in out] == ["2023-01-01", "2023-02-01", "2023-03-01"]


def test_holt_uses_recent_trend_when_smoothed_trend_is_flat(make_monthly):
    rows = make_monthly({"a": [100, 100, 120, 140, 160, 180]}, "2024-01")
    out = P.forecast(rows, "holts", 3, ["k"], params={"holts": {"alpha": 1.0, "beta": 0.0}}).orderBy("step")
    values = [r.Forecast for r in out.collect()]
    assert values == sorted(values) and len(set(values)) == 3


def test_exp_smoothing_carries_the_trend(make_monthly):
    rows = make_monthly({"a": [100, 110, 125, 145, 170, 200, 235, 275]})
    out = P.forecast(rows, "exp_smoothing", 4, ["k"], params={"exp_smoothing": {"alpha": 0.35}}).orderBy("step")
    values = [r.Forecast for r in out.collect()]
    assert values == sorted(values) and len(set(values)) == 4


def test_seasonal_models_grow_on_last_year(make_monthly):
    first = [100 + 20 * i for i in range(12)]
    rows = make_monthly({"a": first + [v * 1.25 for v in first]})
    for model in ("seasonal_trend", "seasonal_naive"):
        out = P.forecast(rows, model, 6, ["k"]).orderBy("step").collect()
        assert all(r.Forecast > first[i] * 1.25 for i, r in enumerate(out))


def test_unknown_model_is_refused(make_monthly):
    with pytest.raises(ValueError, match="unknown model"):
        P.forecast(make_monthly({"a": [1, 2, 3]}), "prophecy", 3, ["k"])


def test_clip_at_zero(make_monthly):
    rows = make_monthly({"a": [100, 80, 60, 40, 20, 5]})
    plain = P.forecast(rows, "linear_trend", 3, ["k"]).agg(F.min("Forecast")).first()[0]
    clipped = P.forecast(rows, "linear_trend", 3, ["k"], clip_at_zero=True).agg(F.min("Forecast")).first()[0]
    assert plain < 0 and clipped == 0


def test_fallback_for_short_series(panel):
    _, rows = panel
    out = P.forecast_with_fallback(rows, "holts", 2, ["k"]).select("k", "model_key").distinct()
    used = {r.k: r.model_key for r in out.collect()}
    assert used["n01"] == "exp_smoothing" and used["n02"] == "holts"


def test_champions_equal_the_plain_rules(panel):
    series, rows = panel
    got = {r.k: r for r in E.champions(rows, ["k"], P.CANDIDATES).collect()}
    assert set(got) == set(series)
    for key, y in series.items():
        name, error = brute.champion(y)
        assert got[key].model_key == name, key
        assert (got[key].MAPE is None) == (error is None)
        if error is not None:
            assert got[key].MAPE == pytest.approx(error, abs=0.011)
        assert got[key].judged_by == ("backtest" if len(y) >= 10 else "holdout" if len(y) >= 6 else "default")


def test_best_model_forecast_uses_the_champion(panel):
    series, rows = panel
    out = P.forecast_with_best_model(rows, 3, ["k"], models=P.CANDIDATES)
    got = {(r.k, r.step): (r.model_key, r.Forecast) for r in out.collect()}
    for key in ("n12", "n25", "n40"):
        name, _ = brute.champion(series[key])
        want = brute.MODELS[name](series[key], 3)
        for step in (1, 2, 3):
            assert got[(key, step)][0] == name
            assert got[(key, step)][1] == pytest.approx(want[step - 1][0], rel=1e-9)


def test_comparison_is_sorted_and_backtest_counts_splits(panel):
    _, rows = panel
    rows = rows.filter("k IN ('n25', 'n40')")
    table = E.compare_models(rows, ["k"]).orderBy("k", "rank").collect()
    for key in ("n25", "n40"):
        errors = [r.MAPE for r in table if r.k == key]
        assert len(errors) == 7 and errors == sorted(errors)  # the forest takes part from eight months on
    tested = E.backtest(rows, ["k"], ["moving_average", "linear_trend"], 6, 1, 4).collect()
    assert len(tested) == 4 and all(r.Splits == 4 and r.Horizon == 1 for r in tested)


def test_best_model_takes_the_lowest_error(spark):
    table = spark.createDataFrame([("a", 20.0), ("b", 10.0), ("c", 15.0)], "model_key string, MAPE double")
    best = E.best_model(table).collect()
    assert [(r.model_key, r.MAPE) for r in best] == [("b", 10.0)]


def test_metrics(spark):
    rows = spark.createDataFrame([(100.0, 110.0), (200.0, 190.0), (300.0, 310.0), (0.5, 1.0)], "actual double, predicted double")
    floored, exact = E.metrics(rows).first(), E.metrics(rows, tiny_only=True).first()
    assert floored.MAPE == pytest.approx((10 + 5 + 10 / 3 + 50) / 4)
    assert exact.MAPE == pytest.approx((10 + 5 + 10 / 3 + 100) / 4)
    flat = spark.createDataFrame([(5.0, 4.0), (5.0, 6.0)], "actual double, predicted double")
    assert E.metrics(flat).first().R2 == 0.0


def test_confidence_bands(spark):
    rows = spark.createDataFrame([
        (10.0, 12.0, 24, 1), (5.0, 5.0, 30, 0), (60.0, 50.0, 4, 9), (None, 5.0, 3, 0)],
        "MAPE double, cv double, months long, anomalies long")
    got = [(r.score, r.level) for r in E.with_confidence(rows).collect()]
    assert got == [(77, "High"), (100, "High"), (0, "Low"), (None, "Not rated")]


def test_flat_guard_moves_only_flat_paths(spark, make_monthly):
    rows = make_monthly({"a": [100, 120, 140, 160, 180, 200]})
    flat = spark.createDataFrame(
        [("a", "m", s, "2022-07-01", 150.0, 170.0, 130.0) for s in (1, 2, 3)],
        "k string, model_key string, step long, Date string, Forecast double, Upper double, Lower double")
    got = [r.Forecast for r in P.flat_guard(flat, rows, ["k"]).orderBy("step").collect()]
    assert got == pytest.approx([150 + 0.45 * 20 * brute.pull(0.88, s) for s in (1, 2, 3)])
    sloped = flat.withColumn("Forecast", F.col("Forecast") + F.col("step"))
    same = [r.Forecast for r in P.flat_guard(sloped, rows, ["k"]).orderBy("step").collect()]
    assert same == [151.0, 152.0, 153.0]


def test_interval_rescale(make_monthly):
    rows = make_monthly({"a": wavy(20, 3)})
    base = P.forecast(rows, "holts", 2, ["k"])
    narrow = P.rescale_interval(base, P.Z_VALUES["80%"]).orderBy("step").collect()
    direct = P.forecast(rows, "holts", 2, ["k"], z=1.28).orderBy("step").collect()
    assert [r.Upper for r in narrow] == pytest.approx([r.Upper for r in direct])


def test_grouped_forecasts_have_separate_totals(make_monthly):
    rows = make_monthly({"Electronics": [1000 + 20 * i for i in range(12)], "Apparel": [500 + 10 * i for i in range(12)],
                         "Tiny": [1, 2]})
    out = P.forecast_groups(rows, ["k"], 24).collect()
    totals = {r.k: r.TotalForecast for r in out}
    assert set(totals) == {"Electronics", "Apparel"} and len(set(totals.values())) == 2
    assert sum(1 for r in out if r.k == "Electronics") == 24
