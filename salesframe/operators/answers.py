"""The results that questions are routed to, and their join."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import attach
from ..session import settle
from .anomaly import detect_anomalies
from .cube import Cube, roll_up
from .evaluate import compare_models, with_champion
from .forecast import CANDIDATES, chosen_rows, series_of, with_chosen_path
from .profile import missing_values
from .ranking import rank_dimension
from .rollup import business_facts, dimension_share, monthly_totals
from .rules import planning_recommendations


def _lines(df: DataFrame, lines: Sequence[tuple[str, Column | None, str, Column]]) -> DataFrame:
    """Rows (route, subject, metric, value) from one wide row."""
    return df.select(F.inline(F.array(*[
        F.struct(F.lit(route).alias("route"),
                 (F.lit(None) if subject is None else subject).cast("string").alias("subject"),
                 F.lit(metric).alias("metric"), value.cast("double").alias("value"))
        for route, subject, metric, value in lines
    ])))


def _rows(df: DataFrame, route: str, subject: Column, metric: Column, value: Column) -> DataFrame:
    return df.select(F.lit(route).alias("route"), subject.cast("string").alias("subject"),
                     metric.alias("metric"), value.cast("double").alias("value"))


# Names of a product column, and words in such names, by preference.
PRODUCT_COLUMNS = ["Product", "Product Name", "Item", "Item Name", "SKU", "Category"]
PRODUCT_WORDS = ["product", "item", "sku", "category", "brand"]


def product_dimension(df: DataFrame) -> str | None:
    """The column that product questions are about: by name, else by a word in the name."""
    names = {c.lower(): c for c in df.columns}
    known = [names[p.lower()] for p in PRODUCT_COLUMNS if p.lower() in names]
    return next(iter(known + [c for c in df.columns if any(w in c.lower() for w in PRODUCT_WORDS)]), None)


def answer_facts(df: DataFrame, product_dim: str | None = None, uplift_pct: float = 20.0,
                 cube: Cube | None = None) -> DataFrame:
    """Every result but forecasts, as (route, subject, metric, value).

    The rows are read twice: for the cube (unless one with all these dimensions is given) and for missing values.
    """
    c = F.col
    product_dim = product_dim or product_dimension(df)
    month = lambda name: F.date_format(name, "yyyy-MM")
    dims = [d for d in ("Category", "Region") if d in df.columns]
    if cube is None:
        cube = roll_up(df, (), [*dims, *([product_dim] if product_dim else [])])
    facts = settle(business_facts(cube, (), dims), "facts")
    factor = 1 + uplift_pct / 100
    shared = lambda route: [
        (route, None, "rows", c("rows")), (route, None, "total", c("total")),
        (route, month("best_month"), "best_month", c("best_sales")),
        (route, month("worst_month"), "worst_month", c("worst_sales")),
        (route, month("latest_month"), "latest_month", c("latest_sales")),
    ]
    lines = [
        *shared("summary"), ("summary", None, "row_avg", c("row_avg")),
        *shared("general"),
        *[("general", c(f"top_{d}"), f"top_{d}", c(f"top_{d}_share")) for d in dims],
        ("trend", None, "first3", c("first3")), ("trend", None, "last3", c("last3")),
        ("trend", None, "growth_3", c("growth_3")),
        ("comparison", month("latest_month"), "latest", c("latest_sales")),
        ("comparison", month("previous_month"), "previous", c("previous_sales")),
        ("comparison", None, "mom", c("mom")),
        ("comparison_3", None, "last3", c("last3")), ("comparison_3", None, "prev3", c("prev3")),
        ("comparison_3", None, "momentum", c("momentum")),
        ("best_month", month("best_month"), "sales", c("best_sales")),
        ("weakest_month", month("worst_month"), "sales", c("worst_sales")),
        ("scenario", None, "total", c("total")), ("scenario", None, "uplift_total", c("total") * factor),
        ("scenario", None, "month_avg", c("month_avg")), ("scenario", None, "uplift_month_avg", c("month_avg") * factor),
    ]
    parts = [_lines(facts, lines)]
    for dim, word in [*[(d, d.lower()) for d in dims], *([(product_dim, "product")] if product_dim else [])]:
        ranked = rank_dimension(cube.by(dim), dim).withColumn("_m", F.explode(F.array(
            F.struct(F.lit("sales").alias("m"), F.col("Sales").alias("v")),
            F.struct(F.lit("share").alias("m"), F.col("Share").alias("v")))))
        parts.append(ranked.select(
            F.concat("mode", F.lit(f"_{word}")).alias("route"), F.col(dim).alias("subject"),
            F.col("_m.m").alias("metric"), F.col("_m.v").alias("value")))
    for dim in dims:
        parts.append(_rows(dimension_share(cube.by(dim), dim), f"{dim.lower()}_breakdown", c(dim), F.lit("share"), c("Share")))
    if "Category" in dims:
        cells = monthly_totals(cube.by("Category"), ["Category"])
        parts.append(_rows(cells, "month_category", F.concat_ws(" ", month("Date"), c("Category")), F.lit("sales"), c("Sales")))
    odd = detect_anomalies(monthly_totals(cube.periods()), "rolling_deviation", 2.5, by_period=True)
    parts.append(_rows(odd.agg(F.count(F.lit(1)).alias("n")), "anomaly", F.lit(None), F.lit("count"), c("n")))
    parts.append(_rows(odd, "anomaly", F.date_format("Date", "yyyy-MM"), F.lit("score"), c("anomaly_score")))
    parts.append(_rows(compare_models(cube.periods(), (), CANDIDATES), "model_info", c("model_key"), F.lit("MAPE"), c("MAPE")))
    parts.append(_rows(planning_recommendations(cube, facts=facts), "recommendations", c("subject"), c("code"), c("metric")))
    parts.append(_rows(missing_values(df), "data_info", c("column"), F.lit("missing"), c("missing")))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def scoped_forecasts(df: DataFrame | Cube, questions: DataFrame, dims: Sequence[str]) -> DataFrame:
    """Best-model forecasts of the whole table and of every dimension value, per asked horizon.

    Horizons are bounded by the longest one that ``classify`` lets through. Months of all scopes come from one
    cube; raw rows are not multiplied by their scopes.
    """
    cube = df if isinstance(df, Cube) else roll_up(df, (), dims)
    keys = ["scope_dim", "scope_value"]
    rows = cube.periods().select(F.lit("").alias("scope_dim"), F.lit("").alias("scope_value"), "Date", "Sales")
    for d in dims:
        rows = rows.unionByName(cube.by(d).select(
            F.lit(d).alias("scope_dim"), F.col(d).cast("string").alias("scope_value"), "Date", "Sales"))
    series = series_of(rows, keys, 3)
    asked = questions.filter(F.col("route").startswith("forecast")).agg(F.collect_set("horizon").alias("_asked"))
    rows = attach(with_champion(series, keys, CANDIDATES), asked, ()).withColumn("h", F.explode("_asked")).drop("_asked")
    picked = with_chosen_path(rows, F.col("champion")).withColumnRenamed("h", "horizon")
    return chosen_rows(picked, [*keys, "horizon"])


ASK = ["route", "scope_dim", "scope_value", "horizon"]


def asks(questions: DataFrame, ids: Sequence[str]) -> DataFrame:
    """Which result each routed question asks for: ids and the columns of ``ASK``.

    Only what tells results apart is kept: the horizon is 0 where nothing is forecast.
    """
    ahead = F.col("route").startswith("forecast")
    return questions.select(*ids, "route", F.coalesce("scope_dim", F.lit("")).alias("scope_dim"),
                            F.when(F.col("route") != "forecast", F.lower("scope_value")).alias("scope_value"),
                            F.when(ahead, F.col("horizon")).otherwise(0).alias("horizon"))


def answers(asked: DataFrame, facts: DataFrame, forecasts: DataFrame) -> DataFrame:
    """One result for each distinct ask: (``ASK``, questions, subject, metric, value).

    However many questions ask for the same, their result is there once; they find it by
    their ask. An ask without a result has one row with the metric ``no_result``.
    """
    kinds = asked.groupBy(*ASK).agg(F.count(F.lit(1)).alias("questions"))
    ahead = F.col("route").startswith("forecast")
    none = F.lit("no_result")
    plain = kinds.filter(~ahead).join(facts, "route", "left").select(
        *ASK, "questions", "subject", F.coalesce("metric", none).alias("metric"), "value")
    paths = forecasts.select(
        "scope_dim", F.lower("scope_value").alias("scope_value"), "horizon",
        F.concat_ws(" ", F.date_format("Date", "yyyy-MM"), F.nullif("scope_value", F.lit(""))).alias("subject"),
        F.col("model_key").alias("metric"), F.col("Forecast").alias("value"))
    # one value or the whole table: an equi-join by the value; all values of a dimension: without it
    one, every = kinds.filter(ahead & (F.col("route") != "forecast_groups")), kinds.filter("route = 'forecast_groups'")
    scoped = one.withColumn("_value", F.coalesce("scope_value", F.lit(""))).join(
        paths.withColumnRenamed("scope_value", "_value"), ["scope_dim", "_value", "horizon"], "left")
    grouped = every.join(paths.drop("scope_value"), ["scope_dim", "horizon"], "left")
    shown = lambda df: df.select(*ASK, "questions", "subject", F.coalesce("metric", none).alias("metric"), "value")
    return plain.unionByName(shown(scoped)).unionByName(shown(grouped))
