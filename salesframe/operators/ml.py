"""Tree and linear regression on the feature table of a monthly panel.

One model is fitted on the whole panel; rows of all series are its examples.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import arrays as A
from ..functions.exprs import attach, staged
from ..session import scratch_path, settle
from .evaluate import metrics, ranked, time_split
from .features import model_features, month_arrays
from .forecast import RECENT, Z_95, flat_limit, move_if_flat
from .rollup import monthly_totals

# The features; the last three describe the calendar.
FEATURES = ["lag_1", "lag_2", "lag_3", "rolling_mean_3", "rolling_std_3", "month", "quarter", "year"]
CALENDAR = FEATURES[5:]
FEWEST_MONTHS = 6
#: Rows that go down all trees together.
ROWS_AT_ONCE = 4096


def _pipeline(learner) -> Pipeline:
    learner = learner.setFeaturesCol("_features").setLabelCol("Sales").setPredictionCol("_prediction")
    return Pipeline(stages=[VectorAssembler(inputCols=FEATURES, outputCol="_features"), learner])


def forest(trees: int = 120, depth: int = 8, leaf: int = 1, seed: int = 42) -> Pipeline:
    return _pipeline(RandomForestRegressor(
        numTrees=trees, maxDepth=depth, minInstancesPerNode=leaf, featureSubsetStrategy="all", seed=seed))


def regressors(seed: int = 42) -> dict[str, Pipeline]:
    """The three compared learners; trees of boosting learn from all rows each round."""
    return {
        "Linear Regression": _pipeline(LinearRegression()),
        "Random Forest": forest(250, 10, 2, seed),
        "Gradient Boosting": _pipeline(GBTRegressor(maxIter=250, stepSize=0.05, maxDepth=3, seed=seed)),
    }


class Trees(NamedTuple):
    """A forest as arrays (trees, nodes): a node's feature (-1 in leaves), threshold, children and value."""
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Mean over the trees for rows of features; all trees and rows go down one level at a time."""
        out = []
        tree = np.arange(len(self.value))[:, None]
        for at in range(0, len(x), ROWS_AT_ONCE):
            part = x[at:at + ROWS_AT_ONCE]
            row, node = np.arange(len(part))[None, :], np.zeros((len(tree), len(part)), np.int32)
            feature = self.feature[tree, node]
            while (feature >= 0).any():
                low = part[row, np.maximum(feature, 0)] <= self.threshold[tree, node]
                below = np.where(low, self.left[tree, node], self.right[tree, node])
                node = np.where(feature >= 0, below, node)
                feature = self.feature[tree, node]
            out.append(self.value[tree, node].mean(axis=0))
        return np.concatenate(out) if out else np.zeros(0)


def forest_nodes(model: PipelineModel, spark: SparkSession) -> DataFrame:
    """The nodes of a fitted forest as a table: ``tree``, ``node``, ``feature``, ``threshold``, ``left``, ``right``, ``value``."""
    path = scratch_path(spark, "forest")
    model.stages[-1].write().save(path)
    n = F.col("nodeData")
    return spark.read.parquet(f"{path}/data").select(
        F.col("treeID").alias("tree"), n["id"].alias("node"), n["split"]["featureIndex"].alias("feature"),
        F.get(n["split"]["leftCategoriesOrThreshold"], F.lit(0)).alias("threshold"),
        n["leftChild"].alias("left"), n["rightChild"].alias("right"), n["prediction"].alias("value"))


def forest_trees(model: PipelineModel, spark: SparkSession) -> Trees:
    """A fitted forest as arrays; at most trees x 2 ** (depth + 1) nodes, whatever it learnt from."""
    nodes = forest_nodes(model, spark).toPandas()
    shape = (nodes["tree"].max() + 1, nodes["node"].max() + 1)

    def laid(name: str, kind: type, empty: float) -> np.ndarray:
        out = np.full(shape, empty, kind)
        out[nodes["tree"], nodes["node"]] = nodes[name].fillna(empty)
        return out
    return Trees(laid("feature", np.int32, -1), laid("threshold", np.float64, 0), laid("left", np.int32, -1),
                 laid("right", np.int32, -1), laid("value", np.float64, 0))


def recursive_paths(trees: Trees, history: np.ndarray, month: np.ndarray, steps: int) -> np.ndarray:
    """Forecasts (series, steps): each prediction, not below 0, becomes the newest history of the next.

    ``history`` has the last three months of each series, oldest first; ``month`` counts the last one from year 0.
    """
    out = np.zeros((len(history), steps))
    for step in range(steps):
        lags = history[:, ::-1]
        month = month + 1
        features = np.column_stack([
            lags, lags.mean(axis=1), lags.std(axis=1), month % 12 + 1, month % 12 // 3 + 1, month // 12])
        out[:, step] = np.maximum(trees.predict(features), 0.0)
        history = np.column_stack([history[:, 1:], out[:, step]])
    return out


def with_forest_path(rows: DataFrame, trees: Trees, ids: Sequence[str], h: str) -> DataFrame:
    """Add the path ``_f`` of ``h`` months to rows with ``dates`` and ``y``: one projection, whatever the horizon.

    Trees are arrays that go with the task; a batch of series goes down all of them together. Walking them
    by column expressions would visit a thousand nodes per series and month one by one.
    """
    @F.pandas_udf("array<double>")
    def path(y: pd.Series, month: pd.Series, steps: pd.Series) -> pd.Series:
        if not len(y):
            return pd.Series([], dtype=object)
        found = recursive_paths(trees, np.stack([v[-3:] for v in y]), month.to_numpy(), int(steps.max()))
        return pd.Series([f[:n] for f, n in zip(found, steps)])

    last = F.element_at("dates", -1)
    state = staged(rows, {"_recent": A.tail("y", RECENT), "_flat": flat_limit("y")}).withColumns({
        "_slope": F.expr(A.slope("_recent")), "_last": last,
        "_f": path("y", F.year(last) * 12 + F.month(last) - 1, F.col(h).cast("int"))})
    return staged(state.drop("_recent"), {"_f": move_if_flat("_f", "_slope", "_flat", 0.20, 0.78)}).select(*ids, "_last", "_f")


def random_forest_forecast(df: DataFrame, horizon: int = 6, keys: Sequence[str] = (), z: float = Z_95,
                           trees: int = 120, depth: int = 8, seed: int = 42) -> DataFrame:
    """Month-by-month forecasts of every series by one forest over the whole panel."""
    keys = list(keys)
    # History, training rows and residuals all start from the month totals.
    monthly = settle(monthly_totals(df, keys), "monthly")
    series = month_arrays(monthly, keys).filter(F.size("y") >= FEWEST_MONTHS)
    rows = model_features(monthly, keys)
    if keys:
        rows = rows.join(series.select(*keys), keys, "left_semi")
    rows = settle(rows, "features")
    if not rows.head(1):  # no series is long enough
        return df.sparkSession.createDataFrame([], series.select(*keys).schema).select(
            *keys, F.lit("random_forest").alias("model_key"), F.lit(0).cast("long").alias("step"),
            F.lit(None).cast("date").alias("Date"), *[F.lit(None).cast("double").alias(c) for c in ("Forecast", "Upper", "Lower")])
    model = forest(trees, depth, 1, seed).fit(rows)
    spread = model.transform(rows).groupBy(*keys).agg(
        F.stddev_pop(F.col("Sales") - F.col("_prediction")).alias("_s"))
    found = with_forest_path(attach(series, spread, keys).withColumn("_h", F.lit(horizon)),
                             forest_trees(model, df.sparkSession), [*keys, "_s"], "_h")
    long = found.select(*keys, "_s", "_last", F.posexplode("_f").alias("_i", "Forecast"))
    step = F.col("_i") + 1
    return long.select(
        *keys, F.lit("random_forest").alias("model_key"), step.cast("long").alias("step"),
        F.add_months("_last", step).alias("Date"), "Forecast",
        (F.col("Forecast") + F.col("_s") * z).alias("Upper"),
        F.greatest(F.col("Forecast") - F.col("_s") * z, F.lit(0.0)).alias("Lower"),
    )


def forest_paths(cut: DataFrame, keys: Sequence[str], trees: int = 120, depth: int = 8, seed: int = 42) -> DataFrame:
    """Forest forecasts ``v`` of series cut at origins (``slot``, ``o``, ``h``, ``dates``, ``y``).

    ``slot`` numbers the origins of a series from its last one; there are as many forests as
    slots, each fitted on the whole panel as far as its origins go.
    """
    ids, out = [*keys, "o", "h"], None
    cut = settle(cut.filter(F.size("y") >= FEWEST_MONTHS), "cut")
    for (slot,) in sorted(cut.select("slot").distinct().collect()):  # a handful of origins
        part = cut.filter(F.col("slot") == slot)
        rows = model_features(
            part.select(*keys, F.explode(F.arrays_zip("dates", "y")).alias("_m")).select(
                *keys, F.col("_m.dates").alias("Date"), F.col("_m.y").alias("Sales")), keys)
        model = forest(trees, depth, 1, seed).fit(settle(rows, "features"))
        done = with_forest_path(part.select(*ids, "dates", "y"), forest_trees(model, cut.sparkSession), ids, "h").select(
            *ids, F.col("_f").alias("v"))
        out = done if out is None else out.unionByName(done)
    return out if out is not None else cut.select(*ids, F.col("y").alias("v"))


def feature_table(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Features of a panel with the train/test part of every month, written once for the fits."""
    return settle(time_split(model_features(monthly_totals(df, keys), keys), keys), "features")


def compare_regressors(table: DataFrame, seed: int = 42) -> tuple[DataFrame, dict[str, PipelineModel]]:
    """Fit the learners on the train part and score them on the test part, best RMSE first."""
    train, test = table.filter("part = 'train'"), table.filter("part = 'test'")
    fitted = {name: p.fit(train) for name, p in regressors(seed).items()}
    scored = None
    for name, model in fitted.items():
        rows = model.transform(test).select(
            F.lit(name).alias("model_key"), F.col("Sales").alias("actual"), F.col("_prediction").alias("predicted"))
        scored = rows if scored is None else scored.unionByName(rows)
    out = metrics(scored, ["model_key"], tiny_only=True).withColumns({
        "MAE": F.round("MAE", 4), "RMSE": F.round("RMSE", 4), "MAPE": F.round("MAPE", 2), "R2": F.round("R2", 4)})
    return ranked(out, (), "RMSE", list(fitted)), fitted


def refit_best(table: DataFrame, comparison: DataFrame, seed: int = 42) -> tuple[str, PipelineModel]:
    """Fit the winner again on all rows."""
    name = comparison.filter("rank = 1").first()["model_key"]
    return name, regressors(seed)[name].fit(table)


def importance(model: PipelineModel, spark) -> DataFrame:
    """Share of each feature in a forest's splits, in percent, largest first."""
    parts = model.stages[-1].featureImportances.toArray().tolist()
    rows = [(f, "calendar" if f in CALENDAR else "lag", float(v)) for f, v in zip(FEATURES, parts)]
    table = spark.createDataFrame(rows, "feature string, kind string, _v double")
    return table.select("feature", "kind", F.round(F.col("_v"), 4).alias("Importance"),
                        F.round(F.col("_v") * 100, 1).alias("ImportancePct"))


def forest_importance(df: DataFrame, keys: Sequence[str] = (), trees: int = 120, depth: int = 8,
                      seed: int = 42) -> DataFrame:
    """Feature importance of the forecasting forest; no rows for fewer than four examples."""
    rows = settle(model_features(monthly_totals(df, keys), keys), "features")
    if len(rows.limit(4).collect()) < 4:
        return df.sparkSession.createDataFrame(
            [], "feature string, kind string, Importance double, ImportancePct double")
    return importance(forest(trees, depth, 1, seed).fit(rows), df.sparkSession)


def regression_summary(comparison: DataFrame, examples: DataFrame, anomalies: DataFrame | None = None) -> DataFrame:
    """Best and worst learner with their errors, why the best one suits, whether the history is deep
    (90 rows), and how many ``anomalies`` call for caution."""
    ends = comparison.agg(
        F.min(F.struct("rank", "model_key", "RMSE", "MAE")).alias("_b"),
        F.max(F.struct("rank", "model_key", "RMSE")).alias("_w"))
    odd = anomalies.agg(F.count(F.lit(1)).alias("anomalies")) if anomalies is not None else ends.select(
        F.lit(0).cast("long").alias("anomalies"))
    suits = F.when(F.col("_b.model_key") == "Random Forest", "non_linear").when(
        F.col("_b.model_key") == "Gradient Boosting", "complex_patterns").otherwise("close_to_linear")
    sized = attach(attach(ends, examples.agg(F.count(F.lit(1)).alias("examples")), ()), odd, ())
    return sized.select(
        F.col("_b.model_key").alias("best"), F.col("_b.RMSE").alias("best_rmse"), F.col("_b.MAE").alias("best_mae"),
        F.col("_w.model_key").alias("worst"), F.col("_w.RMSE").alias("worst_rmse"), "examples",
        (F.col("examples") >= 90).alias("deep_history"), suits.alias("suits"), "anomalies",
        (F.col("anomalies") > 0).alias("caution"))
