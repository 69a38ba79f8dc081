"""The chosen model of every series as a table: written once, scored later."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.exprs import attach
from ..operators.evaluate import compare_models
from ..operators.forecast import DEFAULTS, FOREST, FOREST_DEFAULTS, Z_95, champion_rows, series_of

CLASSIC = ["moving_average", "linear_trend", "seasonal_naive", "exp_smoothing", "holts"]
TRAINED = [*CLASSIC, FOREST]
#: Columns of saved champions that are no keys of the panel.
RESULTS = ["model_key", "MAE", "RMSE", "MAPE", "R2", "Accuracy", "Splits", "Horizon", "trained_on", "params", "version"]


def with_params(champions: DataFrame) -> DataFrame:
    """Add the settings each champion was judged with."""
    cases = F.create_map(*[
        part for model, settings in (DEFAULTS | {FOREST: FOREST_DEFAULTS}).items()
        for part in (F.lit(model), F.map_from_entries(F.array(*[
            F.struct(F.lit(k), F.lit(float(v))) for k, v in settings.items()
        ])) if settings else F.expr("CAST(map() AS MAP<STRING, DOUBLE>)"))
    ])
    return champions.withColumn("params", F.try_element_at(cases, F.col("model_key")))


def train_all(df: DataFrame, keys: Sequence[str] = (), models: Sequence[str] = TRAINED) -> DataFrame:
    """The model with the lowest holdout error per series, with its settings; the forest competes from 8 months."""
    best = compare_models(df, keys, models).filter("rank = 1").drop("rank")
    last = series_of(df, keys).select(*keys, F.element_at("dates", -1).alias("trained_on"))
    return with_params(attach(best, last, keys))


def _versions(spark: SparkSession, path: str) -> int:
    """The newest version saved below ``path``, 0 if there is none."""
    try:
        return spark.read.parquet(path).agg(F.max("version")).first()[0] or 0
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return 0


def save_champions(champions: DataFrame, path: str, mode: str = "error") -> None:
    """Write champions as one version of the table.

    ``replace`` keeps the earlier versions and writes the next one as a partition of its own, so readers never meet
    half a table and a retried save overwrites only itself; of each key the newest version's row counts.
    """
    version = 1 + (_versions(champions.sparkSession, path) if mode == "replace" else 0)
    writer = champions.withColumn("version", F.lit(version)).write.partitionBy("version")
    if mode == "replace":
        writer.mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)
    else:
        writer.mode(mode).parquet(path)


def load_champions(spark: SparkSession, path: str) -> DataFrame:
    """The newest saved row of each key."""
    rows = spark.read.parquet(path)
    keys = [c for c in rows.columns if c not in RESULTS]
    newest = F.max_by(F.struct(*[c for c in rows.columns if c not in (*keys, "version")]), "version")
    return rows.groupBy(*keys).agg(newest.alias("_row")).filter("_row IS NOT NULL").select(*keys, "_row.*")


def _saved(name: str, default: float, whole: bool = False) -> str:
    text = f"coalesce(params['{name}'], {float(default)!r}D)"
    return f"CAST({text} AS INT)" if whole else text


def score_champions(champions: DataFrame, df: DataFrame, horizon: int = 12, keys: Sequence[str] = (),
                    z: float = Z_95) -> DataFrame:
    """Forecast new data with saved models and their saved settings."""
    chosen = champions.select(*keys, F.col("model_key").alias("champion"), "params")
    rows = attach(series_of(df, keys), chosen, keys).filter("champion IS NOT NULL").withColumn("h", F.lit(horizon))
    with_forest = bool(champions.filter(F.col("model_key") == FOREST).head(1))
    saved = {
        m: {k: _saved(k, v, k in ("window", "season")) for k, v in settings.items() if k != "top_n"}
        for m, settings in DEFAULTS.items()
    }
    return champion_rows(rows, df, horizon, keys, z, with_forest, saved)
