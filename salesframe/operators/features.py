"""Calendar, lag, rolling and model features."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from ..functions import arrays as A
from ..functions.exprs import attach, clip, per_series, staged
from ..session import settle
from .ordered import over_rows, with_position


#: Levels of a text column up to which ``one_hot`` makes columns of them.
MAX_LEVELS = 1000


def calendar_features(df: DataFrame, date_col: str = "Date") -> DataFrame:
    d = F.col(date_col)
    return df.withColumns({
        "year": F.year(d).cast("long"), "month": F.month(d).cast("long"),
        "day": F.dayofmonth(d).cast("long"), "weekday": F.date_format(d, "EEEE"),
        "quarter": F.quarter(d).cast("long"),
        "is_month_end": (F.last_day(d) == d.cast("date")).cast("long"),
        "is_month_start": (F.dayofmonth(d) == 1).cast("long"),
    })


def row_features(df: DataFrame, order: Sequence[str], keys: Sequence[str] = (),
                 value_col: str = "Sales", lags: Sequence[int] = (1, 2, 3),
                 windows: Sequence[int] = (7, 30)) -> DataFrame:
    """Lags and trailing mean and sample deviation over the ordered rows of each series.

    A trailing window holds the current row and those before it. ``order`` should
    place every row, so that results do not depend on how rows arrive.
    """
    def make(frame, ordered):
        lagged = {f"lag_{k}": F.lag(value_col, k).over(ordered) for k in lags}
        rolled = {
            f"rolling_{label}_{w}": f(value_col).over(frame(1 - w, 0))
            for w in windows for label, f in (("mean", F.avg), ("std", F.stddev_samp))
        }
        return {**lagged, **rolled}

    return over_rows(df, order, max([*lags, *[w - 1 for w in windows]]), make, keys)


def lag_features(df: DataFrame, order: Sequence[str], keys: Sequence[str] = (),
                 value_col: str = "Sales", lags: Sequence[int] = (1, 2, 3)) -> DataFrame:
    return row_features(df, order, keys, value_col, lags, ())


def rolling_features(df: DataFrame, order: Sequence[str], keys: Sequence[str] = (),
                     value_col: str = "Sales", windows: Sequence[int] = (7, 30)) -> DataFrame:
    return row_features(df, order, keys, value_col, (), windows)


def model_features(monthly: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Supervised table of a monthly panel: lags, statistics of the three months before, calendar."""
    w = per_series(keys, "Date")
    three = w.rowsBetween(-3, -1)
    full = F.count("Sales").over(three) == 3
    return monthly.withColumns({
        **{f"lag_{k}": F.lag("Sales", k).over(w) for k in (1, 2, 3)},
        "rolling_mean_3": F.when(full, F.avg("Sales").over(three)),
        "rolling_std_3": F.when(full, F.stddev_samp("Sales").over(three)),
        "month": F.month("Date").cast("long"), "quarter": F.quarter("Date").cast("long"),
        "year": F.year("Date").cast("long"),
    }).dropna()


def month_change(monthly: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Month-over-month percent and the mean of the last three months."""
    w = per_series(keys, "Date")
    before = F.lag("Sales").over(w)
    return monthly.withColumns({
        "MoM": F.when(before.isNotNull(), F.try_divide(F.col("Sales") - before, before) * 100),
        "Rolling3": F.avg("Sales").over(w.rowsBetween(-2, 0)),
    })


def running_total(totals: DataFrame, keys: Sequence[str] = (), value_col: str = "Sales",
                  order: str = "Date") -> DataFrame:
    w = per_series(keys, order).rowsBetween(Window.unboundedPreceding, 0)
    return totals.withColumn("Cumulative", F.sum(value_col).over(w))


def month_arrays(monthly: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """One row per series: month-ordered ``dates`` and ``y``.

    Only monthly rows are collected, so an array is as long as the calendar. The
    exchange by key that this needs anyway keeps its full number of partitions:
    the rows are small but the models on them are not.
    """
    if keys:
        spread = int(monthly.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        monthly = monthly.repartition(spread, *keys)
    rows = F.array_sort(F.collect_list(F.struct("Date", F.col("Sales").cast("double").alias("Sales"))))
    return monthly.groupBy(*keys).agg(rows.alias("_s")).select(
        *keys,
        F.transform("_s", lambda e: e["Date"]).alias("dates"),
        F.transform("_s", lambda e: e["Sales"]).alias("y"),
    ).filter(F.size("y") > 0)


def recent_growth(monthly: DataFrame, keys: Sequence[str] = (), window: int = 6,
                  limit: float = 0.15) -> DataFrame:
    """Mean month-over-month ratio of the last months, clamped, beside their average."""
    ratios = ("zip_with(slice(y, 1, size(y) - 1), slice(y, 2, size(y)), "
              "(a, b) -> try_divide(b - a, a))")
    rows = staged(month_arrays(monthly, keys), {"_r": ratios})
    rows = staged(rows, {"_r": f"filter({A.tail('_r', window)}, r -> r IS NOT NULL)"})
    return rows.select(
        *keys, F.expr(A.mean(A.tail("y", window))).alias("recent_avg"),
        clip(F.expr(f"coalesce({A.mean('_r')}, 0D)"), -limit, limit).alias("recent_growth"),
    )


def recent_slope(monthly: DataFrame, keys: Sequence[str] = (), window: int = 6) -> DataFrame:
    """Least-squares slope of the last months."""
    rows = staged(month_arrays(monthly, keys), {"_r": A.tail("y", window)})
    return rows.select(*keys, F.expr(A.slope("_r")).alias("slope"))


def one_hot(df: DataFrame, columns: Sequence[str] | None = None, exclude: Sequence[str] = (),
            levels: Mapping[str, Sequence[str]] | None = None, max_levels: int = MAX_LEVELS) -> DataFrame:
    """0/1 columns per text level, the first level dropped.

    The levels become columns, so they must be few: pass ``levels``, or let two jobs look them up, one that
    sketches how many there are and one that fetches them. A column with more than about ``max_levels`` is refused
    before anything is fetched; ``one_hot_vectors`` takes any number.
    """
    if columns is None:
        columns = [n for n, t in df.dtypes if t == "string" and n not in exclude]
    levels = dict(levels or {})
    unknown = [c for c in columns if c not in levels]
    if unknown:
        sizes = df.agg(*[F.approx_count_distinct(c, 0.02).alias(f"n{i}") for i, c in enumerate(unknown)]).first()
        many = [c for c, n in zip(unknown, sizes) if n > max_levels]
        if many:
            raise ValueError(f"{', '.join(many)}: more than {max_levels} levels, use one_hot_vectors")
        found = df.agg(*[F.collect_set(c).alias(f"s{i}") for i, c in enumerate(unknown)]).first()
        levels |= dict(zip(unknown, found))
    flags = {
        f"{c}_{v}": F.coalesce(F.col(c) == v, F.lit(False)).cast("long")
        for c in columns for v in sorted(levels[c])[1:]
    }
    return df.withColumns(flags).drop(*columns)


def one_hot_vectors(df: DataFrame, columns: Sequence[str] | None = None, exclude: Sequence[str] = ()) -> DataFrame:
    """A sparse 0/1 vector column ``<name>_levels`` per text column, for any number of levels.

    Levels are numbered by name, the first has no place of its own, and a missing value is
    all zeros, as in ``one_hot``. Numbers come from a join with the counted levels.
    """
    if columns is None:
        columns = [n for n, t in df.dtypes if t == "string" and n not in exclude]

    for c in columns:
        levels = df.select(F.col(c).alias("_v")).filter("_v IS NOT NULL").distinct()
        levels = settle(with_position(levels, ["_v"], name="_i"), "levels")
        size = levels.agg(F.greatest(F.max("_i") - 1, F.lit(0)).cast("int").alias("_size"))
        df = attach(df.join(levels, F.col(c) == F.col("_v"), "left"), size, ())
        place = F.col("_i") - 2
        df = df.withColumn(f"{c}_levels", F.struct(
            F.coalesce("_size", F.lit(0)).alias("size"),
            F.when(place >= 0, F.array(place.cast("int"))).otherwise(F.expr("CAST(array() AS ARRAY<INT>)")).alias("indices"),
            F.when(place >= 0, F.array(F.lit(1.0))).otherwise(F.expr("CAST(array() AS ARRAY<DOUBLE>)")).alias("values"),
        )).drop("_v", "_i", "_size")
    return df.drop(*columns)


def min_max(df: DataFrame, columns: Sequence[str] | None = None,
            exclude: Sequence[str] = ()) -> DataFrame:
    """Scale numeric columns to 0..1; constant columns stay as they are."""
    if columns is None:
        columns = [f.name for f in df.schema
                   if isinstance(f.dataType, NumericType) and f.name not in exclude]
    columns = list(columns)
    ends = df.agg(*[
        e for i, c in enumerate(columns)
        for e in (F.min(c).cast("double").alias(f"_lo{i}"), F.max(c).cast("double").alias(f"_hi{i}"))
    ])
    out = attach(df, ends, ())
    return out.withColumns({
        c: F.when(F.col(f"_hi{i}") > F.col(f"_lo{i}"),
                  (F.col(c) - F.col(f"_lo{i}")) / (F.col(f"_hi{i}") - F.col(f"_lo{i}")))
        .otherwise(F.col(c).cast("double"))
        for i, c in enumerate(columns)
    }).drop(*[f"_{e}{i}" for i in range(len(columns)) for e in ("lo", "hi")])
