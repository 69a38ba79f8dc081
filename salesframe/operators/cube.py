"""One roll-up of a sales table that many results read.

A cube holds, for every period and for every period and value of each dimension, the number of rows and of
known values, their sum, least and largest value, squared deviations and the span of dates. Raw rows are read
once and summed by (period, all dimensions) before anything else moves; only these sums are spread over
the dimensions. The cube is written once, so totals, leaders, shares, months, series of forecasts, statistics of
rows and lists of values all come from it without another scan.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import attach, known_keys, month_of, nz_sum
from ..session import settle


def _summed() -> list[Column]:
    """Sums of rows that are sums already."""
    return [
        F.sum("_rows").alias("_rows"), F.sum("_known").alias("_known"), F.sum("Sales").alias("Sales"),
        F.min("_low").alias("_low"), F.max("_high").alias("_high"), F.min("_first").alias("_first"),
        F.max("_last").alias("_last"),
    ]


class Cube:
    """A written roll-up; ``columns`` are those of the sales tables that it can stand for."""

    def __init__(self, cells: DataFrame, keys: Sequence[str], dims: Sequence[str], unit: str):
        self.cells, self.keys, self.dims, self.unit = cells, list(keys), list(dims), unit
        self.columns = [*self.keys, "Date", "Sales", *self.dims]

    def periods(self) -> DataFrame:
        """One row per period, as a sales table, with rows, known values and ends."""
        return self.cells.filter("_set = 0").select(
            *self.keys, F.col("_period").alias("Date"), "Sales", "_rows", "_known", "_m2", "_low", "_high", "_first", "_last")

    def by(self, dim: str) -> DataFrame:
        """One row per period and value of a dimension, as a sales table; ``_rows`` of each."""
        place = self.dims.index(dim) + 1
        return self.cells.filter(F.col("_set") == place).select(
            *self.keys, F.col("_period").alias("Date"), F.col(f"_d_{dim}").alias(dim), "Sales", "_rows")

    def values(self, dims: Sequence[str] | None = None) -> DataFrame:
        """Distinct values of dimensions: (dim, value, place)."""
        dims = list(self.dims if dims is None else dims)
        found = None
        for place, dim in enumerate(dims):
            part = self.by(dim).select(F.lit(dim).alias("dim"), F.col(dim).cast("string").alias("value"), F.lit(place).alias("place"))
            found = part if found is None else found.unionByName(part)
        return found.filter("value <> ''").distinct()

    def totals(self, dims: Sequence[str]) -> DataFrame:
        """Totals per month and per value of each of ``dims``, of dated rows: the columns ``business_facts`` starts from."""
        places = [0, *[self.dims.index(d) + 1 for d in dims]]
        rows = self.cells.filter(F.col("_set").isin(places) & F.col("_period").isNotNull())
        month = F.when(F.col("_set") == 0, month_of(F.col("_period").cast("date"))).alias("_month")
        out = rows.groupBy(*self.keys, "_set", month, *[f"_d_{d}" for d in dims]).agg(*_summed())
        return out.withColumns({f"_g{i}": (F.col("_set") != p).cast("int") for i, p in enumerate(places)})

    def sizes(self) -> DataFrame:
        """Rows per series as ``_rows``, undated ones too."""
        return self.cells.filter("_set = 0").groupBy(*self.keys).agg(F.sum("_rows").alias("_rows"))

    def centre(self) -> DataFrame:
        """Mean, sample deviation and number of the raw rows of each series: ``_mean``, ``_std``, ``_n``."""
        cells = self.cells.filter("_set = 0").select(*self.keys, "_rows", "_known", "Sales", "_m2")
        whole = cells.groupBy(*self.keys).agg(
            F.sum("_rows").alias("_n"), F.sum("_known").alias("_k"), F.try_divide(F.sum("Sales"), F.sum("_known")).alias("_mean"))
        off = F.try_divide(F.col("Sales"), F.col("_known")) - F.col("_mean")
        spread = attach(cells, whole, self.keys).groupBy(*self.keys).agg(
            F.sum(F.coalesce(F.col("_m2") + F.col("_known") * off * off, F.lit(0.0))).alias("_all"))
        return attach(whole, spread, self.keys).select(
            *self.keys, "_mean", F.when(F.col("_k") > 1, F.sqrt(F.col("_all") / (F.col("_k") - 1))).alias("_std"), "_n")


def roll_up(df: DataFrame, keys: Sequence[str] = (), dims: Sequence[str] = (), unit: str = "month",
            date_col: str = "Date", value_col: str = "Sales") -> Cube:
    """The cube of a sales table by ``month``, ``day`` or date as it stands (``date``); null keys are dropped."""
    keys, dims = list(keys), list(dict.fromkeys(dims))
    day = F.col(date_col).cast("date")
    period = {"month": month_of(date_col), "day": day, "date": F.col(date_col)}[unit]
    rows = known_keys(df, keys).select(
        *keys, period.alias("_period"), day.alias("_day"), F.col(value_col).cast("double").alias("_v"),
        *[F.col(d).alias(f"_d_{d}") for d in dims])
    first = rows.groupBy(*keys, "_period", *[f"_d_{d}" for d in dims]).agg(
        F.count(F.lit(1)).alias("_rows"), F.count("_v").alias("_known"), nz_sum("_v").alias("Sales"),
        (F.var_pop("_v") * F.count("_v")).alias("_m2"), F.min("_v").alias("_low"), F.max("_v").alias("_high"),
        F.min("_day").alias("_first"), F.max("_day").alias("_last"))
    if dims:
        first = _spread(settle(first, "combinations"), keys, dims)
    else:
        first = first.withColumn("_set", F.lit(0))
    return Cube(settle(first, "cube"), keys, dims, unit)


def _spread(first: DataFrame, keys: list[str], dims: list[str]) -> DataFrame:
    """Sums by (period) and by (period, value) of each dimension from sums by (period, all dimensions)."""
    marks = [f"_d_{d}" for d in dims]
    kinds = dict(first.dtypes)
    sets = F.array(*[F.struct(
        F.lit(i).alias("_set"), *[(F.col(m) if i == k else F.lit(None).cast(kinds[m])).alias(m) for k, m in enumerate(marks, 1)])
        for i in range(len(dims) + 1)])
    # squared deviations of a union: those inside the parts, and those of the parts' means; means are taken
    # from the series' mean, so that nothing cancels
    whole = first.groupBy(*keys).agg(F.try_divide(F.sum("Sales"), F.sum("_known")).alias("_mean"))
    off = F.try_divide(F.col("Sales"), F.col("_known")) - F.col("_mean")
    rows = attach(first, whole, keys).select(
        *keys, "_period", "_rows", "_known", "Sales", "_low", "_high", "_first", "_last",
        F.coalesce(off * F.col("_known"), F.lit(0.0)).alias("_off"),
        F.coalesce(F.col("_m2") + off * off * F.col("_known"), F.lit(0.0)).alias("_sq"), F.inline(sets))
    around = F.sum("_sq") - F.coalesce(F.try_divide(F.sum("_off") * F.sum("_off"), F.sum("_known")), F.lit(0.0))
    return rows.groupBy(*keys, "_period", "_set", *marks).agg(*_summed(), F.greatest(around, F.lit(0.0)).alias("_m2"))
