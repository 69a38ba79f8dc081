"""Roll-ups of a sales table by period and business dimension."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations_with_replacement

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import arrays as A
from ..functions import labels as L
from ..functions.exprs import (
    attach, known_keys, month_of, nz_sum, pct, pct_change, per_series, staged,
)
from ..session import settle
from .cube import Cube
from .ordered import with_position


def period_totals(df: DataFrame, unit: str = "month", keys: Sequence[str] = (),
                  date_col: str = "Date", value_col: str = "Sales") -> DataFrame:
    """Totals per ``month``, ``week`` (Monday start) or ``year``; only periods with rows."""
    if unit == "year":
        period = F.year(date_col).cast("long").alias("Year")
    else:
        period = F.date_trunc(unit, F.col(date_col).cast("timestamp")).cast("date").alias("Date")
    rows = known_keys(df, keys).filter(F.col(date_col).isNotNull())
    return rows.groupBy(*keys, period).agg(nz_sum(value_col).alias("Sales"))


def monthly_totals(df: DataFrame, keys: Sequence[str] = (), date_col: str = "Date",
                   value_col: str = "Sales") -> DataFrame:
    return period_totals(df, "month", keys, date_col, value_col)


def dimension_totals(df: DataFrame, dims: Sequence[str], value_col: str = "Sales") -> DataFrame:
    return known_keys(df, dims).groupBy(*dims).agg(nz_sum(value_col).alias("Sales"))


def dimension_share(df: DataFrame, dim: str, keys: Sequence[str] = (),
                    value_col: str = "Sales") -> DataFrame:
    """Totals per value of ``dim`` with the share of the series total in percent."""
    totals = dimension_totals(df, [*keys, dim], value_col)
    whole = totals.groupBy(*keys).agg(F.sum("Sales").alias("_whole"))
    return attach(totals, whole, keys).select(
        *keys, dim, "Sales", pct(F.col("Sales"), F.col("_whole")).alias("Share")
    )


def month_by_dimension(df: DataFrame, dim: str, date_col: str = "Date",
                       value_col: str = "Sales") -> DataFrame:
    """Month × dimension totals, ranked in each month.

    ``strongest`` marks the largest cell of the table, ``latest_leader`` the top
    value of the latest month.
    """
    cells = settle(
        known_keys(df, [dim]).groupBy(month_of(date_col).alias("Date"), dim)
        .agg(nz_sum(value_col).alias("Sales")), "cells")
    tops = cells.agg(
        F.min(F.struct(-F.col("Sales"), F.col("Date"), F.col(dim))).alias("_top"),
        F.min(F.struct((-F.unix_date("Date")), -F.col("Sales"), F.col(dim))).alias("_last"),
    ).select(
        F.col("_top.Date").alias("_top_date"), F.col(f"_top.{dim}").alias("_top_dim"),
        F.col(f"_last.{dim}").alias("_last_dim"),
        F.date_from_unix_date(-F.col("_last.col1")).alias("_last_date"),
    )
    # a month may have any number of values: ranks come from ranges of (month, sales, value), not from a window per month
    ranked = with_position(cells.withColumn("_less", -F.col("Sales")), ["_less", dim], ["Date"], "rank")
    return attach(ranked, tops, ()).select(
        "Date", dim, "Sales", F.col("rank").cast("long").alias("rank"),
        ((F.col("Date") == F.col("_top_date")) & (F.col(dim) == F.col("_top_dim"))).alias("strongest"),
        ((F.col("Date") == F.col("_last_date")) & (F.col(dim) == F.col("_last_dim"))).alias("latest_leader"),
    )


def cross_tab(df: DataFrame, row: str, column: str, values: Sequence[str] | None = None,
              value_col: str = "Sales") -> DataFrame:
    """Totals with one column per value of ``column``; empty cells are 0.

    Pass ``values`` when they are known: it saves the job that looks them up.
    """
    grouped = known_keys(df, [row, column]).groupBy(row)
    wide = grouped.pivot(column, list(values)) if values else grouped.pivot(column)
    return wide.agg(F.sum(value_col)).fillna(0.0)


def segment_share(df: DataFrame, dim: str, date_col: str = "Date",
                  value_col: str = "Sales") -> DataFrame:
    """Each segment's months beside the month totals: share and month-over-month."""
    rows = df.filter(F.col(date_col).isNotNull())
    cells = (
        rows.groupBy(dim, month_of(date_col).alias("Date")).agg(nz_sum(value_col).alias("Sales"))
    )
    whole = cells.groupBy("Date").agg(F.sum("Sales").alias("Total"))
    before = F.lag("Sales").over(per_series([dim], "Date"))
    return (
        known_keys(cells, [dim]).withColumn("_before", before)
        .join(whole, "Date", "left")
        .select(
            dim, "Date", "Sales", "Total",
            F.when(F.col("Total") > 0, F.col("Sales") / F.col("Total") * 100).otherwise(0.0).alias("Share"),
            F.when(F.col("_before").isNotNull(), pct_change(F.col("Sales"), F.col("_before"))).alias("MoM"),
        )
    )


def calendar(df: DataFrame, keys: Sequence[str] = (), unit: str = "month",
             date_col: str = "Date") -> DataFrame:
    """Every period between the first and last one of each series."""
    trunc = F.date_trunc(unit, F.col(date_col).cast("timestamp")).cast("date")
    step = {"month": "interval 1 month", "week": "interval 7 days", "day": "interval 1 day"}[unit]
    span = known_keys(df, keys).filter(F.col(date_col).isNotNull()).groupBy(*keys).agg(
        F.min(trunc).alias("_lo"), F.max(trunc).alias("_hi")
    ).filter(F.col("_lo").isNotNull())
    return span.select(*keys, F.explode(F.sequence("_lo", "_hi", F.expr(step))).alias("Date"))


def missing_periods(df: DataFrame, keys: Sequence[str] = (), unit: str = "month",
                    date_col: str = "Date", value_col: str = "Sales") -> DataFrame:
    totals = period_totals(df, unit, keys, date_col, value_col)
    return calendar(df, keys, unit, date_col).join(totals, [*keys, "Date"], "left_anti")


def fill_calendar(totals: DataFrame, keys: Sequence[str] = (), unit: str = "month",
                  fill: float | None = 0.0) -> DataFrame:
    """Series with every period present; absent ones get ``fill``."""
    full = calendar(totals, keys, unit).join(totals, [*keys, "Date"], "left")
    return full if fill is None else full.fillna(fill, subset=["Sales"])


def histogram(df: DataFrame, value_col: str = "Sales", bins: int = 30,
              keys: Sequence[str] = ()) -> DataFrame:
    """Counts in ``bins`` equal-width bins; the upper edge belongs to the last bin."""
    rows = known_keys(df, keys).filter(F.col(value_col).isNotNull())
    span = rows.groupBy(*keys).agg(F.min(value_col).alias("_lo"), F.max(value_col).alias("_hi"))
    width = (F.col("_hi") - F.col("_lo")) / bins
    slot = F.when(F.col("_hi") > F.col("_lo"), F.least(
        F.floor(F.try_divide(F.col(value_col) - F.col("_lo"), width)) + 1, F.lit(bins)
    )).otherwise(1)
    counts = (
        attach(rows, span, keys).groupBy(*keys, slot.cast("int").alias("bin"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    grid = span.select(*keys, "_lo", width.alias("_width"),
                       F.explode(F.sequence(F.lit(1), F.lit(bins))).alias("bin"))
    return grid.join(counts, [*keys, "bin"], "left").select(
        *keys, F.col("bin").cast("long").alias("bin"),
        (F.col("_lo") + F.col("_width") * (F.col("bin") - 1)).alias("bin_start"),
        (F.col("_lo") + F.col("_width") * F.col("bin")).alias("bin_end"),
        F.coalesce("n", F.lit(0)).cast("long").alias("n"),
    )


def correlation(df: DataFrame, columns: Sequence[str], target: str = "Sales",
                keys: Sequence[str] = ()) -> DataFrame:
    """Pearson matrix in long form, with strength and rank of each column against the target."""
    pairs = [(a, b) for a, b in combinations_with_replacement(columns, 2)]
    wide = known_keys(df, keys).groupBy(*keys).agg(*[
        F.corr(F.col(a).cast("double"), F.col(b).cast("double")).alias(f"_r{i}")
        for i, (a, b) in enumerate(pairs)
    ])
    cells = [
        F.struct(F.lit(x).alias("a"), F.lit(y).alias("b"), F.col(f"_r{i}").alias("r"))
        for i, (a, b) in enumerate(pairs)
        for x, y in ([(a, b)] if a == b else [(a, b), (b, a)])
    ]
    long = wide.select(*keys, F.explode(F.array(*cells)).alias("_c")).select(
        *keys, F.col("_c.a").alias("column_a"), F.col("_c.b").alias("column_b"),
        F.col("_c.r").alias("r"),
    )
    is_rank = (F.col("column_a") == target) & (F.col("column_b") != target) & F.col("r").isNotNull()
    rank = F.row_number().over(
        per_series([*keys, "_is_rank"], F.abs("r").desc(), F.col("column_b"))
    )
    return long.withColumn("_is_rank", is_rank).select(
        *keys, "column_a", "column_b", "r",
        L.correlation_label(F.col("r")).alias("strength"),
        F.when(F.col("_is_rank"), rank.cast("long")).alias("target_rank"),
    )


def level_counts(df: DataFrame, dim: str) -> DataFrame:
    return known_keys(df, [dim]).groupBy(dim).agg(F.count(F.lit(1)).alias("n"))


def recent_days(df: DataFrame | Cube, keys: Sequence[str] = (), days: int = 30,
                date_col: str = "Date", value_col: str = "Sales") -> DataFrame:
    """Sum of the last ``days`` days against the ``days`` before them.

    Daily totals are made first, so the look-back runs over calendar rows only. A cube must be one by day.
    """
    if isinstance(df, Cube):
        df, date_col, value_col = df.periods(), "Date", "Sales"
    daily = (
        known_keys(df, keys).filter(F.col(date_col).isNotNull())
        .groupBy(*keys, F.col(date_col).cast("date").alias("_day"))
        .agg(nz_sum(value_col).alias("_s"), F.count(F.lit(1)).alias("_n"))
    )
    last = daily.groupBy(*keys).agg(F.max("_day").alias("last_day"))
    edge, start = F.date_sub("last_day", days), F.date_sub("last_day", 2 * days)
    recent = F.col("_day") >= edge
    prior = (F.col("_day") < edge) & (F.col("_day") >= start)
    sums = attach(daily, last, keys).groupBy(*keys).agg(
        F.max("last_day").alias("last_day"),
        F.sum(F.when(recent, F.col("_s"))).alias("recent_sales"),
        F.sum(F.when(prior, F.col("_s"))).alias("prior_sales"),
    )
    return sums.withColumn(
        "change_pct",
        F.when(F.col("prior_sales").isNotNull() & F.col("recent_sales").isNotNull(),
               pct_change(F.col("recent_sales"), F.col("prior_sales"))),
    )


# ---------------------------------------------------------------------------
# One wide row of facts per series, from one scan.

def _with_series_facts(df: DataFrame) -> DataFrame:
    """Facts of the month-ordered array ``_s`` of (Date, Sales)."""
    df = staged(df, {
        "_y": "transform(_s, e -> e.Sales)",
        "months": "CAST(size(_s) AS BIGINT)",
        "_best": "array_min(transform(_s, e -> named_struct('k', -e.Sales, 'd', e.Date)))",
        "_worst": "array_min(transform(_s, e -> named_struct('k', e.Sales, 'd', e.Date)))",
    })
    n = "size(_y)"
    at = lambda k, field: f"get(_s, {n} - {k}).{field}"
    df = staged(df, {
        "month_avg": A.mean("_y"), "month_std": A.std_samp("_y"),
        "best_month": "_best.d", "best_sales": "-_best.k",
        "worst_month": "_worst.d", "worst_sales": "_worst.k",
        "latest_month": at(1, "Date"), "latest_sales": at(1, "Sales"),
        "previous_month": at(2, "Date"), "previous_sales": at(2, "Sales"),
        "before_previous_sales": at(3, "Sales"),
        "first3": A.mean("slice(_y, 1, 3)"), "last3": A.mean(A.tail("_y", 3)),
        "prev3": f"CASE WHEN {n} >= 6 THEN {A.mean(f'slice(_y, {n} - 5, 3)')} "
                 f"WHEN {n} > 3 THEN {A.mean(f'slice(_y, 1, {n} - 3)')} END",
        "first_half": f"CASE WHEN {n} >= 6 THEN {A.mean(f'slice(_y, 1, CAST({n} div 2 AS INT))')} END",
        "second_half": f"CASE WHEN {n} >= 6 THEN {A.mean(f'slice(_y, CAST({n} div 2 + 1 AS INT), {n})')} END",
    }).drop("_best", "_worst")
    change = lambda new, old: f"coalesce(try_divide({new} - {old}, {old}), 0D) * 100"
    return staged(df, {
        "cv": "CASE WHEN month_avg > 0 THEN coalesce(month_std / month_avg, 0D) * 100 ELSE 0D END",
        "growth_3": f"CASE WHEN months >= 2 THEN {change('last3', 'first3')} ELSE 0D END",
        "growth_half": f"CASE WHEN months >= 6 THEN {change('second_half', 'first_half')} END",
        "momentum": f"CASE WHEN months >= 4 THEN {change('last3', 'prev3')} END",
        "mom": f"CASE WHEN months >= 2 THEN {change('latest_sales', 'previous_sales')} END",
    })


def _fact_totals(df: DataFrame, keys: list[str], dims: list[str], date_col: str, value_col: str) -> DataFrame:
    rows = known_keys(df, keys).filter(F.col(date_col).isNotNull()).select(
        *keys, month_of(date_col).alias("_month"), F.col(date_col).cast("date").alias("_day"),
        F.col(value_col).cast("double").alias("_v"), *[F.col(d).alias(f"_d_{d}") for d in dims],
    )
    marks = ["_month", *[f"_d_{d}" for d in dims]]
    return rows.groupingSets(
        [[*keys, m] for m in marks], *[F.col(c) for c in [*keys, *marks]]
    ).agg(
        nz_sum("_v").alias("Sales"), F.count("_v").alias("_known"), F.count(F.lit(1)).alias("_rows"),
        F.min("_day").alias("_first"), F.max("_day").alias("_last"),
        *[F.grouping(m).alias(f"_g{i}") for i, m in enumerate(marks)],
    )


def business_facts(df: DataFrame | Cube, keys: Sequence[str] = (), dims: Sequence[str] = (),
                   date_col: str = "Date", value_col: str = "Sales") -> DataFrame:
    """One wide row per series: totals, month facts and the leaders of each dimension.

    One scan: grouping sets make month and dimension totals together, counted
    before the shuffle; what reaches the second step is one row per month or
    dimension value. From a cube of the same keys there is no scan at all.
    """
    keys, dims = list(keys), list(dims)
    totals = df.totals(dims) if isinstance(df, Cube) else _fact_totals(df, keys, dims, date_col, value_col)
    is_month = F.col("_g0") == 0
    aggs = [
        F.array_sort(F.collect_list(F.when(
            is_month, F.struct(F.col("_month").alias("Date"), F.col("Sales").alias("Sales"))
        ))).alias("_s"),
        F.sum(F.when(is_month, F.col("_rows"))).alias("rows"),
        F.sum(F.when(is_month, F.col("_known"))).alias("_known"),
        F.sum(F.when(is_month, F.col("Sales"))).alias("total"),
        F.min("_first").alias("first_day"), F.max("_last").alias("last_day"),
    ]
    for i, d in enumerate(dims, start=1):
        value = F.col(f"_d_{d}")
        mine = (F.col(f"_g{i}") == 0) & value.isNotNull()
        aggs += [
            F.min(F.when(mine, F.struct((-F.col("Sales")).alias("k"), value.alias("v")))).alias(f"_top_{d}"),
            F.min(F.when(mine, F.struct(F.col("Sales").alias("k"), value.alias("v")))).alias(f"_weak_{d}"),
            F.sum(F.when(mine, F.col("Sales"))).alias(f"_sum_{d}"),
            F.count(F.when(mine, F.lit(1))).alias(f"{d}_levels"),
        ]
    wide = totals.groupBy(*keys).agg(*aggs).withColumn(
        "row_avg", F.try_divide(F.col("total"), F.col("_known"))
    )
    wide = _with_series_facts(wide)
    for d in dims:
        wide = wide.withColumns({
            f"top_{d}": F.col(f"_top_{d}.v"),
            f"top_{d}_sales": -F.col(f"_top_{d}.k"),
            f"top_{d}_share": F.when(F.col(f"_top_{d}").isNotNull(), pct(-F.col(f"_top_{d}.k"), F.col(f"_sum_{d}"))),
            f"weak_{d}": F.col(f"_weak_{d}.v"),
            f"weak_{d}_sales": F.col(f"_weak_{d}.k"),
            f"weak_{d}_share": F.when(F.col(f"_weak_{d}").isNotNull(), pct(F.col(f"_weak_{d}.k"), F.col(f"_sum_{d}"))),
        }).drop(f"_top_{d}", f"_weak_{d}", f"_sum_{d}")
    return wide.filter(F.col("months") > 0).drop("_known")


def dataset_summary(df: DataFrame, keys: Sequence[str] = (), date_col: str = "Date",
                    value_col: str = "Sales") -> DataFrame:
    facts = business_facts(df, keys, (), date_col, value_col)
    return facts.select(
        *keys, "rows", "total", "row_avg", "first_day", "last_day", "months", "month_avg",
        "best_month", "best_sales", "worst_month", "worst_sales", "latest_month", "latest_sales",
    )


def uplift(df: DataFrame, keys: Sequence[str] = (), factor: float = 1.2) -> DataFrame:
    """Flat what-if: totals and monthly average times ``factor``."""
    return business_facts(df, keys).select(
        *keys, "total", (F.col("total") * factor).alias("uplift_total"),
        (F.col("total") * factor - F.col("total")).alias("extra_total"),
        "month_avg", (F.col("month_avg") * factor).alias("uplift_month_avg"),
    )


def latest_change_by(df: DataFrame, dim: str, keys: Sequence[str] = (), date_col: str = "Date",
                     value_col: str = "Sales") -> DataFrame:
    """Change of each dimension value between the two latest months with rows.

    A value absent from one of the months counts as 0 there.
    """
    cells = (
        known_keys(df, keys).filter(F.col(date_col).isNotNull())
        .groupBy(*keys, month_of(date_col).alias("_month"), F.col(dim).alias("_dim"))
        .agg(nz_sum(value_col).alias("Sales"))
    )
    months = cells.groupBy(*keys, "_month").agg(F.sum("Sales").alias("Sales"))
    last_two = F.slice(F.reverse(F.array_sort(F.collect_list(F.struct("_month", "Sales")))), 1, 2)
    ends = months.groupBy(*keys).agg(last_two.alias("_m")).filter(F.size("_m") == 2).select(
        *keys, F.col("_m")[0]["_month"].alias("_now"), F.col("_m")[1]["_month"].alias("_then"),
        (F.col("_m")[0]["Sales"] - F.col("_m")[1]["Sales"]).alias("total_change"),
    )
    sided = F.when(F.col("_month") == F.col("_now"), F.col("Sales")).when(
        F.col("_month") == F.col("_then"), -F.col("Sales"))
    return (
        attach(cells.filter(F.col("_dim").isNotNull()), ends, keys)
        .filter(F.col("_month").isin(F.col("_now"), F.col("_then")))
        .groupBy(*keys, F.col("_dim").alias(dim))
        .agg(F.sum(sided).alias("change"), F.max("total_change").alias("total_change"))
    )


def main_driver(df: DataFrame, dim: str, keys: Sequence[str] = (), date_col: str = "Date",
                value_col: str = "Sales") -> DataFrame:
    """The value that lost most when the total fell, or gained most when it rose."""
    change = latest_change_by(df, dim, keys, date_col, value_col)
    worst = F.min(F.struct(F.col("change").alias("k"), F.col(dim).alias("v")))
    best = F.min(F.struct((-F.col("change")).alias("k"), F.col(dim).alias("v")))
    picked = change.groupBy(*keys).agg(
        F.max("total_change").alias("total_change"), worst.alias("_w"), best.alias("_b")
    )
    fell, rose = F.col("total_change") < 0, F.col("total_change") > 0
    return picked.filter(fell | rose).select(
        *keys, "total_change",
        F.when(fell, F.col("_w.v")).otherwise(F.col("_b.v")).alias("subject"),
        F.when(fell, F.col("_w.k")).otherwise(-F.col("_b.k")).alias("change"),
    )
