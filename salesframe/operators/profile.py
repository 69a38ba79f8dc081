"""Schema summary, validation checks and the cleaning report."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import ROW_HASH, attach, nan_to_null, pct, row_hash
from .anomaly import iqr_outlier_count
from .cube import roll_up
from .rollup import missing_periods, monthly_totals

def _q(name: str) -> Column:
    return F.col(f"`{name}`")


def _nulls(c: str) -> Column:
    return F.count_if(_q(c).isNull())


def _profile(df: DataFrame, **marks: Column) -> DataFrame:
    """One row: ``_rows``, ``_duplicates``, ``_nulls`` and the number of rows of which each of ``marks`` is true.

    One pass: what is counted of a row rides along with the row's hash, under which copies meet, so no
    whole row is shuffled.
    """
    df = nan_to_null(df)
    nulls = sum((_q(c).isNull().cast("int") for c in df.columns), F.lit(0))
    marks = {"_nulls": nulls} | {n: F.coalesce(m, F.lit(False)).cast("int") for n, m in marks.items()}
    copies = df.select(*row_hash(df), *[m.alias(n) for n, m in marks.items()]).groupBy(*ROW_HASH).agg(
        F.count(F.lit(1)).alias("_c"), *[F.first(n).alias(n) for n in marks])
    return copies.agg(
        F.coalesce(F.sum("_c"), F.lit(0)).alias("_rows"), F.coalesce(F.sum(F.col("_c") - 1), F.lit(0)).alias("_duplicates"),
        *[F.coalesce(F.sum(F.col("_c") * F.col(n)), F.lit(0)).alias(n) for n in marks])


def _lines(one: DataFrame, lines: Sequence[tuple[str, Column, Column]]) -> DataFrame:
    """Turn one wide row into (check, level, metric) rows."""
    return one.select(F.explode(F.array(*[
        F.struct(F.lit(name).alias("check"), level.alias("level"), metric.cast("double").alias("metric"))
        for name, level, metric in lines
    ])).alias("_l")).select("_l.*")


def schema_summary(df: DataFrame) -> DataFrame:
    """One row per column: type, missing values, smallest value as a sample; table sizes beside."""
    kinds = dict(df.dtypes)
    known = nan_to_null(df)
    one = attach(_profile(df), known.agg(*[
        e for i, c in enumerate(df.columns)
        for e in (_nulls(c).alias(f"_n{i}"), F.min(_q(c)).cast("string").alias(f"_s{i}"))
    ]), ())
    rows = F.array(*[
        F.struct(F.lit(i + 1).cast("long").alias("position"), F.lit(c).alias("column"),
                 F.lit(kinds[c]).alias("dtype"), F.col(f"_n{i}").cast("long").alias("missing"),
                 F.col(f"_s{i}").alias("sample"))
        for i, c in enumerate(df.columns)
    ])
    return one.select("_rows", "_duplicates", F.explode(rows).alias("_r")).select(
        "_r.*", F.col("_rows").cast("long").alias("rows"), F.col("_duplicates").cast("long").alias("duplicates"))


def missing_values(df: DataFrame) -> DataFrame:
    """``column`` and ``missing`` of every column, from one pass that shuffles one row a task."""
    one = nan_to_null(df).agg(*[_nulls(c).alias(f"_n{i}") for i, c in enumerate(df.columns)])
    return one.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(f"_n{i}").cast("long").alias("missing")) for i, c in enumerate(df.columns)])))


def _level(ok: Column, warn: Column | None = None, otherwise: str = "warn") -> Column:
    out = F.when(ok, "ok")
    if warn is not None:
        out = out.when(warn, "warn")
    return out.otherwise(otherwise)


def _common(df: DataFrame, date_col: str | None, value_col: str | None,
            absent: str) -> tuple[dict[str, Column], list[tuple[str, Column, Column]]]:
    rows, share = F.col("_rows"), pct(F.col("_nulls"), F.col("_rows") * len(df.columns))
    found = lambda c: (F.lit("ok" if c else absent), F.lit(1 if c else 0))
    lines = [
        ("rows", _level(rows >= 100, rows >= 30, "error"), rows),
        ("date_column", *found(date_col)),
        ("target_column", *found(value_col)),
        ("missing_values", _level(share == 0, share < 20, "error"), F.col("_nulls")),
        ("duplicate_rows", _level(F.col("_duplicates") == 0), F.col("_duplicates")),
    ]
    extra = {}
    if value_col:
        extra["_negatives"] = _q(value_col).try_cast("double") < 0
        lines.append(("negative_values", _level(F.col("_negatives") == 0), F.col("_negatives")))
    return extra, lines


def validation_checks(df: DataFrame, date_col: str | None, value_col: str | None) -> DataFrame:
    """Checks of a whole table as (check, level, metric)."""
    extra, lines = _common(df, date_col, value_col, "warn")
    one = _profile(df, **extra)
    if value_col:
        one = attach(one, iqr_outlier_count(df.select(_q(value_col).try_cast("double").alias("_v")), "_v", name="_outliers"), ())
        lines.append(("outliers", _level(F.col("_outliers") == 0), F.col("_outliers")))
    return _lines(one, lines)


def forecast_checks(df: DataFrame, date_col: str | None, value_col: str | None,
                    category_col: str = "Category") -> DataFrame:
    """Checks before forecasting: months of history, gaps, repeated date-category rows.

    Two passes: the profile, and a roll-up by date and category for everything that is counted per date.
    """
    extra, lines = _common(df, date_col, value_col, "error")
    one = _profile(df, **extra)
    by_category = bool(date_col) and category_col in df.columns
    if date_col:
        value = _q(value_col).try_cast("double") if value_col else F.lit(None).cast("double")
        cube = roll_up(df.select(_q(date_col).alias("Date"), value.alias("Sales"), *([_q(category_col).alias("_c")] if by_category else [])),
                       (), ["_c"] if by_category else [], "date")
    if date_col and value_col:
        typed = cube.periods().filter("_known > 0").select(F.col("Date").cast("date").alias("Date"), "Sales").dropna()
        months = monthly_totals(typed).agg(F.count(F.lit(1)).alias("_months"))
        gaps = missing_periods(typed).agg(F.count(F.lit(1)).alias("_gaps"))
        one = attach(attach(one, months, ()), gaps, ())
        lines += [
            ("monthly_history", _level(F.col("_months") >= 12, F.col("_months") >= 6, "error"), F.col("_months")),
            ("monthly_gaps", _level(F.col("_gaps") == 0), F.col("_gaps")),
        ]
    if by_category:
        again = cube.by("_c").agg(F.coalesce(F.sum(F.col("_rows") - 1), F.lit(0)).alias("_repeats"))
        one = attach(one, again, ())
        lines.append(("repeated_date_category", _level(F.col("_repeats") == 0), F.col("_repeats")))
    return _lines(one, lines)


def cleaning_report(raw: DataFrame, clean: DataFrame, date_col: str, value_col: str) -> DataFrame:
    """Before and after: rows, duplicates, nulls fixed, columns converted, outliers of the raw target."""
    kinds = {f.name: f.dataType.typeName() for f in raw.schema}
    before = _profile(raw)
    after = clean.agg(
        F.count(F.lit(1)).alias("rows_after"),
        sum((F.count_if(_q(c).isNull()) for c in clean.columns), F.lit(0)).alias("_nulls_after"),
    )
    one = attach(before, after, ())
    is_number = kinds.get(value_col) in ("double", "float", "integer", "long", "short", "decimal")
    converted = int(date_col != "Date" or kinds[date_col] in ("date", "timestamp", "timestamp_ntz")) + int(
        value_col != "Sales" or is_number)
    if is_number:
        one = attach(one, iqr_outlier_count(raw.select(_q(value_col).cast("double").alias("_v")), "_v", name="_out"), ())
    else:
        one = one.withColumn("_out", F.lit(0))
    enough = F.col("_rows") - 0 >= 4
    return one.select(
        F.col("_rows").cast("long").alias("rows_before"), "rows_after",
        F.col("_duplicates").cast("long").alias("duplicates_removed"),
        F.greatest(F.col("_nulls") - F.col("_nulls_after"), F.lit(0)).cast("long").alias("missing_fixed"),
        F.lit(converted).cast("long").alias("columns_converted"),
        F.when(enough, F.col("_out")).otherwise(0).cast("long").alias("outliers_detected"),
    )
