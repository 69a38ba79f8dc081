"""Column expressions shared by the operators."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ratio(num: Column, den: Column) -> Column:
    """``num / den``, or 0 where that is undefined."""
    return F.coalesce(F.try_divide(num, den), F.lit(0.0))


def pct(part: Column, whole: Column) -> Column:
    return ratio(part, whole) * 100


def pct_change(new: Column, old: Column) -> Column:
    """Change from ``old`` to ``new`` in percent, 0 where ``old`` is 0."""
    return ratio(new - old, old) * 100


def clip(c: Column, lo: float, hi: float) -> Column:
    return F.least(F.greatest(c, F.lit(lo)), F.lit(hi))


def nz_sum(c: Column | str) -> Column:
    """Sum that is 0, not NULL, when every value is missing."""
    return F.coalesce(F.sum(c), F.lit(0.0))


def month_of(c: Column | str) -> Column:
    return F.trunc(col(c), "month")


def per_series(keys: Sequence[str], *order: Column | str) -> WindowSpec:
    """Window over one series of period totals.

    Only for tables already rolled up to periods: a series then holds one row
    per period, so a partition is bounded by the calendar, whatever the data.
    """
    spec = Window.partitionBy(*(keys or [F.lit(1)]))
    return spec.orderBy(*order) if order else spec


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN counts as missing everywhere: floating columns hold NULL in its place."""
    floats = [f"`{n}`" for n, t in df.dtypes if t in ("double", "float")]
    return df.withColumns({c.strip("`"): F.when(~F.isnan(c), F.col(c)) for c in floats}) if floats else df


def known_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose keys are all present, NaN as NULL; unknown groups are not series."""
    for key in keys:
        df = df.filter(F.col(key).isNotNull())
    return nan_to_null(df)


ROW_HASH = ["_hash_a", "_hash_b"]


def row_hash(df: DataFrame) -> list[Column]:
    """128 bits that tell rows apart by all their columns, without making a text of a row.

    Two 64-bit hashes that run through the columns in opposite order, after the pattern of nulls. Nested
    columns are hashed as JSON. Where unequal rows must never meet, compare the rows of equal hashes.
    """
    flat = [F.to_json(F.struct(F.col(f"`{c}`"))) if any(k in t for k in ("<", "variant")) else F.col(f"`{c}`") for c, t in df.dtypes]
    nulls = F.concat(F.lit(""), *[F.when(F.col(f"`{c}`").isNull(), "1").otherwise("0") for c in df.columns])
    return [F.xxhash64(F.lit(1), nulls, *flat).alias(ROW_HASH[0]), F.xxhash64(F.lit(2), *reversed(flat), nulls).alias(ROW_HASH[1])]


def attach(df: DataFrame, stats: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Put per-series statistics (one row per key) beside every row.

    With keys this is a plain equi-join that adaptive execution may broadcast
    or split. Without keys the one row becomes a scalar subquery, so nothing is
    joined at all.
    """
    if keys:
        return df.join(stats, on=list(keys), how="left")
    fields = [c for c in stats.columns]
    one = stats.select(F.struct(*fields).alias("_stats"))
    return (
        df.withColumn("_stats", one.scalar())
        .withColumns({c: F.col(f"_stats.{c}") for c in fields})
        .drop("_stats")
    )


def staged(df: DataFrame, columns: Mapping[str, str]) -> DataFrame:
    """Add columns, given as SQL text, that are worked out once per row.

    Plain projections may be merged, and an array expression that a later lambda
    mentions would then run again for each element. Unpacking a one-element array
    keeps the two steps apart; it moves no rows.
    """
    fields = ", ".join(f"'{name}', {text}" for name, text in columns.items())
    kept = [f"`{c}`" for c in df.columns if c not in columns]
    return df.selectExpr(*kept, f"inline(array(named_struct({fields})))")
