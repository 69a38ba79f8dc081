"""Best, weakest and top-n."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import pct
from .rollup import business_facts, dimension_totals

# The names tried first, then the words looked for in any name.
PRODUCT_COLUMNS = ["Product", "Product Name", "Item", "Item Name", "SKU", "Category"]
PRODUCT_WORDS = ["product", "item", "sku", "category", "brand"]


def product_dimension(df: DataFrame) -> str | None:
    """The most product-like column of a table."""
    by_lower = {c.lower(): c for c in df.columns}
    named = [by_lower[c.lower()] for c in PRODUCT_COLUMNS if c.lower() in by_lower]
    worded = [c for c in df.columns if any(w in c.lower() for w in PRODUCT_WORDS)]
    return next(iter(named + worded), None)


def rank_dimension(df: DataFrame, dim: str | None = None, keys: Sequence[str] = (),
                   value_col: str = "Sales") -> DataFrame:
    """Best and weakest value of a dimension with their shares, per series."""
    dim = dim or product_dimension(df)
    if dim is None:
        raise ValueError("no product-like column; name the dimension")
    ends = dimension_totals(df, [*keys, dim], value_col).groupBy(*keys).agg(
        F.min(F.struct((-F.col("Sales")).alias("k"), F.col(dim).alias("v"))).alias("_b"),
        F.min(F.struct(F.col("Sales").alias("k"), F.col(dim).alias("v"))).alias("_w"),
        F.sum("Sales").alias("_whole"),
    )
    rows = F.array(
        F.struct(F.lit("best").alias("mode"), F.col("_b.v").alias("v"), (-F.col("_b.k")).alias("s")),
        F.struct(F.lit("weakest").alias("mode"), F.col("_w.v").alias("v"), F.col("_w.k").alias("s")),
    )
    return ends.filter(F.col("_whole").isNotNull()).select(
        *keys, "_whole", F.explode(rows).alias("_r")
    ).select(
        *keys, F.col("_r.mode").alias("mode"), F.col("_r.v").alias(dim),
        F.col("_r.s").alias("Sales"), pct(F.col("_r.s"), F.col("_whole")).alias("Share"),
    )


def best_worst_month(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Best and weakest month of each series, the earliest on ties."""
    return business_facts(df, keys).select(
        *keys, "best_month", "best_sales", "worst_month", "worst_sales"
    )


def top_groups(df: DataFrame, dims: Sequence[str], n: int = 8, keys: Sequence[str] = (),
               value_col: str = "Sales") -> DataFrame:
    """The ``n`` largest groups by total, per series."""
    totals = dimension_totals(df, [*keys, *dims], value_col)
    order = [F.col("Sales").desc(), *[F.col(d) for d in dims]]
    if not keys:
        return totals.orderBy(*order).limit(n)
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return totals.withColumn("_p", place).filter(F.col("_p") <= n).drop("_p")


def rows_of_top_groups(df: DataFrame, dims: Sequence[str], n: int = 8,
                       value_col: str = "Sales") -> DataFrame:
    """The raw rows of the ``n`` largest groups."""
    return df.join(top_groups(df, dims, n, (), value_col).select(*dims), list(dims), "left_semi")


def preview(df: DataFrame, order: Sequence[str], n: int = 10, last: bool = False) -> DataFrame:
    """First or last ``n`` rows in the given order."""
    return df.orderBy(*[F.col(c).desc() if last else F.col(c) for c in order]).limit(n)
