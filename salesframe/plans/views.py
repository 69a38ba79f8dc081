"""The given tables seen as sales tables and question tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def sales(spark: SparkSession, folder: str) -> DataFrame:
    """One row per order: Date, Sales, Category, Region, Nation."""
    orders = table(spark, folder, "orders").select(
        "o_orderkey", F.col("o_custkey").alias("c_custkey"),
        F.to_date("o_orderdate").alias("Date"), F.col("o_totalprice").alias("Sales"),
    )
    customer = table(spark, folder, "customer").select(
        "c_custkey", F.col("c_mktsegment").alias("Category"), "c_nationkey")
    nation = table(spark, folder, "nation").select(
        F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("Nation"),
        F.col("n_regionkey").alias("r_regionkey"))
    region = table(spark, folder, "region").select("r_regionkey", F.col("r_name").alias("Region"))
    return (
        orders.join(customer.join(nation, "c_nationkey").join(region, "r_regionkey"), "c_custkey")
        .select("o_orderkey", "Date", "Sales", "Category", "Region", "Nation")
    )


def sales_with_items(spark: SparkSession, folder: str) -> DataFrame:
    """``sales`` with Orders (line count) and Returns (returned lines)."""
    lines = table(spark, folder, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.count(F.lit(1)).alias("Orders"),
        F.count_if(F.col("l_returnflag") == "R").alias("Returns"),
    )
    return sales(spark, folder).join(lines, "o_orderkey", "left").fillna(0, ["Orders", "Returns"])


def item_sales(spark: SparkSession, folder: str) -> DataFrame:
    """One row per line item: Date, Sales, Brand, Product."""
    lines = table(spark, folder, "lineitem").select(
        F.col("l_partkey").alias("p_partkey"), F.to_date("l_shipdate").alias("Date"),
        F.col("l_extendedprice").alias("Sales"),
    )
    part = table(spark, folder, "part").select(
        "p_partkey", F.col("p_brand").alias("Brand"), F.col("p_type").alias("Product"))
    return lines.join(part, "p_partkey").select("Date", "Sales", "Brand", "Product")


def dirty(spark: SparkSession, folder: str) -> DataFrame:
    """``sales`` with planted defects: currency text, nulls, copies, spikes, bad dates."""
    key = F.col("o_orderkey")
    cents = F.round(F.col("Sales") * 100).cast("long") * F.when(key % 997 == 0, 20).otherwise(1)
    text = lambda unit, digits, suffix: F.concat(
        F.lit("₹"), F.expr(f"cents div {unit * 10**digits}").cast("string"), F.lit("."),
        F.lpad(F.expr(f"(cents div {unit}) % {10**digits}").cast("string"), digits, "0"), F.lit(suffix),
    )
    amount = (
        F.when(key % 37 == 0, F.lit(None).cast("string"))
        .otherwise(F.concat(
            F.when(key % 43 == 0, F.lit("-")).otherwise(F.lit("")),
            F.when(key % 5 == 1, text(1000, 2, "k")).when(key % 5 == 2, text(10000, 3, "L"))
            .when(key % 5 == 3, text(100000, 4, "Cr")).otherwise(text(1, 2, "")),
        ))
    )
    return (
        sales(spark, folder).withColumn("cents", cents)
        .select(
            F.col("o_orderkey").alias("order_id"),
            F.when(key % 61 == 0, F.lit("n/a")).otherwise(F.col("Date").cast("string")).alias("Order Date"),
            amount.alias("Revenue"),
            F.when(key % 41 == 0, F.lit(None).cast("string")).otherwise(F.col("Category")).alias("Category"),
            "Region",
            F.when(key % 29 == 0, F.lit(None).cast("long")).otherwise(key % 50).alias("Units"),
            F.explode(F.sequence(F.lit(1), F.when(key % 53 == 0, 2).otherwise(1))).alias("_copy"),
        )
        .drop("_copy")
    )


# Phrases put behind the conversation texts.
PHRASES = [
    "", "forecast next month", "forecast next 2 years", "Forecast ASIA region for next 18 months",
    "show trend", "detect anomaly", "What columns and missing values are in my data?",
    "Which model is best and what is MAPE?", "Forecast by category for next 2 years",
    "show monthly sales by category", "sales by region", "compare last 3 months",
    "worst region", "best category", "what if marketing grows", "total sales",
    "forecast BUILDING for the next twenty-four months", "top product", "lowest month",
    "Give me business recommendations", "forecast for every category", "NATION_7 next 4 months forecast",
    "best month", "compare sales with last month", "best region", "weakest category",
]


def questions(spark: SparkSession, folder: str) -> DataFrame:
    """Conversation turns with a business phrase behind the whole text."""
    phrases = F.array(*[F.lit(p) for p in PHRASES])
    slot = ((F.col("conv_id") * 7 + F.col("turn")) % len(PHRASES)).cast("int")
    return table(spark, folder, "conversations").select(
        "conv_id", "turn",
        F.concat_ws(" ", F.col("text"), F.get(phrases, slot)).alias("question"),
    )


def with_nan(spark: SparkSession, folder: str) -> DataFrame:
    """Order numbers and amounts of ``dirty_typed``, every seventh order's amount NaN."""
    return dirty_typed(spark, folder).select("order_id", F.when(
        F.col("order_id") % 7 == 0, F.lit(float("nan"))).otherwise(F.col("Revenue")).alias("Revenue"))


def dirty_typed(spark: SparkSession, folder: str) -> DataFrame:
    """``dirty`` with its amounts and dates read."""
    from ..operators.clean import parse_amounts, parse_dates
    return parse_dates(parse_amounts(dirty(spark, folder), ["Revenue"]), ["Order Date"])
