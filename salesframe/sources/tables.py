"""Reading and writing tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.exprs import nan_to_null

CORRUPT = "_corrupt_record"


def read_table(spark: SparkSession, path: str, file_format: str | None = None,
               schema: StructType | str | None = None) -> tuple[DataFrame | None, str | None]:
    """Open a CSV or Parquet table: ``(table, None)``, or ``(None, message)`` if it cannot be opened.

    NaN is read as missing.

    A given ``schema`` saves the pass that infers types. Lines that do not fit it
    are kept in ``_corrupt_record`` when the schema has that column.
    """
    kind = file_format or ("parquet" if path.rstrip("/").endswith(".parquet") else "csv")
    reader = spark.read.format(kind)
    if kind == "csv":
        reader = reader.option("header", True).option("mode", "PERMISSIVE").option(
            "columnNameOfCorruptRecord", CORRUPT)
        reader = reader.schema(schema) if schema else reader.option("inferSchema", True)
    elif schema:
        reader = reader.schema(schema)
    try:
        return nan_to_null(reader.load(path)), None
    except PySparkException as exc:
        return None, str(exc)


def write_table(df: DataFrame, path: str, file_format: str = "parquet", partition_by: Sequence[str] = (),
                mode: str = "error") -> None:
    """Write a table as Parquet or CSV with a header."""
    writer = df.write.mode(mode).format(file_format).partitionBy(*partition_by)
    if file_format == "csv":
        writer = writer.option("header", True)
    writer.save(path)


# The shape of the demo series, its categories and regions with their shares.
DEMO = {"low": 8000.0, "high": 22000.0, "yearly": 3500.0, "weekly": 800.0, "noise": 600.0}
DEMO_CATEGORIES = {"Electronics": 0.3, "Apparel": 0.25, "Home & Garden": 0.2, "Sports": 0.15, "Beauty": 0.1}
DEMO_REGIONS = {"North": 0.3, "South": 0.25, "East": 0.25, "West": 0.2}


def _uniform(keys: Sequence[str], salt: int):
    """A number in (0, 1) that depends on the row alone, so retries give the same rows and SQL can restate them.

    52 bits of the MD5 of the row's keys, day and the counter ``salt``.
    """
    row = F.concat_ws("|", *[F.col(k).cast("string") for k in keys], F.col("Date").cast("string"), F.lit(str(salt)))
    bits = F.conv(F.substring(F.md5(row), 1, 13), 16, 10).cast("long")
    return (bits + F.lit(0.5)) / float(1 << 52)


def _draw(shares: dict[str, float], keys: Sequence[str], salt: int):
    u, edge, out = _uniform(keys, salt), 0.0, None
    for name, share in list(shares.items())[:-1]:
        edge += share
        out = F.when(u < edge, name) if out is None else out.when(u < edge, name)
    return out.otherwise(list(shares)[-1])


def demo_panel(series: DataFrame, keys: Sequence[str], start: str = "2022-01-01", end: str = "2024-12-31",
               noise: float = DEMO["noise"], segments: bool = True, seed: int = 42) -> DataFrame:
    """A daily demo series for every row of ``series``: trend, yearly and weekly waves, noise.

    Keys are few bytes, but each becomes a series of costly days. So they are dealt out to a fixed number of
    tasks; after the shuffle of ``distinct`` adaptive execution would put them all into one. Dealing by the keys
    would not help: Spark leaves it out as the same shuffle.
    """
    spark = series.sparkSession
    spread = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    day = F.explode(F.expr(f"sequence(DATE'{start}', DATE'{end}', interval 1 day)"))
    span = F.lit(1.0) * F.datediff(F.lit(end).cast("date"), F.lit(start).cast("date"))
    rows = series.select(*keys).distinct().repartition(spread).select(*keys, day.alias("Date"))
    i = F.datediff("Date", F.lit(start).cast("date"))
    wave = lambda size, turn, period: size * F.sin(2 * F.pi() * turn / period)
    bell = F.sqrt(-2 * F.log(_uniform(keys, seed))) * F.cos(2 * F.pi() * _uniform(keys, seed + 1))
    level = (
        DEMO["low"] + (DEMO["high"] - DEMO["low"]) * i / span
        + wave(DEMO["yearly"], F.dayofyear("Date"), 365) + wave(DEMO["weekly"], F.weekday("Date"), 7)
    )
    value = level + bell * noise if noise else level
    out = rows.withColumn("Sales", F.round(F.greatest(value, F.lit(0.0)), 2))
    if not segments:
        return out
    return out.withColumns({
        "Category": _draw(DEMO_CATEGORIES, keys, seed + 2),
        "Region": _draw(DEMO_REGIONS, keys, seed + 3),
        "Orders": F.floor(F.col("Sales") / (45 + 40 * _uniform(keys, seed + 4))).cast("int"),
        "Returns": F.floor(30 * _uniform(keys, seed + 5)).cast("int"),
    })
