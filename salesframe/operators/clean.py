"""Cleaning of a sales table as it arrives."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, NumericType, TimestampNTZType, TimestampType

from ..functions.exprs import ROW_HASH, attach, nan_to_null, row_hash, staged
from ..functions.quantiles import exact_quantiles, most_common, sketched_quantiles
from ..functions.text import amount, repair_text, text_columns
from ..session import settle
from .features import calendar_features, min_max, one_hot, row_features

# Words that mark a date column and a target column.
DATE_WORDS = ["date", "time", "day", "timestamp"]
TARGET_WORDS = ["sale", "sales", "revenue", "amount", "total", "price", "value", "income"]
DATE_FORMATS = {
    r"^\d{4}/\d{2}/\d{2}$": "yyyy/MM/dd", r"^\d{2}/\d{2}/\d{4}$": "MM/dd/yyyy",
    r"^\d{2}-\d{2}-\d{4}$": "dd-MM-yyyy", r"^\d{2} [A-Za-z]{3} \d{4}$": "dd MMM yyyy",
}
ENOUGH = 0.6


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, NumericType)]


def _is_date_type(field) -> bool:
    return isinstance(field.dataType, (DateType, TimestampType, TimestampNTZType))


def _named_like(name: str, words: Sequence[str]) -> bool:
    return any(w in name.lower() for w in words)


def date_column(df: DataFrame) -> str | None:
    """First column that holds dates or is named like one."""
    return next((f.name for f in df.schema if _is_date_type(f) or _named_like(f.name, DATE_WORDS)), None)


def target_column(df: DataFrame) -> str | None:
    """First column named like a sales figure, else the first numeric one."""
    named = [c for c in df.columns if _named_like(c, TARGET_WORDS)]
    return next(iter(named + numeric_columns(df)), None)


def scope(df: DataFrame, dim: str, value: str) -> DataFrame:
    """Rows whose dimension equals a value, whatever the case."""
    return df.filter(F.lower(dim) == value.lower())


def _readable(df: DataFrame, parsed: Mapping[str, Column]) -> list[str]:
    """Columns with enough readable values among all rows; one profile row is fetched."""
    if not parsed:
        return []
    shares = df.agg(*[F.avg(c.isNotNull().cast("int")).alias(n) for n, c in parsed.items()]).first()
    return [n for n in parsed if (shares[n] or 0) >= ENOUGH]


def parse_amounts(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Currency-like text columns become doubles.

    With ``columns`` the step is lazy. Without, every text column that is not
    named like a date is profiled, and converts when 60 % of all rows read.
    """
    order = df.columns
    candidates = columns if columns is not None else [
        c for c in text_columns(df) if not _named_like(c, DATE_WORDS)]
    if candidates:
        # A text worked out upstream is mentioned several times below: make it once.
        df = staged(df, {c: f"`{c}`" for c in candidates}).select(*[F.col(f"`{c}`") for c in order])
    if columns is None:
        columns = _readable(df, {c: amount(F.col(c)) for c in candidates})
    return df.withColumns({c: amount(F.col(c)) for c in columns})


def read_date(c: Column, formats: Mapping[str, str] = DATE_FORMATS) -> Column:
    """ISO dates first; other formats only where the text has their shape, so nothing is tried in vain."""
    others = [F.when(c.rlike(shape), F.try_to_timestamp(c, F.lit(fmt))) for shape, fmt in formats.items()]
    return F.coalesce(c.try_cast("timestamp"), *others).cast("date")


def parse_dates(df: DataFrame, columns: Sequence[str] | None = None,
                formats: Mapping[str, str] = DATE_FORMATS) -> DataFrame:
    """Date-named text columns become dates when 60 % of all rows read."""
    if columns is None:
        candidates = [c for c in text_columns(df) if _named_like(c, DATE_WORDS)]
        columns = _readable(df, {c: read_date(F.col(c), formats) for c in candidates})
    return df.withColumns({c: read_date(F.col(c), formats) for c in columns})


def drop_duplicates(df: DataFrame) -> DataFrame:
    """One of each group of equal rows.

    The rows are written once with a hash and a number each. Only hashes are shuffled to find those that
    repeat; only the rows behind repeated hashes are compared whole, copies collapsing before they move. The numbers of
    surplus copies are then taken out, by a broadcast as long as they are few.
    """
    rows = settle(df.select(*[F.col(f"`{c}`") for c in df.columns], *row_hash(df),
                            F.monotonically_increasing_id().alias("_row")), "rows")
    again = rows.groupBy(*ROW_HASH).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select(*ROW_HASH)
    suspects = rows.join(settle(again, "repeated"), ROW_HASH, "left_semi")
    # a null in a column is a value of its own here, as it is where rows are grouped
    kept = suspects.groupBy(*[F.col(f"`{c}`") for c in df.columns]).agg(F.min("_row").alias("_row"))
    surplus = suspects.select("_row").join(kept.select("_row"), "_row", "left_anti")
    return rows.join(settle(surplus, "surplus"), "_row", "left_anti").drop("_row", *ROW_HASH)


def drop_missing(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.dropna(subset=list(columns))


def fill_median(df: DataFrame, columns: Sequence[str] | None = None, approx: float | None = None) -> DataFrame:
    """Numeric gaps take the column median; filled columns are doubles.

    All medians come from one pass over (column, value) pairs; with ``approx``, an allowed rank error, from one
    sketch per column, which shuffles nothing but sketches.
    """
    columns = list(columns if columns is not None else numeric_columns(df))
    if not columns:
        return df
    df = nan_to_null(df)
    pairs = df.select(F.explode(F.array(*[
        F.struct(F.lit(i).alias("i"), F.col(c).cast("double").alias("v")) for i, c in enumerate(columns)
    ])).alias("_p")).select(F.col("_p.i").alias("_i"), F.col("_p.v").alias("_v"))
    found = sketched_quantiles(pairs, "_v", {"m": 0.5}, approx, ["_i"]) if approx else exact_quantiles(pairs, "_v", {"m": 0.5}, ["_i"])
    medians = found.agg(*[
        F.max(F.when(F.col("_i") == i, F.col("m"))).alias(f"_m{i}") for i in range(len(columns))
    ])
    out = attach(df, medians, ())
    return out.withColumns({
        c: F.coalesce(F.col(c).cast("double"), F.col(f"_m{i}")) for i, c in enumerate(columns)
    }).drop(*[f"_m{i}" for i in range(len(columns))])


def fill_mode(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Text gaps take the most common value, else ``Unknown``; one pass over (column, value) pairs."""
    columns = list(columns if columns is not None else text_columns(df))
    if not columns:
        return df
    pairs = df.select(F.explode(F.array(*[
        F.struct(F.lit(i).alias("i"), F.col(c).alias("v")) for i, c in enumerate(columns)
    ])).alias("_p")).select(F.col("_p.i").alias("_i"), F.col("_p.v").alias("_v"))
    modes = most_common(pairs, "_v", ["_i"]).agg(*[
        F.max(F.when(F.col("_i") == i, F.col("_v"))).alias(f"_m{i}") for i in range(len(columns))])
    return attach(df, modes, ()).withColumns({
        c: F.coalesce(F.col(c), F.col(f"_m{i}"), F.lit("Unknown")) for i, c in enumerate(columns)
    }).drop(*[f"_m{i}" for i in range(len(columns))])


def clip_negative(df: DataFrame, value_col: str) -> DataFrame:
    return df.withColumn(value_col, F.greatest(F.col(value_col), F.lit(0.0)))


def rename_canonical(df: DataFrame, date_col: str | None, value_col: str | None) -> DataFrame:
    names = {date_col: "Date", value_col: "Sales"}
    return df.withColumnsRenamed({old: new for old, new in names.items() if old and old != new})


def clean_sales(df: DataFrame, date_col: str | None = None, value_col: str | None = None,
                tiebreak: Sequence[str] = (), prepare_model_features: bool = False) -> DataFrame:
    """The full cleaning order, from text amounts to time, lag and rolling features.

    ``tiebreak`` names the identifying columns that order rows of one date; lags
    and rolling windows follow it, and it is neither filled nor scaled.
    """
    df = parse_dates(parse_amounts(nan_to_null(df)))
    date_col, value_col = date_col or date_column(df), value_col or target_column(df)
    # Medians, modes and row numbers each pass over the table: it is written once, without copies.
    df = drop_duplicates(drop_missing(df, [c for c in (date_col, value_col) if c]))
    df = fill_mode(fill_median(df, [c for c in numeric_columns(df) if c not in tiebreak]))
    if value_col:
        df = clip_negative(df, value_col)
    df = rename_canonical(df, date_col, value_col)
    if date_col:
        df = calendar_features(df, "Date")
    if date_col and value_col:
        df = row_features(df, ["Date", *tiebreak])
    if prepare_model_features:
        df = min_max(one_hot(df, exclude=["Date"]), exclude=["Sales", "Date", *tiebreak])
    return df


def clean_upload(df: DataFrame, date_col: str, value_col: str,
                 ids: Sequence[str] = ()) -> DataFrame:
    """The shorter order for a table whose dates and amounts are already typed."""
    df = drop_duplicates(drop_missing(nan_to_null(df), [date_col, value_col]))
    df = repair_text(fill_mode(fill_median(df, [c for c in numeric_columns(df) if c not in ids])))
    return rename_canonical(clip_negative(df, value_col), date_col, value_col)


def cleaning_steps(df: DataFrame, date_col: str, value_col: str) -> DataFrame:
    """What cleaning a typed table changes: one row per step with count and level."""
    from .anomaly import iqr_outlier_count

    df = nan_to_null(df)
    # Copies are told by a hash, so only hashes and a few marks are shuffled, not rows.
    kept, there = F.col("_kept"), F.col(f"`{date_col}`").isNotNull() & F.col(f"`{value_col}`").isNotNull()
    gaps = lambda names: sum((F.col(f"`{c}`").isNull().cast("int") for c in names), F.lit(0))
    numbers, texts = numeric_columns(df), text_columns(df)
    groups = df.select(
        *row_hash(df), there.alias("_kept"), F.col(f"`{value_col}`").cast("double").alias("_v"), gaps(numbers).alias("_numeric"), gaps(texts).alias("_text"),
        F.coalesce(F.col(f"`{value_col}`") < 0, F.lit(False)).alias("_below")).groupBy(*ROW_HASH).agg(
        F.count(F.lit(1)).alias("_copies"), *[F.first(c).alias(c) for c in ("_kept", "_numeric", "_text", "_below", "_v")])
    groups = settle(groups, "kinds")
    counts = groups.agg(
        (F.sum("_copies") - F.count(F.lit(1))).alias("duplicates_removed"),
        F.count_if(~kept).alias("rows_dropped"),
        F.coalesce(F.sum(F.when(kept, F.col("_numeric"))), F.lit(0)).alias("numeric_filled"),
        F.coalesce(F.sum(F.when(kept, F.col("_text"))), F.lit(0)).alias("text_filled"),
        F.count_if(kept & F.col("_below")).alias("negatives_clipped"),
        F.count_if(kept).alias("rows_left"),
    )
    counts = attach(counts, iqr_outlier_count(groups.filter(kept), "_v"), ())
    steps = ["duplicates_removed", "rows_dropped", "numeric_filled", "text_filled",
             "outliers", "negatives_clipped", "rows_left"]
    return counts.select(F.explode(F.array(*[
        F.struct(F.lit(i).cast("long").alias("step"), F.lit(s).alias("code"),
                 F.col(s).cast("long").alias("n"),
                 F.when((F.col(s) == 0) | F.lit(s == "rows_left"), "ok").otherwise("warn").alias("level"))
        for i, s in enumerate(steps, start=1)
    ])).alias("_r")).select("_r.*")
