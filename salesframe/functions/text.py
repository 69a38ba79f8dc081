"""Text helpers: currency amounts and text repair."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Amount suffixes and what they multiply by.
AMOUNT_SUFFIXES = {"cr": 1e7, "l": 1e5, "k": 1e3}

# Letters that betray UTF-8 read as a one-byte code page, and
# typographic characters with their plain forms.
MOJIBAKE_MARKS = "ÃâðÂ"
PLAIN_FORMS = {
    "’": "'", "‘": "'", "“": '"', "”": '"',
    "–": "-", "—": "-", "…": "...", " ": " ",
}


def amount(c: Column) -> Column:
    """``₹1,200`` / ``5k`` / ``2.5L`` / ``1.2Cr`` as a double; NULL if unreadable."""
    bare = F.lower(F.translate(F.trim(F.regexp_replace(c, r"(?U)^\s+|\s+$", "")), "₹, ", ""))
    factor = F.lit(1.0)
    for suffix, value in reversed(AMOUNT_SUFFIXES.items()):
        factor = F.when(F.endswith(bare, F.lit(suffix)), F.lit(value)).otherwise(factor)
    digits = F.regexp_replace(bare, r"[^0-9.\-]", "")
    # Plain labels leave nothing to read: a cast tried on them costs an exception per row.
    readable = digits.rlike(r"^-?([0-9]+\.?[0-9]*|\.[0-9]+)$")
    return F.when(readable, digits.try_cast("double")) * factor


def _undo_mojibake(text: str) -> str:
    if any(mark in text for mark in MOJIBAKE_MARKS):
        for page in ("cp1252", "latin1"):
            try:
                return text.encode(page).decode("utf-8")
            except UnicodeError:
                pass
    return text


def _repair_one(text: str) -> str:
    text = _undo_mojibake(text.strip()).translate(str.maketrans(PLAIN_FORMS))
    return " ".join(unicodedata.normalize("NFKC", text).split())


@F.pandas_udf(StringType())
def _repair(texts: pd.Series) -> pd.Series:
    return texts.map(_repair_one, na_action="ignore")


def repaired(c: Column) -> Column:
    """Trimmed text with repaired encoding, plain punctuation and single spaces.

    Plain ASCII needs no Unicode work and stays in the JVM; only other texts
    are sent to Python.
    """
    ascii_form = F.trim(F.regexp_replace(c, r"[\s\x1c-\x1f]+", " "))
    return F.when(
        c.rlike(r"[^\x00-\x7f]"), _repair(F.when(c.rlike(r"[^\x00-\x7f]"), c))
    ).otherwise(ascii_form)


def text_columns(df: DataFrame) -> list[str]:
    return [name for name, kind in df.dtypes if kind == "string"]


def repair_text(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    return df.withColumns({c: repaired(F.col(c)) for c in (columns or text_columns(df))})
