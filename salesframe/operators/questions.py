"""Tables of business questions: intent, horizon, mentioned values, routing to results."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import attach, staged
from ..functions.labels import horizon_caution
from ..session import settle

# The words below define intents, flags and numbers.
WEAK = ["weak", "weakest", "worst", "lowest", "least", "poor", "poorest", "underperform", "under performing",
        "under-performing", "low performing", "low-performing"]
PRODUCT = ["product", "item", "sku", "brand"]
INTENT_WORDS = {
    "anomaly": ["anomaly", "anomalies", "spike", "drop", "unusual", "outlier", "outliers"],
    "recommendations": ["recommendation", "recommendations", "recommend", "business advice", "business insight",
                        "business insights", "action plan", "next steps", "what should i do", "what to do",
                        "strategy", "strategies", "decision", "decisions"],
    "model_info": ["model", "algorithm", "mape", "rmse", "mae", "r-squared", "r squared", "r2", "accuracy",
                   "confidence interval", "feature importance", "smart ensemble", "holt", "random forest",
                   "linear trend", "moving average", "exponential smoothing", "seasonal naive"],
    "project_info": ["project", "application", "module", "workflow", "feature", "tech stack", "technology",
                     "architecture"],
    "data_info": ["column", "columns", "missing", "duplicate", "duplicates", "clean", "cleaning", "preprocess",
                  "preprocessing", "data quality", "shape", "rows", "fields", "schema"],
    "scenario": ["scenario", "what if", "simulate", "marketing", "churn", "discount"],
    "forecast": ["forecast", "forecasting", "predict", "prediction", "next month", "next 6", "future sales",
                 "future revenue"],
    "comparison": ["compare", "comparison", "vs", "versus", "last 3 months", "last month vs"],
    "summary": ["total sales", "total revenue", "overall sales", "average sales", "avg sales", "date range",
                "record count", "how many records"],
    "best_month": ["best month", "highest month", "top month", "peak month"],
    "best_category": ["best category", "top category", "highest category"],
    "best_product": ["best product", "top product", "highest product", "best item", "top item", "highest item"],
    "best_region": ["best region", "top region", "highest region"],
    "trend": ["trend", "growth", "decline", "upward", "downward", "momentum"],
    "overview": ["summary", "overview", "dataset", "overall", "tell me about my data"],
}
NUMBERS = ["one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten", "eleven", "twelve"]
EACH_PRODUCT = ["each product", "for each product", "every product", "for every product", "all products",
                "by product", "product wise", "product-wise"]
EACH_CATEGORY = ["every category", "for every category", "each category", "for each category", "all categories",
                 "by category", "category wise", "category-wise"]
EACH_REGION = ["every region", "for every region", "each region", "for each region", "all regions", "by region",
               "region wise", "region-wise", "regions"]
EACH_MONTH = ["every month", "month by month", "monthly", "each month", "by month"]
SALES_WORDS = ["sales", "revenue"]
DEFAULT_HORIZON, LONGEST_HORIZON = 6, 60
DIMENSION_ORDER = ["Category", "Product", "Product Name", "Item", "Item Name", "SKU", "Brand", "Region"]

# Patterns that read how far ahead a question looks, and the name of the application.
_NUMBER = r"(\d+|" + "|".join(NUMBERS) + r"|twenty[- ]four)"
_AHEAD = r"\bnext\s+(\d+|" + "|".join(NUMBERS) + r")[-\s]*(month|months|year|years)\b"
_NEXT_YEAR = r"\bnext\s+year\b"
_YEARS = _NUMBER + r"[-\s]*(?:year|years|yr|yrs)\b"
_MONTHS = _NUMBER + r"[-\s]*(?:month|months|mo|mos)\b"
_NEXT = r"\bnext\s+" + _NUMBER + r"\b"
_APP = r"\bapp\b"


def has_any(q: str, words: Sequence[str]) -> str:
    """SQL text: whether column ``q`` holds any of the words; a word inside a longer one counts."""
    if len(words) == 1:
        return f"contains({q}, '{words[0]}')"
    either = "|".join(re.escape(w).replace("\\ ", " ").replace("\\-", "-") for w in words)
    return f"({q} RLIKE r'{either}')"


def intent(q: str) -> str:
    """SQL text: the first rule that matches lower-case column ``q``, in the order of the rules."""
    has = lambda name: has_any(q, INTENT_WORDS[name])
    word = lambda w: f"contains({q}, '{w}')"
    weak = has_any(q, WEAK)
    ahead = f"({word('next')} AND {q} RLIKE r'(?U){_AHEAD}')"
    rules = [
        (has("anomaly"), "anomaly"), (has("recommendations"), "recommendations"), (has("model_info"), "model_info"),
        (f"{has('project_info')} OR ({word('app')} AND {q} RLIKE r'(?U){_APP}')", "project_info"),
        (has("data_info"), "data_info"), (has("scenario"), "scenario"), (f"{has('forecast')} OR {ahead}", "forecast"),
        (has("comparison"), "comparison"), (has("summary"), "summary"),
        (f"{word('region')} AND {weak}", "weakest_region"), (f"{word('category')} AND {weak}", "weakest_category"),
        (f"{has_any(q, PRODUCT)} AND {weak}", "weakest_product"), (f"{word('month')} AND {weak}", "weakest_month"),
        *[(has(name), name) for name in ("best_month", "best_category", "best_product", "best_region", "trend")],
        (has("overview"), "summary"),
    ]
    return "CASE " + " ".join(f"WHEN {cond} THEN '{name}'" for cond, name in rules) + " ELSE 'fallback' END"


def _number(text: str) -> str:
    """Value of digits or a number word; NULL if there is none or it is 0."""
    words = " ".join(f"WHEN '{w}' THEN {i}D" for i, w in enumerate(NUMBERS, start=1))
    return (f"nullif(CASE {text} WHEN '' THEN NULL {words} WHEN 'twenty four' THEN 24D WHEN 'twenty-four' THEN 24D "
            f"ELSE try_cast({text} AS DOUBLE) END, 0D)")


def horizon(q: str, longest: int = LONGEST_HORIZON) -> str:
    """SQL text: months ahead that lower-case column ``q`` asks for, 1 to ``longest``, 6 if it does not say."""
    def find(words: Sequence[str], pattern: str) -> str:
        got = f"regexp_extract({q}, r'(?U){pattern}', 1)"
        return f"CASE WHEN {has_any(q, words)} THEN {_number(got)} END"

    months = ", ".join([
        f"CASE WHEN contains({q}, 'next month') THEN 1D END",
        f"CASE WHEN {q} RLIKE r'(?U){_NEXT_YEAR}' THEN 12D END",
        find(["year", "yr"], _YEARS) + " * 12",
        find(["mo"], _MONTHS),
        find(["next"], _NEXT),
        f"{DEFAULT_HORIZON}D",
    ])
    return f"CAST(least(greatest(coalesce({months}), 1D), {longest}D) AS BIGINT)"


def flags(q: str) -> dict[str, str]:
    """SQL texts of the breakdown flags; needs ``intent`` beside lower-case column ``q``."""
    return {
        "groupwise_forecast": f"intent = 'forecast' AND {has_any(q, [*EACH_PRODUCT, *EACH_CATEGORY, 'categories'])}",
        "month_category": f"{has_any(q, EACH_MONTH)} AND {has_any(q, ['category', 'categories'])} AND {has_any(q, SALES_WORDS)}",
        "category_breakdown": has_any(q, EACH_CATEGORY),
        "region_breakdown": f"{has_any(q, EACH_REGION)} AND {has_any(q, [*SALES_WORDS, 'performance', 'breakdown'])}",
    }


PARTS = ["intent", "horizon", "caution", "flags"]


def classify(questions: DataFrame, text_col: str = "question", parts: Sequence[str] = PARTS,
             longest: int = LONGEST_HORIZON) -> DataFrame:
    """The wanted ``parts`` beside every question; only what they need is worked out.

    Horizons of more than ``longest`` months count as ``longest``.
    """
    ahead, marks = {"horizon", "caution"} & set(parts), "flags" in parts
    rows = staged(questions, {"_q": f"lower(`{text_col}`)"})
    first = {"intent": intent("_q")} if marks or "intent" in parts else {}
    rows = staged(rows, first | ({"horizon": horizon("_q", longest)} if ahead else {}))
    rows = (staged(rows, flags("_q")) if marks else rows).drop("_q")
    return rows.withColumn("caution", horizon_caution(F.col("horizon"))) if "caution" in parts else rows


def dimension_values(df: DataFrame, dims: Sequence[str] | None = None) -> DataFrame:
    """Distinct values of the text columns of a table, one scan: (dim, value, place)."""
    if dims is None:
        text = [n for n, t in df.dtypes if t == "string"]
        dims = [d for d in DIMENSION_ORDER if d in df.columns] + [c for c in text if c not in DIMENSION_ORDER]
    pairs = F.array(*[
        F.struct(F.lit(d).alias("dim"), F.col(d).cast("string").alias("value"), F.lit(i).alias("place"))
        for i, d in enumerate(dims)
    ])
    return df.select(F.inline(pairs)).filter("value <> ''").distinct()


# A text is a row of words and single other characters. A value stands in it as
# a whole word exactly where its own pieces follow each other, with no word
# character directly before or after.
_PIECES = r"(?U)\w+|\W"


def _marked(pieces: str) -> str:
    """SQL text: pieces in a row, words between marks of one kind, other pieces between marks of another.

    The row begins and ends with a mark of the other kind. One row holds another exactly where
    its pieces follow each other with no word directly before or after.
    """
    mark = r"IF(t RLIKE r'(?U)^\w', '\u0002', '\u0003')"
    return f"concat('\u0003', array_join(transform({pieces}, t -> concat({mark}, t, {mark})), ''), '\u0003')"


def _indexed(values: DataFrame) -> DataFrame:
    """Values under their rarest piece (the fewest values have it): ``_piece``, ``dim``, ``value``, ``place``, ``_run``."""
    known = values.select("dim", "value", "place", F.regexp_extract_all(F.lower("value"), F.lit(_PIECES), F.lit(0)).alias("_v"))
    each = known.select("dim", "value", F.explode(F.array_distinct("_v")).alias("_piece"))
    spread = each.groupBy("_piece").agg(F.count(F.lit(1)).alias("_n"))
    # words before blanks and signs, which most texts have
    rank = F.struct((~F.col("_piece").rlike(r"(?U)^\w")).alias("sign"), F.col("_n").alias("n"), F.col("_piece").alias("piece"))
    rarest = each.join(spread, "_piece").groupBy("dim", "value").agg(F.min(rank).alias("_r"))
    return known.join(rarest, ["dim", "value"]).select(
        "dim", "value", "place", F.col("_r.piece").alias("_piece"), F.expr(_marked("_v")).alias("_run"))


def mentions(questions: DataFrame, values: DataFrame, ids: Sequence[str],
             text_col: str = "question") -> DataFrame:
    """The dimension value a question names: ``dim`` and ``value``, NULL if none.

    Values are kept under their rarest piece. The distinct pieces of a question meet them in an equi-join of ids and
    pieces, without texts; what is found so is compared with the text, one candidate a row, and the best one is a
    minimum. So neither a common first word of very many values nor a question with many candidates makes a long
    list, and no question is compared with every value. A question about a category or region looks there first, then
    in column order; the longest value wins.
    """
    spread = int(questions.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return _mentions(questions.repartition(spread, *ids), questions.columns, values, ids, text_col)


def _mentions(rows: DataFrame, shown: Sequence[str], values: DataFrame, ids: Sequence[str], text_col: str) -> DataFrame:
    cut = lambda c: F.regexp_extract_all(F.lower(c), F.lit(_PIECES), F.lit(0))
    pieces = rows.select(*ids, F.explode(F.array_distinct(cut(text_col))).alias("_piece"))
    found = pieces.join(settle(_indexed(values), "values"), "_piece").drop("_piece")
    # texts are taken apart only where something was found
    named = rows.select(*ids, F.col(text_col).alias("_q")).join(found, list(ids))
    pieces_of = f"regexp_extract_all(lower(_q), r'{_PIECES}', 0)"
    named = staged(named, {"_text": _marked(pieces_of), "_about": (
        "CASE WHEN contains(lower(_q), 'category') THEN 'Category' WHEN contains(lower(_q), 'region') THEN 'Region' END")})
    named = named.drop("_q").where("contains(_text, _run)")
    first = F.coalesce(F.col("dim") == F.col("_about"), F.lit(False))
    best = F.min(F.struct(F.when(first, -1).otherwise(F.col("place")).alias("o"), (-F.length("value")).alias("l"),
                          F.col("value").alias("v"), F.col("dim").alias("d")))
    return rows.join(named.groupBy(*ids).agg(best.alias("_best")), list(ids), "left").select(
        *shown, F.col("_best.d").alias("dim"), F.col("_best.v").alias("value"))


def route(questions: DataFrame, values: DataFrame, ids: Sequence[str],
          text_col: str = "question", product_dim: str | None = None) -> DataFrame:
    """Which result answers a question: ``route``, with ``scope_dim`` and ``scope_value``.

    Forecast routes are scoped to a mentioned value, to a dimension (one forecast
    per value) or to everything.
    """
    # dealt out before anything is worked out of the texts
    spread = int(questions.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = classify(questions.repartition(spread, *ids), text_col)
    named = _mentions(dealt, dealt.columns, values, ids, text_col)
    c = F.col
    says = lambda words: F.expr(has_any(f"lower(`{text_col}`)", words))
    direct = ["data_info", "model_info", "recommendations", "project_info"]
    is_forecast = c("intent") == "forecast"
    last3 = says(["last 3", "three"])
    answer = (
        F.when(c("intent").isin(*direct), c("intent"))
        .when(is_forecast & c("dim").isNotNull() & ~c("groupwise_forecast"), "forecast_value")
        .when(is_forecast & c("groupwise_forecast"), "forecast_groups")
        .when(is_forecast, "forecast")
        .when(c("month_category"), "month_category")
        .when(c("category_breakdown"), "category_breakdown")
        .when(c("region_breakdown"), "region_breakdown")
        .when((c("intent") == "comparison") & last3, "comparison_3")
        .when(c("intent") == "fallback", "general")
        .otherwise(c("intent"))
    )
    by = F.when(says(["category"]), "Category").when(says(["region"]), "Region").otherwise(
        F.lit(product_dim or "Category"))
    return named.withColumn("route", answer).withColumns({
        "scope_dim": F.when(c("route") == "forecast_value", c("dim")).when(c("route") == "forecast_groups", by),
        "scope_value": F.when(c("route") == "forecast_value", c("value")),
    }).drop("dim", "value")
