"""Classical forecasters over a panel of monthly series.

One row holds one series (or one series cut at a backtest origin) as an array;
every model is a set of column expressions over it. Series, origins and models
are so computed side by side, and nothing is exchanged between rows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import arrays as A
from ..functions.exprs import attach, known_keys, per_series, staged
from ..session import settle
from .features import month_arrays
from .ranking import rows_of_top_groups
from .rollup import monthly_totals

# Model names, their order, defaults and the fewest months each needs.
BASE_MODELS = ["moving_average", "linear_trend", "seasonal_naive", "seasonal_trend", "exp_smoothing", "holts"]
MODELS = ["smart_ensemble", *BASE_MODELS]
FOREST, FOREST_MONTHS = "random_forest", 8
FOREST_DEFAULTS = {"trees": 120, "depth": 8, "seed": 42}
CANDIDATES = ["smart_ensemble", "moving_average", "linear_trend", "seasonal_trend", "exp_smoothing", "holts"]
#: What series are judged by unless told otherwise; the forest takes part from ``FOREST_MONTHS`` months.
WITH_FOREST = [*CANDIDATES, FOREST]
ENSEMBLE_MEMBERS = ["holts", "linear_trend", "exp_smoothing", "moving_average", "seasonal_trend"]
FALLBACK_ORDER = ["smart_ensemble", "holts", "exp_smoothing", "linear_trend", "seasonal_trend",
                  "moving_average", "seasonal_naive"]
DEFAULTS: dict[str, dict[str, float]] = {
    "moving_average": {"window": 3, "trend_weight": 0.35, "damping": 0.85},
    "linear_trend": {},
    "seasonal_naive": {"season": 12, "trend_strength": 0.6},
    "seasonal_trend": {"season": 12, "trend_strength": 1.0},
    "exp_smoothing": {"alpha": 0.3, "trend_weight": 0.45, "damping": 0.88},
    "holts": {"alpha": 0.3, "beta": 0.1},
    "smart_ensemble": {"top_n": 3},
}
FEWEST_MONTHS = {"smart_ensemble": 2, "holts": 2, "linear_trend": 2, "seasonal_trend": 2,
                 "exp_smoothing": 1, "moving_average": 1, "seasonal_naive": 1}
GROWTH_LIMITS = (0.65, 1.45)
RECENT = 6
Z_95 = 1.96
Z_VALUES = {"80%": 1.28, "95%": 1.96, "99%": 2.576}

# A setting is a number, or SQL text over the columns of the series table.
Params = Mapping[str, Mapping[str, "float | str"]]


def check_models(models: Sequence[str]) -> None:
    unknown = [m for m in models if m not in (*MODELS, FOREST)]
    if unknown:
        raise ValueError(f"unknown model {unknown[0]}, use one of {[*MODELS, FOREST]}")


def _settings(params: Params | None) -> dict[str, dict[str, str]]:
    """Settings of every model as SQL text."""
    given = params or {}
    whole = {"window", "season", "top_n"}
    text = lambda name, v: v if isinstance(v, str) else (str(int(v)) if name in whole else f"{float(v)!r}D")
    return {m: {k: text(k, v) for k, v in {**d, **given.get(m, {})}.items()} for m, d in DEFAULTS.items()}


def _damped(step: str, d: str) -> str:
    """1 + d + … + d^(step-1)."""
    return f"(1 - pow({d}, {step})) / (1 - {d})"


def _exp_levels(y: str, alpha: str) -> str:
    return (f"aggregate(slice({y}, 2, size({y})), slice({y}, 1, 1), (acc, v) -> "
            f"concat(acc, array({alpha} * v + (1 - {alpha}) * element_at(acc, -1))))")


def _holt_state(y: str, alpha: str, beta: str) -> str:
    """Final level ``l`` and trend ``t``, with count, mean and squared deviations of the same-month residuals."""
    start = f"get({y}, 0)"
    climb = f"(get({y}, 1) - {start})"
    level = f"({alpha} * v + (1 - {alpha}) * (acc.l + acc.t))"
    trend = f"({beta} * ({level} - acc.l) + (1 - {beta}) * acc.t)"
    gap = f"(v - {level} - {trend} - acc.m)"
    return (
        f"CASE WHEN size({y}) >= 2 THEN aggregate(slice({y}, 2, size({y})), "
        f"named_struct('l', {start}, 't', {climb}, 'n', 1D, 'm', -{climb}, 'q', 0D), "
        f"(acc, v) -> named_struct('l', {level}, 't', {trend}, 'n', acc.n + 1, 'm', acc.m + {gap} / (acc.n + 1), "
        f"'q', acc.q + {gap} * {gap} * acc.n / (acc.n + 1))) END"
    )


def _growth_factor(now: str, then: str) -> str:
    low, high = GROWTH_LIMITS
    known = f"filter(zip_with({now}, {then}, (a, b) -> CASE WHEN b > 0 THEN a / b END), r -> r IS NOT NULL)"
    return f"coalesce(least(greatest({A.median(known)}, {low}D), {high}D), 1D)"


def _band(f: str, s: str, z: float) -> str:
    """A path with its interval; the lower end is not negative."""
    return (
        f"CASE WHEN {f} IS NOT NULL AND {s} IS NOT NULL THEN named_struct('f', {f}, "
        f"'u', transform({f}, x -> x + {s} * {z}D), 'l', transform({f}, x -> greatest(x - {s} * {z}D, 0D))) END"
    )


def add_paths(df: DataFrame, models: Sequence[str], y: str = "y", h: str = "h", out: str = "p_",
              z: float = Z_95, params: Params | None = None) -> DataFrame:
    """Add ``<out><model>`` = (f, u, l) arrays of length ``h`` for base models.

    A model that needs more months than a row has gives NULL there.
    """
    p = _settings(params)
    models = list(dict.fromkeys(models))
    seasonal = [m for m in models if m.startswith("seasonal")]
    line = "linear_trend" in models or seasonal
    n = f"size({y})"
    c = lambda name: f"_{out}{name}"
    steps = lambda body: f"transform(sequence(1, {h}), k -> {body})"
    made: list[str] = []

    def add(frame: DataFrame, columns: dict[str, str]) -> DataFrame:
        made.extend(c(k) for k in columns)
        return staged(frame, {c(k): v for k, v in columns.items()})

    first = {"recent": A.tail(y, RECENT), "flat": flat_limit(y)}
    if "moving_average" in models:
        first["win"] = A.tail(y, p["moving_average"]["window"])
    if line:
        first |= {"b": A.slope(y), "m": A.mean(y)}
    if seasonal:
        season = p[seasonal[0]]["season"]
        first |= {
            "now": f"CASE WHEN {n} >= {season} THEN {A.tail(y, season)} END",
            "then": f"CASE WHEN {n} >= 2 * {season} THEN slice({y}, {n} - 2 * {season} + 1, {season}) END",
        }
    if "exp_smoothing" in models:
        first["lv"] = _exp_levels(y, p["exp_smoothing"]["alpha"])
    if "holts" in models:
        first["ho"] = _holt_state(y, p["holts"]["alpha"], p["holts"]["beta"])
    df = add(df, first)

    second = {"slope": A.slope(c("recent"))}
    if "moving_average" in models:
        second |= {"ma": A.mean(c("win")), "ma_s": A.std_pop(c("win"))}
    if line:
        second["a"] = f"{c('m')} - {c('b')} * ({n} - 1) / 2"
    if seasonal:
        second["g"] = f"CASE WHEN {c('then')} IS NULL THEN 1D ELSE {_growth_factor(c('now'), c('then'))} END"
    if "exp_smoothing" in models:
        second |= {"lv6": A.tail(c("lv"), RECENT), "ex_s": A.std_pop(f"zip_with({y}, {c('lv')}, (a, b) -> a - b)")}
    if "holts" in models:
        second["ho_s"] = f"sqrt({c('ho')}.q / {c('ho')}.n)"
    df = add(df, second)

    third: dict[str, str] = {}
    if line:
        at = f"{c('a')} + {c('b')} *"
        third |= {
            "li_s": A.std_pop(f"transform({y}, (v, i) -> v - ({at} i))"),
            "li": f"CASE WHEN {n} >= 2 THEN {steps(f'{at} ({n} - 1 + k)')} END",
        }
    if seasonal:
        jumps = f"zip_with(slice({c('now')}, 2, size({c('now')})), slice({c('now')}, 1, size({c('now')}) - 1), (a, b) -> a - b)"
        misses = f"zip_with({c('now')}, {c('then')}, (a, b) -> a - b * {c('g')})"
        third["se_s"] = f"CASE WHEN {c('then')} IS NOT NULL THEN {A.std_pop(misses)} WHEN {c('now')} IS NOT NULL THEN {A.std_pop(jumps)} END"
    if "seasonal_naive" in models:
        third["all_s"] = A.std_pop(y)
    for m in seasonal:
        season, strength = p[m]["season"], p[m]["trend_strength"]
        base = f"get({y}, greatest({n} - {season} + (k - 1) % {season}, 0))"
        grown = f"greatest(1 + ({c('g')} - 1) * {strength} * (floor((k - 1) / {season}) + 1), 0D)"
        third[m] = steps(f"{base} * CASE WHEN {n} >= {season} THEN {grown} ELSE 1D END")
    if "exp_smoothing" in models:
        w = p["exp_smoothing"]["trend_weight"]
        third["ex_t"] = f"{w} * {c('slope')} + (1 - {w}) * {A.slope(c('lv6'))}"
    if "holts" in models:
        third["ho_t"] = (f"CASE WHEN abs({c('ho')}.t) <= {c('flat')} AND abs({c('slope')}) > {c('flat')} "
                         f"THEN {c('slope')} ELSE {c('ho')}.t END")
    if "moving_average" in models:
        q = p["moving_average"]
        third["moving_average"] = steps(
            f"greatest({c('ma')} + {q['trend_weight']} * {c('slope')} * {_damped('k', q['damping'])}, 0D)")
    df = add(df, third)

    paths: dict[str, str] = {}
    if "exp_smoothing" in models:
        pull = f"{c('ex_t')} * {_damped('k', p['exp_smoothing']['damping'])}"
        paths["exp_smoothing"] = steps(f"element_at({c('lv')}, -1) + {pull}")
    if "holts" in models:
        climb = steps(f"{c('ho')}.l + k * {c('ho_t')}")
        paths["holts"] = f"CASE WHEN {c('ho')} IS NOT NULL THEN {climb} END"
    if paths:
        df = add(df, paths)

    short = lambda m: f"{n} < {p[m]['season']}"
    bands = {
        "moving_average": lambda m: _band(c(m), c("ma_s"), z),
        "linear_trend": lambda m: _band(c("li"), c("li_s"), z),
        "exp_smoothing": lambda m: _band(c(m), c("ex_s"), z),
        "holts": lambda m: _band(c(m), c("ho_s"), z),
        "seasonal_trend": lambda m: f"CASE WHEN {short(m)} THEN {_band(c('li'), c('li_s'), z)} ELSE {_band(c(m), c('se_s'), z)} END",
        "seasonal_naive": lambda m: f"CASE WHEN {short(m)} THEN {_band(c(m), c('all_s'), z)} ELSE {_band(c(m), c('se_s'), z)} END",
    }
    return staged(df, {f"{out}{m}": bands[m](m) for m in models}).drop(*made)


def flat_limit(y: str) -> str:
    """Changes up to this size count as flat."""
    return f"greatest({A.mean(f'transform({y}, v -> abs(v))')} * 0.001D, 1e-9D)"


def move_if_flat(f: str, slope: str, flat: str, weight: float, damping: float, fewest: int = 3) -> str:
    """A path that is flat at 2 decimals follows the recent slope; never negative."""
    is_flat = f"size({f}) >= {fewest} AND size(array_distinct(transform({f}, x -> round(x, 2)))) = 1"
    moved = f"x + {weight}D * {slope} * {_damped('(i + 1)', f'{damping}D')}"
    path = f"CASE WHEN {is_flat} AND abs({slope}) > {flat} THEN transform({f}, (x, i) -> {moved}) ELSE {f} END"
    return f"transform({path}, x -> greatest(x, 0D))"


def add_ensemble(df: DataFrame, y: str = "y", h: str = "h", out: str = "p_", z: float = Z_95,
                 params: Params | None = None) -> DataFrame:
    """Add the blend of the members that did best on the latest months.

    Needs ``<out><member>`` already there. The validation forecasts are made from
    the same row, so no join is needed. ``<out>members`` keeps the blend.
    """
    top_n = _settings(params)["smart_ensemble"]["top_n"]
    n = f"size({y})"
    df = staged(df, {"_ek": f"CASE WHEN {n} >= 6 THEN CAST(greatest(2, least(6, floor({n} / 4))) AS INT) END"})
    df = staged(df, {
        "_ey": f"slice({y}, 1, {n} - _ek)", "_et": f"slice({y}, {n} - _ek + 1, _ek)",
    })
    df = add_paths(df, ENSEMBLE_MEMBERS, "_ey", "_ek", "_e_", z, params)
    df = staged(df, {
        f"_s_{m}": A.mean(f"zip_with(_et, _e_{m}.f, (a, b) -> abs(a - b) / greatest(abs(a), 1D))") + " * 100"
        for m in ENSEMBLE_MEMBERS
    })
    entries = ", ".join(
        f"CASE WHEN _s_{m} IS NOT NULL AND {out}{m} IS NOT NULL{f' AND {n} >= 12' if m == 'seasonal_trend' else ''} "
        f"THEN named_struct('mape', greatest(_s_{m}, 0.01D), 'place', {i}, 'model_key', '{m}', 'p', {out}{m}) END"
        for i, m in enumerate(ENSEMBLE_MEMBERS)
    )
    df = staged(df, {"_best": f"slice(array_sort(array_compact(array({entries}))), 1, {top_n})", "_recent": A.tail(y, RECENT)})
    df = staged(df, {
        "_wsum": "aggregate(_best, 0D, (s, e) -> s + 1 / (e.mape + 1))",
        "_slope": A.slope("_recent"), "_flat": flat_limit(y),
    })
    blend = lambda part: (
        f"transform(sequence(1, {h}), k -> aggregate(_best, 0D, "
        f"(s, e) -> s + try_divide(get(e.p.{part}, k - 1), (e.mape + 1) * _wsum)))")
    df = staged(df, {"_bf": blend("f"), "_bu": blend("u"), "_bl": blend("l")})
    df = staged(df, {"_bf": move_if_flat("_bf", "_slope", "_flat", 0.18, 0.80)})
    enough = f"{n} >= 6 AND size(_best) > 0"
    blended = ("named_struct('f', _bf, 'u', zip_with(_bu, _bf, (a, b) -> greatest(a, b)), "
               "'l', zip_with(_bl, _bf, (a, b) -> greatest(least(a, b), 0D)))")
    members = ("transform(_best, e -> named_struct('model_key', e.model_key, 'validation_mape', e.mape, "
               "'weight', try_divide(1D, (e.mape + 1) * _wsum)))")
    return staged(df, {
        f"{out}smart_ensemble": f"CASE WHEN {enough} THEN {blended} ELSE {out}holts END",
        f"{out}members": f"CASE WHEN {enough} THEN {members} END",
    }).drop("_ek", "_ey", "_et", "_best", "_recent", "_wsum", "_slope", "_flat", "_bf", "_bu", "_bl",
            *[f"_{s}_{m}" for s in ("e", "s") for m in ENSEMBLE_MEMBERS])


def add_models(df: DataFrame, models: Sequence[str], y: str = "y", h: str = "h", z: float = Z_95,
               params: Params | None = None) -> DataFrame:
    """Add ``p_<model>`` for any models."""
    check_models(models)
    base = [m for m in models if m != "smart_ensemble"]
    if "smart_ensemble" in models:
        base += ENSEMBLE_MEMBERS
    df = add_paths(df, base, y, h, "p_", z, params)
    return add_ensemble(df, y, h, "p_", z, params) if "smart_ensemble" in models else df


def listed_paths(models: Sequence[str], value: str) -> str:
    """Array of (model_key, value) for the models a row can run; ``{}`` stands for the model."""
    entries = ", ".join(
        f"CASE WHEN p_{m} IS NOT NULL THEN named_struct('model_key', '{m}', 'v', {value.format(m)}) END" for m in models)
    return f"array_compact(array({entries}))"


def paths_to_rows(df: DataFrame, ids: Sequence[str], models: Sequence[str]) -> DataFrame:
    """One row per id, model and step; months follow the last of ``dates``."""
    ids = list(ids)
    quoted = [f"`{i}`" for i in ids]
    long = df.selectExpr(*quoted, "element_at(dates, -1) AS _last", f"inline({listed_paths(models, 'p_{}')})")
    return long.selectExpr(
        *quoted, "_last", "model_key", "posexplode(arrays_zip(v.f, v.u, v.l)) AS (_i, _v)"
    ).selectExpr(
        *quoted, "model_key", "CAST(_i + 1 AS BIGINT) AS step", "add_months(_last, _i + 1) AS Date",
        "_v.f AS Forecast", "_v.u AS Upper", "_v.l AS Lower",
    )


def series_of(df: DataFrame, keys: Sequence[str] = (), fewest: int = 1) -> DataFrame:
    """Monthly arrays of the raw rows of a panel."""
    return month_arrays(monthly_totals(known_keys(df, keys), keys), keys).filter(F.size("y") >= fewest)


def forecast(df: DataFrame, model: str | Sequence[str], horizon: int = 6, keys: Sequence[str] = (),
             z: float = Z_95, params: Params | None = None, clip_at_zero: bool = False) -> DataFrame:
    """Forecast every series of a panel with one or more models.

    Forecasts of trend and smoothing models can be negative unless ``clip_at_zero``.
    """
    models = [model] if isinstance(model, str) else list(model)
    classic, out = [m for m in models if m != FOREST], None
    if classic or not models:
        rows = series_of(df, keys).withColumn("h", F.lit(horizon))
        out = paths_to_rows(add_models(rows, classic, z=z, params=params), keys, classic)
    if FOREST in models:
        trees = _forest_rows(df, horizon, keys, z)
        out = trees if out is None else out.unionByName(trees)
    return out.withColumn("Forecast", F.greatest("Forecast", F.lit(0.0))) if clip_at_zero else out


def ensemble_members(df: DataFrame, keys: Sequence[str] = (), params: Params | None = None) -> DataFrame:
    """Which models the ensemble blends per series, with validation error and weight."""
    rows = series_of(df, keys).withColumn("h", F.lit(1))
    return add_models(rows, ["smart_ensemble"], params=params).select(
        *keys, F.explode("p_members").alias("_m")).select(*keys, "_m.*")


def with_chosen_path(df: DataFrame, preferred: Column, z: float = Z_95,
                     params: Params | None = None) -> DataFrame:
    """Add ``model_key`` and ``p_chosen``: the preferred model, else the first fallback that can run."""
    df = add_models(df.withColumn("_want", preferred), MODELS, z=z, params=params)
    wanted = [f"CASE WHEN _want = '{m}' AND p_{m} IS NOT NULL THEN '{m}' END" for m in MODELS]
    others = [f"CASE WHEN p_{m} IS NOT NULL THEN '{m}' END" for m in FALLBACK_ORDER]
    df = staged(df, {"model_key": f"coalesce({', '.join(wanted + others)})"})
    path = " ".join(f"WHEN '{m}' THEN p_{m}" for m in MODELS)
    return staged(df, {"p_chosen": f"CASE model_key {path} END"}).drop(
        "_want", "p_members", *[f"p_{m}" for m in MODELS])


def chosen_rows(df: DataFrame, ids: Sequence[str]) -> DataFrame:
    rows = df.withColumnRenamed("model_key", "_key")
    out = paths_to_rows(rows, [*ids, "_key"], ["chosen"])
    return out.drop("model_key").withColumnRenamed("_key", "model_key")


def forecast_with_fallback(df: DataFrame, preferred: str, horizon: int = 6, keys: Sequence[str] = (),
                           z: float = Z_95, params: Params | None = None) -> DataFrame:
    """The preferred model where a series is long enough, else the first model that can run."""
    check_models([preferred])
    rows = series_of(df, keys).withColumn("h", F.lit(horizon))
    return chosen_rows(with_chosen_path(rows, F.lit(preferred), z, params), keys)


def _forest_rows(df: DataFrame, horizon: int, keys: Sequence[str], z: float) -> DataFrame:
    from .ml import random_forest_forecast

    return random_forest_forecast(df, horizon, keys, z)


def forecast_with_best_model(df: DataFrame, horizon: int = 6, keys: Sequence[str] = (),
                             z: float = Z_95, models: Sequence[str] = WITH_FOREST) -> DataFrame:
    """Each series with the model that did best on its recent past.

    With the forest among the ``models``, one forest is fitted for each recent origin and
    one for the forecasts, whatever the number of series.
    """
    from .evaluate import with_champion

    rows = with_champion(series_of(df, keys), keys, models).withColumn("h", F.lit(horizon))
    return champion_rows(rows, df, horizon, keys, z, FOREST in models)


def champion_rows(rows: DataFrame, df: DataFrame, horizon: int, keys: Sequence[str], z: float, with_forest: bool,
                  params: Params | None = None) -> DataFrame:
    """Forecasts of monthly arrays by the ``champion`` of each; the forest learns from the raw rows ``df``."""
    if not with_forest:
        return chosen_rows(with_chosen_path(rows, F.col("champion"), z, params), keys)
    rows = settle(rows, "champions")
    classic = rows.filter(F.col("champion") != FOREST)
    classic = chosen_rows(with_chosen_path(classic, F.col("champion"), z, params), keys)
    won = rows.filter(F.col("champion") == FOREST).select(*keys)
    if not won.head(1):
        return classic
    trees = _forest_rows(df, horizon, keys, z)
    return classic.unionByName(trees.join(won, list(keys), "left_semi") if keys else trees)


def forecast_groups(df: DataFrame, group_cols: Sequence[str], horizon: int = 6,
                    max_groups: int | None = None, fewest_months: int = 3, z: float = Z_95) -> DataFrame:
    """Best-model forecasts of all groups, or of the ``max_groups`` largest, with each group's total."""
    from .evaluate import with_champion

    groups = list(group_cols)
    rows = known_keys(df, groups)
    if max_groups:
        rows = rows_of_top_groups(rows, groups, max_groups)
    series = with_champion(series_of(rows, groups, fewest_months), groups, CANDIDATES).withColumn("h", F.lit(horizon))
    picked = with_chosen_path(series, F.col("champion"), z).withColumn("TotalForecast", F.expr(A.total("p_chosen.f")))
    return chosen_rows(picked, [*groups, "TotalForecast"])


def flat_guard(forecasts: DataFrame, df: DataFrame, keys: Sequence[str] = (), weight: float = 0.45,
               damping: float = 0.88) -> DataFrame:
    """Shift flat forecast paths and their bands along the recent slope of each series."""
    facts = staged(series_of(df, keys), {"_recent": A.tail("y", RECENT)}).select(
        *keys, F.expr(A.slope("_recent")).alias("_slope"), F.expr(flat_limit("y")).alias("_flat"),
        F.size("y").alias("_n"))
    path = per_series([*keys, "model_key"])
    same = F.min("Forecast").over(path) == F.max("Forecast").over(path)
    moves = same & (F.abs("_slope") > F.col("_flat")) & (F.col("_n") >= 2)
    shift = weight * F.col("_slope") * (1 - F.pow(F.lit(damping), F.col("step"))) / (1 - damping)
    moved = F.greatest(F.col("Forecast") + shift, F.lit(0.0))
    width = F.greatest(F.col("Upper") - F.col("Forecast"), F.lit(0.0))
    return attach(forecasts, facts, keys).withColumns({"_moves": moves, "_new": moved, "_w": width}).select(
        *keys, "model_key", "step", "Date",
        F.when(F.col("_moves"), F.col("_new")).otherwise(F.col("Forecast")).alias("Forecast"),
        F.when(F.col("_moves"), F.col("_new") + F.col("_w")).otherwise(F.col("Upper")).alias("Upper"),
        F.when(F.col("_moves"), F.greatest(F.col("_new") - F.col("_w"), F.lit(0.0)))
        .otherwise(F.col("Lower")).alias("Lower"),
    )


def rescale_interval(forecasts: DataFrame, z: float) -> DataFrame:
    """Turn 95 % bands into bands of another z value."""
    width = (F.col("Upper") - F.col("Forecast")) * (z / Z_95)
    return forecasts.withColumn("_w", width).withColumns({
        "Upper": F.col("Forecast") + F.col("_w"),
        "Lower": F.greatest(F.col("Forecast") - F.col("_w"), F.lit(0.0)),
    }).drop("_w")


def last_actuals(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return series_of(df, keys).select(*keys, F.element_at("y", -1).alias("last_actual"))


def forecast_steps(forecasts: DataFrame, actuals: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Month-over-month percent of a forecast, the first step against the last actual month."""
    before = F.coalesce(F.lag("Forecast").over(per_series([*keys, "model_key"], "step")), F.col("last_actual"))
    return attach(forecasts, actuals, keys).withColumn("_before", before).withColumn(
        "MoM", (F.col("Forecast") - F.col("_before")) / F.greatest(F.col("_before"), F.lit(1.0)) * 100
    ).drop("_before", "last_actual")


def path_summary(forecasts: DataFrame, actuals: DataFrame, keys: Sequence[str] = (),
                 limit: float = 8.0, absolute: bool = False) -> DataFrame:
    """Direction, change, launch, peak, low and largest steps of each forecast path.

    ``limit`` is the percent that counts as a direction. ``absolute`` divides by
    the size of the first value instead of the value itself.
    """
    ids = [*keys, "model_key"]
    at = F.array_sort(F.collect_list(F.struct("step", "Date", "Forecast", "Upper", "Lower")))
    rows = attach(forecasts.groupBy(*ids).agg(at.alias("_p")), actuals, keys)
    rows = staged(rows, {
        "_f": "transform(_p, e -> e.Forecast)", "_first": "_p[0].Forecast", "_last": "element_at(_p, -1).Forecast",
        "_width": "_p[0].Upper - _p[0].Lower",
        "_diff": "transform(slice(_p, 2, size(_p)), (e, i) -> named_struct("
                 "'k', e.Forecast - get(_p, i).Forecast, 'd', e.Date, 'b', get(_p, i).Forecast))",
    })
    rows = staged(rows, {
        "total_change": f"(_last - _first) / greatest({'abs(_first)' if absolute else '_first'}, 1D) * 100",
        "launch_change": "(_first - last_actual) / greatest(last_actual, 1D) * 100",
        "_top": "array_min(transform(_p, e -> named_struct('k', -e.Forecast, 'd', e.Date)))",
        "_low": "array_min(transform(_p, e -> named_struct('k', e.Forecast, 'd', e.Date)))",
        "_rise": "array_min(transform(_diff, e -> named_struct('k', -e.k, 'd', e.d, 'b', e.b)))",
        "_fall": "array_min(_diff)",
    })
    return rows.selectExpr(
        *[f"`{i}`" for i in ids], f"{A.total('_f')} AS total", f"{A.mean('_f')} AS mean",
        f"CASE WHEN total_change > {limit} THEN 'up' WHEN total_change < -{limit} THEN 'down' ELSE 'steady' END AS direction",
        "total_change", "launch_change", "_top.d AS peak_month", "-_top.k AS peak", "_low.d AS low_month", "_low.k AS low",
        "_rise.d AS rise_month", "abs(_rise.k) / greatest(_rise.b, 1D) * 100 AS rise_pct",
        "_fall.d AS drop_month", "abs(_fall.k) / greatest(_fall.b, 1D) * 100 AS drop_pct",
        "_width / greatest(_first, 1D) * 100 AS range_width_pct",
    )


def export_table(forecasts: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """The table handed out: month text, rounded values, model."""
    return forecasts.select(
        *keys, F.date_format("Date", "MMM yyyy").alias("Month"),
        *[F.round(c, 2).alias(c) for c in ("Forecast", "Lower", "Upper")],
        F.col("model_key").alias("Model"),
    )
