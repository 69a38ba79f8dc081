"""SQL twins of the forecasters.

They follow other routes than the Spark code: the smoothing level is a weighted
sum, Holt's state a recursive query, seasons are self-joins.
"""

from __future__ import annotations

from collections.abc import Sequence

from .registry import cols, monthly_sql


def _using(keys: Sequence[str], *more: str) -> str:
    return f"USING ({', '.join([*keys, *more])})"


def idx_sql(keys: Sequence[str]) -> str:
    """``idx``: months of each series numbered from 0."""
    return monthly_sql(keys) + f""",
idx AS MATERIALIZED (SELECT {cols(keys)}d, s AS y, i - 1 AS i, n FROM m),
size AS MATERIALIZED (SELECT {cols(keys)}max(n) AS n, max(d) AS last_d FROM idx GROUP BY {', '.join(keys)})"""


def base_sql(keys: Sequence[str], outer: str) -> str:
    """``fc``: base forecasts for every (series, o, h) of the table ``outer``."""
    k, ids = cols(keys), ", ".join([*keys, "o", "h"])
    return f"""
o AS (SELECT DISTINCT {ids} FROM {outer}),
hist AS (SELECT {cols(keys, 'o.')}o.o, o.h, i, y FROM o JOIN idx {_using(keys)} WHERE i < o.o),
st AS (SELECT {ids}, avg(y) FILTER (WHERE i >= o - 3) AS ma, stddev_pop(y) FILTER (WHERE i >= o - 3) AS ma_s,
  CASE WHEN o >= 2 THEN regr_slope(y, i) FILTER (WHERE i >= o - 6) ELSE 0 END AS sl,
  CASE WHEN o >= 2 THEN regr_slope(y, i) END AS b, CASE WHEN o >= 2 THEN regr_intercept(y, i) END AS a,
  greatest(avg(abs(y)) * 0.001, 1e-9) AS flat, stddev_pop(y) AS all_s FROM hist GROUP BY {ids}),
li AS (SELECT {ids}, stddev_pop(y - (a + b * i)) AS li_s FROM hist JOIN st {_using(keys, 'o', 'h')} GROUP BY {ids}),
lv AS (SELECT {cols(keys, 'x.')}x.i, x.y, sum(z.y * CASE z.i WHEN 0 THEN pow(0.7::DOUBLE, x.i) ELSE 0.3::DOUBLE * pow(0.7::DOUBLE, x.i - z.i) END) AS l
  FROM idx x JOIN idx z {_using(keys)} WHERE z.i <= x.i GROUP BY ALL),
ex AS (SELECT {ids}, max(l) FILTER (WHERE i = o - 1) AS lev, CASE WHEN o >= 2 THEN regr_slope(l, i) FILTER (WHERE i >= o - 6) ELSE 0 END AS lsl,
  stddev_pop(y - l) AS ex_s FROM o JOIN lv {_using(keys)} WHERE i < o GROUP BY {ids}),
hl AS (SELECT {cols(keys, 'x.')}x.i, x.y, x.y AS l, z.y - x.y AS t FROM idx x JOIN idx z {_using(keys)} WHERE x.i = 0 AND z.i = 1
  UNION ALL SELECT {cols(keys, 'idx.')}idx.i, idx.y, 0.3::DOUBLE * idx.y + 0.7::DOUBLE * (l + t),
    0.1::DOUBLE * (0.3::DOUBLE * idx.y + 0.7::DOUBLE * (l + t) - l) + 0.9::DOUBLE * t
  FROM hl JOIN idx {_using(keys)} WHERE idx.i = hl.i + 1),
ho AS (SELECT {ids}, max(l) FILTER (WHERE i = o - 1) AS hlev, max(t) FILTER (WHERE i = o - 1) AS ht,
  stddev_pop(y - l - t) AS ho_s FROM o JOIN hl {_using(keys)} WHERE i < o GROUP BY {ids}),
pr AS (SELECT {cols(keys, 'c.')}c.o, c.h, c.i, c.y, p.y AS p FROM hist c LEFT JOIN hist p
  ON {' AND '.join(f'c.{x} = p.{x}' for x in keys)} AND c.o = p.o AND c.h = p.h AND p.i = c.i - 12 WHERE c.i >= c.o - 12),
gr AS (SELECT {ids}, CASE WHEN o >= 24 THEN coalesce(greatest(least(median(y / p) FILTER (WHERE p > 0), 1.45), 0.65), 1) ELSE 1 END AS g
  FROM pr GROUP BY {ids}),
jm AS (SELECT {ids}, y - lag(y) OVER (PARTITION BY {ids} ORDER BY i) AS j FROM pr),
se AS (SELECT {ids}, any_value(g) AS g, CASE WHEN o >= 24 THEN stddev_pop(y - g * p) END AS s24
  FROM pr JOIN gr {_using(keys, 'o', 'h')} GROUP BY {ids}),
sj AS (SELECT {ids}, stddev_pop(j) AS s12 FROM jm GROUP BY {ids}),
sp AS (SELECT {ids}, unnest(range(1, h + 1)) AS step FROM o),
al AS (SELECT * FROM sp JOIN st {_using(keys, 'o', 'h')} JOIN li {_using(keys, 'o', 'h')} JOIN ex {_using(keys, 'o', 'h')}
  LEFT JOIN ho {_using(keys, 'o', 'h')} JOIN se {_using(keys, 'o', 'h')} JOIN sj {_using(keys, 'o', 'h')}),
bs AS (SELECT {cols(keys, 'al.')}al.o, al.h, al.step, hist.y AS base FROM al JOIN hist
  ON {' AND '.join(f'al.{x} = hist.{x}' for x in keys)} AND al.o = hist.o AND al.h = hist.h
  AND hist.i = greatest(al.o - 12 + (al.step - 1) % 12, 0)),
fs AS (
  SELECT {ids}, step, 'moving_average' AS model_key,
    greatest(ma + 0.35::DOUBLE * sl * (1 - pow(0.85::DOUBLE, step)) / 0.15::DOUBLE, 0) AS f, ma_s AS s FROM al
  UNION ALL SELECT {ids}, step, 'linear_trend', a + b * (o - 1 + step), li_s FROM al
  UNION ALL SELECT {ids}, step, 'exp_smoothing', lev + (0.45::DOUBLE * sl + 0.55::DOUBLE * lsl) * (1 - pow(0.88::DOUBLE, step)) / 0.12::DOUBLE, ex_s FROM al
  UNION ALL SELECT {ids}, step, 'holts', hlev + step * CASE WHEN abs(ht) <= flat AND abs(sl) > flat THEN sl ELSE ht END, ho_s FROM al
  UNION ALL SELECT {ids}, step, 'seasonal_trend', CASE WHEN o < 12 THEN a + b * (o - 1 + step)
    ELSE base * greatest(0, 1 + (g - 1) * ((step - 1) // 12 + 1)) END,
    CASE WHEN o < 12 THEN li_s ELSE coalesce(s24, s12) END FROM al JOIN bs {_using(keys, 'o', 'h', 'step')}
  UNION ALL SELECT {ids}, step, 'seasonal_naive', CASE WHEN o < 12 THEN base
    ELSE base * greatest(0, 1 + (g - 1) * 0.6::DOUBLE * ((step - 1) // 12 + 1)) END,
    CASE WHEN o < 12 THEN all_s ELSE coalesce(s24, s12) END FROM al JOIN bs {_using(keys, 'o', 'h', 'step')}),
fc AS (SELECT *, f + 1.96::DOUBLE * s AS u, greatest(f - 1.96::DOUBLE * s, 0) AS l FROM fs WHERE f IS NOT NULL)"""


def all_models_sql(keys: Sequence[str], outer_sql: str) -> str:
    """``af``: forecasts of all models at the (series, o, h) rows of ``outer_sql`` (a full SELECT).

    Errors of members that forecast the same (a short seasonal trend is the linear one) are equal but for the order of
    their sum, so the three best are picked by rounded errors.
    """
    ids = ", ".join([*keys, "o", "h"])
    on = lambda a, b: " AND ".join(f"{a}.{x} = {b}.{x}" for x in keys)
    return f"""WITH RECURSIVE {idx_sql(keys)},
wanted AS ({outer_sql}),
inner_o AS (SELECT {cols(keys)}o AS oo, h AS oh, o - greatest(2, least(6, o // 4)) AS o, greatest(2, least(6, o // 4)) AS h
  FROM wanted WHERE o >= 6),
both_o AS (SELECT {ids} FROM wanted UNION SELECT {ids} FROM inner_o),
{base_sql(keys, 'both_o')},
sc AS (SELECT {cols(keys, 'n.')}n.oo AS o, n.oh AS h, fc.model_key,
    greatest(avg(abs(idx.y - fc.f) / greatest(abs(idx.y), 1)) * 100, 0.01) AS mape
  FROM inner_o n JOIN fc ON {on('n', 'fc')} AND n.o = fc.o AND n.h = fc.h
  JOIN idx ON {on('n', 'idx')} AND idx.i = n.o + fc.step - 1
  WHERE fc.model_key <> 'seasonal_naive' AND (fc.model_key <> 'seasonal_trend' OR n.oo >= 12) GROUP BY ALL),
tp AS (SELECT *, 1 / (mape + 1) AS w FROM sc QUALIFY row_number() OVER (PARTITION BY {ids} ORDER BY round(mape, 9),
  list_position(['holts', 'linear_trend', 'exp_smoothing', 'moving_average', 'seasonal_trend'], model_key)) <= 3),
bl AS (SELECT {ids}, step, sum(f * w) / sum(w) AS f, sum(u * w) / sum(w) AS u, sum(l * w) / sum(w) AS l
  FROM tp JOIN fc {_using(keys, 'o', 'h', 'model_key')} GROUP BY {ids}, step),
mv AS (SELECT bl.* EXCLUDE (f), greatest(f + CASE WHEN h >= 3 AND abs(sl) > flat
    AND max(round(f, 2)) OVER (PARTITION BY {ids}) = min(round(f, 2)) OVER (PARTITION BY {ids})
    THEN 0.18::DOUBLE * sl * (1 - pow(0.8::DOUBLE, step)) / 0.2::DOUBLE ELSE 0 END, 0) AS f FROM bl JOIN st {_using(keys, 'o', 'h')}),
af AS MATERIALIZED (
  SELECT {ids}, step, model_key, f, u, l FROM fc SEMI JOIN wanted {_using(keys, 'o', 'h')}
  UNION ALL SELECT {ids}, step, 'smart_ensemble', f, greatest(u, f), greatest(least(l, f), 0) FROM mv
  UNION ALL SELECT {ids}, step, 'smart_ensemble', f, u, l FROM fc SEMI JOIN wanted {_using(keys, 'o', 'h')}
    WHERE o < 6 AND model_key = 'holts')"""


CANDIDATES = "['smart_ensemble', 'moving_average', 'linear_trend', 'seasonal_trend', 'exp_smoothing', 'holts']"


def metrics_sql(keys: Sequence[str], models: str = CANDIDATES) -> str:
    """``me``: rounded metrics of the forecasts in ``af`` against the months that followed."""
    k = ", ".join(keys)
    return f"""
pv AS (SELECT {cols(keys, 'af.')}af.model_key, af.o, af.h, idx.y AS a, af.f AS p FROM af JOIN idx
  ON {' AND '.join(f'af.{x} = idx.{x}' for x in keys)} AND idx.i = af.o + af.step - 1 WHERE list_contains({models}, af.model_key)),
me AS (SELECT {k}, model_key, round(avg(abs(a - p)), 2) AS MAE, round(sqrt(avg((a - p) * (a - p))), 2) AS RMSE,
  round(avg(abs(a - p) / greatest(abs(a), 1)) * 100, 2) AS MAPE,
  round(CASE WHEN var_pop(a) > 0 THEN 1 - avg((a - p) * (a - p)) / var_pop(a) ELSE 0 END, 3) AS R2,
  count(DISTINCT o) AS Splits FROM pv GROUP BY {k}, model_key),
rk AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY {k} ORDER BY MAPE, list_position({models}, model_key)) AS rank FROM me)"""


def holdout_outer(keys: Sequence[str]) -> str:
    return (f"SELECT {cols(keys)}o, n - o AS h FROM (SELECT {cols(keys)}n, greatest(CAST(floor(n * 0.8::DOUBLE) AS BIGINT), 3) AS o "
            "FROM size) WHERE n - o >= 2")


def backtest_outer(keys: Sequence[str], min_train: str, horizon: int, splits: int) -> str:
    return (f"SELECT {cols(keys)}unnest(range(greatest({min_train}, n - {horizon} + 1 - {splits}), n - {horizon} + 1)) AS o, "
            f"{horizon} AS h FROM size WHERE n >= {min_train} + {horizon}")


def champion_outer(keys: Sequence[str]) -> str:
    short = holdout_outer(keys).replace("FROM size)", "FROM size WHERE n < 10)")
    return backtest_outer(keys, "greatest(6, least(12, n // 2))", 1, 6).replace(
        "FROM size WHERE", "FROM size WHERE n >= 10 AND") + " UNION ALL " + short


def full_outer(keys: Sequence[str], horizon: int) -> str:
    return f"SELECT {cols(keys)}n AS o, {horizon} AS h FROM size"


def champion_and_full_sql(keys: Sequence[str], horizon: int, source: str | None = None) -> str:
    """``ch``: the champion per series; ``af`` also holds full-history forecasts (o = n)."""
    k = ", ".join(keys)
    sql = all_models_sql(keys, champion_outer(keys) + " UNION ALL " + full_outer(keys, horizon))
    return sql + "," + metrics_sql(keys) + f""",
ch AS (SELECT {cols(keys, 'size.')}size.n AS months, last_d AS trained_on, coalesce(rk.model_key, 'holts') AS model_key, MAE, RMSE, MAPE, R2,
  CASE WHEN rk.model_key IS NULL THEN 'default' WHEN n >= 10 THEN 'backtest' ELSE 'holdout' END AS judged_by
  FROM size LEFT JOIN (SELECT * FROM rk WHERE rank = 1) rk {_using(keys)}),
pick AS (SELECT {cols(keys, 'ch.')}ch.model_key, step, CAST(last_d + to_months(CAST(step AS INTEGER)) AS DATE) AS "Date", f, u, l
  FROM ch JOIN size {_using(keys)} JOIN af ON {' AND '.join(f'af.{x} = ch.{x}' for x in keys)}
  AND af.o = size.n AND af.h = {horizon} AND af.model_key = ch.model_key)"""
