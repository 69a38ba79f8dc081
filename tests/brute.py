"""Plain Python statements of the forecasting rules, one value at a time."""

import math
import statistics as st

Z = 1.96


def slope(v):
    n = len(v)
    if n < 2:
        return 0.0
    xm, ym = (n - 1) / 2, sum(v) / n
    return sum((i - xm) * (y - ym) for i, y in enumerate(v)) / sum((i - xm) ** 2 for i in range(n))


def pull(d, h):
    return sum(d ** s for s in range(h))


def banded(path, sd):
    return [(f, f + Z * sd, max(f - Z * sd, 0.0)) for f in path]


def moving_average(y, h):
    last = y[-3:]
    path = [max(st.fmean(last) + 0.35 * slope(y[-6:]) * pull(0.85, k), 0.0) for k in range(1, h + 1)]
    return banded(path, st.pstdev(last))


def linear_trend(y, h):
    n = len(y)
    if n < 2:
        return None
    b = slope(y)
    a = st.fmean(y) - b * (n - 1) / 2
    return banded([a + b * (n - 1 + k) for k in range(1, h + 1)], st.pstdev([v - a - b * i for i, v in enumerate(y)]))


def growth(y):
    if len(y) < 24:
        return 1.0
    ratios = [a / b for a, b in zip(y[-12:], y[-24:-12]) if b > 0]
    return min(max(st.median(ratios), 0.65), 1.45) if ratios else 1.0


def seasonal(y, h, strength):
    n, g = len(y), growth(y)
    path = [y[n - 12 + (k - 1) % 12] * max(0.0, 1 + (g - 1) * strength * ((k - 1) // 12 + 1)) for k in range(1, h + 1)]
    if n >= 24:
        sd = st.pstdev([a - b * g for a, b in zip(y[-12:], y[-24:-12])])
    else:
        sd = st.pstdev([b - a for a, b in zip(y[-12:], y[-11:])])
    return banded(path, sd)


def seasonal_trend(y, h):
    return seasonal(y, h, 1.0) if len(y) >= 12 else linear_trend(y, h)


def seasonal_naive(y, h):
    if len(y) >= 12:
        return seasonal(y, h, 0.6)
    return banded([y[max(len(y) - 12 + (k - 1) % 12, 0)] for k in range(1, h + 1)], st.pstdev(y))


def exp_smoothing(y, h):
    levels = [y[0]]
    for v in y[1:]:
        levels.append(0.3 * v + 0.7 * levels[-1])
    turn = 0.45 * slope(y[-6:]) + 0.55 * slope(levels[-6:])
    return banded([levels[-1] + turn * pull(0.88, k) for k in range(1, h + 1)],
                  st.pstdev([v - x for v, x in zip(y, levels)]))


def holts(y, h, alpha=0.3, beta=0.1):
    if len(y) < 2:
        return None
    level, trend = y[0], y[1] - y[0]
    misses = [y[0] - level - trend]
    for v in y[1:]:
        before = level
        level = alpha * v + (1 - alpha) * (level + trend)
        trend = beta * (level - before) + (1 - beta) * trend
        misses.append(v - level - trend)
    flat = max(st.fmean(map(abs, y)) * 0.001, 1e-9)
    recent = slope(y[-6:])
    if abs(trend) <= flat < abs(recent):
        trend = recent
    return banded([level + k * trend for k in range(1, h + 1)], st.pstdev(misses))


def mape(actual, predicted):
    return 100 * st.fmean(abs(a - p) / max(abs(a), 1) for a, p in zip(actual, predicted))


def smart_ensemble(y, h):
    n = len(y)
    if n < 6:
        return holts(y, h)
    k = max(2, min(6, n // 4))
    models = [holts, linear_trend, exp_smoothing, moving_average] + ([seasonal_trend] if n >= 12 else [])
    scored = sorted(
        ((max(mape(y[-k:], [f for f, _, _ in m(y[:-k], k)]), 0.01), i, m(y, h)) for i, m in enumerate(models)),
        key=lambda e: e[:2])[:3]
    weights = [1 / (e[0] + 1) for e in scored]
    mix = lambda s, j: sum(w * e[2][s][j] for w, e in zip(weights, scored)) / sum(weights)
    f = [mix(s, 0) for s in range(h)]
    turn, flat = slope(y[-6:]), max(st.fmean(map(abs, y)) * 0.001, 1e-9)
    if h >= 3 and len({round(x, 2) for x in f}) == 1 and abs(turn) > flat:
        f = [x + 0.18 * turn * pull(0.8, s + 1) for s, x in enumerate(f)]
    f = [max(x, 0.0) for x in f]
    return [(x, max(mix(s, 1), x), max(min(mix(s, 2), x), 0.0)) for s, x in enumerate(f)]


MODELS = {m.__name__: m for m in (
    moving_average, linear_trend, seasonal_trend, seasonal_naive, exp_smoothing, holts, smart_ensemble)}
CANDIDATES = ["smart_ensemble", "moving_average", "linear_trend", "seasonal_trend", "exp_smoothing", "holts"]


def champion(y):
    n = len(y)
    if n >= 10:
        origins, h = list(range(max(6, min(12, n // 2)), n))[-6:], 1
    else:
        split = max(math.floor(n * 0.8), 3)
        origins, h = [split], n - split
        if h < 2:
            return "holts", None
    best = None
    for i, name in enumerate(CANDIDATES):
        pairs = [(y[o + s], f[0]) for o in origins for s, f in enumerate(MODELS[name](y[:o], h))]
        score = (round(mape(*zip(*pairs)), 2), i, name)
        best = min(best, score) if best else score
    return best[2], best[0]
