"""Arithmetic on one series held as an array of doubles, as Spark SQL text.

A monthly history is at most a few hundred values, so the array is small however
many rows the month totals were made from. Every function takes and returns SQL
text; an argument should be a plain column where a lambda mentions it.
"""

from __future__ import annotations


def tail(a: str, k: int | str) -> str:
    """The last ``k`` values, fewer if the series is shorter."""
    return f"slice({a}, greatest(size({a}) - {k} + 1, 1), {k})"


def total(a: str) -> str:
    return f"aggregate({a}, 0D, (s, x) -> s + x)"


def mean(a: str) -> str:
    return f"try_divide({total(a)}, size({a}))"


def _moments(a: str, finish: str) -> str:
    """Fold count, mean and squared deviations; stable for large values."""
    gap = "(x - acc.m)"
    return (
        f"aggregate({a}, named_struct('n', 0D, 'm', 0D, 'q', 0D), (acc, x) -> named_struct("
        f"'n', acc.n + 1, 'm', acc.m + {gap} / (acc.n + 1), "
        f"'q', acc.q + {gap} * {gap} * acc.n / (acc.n + 1)), acc -> {finish})"
    )


def std_pop(a: str) -> str:
    return _moments(a, "sqrt(try_divide(acc.q, acc.n))")


def std_samp(a: str) -> str:
    return _moments(a, "CASE WHEN acc.n > 1 THEN sqrt(acc.q / (acc.n - 1)) END")


def slope(a: str) -> str:
    """Least-squares slope against 0, 1, 2, …; 0 for fewer than two values."""
    n = f"CAST(size({a}) AS DOUBLE)"
    weighted = f"transform({a}, (x, i) -> x * (i - (size({a}) - 1) / 2))"
    return f"CASE WHEN {n} < 2 THEN 0D ELSE try_divide({total(weighted)} * 12, {n} * ({n} * {n} - 1)) END"


def median(a: str) -> str:
    """Median by linear interpolation, NULL for an empty array."""
    s = f"array_sort({a})"
    return f"(get({s}, CAST(floor((size({a}) - 1) / 2) AS INT)) + get({s}, CAST(floor(size({a}) / 2) AS INT))) / 2"
