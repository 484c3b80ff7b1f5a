"""Two-sided Fisher exact test over columns, in Arrow batches."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

TOLERANCE = 1e-14


#: Tables up to this total are added up term by term over their whole support.
SMALL = 2000


def log_factorial(k: np.ndarray | int) -> np.ndarray:
    """ln k!, by Stirling's series from 16 on and a table below."""
    k = np.asarray(k, np.float64)
    low = np.concatenate([[0.0], np.cumsum(np.log(np.arange(1, 16, dtype=np.float64)))])
    n = np.maximum(k, 16.0)
    series = n * np.log(n) - n + 0.5 * np.log(2 * np.pi * n) + 1 / (12 * n) - 1 / (360 * n**3) + 1 / (1260 * n**5)
    return np.where(k < 16, low[np.minimum(k, 15).astype(np.int64)], series)


def two_sided(a: int, b: int, c: int, d: int) -> float:
    """p of the table ((a, b), (c, d)): all tables with the same margins that are no more likely; 1 if a margin is empty.

    The likelihood falls to both sides of its mode, so the tables wanted are two
    tails. Each is summed from its likely end for as many terms as can still
    count, some multiple of the standard deviation; time and memory grow with
    the root of the total.
    """
    first, second, column = a + b, c + d, a + c
    if 0 in (first, second, column, b + d):
        return 1.0
    total, low, high = first + second, max(0, column - second), min(first, column)
    base = log_factorial(first) + log_factorial(second) + log_factorial(column) + log_factorial(total - column) - log_factorial(total)

    def log_p(k: np.ndarray) -> np.ndarray:
        return base - log_factorial(k) - log_factorial(first - k) - log_factorial(column - k) - log_factorial(second - column + k)

    limit = float(log_p(np.array([a]))[0]) + np.log1p(TOLERANCE) + 1e-15 * total + 1e-11
    if total <= SMALL:
        terms = log_p(np.arange(low, high + 1))
        return float(min(1.0, np.exp(terms[terms <= limit]).sum()))
    mode = min(high, max(low, (first + 1) * (column + 1) // (total + 2)))
    if float(log_p(np.array([mode]))[0]) <= limit:
        return 1.0

    def edge(inner: int, outer: int) -> int | None:
        """The place nearest to the mode that is no more likely than the limit, by halving."""
        if float(log_p(np.array([outer]))[0]) > limit:
            return None
        while abs(outer - inner) > 1:
            middle = (inner + outer) // 2
            inner, outer = (inner, middle) if float(log_p(np.array([middle]))[0]) <= limit else (middle, outer)
        return outer

    reach = 50 * int(np.sqrt(float(first) * column / total * (1 - column / total) * (1 - first / total)) + 1) + 50
    left, right = edge(mode, low), edge(mode, high)
    tails = [np.arange(max(low, left - reach), left + 1)] if left is not None else []
    tails += [np.arange(right, min(high, right + reach) + 1)] if right is not None else []
    return float(min(1.0, sum(np.exp(log_p(t)).sum() for t in tails)))


@F.pandas_udf(DoubleType())
def fisher_p(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
    return pd.Series([two_sided(int(w), int(x), int(y), int(z)) for w, x, y, z in zip(a, b, c, d, strict=True)], dtype=float)
