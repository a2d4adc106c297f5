"""Parametric distributions of number columns, fitted to moments that one aggregate gives.

Every family is fitted from count, mean, variance, least and largest value, so a table is read
once for all columns and families. How well a family fits is its Kolmogorov-Smirnov distance
to the column's quantiles, which a sketch of fixed size holds; ``best`` takes the closest.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions import exprs

#: Names of families by which they are known elsewhere (fixed values).
ALIASES = {"gaussian": "norm", "normal": "norm"}
FAMILIES = ("norm", "truncnorm", "uniform", "gamma", "beta")
#: Places at which a distribution function is tabled before it is inverted.
GRID = 4097


def family_of(name: str) -> str:
    """The family of a name; unknown ones are an error."""
    low = name.strip().lower()
    low = ALIASES.get(low, low)
    if low not in (*FAMILIES, "best", "empirical"):
        raise ValueError(f"unknown distribution {name!r}: one of {', '.join((*FAMILIES, 'best', 'empirical'))}")
    return low


def normal_cdf(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.vectorize(math.erfc, otypes=[float])(-np.asarray(x, float) / math.sqrt(2))


def gamma_cdf(k: float, x: np.ndarray) -> np.ndarray:
    """The regularized lower incomplete gamma function: its power series below k + 1, a continued fraction for the rest above."""
    x = np.maximum(np.asarray(x, float), 0.0)
    low, out = x < k + 1, np.zeros_like(x)
    front = lambda v: np.exp(k * np.log(np.maximum(v, 1e-300)) - v - math.lgamma(k))
    v = x[low]
    term = total = np.full_like(v, 1 / k)
    for n in range(1, 400):
        term = term * v / (k + n)
        total = total + term
    out[low] = total * front(v)
    v = x[~low]
    if len(v):
        # evaluated from its far end: q = front / (v + (1 - k) / (1 + 1 / (v + (2 - k) / (1 + 2 / ...))))
        tail = v.copy()
        for n in range(300, 0, -1):
            tail = v + (n - k) / (1 + n / tail)
        out[~low] = 1 - front(v) / tail
    return np.clip(np.where(x > 0, out, 0.0), 0, 1)


def beta_cdf(a: float, b: float, x: np.ndarray) -> np.ndarray:
    """The regularized incomplete beta function by its continued fraction, from the far end."""
    x = np.clip(np.asarray(x, float), 0.0, 1.0)
    turned = x > (a + 1) / (a + b + 2)

    def below(p: float, q: float, v: np.ndarray) -> np.ndarray:
        part = np.ones_like(v)
        for m in range(300, 0, -1):
            odd = -(p + m - 1) * (p + q + m - 1) * v / ((p + 2 * m - 2) * (p + 2 * m - 1))
            even = m * (q - m) * v / ((p + 2 * m - 1) * (p + 2 * m))
            part = 1 + odd / (1 + even / part)
        log = p * np.log(np.maximum(v, 1e-300)) + q * np.log(np.maximum(1 - v, 1e-300)) - (math.lgamma(p) + math.lgamma(q) - math.lgamma(p + q))
        return np.where(v > 0, np.exp(log) / (p * part), 0.0)

    out = np.empty_like(x)
    out[~turned], out[turned] = below(a, b, x[~turned]), 1 - below(b, a, 1 - x[turned])
    return np.clip(out, 0, 1)


def truncated_moments(mean: float, sd: float, low: float, high: float) -> tuple[float, float]:
    """Mean and deviation of a normal distribution that is cut at both ends."""
    a, b = (low - mean) / sd, (high - mean) / sd
    density = lambda z: math.exp(-z * z / 2) / math.sqrt(2 * math.pi)
    mass = max(1e-12, 0.5 * (math.erfc(a / math.sqrt(2)) - math.erfc(b / math.sqrt(2))))
    shift = (density(a) - density(b)) / mass
    return mean + sd * shift, sd * math.sqrt(max(1e-12, 1 + (a * density(a) - b * density(b)) / mass - shift * shift))


def fit(family: str, n: int, mean: float, variance: float, low: float, high: float) -> tuple[float, float] | None:
    """The two parameters of a family by its moments; None where it has none to offer."""
    width, sd = high - low, math.sqrt(max(variance, 0.0))
    if n < 1 or width <= 0 or sd <= 0:
        return None
    if family == "norm":
        return mean, sd
    if family == "uniform":
        return low, width
    if family == "gamma":  # shape and scale above the least value
        return (mean - low) ** 2 / variance, variance / (mean - low)
    if family == "beta":  # on the range of the values
        m, v = (mean - low) / width, variance / width**2
        common = m * (1 - m) / v - 1
        return (m * common, (1 - m) * common) if common > 0 else None
    centre, spread = mean, sd
    for _ in range(500):
        m, s = truncated_moments(centre, spread, low, high)
        step = (mean - m, sd / s)
        centre += 0.5 * step[0]
        spread = min(10 * width, spread * step[1] ** 0.5)
        centre = min(high + 3 * width, max(low - 3 * width, centre))
        if abs(step[0]) < 1e-10 * width and abs(step[1] - 1) < 1e-10:
            break
    return centre, spread


def cdf(family: str, parameters: tuple[float, float], low: float, high: float, x: np.ndarray) -> np.ndarray:
    a, b = parameters
    x = np.asarray(x, float)
    if family == "norm":
        return normal_cdf((x - a) / b)
    if family == "uniform":
        return np.clip((x - a) / b, 0, 1)
    if family == "gamma":
        return gamma_cdf(a, (x - low) / b)
    if family == "beta":
        return beta_cdf(a, b, (x - low) / (high - low))
    ends = normal_cdf(np.array([(low - a) / b, (high - a) / b]))
    return np.clip((normal_cdf((x - a) / b) - ends[0]) / max(1e-12, ends[1] - ends[0]), 0, 1)


def quantile_knots(family: str, parameters: tuple[float, float], low: float, high: float, knots: int, bounded: bool = True) -> list[float]:
    """The values of evenly spaced shares, within the learnt range or, unbounded, from 1e-6 to 1 - 1e-6 at the ends."""
    shares = np.clip(np.linspace(0, 1, knots), 1e-6, 1 - 1e-6)
    far = {"norm": parameters[1] * 5.0, "gamma": parameters[1] * (12 + 6 * math.sqrt(max(parameters[0], 1e-9)) + parameters[0])}.get(family, 0.0)
    begin, end = (min(low, parameters[0] - far), max(high, parameters[0] + far)) if family == "norm" else (low, max(high, low + far))
    # finer near the ends, where distributions of that kind rise steeply
    grid = begin + (end - begin) * (1 - np.cos(np.linspace(0, math.pi, GRID))) / 2
    values = np.interp(shares, np.maximum.accumulate(cdf(family, parameters, low, high, grid)), grid)
    return [float(v) for v in (np.clip(values, low, high) if bounded else values)]


def ks_of(family: str, parameters: tuple[float, float], low: float, high: float, quantiles: list[float]) -> float:
    """The largest gap between the distribution and the shares of evenly spaced quantiles; runs of equal ones count at both ends."""
    q, shares = np.asarray(quantiles, float), np.linspace(0, 1, len(quantiles))
    values, first = np.unique(q, return_index=True)
    last = np.append(first[1:], len(q)) - 1
    at = cdf(family, parameters, low, high, values)
    return float(max(np.abs(at - shares[last]).max(), np.abs(at - shares[first]).max()))


def moments(values: dict[str, Column]) -> list[Column]:
    """Aggregates, five a column, that ``read_moments`` takes apart."""
    return [f(v).alias(f"{k} {c}") for c, v in values.items() for k, f in (("n", F.count), ("m", F.avg), ("v", F.var_pop), ("l", F.min), ("h", F.max))]


def read_moments(row, column: str) -> tuple[int, float, float, float, float] | None:
    """(n, mean, variance, least, largest) of a column with values."""
    return tuple(row[f"{k} {column}"] for k in "nmvlh") if row[f"n {column}"] else None


def chosen(name: str, known: tuple | None, quantiles: list[float]) -> tuple[str, tuple[float, float], float] | None:
    """(family, parameters, KS distance) of a family, or of the closest one for ``best``; None where none fits."""
    if known is None or name == "empirical":
        return None
    fits = [(f, p, ks_of(f, p, known[3], known[4], quantiles)) for f in (FAMILIES if name == "best" else (name,)) if (p := fit(f, *known))]
    return min(fits, key=lambda x: x[2], default=None)


def fitted(df: DataFrame, columns: list[str], families: tuple[str, ...] = FAMILIES, knots: int = 257) -> DataFrame:
    """(column_name, distribution, first, second, low, high, ks, best): what each family makes of each column.

    norm: mean and deviation; truncnorm: those of the whole normal distribution; uniform: start
    and width; gamma: shape and scale above ``low``; beta: its two shapes between ``low`` and
    ``high``. A column without two different values has no rows.
    """
    values = {c: exprs.number(c) for c in columns}
    points = [i / (knots - 1) for i in range(knots)]
    row = df.agg(*moments(values), *(F.percentile_approx(v, points, 10_000).alias(f"q {c}") for c, v in values.items())).first()
    out = []
    for c in columns:
        if (known := read_moments(row, c)) is None:
            continue
        fits = [(f, p, ks_of(f, p, known[3], known[4], row[f"q {c}"])) for f in map(family_of, families) if (p := fit(f, *known))]
        nearest = min((k for *_, k in fits), default=None)
        out += [(c, f, float(p[0]), float(p[1]), float(known[3]), float(known[4]), k, k == nearest) for f, p, k in fits]
    return df.sparkSession.createDataFrame(out, "column_name string, distribution string, first double, second double, low double, high double, ks double, best boolean")
