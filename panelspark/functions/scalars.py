"""Scalar column functions. Missing values are NULL; no function makes NaN or infinity."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WEEKS = 52
TINY = 1e-12


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def lit(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def div(a: Column | str, b: Column | str) -> Column:
    """a / b, null where b is zero or null."""
    return col(a) / F.nullif(col(b), F.lit(0.0))


def r(c: Column | str, digits: int = 6) -> Column:
    """Rounded, without a negative zero."""
    return F.round(col(c), digits) + F.lit(0.0)


# Coefficients of the rational approximation of the normal quantile (central part, tails), absolute error below 1.2e-9.
_A = (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00)
_B = (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01)
_C = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00)
_D = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00)
_LOW = 0.02425


def _poly(x: Column, coefficients: tuple[float, ...], last: float | None = None) -> Column:
    out = F.lit(coefficients[0])
    for c in coefficients[1:] + ((last,) if last is not None else ()):
        out = out * x + F.lit(c)
    return out


def probit(p: Column | str) -> Column:
    """Inverse of the normal distribution function; null outside (0, 1)."""
    p = col(p)

    def tail(x: Column) -> Column:
        q = F.sqrt(F.lit(-2.0) * F.ln(x))
        return _poly(q, _C) / _poly(q, _D, 1.0)

    q = p - 0.5
    middle = _poly(q * q, _A) * q / _poly(q * q, _B, 1.0)
    return F.when(p <= 0, None).when(p < _LOW, tail(p)).when(p <= 1 - _LOW, middle).when(p < 1, -tail(1 - p))


def with_probit(df: DataFrame, p: str, name: str) -> DataFrame:
    """df with `name`, the probit of its column p, to the same bits: what the polynomials share is in columns of their own. Written out in one expression it is repeated with every
    coefficient, which took several times as long (that the JVM leaves code of that length uncompiled is a guess)."""
    u, q, s, t = (F.col(c) for c in (p, "_pq", "_ps", "_pt"))
    parts = df.withColumn("_pq", u - 0.5).withColumn("_pt", F.sqrt(F.lit(-2.0) * F.ln(F.when(u < _LOW, u).otherwise(1 - u)))).withColumn("_ps", q * q)
    parts = parts.withColumn("_pm", F.when((u >= _LOW) & (u <= 1 - _LOW), _poly(s, _A) * q / _poly(s, _B, 1.0))).withColumn("_pt", _poly(t, _C) / _poly(t, _D, 1.0))
    return parts.withColumn(name, F.when(u <= 0, None).when(u < _LOW, t).when(u <= 1 - _LOW, F.col("_pm")).when(u < 1, -t)).drop("_pq", "_ps", "_pt", "_pm")


def probit_sql(p: str) -> str:
    """The same as SQL text."""

    def poly(x: str, cs: tuple[float, ...], last: float | None = None) -> str:
        out = f"({cs[0]!r})::DOUBLE"
        for c in cs[1:] + ((last,) if last is not None else ()):
            out = f"({out} * {x} + ({c!r})::DOUBLE)"
        return out

    def tail(x: str) -> str:
        q = f"sqrt(-2.0::DOUBLE * ln({x}))"
        return f"{poly(q, _C)} / {poly(q, _D, 1.0)}"

    q = f"({p} - 0.5::DOUBLE)"
    middle = f"{poly(f'({q} * {q})', _A)} * {q} / {poly(f'({q} * {q})', _B, 1.0)}"
    return f"CASE WHEN {p} <= 0 THEN NULL WHEN {p} < {_LOW} THEN {tail(p)} WHEN {p} <= {1 - _LOW} THEN {middle} WHEN {p} < 1 THEN -({tail(f'(1 - {p})')}) END"


def normcdf(x: Column | str) -> Column:
    """The normal distribution function, absolute error below 1e-7 (a rational function of five fixed coefficients)."""
    x = col(x)
    a = F.abs(x)
    t = F.lit(1.0) / (F.lit(1.0) + F.lit(0.2316419) * a)
    upper = F.exp(-a * a / 2) / math.sqrt(2 * math.pi) * t * _poly(t, (1.330274429, -1.821255978, 1.781477937, -0.356563782, 0.319381530))
    return F.when(x >= 0, 1 - upper).otherwise(upper)


def k_of(n: Column | str, q: Column | float, long_short: Column | bool = False) -> Column:
    """How many names a share q of n is: at least one, none of none; with two sides at most half."""
    n = col(n)
    k = F.greatest(F.lit(1).cast("long"), F.ceil(lit(q) * n.cast("double")).cast("long"))
    half = F.floor(n / 2).cast("long")
    k = F.when(lit(long_short), F.least(k, half)).otherwise(k)
    return F.when(n == 0, F.lit(0).cast("long")).otherwise(k)


def exit_k(n: Column | str, k: Column | str, epsilon: Column | float) -> Column:
    """The wider rank at which a held name leaves."""
    return F.least(col(n).cast("long"), F.ceil((F.lit(1.0) + lit(epsilon)) * col(k).cast("double")).cast("long"))


def ramp(p: Column | str, low: float = 0.3, high: float = 0.9, warm: float = 0.5, invert: bool = False) -> Column:
    """Share of the aggressive book: 1 up to low, 0 from high, a straight line between; `warm` while p is missing."""
    p = col(p)
    line = F.when(p <= low, 1.0).when(p >= high, 0.0).otherwise((high - p) / (high - low))
    line = 1 - line if invert else line
    return F.when(p.isNull(), warm).otherwise(line)


def step(p: Column | str, gate: float = 0.9, warm: float = 0.5, invert: bool = False) -> Column:
    """Share of the aggressive book: all of it up to the gate, none above."""
    on = F.when(col(p) <= gate, 1.0).otherwise(0.0)
    return F.when(col(p).isNull(), warm).otherwise(1 - on if invert else on)


def qlike(forecast: Column | str, actual: Column | str) -> Column:
    """x - ln x - 1 of the ratio of variances; null unless both are positive."""
    x = div(col(actual) * col(actual), col(forecast) * col(forecast))
    return F.when((col(actual) > 0) & (col(forecast) > 0), x - F.ln(x) - 1)


def corr_distance(rho: Column | str) -> Column:
    """sqrt(2 (1 - rho)); a missing correlation counts as none."""
    return F.sqrt(F.greatest(F.lit(0.0), 2 * (1 - F.coalesce(col(rho), F.lit(0.0)))))


def kernel(sizing: str, sigma: Column | str = "sigma", pctl: Column | str = "pctl") -> Column:
    """Raw size of a name: eqw, inv_vol, inv_sqrt_vol, or inv_vol_pctl (halved or doubled by where its volatility stands in its own past)."""
    s = col(sigma)
    if sizing == "eqw":
        return F.lit(1.0)
    if sizing == "inv_vol":
        return div(F.lit(1.0), s)
    if sizing == "inv_sqrt_vol":
        return div(F.lit(1.0), F.sqrt(s))
    if sizing == "inv_vol_pctl":
        return div(F.lit(1.0), s) * F.exp(F.lit(math.log(2)) * (0.5 - F.coalesce(col(pctl), F.lit(0.5))))
    raise ValueError(f"unknown sizing {sizing}")


def friday(d: Column | str) -> Column:
    """The Friday on or after a day: the end of its week."""
    return F.next_day(F.date_sub(col(d).cast("date"), 1), "FRI")


def tag(q: float) -> str:
    """Two digits for a share: q05 for 0.05."""
    return f"q{round(q * 100):02d}"


def stub(code: Column | str) -> Column:
    """A code as part of a file name."""
    return F.regexp_replace(col(code).cast("string"), r"\.", "_")
