"""Special functions as column expressions: series and continued fractions folded over a sequence, never a call a row.

Arguments are positive doubles unless said otherwise; null gives null. Good to some twelve digits.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Arguments are moved up by so much before an asymptotic series is used.
SHIFT = 10


def lgamma(x: Column) -> Column:
    s = x + SHIFT
    y = 1 / (s * s)
    tail = (F.lit(1 / 12) - y * (F.lit(1 / 360) - y * (F.lit(1 / 1260) - y * (F.lit(1 / 1680) - y / 1188)))) / s
    return (s - 0.5) * F.log(s) - s + math.log(2 * math.pi) / 2 + tail - sum((F.log(x + i) for i in range(1, SHIFT)), F.log(x))


def digamma(x: Column) -> Column:
    s = x + SHIFT
    y = 1 / (s * s)
    tail = F.log(s) - 0.5 / s - y * (F.lit(1 / 12) - y * (F.lit(1 / 120) - y * (F.lit(1 / 252) - y * (F.lit(1 / 240) - y / 132))))
    return tail - sum((1 / (x + i) for i in range(1, SHIFT)), 1 / x)


def trigamma(x: Column) -> Column:
    s = x + SHIFT
    y = 1 / (s * s)
    tail = 1 / s + y / 2 + y / s * (F.lit(1 / 6) - y * (F.lit(1 / 30) - y * (F.lit(1 / 42) - y * (F.lit(1 / 30) - y * 5 / 66))))
    return tail + sum((1 / ((x + i) * (x + i)) for i in range(1, SHIFT)), 1 / (x * x))


def _series(first: Column, ratio, terms: Column) -> Column:
    """first * (1 + r(1) + r(1) r(2) + ...), all positive, so many terms."""
    start = F.struct(first.alias("t"), first.alias("s"))

    def step(acc: Column, i: Column) -> Column:
        t = acc["t"] * ratio(i)
        return F.struct(t.alias("t"), (acc["s"] + t).alias("s"))

    return F.aggregate(F.sequence(F.lit(1), terms.cast("int")), start, step, lambda acc: acc["s"])


def gamma_p(a: Column, x: Column) -> Column:
    """Regularised lower incomplete gamma function, x >= 0: its series of positive terms, 1 where the rest is below 1e-16."""
    far = x > a + 12 * F.sqrt(a) + 60
    terms = F.when(far, 1).otherwise(F.greatest(x - a, F.lit(0.0)) + 9 * F.sqrt(x) + 30)
    inside = F.exp(a * F.log(x) - x - lgamma(a)) * _series(1 / a, lambda i: x / (a + i), terms)
    return F.when(x <= 0, 0.0).when(far, 1.0).otherwise(F.least(inside, F.lit(1.0)))


def beta_i(a: Column, b: Column, x: Column) -> Column:
    """Regularised incomplete beta function, 0 <= x <= 1, by the series of positive terms on the side of the smaller tail."""
    turn = x > (a + 1) / (a + b + 2)
    p, q, y = F.when(turn, b).otherwise(a), F.when(turn, a).otherwise(b), F.when(turn, 1 - x).otherwise(x)
    terms = F.least(F.lit(20_000.0), 40 / -F.log(y) + 9 * F.sqrt(a + b) + 30)
    inside = F.exp(lgamma(a + b) - lgamma(a) - lgamma(b) + p * F.log(y) + q * F.log1p(-y)) * _series(1 / p, lambda i: y * (p + q + i - 1) / (p + i), terms)
    return F.when(x <= 0, 0.0).when(x >= 1, 1.0).when(turn, 1 - inside).otherwise(inside)


def erfcx(y: Column) -> Column:
    """exp(y^2) erfc(y) for y >= 0: a continued fraction from its 150th level up from 1 on, the gamma series below."""
    fraction = F.aggregate(F.sequence(F.lit(150), F.lit(1), F.lit(-1)), y, lambda f, k: y + k / 2 / f)
    return F.when(y >= 1, 1 / (math.sqrt(math.pi) * fraction)).otherwise(F.exp(y * y) * (1 - gamma_p(F.lit(0.5), y * y)))


def normal_cdf(z: Column) -> Column:
    tail = F.exp(-z * z / 2) * erfcx(F.abs(z) / math.sqrt(2)) / 2
    return F.when(z < 0, tail).otherwise(1 - tail)


# Coefficients of the published rational approximation AS 241 (PPND16) of the normal quantile, from the
# highest power down, numerator and denominator: the middle, the tails, the far tails.
MIDDLE = (
    (2509.0809287301226727, 33430.575583588128105, 67265.770927008700853, 45921.953931549871457, 13731.693765509461125, 1971.5909503065514427, 133.14166789178437745, 3.387132872796366608),
    (5226.495278852545925, 28729.085735721942674, 39307.89580009271061, 21213.794301586595867, 5394.1960214247511077, 687.1870074920579083, 42.313330701600911252, 1.0),
)
TAIL = (
    (7.7454501427834140764e-4, 0.0227238449892691845833, 0.24178072517745061177, 1.27045825245236838258, 3.64784832476320460504, 5.7694972214606914055, 4.6303378461565452959, 1.42343711074968357734),
    (1.05075007164441684324e-9, 5.475938084995344946e-4, 0.0151986665636164571966, 0.14810397642748007459, 0.68976733498510000455, 1.6763848301838038494, 2.05319162663775882187, 1.0),
)
FAR = (
    (2.01033439929228813265e-7, 2.71155556874348757815e-5, 0.0012426609473880784386, 0.026532189526576123093, 0.29656057182850489123, 1.7848265399172913358, 5.4637849111641143699, 6.6579046435011037772),
    (2.04426310338993978564e-15, 1.4215117583164458887e-7, 1.8463183175100546818e-5, 7.868691311456132591e-4, 0.0148753612908506148525, 0.13692988092273580531, 0.59983220655588793769, 1.0),
)


def normal_quantile(p: Column) -> Column:
    """z with normal_cdf(z) = p, 0 < p < 1."""

    def ratio(table, x: Column) -> Column:
        top, bottom = (_horner(c, x) for c in table)
        return top / bottom

    q = p - 0.5
    r = F.sqrt(-F.log(F.least(p, 1 - p)))
    out = F.when(r <= 5, ratio(TAIL, r - 1.6)).otherwise(ratio(FAR, r - 5))
    return F.when(F.abs(q) <= 0.425, q * ratio(MIDDLE, 0.180625 - q * q)).otherwise(F.signum(q) * out)


def _horner(coefficients: tuple[float, ...], x: Column) -> Column:
    out = F.lit(coefficients[0])
    for c in coefficients[1:]:
        out = out * x + c
    return out
