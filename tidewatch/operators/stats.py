"""Rank tests and fits as aggregations. Tail probabilities are small functions on rows already aggregated."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import stars
from ..sources.scratch import stored
from .order import known, running

def normal_two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def _series(rows, step: float = 1e-16) -> float:
    total = 0.0
    for term in rows:
        total += term
        if abs(term) < step * abs(total):
            break
    return total


def gamma_p(a: float, x: float) -> float:
    """Regularised lower incomplete gamma function."""
    if x <= 0:
        return 0.0
    scale = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:

        def terms():
            t, n = 1 / a, a
            while True:
                yield t
                n += 1
                t *= x / n

        return min(1.0, scale * _series(terms()))
    b, c = x + 1 - a, 1e300
    d = 1 / b
    h = d
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or 1e-300)
        c = b + an / c or 1e-300
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return 1 - scale * h


def beta_i(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_i(b, a, 1 - x)
    scale = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    c, d = 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d or 1e-300)
    h = d
    for m in range(1, 10_000):
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + top * d or 1e-300)
            c = 1 + top / c or 1e-300
            h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return scale * h


def chi2_sf(x: float, df: float) -> float:
    return 1 - gamma_p(df / 2, x / 2)


def t_two_sided(t: float, df: float) -> float:
    return beta_i(df / 2, 0.5, df / (df + t * t))


def kolmogorov_sf(d: float, n: float) -> float:
    """The limit distribution's tail at the effective size n; exact small-sample values differ."""
    x = (math.sqrt(n) + 0.12 + 0.11 / math.sqrt(n)) * d
    return 1.0 if x < 0.2 else max(0.0, min(1.0, 2 * sum((-1) ** (k - 1) * math.exp(-2 * k * k * x * x) for k in range(1, 101))))


#: Up to so many pairs of values, one of each sample, the chance of a two-sample distance is counted, not taken from the limit.
EXACT_PAIRS = 250_000


def kolmogorov_paths(d: float, n: int, m: int) -> float:
    """Chance that samples of n and m values without ties are at least d apart.

    An order of both samples is a lattice path from (0, 0) to (n, m); it is less than d apart where |i / n - j / m| < d all
    along. The paths that stay inside are counted row by row: a row's places inside are one run, and a place gets all of
    the row before from the start of the run on. Good to some twelve digits.
    """
    least, j, scale = round(d * n * m), np.arange(m + 1, dtype=np.int64), 0.0
    row = (j * n < least).astype(float)
    for i in range(1, n + 1):
        inside = np.abs(i * m - j * n) < least
        row = np.cumsum(row * inside) * inside
        if (most := row.max()) > 1e200:
            row, scale = row / most, scale + math.log(most)
    if row[m] <= 0:
        return 1.0
    every = math.lgamma(n + m + 1) - math.lgamma(n + 1) - math.lgamma(m + 1)
    return min(1.0, max(0.0, -math.expm1(math.log(row[m]) + scale - every)))


def two_sample_p(d: float, n: int, m: int) -> float:
    return kolmogorov_paths(d, int(n), int(m)) if n * m <= EXACT_PAIRS else kolmogorov_sf(d, n * m / (n + m))


def _mann_whitney(u: float, n: int, m: int, ties: float) -> float:
    """Exact for groups of at most eight without ties, else the corrected normal approximation."""
    if ties == 0 and min(n, m) <= 8:
        ways = [[0] * (n * m + 1) for _ in range(n + 1)]
        ways[0][0] = 1
        for k in range(1, n + m + 1):
            for i in range(min(n, k), 0, -1):
                for s in range(n * m, -1, -1):
                    if (r := s - (k - i)) >= 0:
                        ways[i][s] += ways[i - 1][r]
        total = sum(ways[n])
        high = max(u, n * m - u)
        return min(1.0, 2 * sum(ways[n][int(math.ceil(high)) :]) / total)
    both = n + m
    sd = math.sqrt(n * m / 12 * ((both + 1) - ties / (both * (both - 1))))
    return 1.0 if sd == 0 else min(1.0, math.erfc(max(0.0, abs(u - n * m / 2) - 0.5) / sd / math.sqrt(2)))


def _kendall(s: float, n: int, tied: float) -> float:
    """Exact for up to 33 rows without ties, by the number of permutations of so few or fewer inversions, else normal with
    the variance corrected for ties; tied: the sum of t (t - 1) (2t + 5) over tied values."""
    pairs = n * (n - 1) // 2
    if tied == 0 and n <= 33:
        ways = [1]
        for i in range(2, n + 1):
            ways = [sum(ways[max(0, k - i + 1) : k + 1]) for k in range(len(ways) + i - 1)]
        against = round((pairs - s) / 2)
        return 1.0 if 2 * against == pairs else min(1.0, 2 * sum(ways[: min(against, pairs - against) + 1]) / math.factorial(n))
    var = (n * (n - 1) * (2 * n + 5) - tied) / 18
    return 1.0 if var <= 0 else normal_two_sided(s / math.sqrt(var))


def _udf(f):
    @F.pandas_udf("double")
    def tail(*columns: pd.Series) -> pd.Series:
        return pd.Series([None if any(pd.isna(v) for v in row) else f(*row) for row in zip(*columns, strict=True)], dtype="float64")

    return tail


def mann_whitney_p(u: str, n: str, m: str, ties: str) -> Column:
    return _udf(lambda u, n, m, t: _mann_whitney(u, int(n), int(m), t))(F.col(u), F.col(n), F.col(m), F.col(ties))


def chi2_p(x: str, df: str) -> Column:
    return _udf(chi2_sf)(F.col(x), F.col(df))


def normal_p(z: str) -> Column:
    return _udf(normal_two_sided)(F.col(z))


def t_p(t: Column, df: Column) -> Column:
    return _udf(t_two_sided)(t, df)


def rank_sums(df: DataFrame, group: str, value: str) -> DataFrame:
    """group, n, rank_sum, with the table's total and tie term: ranks from counts of distinct values, never of all rows.
    Nulls and NaN are missing."""
    counts = stored(df.filter(F.col(group).isNotNull() & known(value)).groupBy(group, value).agg(F.count("*").alias("k")))
    values = running(counts.groupBy(value).agg(F.sum("k").alias("c")), value, ["c"])
    ranked = values.select(value, "c", (F.col("before_c") + (F.col("c") + 1) / 2).alias("avg_rank"))
    joined = counts.join(ranked, value)
    cube = F.col("c").cast("double") * F.col("c") - 1  # over the c rows of a value: c^3 - c in all
    out = joined.groupBy(group).agg(F.sum("k").alias("n"), F.sum(F.col("avg_rank") * F.col("k")).alias("rank_sum"), F.sum(cube * F.col("k")).alias("ties"))
    everything = Window.partitionBy()  # one row a group
    return stored(out.withColumn("total", F.sum("n").over(everything)).withColumn("tie_sum", F.sum("ties").over(everything)).drop("ties"))


def kruskal_wallis(sums: DataFrame) -> DataFrame:
    """One row from rank_sums: H corrected for ties, degrees of freedom, p."""
    n = F.max("total")
    h = F.lit(12.0) / (n * (n + 1)) * F.sum(F.col("rank_sum") * F.col("rank_sum") / F.col("n")) - 3 * (n + 1)
    fix = 1 - F.max("tie_sum") / (n.cast("double") * n * n - n)
    out = sums.agg(F.when(fix > 0, h / fix).alias("h_stat"), (F.count("*") - 1).alias("df"))
    return out.withColumn("p", chi2_p("h_stat", "df"))


def dunn_test(sums: DataFrame, group: str) -> DataFrame:
    """Every two groups: z of the difference of mean ranks, p, p times the number of pairs, stars."""
    a = sums.select(F.col(group).alias("group_1"), F.col("n").alias("n1"), (F.col("rank_sum") / F.col("n")).alias("m1"), "total", "tie_sum")
    b = sums.select(F.col(group).alias("group_2"), F.col("n").alias("n2"), (F.col("rank_sum") / F.col("n")).alias("m2"))
    n = F.col("total").cast("double")
    se = F.sqrt((n * (n + 1) / 12 - F.col("tie_sum") / (12 * (n - 1))) * (1 / F.col("n1") + 1 / F.col("n2")))
    out = a.join(F.broadcast(b), F.col("group_1") < F.col("group_2")).withColumn("z", (F.col("m1") - F.col("m2")) / se)  # one row a group
    out = out.withColumn("p_raw", normal_p("z"))
    bonf = F.least(F.col("p_raw") * F.count("*").over(Window.partitionBy()), F.lit(1.0))
    return out.select("group_1", "group_2", F.round("z", 3).alias("z_stat"), "p_raw", bonf.alias("p_bonf"), stars(bonf).alias("sig"))


def ks_two_sample(df: DataFrame, group: str, value: str, first: str, second: str) -> DataFrame:
    """One row: the largest distance of two groups' distribution functions, and its p: counted for up to EXACT_PAIRS pairs of
    values, of the limit distribution beyond. No row where a group has five known values or fewer."""
    counts = stored(df.filter(F.col(group).isin(first, second) & known(value)).groupBy(value).agg(F.count_if(F.col(group) == first).alias("a"), F.count_if(F.col(group) == second).alias("b")))
    sizes = counts.agg(F.sum("a").alias("n_1"), F.sum("b").alias("n_2")).filter("n_1 > 5 AND n_2 > 5")
    rows = running(counts, value, ["a", "b"]).crossJoin(F.broadcast(sizes))  # one row
    d = F.abs((F.col("before_a") + F.col("a")) / F.col("n_1") - (F.col("before_b") + F.col("b")) / F.col("n_2"))
    out = rows.groupBy("n_1", "n_2").agg(F.max(d).alias("d_stat")).select("d_stat", "n_1", "n_2")
    return out.withColumn("p", _udf(two_sample_p)(F.col("d_stat"), F.col("n_1"), F.col("n_2")))


def kendall_trend(df: DataFrame, group: str, order: str, value: str, least: int = 4) -> DataFrame:
    """Tau-b of value against order in each group of at least `least` rows, its p (exact for few rows) and direction; one row a year."""
    a = df.select(group, F.col(order).alias("x1"), F.col(value).alias("y1"))
    b = df.select(group, F.col(order).alias("x2"), F.col(value).alias("y2"))
    pairs = a.join(b, group).filter("x1 < x2")
    s = F.signum(F.col("y2") - F.col("y1"))
    sums = pairs.groupBy(group).agg(F.sum(s).alias("s"), F.count("*").alias("pairs"), F.count_if(s == 0).alias("tied"))
    c = F.col("c").cast("double")
    n = df.groupBy(group, value).agg(F.count("*").alias("c")).groupBy(group).agg(F.sum("c").alias("n"), F.sum(c * (c - 1) * (2 * c + 5)).alias("tied_sum"))
    n = n.filter(F.col("n") >= least)
    out = sums.join(n, group).withColumn("tau", F.try_divide(F.col("s"), F.sqrt(F.col("pairs").cast("double") * (F.col("pairs") - F.col("tied")))))
    out = out.withColumn("p", _udf(lambda s, n, t: _kendall(s, int(n), t))(F.col("s"), F.col("n"), F.col("tied_sum")))
    return out.select(group, "n", "tau", "p", F.when(F.col("tau") > 0, "increasing").when(F.col("tau") < 0, "decreasing").otherwise("flat").alias("direction"), stars(F.col("p")).alias("sig"))


def linregress(df: DataFrame, groups: list[str], x: str, y: str) -> DataFrame:
    """Least squares by group with the slope's two-sided p."""
    out = df.groupBy(*groups).agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_r2(y, x).alias("r_squared"), F.count("*").alias("n"))
    r2 = F.col("r_squared")
    t = F.when((F.col("n") > 2) & (r2 < 1), F.sqrt(r2 * (F.col("n") - 2) / (1 - r2)))
    return out.withColumn("p", t_p(t, (F.col("n") - 2).cast("double")))
