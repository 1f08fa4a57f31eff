"""Deterministic samples by hashed order, and what is estimated from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import quantile
from ..functions.special import beta_i, digamma, erfcx, gamma_p, normal_cdf, trigamma
from ..sources.scratch import stored
from .order import known, running

SEED = "42"


def hashed(*keys: str, seed: str = SEED) -> Column:
    return F.md5(F.concat_ws("#", *keys, F.lit(seed)).cast("binary"))


def cap_sample(df: DataFrame, keys: list[str], n: int) -> DataFrame:
    """n rows without replacement."""
    return df.withColumn("__h", hashed(*keys)).orderBy("__h").limit(n).drop("__h")


def stratified_sample(long: DataFrame, per_year: int = 5000, zeros: float = 0.3) -> DataFrame:
    """Of each year and band at most the given share of zeros and the rest of positive values: those of the least hashes.

    How many rows begin with which four digits of the hash tells where the last row of a sample stands; only the rows up
    to there are ordered, some few more than the sample holds, so no task sorts a stratum.
    """
    stratum = F.when(F.col("value") == 0, "zero").when(F.col("value") > 0, "positive")
    keys = ["year", "band", "stratum"]
    rows = long.withColumn("stratum", stratum).filter("stratum IS NOT NULL").withColumn("__h", hashed("row", "col")).withColumn("__d", F.substring("__h", 1, 4))
    cap = F.when(F.col("stratum") == "zero", int(per_year * zeros)).otherwise(per_year - int(per_year * zeros))
    digits = rows.groupBy(*keys, "__d").agg(F.count("*").alias("__k"))  # 65,536 rows a stratum at most
    before = F.sum("__k").over(Window.partitionBy(*keys).orderBy("__d")) - F.col("__k")
    last = digits.withColumn("__before", before).filter(F.col("__before") < cap).groupBy(*keys).agg(F.max("__d").alias("__last"))
    near = rows.join(last, keys).filter("__d <= __last")
    n = F.row_number().over(Window.partitionBy(*keys).orderBy("__h", "row", "col"))
    return near.withColumn("__n", n).filter(F.col("__n") <= cap).select(*long.columns, "stratum")


def systematic_sample(df: DataFrame, order: list[str], most: int) -> DataFrame:
    """Every k-th row in the given order, `most` at most. Numbers come from counts by the first column, then within it."""
    first = order[0]
    groups = df.groupBy(first).agg(F.count("*").alias("__c"))
    groups = groups.withColumn("__before", F.sum("__c").over(Window.orderBy(first)) - F.col("__c")).withColumn("__all", F.sum("__c").over(Window.partitionBy()))
    rows = df.join(groups, first).withColumn("__i", F.col("__before") + F.row_number().over(Window.partitionBy(first).orderBy(*order[1:])) - 1)
    step = F.greatest(F.floor(F.col("__all") / most), F.lit(1))
    return rows.filter((F.col("__i") % step == 0) & (F.col("__i") / step < most)).withColumn("sample_no", F.floor(F.col("__i") / step)).drop("__c", "__before", "__all", "__i")


def variogram(points: DataFrame, value: str, bins: int = 12, least: int = 5, share: float = 0.6) -> DataFrame:
    """Half the mean squared difference by distance, up to the given percentile of distances; points is a bounded sample."""
    a = points.select(F.col("sample_no").alias("i"), F.col("row").alias("r1"), F.col("col").alias("c1"), F.col(value).alias("v1"))
    b = points.select(F.col("sample_no").alias("j"), F.col("row").alias("r2"), F.col("col").alias("c2"), F.col(value).alias("v2"))
    pairs = a.join(F.broadcast(b), F.col("i") < F.col("j"))  # at most 1500 points
    pairs = pairs.select(F.sqrt(((F.col("r1") - F.col("r2")) ** 2 + (F.col("c1") - F.col("c2")) ** 2).cast("double")).alias("dist"), ((F.col("v1") - F.col("v2")) ** 2 / 2).alias("half"))
    far = pairs.agg(quantile("dist", share).alias("far"))
    rows = pairs.crossJoin(F.broadcast(far)).withColumn("bin", F.floor(F.col("dist") / (F.col("far") / bins)).cast("int")).filter(F.col("bin") < bins)
    out = rows.groupBy("bin").agg(F.avg("half").alias("semivariance"), F.count("*").alias("pairs"), ((F.col("bin") + 0.5) * F.first("far") / bins).alias("center"))
    return out.filter(F.col("pairs") > least)


#: Candidates, and the shapes at which one pass takes the slope of the Weibull likelihood.
FAMILIES = ("beta", "gamma", "invgauss", "lognorm", "weibull_min")
SHAPES, PASSES, SPREAD = 16, 5, 16.0


def _fold(steps: int, start: Column, step) -> Column:
    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, lambda acc, _: step(acc))


def _gamma_shape(gap: Column) -> Column:
    """k with log k - digamma(k) = gap, the log of the mean less the mean of logs, by Newton's method on 1 / k."""
    start = (3 - gap + F.sqrt((gap - 3) * (gap - 3) + 24 * gap)) / (12 * gap)
    return _fold(25, start, lambda k: 1 / (1 / k + (F.log(k) - digamma(k) - gap) / (k * k * (1 / k - trigamma(k)))))


def _beta_shapes(m: Column, v: Column, l: Column, l1: Column) -> Column:  # noqa: E741
    """(a, b) whose means of log x and log (1 - x) are l and l1, by Newton's method in both from the moments on."""
    t = m * (1 - m) / v - 1
    start = F.struct(F.greatest(m * t, F.lit(0.01)).alias("a"), F.greatest((1 - m) * t, F.lit(0.01)).alias("b"))

    def step(at: Column) -> Column:
        a, b = at["a"], at["b"]
        both, slope = digamma(a + b), trigamma(a + b)
        g, h = digamma(a) - both - l, digamma(b) - both - l1
        p, q = trigamma(a), trigamma(b)
        det = p * q - slope * (p + q)
        a2, b2 = a - (g * (q - slope) + slope * h) / det, b - (h * (p - slope) + slope * g) / det
        return F.struct(F.when(a2 > 0, a2).otherwise(a / 2).alias("a"), F.when(b2 > 0, b2).otherwise(b / 2).alias("b"))

    return _fold(60, start, step)


def _weibull(counts: DataFrame, moments: DataFrame, groups: list[str]) -> DataFrame:
    """groups, k, scale. The likelihood's slope rises with the shape k: each of a few aggregations over the counts takes it
    at SHAPES + 1 shapes at once and the next goes on between the two where it crosses 0; a line crosses the last gap."""
    known = moments.select(*groups, "n", "m", (F.col("l") - F.log("m")).alias("level"), (1.2 / F.col("sl") / SPREAD).alias("low"), (1.2 / F.col("sl") * SPREAD).alias("high"))
    u = F.log(F.col("x") / F.col("m"))
    for _ in range(PASSES):
        shape = [F.col("low") * F.pow(F.col("high") / F.col("low"), F.lit(i / SHAPES)) for i in range(SHAPES + 1)]
        keys = [*groups, "n", "m", "level", "low", "high"]
        sums = [F.sum(F.exp(k * u) * F.col("c")).alias(f"p{i}") for i, k in enumerate(shape)] + [F.sum(F.exp(k * u) * u * F.col("c")).alias(f"q{i}") for i, k in enumerate(shape)]
        rows = joined(counts, known, groups).groupBy(*keys).agg(*sums)
        points = F.array(*[F.struct(k.alias("k"), (F.col(f"q{i}") / F.col(f"p{i}") - 1 / k - F.col("level")).alias("s")) for i, k in enumerate(shape)])
        rows = rows.select(*groups, "n", "m", "level", points.alias("at"))
        up = F.filter("at", lambda e: e["s"] > 0)
        down = F.filter("at", lambda e: e["s"] <= 0)
        # without a crossing inside, the end nearer to 0 counts
        rows = rows.select(*groups, "n", "m", "level", F.coalesce(F.get(down, F.size(down) - 1), F.get("at", F.lit(0))).alias("lo"), F.coalesce(F.get(up, F.lit(0)), F.get("at", F.lit(SHAPES))).alias("hi"))
        known = rows.select(*groups, "n", "m", "level", F.col("lo.k").alias("low"), F.col("hi.k").alias("high"), F.col("lo.s").alias("s_low"), F.col("hi.s").alias("s_high"))
    gap = F.log(F.col("high") / F.col("low"))
    k = F.when(F.col("s_high") > F.col("s_low"), F.col("low") * F.exp(gap * F.col("s_low") / (F.col("s_low") - F.col("s_high")))).otherwise(F.col("low"))
    known = known.select(*groups, "n", "m", k.alias("k"))
    rows = joined(counts, known, groups).groupBy(*groups, "n", "m", "k").agg(F.sum(F.exp(F.col("k") * u) * F.col("c")).alias("p"))
    return rows.select(*groups, "k", (F.col("m") * F.pow(F.col("p") / F.col("n"), 1 / F.col("k"))).alias("scale"))


def joined(rows: DataFrame, table: DataFrame, groups: list[str]) -> DataFrame:
    """rows beside the one row that table has for their group; groups are not null."""
    return rows.join(table, groups) if groups else rows.crossJoin(F.broadcast(table))  # one row


def fit_groups(sample: DataFrame, value: str, groups: list[str], bounded: Column | bool = False, least: int = 100) -> DataFrame:
    """For each group of more than `least` positive values and each candidate: its two parameters by maximum likelihood
    (all distributions start at 0), the Kolmogorov-Smirnov distance, and whether it is the chosen one, that of the least.

    Candidates are gamma, log-normal, Weibull, inverse Gaussian and, where `bounded` says so, beta. All of it is one
    declarative plan over the counts of distinct values, which are written once: no value goes to Python, nothing to the
    driver. Values that are null, NaN or not positive, and null groups, are left out; a group of one value has no fit.
    """
    some = sample.filter((F.col(value) > 0) & known(value))
    for g in groups:
        some = some.filter(F.col(g).isNotNull())
    counts = stored(some.select(*groups, F.col(value).cast("double").alias("x"), F.lit(bounded).alias("bounded") if isinstance(bounded, bool) else bounded.alias("bounded")).groupBy(*groups, "x").agg(F.count("*").alias("c"), F.max("bounded").alias("bounded")))
    x, log, c = F.col("x"), F.log("x"), F.col("c")
    mean = lambda e: F.sum(e * c) / F.sum(F.when(e.isNotNull(), c))
    sums = counts.groupBy(*groups).agg(F.sum(c).alias("n"), F.max("bounded").alias("bounded"), F.max(x).alias("most"), mean(x).alias("m"), mean(log).alias("l"), mean(1 / x).alias("inv"), mean(F.when(x < 1, F.log1p(-x))).alias("l1")).filter(F.col("n") > least)
    around = joined(counts.drop("bounded"), sums, groups).groupBy(*groups, "n", "bounded", "most", "m", "l", "inv", "l1")
    moments = around.agg(F.sqrt(mean((log - F.col("l")) ** 2)).alias("sl"), mean((x - F.col("m")) ** 2).alias("v")).filter("sl > 0")
    shapes = joined(moments, _weibull(counts, moments, groups).withColumnsRenamed({"k": "wk", "scale": "ws"}), groups)
    k, ab = _gamma_shape(F.log("m") - F.col("l")), _beta_shapes(F.col("m"), F.col("v"), F.col("l"), F.col("l1"))
    can = F.col("bounded") & F.col("l1").isNotNull() & (F.col("v") > 0) & (F.col("m") < 1)
    shapes = shapes.withColumn("k", k).withColumn("ab", F.when(can, ab))
    each = [("gamma", F.col("k"), F.col("m") / F.col("k")), ("lognorm", F.col("sl"), F.exp("l")), ("invgauss", F.col("m"), 1 / (F.col("inv") - 1 / F.col("m"))), ("weibull_min", F.col("wk"), F.col("ws")), ("beta", F.col("ab.a"), F.col("ab.b"))]
    table = shapes.select(*groups, F.inline(F.array(*[F.struct(F.lit(n).alias("distribution"), a.alias("a"), b.alias("b")) for n, a, b in each]))).filter("a IS NOT NULL")
    fits = ks_one_sample(counts.drop("bounded"), table, groups)
    best = F.row_number().over(Window.partitionBy(*groups).orderBy("ks", "distribution")) == 1  # five rows
    return fits.withColumn("chosen", best)


def fit_positive_distribution(sample: DataFrame, value: str, bounded: bool = False, least: int = 100) -> DataFrame | None:
    """fit_groups() of a whole table; None for samples of `least` positive values or fewer."""
    some = stored(sample.filter((F.col(value) > 0) & known(value)).select(F.col(value).cast("double").alias(value)))
    return fit_groups(some, value, [], bounded, least) if some.count() > least else None


def cdf(name: Column, a: Column, b: Column, x: Column) -> Column:
    """Distribution functions of the candidates."""
    root = F.sqrt(b / x)
    near = root * (x / a - 1)
    wald = normal_cdf(near) + F.exp(-near * near / 2) * erfcx(root * (x / a + 1) / F.sqrt(F.lit(2.0))) / 2
    return (
        F.when(name == "gamma", gamma_p(a, x / b))
        .when(name == "lognorm", normal_cdf(F.log(x / b) / a))
        .when(name == "weibull_min", -F.expm1(-F.pow(x / b, a)))
        .when(name == "beta", beta_i(a, b, F.least(x, F.lit(1.0))))
        .when(name == "invgauss", wald)
    )


def ks_one_sample(counts: DataFrame, fits: DataFrame, groups: list[str]) -> DataFrame:
    """groups, distribution, a, b, ks of each candidate over the sample's distinct values x with counts c."""
    total = counts.groupBy(*groups).agg(F.sum("c").alias("n"))
    steps = joined(running(counts, "x", ["c"], groups), total, groups)
    steps = steps.select(*groups, "x", ((F.col("before_c") + F.col("c")) / F.col("n")).alias("hi"), (F.col("before_c") / F.col("n")).alias("lo"))
    both = joined(steps, fits, groups).withColumn("f", cdf(F.col("distribution"), F.col("a"), F.col("b"), F.col("x")))  # five candidates a group
    return both.groupBy(*groups, "distribution", "a", "b").agg(F.max(F.greatest(F.col("hi") - F.col("f"), F.col("f") - F.col("lo"))).alias("ks"))
