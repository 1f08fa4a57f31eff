import math
import random
from statistics import NormalDist

import pytest
from pyspark.sql import functions as F

from tidewatch.functions import special
from tidewatch.operators import sampling, stats

c = F.col


def values(spark, rows, names, e):
    return [r["y"] for r in spark.createDataFrame(rows, names).coalesce(1).select(e.alias("y")).collect()]


def test_gammas(spark):
    xs = [1e-3, 0.1, 0.5, 1.0, 1.4616, 3.3, 10.0, 250.0, 1e6]
    rows = [(x,) for x in xs]
    assert values(spark, rows, ["x"], special.lgamma(c("x"))) == pytest.approx([math.lgamma(x) for x in xs], rel=1e-12, abs=1e-12)
    h = [max(1e-5 * x, 1e-9) for x in xs]
    slope = [(math.lgamma(x + d) - math.lgamma(x - d)) / (2 * d) for x, d in zip(xs, h, strict=True)]
    assert values(spark, rows, ["x"], special.digamma(c("x"))) == pytest.approx(slope, rel=1e-4, abs=1e-4)
    got = values(spark, [(1.0,), (0.5,)], ["x"], special.digamma(c("x")))
    assert got == pytest.approx([-0.5772156649015329, -1.9635100260214235], rel=1e-13)
    assert values(spark, [(1.0,), (0.5,)], ["x"], special.trigamma(c("x"))) == pytest.approx([math.pi**2 / 6, math.pi**2 / 2], rel=1e-13)


def test_incomplete_functions_equal_the_fractions(spark):
    rng = random.Random(1)
    rows = [(math.exp(rng.uniform(-3, 6)), rng.random()) for _ in range(300)]
    rows = [(a, a * math.exp(rng.uniform(-2, 1.5))) for a, _ in rows] + [(2.0, 0.0), (0.5, 1e-9), (3.0, 1e4)]
    assert values(spark, rows, ["a", "x"], special.gamma_p(c("a"), c("x"))) == pytest.approx([stats.gamma_p(a, x) for a, x in rows], rel=1e-9, abs=1e-12)
    rows = [(math.exp(rng.uniform(-2, 5)), math.exp(rng.uniform(-2, 5)), rng.random()) for _ in range(300)] + [(2.0, 3.0, 0.0), (2.0, 3.0, 1.0), (0.3, 40.0, 1e-6)]
    assert values(spark, rows, ["a", "b", "x"], special.beta_i(c("a"), c("b"), c("x"))) == pytest.approx([stats.beta_i(*r) for r in rows], rel=1e-8, abs=1e-11)


def test_normal(spark):
    zs = [-37.0, -8.0, -3.3, -1.4, -1e-6, 0.0, 0.7, 1.5, 6.0, 12.0]
    assert values(spark, [(z,) for z in zs], ["z"], special.normal_cdf(c("z"))) == pytest.approx([math.erfc(-z / math.sqrt(2)) / 2 for z in zs], rel=1e-10)
    ps = [1e-300, 1e-12, 0.001, 0.07, 0.0751, 0.4, 0.5, 0.93, 0.999999]
    assert values(spark, [(p,) for p in ps], ["p"], special.normal_quantile(c("p"))) == pytest.approx([NormalDist().inv_cdf(p) for p in ps], rel=1e-12, abs=1e-12)


def test_distribution_functions(spark):
    rng = random.Random(3)
    phi = NormalDist().cdf
    rows = [(n, math.exp(rng.uniform(-1, 2)), math.exp(rng.uniform(-1, 2)), rng.uniform(0.01, 6)) for n in sampling.FAMILIES for _ in range(40)]
    rows = [(n, a, b, x / 6.1 if n == "beta" else x) for n, a, b, x in rows]
    want = {
        "gamma": lambda a, b, x: stats.gamma_p(a, x / b), "lognorm": lambda a, b, x: phi(math.log(x / b) / a), "weibull_min": lambda a, b, x: 1 - math.exp(-((x / b) ** a)), "beta": stats.beta_i,
        "invgauss": lambda a, b, x: phi(math.sqrt(b / x) * (x / a - 1)) + math.exp(2 * b / a) * phi(-math.sqrt(b / x) * (x / a + 1)),
    }
    got = values(spark, rows, ["n", "a", "b", "x"], sampling.cdf(c("n"), c("a"), c("b"), c("x")))
    assert got == pytest.approx([want[n](a, b, x) for n, a, b, x in rows], rel=1e-7, abs=1e-10)


def slope(f, v, d=1e-4):
    return (f(v * (1 + d)) - f(v * (1 - d))) / (2 * v * d)


def likelihood(name, a, b, xs):
    if name == "gamma":
        return sum((a - 1) * math.log(x) - x / b - a * math.log(b) - math.lgamma(a) for x in xs)
    if name == "weibull_min":
        return sum(math.log(a / b) + (a - 1) * math.log(x / b) - (x / b) ** a for x in xs)
    if name == "beta":
        return sum((a - 1) * math.log(x) + (b - 1) * math.log1p(-x) + math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) for x in xs)
    if name == "lognorm":
        return sum(-math.log(x * a) - (math.log(x / b) / a) ** 2 / 2 for x in xs)
    return sum(math.log(b / x**3) / 2 - b * (x - a) ** 2 / (2 * a * a * x) for x in xs)


def test_fits_are_the_likeliest_and_the_nearest_is_chosen(spark):
    rng = random.Random(7)
    samples = {"gamma": [rng.gammavariate(2.5, 3) for _ in range(600)], "beta": [rng.betavariate(2, 5) for _ in range(700)], "lognorm": [rng.lognormvariate(0.5, 0.8) for _ in range(500)], "weibull_min": [rng.weibullvariate(2, 6) for _ in range(800)]}
    samples["few"], samples["same"] = [1.0] * 100, [2.0] * 300
    rows = [(g, x) for g, xs in samples.items() for x in xs] + [("gamma", 0.0), ("gamma", None), ("gamma", math.nan), ("gamma", -3.0), (None, 1.0)]
    out = sampling.fit_groups(spark.createDataFrame(rows, "g string, x double"), "x", ["g"], F.col("g") == "beta").collect()
    assert {r["g"] for r in out} == {"gamma", "beta", "lognorm", "weibull_min"}
    for r in out:
        n = r["distribution"]
        for v, f in ((r["a"], lambda v: likelihood(n, v, r["b"], samples[r["g"]])), (r["b"], lambda v: likelihood(n, r["a"], v, samples[r["g"]]))):
            assert abs(slope(f, v) * v) < 1e-4 * len(samples[r["g"]])
        xs = sorted(samples[r["g"]])
        f = [x["y"] for x in spark.createDataFrame([(x,) for x in xs], "x double").coalesce(1).select(sampling.cdf(F.lit(n), F.lit(r["a"]), F.lit(r["b"]), F.col("x")).alias("y")).collect()]
        assert r["ks"] == pytest.approx(max(max((i + 1) / len(xs) - y, y - i / len(xs)) for i, y in enumerate(f)))
    for g in ("gamma", "beta", "lognorm", "weibull_min"):
        own = [r for r in out if r["g"] == g]
        assert len(own) == 4 + (g == "beta") and [r["chosen"] for r in sorted(own, key=lambda r: r["ks"])] == [True] + [False] * (len(own) - 1)
        assert next(r["ks"] for r in own if r["distribution"] == g) < 0.06


def test_stratified_sample_is_the_least_hashes(spark):
    import hashlib

    rows = [(y, "b", r, k, float((r * k) % 3)) for y in (1, 2) for r in range(40) for k in range(30)] + [(3, "b", 0, 0, None), (3, "b", 0, 1, -1.0)]
    got = {tuple(r)[:4] for r in sampling.stratified_sample(spark.createDataFrame(rows, "year int, band string, row int, col int, value double"), per_year=100).collect()}
    want = set()
    for y in (1, 2):
        for zero, cap in ((True, 30), (False, 70)):
            of = sorted((hashlib.md5(f"{r}#{k}#42".encode()).hexdigest(), r, k) for yy, _, r, k, v in rows if yy == y and v is not None and v >= 0 and (v == 0) == zero)
            want |= {(y, "b", r, k) for _, r, k in of[:cap]}
    assert got == want
