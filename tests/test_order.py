import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatch.operators import stats
from tidewatch.operators.order import beside, quantiles, ranged, running
from tidewatch.sources import scratch


def test_quantiles_of_groups_equal_numpy(spark):
    rng = random.Random(2)
    draw = {"a": lambda: rng.gauss(0, 1), "b": lambda: float(rng.randint(0, 3)), None: lambda: rng.expovariate(1e-6), "one": lambda: 4.5}
    rows = [(g, draw[g](), rng.choice([1, 2, None])) for g in ("a", "b", None) for _ in range(400)] + [("one", 4.5, 7)]
    rows += [("a", None, None), ("b", math.nan, None), ("a", 1e12, None), ("none", None, None), ("nan", math.nan, None)]
    df = spark.createDataFrame(rows, "g string, v double, w int")
    wanted = {"q0": ("v", 0.0), "p05": ("v", 0.05), "half": ("v", 0.5), "p99": ("v", 0.99), "q1": ("v", 1.0), "w_half": ("w", 0.5), "double": (F.col("w") * 2, 0.25)}
    got = {r["g"]: r for r in quantiles(df, ["g"], wanted).collect()}
    assert set(got) == {"a", "b", None, "one"}
    for g, r in got.items():
        v = [x for k, x, _ in rows if k == g and x is not None and not math.isnan(x)]
        w = [x for k, _, x in rows if k == g and x is not None]
        for name, (_, q) in wanted.items():
            of = v if name not in ("w_half", "double") else [x * (2 if name == "double" else 1) for x in w]
            assert r[name] == pytest.approx(np.quantile(of, q), rel=1e-12)


def test_quantiles_without_groups_and_without_rows(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (4.0,), (8.0,)], "v double")
    assert [tuple(r) for r in quantiles(df, [], {"p05": ("v", 0.05), "p50": ("v", 0.5)}).collect()] == [(1.15, 3.0)]
    assert [tuple(r) for r in quantiles(df.filter("v < 0"), [], {"p": ("v", 0.5)}).collect()] == [(None,)]
    assert quantiles(df.filter("v < 0").withColumn("g", F.lit(1)), ["g"], {"p": ("v", 0.5)}).count() == 0
    two = quantiles(df.withColumn("x", F.lit(None).cast("double")), [], {"p": ("v", 0.5), "none": ("x", 0.5)}).first()
    assert (two["p"], two["none"]) == (3.0, None)


def test_ranges_are_of_equal_depth_whatever_the_outliers(spark):
    n, parts = 20_000, 16
    values = spark.range(n).select((F.col("id") / n).alias("v")).unionAll(spark.createDataFrame([(1e9,), (-1e15,), (1e300,)], "v double"))
    depth = [r["count"] for r in ranged(values, "v", parts).groupBy("__part").count().collect()]
    assert len(depth) == parts and max(depth) < 2 * n / parts
    assert {r["__part"] for r in ranged(values.filter("v > 1"), "v", parts).collect()} <= set(range(parts))


def test_running_sums_of_groups(spark):
    rng = random.Random(4)
    rows = {(rng.choice(["x", "y", None]), rng.choice([rng.random(), float(rng.randint(0, 9)), 1e18])): rng.randint(1, 5) for _ in range(900)}
    df = spark.createDataFrame([(*k, c) for k, c in rows.items()], "g string, v double, c int")
    for groups in ([], ["g"]):
        df2 = df if groups else df.groupBy("v").agg(F.sum("c").alias("c"))
        for r in running(df2, "v", ["c"], groups).collect():
            assert r["before_c"] == sum(c for (g, v), c in rows.items() if v < r["v"] and (not groups or g == r["g"]))


def test_nan_is_missing_in_ranks(spark):
    rows = [("a", 1.0), ("a", 2.0), ("b", 3.0), ("b", math.nan), ("b", None), ("b", 5.0)]
    sums = {r["g"]: r for r in stats.rank_sums(spark.createDataFrame(rows, "g string, v double"), "g", "v").collect()}
    assert (sums["a"]["n"], sums["b"]["n"], sums["a"]["total"]) == (2, 2, 4) and sums["b"]["rank_sum"] == 7


def test_beside_meets_null_groups(spark):
    a = spark.createDataFrame([("x", 1), (None, 2), ("z", 3)], "g string, n int")
    b = spark.createDataFrame([("x", 0.5), (None, 0.7)], "g string, m double")
    assert sorted(map(tuple, beside(a, b, ["g"]).collect()), key=str) == sorted([("x", 1, 0.5), (None, 2, 0.7), ("z", 3, None)], key=str)


def test_no_buffer_holds_a_group(spark):
    df = spark.range(100).select(F.lit("g").alias("g"), F.col("id").cast("double").alias("v"))
    plan = quantiles(df, ["g"], {"m": ("v", 0.5)})._jdf.queryExecution().optimizedPlan().toString()
    assert "percentile(" not in plan and "collect_set" not in plan


def test_stored_tables_are_released(spark):
    import os

    since = scratch.mark()
    scratch.stored(spark.range(3))
    path = scratch._made[-1][1].removeprefix("file:")
    assert os.path.isdir(path)
    scratch.release(since)
    assert not os.path.isdir(path) and scratch.mark() == since
