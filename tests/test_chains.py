"""Chains of draws and small samples against plain Python."""

import itertools
import math
import random
from statistics import NormalDist

import numpy as np
import pytest

from tidewatch.operators import stats, uncertainty

SCHEMA = "param string, chain int, draw int, idx string, value double"


def brute(chains):
    n = min(map(len, chains)) // 2
    x = np.array([part for c in chains for part in (c[:n], c[-n:])])
    order = np.sort(x.ravel())
    ranks = (np.searchsorted(order, x, "left") + np.searchsorted(order, x, "right") + 1) / 2
    z = np.vectorize(NormalDist().inv_cdf)((ranks - 0.375) / (x.size + 0.25))
    w, b = z.var(1, ddof=1).mean(), z.mean(1).var(ddof=1)
    var = (n - 1) / n * w + b
    c = z - z.mean(1, keepdims=True)
    rho = [1 - (w - np.mean([(r[: n - t] * r[t:]).sum() / n for r in c])) / var for t in range(n)]
    rho[0], total, least = 1.0, 0.0, math.inf
    for t in range(0, n - 1, 2):
        least = min(least, rho[t] + rho[t + 1])
        if least < 0:
            break
        total += least
    return math.sqrt(var / w), x.size / max(-1 + 2 * total, 1 / math.log10(x.size))


def walk(rng, n, keep):
    out = [0.0]
    for _ in range(n - 1):
        out.append(keep * out[-1] + rng.gauss(0, 1))
    return out


def test_diagnosis_equals_the_definition(spark):
    rng = random.Random(9)
    made = {
        "quick": [walk(rng, 301, 0.1), walk(rng, 290, 0.1)], "slow": [walk(rng, 1500, 0.995), walk(rng, 1500, 0.995)], "apart": [[v + 9 for v in walk(rng, 600, 0.5)], walk(rng, 600, 0.5)],
        "ties": [[float(rng.randint(0, 3)) for _ in range(260)] for _ in range(3)], "four": [[1.0, 2.0, 4.0, 3.0]], "alike": [[5.0] * 40] * 2, "few": [[1.0, 2.0, 3.0]],
    }
    rows = [(p, c, 7 * i + 3, "0", v) for p, chains in made.items() for c, chain in enumerate(chains) for i, v in enumerate(chain)]
    rows += [("quick", 0, 10**6, "0", None), ("quick", 1, 10**6, "0", math.nan)]
    rng.shuffle(rows)
    got = {r["param"]: r for r in uncertainty.rhat_ess(spark.createDataFrame(rows, SCHEMA).repartition(5)).collect()}
    assert set(got) == set(made)
    for p in ("quick", "slow", "apart", "ties", "four"):
        rhat, ess = brute([np.array(c) for c in made[p]])
        assert got[p]["rhat"] == pytest.approx(rhat, rel=1e-9) and got[p]["ess"] == pytest.approx(ess, rel=1e-9)
        assert got[p]["flagged"] == (rhat > 1.05 or ess < 400)
    for p in ("alike", "few"):
        assert (got[p]["rhat"], got[p]["ess"], got[p]["flagged"]) == (None, None, False)
    assert uncertainty.rhat_ess(spark.createDataFrame([], SCHEMA)).count() == 0


def test_narrowest_intervals(spark):
    rng = random.Random(1)
    rows = [(p, 0, i, "0", v) for p in ("a", "b") for i, v in enumerate([rng.expovariate(1) for _ in range(300)] if p == "a" else [float(rng.randint(0, 5)) for _ in range(90)])] + [("b", 0, 99, "0", math.nan)]
    for r in uncertainty.posterior_summary(spark.createDataFrame(rows, SCHEMA)).collect():
        v = sorted(x for p, *_, x in rows if p == r["param"] and not math.isnan(x))
        k = int(len(v) * 0.9)
        width, lo, hi = min((v[i + k] - v[i], v[i], v[i + k]) for i in range(len(v) - k))
        assert (r["hdi_low"], r["hdi_high"]) == (lo, hi) and r["mean"] == pytest.approx(np.mean(v))


@pytest.mark.parametrize(("n", "m"), [(1, 1), (3, 4), (5, 5), (6, 4)])
def test_paths_equal_all_orders(n, m):
    orders = list(itertools.combinations(range(n + m), n))
    far = []
    for first in orders:
        i = j = 0
        most = 0
        for k in range(n + m):
            i, j = (i + 1, j) if k in first else (i, j + 1)
            most = max(most, abs(i * m - j * n))
        far.append(most)
    for d in sorted(set(far)):
        assert stats.kolmogorov_paths(d / (n * m), n, m) == pytest.approx(sum(f >= d for f in far) / len(orders), abs=1e-12)


def test_paths_meet_the_limit_for_larger_samples():
    for d in (0.06, 0.09, 0.12):
        assert stats.kolmogorov_paths(d, 480, 500) == pytest.approx(stats.kolmogorov_sf(d, 480 * 500 / 980), rel=0.05, abs=1e-4)
    assert stats.two_sample_p(0.05, 3000, 4000) == stats.kolmogorov_sf(0.05, 3000 * 4000 / 7000)
    assert stats.kolmogorov_paths(1.0, 400, 500) < 1e-12 and stats.kolmogorov_paths(0.0, 4, 5) == 1.0


def test_column_report_tells_absent_and_empty_columns(spark):
    from tidewatch.functions.columns import column_report

    df = spark.createDataFrame([(1, None, None), (2, "x", None)], "a int, `b.c` string, d double")
    got = {r["column_name"]: (r["present"], r["n_rows"], r["n_filled"]) for r in column_report(df, ["a", "b.c", "d", "e"]).collect()}
    assert got == {"a": (True, 2, 2), "b.c": (True, 2, 1), "d": (True, 2, 0), "e": (False, 2, 0)}
    assert {r["n_rows"] for r in column_report(df.limit(0), ["a", "e"]).collect()} == {0}


def test_products_of_a_block_are_no_loops_of_expressions(spark):
    rng = random.Random(17)
    x = [[rng.random() for _ in range(n)] for n in (uncertainty.BLOCK, uncertainty.BLOCK, 5)]  # blocks of one half; the last is short
    blocks = spark.createDataFrame([("p", "0", 0, b, v) for b, v in enumerate(x)], "param string, idx string, part int, b int, xs array<double>")
    sums = uncertainty._products(blocks, blocks.select("param", "idx").distinct(), range(0, 2))
    plan = sums._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" in plan and "zip_with" not in plan
    flat = [v for block in x for v in block]
    got = {r["t"]: r["ac"] for r in sums.collect()}
    assert len(got) == 2 * uncertainty.BLOCK
    assert all(got[t] == pytest.approx(sum(a * b for a, b in zip(flat, flat[t:]))) for t in got)
