"""Every query with SQL gives DuckDB's rows at the smallest scale."""

import math

import duckdb
import pytest

from tidewatch.plans.oracles import ORACLES
from tidewatch.plans.queries import QUERIES

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events embeddings".split()
#: The full comparison is the driver's; these cover every family of operators.
NAMES = ["aoi_crop", "hazard_annual_3", "hazard_seasonal_2", "raster_quality", "zone_class", "buffer_metrics", "facility_zone", "annual_metrics", "merge_spells", "combined_loss", "facility_ranking", "dunn_test", "suggest_thresholds", "flood_probability", "scenario_metrics", "posterior_summary", "variogram"]
NAMES += ["required_columns"]
#: Sinks, readers, streams and p-values.
NAMES += ["facility_csv_scan", "pool_by_facility_scan", "new_maps_written", "hazard_written", "review_list", "pool_metadata_document", "results_written", "calibration_report", "facility_zone_join", "post_year_counts", "scenario_grid"]
NAMES += ["fit_positive_distribution", "fit_by_band", "rhat_ess", "ks_two_sample_exact", "stratified_sample", "pool_pruned_scan", "hazard_years_scan", "spell_percentiles", "category_describe", "seasonal_risk", "raster_stats"]
NAMES += ["kruskal_wallis_p", "dunn_test_p", "mann_whitney_pre_post", "reclassify", "ks_two_sample_p", "kendall_trend_loss", "band_trend_p", "trend_regression_p", "calibrated_loss", "fit_lognormal", "session_spells_stream", "incremental_streak_stream"]


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, bool) or isinstance(v, str):
        return str(v)
    return round(float(v), 5) + 0.0 if isinstance(v, (int, float)) or hasattr(v, "as_integer_ratio") else str(v)[:10]


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    cols = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=str)
    rel = duck.sql(ORACLES[name])
    at = [rel.columns.index(c) for c in cols]
    want = sorted((tuple(plain(r[i]) for i in at) for r in rel.fetchall()), key=str)
    assert len(rel.columns) == len(cols) and got == want


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


def test_rhat_flags_disagreeing_chains(spark):
    import random

    from tidewatch.operators.uncertainty import rhat_ess

    rng = random.Random(3)
    rows = [(p, c, i, "0", rng.gauss(c * shift, 1)) for p, shift in (("good", 0), ("bad", 5)) for c in range(2) for i in range(500)]
    got = {r["param"]: r for r in rhat_ess(spark.createDataFrame(rows, "param string, chain int, draw int, idx string, value double")).collect()}
    assert got["good"]["rhat"] < 1.02 and got["good"]["ess"] > 400 and not got["good"]["flagged"]
    assert got["bad"]["rhat"] > 1.5 and got["bad"]["flagged"]


def test_fit_recovers_a_gamma(spark):
    import numpy as np

    from tidewatch.operators.sampling import fit_positive_distribution

    x = np.random.default_rng(0).gamma(2.0, 3.0, 800)
    df = spark.createDataFrame([(float(v),) for v in x], "x double")
    fits = {r["distribution"]: r for r in fit_positive_distribution(df, "x").collect()}
    assert min(fits.values(), key=lambda r: r["ks"])["distribution"] in ("gamma", "weibull_min")
    assert abs(fits["gamma"]["a"] - 2) < 0.3 and fits["gamma"]["ks"] < 0.05
    assert fit_positive_distribution(df.limit(50), "x") is None


@pytest.mark.parametrize("n, m", [(6, 9), (248, 186), (500, 500), (501, 500), (1464, 1098)])
def test_sql_of_the_two_sample_p_follows_the_rule(n, m):
    from tidewatch.operators import stats
    from tidewatch.plans import stats_sql

    d = round(0.07 * n * m) / (n * m)
    got = duckdb.sql(f"SELECT {stats_sql.two_sample_p('d_stat')} FROM (SELECT {d}::DOUBLE AS d_stat, {n}::BIGINT AS n_1, {m}::BIGINT AS n_2)").fetchall()[0][0]
    assert got == pytest.approx(stats.two_sample_p(d, n, m), abs=1e-8)


def test_movement_counts_hold_every_facility(spark):
    from tidewatch.operators.reclass import movement_counts

    rows = [("a", "SAFE", "SAFE", False), ("b", "SAFE", "CHRONIC", True), ("c", "SAFE", "SAFE", False), ("d", "CRITICAL", "CRITICAL", False)]
    out = movement_counts(spark.createDataFrame(rows, "hf_id string, cat_original string, cat_new string, reclassified boolean"))
    assert {(r["cat_original"], r["cat_new"]): (r["n"], round(r["share"], 6)) for r in out.collect()} == {("SAFE", "SAFE"): (2, 0.666667), ("SAFE", "CHRONIC"): (1, 0.333333), ("CRITICAL", "CRITICAL"): (1, 1.0)}
