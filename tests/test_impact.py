import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidewatch.config import LossConfig
from tidewatch.functions.columns import require_columns, season, stars, step_loss
from tidewatch.operators import calibration, impact, model, reclass, sampling, stats


def pool(spark, wet, pct=0.5, dist=400.0, cat="SAFE", hf="a"):
    rows = [(hf, cat, 0, dt.date(2026, 1, 1) + dt.timedelta(i), o, pct if o else 0.0, dist) for i, o in enumerate(wet)]
    return spark.createDataFrame(rows, "hf_id string, hf_category string, scenario_id int, date date, occurrence int, pct_flooded double, min_distance double")


@pytest.mark.parametrize("value,loss", [(4.9, 0.0), (5.0, 0.1), (13.0, 0.25), (33.0, 0.5), (100.0, 1.0), (None, 0.0)])
def test_step_loss_at_thresholds(spark, value, loss):
    df = spark.createDataFrame([(value,)], "v double")
    assert df.select(step_loss("v", LossConfig().spell_days)).first()[0] == loss
    assert df.select(step_loss("v", ())).first()[0] == 0.0


def test_combined_loss_by_hand(spark):
    scored = impact.combined_loss(pool(spark, [1] * 5 + [0] * 4 + [1], cat="CRITICAL"), impact.SYNTHETIC).orderBy("date").collect()
    # five days: R1 .1; 5 * .5 = 2.5: R2 .1; below 500 m: R3 .5; merged ten days: R4 .1
    assert scored[0]["combined_loss"] == pytest.approx((0.45 * 0.1 + 0.25 * 0.1 + 0.2 * 0.5 + 0.1 * 0.1) * 1.6)
    assert scored[6]["combined_loss"] == 0.0 and scored[6]["merged_spell_id"] == 0
    assert scored[9]["r4_loss"] == 0.1 and scored[9]["r1_loss"] == 0.0


def test_distance_limits_and_unknowns(spark):
    for d, loss in ((499.9, 0.5), (500.0, 0.25), (1199.0, 0.25), (1200.0, 0.0), (None, 0.0)):
        assert impact.combined_loss(pool(spark, [1], dist=d), impact.SYNTHETIC).first()["r3_loss"] == loss
    assert impact.combined_loss(pool(spark, [1], cat="OTHER"), impact.SYNTHETIC).first()["r5_mult"] == 1.0


def test_inactive_rules_keep_their_weight_and_zero_weights(spark):
    df = pool(spark, [1])
    off = impact.combined_loss(df, impact.SYNTHETIC, LossConfig(active=(False, False, True, False))).first()["combined_loss"]
    assert off == pytest.approx(0.2 * 0.5)
    assert impact.combined_loss(df, impact.SYNTHETIC, LossConfig(weights=(0, 0, 0, 0))).first()["combined_loss"] == 0.0


def test_annual_stats_fill_missing_months(spark):
    stats_ = impact.annual_stats(impact.combined_loss(pool(spark, [1] * 16 + [0] * 4), impact.SYNTHETIC), impact.SYNTHETIC).first()
    assert len(stats_["monthly_loss"]) == 12 and stats_["monthly_loss"][5] == 0.0
    assert stats_["days_flooded"] == 16 and stats_["n_spells_15plus"] == 1


def test_first_366_days(spark):
    assert impact.first_days(pool(spark, [0] * 400), ["hf_id"]).count() == 366


def test_seasons_and_stars(spark):
    df = spark.createDataFrame([(2020, 11), (2020, 1), (2020, 5)], "y int, m int")
    label, year = season(F.col("y"), F.col("m"))
    assert [tuple(r) for r in df.select(label, year).collect()] == [("dry", 2021), ("dry", 2020), ("wet", 2020)]
    ps = spark.createDataFrame([(0.0005,), (0.005,), (0.02,), (0.5,)], "p double")
    assert [r[0] for r in ps.select(stars(F.col("p"))).collect()] == ["***", "**", "*", "ns"]


def test_required_columns(spark):
    with pytest.raises(ValueError, match="lacks columns: b"):
        require_columns(spark.createDataFrame([(1,)], "a int"), ["a", "b"])


def test_tails_against_known_values(spark):
    assert stats.chi2_sf(7.814727903251179, 3) == pytest.approx(0.05, abs=1e-9)
    assert stats.normal_two_sided(1.959963984540054) == pytest.approx(0.05, abs=1e-12)
    assert stats.t_two_sided(2.2281388519649385, 10) == pytest.approx(0.05, abs=1e-9)
    assert stats.gamma_p(2.0, 2.0) == pytest.approx(1 - 3 * 2.718281828459045**-2)
    assert stats._mann_whitney(0, 3, 3, 0) == pytest.approx(0.1)
    assert stats._mann_whitney(4.5, 3, 3, 0) == pytest.approx(1.0)
    assert spark.range(1).select(sampling.digamma(F.lit(1.0)).alias("y")).first()["y"] == pytest.approx(-0.5772156649015329)


def test_rank_sums_equal_average_ranks(spark):
    import pandas as pd

    rows = [("a" if i % 3 else "b", float(i % 7)) for i in range(60)]
    got = {r["g"]: r["rank_sum"] for r in stats.rank_sums(spark.createDataFrame(rows, "g string, v double"), "g", "v").collect()}
    ranks = pd.Series([v for _, v in rows]).rank()
    for g in "ab":
        assert got[g] == pytest.approx(sum(r for r, (k, _) in zip(ranks, rows, strict=True) if k == g))


def test_reclassification_rules(spark):
    rows = [("1", "SAFE", True, 0.1, 0.6), ("2", "SAFE", True, 0.1, 0.2), ("3", "SAFE", False, 0.1, 0.2), ("4", "CRITICAL", True, 0.2, 0.7), ("5", "CHRONIC", True, 0.2, 0.7), ("6", "SAFE", False, 0.1, 0.05)]
    df = spark.createDataFrame(rows, "hf_id string, hf_category string, significant boolean, mean_pre double, mean_post double")
    df = df.withColumn("delta", F.col("mean_post") - F.col("mean_pre")).withColumn("n_post", F.lit(4))
    out = {r["hf_id"]: (r["cat_new"], r["reason"]) for r in reclass.reclassify(reclass.classify(df)).collect()}
    assert out["1"] == ("UNSTABLE", "safe_emerged_high") and out["2"] == ("CHRONIC", "safe_emerged_mid") and out["3"] == ("CHRONIC", "safe_emerged_low")
    assert out["4"] == ("UNSTABLE", "critical_now_persistent") and out["5"] == ("CHRONIC", "no_change") and out["6"] == ("SAFE", "no_change")
    few = {r["reason"] for r in reclass.reclassify(reclass.classify(df.withColumn("n_post", F.lit(2)))).collect()}
    assert few == {"uncertain_few_years"}


def test_calibrated_config_and_year_scaling(spark):
    df = spark.createDataFrame([("spell_days", 5.0, 0.1), ("distance_critical_m", 300.0, 0.5)], "rule string, threshold double, loss double")
    cfg = calibration.calibrated_config(df)
    assert cfg.spell_days == ((5.0, 0.1),) and cfg.distance_m == ((300.0, 0.5),) and cfg.intensity == LossConfig().intensity
    years = spark.createDataFrame([(2012,), (2020,)], "year int")
    assert model.t_year_of(years, 2040).first()["t_year"] == 2.0
