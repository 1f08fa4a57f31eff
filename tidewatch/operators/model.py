"""Data work around the occurrence model: lags, covariates, indices, and scoring with given parameters."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import clip, lookup, sigmoid

# Category order and the largest distance of each buffer.
CATEGORY_INDEX = {"SAFE": 0, "CHRONIC": 1, "UNSTABLE": 2, "CRITICAL": 3}
LARGEST = {40: 2545.5, 60: 3818.0}
EPS = 1e-6


def lag_features(df: DataFrame) -> DataFrame:
    """Adds the day before's occurrence and share by facility."""
    w = Window.partitionBy("hf_id").orderBy("date")
    return df.withColumn("o_lag", F.lag("occurrence").over(w)).withColumn("p_lag", F.lag("pct_flooded").over(w))


def complete(df: DataFrame) -> DataFrame:
    return df.dropna(subset=["occurrence", "pct_flooded", "min_distance", "o_lag", "p_lag"])


def year_range(df: DataFrame) -> DataFrame:
    return df.agg(F.min("year").alias("year_min"), F.max("year").alias("year_max"))


def year_scaled(year: Column, high: float) -> Column:
    """Years since the first over the span, within [0, high]; a span of 0 counts as 1."""
    return clip((year - F.col("year_min")) / F.greatest(F.col("year_max") - F.col("year_min"), F.lit(1)), 0.0, high)


def seasonal_covariates(df: DataFrame) -> DataFrame:
    """Season, scaled year, clipped share, distance over the buffer's largest."""
    angle = F.lit(2 * math.pi) * F.col("day_of_year") / 365
    out = df.crossJoin(F.broadcast(year_range(df)))  # one row
    largest = F.when(F.col("buffer_pixels") == 40, LARGEST[40]).otherwise(LARGEST[60])
    out = out.withColumn("cos_t", F.cos(angle)).withColumn("sin_t", F.sin(angle)).withColumn("t_year", year_scaled(F.col("year"), 1.0))
    out = out.withColumn("p_clipped", clip(F.col("pct_flooded"), EPS, 1 - EPS)).withColumn("d_scaled", F.greatest("min_distance", F.lit(1e-3)) / largest)
    return out.drop("year_min", "year_max")


def t_year_of(df: DataFrame, target: int) -> DataFrame:
    """One row: the scaled value of a target year, within [0, 2]."""
    return year_range(df).select(F.lit(target).alias("target_year"), year_scaled(F.lit(target), 2.0).alias("t_year"))


def category_index(df: DataFrame) -> DataFrame:
    return df.withColumn("category_idx", lookup(F.col("hf_category"), CATEGORY_INDEX, 0))


def facility_index(df: DataFrame) -> DataFrame:
    """hf_id, facility_idx: the place of each id among the sorted ids; the facility table, one row each."""
    ids = df.select("hf_id").distinct()
    return ids.withColumn("facility_idx", F.dense_rank().over(Window.orderBy("hf_id")) - 1)


def wet_rows(df: DataFrame) -> DataFrame:
    return df.filter("occurrence = 1")


def facility_metadata(df: DataFrame) -> DataFrame:
    """The first place, buffer and payam of each facility, and its last occurrence and share."""
    first = [F.min_by(c, "date").alias(c) for c in ("latitude", "longitude", "buffer_pixels", "hf_payam")]
    return df.groupBy("hf_id").agg(*first, F.max_by("occurrence", "date").alias("last_o"), F.max_by("pct_flooded", "date").alias("last_p"), F.max("date").alias("last_date"))


def union_pool(observed: DataFrame, synthetic: DataFrame) -> DataFrame:
    """Both pools; columns that one lacks are null there."""
    return observed.unionByName(synthetic, allowMissingColumns=True)


def scenario_grid(facilities: DataFrame, scenarios: int, first: str, days: int) -> DataFrame:
    """hf_id, scenario_id (0, 1, ...), date, day_of_year: every day of every scenario of every facility, exploded in place."""
    rows = facilities.select("hf_id", F.explode(F.sequence(F.lit(0), F.lit(scenarios - 1))).alias("scenario_id"))
    start = F.to_date(F.lit(first))
    rows = rows.withColumn("date", F.explode(F.sequence(start, F.date_add(start, days - 1))))
    return rows.withColumn("day_of_year", F.dayofyear("date"))


def flood_probability(df: DataFrame, common: dict[str, float], by_facility: DataFrame, by_category: DataFrame) -> DataFrame:
    """Adds the transition, the occurrence probability, the expected wet share with its Beta shapes, and the expected log distance.

    common: beta0, beta_lag, beta_cos, beta_sin, kappa, beta0_P, beta_lag_P, beta_cos_P, beta_sin_P, phi, beta0_D,
    beta_lag_D. by_facility: hf_id, effect, t_break, delta, delta_P, delta_D. by_category: hf_category, beta_cat, gamma_cat.
    Every row is scored: an unknown category counts as the first one, an unknown facility has no effects of its own.
    """
    c = {k: F.lit(float(v)) for k, v in common.items()}
    known = lookup(F.col("hf_category"), {k: k for k in CATEGORY_INDEX}, next(iter(CATEGORY_INDEX)))
    kinds = F.broadcast(by_category.withColumnRenamed("hf_category", "__known"))  # four categories
    out = df.withColumn("__known", known).join(by_facility, "hf_id", "left").join(kinds, "__known", "left").drop("__known")
    out = out.fillna(0.0, [*(x for x in by_facility.columns if x != "hf_id"), *(x for x in by_category.columns if x != "hf_category")])
    out = out.withColumn("transition", sigmoid(c["kappa"] * (F.col("t_year") - F.col("t_break"))))
    logit = c["beta0"] + F.col("effect") + F.col("beta_cat") + c["beta_lag"] * F.col("o_lag") + c["beta_cos"] * F.col("cos_t") + c["beta_sin"] * F.col("sin_t") + (F.col("delta") + F.col("gamma_cat")) * F.col("transition")
    share = c["beta0_P"] + F.col("effect") + c["beta_lag_P"] * F.col("p_lag") + c["beta_cos_P"] * F.col("cos_t") + c["beta_sin_P"] * F.col("sin_t") + F.col("delta_P") * F.col("transition")
    far = c["beta0_D"] + F.col("effect") + c["beta_lag_D"] * F.log1p(F.col("p_lag") * 100) + F.col("delta_D") * F.col("transition")
    out = out.withColumn("p_flood", sigmoid(logit)).withColumn("expected_pct", sigmoid(share)).withColumn("expected_log_distance", clip(far, -5.0, 5.0))
    return out.withColumn("shape_a", clip(F.col("expected_pct") * c["phi"], 0.1, 100.0)).withColumn("shape_b", clip((1 - F.col("expected_pct")) * c["phi"], 0.1, 100.0))
