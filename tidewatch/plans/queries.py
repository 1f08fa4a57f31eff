"""Named queries over the operators, each on whole input tables. Floating results are given at six places after ten, half to
even, so that noise in the last bits, from sums in another order, does not turn ties; dates are given as text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import fixtures as fx
from ..config import SENSITIVITY_SETS as SETS
from ..config import SPELL_DAYS, LossConfig
from ..functions.columns import buffer_pixels, column_report, facility_type, step_loss
from ..operators import calibration, facilities, hazard, impact, model, raster_eda, reclass, sampling, spells, stats, uncertainty
from ..sources import readers, writers
from ..sources.scratch import stored

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
OBS, SYN = ["hf_id", "year"], ["hf_id", "scenario_id"]
PARAMS = {"beta0": -0.5, "beta_lag": 2.0, "beta_cos": 0.4, "beta_sin": -0.3, "kappa": 3.0, "beta0_P": -1.0, "beta_lag_P": 0.8, "beta_cos_P": 0.2, "beta_sin_P": -0.1, "phi": 6.0, "beta0_D": 2.0, "beta_lag_D": -0.5}


def query(f):
    def rounded(spark: SparkSession, d: str) -> DataFrame:
        df = f(spark, d)
        short = lambda c: F.when(F.abs(F.col(c).cast("double")) < 5e-7, 0.0).otherwise(F.rint(F.rint(F.col(c).cast("double") * 1e10) / 1e10 * 1e6) / 1e6)
        plain = {"double": short, "float": short, "date": lambda c: F.col(c).cast("string")}
        return df.select(*[plain.get(t, F.col)(c).alias(c) for c, t in df.dtypes])

    rounded.__doc__ = f.__doc__
    QUERIES[f.__name__] = rounded
    return f


def _binary(spark, d):
    return hazard.binarize(fx.pixel_obs(spark, d))


def _annual(spark, d):
    return hazard.hazard_annual_3(_binary(spark, d))


def _placed(spark, d):
    return facilities.place(facilities.first_by_coordinates(facilities.valid_facilities(fx.facilities(spark, d))), fx.grid(spark, d))


def _metrics(spark, d):
    return reclass.annual_metrics(fx.observed_pool(spark, d), fx.BREAKPOINT)


def _tests(spark, d):
    return reclass.classify(reclass.pre_post_test(_metrics(spark, d)))


def _syn_stats(spark, d):
    return impact.annual_stats(impact.combined_loss(fx.synthetic_pool(spark, d), SYN), SYN)


def _obs_stats(spark, d):
    return impact.annual_stats(impact.combined_loss(impact.first_days(fx.observed_pool(spark, d), OBS), OBS), OBS)


def _obs_spells(spark, d):
    return spells.spell_table(fx.observed_pool(spark, d), OBS)


# pixels and hazard


@query
def binarize(spark, d):
    return _binary(spark, d).withColumn("value", F.col("value").cast("double"))


@query
def aoi_crop(spark, d):
    pixels = fx.pixel_obs(spark, d)
    return hazard.aoi_crop(pixels, hazard.aoi_bbox(pixels))


@query
def aoi_bbox(spark, d):
    return hazard.aoi_bbox(fx.pixel_obs(spark, d))


@query
def invalid_code_maps(spark, d):
    return hazard.invalid_code_maps(fx.pixel_obs(spark, d), codes=(1, 30, 50, 200)).select("map_date", F.explode("codes").alias("code"))


@query
def season_label(spark, d):
    return hazard.with_season(fx.pixel_obs(spark, d)).groupBy("map_date", "season", "season_year").agg(F.count("*").alias("pixels"))


@query
def map_catalog(spark, d):
    """Maps by the dates in their file names, one name in five without the usual mark."""
    stamp = F.date_format("map_date", "yyyyMMdd")
    name = F.when(F.dayofmonth("map_date") % 5 == 0, F.concat(F.lit("scene_"), stamp)).otherwise(F.concat(F.lit("flood_e"), stamp, F.lit("_v1.tif")))
    names = fx.pixel_obs(spark, d).select(name.alias("file_name")).distinct()
    strict = readers.map_catalog(names).select("file_name", F.col("map_date").alias("strict_date"))
    return readers.map_catalog(names, strict=False).join(strict, "file_name")


@query
def tile_unpack(spark, d):
    """Tiles of eight columns, the last narrower, built from the pixels, and unpacked again."""
    size = 8
    tiles = fx.pixel_obs(spark, d).groupBy("map_date", F.col("row").alias("tile_row"), (F.floor(F.col("col") / size) * size).cast("int").alias("tile_col")).agg(F.array_sort(F.collect_list(F.struct("col", "code"))).alias("v"))
    return hazard.unpack_tiles(tiles.select("map_date", "tile_row", "tile_col", F.least(F.lit(size), F.lit(25) - F.col("tile_col")).alias("width"), F.col("v.code").alias("values")))


@query
def window_scan(spark, d):
    """Every window of five rows in turn."""
    windows = F.floor(F.col("row") / 5).cast("int").alias("window")
    return fx.pixel_obs(spark, d).groupBy(windows, "row").agg(F.count("*").alias("pixels"), F.count_if(F.col("code") == 200).alias("flooded"))


@query
def hazard_annual(spark, d):
    return hazard.hazard_annual(_binary(spark, d))


@query
def hazard_seasonal(spark, d):
    return hazard.hazard_seasonal(_binary(spark, d))


@query
def hazard_annual_3(spark, d):
    return _annual(spark, d)


@query
def hazard_seasonal_2(spark, d):
    return hazard.hazard_seasonal_2(_binary(spark, d))


@query
def hazard_annual_2(spark, d):
    return hazard.hazard_annual_2(hazard.hazard_seasonal_2(_binary(spark, d)))


@query
def raster_stats(spark, d):
    return raster_eda.raster_stats(_annual(spark, d))


@query
def raster_stats_flooded(spark, d):
    return raster_eda.raster_stats(_annual(spark, d), flooded_only=True)


@query
def flood_extent(spark, d):
    return raster_eda.flood_extent(_annual(spark, d))


@query
def pixel_consistency(spark, d):
    return raster_eda.pixel_consistency(_annual(spark, d))


@query
def band_correlation(spark, d):
    return raster_eda.band_correlation(_annual(spark, d))


@query
def year_correlation(spark, d):
    return raster_eda.year_correlation(_annual(spark, d))


@query
def raster_quality(spark, d):
    seen = _binary(spark, d).groupBy(F.year("map_date").alias("year")).agg((F.count_distinct("map_date") - 1).alias("observed_days"))
    return raster_eda.raster_quality(_annual(spark, d), seen)


@query
def trend_by_band(spark, d):
    return raster_eda.trend_by_band(_annual(spark, d))


@query
def persistence(spark, d):
    return raster_eda.persistence(_annual(spark, d))


@query
def zone_class(spark, d):
    zones = raster_eda.zone_class(raster_eda.persistence(_annual(spark, d)), pers_cut=2, cv_cut=0.3)
    return zones.select("row", "col", "zone", "zone_name")


@query
def zone_shares(spark, d):
    return raster_eda.zone_shares(raster_eda.zone_class(raster_eda.persistence(_annual(spark, d)), pers_cut=2, cv_cut=0.3, rule="map"))


@query
def monte_carlo_inputs(spark, d):
    return raster_eda.monte_carlo_inputs(_annual(spark, d))


@query
def lag1_autocorrelation(spark, d):
    return raster_eda.lag1_autocorrelation(_annual(spark, d))


@query
def zero_share_pivot(spark, d):
    return raster_eda.zero_share_pivot(_annual(spark, d))


@query
def freq_hist(spark, d):
    rows = _annual(spark, d).filter("flood_frequency IS NOT NULL")
    return raster_eda.histogram(rows, F.col("flood_frequency"), 0.0, 1.0, 20, ["year"])


@query
def stratified_sample(spark, d):
    return sampling.stratified_sample(raster_eda.long_bands(_annual(spark, d)), per_year=5000)


@query
def cap_sample(spark, d):
    return sampling.cap_sample(_annual(spark, d).filter("flood_frequency IS NOT NULL"), ["year", "row", "col"], 3000)


@query
def systematic_sample(spark, d):
    return sampling.systematic_sample(raster_eda.persistence(_annual(spark, d)).select("row", "col", "persistence"), ["row", "col"], 1500)


@query
def variogram(spark, d):
    points = raster_eda.persistence(_annual(spark, d)).select("row", "col", F.col("cv"))
    return sampling.variogram(sampling.systematic_sample(points, ["row", "col"], 1500), "cv")


@query
def fit_positive_distribution(spark, d):
    """Candidate distributions of the pixels' yearly frequencies with their distances."""
    return sampling.fit_positive_distribution(_annual(spark, d), "flood_frequency", bounded=True)


@query
def fit_lognormal(spark, d):
    """The log-normal candidate, whose parameters have a closed form, with its distance from the frequencies."""
    return sampling.fit_positive_distribution(_annual(spark, d), "flood_frequency").filter("distribution = 'lognorm'").drop("chosen")


@query
def fit_by_band(spark, d):
    """The candidates for the positive values of each band's sample; the beta for frequencies alone; the nearest is chosen."""
    sample = sampling.stratified_sample(raster_eda.long_bands(_annual(spark, d)), per_year=5000)
    return sampling.fit_groups(sample, "value", ["band"], F.col("band") == "flood_frequency")


# facilities


@query
def valid_facilities(spark, d):
    return facilities.valid_facilities(fx.facilities(spark, d))


@query
def required_columns(spark, d):
    """The columns that scoring needs, and one that only labelled days have, in the observed pool."""
    return column_report(fx.observed_pool(spark, d), [*readers.POOL_NEEDS, "spell_id"])


@query
def facility_type_buffer(spark, d):
    rows = fx.facilities(spark, d).withColumn("hf_type", facility_type(F.col("hf_id")))
    return rows.select("hf_id", "hf_type", buffer_pixels(F.col("hf_type")).alias("buffer_pixels"), (buffer_pixels(F.col("hf_type")) * 90.0).alias("buffer_meters"))


@query
def coordinate_dedup(spark, d):
    return facilities.first_by_coordinates(fx.facilities(spark, d)).select("hf_id", "longitude", "latitude")


@query
def shared_coordinates(spark, d):
    return facilities.shared_coordinates(fx.facilities(spark, d)).select("longitude", "latitude", "facilities", F.explode("ids").alias("hf_id"))


@query
def coord_to_pixel(spark, d):
    return _placed(spark, d).select("hf_id", "row", "col", "inside", "row_from", "row_to", "col_from", "col_to")


@query
def facility_pixel_point_lookup(spark, d):
    return facilities.point_lookup(_placed(spark, d), _annual(spark, d), ["year", "flood_duration", "max_consecutive"]).select("hf_id", "year", "flood_duration", "max_consecutive")


@query
def facility_pixel_band_join(spark, d):
    rows = facilities.facility_pixels(_placed(spark, d), _binary(spark, d), ["map_date", "value"])
    return rows.groupBy("hf_id").agg(F.count("*").alias("pairs"), F.count_if(F.col("value") == 1).alias("wet"))


@query
def buffer_metrics(spark, d):
    return facilities.buffer_metrics(_placed(spark, d), _binary(spark, d))


@query
def hf_year_series(spark, d):
    placed = _placed(spark, d)
    rows = facilities.hf_year_series(facilities.buffer_metrics(placed, _binary(spark, d)), placed)
    return rows.select("hf_id", "hf_type", "buffer_pixels", "year", "n_days", "total_flooded_days", "series_binary", "series_no_data_count")


@query
def explode_series(spark, d):
    """Facility-years written as JSON arrays and read back as days."""
    placed = _placed(spark, d)
    series = facilities.hf_year_series(facilities.buffer_metrics(placed, _binary(spark, d)), placed)
    days = facilities.explode_series(series)
    return facilities.dry_distance_impute(days).select("hf_id", "date", "occurrence", "pct_flooded", "min_distance", "day_of_year", "year")


@query
def aoi_coverage(spark, d):
    return facilities.aoi_coverage(_placed(spark, d), fx.pixel_obs(spark, d))


@query
def facilities_outside(spark, d):
    return facilities.facilities_outside(_placed(spark, d), fx.pixel_obs(spark, d)).select("hf_id", "row", "col")


@query
def extraction_counters(spark, d):
    placed = _placed(spark, d)
    return facilities.extraction_counters(facilities.aoi_coverage(placed, fx.pixel_obs(spark, d)), facilities.buffer_metrics(placed, _binary(spark, d)))


@query
def facility_persistence(spark, d):
    return facilities.patch_means(_placed(spark, d), raster_eda.persistence(_annual(spark, d)), ["persistence", "persistence_pct"])


@query
def facility_zone(spark, d):
    zones = raster_eda.zone_class(raster_eda.persistence(_annual(spark, d)), pers_cut=2, cv_cut=0.3)
    rows = facilities.patch_means(_placed(spark, d), zones, ["persistence", "cv", "zone"]).withColumn("zone", F.bround("zone").cast("int"))
    return rows.withColumn("zone_name", F.element_at(F.create_map(*[F.lit(x) for kv in raster_eda.ZONES.items() for x in kv]), F.col("zone")))


@query
def pool_metadata(spark, d):
    placed = _placed(spark, d)
    return writers.pool_metadata(facilities.hf_year_series(facilities.buffer_metrics(placed, _binary(spark, d)), placed))


# reclassification


@query
def annual_metrics(spark, d):
    return _metrics(spark, d)


@query
def annual_summary(spark, d):
    return reclass.annual_summary(_metrics(spark, d))


@query
def pre_post_test(spark, d):
    return reclass.pre_post_test(_metrics(spark, d)).drop("pval", "significant")


@query
def mann_whitney_pre_post(spark, d):
    """With p-values, which SQL does not have."""
    return reclass.pre_post_test(_metrics(spark, d))


@query
def reclassify(spark, d):
    """Categories after the rules, which rest on the p-values."""
    return reclass.reclassify(_tests(spark, d))


@query
def movement_counts(spark, d):
    return reclass.movement_counts(reclass.reclassify(_tests(spark, d)))


@query
def reclassified_pool(spark, d):
    pool = reclass.apply_to_pool(fx.observed_pool(spark, d), reclass.reclassify(_tests(spark, d)))
    return pool.groupBy("hf_category").agg(F.count("*").alias("days"), F.sum("occurrence").alias("wet"))


@query
def classify_by_delta(spark, d):
    """The classes with significance taken as a difference of 0.02 or more, so that SQL can follow."""
    tests = reclass.pre_post_test(_metrics(spark, d)).withColumn("significant", F.abs(F.round("delta", 9)) >= 0.02)
    out = reclass.reclassify(reclass.classify(tests, 0.55), high=0.60, mid=0.50)
    return out.drop("mean_pre", "mean_post", "delta", "pval")


# spells


@query
def label_spells(spark, d):
    return spells.label_spells(fx.observed_pool(spark, d), OBS).select("hf_id", "date", "spell_id", "spell_duration")


@query
def merge_spells(spark, d):
    return spells.merge_spells(spells.label_spells(fx.synthetic_pool(spark, d), SYN), SYN).select("hf_id", "scenario_id", "date", "merged_spell_id", "merged_duration")


@query
def spell_table(spark, d):
    return _obs_spells(spark, d)


@query
def spell_lengths(spark, d):
    """Lengths of spells that may run over the turn of a year."""
    return spells.spell_lengths(fx.observed_pool(spark, d), ["hf_id"])


@query
def max_streak_hold(spark, d):
    return spells.max_streak_hold(_binary(spark, d), ["row", "col"])


@query
def max_run_tolerant(spark, d):
    return spells.max_run_tolerant(_binary(spark, d), ["row", "col"], gap=3)


# impact


@query
def step_loss_table(spark, d):
    days = spells.label_spells(fx.observed_pool(spark, d), OBS).filter("spell_id >= 0")
    return days.groupBy("spell_duration", step_loss("spell_duration", SPELL_DAYS).alias("loss")).agg(F.count("*").alias("days"))


@query
def combined_loss(spark, d):
    rows = impact.combined_loss(fx.observed_pool(spark, d), OBS)
    return rows.select("hf_id", "date", "r1_loss", "r2_loss", "r3_loss", "r4_loss", "r5_mult", "combined_loss")


@query
def combined_loss_inactive(spark, d):
    rows = impact.combined_loss(fx.synthetic_pool(spark, d), SYN, LossConfig(active=(True, False, True, True), weights=(0.5, 0.2, 0.2, 0.1)))
    return rows.select("hf_id", "scenario_id", "date", "combined_loss")


@query
def scenario_annual_stats(spark, d):
    return _syn_stats(spark, d).drop("monthly_loss")


@query
def monthly_loss(spark, d):
    rows = _obs_stats(spark, d).select("hf_id", "year", F.posexplode("monthly_loss").alias("m", "loss"))
    return rows.select("hf_id", "year", (F.col("m") + 1).alias("month"), "loss")


@query
def observed_year_stats(spark, d):
    return _obs_stats(spark, d).drop("monthly_loss")


@query
def facility_ranking(spark, d):
    return impact.facility_ranking(_syn_stats(spark, d))


@query
def top_facilities(spark, d):
    return impact.facility_ranking(_syn_stats(spark, d)).orderBy("rank").limit(30).select("rank", "hf_id")


@query
def exceedance_table(spark, d):
    return impact.exceedance_table(_syn_stats(spark, d))


@query
def category_describe(spark, d):
    return impact.category_describe(_syn_stats(spark, d))


@query
def kruskal_wallis(spark, d):
    """H over categories; the p-value is tested apart."""
    sums = stats.rank_sums(_syn_stats(spark, d).withColumn("loss", F.round("annual_mean_loss", 9)), "hf_category", "loss")
    return stats.kruskal_wallis(sums).drop("p")


@query
def dunn_test(spark, d):
    sums = stats.rank_sums(_syn_stats(spark, d).withColumn("loss", F.round("annual_mean_loss", 9)), "hf_category", "loss")
    return stats.dunn_test(sums, "hf_category").select("group_1", "group_2", "z_stat")


@query
def dunn_test_p(spark, d):
    sums = stats.rank_sums(_syn_stats(spark, d).withColumn("loss", F.round("annual_mean_loss", 9)), "hf_category", "loss")
    return stats.dunn_test(sums, "hf_category")


@query
def seasonal_risk(spark, d):
    return impact.seasonal_risk(_obs_stats(spark, d))


@query
def temporal_trend(spark, d):
    return impact.temporal_trend(_obs_stats(spark, d))


@query
def kendall_trend(spark, d):
    trend = impact.temporal_trend(_obs_stats(spark, d)).withColumn("freq", F.round("flood_freq_med", 9))
    return stats.kendall_trend(trend, "hf_category", "year", "freq").select("hf_category", "n", "tau", "direction")


@query
def trend_regression(spark, d):
    return stats.linregress(_obs_stats(spark, d).withColumn("y", F.col("days_flooded").cast("double")), ["hf_category"], "year", "y").drop("p")


@query
def r1_sensitivity(spark, d):
    pool = impact.category_backfill(fx.synthetic_pool(spark, d, with_category=False))
    return impact.r1_sensitivity(pool, SYN, SETS)


@query
def category_backfill(spark, d):
    pool = impact.category_backfill(fx.synthetic_pool(spark, d, with_category=False))
    return pool.groupBy("hf_id", "hf_category").agg(F.count("*").alias("days"))


# calibration


@query
def spell_percentiles(spark, d):
    return calibration.spell_percentiles(_obs_spells(spark, d))


@query
def spell_quantiles_by_category(spark, d):
    return calibration.spell_quantiles_by_category(_obs_spells(spark, d))


@query
def annual_severe_spells(spark, d):
    return calibration.annual_severe_spells(_obs_spells(spark, d), 6)


@query
def suggest_thresholds(spark, d):
    return calibration.suggest_thresholds(calibration.spell_percentiles(_obs_spells(spark, d)))


@query
def empirical_thresholds(spark, d):
    return calibration.empirical_thresholds(fx.synthetic_pool(spark, d), SYN)


@query
def calibrated_loss(spark, d):
    """Annual losses of the observed pool under thresholds calibrated from its own spells."""
    cfg = calibration.calibrated_config(calibration.suggest_thresholds(calibration.spell_percentiles(_obs_spells(spark, d))))
    scored = impact.combined_loss(fx.observed_pool(spark, d), OBS, cfg)
    return scored.groupBy("hf_id", "year").agg(F.avg("combined_loss").alias("annual_mean_loss"), F.max("combined_loss").alias("annual_max_loss"))


@query
def ks_two_sample(spark, d):
    return stats.ks_two_sample(_obs_spells(spark, d), "hf_category", "duration", "SAFE", "CRITICAL").drop("p")


@query
def boxplot_stats(spark, d):
    return calibration.boxplot_stats(_obs_spells(spark, d))


# model data


@query
def lag_features(spark, d):
    return model.complete(model.lag_features(fx.observed_pool(spark, d))).select("hf_id", "date", "o_lag", "p_lag")


@query
def seasonal_covariates(spark, d):
    return model.seasonal_covariates(fx.observed_pool(spark, d)).select("hf_id", "date", "cos_t", "sin_t", "t_year", "p_clipped", "d_scaled")


@query
def category_index(spark, d):
    return model.category_index(fx.observed_pool(spark, d)).groupBy("hf_category", "category_idx").agg(F.count("*").alias("n"))


@query
def facility_index(spark, d):
    return model.facility_index(fx.observed_pool(spark, d))


@query
def facility_metadata(spark, d):
    return model.facility_metadata(fx.observed_pool(spark, d))


@query
def t_year_of(spark, d):
    return model.t_year_of(fx.observed_pool(spark, d), 2005)


@query
def union_pool(spark, d):
    pool = model.union_pool(fx.observed_pool(spark, d), fx.synthetic_pool(spark, d).drop("hf_category"))
    return pool.groupBy("is_synthetic", "scenario_id", "hf_category").agg(F.count("*").alias("days"), F.sum("occurrence").alias("wet"))


@query
def flood_probability(spark, d):
    """The daily observed pool scored with a table of parameters."""
    pool = stored(model.complete(model.lag_features(fx.observed_pool(spark, d))))  # read twice: the range of years, and every row
    rows = model.seasonal_covariates(pool)
    n = F.length("hf_id") * 7 + F.ascii(F.substring("hf_id", -1, 1))
    by_facility = fx.pool_facilities(spark, d).select("hf_id", (n % 5 / 10.0).alias("effect"), (n % 3 / 4.0).alias("t_break"), (n % 7 / 8.0 - 0.4).alias("delta"), (n % 4 / 6.0).alias("delta_P"), (n % 6 / 9.0).alias("delta_D"))
    by_category = spark.createDataFrame([(c, i * 0.2, i * 0.1 - 0.1) for i, c in enumerate(fx.CATEGORIES)], "hf_category string, beta_cat double, gamma_cat double")
    out = model.flood_probability(rows, PARAMS, by_facility, by_category)
    return out.select("hf_id", "date", "transition", "p_flood", "expected_pct", "shape_a", "shape_b", "expected_log_distance")


# uncertainty


@query
def monthly_frequency(spark, d):
    return uncertainty.monthly_frequency(fx.observed_pool(spark, d))


@query
def monthly_frequency_syn(spark, d):
    return uncertainty.monthly_frequency_syn(fx.synthetic_pool(spark, d))


@query
def spell_exceedance(spark, d):
    return uncertainty.spell_exceedance(fx.synthetic_pool(spark, d))


@query
def spell_length_hist(spark, d):
    rows = spells.spell_lengths(fx.observed_pool(spark, d), ["hf_id"])
    return raster_eda.histogram(rows, F.col("length").cast("double"), 0.0, 60.0, 30)


@query
def pct_hist(spark, d):
    wet = model.wet_rows(fx.observed_pool(spark, d))
    return raster_eda.histogram(wet, F.col("pct_flooded") * 100, 0.0, 100.0, 25)


@query
def facility_mean_frequency(spark, d):
    return uncertainty.facility_mean_frequency(fx.observed_pool(spark, d), fx.synthetic_pool(spark, d))


@query
def scenario_metrics(spark, d):
    return uncertainty.scenario_metrics(fx.synthetic_pool(spark, d), 5)


@query
def credible_interval(spark, d):
    return uncertainty.credible_interval(fx.synthetic_pool(spark, d), fx.observed_pool(spark, d)).withColumn("obs_days", F.col("obs_days").cast("double"))


@query
def uncertainty_summary(spark, d):
    return uncertainty.uncertainty_summary(uncertainty.scenario_metrics(fx.synthetic_pool(spark, d), 5))


@query
def breakpoint_sensitivity(spark, d):
    return uncertainty.breakpoint_sensitivity(fx.draws(spark, d))


@query
def posterior_summary(spark, d):
    return uncertainty.posterior_summary(fx.draws(spark, d))


@query
def split_rhat(spark, d):
    return uncertainty.split_rhat(fx.draws(spark, d))


@query
def rhat_ess(spark, d):
    return uncertainty.rhat_ess(fx.draws(spark, d))


@query
def subsample_stability(spark, d):
    """Stability of the scenarios' metrics, with facilities standing for scenarios to have enough of them."""
    pool = fx.synthetic_pool(spark, d)
    rows = pool.groupBy(F.col("hf_id").alias("scenario_id")).agg(F.sum("occurrence").cast("double").alias("annual_days"), F.round(F.avg("pct_flooded"), 9).alias("mean_pct"))
    return uncertainty.subsample_stability(rows)


from . import stored as _stored  # noqa: E402, F401  registers its queries
