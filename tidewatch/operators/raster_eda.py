"""Statistics of hazard rasters: by year and band, across years, quality rules, zones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .order import beside, quantiles
from .stats import linregress

BANDS = ["flood_frequency", "flood_duration", "valid_obs", "max_consecutive"]
#: Zone cuts: years with floods, and variation of the duration.
PERSISTENCE_CUT, CV_CUT, CV_MOST = 6, 1.25, 5.0
ZONES = {1: "SAFE", 2: "CHRONIC", 3: "UNSTABLE", 4: "CRITICAL"}


def long_bands(hazard: DataFrame) -> DataFrame:
    """One row a pixel, year and band; pixels without frequency are not valid and go."""
    valid = hazard.filter("flood_frequency IS NOT NULL")
    return valid.unpivot(["year", "row", "col"], [F.col(b).cast("double").alias(b) for b in BANDS], "band", "value")


def raster_stats(hazard: DataFrame, flooded_only: bool = False) -> DataFrame:
    """Statistics of the valid values by year and band; of the positive ones only, with zeros from all, on demand."""
    rows = long_bands(hazard)
    v = F.when(F.col("value") > 0, F.col("value")) if flooded_only else F.col("value")
    keys = ["year", "band"]
    base = rows.groupBy(*keys).agg(
        F.count(v).alias("count"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"), F.min(v).alias("min"), F.max(v).alias("max"),
        F.count_if(F.col("value") == 0).alias("zeros"), (F.count_if(F.col("value") == 0) * 100.0 / F.count("value")).alias("zeros_pct"),
    )
    return beside(base, quantiles(rows, keys, {"median": (v, 0.5), "q25": (v, 0.25), "q75": (v, 0.75)}), keys)


def flood_extent(hazard: DataFrame, threshold: float = 0.0) -> DataFrame:
    return hazard.groupBy("year").agg(F.count_if(F.col("flood_frequency") > threshold).alias("flooded_pixels"), F.count("flood_frequency").alias("valid_pixels"))


def pixel_consistency(hazard: DataFrame) -> DataFrame:
    """Mean, deviation, variation and range over the years of each band and pixel; whether all years are valid."""
    rows = hazard.unpivot(["year", "row", "col"], [F.col(b).cast("double").alias(b) for b in BANDS], "band", "value")
    mean, std = F.avg("value"), F.stddev_pop("value")
    return rows.groupBy("band", "row", "col").agg(mean.alias("mean"), std.alias("std"), (std / (mean + 1e-10)).alias("cv"), (F.max("value") - F.min("value")).alias("range"), F.bool_and(F.col("value").isNotNull()).alias("all_valid"))


def band_correlation(hazard: DataFrame) -> DataFrame:
    """Pearson correlation of every two bands by year, and their mean over years."""
    valid = hazard.filter("flood_frequency IS NOT NULL")
    pairs = [(a, b) for i, a in enumerate(BANDS) for b in BANDS[i + 1 :]]
    wide = valid.groupBy("year").agg(*[F.corr(F.col(a).cast("double"), F.col(b).cast("double")).alias(f"{a}:{b}") for a, b in pairs])
    out = wide.unpivot(["year"], [f"{a}:{b}" for a, b in pairs], "pair", "r")
    return out.withColumn("r", F.nanvl("r", F.lit(None).cast("double"))).withColumn("mean_r", F.avg("r").over(Window.partitionBy("pair")))


def year_correlation(hazard: DataFrame) -> DataFrame:
    """Correlation of each band between every two years over the pixels valid in both; null where a band does not vary."""
    valid = hazard.filter("flood_frequency IS NOT NULL")
    a = valid.select(F.col("year").alias("year_1"), "row", "col", *[F.col(b).cast("double").alias(f"{b}_1") for b in BANDS])
    b = valid.select(F.col("year").alias("year_2"), "row", "col", *[F.col(b).cast("double").alias(f"{b}_2") for b in BANDS])
    both = a.join(b, ["row", "col"]).filter("year_1 < year_2").groupBy("year_1", "year_2")
    out = both.agg(*[F.corr(f"{b}_1", f"{b}_2").alias(b) for b in BANDS], F.count("*").alias("pixels"))
    out = out.unpivot(["year_1", "year_2", "pixels"], BANDS, "band", "r")
    return out.withColumn("r", F.nanvl("r", F.lit(None).cast("double")))


def raster_quality(hazard: DataFrame, observed: DataFrame) -> DataFrame:
    """Violations of the rules that tie the bands of a year to each other and to the days observed."""
    rows = hazard.join(F.broadcast(observed), "year")  # one row a year
    f, d, n, c, o = (F.col(x) for x in ("flood_frequency", "flood_duration", "valid_obs", "max_consecutive", "observed_days"))
    return rows.groupBy("year").agg(
        F.count("*").alias("total"), F.count(f).alias("valid"), (F.count(f) * 100.0 / F.count("*")).alias("coverage_pct"),
        F.count_if(n > o).alias("count_over_observed"), F.count_if(d > f * o + 1e-5).alias("duration_over_frequency"), F.count_if(c > d + 1e-5).alias("consecutive_over_duration"),
        F.count_if((f == 0) & ((d > 0) | (c > 0))).alias("zero_frequency_conflicts"), (F.avg(n) * 100.0 / F.max(o)).alias("completeness_pct"),
    )


def trend_by_band(hazard: DataFrame) -> DataFrame:
    """Least-squares line through the yearly means of each band, with the slope's p."""
    means = long_bands(hazard).groupBy("band", "year").agg(F.avg("value").alias("mean"))
    out = linregress(means, ["band"], "year", "mean")
    trend = F.when(F.col("slope") > 0, "increasing").when(F.col("slope") < 0, "decreasing").otherwise("flat")
    return out.select("band", "slope", "intercept", "r_squared", F.col("p").alias("p_value"), trend.alias("trend"), F.col("n").alias("years"))


def persistence(hazard: DataFrame) -> DataFrame:
    """Years with floods, share of all years, and variation of the duration, by pixel."""
    mean, std = F.avg("flood_duration"), F.stddev_pop("flood_duration")
    years = F.max("n_years")
    rows = hazard.crossJoin(F.broadcast(hazard.agg(F.count_distinct("year").alias("n_years"))))  # one row
    return rows.groupBy("row", "col").agg(
        F.count_if(F.col("flood_frequency") > 0).cast("int").alias("persistence"), (F.count_if(F.col("flood_frequency") > 0) * 100.0 / years).alias("persistence_pct"), F.least(F.when(mean > 0, std / mean).otherwise(0.0), F.lit(CV_MOST)).alias("cv"), F.count("flood_frequency").alias("valid_years")
    )


def zone(persistence_: Column, cv: Column, pers_cut: int = PERSISTENCE_CUT, cv_cut: float = CV_CUT, rule: str = "facility") -> Column:
    """1 safe, 2 chronic, 3 unstable, 4 critical; the map rule counts the cut itself as many years where variation is high."""
    many, varied = persistence_ > pers_cut, cv >= cv_cut
    often = persistence_ >= pers_cut if rule == "map" else many
    return F.when(~varied & ~many, 1).when(~varied & many, 2).when(varied & often, 3).otherwise(4)


def zone_class(by_pixel: DataFrame, **cuts) -> DataFrame:
    out = by_pixel.withColumn("zone", zone(F.col("persistence"), F.col("cv"), **cuts))
    return out.withColumn("zone_name", F.element_at(F.create_map(*[F.lit(x) for kv in ZONES.items() for x in kv]), F.col("zone")))


def zone_shares(zones: DataFrame) -> DataFrame:
    return zones.groupBy("zone", "zone_name").agg(F.count("*").alias("pixels")).withColumn("share", F.col("pixels") / F.sum("pixels").over(Window.partitionBy()))


def monte_carlo_inputs(hazard: DataFrame) -> DataFrame:
    """By band: mean and spread over the years of the yearly means, spreads and zero shares."""
    yearly = long_bands(hazard).groupBy("band", "year").agg(F.avg("value").alias("m"), F.stddev_pop("value").alias("s"), F.avg((F.col("value") == 0).cast("double")).alias("z"), F.count("*").alias("n"))
    return yearly.groupBy("band").agg(F.avg("m").alias("mean_of_means"), F.stddev_pop("m").alias("std_of_means"), F.avg("s").alias("mean_of_stds"), F.stddev_pop("s").alias("std_of_stds"), F.avg("z").alias("zero_probability"), F.sum("n").alias("values"))


def lag1_autocorrelation(hazard: DataFrame) -> DataFrame:
    yearly = long_bands(hazard).groupBy("band", "year").agg(F.avg("value").alias("m"))
    lagged = yearly.withColumn("before", F.lag("m").over(Window.partitionBy("band").orderBy("year")))
    return lagged.groupBy("band").agg(F.nanvl(F.corr("m", "before"), F.lit(None).cast("double")).alias("autocorrelation"), F.count("before").alias("pairs"))


def zero_share_pivot(hazard: DataFrame) -> DataFrame:
    rows = long_bands(hazard).groupBy("year").pivot("band", BANDS).agg(F.avg((F.col("value") == 0).cast("double")) * 100.0)
    return rows.select("year", *[F.col(b).alias(f"zero_{b}") for b in BANDS])


def histogram(df: DataFrame, value: Column, low: float, high: float, bins: int, keys: list[str] | None = None) -> DataFrame:
    """Counts and density in bins of equal width; the last bin holds its upper end, what is outside is left out."""
    keys, width = keys or [], (high - low) / bins
    at = F.least(F.floor((value - low) / width), F.lit(bins - 1)).cast("int")
    rows = df.filter((value >= low) & (value <= high)).groupBy(*keys, at.alias("bin")).agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy(*keys))
    return rows.select(*keys, "bin", (F.col("bin") * width + low).alias("bin_start"), "n", (F.col("n") / (total * width)).alias("density"))
