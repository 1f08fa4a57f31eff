"""Service loss by vulnerability rules, and what follows from it: rankings, exceedance, seasons, trends."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import EXCEEDANCE, LossConfig
from ..functions.columns import lookup, quantile, step_loss
from .order import beside, quantiles
from .spells import label_spells, merge_spells, number_spells, with_durations

SYNTHETIC = ["hf_id", "scenario_id"]
OBSERVED = ["hf_id", "year"]


def combined_loss(df: DataFrame, keys: list[str], cfg: LossConfig | None = None) -> DataFrame:
    """Adds the four rule losses, the category factor and their combination, 0 to 1, to daily series.

    An inactive rule gives 0 but keeps its weight; weights that sum to 0 count as 1.
    """
    cfg = cfg or LossConfig()
    # all that needs days in date order comes first, then merged spells, then spells: each is sorted once
    first = F.first("hf_category").over(Window.partitionBy(*keys).orderBy("date"))
    days = merge_spells(number_spells(df.withColumn("__first", first), keys), keys, cfg.gap)
    days = with_durations(days, keys).withColumn("__share", F.avg("pct_flooded").over(Window.partitionBy(*keys, "spell_id")))
    wet = F.col("spell_id") >= 0
    rules = [
        F.when(wet, step_loss("spell_duration", cfg.spell_days)).otherwise(0.0),
        F.when(wet, step_loss(F.col("__share") * F.col("spell_duration"), cfg.intensity)).otherwise(0.0),
        _near(cfg.distance_m),
        F.when(wet, step_loss("merged_duration", cfg.spell_days)).otherwise(0.0),
    ]
    for i, rule in enumerate(rules):
        days = days.withColumn(f"r{i + 1}_loss", rule if cfg.active[i] else F.lit(0.0))
    days = days.withColumn("r5_mult", lookup(F.col("__first"), cfg.factors, 1.0)).drop("__first", "__share")
    total = sum(cfg.weights) or 1.0
    score = sum((F.lit(w) * F.col(f"r{i + 1}_loss") for i, w in enumerate(cfg.weights)), F.lit(0.0)) / F.lit(total)
    return days.withColumn("combined_loss", F.least(F.greatest(score * F.col("r5_mult"), F.lit(0.0)), F.lit(1.0)))


def _near(limits) -> Column:
    """The loss of the nearest limit that a wet day's distance is below; none for unknown distances."""
    out = F.lit(0.0)
    for limit, loss in sorted(limits, reverse=True):
        out = F.when(F.col("min_distance") < limit, F.lit(loss)).otherwise(out)
    return F.when(F.col("spell_id") >= 0, out).otherwise(0.0)


def annual_stats(scored: DataFrame, keys: list[str]) -> DataFrame:
    """One row a series: days and losses, spells of 15 days and more, mean loss of each month (0 for none)."""
    monthly = scored.groupBy(*keys, F.month("date").alias("m")).agg(
        F.min(F.struct("date", "hf_category"))["hf_category"].alias("cat"),
        F.min("date").alias("first"),
        F.sum("occurrence").alias("wet"),
        F.count("*").alias("n"),
        F.sum("combined_loss").alias("loss"),
        F.max("combined_loss").alias("top"),
        F.count_if(F.col("combined_loss") >= 0.50).alias("g50"),
        F.count_if(F.col("combined_loss") >= 0.75).alias("g75"),
        F.count_if(F.col("combined_loss") >= 0.999).alias("g100"),
        F.collect_set(F.when(F.col("spell_duration") >= 15, F.col("spell_id"))).alias("long"),
    )
    by_month = F.map_from_entries(F.collect_list(F.struct("m", (F.col("loss") / F.col("n")).alias("v"))))
    return monthly.groupBy(*keys).agg(
        F.min_by("cat", "first").alias("hf_category"),
        F.sum("wet").cast("int").alias("days_flooded"),
        (F.sum("loss") / F.sum("n")).alias("annual_mean_loss"),
        F.max("top").alias("annual_max_loss"),
        F.sum("g50").cast("int").alias("days_loss_gt50"),
        F.sum("g75").cast("int").alias("days_loss_gt75"),
        F.sum("g100").cast("int").alias("days_loss_100"),
        F.size(F.array_distinct(F.flatten(F.collect_list("long")))).alias("n_spells_15plus"),
        F.transform(F.sequence(F.lit(1), F.lit(12)), lambda m: F.coalesce(F.element_at(by_month, m), F.lit(0.0))).alias("monthly_loss"),
    )


def first_days(df: DataFrame, keys: list[str], days: int = 366) -> DataFrame:
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy("date"))).filter(F.col("__n") <= days).drop("__n")


def facility_ranking(stats: DataFrame) -> DataFrame:
    """Facilities by median annual loss; ranks come from the sorted facility table, one row a facility."""
    loss = "annual_mean_loss"
    out = stats.filter("hf_id IS NOT NULL AND hf_category IS NOT NULL").groupBy("hf_id", "hf_category").agg(
        quantile(loss, 0.5).alias("loss_p50"),
        quantile(loss, 0.05).alias("loss_p05"),
        quantile(loss, 0.95).alias("loss_p95"),
        quantile("days_loss_gt50", 0.5).alias("days_gt50"),
        quantile("days_loss_gt75", 0.5).alias("days_gt75"),
        F.avg((F.col("days_loss_100") > 0).cast("double")).alias("p_total"),
    )
    return out.withColumn("rank", F.row_number().over(Window.orderBy(F.round("loss_p50", 9).desc(), "hf_id")))


def exceedance_table(stats: DataFrame, thresholds=EXCEEDANCE) -> DataFrame:
    """Share of series at or above each loss, facilities with the largest first share first."""
    shares = [F.avg((F.col("annual_mean_loss") >= t).cast("double")).alias(f"p_exceed_{round(t * 100)}pct") for t in thresholds]
    out = stats.filter("hf_id IS NOT NULL AND hf_category IS NOT NULL").groupBy("hf_id", "hf_category").agg(*shares)
    return out.orderBy(F.desc(out.columns[2]), "hf_id", "hf_category")


def category_describe(stats: DataFrame) -> DataFrame:
    loss, rows = "annual_mean_loss", stats.filter("hf_category IS NOT NULL")
    base = rows.groupBy("hf_category").agg(F.count("*").alias("n"), F.avg(loss).alias("mean"))
    shares = quantiles(rows, ["hf_category"], {"median": (loss, 0.5), "p25": (loss, 0.25), "p75": (loss, 0.75), "p95": (loss, 0.95)})
    return beside(base, shares, ["hf_category"]).select("hf_category", "n", "median", "mean", "p25", "p75", "p95")


def seasonal_risk(stats: DataFrame) -> DataFrame:
    """Median, p05, p95 of monthly losses by category, with the month of the highest median (the first of equals)."""
    months = stats.select("hf_category", F.posexplode("monthly_loss").alias("m", "loss")).withColumn("month", F.col("m") + 1)
    out = quantiles(months, ["hf_category", "month"], {"median": ("loss", 0.5), "p05": ("loss", 0.05), "p95": ("loss", 0.95)})
    peak = F.max_by("month", F.struct(F.round("median", 9), -F.col("month"))).over(Window.partitionBy("hf_category"))  # twelve rows
    return out.withColumn("peak_month", peak)


def temporal_trend(stats: DataFrame) -> DataFrame:
    """Medians by category and year."""
    medians = {"flood_freq_med": F.col("days_flooded") / 365.0, "mean_loss_med": "annual_mean_loss", "days_gt50_med": "days_loss_gt50", "days_gt75_med": "days_loss_gt75"}
    return quantiles(stats, ["hf_category", "year"], {k: (v, 0.5) for k, v in medians.items()})


def category_backfill(df: DataFrame) -> DataFrame:
    """Null categories become the facility's earliest one."""
    known = F.first("hf_category", True).over(Window.partitionBy("hf_id").orderBy("date").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return df.withColumn("hf_category", F.coalesce("hf_category", known))


def r1_sensitivity(df: DataFrame, keys: list[str], sets: dict[str, tuple]) -> DataFrame:
    """Median over series of the mean duration loss, by category, for each threshold set; one pass over the days."""
    days = label_spells(df, keys)
    losses = {label: F.avg(F.when(F.col("spell_id") >= 0, step_loss("spell_duration", limits)).otherwise(0.0)) for label, limits in sets.items()}
    means = days.groupBy(*keys).agg(F.min_by("hf_category", "date").alias("hf_category"), *[v.alias(k) for k, v in losses.items()])
    long = means.unpivot(["hf_category"], list(losses), "label", "loss")
    return quantiles(long, ["label", "hf_category"], {"median_loss": ("loss", 0.5)})
