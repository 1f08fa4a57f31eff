"""Change of facilities between two periods, and the categories that follow."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .order import beside, quantiles
from .spells import label_spells
from .stats import mann_whitney_p


def annual_metrics(days: DataFrame, breakpoint: int = 2021) -> DataFrame:
    """By facility and year: flood days, frequency, mean share on wet days, longest and mean spell, spells; pre or post."""
    rows = label_spells(days, ["hf_id", "year"])
    wet = F.col("spell_id") >= 0
    out = rows.groupBy("hf_id", "year").agg(
        F.min_by("hf_category", "date").alias("hf_category"), F.count_if(wet).cast("int").alias("flood_days"), F.avg(wet.cast("double")).alias("flood_freq"), F.coalesce(F.avg(F.when(wet, F.col("pct_flooded"))), F.lit(0.0)).alias("mean_pct"),
        F.max("spell_duration").alias("max_spell"), (F.max("spell_id") + 1).alias("n_spells"),
    )
    out = out.withColumn("mean_spell", F.when(F.col("n_spells") > 0, F.col("flood_days") / F.col("n_spells")).otherwise(0.0))
    return out.withColumn("period", F.when(F.col("year") > breakpoint, "post").otherwise("pre"))


def annual_summary(metrics: DataFrame) -> DataFrame:
    v = "flood_freq"
    base = metrics.groupBy("year").agg(F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"), F.count("*").alias("facilities"))
    return beside(base, quantiles(metrics, ["year"], {"q05": (v, 0.05), "q95": (v, 0.95)}), ["year"])


def pre_post_test(metrics: DataFrame, alpha: float = 0.05) -> DataFrame:
    """Means before and after, their difference, Mann-Whitney U and its p-value; facilities with two years in each."""
    both = Window.partitionBy("hf_id")
    rank = F.rank().over(both.orderBy("flood_freq")) + (F.count("*").over(Window.partitionBy("hf_id", "flood_freq")) - 1) / 2
    rows = metrics.withColumn("rank", rank).withColumn("ties", F.count("*").over(Window.partitionBy("hf_id", "flood_freq")))
    pre, post = F.col("period") == "pre", F.col("period") == "post"
    out = rows.groupBy("hf_id").agg(
        F.min_by("hf_category", "year").alias("hf_category"), F.count_if(pre).alias("n_pre"), F.count_if(post).alias("n_post"), F.avg(F.when(pre, F.col("flood_freq"))).alias("mean_pre"), F.avg(F.when(post, F.col("flood_freq"))).alias("mean_post"),
        F.sum(F.when(pre, F.col("rank"))).alias("ranks_pre"), F.sum((F.col("ties") * F.col("ties") - 1).cast("double")).alias("tie_sum"),
    )
    out = out.filter("n_pre >= 2 AND n_post >= 2").withColumn("delta", F.col("mean_post") - F.col("mean_pre"))
    out = out.withColumn("u_stat", F.col("ranks_pre") - F.col("n_pre") * (F.col("n_pre") + 1) / 2)
    out = out.withColumn("pval", mann_whitney_p("u_stat", "n_pre", "n_post", "tie_sum"))
    return out.select("hf_id", "hf_category", "n_pre", "n_post", "mean_pre", "mean_post", "delta", "u_stat", "pval", (F.col("pval") < alpha).alias("significant"))


def classify(tests: DataFrame, freq: float = 0.10) -> DataFrame:
    """Adds change_type: of safe facilities confirmed, emerged or changed; of others the kind of change."""
    safe = F.when(F.col("significant"), "SAFE_CHANGED").when(F.col("mean_post") >= freq, "SAFE_EMERGED").otherwise("SAFE_CONFIRMED")
    other = F.when(F.col("significant") & (F.col("delta") > freq), "INCREASED").when(F.col("significant") & (F.col("delta") < -freq), "DECREASED")
    other = other.when(~F.col("significant") & (F.col("mean_post") < freq), "STABLE_LOW").when(~F.col("significant"), "STABLE").otherwise("MARGINAL")
    return tests.withColumn("change_type", F.when(F.col("hf_category") == "SAFE", safe).otherwise(other))


def reclassify(tests: DataFrame, high: float = 0.40, mid: float = 0.10, min_years: int = 3) -> DataFrame:
    """New category and reason by the rules of the old one, beside the test's p-value where there is one; too few years after
    the break leave it."""
    safe, change, post = F.col("hf_category") == "SAFE", F.col("change_type"), F.col("mean_post")
    reason = (
        F.when(F.col("n_post") < min_years, "uncertain_few_years")
        .when(safe & (change == "SAFE_CHANGED") & (post > high), "safe_emerged_high")
        .when(safe & (change == "SAFE_CHANGED") & (post > mid), "safe_emerged_mid")
        .when(safe & (change == "SAFE_EMERGED"), "safe_emerged_low")
        .when((F.col("hf_category") == "CRITICAL") & (change == "INCREASED") & (post > 0.50), "critical_now_persistent")
        .otherwise("no_change")
    )
    out = tests.withColumn("reason", reason)
    new = F.when(F.col("reason").isin("safe_emerged_high", "critical_now_persistent"), "UNSTABLE").when(F.col("reason").isin("safe_emerged_mid", "safe_emerged_low"), "CHRONIC").otherwise(F.col("hf_category"))
    out = out.withColumn("cat_new", new)
    return out.select("hf_id", F.col("hf_category").alias("cat_original"), "cat_new", "mean_pre", "mean_post", "delta", *[c for c in ("pval",) if c in tests.columns], "change_type", F.col("n_post").alias("n_years_post"), (F.col("cat_new") != F.col("hf_category")).alias("reclassified"), "reason")


def movement_counts(reclassified: DataFrame) -> DataFrame:
    """Facilities by old and new category, those that stay included, with their share of the old one."""
    out = reclassified.groupBy("cat_original", "cat_new").agg(F.count("*").alias("n"))
    return out.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("cat_original")))


def apply_to_pool(pool: DataFrame, reclassified: DataFrame) -> DataFrame:
    """The pool's rows of reclassified facilities, with the new category."""
    return pool.drop("hf_category").join(reclassified.select("hf_id", F.col("cat_new").alias("hf_category")), "hf_id")


def with_post_years(facilities: DataFrame, metrics: DataFrame) -> DataFrame:
    """facilities with n_years_post: their years after the break in metrics, 0 where there are none."""
    counts = metrics.filter("period = 'post'").groupBy("hf_id").agg(F.count("*").alias("n_years_post"))
    return facilities.join(counts, "hf_id", "left").withColumn("n_years_post", F.coalesce("n_years_post", F.lit(0)).cast("int"))
