"""Thresholds from the empirical spells of a pool."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import LossConfig
from .order import quantiles
from .spells import label_spells, spell_table

# Quantiles of spells, and the losses of the duration and intensity steps from the lowest threshold up.
DURATION_QUANTILES = (0.50, 0.75, 0.90, 0.95, 0.99)
DISTANCE_QUANTILES = (0.05, 0.10, 0.25, 0.50)
DURATION_LOSSES, INTENSITY_LOSSES = (0.10, 0.25, 0.50, 0.75, 1.00), (0.10, 0.25, 0.50, 0.80)


def _named(prefix: str, c: str, qs) -> dict[str, tuple[str, float]]:
    return {f"{prefix}_p{round(q * 100):02d}": (c, q) for q in qs}


def spell_percentiles(spells: DataFrame) -> DataFrame:
    """One row: percentiles of spell durations, intensities and least distances."""
    return quantiles(spells, [], _named("dur", "duration", DURATION_QUANTILES) | _named("int", "intensity_idx", DURATION_QUANTILES) | _named("dist", "min_distance", DISTANCE_QUANTILES))


def spell_quantiles_by_category(spells: DataFrame) -> DataFrame:
    return quantiles(spells.filter("hf_category IS NOT NULL"), ["hf_category"], _named("dur", "duration", (0.75, 0.90, 0.95)))


def boxplot_stats(spells: DataFrame) -> DataFrame:
    """Quartiles of durations by category, whiskers within 1.5 times their distance, and outliers: all from the counts of
    the whole numbers that durations are."""
    counts = spells.groupBy("hf_category", "duration").agg(F.count("*").alias("c"))
    names = {"q1": 0.25, "median": 0.5, "q3": 0.75}
    rows = counts.select("*", *[F.expr(f"percentile(duration, {q}, c) OVER (PARTITION BY hf_category)").alias(n) for n, q in names.items()])
    fence = (F.col("q3") - F.col("q1")) * 1.5
    within = (F.col("duration") >= F.col("q1") - fence) & (F.col("duration") <= F.col("q3") + fence)
    ends = [f(F.when(within, F.col("duration"))).alias(n) for n, f in (("low", F.min), ("high", F.max))]
    return rows.groupBy("hf_category", *names).agg(*ends, F.sum(F.when(within, 0).otherwise(F.col("c"))).alias("outliers"))


def annual_severe_spells(spells: DataFrame, days: int = 15) -> DataFrame:
    """Spells of `days` and more for each facility and year of the spell's start."""
    return spells.filter(F.col("duration") >= days).groupBy("hf_id", F.year("start_date").alias("year")).agg(F.count("*").alias("n_severe"))


def suggest_thresholds(percentiles: DataFrame) -> DataFrame:
    """rule, threshold, loss from one row of spell_percentiles: whole days, intensities to 2 digits, metres to 1."""
    half_even = lambda c, n: F.bround(F.col(c), n)
    rows = [("spell_days", half_even(f"dur_p{round(q * 100)}", 0), loss) for q, loss in zip(DURATION_QUANTILES, DURATION_LOSSES, strict=True)]
    rows += [("intensity", half_even(f"int_p{round(q * 100)}", 2), loss) for q, loss in zip(DURATION_QUANTILES[1:], INTENSITY_LOSSES, strict=True)]
    rows += [("distance_critical_m", half_even("dist_p25", 1), 0.5), ("distance_moderate_m", half_even("dist_p50", 1), 0.25)]
    structs = [F.struct(F.lit(rule).alias("rule"), value.cast("double").alias("threshold"), F.lit(loss).alias("loss")) for rule, value, loss in rows]
    return percentiles.select(F.inline(F.array(*structs)))


def empirical_thresholds(df: DataFrame, keys: list[str]) -> DataFrame:
    """One row of percentiles over the spells of all series; distances are those of every wet day."""
    days = label_spells(df, keys)
    spells = quantiles(spell_table(days, keys, labelled=True), [], _named("dur", "duration", DURATION_QUANTILES) | _named("int", "intensity_idx", DURATION_QUANTILES[1:]))
    wet = quantiles(days.filter("spell_id >= 0"), [], _named("dist", "min_distance", DISTANCE_QUANTILES[1:]))
    return spells.crossJoin(F.broadcast(wet))  # one row each


def calibrated_config(suggested: DataFrame, base: LossConfig | None = None) -> LossConfig:
    """The settings with the suggested thresholds, eleven rows, in place of the fixed ones."""
    rows = suggested.collect()
    pick = lambda rule: tuple((r["threshold"], r["loss"]) for r in rows if r["rule"] == rule) or None
    near = tuple((r["threshold"], r["loss"]) for r in rows if r["rule"].startswith("distance")) or None
    return (base or LossConfig()).calibrated(spell_days=pick("spell_days"), intensity=pick("intensity"), distance_m=near)


def report(percentiles: DataFrame, suggested: DataFrame) -> DataFrame:
    """One JSON document: the percentiles and the suggested thresholds."""
    rows = suggested.agg(F.sort_array(F.collect_list(F.struct("rule", "threshold", "loss"))).alias("thresholds"))
    return percentiles.crossJoin(F.broadcast(rows)).select(F.to_json(F.struct("*")).alias("report"))
