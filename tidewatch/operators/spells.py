"""Wet spells of daily series: labelling, merging over recovery gaps, streaks with missing days.

A series is one value of the key columns; its rows are days in date order. All windows of one function share the
key's partitioning and order, so a plan has one exchange and one sort.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _window(keys: list[str], order: str = "date"):
    return Window.partitionBy(*keys).orderBy(order)


def label_spells(df: DataFrame, keys: list[str]) -> DataFrame:
    """Adds spell_id (0, 1, ... in each series; -1 on dry days) and spell_duration (0 on dry days)."""
    return with_durations(number_spells(df, keys), keys)


def number_spells(df: DataFrame, keys: list[str]) -> DataFrame:
    """Adds spell_id, for which days need their date order alone."""
    w = _window(keys)
    wet = F.coalesce(F.col("occurrence"), F.lit(0)) == 1
    start = (wet & ~F.coalesce(F.lag(wet).over(w), F.lit(False))).cast("int")
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn("spell_id", F.when(wet, F.sum(start).over(upto) - 1).otherwise(-1).cast("int"))


def with_durations(df: DataFrame, keys: list[str]) -> DataFrame:
    """Adds spell_duration to numbered days."""
    size = F.count("*").over(Window.partitionBy(*keys, "spell_id"))
    return df.withColumn("spell_duration", F.when(F.col("spell_id") >= 0, size).otherwise(0).cast("int"))


def merge_spells(df: DataFrame, keys: list[str], gap: int = 4) -> DataFrame:
    """Adds merged_spell_id and merged_duration to numbered days: spells with at most `gap` dry days between are one.

    The days of such a gap belong to the merged spell, which has the id of its first spell; other dry days have -1.
    """
    w = _window(keys)
    before, upto = w.rowsBetween(Window.unboundedPreceding, -1), w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    wet = F.col("spell_id") >= 0
    df = df.withColumn("__pos", F.row_number().over(w))
    previous = F.max(F.when(wet, F.col("__pos"))).over(before)
    df = df.withColumn("__root", F.when(wet & (previous.isNull() | (F.col("__pos") - previous - 1 > gap)), F.col("spell_id")))
    df = df.withColumn("__root", F.max("__root").over(upto))
    run = Window.partitionBy(*keys, "__root")  # a merged spell and the dry days after it; a frame up to the end takes squared time
    df = df.withColumns({"__from": F.min("__pos").over(run), "__to": F.max(F.when(wet, F.col("__pos"))).over(run)})
    inside = F.col("__root").isNotNull() & (F.col("__pos") <= F.col("__to"))
    df = df.withColumn("merged_spell_id", F.when(inside, F.col("__root")).otherwise(-1).cast("int"))
    df = df.withColumn("merged_duration", F.when(inside, F.col("__to") - F.col("__from") + 1).otherwise(0).cast("int"))
    return df.drop("__pos", "__root", "__from", "__to")


def spell_table(df: DataFrame, keys: list[str], labelled: bool = False) -> DataFrame:
    """One row a spell: start, end, duration, mean share flooded, least distance, and their intensity."""
    days = (df if labelled else label_spells(df, keys)).filter("spell_id >= 0")
    out = days.groupBy(*keys, "spell_id").agg(
        F.min("date").alias("start_date"),
        F.max("date").alias("end_date"),
        F.count("*").cast("int").alias("duration"),
        F.avg("pct_flooded").alias("mean_pct_flooded"),
        F.min("min_distance").alias("min_distance"),
        F.min_by("hf_category", "date").alias("hf_category"),
    )
    return out.withColumn("intensity_idx", F.col("mean_pct_flooded") * F.col("duration"))


def spell_lengths(df: DataFrame, keys: list[str]) -> DataFrame:
    """The length of every spell, the last one too."""
    return label_spells(df, keys).filter("spell_id >= 0").groupBy(*keys, "spell_id").agg(F.count("*").cast("int").alias("length"))


def _held_islands(df: DataFrame, keys: list[str], order: str, value: str, gap: int) -> DataFrame:
    w = _window(keys, order)
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    missing = F.sum(F.col(value).isNull().cast("int")).over(upto)
    clear = F.sum((F.coalesce(F.col(value), F.lit(-1)) == 0).cast("int")).over(upto)
    df = df.withColumn("__missing", missing).withColumn("__clear", clear)
    wet = F.col(value) == 1
    hold = lambda c: F.last(F.when(wet, F.col(c)), True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    new = hold("__clear").isNull() | (F.col("__clear") > hold("__clear")) | (F.col("__missing") - hold("__missing") > gap)
    return df.withColumn("__new", F.when(wet, new.cast("int"))).withColumn("__island", F.when(wet, F.sum("__new").over(upto)))


def held_runs(df: DataFrame, keys: list[str], order: str = "map_date", value: str = "value", gap: int = 2) -> DataFrame:
    """Adds __run to flood observations: the floods in their run, which a clear one or more than `gap` missing ones end."""
    marked = _held_islands(df, keys, order, value, gap)
    return marked.withColumn("__run", F.when(F.col("__island").isNotNull(), F.count("*").over(Window.partitionBy(*keys, "__island"))))


def max_streak_hold(df: DataFrame, keys: list[str], order: str = "map_date", value: str = "value", gap: int = 2) -> DataFrame:
    """The most flood observations in a run that a clear one, or more than `gap` missing ones, ends.

    Missing observations are held over but not counted. 0 without floods; null where nothing was observed.
    """
    return held_runs(df, keys, order, value, gap).groupBy(*keys).agg(longest_held(value).alias("max_consecutive"))


def longest_held(value: str = "value") -> Column:
    return F.when(F.count(value) > 0, F.coalesce(F.max("__run"), F.lit(0))).cast("int")


def tolerant_runs(df: DataFrame, keys: list[str], order: str = "map_date", value: str = "value", gap: int = 5) -> DataFrame:
    """Adds __run: floods and tolerated missing observations since the last breaker and up to the next one.

    Breakers are clear observations and each (gap+1)-th missing one in a row.
    """
    w = _window(keys, order)
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    missing = F.col(value).isNull()
    df = df.withColumn("__seen", F.sum((~missing).cast("int")).over(upto))
    nth = F.row_number().over(Window.partitionBy(*keys, "__seen").orderBy(order)) - F.when(F.col("__seen") > 0, 1).otherwise(0)
    df = df.withColumn("__nth", nth)
    breaker = F.coalesce(F.col(value) == 0, F.lit(False)) | (missing & (F.pmod(F.col("__nth"), F.lit(gap + 1)) == 0))
    df = df.withColumn("__break", breaker.cast("int")).withColumn("__group", F.sum("__break").over(upto))
    return df.withColumn("__run", F.sum(1 - F.col("__break")).over(Window.partitionBy(*keys, "__group")))


def max_run_tolerant(df: DataFrame, keys: list[str], order: str = "map_date", value: str = "value", gap: int = 5) -> DataFrame:
    """The longest run of floods and tolerated missing observations; null where nothing was observed."""
    return tolerant_runs(df, keys, order, value, gap).groupBy(*keys).agg(longest_tolerated(value).alias("max_run"))


def longest_tolerated(value: str = "value") -> Column:
    return F.when(F.count(value) > 0, F.max("__run")).cast("int")


def exceedance(lengths: Column, k: int) -> Column:
    """The share of spells of at least k days, 0 without spells."""
    return F.coalesce(F.avg((lengths >= k).cast("double")), F.lit(0.0))
