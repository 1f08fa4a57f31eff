"""Sinks: partitioned Parquet, small CSV and JSON reports, all through Spark's writers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.hazard import to_sentinel
from .readers import observed_path
from .scratch import stored


def write_new_maps(maps: DataFrame, path: str, spark: SparkSession | None = None) -> DataFrame:
    """Writes the maps whose dates are not there yet, a partition each (year, map_date); returns the dates written.

    The dates that are there come from the partitions alone and meet the maps in an anti-join. Each new date replaces its own
    partition, which appears whole or not at all, so a call that broke half-way is simply made again.
    """
    spark = spark or maps.sparkSession
    dates = lambda: spark.read.schema("map_date date").option("basePath", path).parquet(path).select("map_date").distinct()
    nothing = spark.createDataFrame([], "map_date date")
    done = stored(dates()) if _any(spark, f"{path}/year=*/map_date=*") else nothing  # one row a map
    new = maps.join(done, "map_date", "left_anti").withColumn("year", F.year("map_date"))
    new.select(*maps.columns, "year").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("year", "map_date").parquet(path)
    return stored(dates().join(done, "map_date", "left_anti")) if _any(spark, f"{path}/year=*/map_date=*") else nothing


def _any(spark: SparkSession, pattern: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(pattern)
    return bool(at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(at))


def write_hazard(hazard: DataFrame, path: str, sentinel: bool = False, observed: DataFrame | None = None) -> None:
    """Hazard bands by year; on demand with the no-data number in place of null, and the days observed in each year
    (year, observed_days) in a table beside them."""
    bands = [c for c in hazard.columns if c not in ("year", "row", "col", "season", "season_year")]
    rows = hazard.withColumns({b: to_sentinel(F.col(b)) for b in bands}) if sentinel else hazard
    key = "year" if "year" in hazard.columns else "season_year"
    rows.write.mode("overwrite").option("compression", "zstd").partitionBy(key).parquet(path)
    if observed is not None:
        observed.select(F.col("year").cast("int").alias("year"), F.col("observed_days").cast("long").alias("observed_days")).write.mode("overwrite").parquet(observed_path(path))


def write_pool(hf_years: DataFrame, path: str, fmt: str = "parquet") -> None:
    if fmt == "arrays":
        hf_years.write.mode("overwrite").partitionBy("hf_id", "year").parquet(path)
    elif fmt == "parquet":
        hf_years.write.mode("overwrite").option("compression", "zstd").parquet(path)
    else:
        raise ValueError(f"unknown format: {fmt}")


def pool_metadata(hf_years: DataFrame) -> DataFrame:
    """One JSON document: counts, years, facilities by type, buffers."""
    kinds = hf_years.select("hf_id", "hf_type").distinct().groupBy("hf_type").agg(F.count("*").alias("n")).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("hf_type", "n")))).alias("types"))
    sums = hf_years.agg(F.count("*").alias("records"), F.count_distinct("hf_id").alias("facilities"), F.sort_array(F.collect_set("year")).alias("years"), F.sort_array(F.collect_set("buffer_pixels")).alias("buffers"))
    return sums.crossJoin(F.broadcast(kinds)).select(F.to_json(F.struct("*")).alias("metadata"))


def write_json_document(df: DataFrame, path: str) -> None:
    """A one-row text column as one file."""
    df.coalesce(1).write.mode("overwrite").text(path)


def write_year_summary(hf_years: DataFrame, path: str) -> None:
    hf_years.select("hf_id", "hf_type", "year", "n_days", "total_flooded_days").write.mode("overwrite").option("header", True).csv(path)


def write_review_list(bad_maps: DataFrame, path: str) -> None:
    bad_maps.select(F.concat_ws(" ", "map_date", F.to_json("codes"))).coalesce(1).write.mode("overwrite").text(path)


def write_by_facility(pool: DataFrame, path: str) -> None:
    """One partition a facility, named after it with slashes and spaces replaced; one task writes each."""
    keyed = pool.withColumn("hf_key", F.regexp_replace("hf_id", "[/ ]", "_"))
    keyed.repartition("hf_key").write.mode("overwrite").partitionBy("hf_key").parquet(path)


def write_results(tables: dict[str, DataFrame], path: str, parquet: tuple[str, ...] = ("scenario_stats", "observed_stats")) -> None:
    """Named result tables: the large ones as Parquet, the others as CSV; an empty trend table is left out."""
    for name, df in tables.items():
        if name == "trend" and df.isEmpty():
            continue
        target = f"{path}/{name}"
        if name in parquet:
            df.write.mode("overwrite").parquet(target)
        else:
            df.write.mode("overwrite").option("header", True).csv(target)
