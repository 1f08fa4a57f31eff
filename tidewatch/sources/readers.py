"""Readers with explicit schemas, so nothing is inferred and missing columns fail at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions.columns import require_columns, season
from ..operators.facilities import REQUIRED

POOL = "hf_id string, hf_payam string, hf_category string, latitude double, longitude double, buffer_pixels int, date date, occurrence int, pct_flooded double, min_distance double, day_of_year int, year int, scenario_id int, is_synthetic int"
POOL_NEEDS = ["hf_id", "date", "occurrence", "pct_flooded", "min_distance"]


def read_pixels(spark: SparkSession, path: str, rows: tuple[int, int] | None = None) -> DataFrame:
    """Pixel table; `rows` (first, end) reaches the scan as a pushed filter."""
    df = require_columns(spark.read.parquet(path), ["map_date", "row", "col", "code"], "pixels")
    return df if rows is None else df.filter((F.col("row") >= rows[0]) & (F.col("row") < rows[1]))


def map_date(name: Column, strict: bool = True) -> Column:
    """The date in a map's file name: eight digits after _e, or, leniently, the first eight digits. Null without."""
    exact = F.to_date(F.nullif(F.regexp_extract(name, r"_e(\d{8})", 1), F.lit("")), "yyyyMMdd")
    return exact if strict else F.coalesce(exact, F.to_date(F.nullif(F.regexp_extract(name, r"(\d{8})", 1), F.lit("")), "yyyyMMdd"))


def map_catalog(names: DataFrame, strict: bool = True) -> DataFrame:
    """file_name, map_date, year, season, season_year; names without a date keep a null date."""
    rows = names.withColumn("map_date", map_date(F.col("file_name"), strict)).withColumn("year", F.year("map_date"))
    label, year = season(F.year("map_date"), F.month("map_date"))
    known = F.col("map_date").isNotNull()
    return rows.withColumn("season", F.when(known, label)).withColumn("season_year", F.when(known, year))


def read_facilities(spark: SparkSession, path: str) -> DataFrame:
    df = spark.read.option("header", True).csv(path)
    names = {c: c.strip().lower().replace(" ", "_") for c in df.columns}
    df = df.withColumnsRenamed({**names, **{c: "hf_id" for c, n in names.items() if n == "health_facility_name"}})
    require_columns(df, REQUIRED, "facilities")
    return df.withColumns({"longitude": F.col("longitude").try_cast("double"), "latitude": F.col("latitude").try_cast("double")})


def read_pool_csv(spark: SparkSession, path: str) -> DataFrame:
    header = spark.read.option("header", True).csv(path).columns
    kinds = dict(x.split(" ") for x in POOL.split(", "))
    schema = ", ".join(f"`{c}` {kinds.get(c, 'string')}" for c in header)
    return require_columns(spark.read.option("header", True).option("dateFormat", "yyyy-MM-dd").schema(schema).csv(path), POOL_NEEDS, "pool")


def read_hf_years(spark: SparkSession, path: str) -> DataFrame:
    return require_columns(spark.read.parquet(path), ["hf_id", "year", "dates", "series_binary", "series_pct_flood_pixels", "series_distance_m"], "facility years")


#: Facilities whose keys are broadcast at most, a few MB; more are joined as Spark sees fit.
BROADCAST_FACILITIES = 100_000


def read_by_facility(spark: SparkSession, path: str, facilities: list[str] | DataFrame | None = None) -> DataFrame:
    """A pool partitioned by facility; only the partitions of the given facilities are read.

    A list of names is a filter on the partitions. A table (hf_id and any other columns but the pool's) is joined: with a
    filter on that table the scan prunes its partitions while the query runs. Keys are text, whatever they look like.
    """
    schema = spark.read.option("basePath", path).parquet(_any_partition(spark, path, "hf_key")).schema  # the others are listed once, below
    schema["hf_key"].dataType = StringType()
    df = spark.read.schema(schema).parquet(path)
    if facilities is None:
        return df
    if isinstance(facilities, list):
        return df.filter(F.col("hf_key").isin(*[safe_name(x) for x in facilities]))
    keys = facilities.withColumn("hf_key", F.regexp_replace("hf_id", "[/ ]", "_")).drop("hf_id")
    few = keys.limit(BROADCAST_FACILITIES + 1).count() <= BROADCAST_FACILITIES
    return df.join(F.broadcast(keys) if few else keys, "hf_key")


def _any_partition(spark: SparkSession, path: str, key: str) -> str:
    """A partition of the table, or the table itself where it has none."""
    jpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there = jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatusIterator(jpath)
    while there.hasNext():
        if (at := there.next().getPath()).getName().startswith(f"{key}="):
            return at.toString()
    return path


def read_hazard(spark: SparkSession, path: str, years: list[int] | None = None, bands: list[str] | None = None) -> DataFrame:
    """Stored hazard of the given years with the wanted bands, and the observed days of each year where they are stored
    beside it (writers.write_hazard). Years reach the scan as partition filters, bands as its read schema."""
    df = require_columns(spark.read.parquet(path), ["year", "row", "col", *(bands or [])], "hazard")
    df = df if years is None else df.filter(F.col("year").isin(*years))
    df = df if bands is None else df.select("year", "row", "col", *bands)
    side = observed_path(path)
    jpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(side)
    if not jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(jpath):
        return df
    days = spark.read.schema("year int, observed_days long").parquet(side)
    return df.join(F.broadcast(days), "year", "left")  # one row a year


def observed_path(path: str) -> str:
    return f"{path.rstrip('/')}-observed-days"


def safe_name(name: str) -> str:
    return name.replace("/", "_").replace(" ", "_")


def split_pool(df: DataFrame, synthetic: bool) -> DataFrame:
    """The observed or synthetic rows; all rows where the table does not tell."""
    return df if "is_synthetic" not in df.columns else df.filter(F.col("is_synthetic") == int(synthetic))


def read_draws(spark: SparkSession, path: str) -> DataFrame:
    return require_columns(spark.read.parquet(path), ["param", "chain", "draw", "idx", "value"], "draws")
