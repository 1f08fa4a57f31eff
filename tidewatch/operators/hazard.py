"""Pixels: recoding, cropping, and hazard measures by pixel and year or season. Null is no data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import season
from .spells import held_runs, longest_held, longest_tolerated, tolerant_runs

# Map codes.
FLOOD, NO_DATA, OUTSIDE = 200, (30, 50), 1
CODES = (1, 16, 17, 20, 30, 50, 99, 200)
NO_DATA_OUT = -9999
PIXEL = ["row", "col"]


def binarize(pixels: DataFrame, flood: int = FLOOD, nodata=NO_DATA) -> DataFrame:
    """map_date, row, col, value: 1 flood, null no data, 0 anything else."""
    value = F.when(F.col("code") == flood, 1).when(F.col("code").isin(*nodata) | F.col("code").isNull(), None).otherwise(0)
    return pixels.select("map_date", "row", "col", value.cast("smallint").alias("value"))


def to_sentinel(value: Column, sentinel: int = NO_DATA_OUT) -> Column:
    return F.coalesce(value, F.lit(sentinel))


def from_sentinel(value: Column, sentinel: int = NO_DATA_OUT) -> Column:
    return F.nullif(value, F.lit(sentinel))


def unpack_tiles(tiles: DataFrame) -> DataFrame:
    """Pixels of dense tiles (map_date, tile_row, tile_col, width, values)."""
    rows = tiles.select("map_date", "tile_row", "tile_col", "width", F.posexplode("values").alias("pos", "code"))
    return rows.select("map_date", (F.col("tile_row") + F.floor(F.col("pos") / F.col("width"))).cast("int").alias("row"), (F.col("tile_col") + F.col("pos") % F.col("width")).cast("int").alias("col"), "code")


def aoi_bbox(pixels: DataFrame, out_code: int = OUTSIDE) -> DataFrame:
    """The bounds of what is inside on the first map: one row, or an error when nothing is."""
    first = pixels.agg(F.min("map_date").alias("map_date"))
    inside = pixels.join(F.broadcast(first), "map_date").filter(F.col("code") != out_code)
    box = inside.agg(F.min("row").alias("row_min"), F.max("row").alias("row_max"), F.min("col").alias("col_min"), F.max("col").alias("col_max"))
    none = F.raise_error(F.lit("no pixel of the first map is inside the area")).cast("int")
    return box.withColumn("row_min", F.coalesce("row_min", none))


def aoi_crop(pixels: DataFrame, bbox: DataFrame) -> DataFrame:
    """Pixels within the box, numbered from its corner."""
    rows = pixels.crossJoin(F.broadcast(bbox))  # one row
    rows = rows.filter(F.col("row").between(F.col("row_min"), F.col("row_max")) & F.col("col").between(F.col("col_min"), F.col("col_max")))
    return rows.select("map_date", (F.col("row") - F.col("row_min")).alias("row"), (F.col("col") - F.col("col_min")).alias("col"), "code")


def invalid_code_maps(pixels: DataFrame, codes=CODES) -> DataFrame:
    """Maps with codes outside the known set, and which."""
    return pixels.filter(~F.col("code").isin(*codes)).groupBy("map_date").agg(F.sort_array(F.collect_set("code")).alias("codes"))


def with_season(pixels: DataFrame) -> DataFrame:
    label, year = season(F.year("map_date"), F.month("map_date"))
    return pixels.withColumn("season", label).withColumn("season_year", year)


def _measures(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys, *PIXEL).agg(F.avg("value").alias("flood_frequency"), F.coalesce(F.sum("value"), F.lit(0)).cast("int").alias("flood_duration"))


def hazard_annual(pixels: DataFrame) -> DataFrame:
    """Share of valid observations flooded (null without any) and number of floods (0 without any)."""
    return _measures(pixels.withColumn("year", F.year("map_date")), ["year"])


def hazard_seasonal(pixels: DataFrame) -> DataFrame:
    return _measures(with_season(pixels), ["season_year", "season"])


def hazard_annual_3(pixels: DataFrame, gap: int = 2) -> DataFrame:
    """Frequency, duration, valid observations and the longest held streak; all null where nothing was observed."""
    rows = pixels.withColumn("year", F.year("map_date"))
    keys = ["year", *PIXEL]
    both = held_runs(rows, keys, gap=gap).groupBy(*keys)
    both = both.agg(F.count("value").cast("int").alias("valid_obs"), F.sum("value").cast("int").alias("flood_duration"), longest_held().alias("max_consecutive"))
    return both.select(*keys, (F.col("flood_duration") / F.nullif("valid_obs", F.lit(0))).alias("flood_frequency"), "flood_duration", F.nullif("valid_obs", F.lit(0)).alias("valid_obs"), "max_consecutive")


def hazard_seasonal_2(pixels: DataFrame, gap: int = 5) -> DataFrame:
    rows = with_season(pixels)
    keys = ["season_year", "season", *PIXEL]
    out = tolerant_runs(rows, keys, gap=gap).groupBy(*keys)
    return out.agg(F.coalesce(F.sum("value"), F.lit(0)).cast("int").alias("flooded"), F.count("value").cast("int").alias("valid"), longest_tolerated().alias("max_run"))


def hazard_annual_2(seasonal: DataFrame) -> DataFrame:
    """Seasons rolled up to years: sums, the longest run of any season, frequency; null where nothing was observed."""
    out = seasonal.groupBy(F.col("season_year").alias("year"), *PIXEL).agg(F.sum("flooded").alias("flooded"), F.sum("valid").alias("valid"), F.max("max_run").alias("max_run"))
    seen = F.col("valid") > 0
    return out.select("year", *PIXEL, F.when(seen, F.col("flooded") / F.col("valid")).alias("flood_frequency"), F.when(seen, F.col("flooded")).cast("int").alias("flood_duration"), F.when(seen, F.col("valid")).cast("int").alias("valid_obs"), F.when(seen, F.col("max_run")).alias("max_consecutive"))
