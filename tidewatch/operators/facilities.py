"""Facilities: cleaning, placing on the grid, and the pixels of their buffers."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import buffer_pixels, facility_type, require_columns

REQUIRED = ["county_code", "payam_code", "hf_id", "longitude", "latitude", "functional_status"]
PIXEL_M = 90.0
#: Side of the squares that pixels and facilities are dealt to; at least as wide as the widest buffer.
BUCKET = 60
#: Parts of a square by day.
SPREAD = 16


@dataclass(frozen=True)
class Grid:
    """Affine grid: longitude = c + col * a + row * b, latitude = f + col * d + row * e; height and width in pixels."""

    a: float
    e: float
    c: float
    f: float
    height: int
    width: int
    b: float = 0.0
    d: float = 0.0

    def row_col(self, lat: Column, lon: Column) -> tuple[Column, Column]:
        """The nearest pixel, halves to the even one."""
        det = self.a * self.e - self.b * self.d
        x, y = lon - self.c, lat - self.f
        return F.rint((y * self.a - x * self.d) / det).cast("int"), F.rint((x * self.e - y * self.b) / det).cast("int")


def valid_facilities(df: DataFrame) -> DataFrame:
    """Rows that are complete and not marked as not functional."""
    require_columns(df, REQUIRED, "facilities")
    return df.dropna(subset=REQUIRED).filter(F.lower(F.trim("functional_status")) != "not functional")


def first_by_coordinates(df: DataFrame) -> DataFrame:
    """The first facility by id of each coordinate."""
    n = F.row_number().over(Window.partitionBy("longitude", "latitude").orderBy("hf_id"))
    return df.withColumn("__n", n).filter(F.col("__n") == 1).drop("__n")


def shared_coordinates(df: DataFrame) -> DataFrame:
    return df.groupBy("longitude", "latitude").agg(F.count("*").alias("facilities"), F.sort_array(F.collect_list("hf_id")).alias("ids")).filter("facilities > 1")


def place(df: DataFrame, grid: Grid, pixel_m: float = PIXEL_M) -> DataFrame:
    """Adds hf_type, buffer_pixels, buffer_meters, row, col, inside and the clipped bounds of the buffer (ends exclusive)."""
    row, col = grid.row_col(F.col("latitude"), F.col("longitude"))
    df = df.withColumn("hf_type", facility_type(F.col("hf_id"))).withColumn("buffer_pixels", buffer_pixels(F.col("hf_type"))).withColumn("buffer_meters", F.col("buffer_pixels") * pixel_m)
    df = df.withColumn("row", row).withColumn("col", col)
    inside = (F.col("row") >= 0) & (F.col("row") < grid.height) & (F.col("col") >= 0) & (F.col("col") < grid.width)
    half = F.floor(F.col("buffer_pixels") / 2).cast("int")
    df = df.withColumn("inside", F.coalesce(inside, F.lit(False)))
    for axis, most in (("row", grid.height), ("col", grid.width)):
        df = df.withColumn(f"{axis}_from", F.greatest(F.col(axis) - half, F.lit(0))).withColumn(f"{axis}_to", F.least(F.col(axis) + half, F.lit(most)))
    return df


def facility_pixels(placed: DataFrame, pixels: DataFrame, value: list[str], spread: str | None = None) -> DataFrame:
    """Every facility inside the grid with the pixels of its buffer.

    A join on the squares of BUCKET pixels that a buffer touches, nine at most, then the exact bounds. `spread`, a column
    of many values a pixel such as its day, deals each square's rows to SPREAD parts, and facilities go to all of them, so
    that no task has all days of a dense square.
    """
    span = lambda axis: F.explode(F.sequence(F.floor(F.col(f"{axis}_from") / BUCKET), F.floor((F.col(f"{axis}_to") - 1) / BUCKET)))
    near = placed.filter("inside AND row_from < row_to AND col_from < col_to").withColumnsRenamed({"row": "hf_row", "col": "hf_col"})
    near = near.withColumn("__br", span("row")).withColumn("__bc", span("col"))
    rows = pixels.select("row", "col", *value, F.floor(F.col("row") / BUCKET).alias("__br"), F.floor(F.col("col") / BUCKET).alias("__bc"))
    keys = ["__br", "__bc"]
    if spread:
        near = near.withColumn("__part", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))))
        rows = rows.withColumn("__part", F.pmod(F.xxhash64(spread), F.lit(SPREAD)).cast("int"))
        keys.append("__part")
    hit = (F.col("row") >= F.col("row_from")) & (F.col("row") < F.col("row_to")) & (F.col("col") >= F.col("col_from")) & (F.col("col") < F.col("col_to"))
    return near.join(rows, keys).filter(hit).drop(*keys)


def buffer_metrics(placed: DataFrame, pixels: DataFrame, pixel_m: float = PIXEL_M) -> DataFrame:
    """For each facility and day: any flood, share of valid pixels flooded, distance to the nearest flood, validity.

    Pixels of the buffer beyond the grid count as no data. Days without a map give no row.
    """
    rows = facility_pixels(placed, pixels, ["map_date", "value"], "map_date")
    wet = F.col("value") == 1
    dr, dc = F.col("row") - F.col("hf_row"), F.col("col") - F.col("hf_col")
    out = rows.groupBy("hf_id", F.col("map_date").alias("date")).agg(
        F.count("value").alias("n_valid_pixels"),
        F.count_if(wet).alias("wet"),
        (F.sqrt(F.min(F.when(wet, dr * dr + dc * dc)).cast("double")) * pixel_m).alias("distance_m"),
        F.max("buffer_pixels").alias("size"),
        F.bool_or((F.col("row_to") - F.col("row_from") < F.col("buffer_pixels")) | (F.col("col_to") - F.col("col_from") < F.col("buffer_pixels"))).alias("buffer_partial"),
    )
    total = (F.floor(F.col("size") / 2) * 2).cast("long")
    out = out.withColumn("total_pixels_buffer", total * total)
    return out.select(
        "hf_id", "date", (F.col("wet") > 0).cast("int").alias("binary"),
        F.when(F.col("n_valid_pixels") > 0, F.col("wet") * 100.0 / F.col("n_valid_pixels")).otherwise(0.0).alias("pct_pixels"), "distance_m",
        (F.col("total_pixels_buffer") - F.col("n_valid_pixels")).alias("n_no_data"), "n_valid_pixels", "total_pixels_buffer",
        (F.col("n_valid_pixels") * 100.0 / F.col("total_pixels_buffer")).alias("pct_valid_data"), F.lit(True).alias("inside_aoi"), "buffer_partial",
    )


def point_lookup(placed: DataFrame, pixels: DataFrame, value: list[str]) -> DataFrame:
    """The values of the pixel a facility stands on."""
    return placed.filter("inside").join(pixels.select("row", "col", *value), ["row", "col"])


def facilities_outside(placed: DataFrame, pixels: DataFrame) -> DataFrame:
    """Facilities that stand on no pixel of any map."""
    return placed.join(pixels.select("row", "col").distinct(), ["row", "col"], "left_anti")


def aoi_coverage(placed: DataFrame, pixels: DataFrame) -> DataFrame:
    """hf_id, year, covered: whether the facility's pixel is on the year's first map."""
    first = pixels.groupBy(F.year("map_date").alias("year")).agg(F.min("map_date").alias("map_date"))
    on = pixels.join(F.broadcast(first), "map_date").select("year", "row", "col").distinct()  # one row a year is broadcast
    every = placed.select("hf_id", "row", "col").crossJoin(F.broadcast(first.select("year")))
    return every.join(on.withColumn("covered", F.lit(True)), ["year", "row", "col"], "left").select("hf_id", "year", F.coalesce("covered", F.lit(False)).alias("covered"))


def extraction_counters(coverage: DataFrame, metrics: DataFrame) -> DataFrame:
    """One row: facility-years seen, inside, outside, and facility-days without valid pixels."""
    seen = coverage.agg(F.count("*").alias("processed"), F.count_if("covered").alias("inside"), F.count_if(~F.col("covered")).alias("outside"))
    return seen.crossJoin(F.broadcast(metrics.agg(F.count_if(F.col("n_valid_pixels") == 0).alias("no_data_days"))))


def hf_year_series(metrics: DataFrame, placed: DataFrame) -> DataFrame:
    """One row a facility and year with its days as parallel arrays in date order, rounded to two places."""
    day = F.struct(F.col("date"), F.col("binary"), F.round("pct_pixels", 2).alias("pct"), F.round("distance_m", 2).alias("dist"), F.col("n_no_data"))
    rows = metrics.groupBy("hf_id", F.year("date").alias("year")).agg(F.array_sort(F.collect_list(day)).alias("d"), F.sum("binary").cast("int").alias("total_flooded_days"), F.count("*").cast("int").alias("n_days"))
    arrays = [F.col("d.date").cast("array<string>").alias("dates"), F.col("d.binary").alias("series_binary"), F.col("d.pct").alias("series_pct_flood_pixels"), F.col("d.dist").alias("series_distance_m"), F.col("d.n_no_data").alias("series_no_data_count")]
    meta = placed.select("hf_id", "hf_type", "latitude", "longitude", "buffer_pixels", "buffer_meters")
    return rows.join(meta, "hf_id").select(*meta.columns, "year", "n_days", "total_flooded_days", *[F.to_json(a, {"ignoreNullFields": "false"}).alias(n) for a, n in zip(arrays, ("dates", "series_binary", "series_pct_flood_pixels", "series_distance_m", "series_no_data_count"), strict=True)])


def explode_series(hf_year: DataFrame) -> DataFrame:
    """Daily rows of facility-years; arrays may be JSON text or arrays. Percentages become shares."""
    kinds = {"dates": "array<string>", "series_binary": "array<int>", "series_pct_flood_pixels": "array<double>", "series_distance_m": "array<double>"}
    parse = lambda c: F.from_json(c, kinds[c]) if dict(hf_year.dtypes)[c] == "string" else F.col(c)
    rows = hf_year.withColumns({c: parse(c) for c in kinds}).withColumn("d", F.explode(F.arrays_zip(*kinds)))
    kept = [c for c in hf_year.columns if c not in kinds and c not in ("year", "n_days", "total_flooded_days", "series_no_data_count")]
    date = F.to_date("d.dates")
    return rows.select(*kept, date.alias("date"), F.col("d.series_binary").alias("occurrence"), (F.col("d.series_pct_flood_pixels") / 100).alias("pct_flooded"), F.col("d.series_distance_m").alias("min_distance"), F.dayofyear(date).alias("day_of_year"), F.year(date).alias("year"))


def dry_distance_impute(df: DataFrame) -> DataFrame:
    """Dry days get the distance to the corner of the buffer."""
    corner = F.when(F.col("buffer_pixels") == 40, 2545.5).when(F.col("buffer_pixels") == 60, 3818.0).otherwise(F.col("min_distance"))
    return df.withColumn("min_distance", F.when(F.col("occurrence") == 0, corner).otherwise(F.col("min_distance")))


def patch_means(placed: DataFrame, by_pixel: DataFrame, values: list[str]) -> DataFrame:
    """Means of pixel values over each facility's buffer."""
    rows = facility_pixels(placed, by_pixel, values)
    return rows.groupBy("hf_id").agg(F.count("*").alias("pixels"), *[F.avg(v).alias(v) for v in values])


def join_zones(rows: DataFrame, zones: DataFrame) -> DataFrame:
    """rows with the zone of their facility and its name in capitals; facilities without a zone go. One zone a facility
    counts, the smallest where there are several."""
    one = zones.groupBy("hf_id").agg(F.min(F.struct("zone", F.upper("zone_name").alias("zone_name"))).alias("z")).select("hf_id", "z.*")
    return rows.join(one, "hf_id")
