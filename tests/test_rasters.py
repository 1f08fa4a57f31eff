import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidewatch.operators import facilities, hazard, raster_eda
from tidewatch.operators.facilities import Grid
from tidewatch.sources import readers, writers

GRID = Grid(a=0.01, e=-0.01, c=30.0, f=5.0, height=100, width=80)


def placed(spark, points):
    rows = [(f"hf {i} PHCC", lat, lon) for i, (lat, lon) in enumerate(points)]
    return facilities.place(spark.createDataFrame(rows, "hf_id string, latitude double, longitude double"), GRID)


def at(row, col):
    return 5.0 - row * 0.01, 30.0 + col * 0.01


def test_placing_edges(spark):
    rows = placed(spark, [at(0, 0), at(99, 79), at(100, 10), at(-1, 10), at(50, 40)]).orderBy("hf_id").collect()
    assert [r["inside"] for r in rows] == [True, True, False, False, True]
    assert (rows[0]["row_from"], rows[0]["row_to"]) == (0, 30) and (rows[4]["col_from"], rows[4]["col_to"]) == (10, 70)


def test_band_join_equals_a_scan(spark):
    p = placed(spark, [at(0, 0), at(59, 61), at(60, 60), at(99, 79)])
    pixels = spark.range(100 * 80).select(F.floor(F.col("id") / 80).cast("int").alias("row"), (F.col("id") % 80).cast("int").alias("col"), F.lit(1).alias("value"))
    got = {r["hf_id"]: r["n"] for r in facilities.facility_pixels(p, pixels, ["value"]).groupBy("hf_id").agg(F.count("*").alias("n")).collect()}
    for r in p.collect():
        assert got[r["hf_id"]] == (r["row_to"] - r["row_from"]) * (r["col_to"] - r["col_from"])
    plan = facilities.facility_pixels(p, pixels, ["value"])._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_buffer_metrics_center_and_no_flood(spark):
    p = placed(spark, [at(50, 40)])
    day = dt.date(2020, 1, 1)
    rows = [(day, 50, 40, 1), (day, 50, 43, 1), (dt.date(2020, 1, 2), 50, 40, 0), (dt.date(2020, 1, 3), 53, 44, 1), (dt.date(2020, 1, 4), 50, 40, None)]
    got = {r["date"].day: r for r in facilities.buffer_metrics(p, spark.createDataFrame(rows, "map_date date, row int, col int, value int")).collect()}
    assert got[1]["distance_m"] == 0.0 and got[1]["pct_pixels"] == 100.0
    assert got[2]["distance_m"] is None and got[2]["binary"] == 0
    assert got[3]["distance_m"] == pytest.approx(450.0) and got[3]["n_no_data"] == 3599
    assert got[4]["n_valid_pixels"] == 0 and got[4]["pct_pixels"] == 0.0


def test_series_round_trip_keeps_null_distances(spark):
    p = placed(spark, [at(50, 40)])
    rows = [(dt.date(2020, 1, 1), 50, 40, 1), (dt.date(2020, 1, 2), 50, 40, 0)]
    m = facilities.buffer_metrics(p, spark.createDataFrame(rows, "map_date date, row int, col int, value int"))
    days = facilities.explode_series(facilities.hf_year_series(m, p)).orderBy("date").collect()
    assert [(r["occurrence"], r["pct_flooded"], r["min_distance"]) for r in days] == [(1, 1.0, 0.0), (0, 0.0, None)]


def test_no_pixel_inside_is_an_error(spark):
    df = spark.createDataFrame([(dt.date(2020, 1, 1), 0, 0, 1)], "map_date date, row int, col int, code int")
    with pytest.raises(Exception, match="no pixel of the first map"):
        hazard.aoi_bbox(df).collect()


def test_all_missing_pixels(spark):
    df = spark.createDataFrame([(dt.date(2020, 1, 1), 0, 0, 30), (dt.date(2020, 1, 11), 0, 0, 50)], "map_date date, row int, col int, code int")
    b = hazard.binarize(df)
    one = hazard.hazard_annual(b).first()
    assert one["flood_frequency"] is None and one["flood_duration"] == 0
    three = hazard.hazard_annual_3(b).first()
    assert three["valid_obs"] is None and three["max_consecutive"] is None
    assert hazard.hazard_annual_2(hazard.hazard_seasonal_2(b)).first()["flood_duration"] is None


@pytest.mark.parametrize("rule,want", [("facility", [1, 2, 4, 3]), ("map", [1, 2, 3, 3])])
def test_zone_rules(spark, rule, want):
    df = spark.createDataFrame([(0, 6, 1.0), (1, 7, 1.0), (2, 6, 1.25), (3, 7, 2.0)], "i int, persistence int, cv double")
    assert [r["zone"] for r in raster_eda.zone_class(df, rule=rule).orderBy("i").collect()] == want


def test_map_catalog_names(spark):
    names = spark.createDataFrame([("m_e20121130_v.tif",), ("x20130102.tif",), ("none.tif",)], "file_name string")
    strict = {r["file_name"]: r["map_date"] for r in readers.map_catalog(names).collect()}
    loose = {r["file_name"]: r for r in readers.map_catalog(names, strict=False).collect()}
    assert strict["x20130102.tif"] is None and loose["x20130102.tif"]["map_date"] == dt.date(2013, 1, 2)
    assert loose["none.tif"]["season"] is None and loose["m_e20121130_v.tif"]["season_year"] == 2013


def test_valid_facilities_and_reader(spark, tmp_path):
    (tmp_path / "f.csv").write_text("County_code,Payam_code,Health Facility Name,longitude,latitude,Functional Status\nc,p,A,30,5,Functional\nc,p,B,30,5, Not Functional \nc,p,C,x,5,Functional\n")
    rows = facilities.valid_facilities(readers.read_facilities(spark, str(tmp_path / "f.csv"))).collect()
    assert [r["hf_id"] for r in rows] == ["A"]


def test_incremental_map_writes(spark, tmp_path):
    path = str(tmp_path / "maps")
    df = spark.createDataFrame([(dt.date(2020, 1, 1), 0, 0, 1), (dt.date(2020, 1, 11), 0, 0, 0)], "map_date date, row int, col int, value int")
    assert writers.write_new_maps(df.limit(1), path, spark).count() == 1
    assert writers.write_new_maps(df, path, spark).count() == 1
    assert spark.read.parquet(path).count() == 2


def test_pool_by_facility_round_trip(spark, tmp_path):
    path = str(tmp_path / "pool")
    writers.write_by_facility(spark.createDataFrame([("A/B C", 1), ("D", 2)], "hf_id string, v int"), path)
    df = readers.read_by_facility(spark, path, ["A/B C"])
    assert [r["v"] for r in df.collect()] == [1]
    assert "PartitionFilters: [isnotnull(hf_key" in df._jdf.queryExecution().executedPlan().toString()
    with pytest.raises(ValueError, match="unknown format"):
        writers.write_pool(df, path, "npz")


def test_results_and_metadata(spark, tmp_path):
    empty = spark.createDataFrame([], "a int")
    writers.write_results({"trend": empty, "ranking": spark.createDataFrame([(1,)], "a int"), "scenario_stats": empty}, str(tmp_path))
    assert not (tmp_path / "trend").exists() and (tmp_path / "ranking").exists() and (tmp_path / "scenario_stats").exists()


def test_days_of_a_dense_square_are_dealt_apart(spark):
    """Dealing days to parts gives each pixel once, as the join without parts does."""
    p = placed(spark, [at(50, 40), at(51, 41), at(0, 0)])
    days = [dt.date(2020, 1, 1) + dt.timedelta(days=i) for i in range(40)]
    pixels = spark.createDataFrame([(day, row, col, (row + col) % 2) for day in days for row in range(45, 56, 2) for col in range(36, 46, 3)] + [(None, 50, 40, 1)], "map_date date, row int, col int, value int")
    count = lambda df: sorted((r["hf_id"], str(r["map_date"]), r["row"], r["col"]) for r in df.collect())
    whole = count(facilities.facility_pixels(p, pixels, ["map_date", "value"]))
    assert count(facilities.facility_pixels(p, pixels, ["map_date", "value"], "map_date")) == whole and len(whole) == len(set(whole)) > 1000
