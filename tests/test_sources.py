import datetime as dt
import os
import shutil

import pytest
from pyspark.sql import functions as F

from tidewatch.sources import readers, writers


def metric(df, name):
    """A metric of the scans of a plan that has run."""
    plan = df._jdf.queryExecution().executedPlan()
    plan = plan.finalPhysicalPlan() if plan.getClass().getSimpleName() == "AdaptiveSparkPlanExec" else plan
    found, todo = [], [plan]
    while todo:
        node = todo.pop()
        kids = node.children()
        todo += [kids.apply(i) for i in range(kids.size())]
        if node.getClass().getSimpleName().endswith("QueryStageExec"):
            todo.append(node.plan())
        if "FileSourceScan" in node.getClass().getSimpleName() and node.metrics().contains(name):
            found.append((str(node), node.metrics().apply(name).value()))
    return found


@pytest.fixture
def pool(spark, tmp_path):
    rows = [(f"h/{i} x" if i % 2 else str(i), f"2020-01-{d:02d}", i * d) for i in range(20) for d in (1, 2, 3)]
    df = spark.createDataFrame(rows, "hf_id string, day string, v int")
    writers.write_by_facility(df, str(tmp_path / "pool"))
    spark.createDataFrame([(f"h/{i} x" if i % 2 else str(i), "far" if i in (3, 4) else "near") for i in range(20)], "hf_id string, zone string").write.parquet(str(tmp_path / "fac"))
    return tmp_path


def test_a_filtered_table_prunes_partitions_as_the_query_runs(spark, pool):
    far = spark.read.parquet(str(pool / "fac")).filter("zone = 'far'")
    rows = readers.read_by_facility(spark, str(pool / "pool"), far)
    assert sorted((r["hf_id"], r["v"], r["zone"]) for r in rows.collect()) == sorted((h, i * d, "far") for h, i in (("h/3 x", 3), ("4", 4)) for d in (1, 2, 3))
    scans = [(text, n) for text, n in metric(rows, "numPartitions")]
    assert any("dynamicpruning" in text and n == 2 for text, n in scans)


def test_names_prune_partitions_before_the_query_runs(spark, pool):
    rows = readers.read_by_facility(spark, str(pool / "pool"), ["h/3 x", "4", "absent"])
    assert sorted({r["hf_id"] for r in rows.collect()}) == ["4", "h/3 x"]
    assert [n for _, n in metric(rows, "numPartitions")] == [2]
    assert dict(rows.dtypes)["hf_key"] == "string"
    assert readers.read_by_facility(spark, str(pool / "pool")).count() == 60


def test_hazard_of_years_and_bands(spark, tmp_path):
    rows = [(y, r, 0, 0.5 * r, r, y - 2000) for y in range(2010, 2016) for r in range(3)]
    hazard = spark.createDataFrame(rows, "year int, row int, col int, flood_frequency double, valid_obs int, max_consecutive int")
    days = spark.createDataFrame([(y, 300 + y % 10) for y in range(2010, 2015)], "year int, observed_days int")
    writers.write_hazard(hazard, str(tmp_path / "a"), observed=days)
    writers.write_hazard(hazard, str(tmp_path / "b"))
    got = readers.read_hazard(spark, str(tmp_path / "a"), [2012, 2015], ["valid_obs"])
    assert sorted(map(tuple, got.collect()), key=str) == sorted([(y, r, 0, r, {2012: 302}.get(y)) for y in (2012, 2015) for r in range(3)], key=str)
    text = got._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [year" in text and "2012" in text and "flood_frequency" not in text
    assert [n for t, n in metric(got, "numPartitions") if "valid_obs" in t] == [2]
    assert readers.read_hazard(spark, str(tmp_path / "b")).columns == ["row", "col", "flood_frequency", "valid_obs", "max_consecutive", "year"]
    with pytest.raises(ValueError, match="lacks columns: nothing"):
        readers.read_hazard(spark, str(tmp_path / "b"), bands=["nothing"])


def maps(spark, days, broken=None):
    rows = [(dt.date(2020, 12, d) if d < 32 else dt.date(2021, 1, d - 31), r, d) for d in days for r in range(4)]
    df = spark.createDataFrame(rows, "map_date date, row int, code int").repartition(3, "map_date")
    return df if broken is None else df.withColumn("code", F.when(F.dayofmonth("map_date") == broken, F.raise_error(F.lit("broken"))).otherwise(F.col("code")).cast("int"))


def stored_maps(spark, path):
    return {(str(r["map_date"]), r["count"]) for r in spark.read.parquet(path).groupBy("map_date").count().collect()}


def test_a_write_that_broke_is_made_again(spark, tmp_path):
    path = str(tmp_path / "maps")
    assert [str(r["map_date"]) for r in writers.write_new_maps(maps(spark, [1, 2]), path).orderBy("map_date").collect()] == ["2020-12-01", "2020-12-02"]
    with pytest.raises(Exception, match="broken"):
        writers.write_new_maps(maps(spark, [1, 2, 3, 4, 40], broken=4), path)
    assert stored_maps(spark, path) == {("2020-12-01", 4), ("2020-12-02", 4)}
    # a commit that moved one partition and then broke: that date is whole, the rest lies in a staging folder
    other = str(tmp_path / "other")
    writers.write_new_maps(maps(spark, [3, 4]), other)
    shutil.copytree(f"{other}/year=2020/map_date=2020-12-03", f"{path}/year=2020/map_date=2020-12-03")
    shutil.copytree(f"{other}/year=2020/map_date=2020-12-04", f"{path}/.spark-staging-1/year=2020/map_date=2020-12-04")
    first = writers.write_new_maps(maps(spark, [1, 2, 3, 4, 40]), path)
    again = writers.write_new_maps(maps(spark, [1, 2, 3, 4, 40]), path)
    assert sorted(str(r["map_date"]) for r in first.collect()) == ["2020-12-04", "2021-01-09"] and again.count() == 0
    assert stored_maps(spark, path) == {(f"2020-12-0{d}", 4) for d in (1, 2, 3, 4)} | {("2021-01-09", 4)}
    assert os.path.isdir(f"{path}/year=2021/map_date=2021-01-09")


def test_no_maps_at_all(spark, tmp_path):
    assert writers.write_new_maps(maps(spark, [1]).limit(0), str(tmp_path / "none")).count() == 0
