"""The derived pools: even parts whatever the input, no join of days, rows with null keys."""

import re

from pyspark.sql import functions as F

from tidewatch import fixtures as fx
from tidewatch.operators import impact, model, spells

DATA = "/root/testdata/sf0.001"


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_days_meet_no_join_and_are_not_broadcast(spark):
    for pool in (fx.observed_pool(spark, DATA), fx.synthetic_pool(spark, DATA)):
        above = _plan(model.wet_rows(pool)).split("explode(")[0]
        assert "Join" not in above and "Broadcast" not in above


def test_series_stay_in_the_parts_that_facilities_were_dealt_to(spark):
    for pool, keys in ((fx.observed_pool(spark, DATA), ["hf_id", "year"]), (fx.synthetic_pool(spark, DATA), ["hf_id", "scenario_id"])):
        above = _plan(spells.label_spells(pool, keys)).split("explode(")[0]
        assert "Exchange" not in above


def test_parts_grow_with_the_input(spark):
    cores = spark.sparkContext.defaultParallelism
    assert fx._parts(spark.range(10), 300) == cores and fx._parts(spark.range(90_001), 300) == 301


def test_rows_with_null_keys_make_no_wet_days(spark, tmp_path):
    events = spark.read.parquet(f"{DATA}/events.parquet").limit(50)
    both = events.unionByName(events.withColumn("event_type", F.lit(None).cast("string"))).unionByName(events.withColumn("user_id", F.lit(None).cast("long")))
    events.write.parquet(f"{tmp_path}/a/events.parquet")
    both.write.parquet(f"{tmp_path}/b/events.parquet")
    wet = [sorted(map(tuple, model.wet_rows(fx.synthetic_pool(spark, f"{tmp_path}/{x}")).select("hf_id", "scenario_id", "date", "pct_flooded").collect())) for x in "ab"]
    assert wet[0] == wet[1] and wet[0]


def test_schema_of_a_pool_by_facility_comes_from_one_partition(spark, tmp_path, monkeypatch):
    from pyspark.sql.readwriter import DataFrameReader

    from tidewatch.sources import readers, writers

    pool = fx.observed_pool(spark, DATA)
    writers.write_by_facility(pool, path := f"{tmp_path}/pool")
    whole, plain = [], DataFrameReader.parquet
    monkeypatch.setattr(DataFrameReader, "parquet", lambda self, *paths, **more: whole.extend(p for p in paths if p == path) or plain(self, *paths, **more))
    rows = readers.read_by_facility(spark, path)
    assert whole == [path] and dict(rows.dtypes)["hf_key"] == "string" and rows.count() == pool.count()


def test_facilities_of_the_pool_have_its_categories(spark):
    want = fx.observed_pool(spark, DATA).select("hf_id", "hf_category").distinct().collect()
    assert sorted(map(tuple, fx.pool_facilities(spark, DATA).collect())) == sorted(map(tuple, want))


def test_vectors_are_dealt_to_even_parts_before_they_become_rows(spark, tmp_path):
    vectors = spark.range(5_000).selectExpr("id AS vec_id", "transform(sequence(1, 64), i -> cast(id % i AS float)) AS embedding", "0 AS label")
    vectors.coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    cores = spark.sparkContext.defaultParallelism
    for rows in (fx.draws(spark, str(tmp_path)), fx.pixel_obs(spark, str(tmp_path))):
        sizes = [r[0] for r in rows.groupBy(F.spark_partition_id()).count().select("count").collect()]
        assert len(sizes) == max(cores, 3) and max(sizes) < 2 * min(sizes) and sum(sizes) == 5_000 * 64


def test_days_of_a_part_do_not_grow_with_the_suppliers(spark, tmp_path):
    suppliers = spark.range(3_000).selectExpr("id AS s_suppkey", "cast(pmod(hash(id), 25) AS int) AS s_nationkey")
    suppliers.write.parquet(f"{tmp_path}/supplier.parquet")
    spark.read.parquet(f"{DATA}/lineitem.parquet").write.parquet(f"{tmp_path}/lineitem.parquet")
    sizes = [r[0] for r in fx.observed_pool(spark, str(tmp_path)).groupBy(F.spark_partition_id()).count().select("count").collect()]
    assert len(sizes) == 10 and max(sizes) < 2 * 190_000


def test_losses_sort_days_three_times_and_look_at_no_day_for_every_other(spark):
    pool = fx.observed_pool(spark, DATA)
    plan = _plan(impact.combined_loss(pool, ["hf_id", "year"])).split("explode(")[0]
    assert plan.count("Sort [") == 3 and not re.search(r"currentrow\$\(\), unboundedfollowing", plan)
