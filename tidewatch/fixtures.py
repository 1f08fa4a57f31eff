"""The domain's input tables, derived from the generic test tables so that work grows with them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators.facilities import Grid

FIRST_DAY, LAST_DAY = "1995-01-02", "2001-11-04"
BREAKPOINT = 1998
CATEGORIES = ["SAFE", "CHRONIC", "UNSTABLE", "CRITICAL"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _category(key):
    return F.element_at(F.array(*[F.lit(c) for c in CATEGORIES]), (F.pmod(key, F.lit(4)) + 1).cast("int"))


def _parts(rows: DataFrame, rows_a_part: int) -> int:
    """Parts for a dense table made from rows: so many that they are of one size whatever the input, and one a core at least."""
    return max(rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // rows_a_part))


def observed_pool(spark: SparkSession, d: str) -> DataFrame:
    """Seven dense years of days for 25 facilities (one a nation) per hundred suppliers; a day is wet if lines shipped.

    Facilities and lines are dealt to parts of 300 suppliers, some 190,000 days, by facility; there a facility becomes its
    days, which meet the lines by grouping. So no task makes all days, none are broadcast, and series of a facility need no
    other exchange. The parts keep their number.
    """
    supplier = table(spark, d, "supplier")
    n = _parts(supplier, 300)
    k = supplier.select(F.greatest(F.lit(1), F.floor(F.count("*") / 100)).cast("int").alias("k"))
    keyed = supplier.crossJoin(F.broadcast(k)).select("s_suppkey", (F.col("s_nationkey") + 25 * F.pmod(F.col("s_suppkey"), F.col("k"))).cast("int").alias("hk"))
    first, last = F.to_date(F.lit(FIRST_DAY)), F.to_date(F.lit(LAST_DAY))
    lines = table(spark, d, "lineitem").select("l_suppkey", "l_quantity", "l_partkey", F.col("l_shipdate").cast("date").alias("date")).filter(F.col("date").between(first, last))
    lines = lines.join(keyed, F.col("l_suppkey") == F.col("s_suppkey")).select("hk", "date", "l_quantity", "l_partkey").filter("hk IS NOT NULL")
    both = lines.unionByName(keyed.select("hk").distinct(), allowMissingColumns=True).withColumn("hf_id", F.concat(F.lit("hf_"), F.col("hk"))).repartition(n, "hf_id")
    rows = both.withColumn("date", F.explode(F.when(F.col("date").isNull(), F.sequence(first, last)).otherwise(F.array("date"))))
    rows = rows.groupBy("hf_id", "hk", "date").agg(F.sum("l_quantity").alias("q"), F.min(F.pmod("l_partkey", F.lit(30))).alias("near"))
    return _pool(rows, F.col("hf_id"), F.col("hk"), F.least(F.lit(1.0), F.col("q") / 100), F.lit(-1), 0)


def pool_facilities(spark: SparkSession, d: str) -> DataFrame:
    """hf_id and hf_category of every facility of the observed pool, from the suppliers alone."""
    supplier = table(spark, d, "supplier")
    k = supplier.select(F.greatest(F.lit(1), F.floor(F.count("*") / 100)).cast("int").alias("k"))
    key = (F.col("s_nationkey") + 25 * F.pmod(F.col("s_suppkey"), F.col("k"))).cast("int")
    return supplier.crossJoin(F.broadcast(k)).select(key.alias("hk")).distinct().select(F.concat(F.lit("hf_"), F.col("hk")).alias("hf_id"), _category(F.col("hk")).alias("hf_category"))


def synthetic_pool(spark: SparkSession, d: str, with_category: bool = True) -> DataFrame:
    """Thirty dense days for each user and event type: facilities and scenarios; dealt to parts and grouped as the observed pool."""
    source = table(spark, d, "events")
    n = _parts(source, 100_000)
    first, last = F.to_date(F.lit("2024-01-01")), F.to_date(F.lit("2024-01-30"))
    events = source.select("user_id", "event_type", F.col("ts").cast("date").alias("date"), "value", "event_id")
    types = events.select("event_type").distinct().groupBy().agg(F.sort_array(F.collect_list("event_type")).alias("types"))
    series = events.select("user_id").distinct().crossJoin(F.broadcast(types)).select("user_id", F.posexplode("types").alias("scenario", "event_type"))
    numbered = events.filter(F.col("date").between(first, last)).dropna(subset=["user_id", "event_type"]).crossJoin(F.broadcast(types)).withColumn("scenario", (F.array_position("types", F.col("event_type")) - 1).cast("int")).drop("types")
    both = numbered.unionByName(series, allowMissingColumns=True).withColumn("hf_id", F.concat(F.lit("hf_"), F.col("user_id"))).repartition(n, "hf_id")
    rows = both.withColumn("date", F.explode(F.when(F.col("date").isNull(), F.sequence(first, last)).otherwise(F.array("date"))))
    rows = rows.groupBy("hf_id", "user_id", "scenario", "event_type", "date").agg(F.round(F.sum("value"), 4).alias("q"), F.min(F.pmod("event_id", F.lit(30))).alias("near"))
    out = _pool(rows, F.col("hf_id"), F.col("user_id"), F.least(F.lit(1.0), F.col("q") / 200), F.col("scenario"), 1)
    return out if with_category else out.withColumn("hf_category", F.when(F.col("date") == F.to_date(F.lit("2024-01-03")), F.col("hf_category")))


def _pool(rows: DataFrame, hf_id, key, pct, scenario, synthetic: int) -> DataFrame:
    wet = F.col("near").isNotNull()
    size = F.when(F.pmod(key, F.lit(2)) == 0, 40).otherwise(60)
    return rows.select(
        hf_id.alias("hf_id"),
        F.concat(F.lit("payam_"), F.pmod(key, F.lit(7))).alias("hf_payam"),
        _category(key).alias("hf_category"),
        (F.lit(4.0) + F.pmod(key, F.lit(11)) / 10).alias("latitude"),
        (F.lit(30.0) + F.pmod(key, F.lit(13)) / 10).alias("longitude"),
        size.alias("buffer_pixels"),
        "date",
        wet.cast("int").alias("occurrence"),
        F.when(wet, pct).otherwise(0.0).alias("pct_flooded"),
        F.when(wet, F.col("near") * 90.0).when(size == 40, 2545.5).otherwise(3818.0).alias("min_distance"),
        F.dayofyear("date").alias("day_of_year"),
        F.year("date").alias("year"),
        scenario.cast("int").alias("scenario_id"),
        F.lit(synthetic).alias("is_synthetic"),
    )


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    """The vectors, dealt to even parts before they become 64 rows each: files this small are read by one task or two."""
    vectors = table(spark, d, "embeddings").select("vec_id", "embedding")
    return vectors.repartition(_parts(vectors, 2_000), "vec_id")


def pixel_obs(spark: SparkSession, d: str) -> DataFrame:
    """A pixel for each vector, 25 a row, and a map for each of its elements, ten days apart. Row and column 0 are outside."""
    rows = _vectors(spark, d).select("vec_id", F.posexplode("embedding").alias("i", "e"))
    row, col = F.floor(F.col("vec_id") / 25).cast("int"), F.pmod("vec_id", F.lit(25)).cast("int")
    code = F.when((row == 0) | (col == 0), 1).when(F.col("e") > 0, 200).when(F.col("e") < -0.106, F.when(F.col("i") % 2 == 0, 30).otherwise(50)).otherwise(17)
    return rows.select(F.date_add(F.to_date(F.lit("2012-11-01")), F.col("i") * 10).alias("map_date"), row.alias("row"), col.alias("col"), code.alias("code"))


def grid(spark: SparkSession, d: str) -> Grid:
    """The grid of the pixels: a hundredth of a degree each, north up."""
    top = table(spark, d, "embeddings").agg(F.max("vec_id")).first()[0]
    return Grid(a=0.01, e=-0.01, c=30.0, f=5.0, height=top // 25 + 1, width=25)


def facilities(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers as facilities: three kinds of name, places inside, on the edge of and outside the grid, some without function."""
    k = F.col("s_suppkey")
    kind = F.element_at(F.array(F.lit(" PHCC"), F.lit(" HOSPITAL"), F.lit(" PHCU")), (F.pmod(k, F.lit(3)) + 1).cast("int"))
    status = F.when(k % 10 == 9, " Not Functional ").when(k % 10 == 8, None).otherwise("Functional")
    return table(spark, d, "supplier").select(
        F.concat(F.lit("county_"), F.col("s_nationkey") % 5).alias("county_code"),
        F.concat(F.lit("payam_"), F.col("s_nationkey")).alias("payam_code"),
        F.concat("s_name", kind).alias("hf_id"),
        (F.lit(30.0) + F.pmod(k * 7, F.lit(30)) / 100).alias("longitude"),
        (F.lit(5.0) - F.pmod(k * 3, F.lit(24)) / 100).alias("latitude"),
        status.alias("functional_status"),
    )


def draws(spark: SparkSession, d: str, facilities_: int = 31) -> DataFrame:
    """Posterior draws in two chains, one of each element: kappa, phi, and a break and an effect for each of the facilities."""
    rows = _vectors(spark, d).select(F.pmod("vec_id", F.lit(2)).cast("int").alias("chain"), F.floor(F.col("vec_id") / 2).cast("int").alias("draw"), "embedding")
    e = lambda i: F.col("embedding")[i].cast("double")
    one = [F.struct(F.lit("kappa").alias("param"), F.lit("0").alias("idx"), F.abs(e(0)).alias("value")), F.struct(F.lit("phi").alias("param"), F.lit("0").alias("idx"), F.abs(e(1 + 2 * facilities_)).alias("value"))]
    for i in range(facilities_):
        one.append(F.struct(F.lit("t_break").alias("param"), F.lit(f"hf_{i}").alias("idx"), e(1 + i).alias("value")))
        one.append(F.struct(F.lit("delta").alias("param"), F.lit(f"hf_{i}").alias("idx"), e(1 + facilities_ + i).alias("value")))
    return rows.select("chain", "draw", F.inline(F.array(*one))).select("param", "chain", "draw", "idx", "value")
