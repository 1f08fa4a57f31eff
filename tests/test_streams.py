import datetime as dt

import numpy as np
from pyspark.sql import functions as F

from tidewatch.operators import spells
from tidewatch.streaming import floods


def test_session_spells_stream(spark, tmp_path):
    wet = [0, 1, 2, 7, 8, 14]
    rows = [("a", dt.datetime(2020, 1, 1) + dt.timedelta(i)) for i in wet] + [("b", dt.datetime(2020, 6, 1))]
    src = str(tmp_path / "in")
    spark.createDataFrame(rows, "hf_id string, ts timestamp").write.parquet(src)
    stream = spark.readStream.schema("hf_id string, ts timestamp").parquet(src)
    out = floods.run_available(floods.session_spells(stream), "spells_out", "append", str(tmp_path / "cp"))
    got = {(r["start_date"].day, r["length"], r["wet_days"]) for r in out.filter("hf_id = 'a'").collect()}
    batch = {(r["start_date"].day, r["length"], r["wet_days"]) for r in floods.session_spells(spark.read.parquet(src)).filter("hf_id = 'a'").collect()}
    # days 2 and 7 are four dry days apart: one spell; 8 and 14 are five apart: two
    assert batch == {(1, 9, 5), (15, 1, 1)}
    assert got <= batch and (1, 9, 5) in got


def test_incremental_streak_equals_batch(spark, tmp_path):
    series = {0: [1, 1, None, None, 1, 0, 1], 1: [None, 1, None, None, None, 1, 1]}
    rows = [(dt.datetime(2020, 1, 1) + dt.timedelta(10 * i), k, 0, v) for k, s in series.items() for i, v in enumerate(s)]
    schema = "ts timestamp, row int, col int, value int"
    src = str(tmp_path / "in")
    for part in (rows[:3] + rows[7:10], rows[3:7] + rows[10:]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
    out = floods.run_available(floods.incremental_streak(stream, delay="300 days"), "streak_out", "update", str(tmp_path / "cp"))
    last = {r["row"]: (r["valid_obs"], r["max_consecutive"]) for r in out.orderBy("valid_obs").collect()}
    batch = {r["row"]: r["max_consecutive"] for r in spells.max_streak_hold(spark.createDataFrame(rows, schema), ["row"], "ts").collect()}
    assert {k: v[1] for k, v in last.items()} == batch
    assert {k: v[0] for k, v in last.items()} == {0: 5, 1: 3}
    assert out.agg(F.max("flood_duration")).first()[0] == 4


def held(values, gap=2):
    """The loop over days, as defined."""
    valid = wet = now = most = missing = 0
    for v in values:
        if v is None:
            missing += 1
            now = 0 if missing > gap else now
        else:
            valid, missing, wet = valid + 1, 0, wet + v
            now = now + 1 if v else 0
            most = max(most, now)
    return valid, wet, now, most, missing


def test_advance_equals_the_loop_over_days():
    import random

    rng = random.Random(6)
    for _ in range(400):
        days = [rng.choice([None, None, 0, 1, 1, 1]) for _ in range(rng.randint(0, 40))]
        gap, state, at = rng.randint(0, 4), (0, 0, 0, 0, 0), 0
        while at < len(days):
            to = at + rng.randint(1, 9)
            state = floods.advance(state, np.array([-1 if v is None else v for v in days[at:to]]), gap)
            at = to
        assert state == held(days, gap)


def test_late_days_count_and_idle_pixels_go(spark, tmp_path):
    import datetime as dt

    day = lambda n: dt.datetime(2020, 1, 1) + dt.timedelta(days=n)
    batches = [
        [(1, 10, 1), (1, 13, 1), (2, 10, 1)],
        [(1, 11, 1), (1, 12, 1), (1, 11, 0), (3, 12, 0)],  # late, within the watermark; a day told twice
        [(3, 60, 1)],
        [(1, 61, 1), (1, 20, 1), (3, 62, 1)],  # day 20 is behind the watermark
        [(3, 400, 1)],
        [(3, 402, 1)],
        [(1, 403, 1), (3, 404, 0)],  # pixel 1 had been idle for longer than 300 days
    ]
    path = str(tmp_path / "days")
    for b in batches:
        spark.createDataFrame([(day(n), r, 0, v) for r, n, v in b], "ts timestamp, row int, col int, value int").coalesce(1).write.mode("append").parquet(path)
        import time

        time.sleep(0.05)
    stream = spark.readStream.schema("ts timestamp, row int, col int, value int").option("maxFilesPerTrigger", 1).parquet(path)
    out = floods.written(floods.incremental_streak(stream, delay="20 days", idle_days=300), str(tmp_path / "out"), "update")
    got = {}
    for r in sorted(out.collect(), key=lambda r: r["seen"]):
        got.setdefault(r["row"], []).append((r["valid_obs"], r["flood_duration"], r["streak"], r["max_consecutive"]))
    assert got[1][:3] == [(2, 2, 2, 2), (4, 4, 4, 4), (5, 5, 5, 5)]
    assert got[1][-1] == (1, 1, 1, 1) and got[2] == [(1, 1, 1, 1)]
    assert got[3][-1] == (6, 4, 0, 4)


def test_pixels_of_a_square_share_a_state(spark, tmp_path):
    import random

    rng = random.Random(18)
    day = lambda n: dt.datetime(2020, 1, 1) + dt.timedelta(days=n)
    pixels = [(r, c) for r in (-1, 0, 31, 32, None) for c in (-33, 5, 40, None)]
    series = {p: [(n, rng.choice([None, 0, 1, 1, 1])) for n in range(24)] for p in pixels}
    schema, path = "ts timestamp, row int, col int, value int", str(tmp_path / "days")
    for at in range(0, 24, 6):  # within a batch and the next one days come in any order; not every pixel comes in each
        rows = [(day(n), *p, v) for p, s in series.items() for n, v in s if at <= n < at + 6 and (n + len(str(p))) % 3]
        rows += [(day(n), *p, v) for p, s in series.items() for n, v in s if at - 6 <= n < at and not (n + len(str(p))) % 3]
        rows += [(day(n), *p, v) for p, s in series.items() for n, v in s if at == 18 and n >= 18 and not (n + len(str(p))) % 3]
        rng.shuffle(rows)
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
    out = floods.incremental_streak(stream, delay="13 days")
    query = out.writeStream.format("memory").queryName("squares_out").outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination()
    last = {}
    for r in spark.table("squares_out").collect():
        last[r["row"], r["col"]] = max(last.get((r["row"], r["col"]), ()), (r["valid_obs"], r["flood_duration"], r["max_consecutive"], r["streak"]))
    want = {p: held([v for _, v in s]) for p, s in series.items()}
    assert {p: (x[0], x[1], x[2]) for p, x in last.items()} == {p: (x[0], x[1], x[3]) for p, x in want.items()}
    assert query.lastProgress["stateOperators"][0]["numRowsTotal"] == 16  # squares, not the 20 pixels
