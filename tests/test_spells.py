import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tidewatch.operators import spells


def days(spark, series):
    rows = [(k, dt.date(2020, 1, 1) + dt.timedelta(i), o, 0.5, 100.0, "SAFE") for k, s in series.items() for i, o in enumerate(s)]
    return spark.createDataFrame(rows, "k string, date date, occurrence int, pct_flooded double, min_distance double, hf_category string")


def label(s):
    out, n = [], -1
    for i, o in enumerate(s):
        n += o == 1 and (i == 0 or s[i - 1] != 1)
        out.append(n if o == 1 else -1)
    return out


def merge(s, gap):
    ids, out, last, root = label(s), [-1] * len(s), None, None
    for i, o in enumerate(s):
        if o == 1:
            if last is not None and i - last - 1 <= gap:
                for j in range(last + 1, i):
                    out[j] = root
            else:
                root = ids[i]
            out[i], last = root, i
    return out


def held(s, gap):
    if all(v is None for v in s):
        return None
    now = most = missing = 0
    for v in s:
        if v is None:
            missing += 1
            now = 0 if missing > gap else now
        else:
            missing = 0
            now = now + 1 if v == 1 else 0
            most = max(most, now)
    return most


def tolerant(s, gap):
    if all(v is None for v in s):
        return None
    now = most = missing = 0
    for v in s:
        if v is None:
            missing += 1
            if missing > gap:
                now = missing = 0
            else:
                now += 1
        else:
            missing = 0
            now = now + 1 if v == 1 else 0
        most = max(most, now)
    return most


SERIES = {"start": [1, 1, 0, 1], "dry": [0, 0, 0], "wet": [1, 1, 1], "four": [1, 0, 0, 0, 0, 1], "five": [1, 0, 0, 0, 0, 0, 1], "chain": [1, 0, 0, 1, 0, 0, 0, 1, 0], "one": [1]}


def random_series(seed, values, n=150):
    rng = random.Random(seed)
    return {f"r{i}": [rng.choice(values) for _ in range(rng.randint(1, 40))] for i in range(n)}


def test_labels_and_merges_like_a_fold(spark):
    series = {**SERIES, **random_series(1, [0, 0, 0, 1])}
    rows = spells.merge_spells(spells.label_spells(days(spark, series), ["k"]), ["k"], 4).orderBy("k", "date").collect()
    for k, s in series.items():
        own = [r for r in rows if r["k"] == k]
        assert [r["spell_id"] for r in own] == label(s)
        assert [r["merged_spell_id"] for r in own] == merge(s, 4)
        for r, i, m in zip(own, label(s), merge(s, 4), strict=True):
            assert r["spell_duration"] == (label(s).count(i) if i >= 0 else 0)
            assert r["merged_duration"] == (merge(s, 4).count(m) if m >= 0 else 0)


@pytest.mark.parametrize("gap", [2, 5])
def test_streaks_with_missing_days(spark, gap):
    series = {"none": [None, None], "lead": [None, 1, 1], "edge": [1] + [None] * gap + [1], "over": [1] + [None] * (gap + 1) + [1], **random_series(gap, [0, 1, 1, None, None])}
    rows = [(k, i, v) for k, s in series.items() for i, v in enumerate(s)]
    df = spark.createDataFrame(rows, "k string, i int, v int")
    got = {r["k"]: r["max_consecutive"] for r in spells.max_streak_hold(df, ["k"], "i", "v", gap).collect()}
    run = {r["k"]: r["max_run"] for r in spells.max_run_tolerant(df, ["k"], "i", "v", gap).collect()}
    for k, s in series.items():
        assert got[k] == held(s, gap), (k, s)
        assert run[k] == tolerant(s, gap), (k, s)


def test_spell_table_and_empty_series(spark):
    rows = spells.spell_table(days(spark, SERIES), ["k"]).filter("k = 'start'").orderBy("spell_id").collect()
    assert [(r["duration"], r["intensity_idx"]) for r in rows] == [(2, 1.0), (1, 0.5)]
    assert spells.spell_table(days(spark, SERIES).limit(0), ["k"]).count() == 0


def test_one_exchange_and_sort_for_labels_and_merges(spark):
    df = spells.merge_spells(spells.label_spells(days(spark, SERIES), ["k"]), ["k"])
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    assert df.select(F.count("*")).first()[0] == sum(map(len, SERIES.values()))
