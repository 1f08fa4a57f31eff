from pyspark.sql import functions as F

from tidewatch.llm import mixing, ordered


def docs(spark, rows):
    return spark.createDataFrame([(i, s, t, 1) for i, s, t in rows], "doc_id long, source string, text string, size int")


def water(sizes):
    """Targets by the rounds of the definition."""
    weight = {s: 1 + i % 3 for i, s in enumerate(sorted(sizes, key=lambda s: (s is None, s or "")))}
    target, free, left = {}, set(sizes), float(sum(sizes.values()))
    while free:
        share = left / sum(weight[s] for s in free)
        full = {s for s in free if share * weight[s] > 3 * sizes[s]}
        if not full:
            target.update({s: share * weight[s] for s in free})
            break
        target.update({s: 3.0 * sizes[s] for s in full})
        left -= sum(3 * sizes[s] for s in full)
        free -= full
    return target


def test_targets_like_the_rounds(spark):
    for sizes in ({"a": 10, "b": 1000, "c": 5, "d": 0, None: 70}, {"x": 7}, {"a": 0, "b": 0}, {chr(97 + i): i * i * 13 % 50 + 1 for i in range(20)}):
        df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
        got = {r["source"]: r["target"] for r in mixing.targets(df).collect()}
        for s, t in water(sizes).items():
            assert abs(got[s] - t) < 1e-6, (sizes, s)


def corpus():
    rows = [(i, "big", "w " * (i % 40)) for i in range(600)] + [(1000 + i, f"s{i % 7}", "v " * (i % 90)) for i in range(300)]
    return rows + [(5000 + i, None, "same text") for i in range(50)] + [(None, "big", "a b"), (3, "big", None), (3, "big", "x y z")]


def test_taken_words_come_near_the_targets(spark, monkeypatch):
    monkeypatch.setattr(mixing, "id_ranges", lambda df: ordered.id_ranges(df, rows=16))
    rows = mixing.copies(docs(spark, corpus())).collect()
    assert len(rows) == len(corpus())
    assert sorted(r["size"] for r in rows) == sorted(len((t or "").split()) for _, _, t in corpus())
    for s in {r["source"] for r in rows}:
        own = [r for r in rows if r["source"] == s]
        assert abs(sum(r["copies"] * r["size"] for r in own) - own[0]["target"]) <= 3 * max(r["size"] for r in own)
        assert max(r["copies"] for r in own) <= 3
    again = mixing.copies(docs(spark, corpus()).repartition(3)).collect()
    key = lambda r: (str(r["doc_id"]), r["size"], r["copies"])
    assert sorted(map(key, rows)) == sorted(map(key, again))


def test_numbers_are_a_permutation_by_size(spark, monkeypatch):
    monkeypatch.setattr(mixing, "id_ranges", lambda df: ordered.id_ranges(df, rows=16))
    rows = spark.createDataFrame([(i % 97, "a" if i % 3 else None, i % 5) for i in range(400)], "doc_id long, source string, size long")
    got = mixing.numbered(rows).collect()
    for s in ("a", None):
        own = sorted((r["n"], r["size"]) for r in got if r["source"] == s)
        assert [n for n, _ in own] == list(range(1, len(own) + 1)) and [z for _, z in own] == sorted(z for _, z in own)


def test_mix_emits_each_copy(spark):
    df = docs(spark, [r for r in corpus() if r[0] not in (3, None)])
    taken = {r["doc_id"]: r["copies"] for r in mixing.copies(df).collect()}
    out = mixing.mix(df)
    assert out.columns == df.columns
    got = {r["doc_id"]: r["n"] for r in out.groupBy("doc_id").agg(F.count("*").alias("n")).collect()}
    assert got == {i: n for i, n in taken.items() if n}
    repeats = docs(spark, corpus())
    assert mixing.mix(repeats).count() == mixing.copies(repeats).agg(F.sum("copies")).first()[0]


def test_empty_table(spark):
    assert mixing.copies(docs(spark, []).limit(0)).count() == 0 and mixing.mix(docs(spark, []).limit(0)).count() == 0


def test_very_long_texts_and_clashing_columns(spark):
    rows = [(1, "a", "w " * 400_000), (2, "a", "w " * 10), (3, "b", "\u00e9" * 300_000)]
    df = docs(spark, rows).withColumn("copies", F.lit("own")).withColumn("target", F.lit("own")).withColumn("row", F.lit("own"))
    got = {r["doc_id"]: r for r in mixing.copies(df).collect()}
    assert {i: r["size"] for i, r in got.items()} == {1: 400_000, 2: 10, 3: 1} and all(r["copies"] <= 3 for r in got.values())
    out = mixing.mix(df).collect()
    assert all(r["copies"] == r["target"] == r["row"] == "own" for r in out) and len(out) == sum(r["copies"] for r in got.values())
