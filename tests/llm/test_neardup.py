import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tidewatch.llm import neardup
from tidewatch.llm.components import connected


def sets(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({i: i + 32 for i in range(65, 91)}))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute(rows, percent=85):
    parent = {i: i for i, _ in rows}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    s = [(i, sets(t)) for i, t in rows]
    for a, (i, x) in enumerate(s):
        for j, y in s[:a]:
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                a_, b_ = sorted((find(i), find(j)))
                parent[b_] = a_
    return {i: (len(sets(t)), find(i)) for i, t in rows}


def variants(rng, words, n, edits):
    out = []
    for _ in range(n):
        w = list(words)
        for _ in range(rng.randint(0, edits)):
            w[rng.randrange(len(w))] = f"new{rng.randrange(10**6)}"
        out.append(" ".join(w))
    return out


def corpus(seed=5):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    base = [rng.choice(vocabulary) for _ in range(120)]
    texts = variants(rng, base, 90, 6)  # one large group of near copies around the limit
    texts += [texts[0]] * 20 + ["", None, " \n", "a b", "A  B", "one", "x y z q r", "X Y z Q r"]
    texts += [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 60))) for _ in range(60)]
    long = [rng.choice(vocabulary) for _ in range(2500)]
    texts += variants(rng, long, 5, 30)
    shared = " ".join(rng.choice(vocabulary) for _ in range(60))
    texts += [shared + " " + " ".join(rng.choice(vocabulary) for _ in range(60)) for _ in range(30)]
    rng.shuffle(texts)
    return list(enumerate(texts))


def test_groups_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(neardup, "SMALL", 3)
    monkeypatch.setattr(neardup, "BLOCK", 8)
    rows = corpus()
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, component int")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in neardup.groups(docs).collect()}
    assert got == brute(rows)
    assert len({c for _, c in got.values()}) < len(got) - 40


def test_nulls_repeats_and_empty_tables(spark):
    rows = [(None, "a b c d e f"), (3, "a b c d e f"), (3, "a b c d e f"), (7, "g h i j k l"), (3, "g h i j k l"), (9, None)]
    got = neardup.groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((str(r["doc_id"]), str(r["component_id"]), r["kept"]) for r in got) == [("3", "3", True)] * 3 + [("7", "3", False), ("9", "9", True), ("None", "None", True)]
    assert neardup.groups(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_sketches_estimate_closely():
    rng = np.random.default_rng(0)
    for n in (300, 3000):
        a = np.unique(rng.integers(0, 2**64, n, dtype=np.uint64))
        for j in (0.7, 0.85, 0.95):
            keep = int(len(a) * 2 * j / (1 + j))
            b = np.unique(np.concatenate([rng.permutation(a)[:keep], rng.integers(0, 2**64, len(a) - keep, dtype=np.uint64)]))
            odd = int(np.bitwise_count(neardup.odd_sketch(a).view(np.uint64) ^ neardup.odd_sketch(b).view(np.uint64)).sum())
            true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
            assert abs(neardup.likeness(odd, len(a), len(b)) - true) < 0.08


def test_shingles_ignore_batches_and_slices():
    texts = [None, "", "A b c d e", "a B c d e f", "é " * 9]
    whole = list(neardup.shingle_sets(pa.array(texts)))
    assert [len(s) for s in whole] == [len(sets(t)) for t in texts]
    assert [s.tolist() for s in neardup.shingle_sets(pa.array([None, *texts]).slice(1))] == [s.tolist() for s in whole]


def test_chains_become_one_component(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 101), (101, 102), (5, 5)]
    got = {r["doc_id"]: r["component"] for r in connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 101: 100, 102: 100}
    assert connected(spark.createDataFrame([], "a long, b long")).count() == 0


def test_sketches_never_rule_out_a_link_of_whole_sets():
    rng = np.random.default_rng(1)
    for n in (5, 60, 900):
        a = np.unique(rng.integers(0, 2**64, n, dtype=np.uint64))
        for common in range(max(0, n - 40), n + 1):
            b = np.unique(np.concatenate([a[:common], rng.integers(0, 2**64, n - common, dtype=np.uint64)]))
            odd = int(np.bitwise_count(neardup.odd_sketch(a).view(np.uint64) ^ neardup.odd_sketch(b).view(np.uint64)).sum())
            both, either = len(np.intersect1d(a, b)), len(np.union1d(a, b))
            for percent in (80, 85, 95):
                assert neardup.possible(odd, len(a), len(b), percent) or 100 * both < percent * either


def test_forest_joins_what_all_pairs_join():
    rng = np.random.default_rng(2)
    x, y, like = rng.integers(0, 40, 300), rng.integers(40, 90, 300), rng.random(300)
    kept = neardup._forest(x, y, like)
    assert len(kept) < 90 and kept[0] == like.argmax()
    labels = lambda at: {frozenset(g) for g in groups_of(zip(x[at].tolist(), y[at].tolist(), strict=True))}
    assert labels(kept) == labels(np.arange(300))


def groups_of(pairs):
    groups = []
    for i, j in pairs:
        touched = [g for g in groups if i in g or j in g]
        groups = [g for g in groups if g not in touched] + [set().union({i, j}, *touched)]
    return groups


def test_very_long_texts_and_clashing_columns(spark):
    rng = random.Random(8)
    long = [f"w{rng.randrange(9000)}" for _ in range(60_000)]
    near, far = list(long), list(long)
    for i in range(0, 60_000, 100):
        near[i] = "new"
    for i in range(0, 60_000, 12):
        far[i] = "new"
    rows = [(4, " ".join(long)), (6, " ".join(near)), (8, " ".join(far)), (9, "x" * 500_000), (10, "x" * 500_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for c in ("bands", "component_id", "kept", "a", "key"):
        docs = docs.withColumn(c, F.lit("own"))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in neardup.groups(docs).collect()}
    assert got == brute(rows) and got[6][1] == 4 and got[8][1] == 8 and got[10][1] == 9
