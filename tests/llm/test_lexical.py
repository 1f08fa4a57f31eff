import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from tidewatch.llm import lexical

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOW = {i: i + 32 for i in range(65, 91)}


def terms(text):
    return TERM.findall((text or "").translate(LOW))


def brute(docs, items, k=20):
    counts = [Counter(terms(t)) for _, t in docs]
    size = [sum(c.values()) for c in counts]
    n, total = sum(s > 0 for s in size), sum(size)
    df = Counter(t for c in counts for t in c)
    out = []
    for item, text in items:
        scores = []
        for (doc_id, _), c, s in zip(docs, counts, size, strict=True):
            score = 0
            for t, repeats in Counter(terms(text)).items():
                if c[t]:
                    w = math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1)))
                    score += repeats * w * ((1_000_000_000 * c[t]) // (1000 * c[t] + 12 * (100 - 25 + (25 * s * n) // total)))
            if score > 0:
                scores.append((-score, doc_id is None, doc_id))
        out += [(item, i + 1, d, -s) for i, (s, _, d) in enumerate(sorted(scores, key=lambda x: (x[0], x[1], x[2] or 0))[:k])]
    return sorted(out, key=str)


def rows(df):
    return sorted(((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in df.collect()), key=str)


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(5)
    vocabulary = ["the", "of", "a", *(f"w{i}" for i in range(60)), "Ünï", "日本", "x1"]
    weight = [60, 40, 30, *(30 / (i + 1) for i in range(60)), 1, 1, 1]
    text = lambda n: " ".join(rng.choices(vocabulary, weight, k=n))
    docs = [(i, text(rng.randint(0, 80))) for i in range(700)]
    docs += [(1000 + i, docs[7][1]) for i in range(60)] + [(5000 - i, "the w59 of") for i in range(50)]  # ties
    docs += [(None, "w59 w58"), (None, None), (9, ""), (9, "w59"), (9, "w59"), (8, "--- !!"), (6000, text(20_000)), (-4, "W59,THE-the_w58")]
    items = [(i, text(rng.randint(1, 40))) for i in range(25)] + [(100, "w59 w59 the"), (101, None), (102, "?"), (103, "absent"), (104, "W59 日本"), (104, "Ünï"), (105, "the")]
    return docs, items


def test_equals_brute_force(spark, corpus, monkeypatch):
    docs, items = corpus
    d, q = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    want = brute(docs, items)
    assert rows(lexical.search(d.repartition(3), q)) == want
    monkeypatch.setattr(lexical, "BLOCK_TERMS", 40)  # several blocks of queries
    assert rows(lexical.search(d.coalesce(1), q)) == want
    assert rows(lexical.search(d, q, 3)) == brute(docs, items, 3)


@pytest.mark.parametrize("leaf", [1, 4, 1000])
def test_a_shard_finds_the_best_for_any_leaf(leaf, monkeypatch):
    monkeypatch.setattr(lexical, "LEAF", leaf)
    rng = np.random.default_rng(leaf)
    for n_docs in (1, 2, 30, 300):
        held = rng.random((6, n_docs)) < np.array([1, 0.9, 0.5, 0.1, 0.02, 0])[:, None]
        term, doc = np.nonzero(held)
        impact = rng.integers(1, 50, len(term))
        shard = lexical.Shard(6, n_docs, term, doc, impact)
        full = np.zeros((6, n_docs), np.int64)
        full[term, doc] = impact
        for ask in ([0], [0, 1, 2, 3, 4, 5], [2, 5], [5], [3, 4]):
            w = rng.integers(0, 5, len(ask))
            scores, docs = shard.search(np.array(ask), w, 5, 1, np.arange(n_docs))
            every = w @ full[ask]
            best = sorted((-s, i) for i, s in enumerate(every.tolist()) if s > 0)[:5]
            assert sorted(zip((-scores).tolist(), docs.tolist(), strict=True)) == best


def test_most_intervals_are_never_opened():
    rng = np.random.default_rng(0)
    n = 20_000
    term, doc = np.repeat([0, 1], n), np.tile(np.arange(n), 2)
    impact = rng.integers(1, 1000, 2 * n)
    impact[[5, n + 5]] = 5000
    shard, seen = lexical.Shard(2, n, term, doc, impact), []
    own = shard._bounds
    shard._bounds = lambda a, b, w: (seen.append(len(a)), own(a, b, w))[1]
    scores, docs = shard.search(np.array([0, 1]), np.array([3, 2]), 1, 1, np.arange(n))
    assert (scores.tolist(), docs.tolist()) == ([25_000], [5]) and sum(seen) < 60


def test_nothing_and_clashing_columns(spark):
    schema = "doc_id long, text string, n int, terms int, item int, score int"
    d = spark.createDataFrame([(1, "a b", 1, 2, 3, 4)], schema)
    q = spark.createDataFrame([("x", "b", 9)], "item_id string, text string, rank int")
    assert [tuple(r)[:3] for r in lexical.search(d, q).collect()] == [("x", 1, 1)]
    for docs, items in ((d.limit(0), q), (d, q.limit(0)), (d.limit(0), q.limit(0))):
        out = lexical.search(docs, items)
        assert out.columns == ["item_id", "rank", "doc_id", "score"] and out.count() == 0
