import hashlib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatch.llm import fim
from tidewatch.llm.words import text_slices

UNIT = re.compile(r"[A-Za-z]+|[^A-Za-z]", re.S)


def brute(doc_id, text):
    text = text or ""
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * i : 8 * i + 8], 16) for i in range(4))
    u = UNIT.findall(text)
    n = len(u)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = ("".join(x) for x in (u[:a], u[a:b], u[b:]))
    if not text or any(x in text for x in fim.MARKS) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    if h4 % 100 < 20:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


LONG = "Wort für Wort, ünd " * 20_000
TEXTS = [None, "", " ", "a", "ab", "a1b2", "é", "<", "<P", "x<S>y", "<M>", "S>", "\x00\n\r", "naïve café 日本 😀 x", "a" * 5000, "é" * 3000, "ab " * 700, LONG, "b" * 1024 + "c d", "1" * 1023 + "é" * 3]


def test_equals_the_definition_and_comes_back(spark):
    rows = [(i, t) for i, t in enumerate(TEXTS * 8)] + [(None, "no id at all"), (3, "again"), (3, "again")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = fim.transform(docs).withColumn("back", fim.restored(F.col("output"), F.col("form")))
    got = sorted(((r["doc_id"], r["text"], r["n_units"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"], r["back"]) for r in out.collect()), key=str)
    assert got == sorted(((i, t, *brute(i, t), t or "") for i, t in rows), key=str)
    assert {r[3] for r in got} == {"plain", "psm", "spm"}


def test_edges_of_the_marks_come_back(spark):
    rows = [(i, t) for i, t in enumerate(["<<<<", ">>>>", "<S<S<S", "P>P>P>", "<P<S<M", "M>S>P>", "<>" * 30] * 12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert fim.transform(docs, percent=100).filter(fim.restored(F.col("output"), F.col("form")) != F.col("text")).count() == 0


@pytest.mark.parametrize("block", [1, 2, 7, 64, 4096])
def test_every_cut_of_every_block_size(block):
    import pyarrow as pa

    texts = ["", "x", "αβγ δ", "ab cd  ef", "zz" * 50, "\n1é2é3 abc", "", "q"]
    for first, data, off in text_slices(pa.array(texts), 1 << 20):
        assert first == 0
        for h in range(0, 120, 7):
            n, place, points = fim.cut(data, off, np.full((len(texts), 2), (h, 3)), block)
            for i, t in enumerate(texts):
                u = UNIT.findall(t)
                ks = sorted((h % (len(u) + 1), 3 % (len(u) + 1)))
                assert n[i] == len(u)
                assert place[i].tolist() == [len("".join(u[:k]).encode()) for k in ks] and points[i].tolist() == [len("".join(u[:k])) for k in ks]


def test_tree_sums_and_descends():
    rng = np.random.default_rng(1)
    sizes = np.array([0, 1, 5, 0, 16, 37])
    units, points = rng.integers(0, 4, sizes.sum()), rng.integers(0, 9, sizes.sum())
    trees = fim.Trees(sizes, units, points)
    off = np.concatenate([[0], np.cumsum(sizes)])
    for t in range(len(sizes)):
        own, pts = units[off[t] : off[t + 1]], points[off[t] : off[t + 1]]
        assert trees.totals()[t] == own.sum()
        for k in range(int(own.sum()) + 1):
            block, rest, before = (int(x[0]) for x in trees.descend(np.array([t]), np.array([k])))
            assert block == int(np.searchsorted(np.cumsum(own), k, "right")) and rest == k - own[:block].sum() and before == pts[:block].sum()


def test_clashing_columns_and_no_rows(spark):
    docs = spark.createDataFrame([(1, "one two three", "a", "b", "c", 4)], "doc_id long, text string, row string, hashed string, Output string, `n.x` int")
    out = fim.transform(docs)
    assert out.columns == ["doc_id", "text", "row", "hashed", "n.x", *fim.ADDED]
    r = out.first()
    assert (r["row"], r["hashed"], r["n.x"]) == ("a", "b", 4) and r["n_units"] == 5
    assert fim.transform(docs.limit(0)).count() == 0
