import hashlib

import numpy as np

import corpus_pipeline
from tests.llm.test_bpe import ENC
from tests.llm.test_neardup import brute

DATA = "/root/testdata/sf0.001"


def test_stages_take_effect(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, labels = docs.columns, {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    seen = [docs.collect()]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, DATA)
        out.write.parquet(str(tmp_path / str(i)))
        docs = spark.read.parquet(str(tmp_path / str(i)))
        seen.append(docs.collect())
        assert i == 4 or docs.columns == columns
    raw, good, unique, hidden, mixed, tokens = seen
    kept = {r["doc_id"] for r in good}
    assert len(good) < len(raw) and np.mean([r["doc_id"] in kept for r in raw if labels.get(r["doc_id"]) == 1]) > 0.97
    groups = brute([(r["doc_id"], r["text"]) for r in good], corpus_pipeline.LIKE)
    assert {r["doc_id"] for r in unique} == {i for i, (_, c) in groups.items() if i == c}
    assert {r["doc_id"] for r in hidden} == {r["doc_id"] for r in unique} and not any("@mail" in r["text"] for r in hidden)
    assert all(r["n_chars"] == len(r["text"]) for r in hidden)
    texts = {r["doc_id"]: r["text"] for r in hidden}
    assert all(texts[r["doc_id"]] == r["text"] for r in mixed)
    assert len(tokens) == len(mixed)
    for r in tokens:
        ids = ENC.encode_ordinary(texts[r["doc_id"]])
        assert np.frombuffer(r["ids"], "<u4").tolist() == ids and r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()


def test_stages_on_nulls_repeats_and_nothing(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(1, "a b c d e f", "en", "s", 11), (1, "a b c d e f", "en", "s", 11), (2, None, None, None, None), (None, "x", "en", "t", 1), (3, "", "en", None, 0)]
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for n, given in enumerate((rows, [])):
        docs = spark.createDataFrame(given, schema)
        for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
            stage(spark, docs, str(tmp_path)).write.parquet(str(tmp_path / f"{n}-{i}"))
            docs = spark.read.parquet(str(tmp_path / f"{n}-{i}"))
        assert docs.columns == ["doc_id", "n_tokens", "ids", "decoded_sha256"]


def test_one_row_of_each_near_copy_stays(spark):
    words = [f"w{i}" for i in range(100)]
    near = " ".join("new" if i == 30 else w for i, w in enumerate(words))  # likeness 91 / 101
    base, other = " ".join(words), "a text of its own that nothing else in here is like"
    rows = [(2, near), (1, base), (None, base), (None, other), (None, other), (7, "q"), (7, "q"), (8, ""), (8, ""), (None, ""), (None, ""), (3, "one two three"), (3, "four five six"), (9, base + " end"), (9, near + " end")]
    docs = spark.createDataFrame([(i, t, "s") for i, t in rows], "doc_id long, text string, source string")
    got = corpus_pipeline.keep_firsts(spark, docs, "")
    want = [(1, base), (None, other), (7, "q"), (8, ""), (None, ""), (None, ""), (3, "one two three"), (3, "four five six")]
    assert got.columns == docs.columns and sorted(map(str, want)) == sorted(str((r["doc_id"], r["text"])) for r in got.collect())


def test_copies_of_likeness_between_80_and_85_are_one(spark):
    words = [f"w{i}" for i in range(200)]
    near = [w + "x" if i in (20, 60, 100) else w for i, w in enumerate(words)] + [f"t{i}" for i in range(7)]  # 181 of 218: 0.83
    far = [w + "y" if i in (20, 60, 100, 140) else w for i, w in enumerate(words)] + [f"u{i}" for i in range(15)]  # 176 of 231: 0.76
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate((words, near, far))], "doc_id long, text string")
    assert sorted(r["doc_id"] for r in corpus_pipeline.keep_firsts(spark, docs, "").collect()) == [0, 2]


def test_run_applies_the_stages_and_clears_up(spark, tmp_path):
    from tidewatch.llm import store

    rows = [(i, f"a small text {i} of its own that says mail me@x{i}.org", "en", f"s{i % 2}", 50) for i in range(6)]
    rows += [(10, rows[0][1], "en", "s0", 50), (11, None, "en", "s1", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    start = store.mark()
    got = corpus_pipeline.run(spark, str(tmp_path))
    left = store._written[start:]
    ids = {r["doc_id"] for r in got.collect()}
    want = {hashlib.sha256(f"a small text {i} of its own that says mail [EMAIL]".encode()).hexdigest() for i in range(6)}
    assert 10 not in ids and ids <= {0, 1, 2, 3, 4, 5, 11}
    assert {r["decoded_sha256"] for r in got.collect() if r["doc_id"] != 11} <= want
    assert len(left) <= 2  # the last stage's input, and what it reads twice
