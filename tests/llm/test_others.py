import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidewatch.llm import lbl, mih, quality, tokenscan, warc, words

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = {i: i + 32 for i in range(65, 91)}
ODD = [None, "", " \t", "a", "A a\vB", "é ü x", "x" * 9000, "\x00 \x1c\x85"]


def test_words_and_hashes(monkeypatch):
    texts = [*ODD, *[f"w{i} W{i % 7}\n" * (i % 5) for i in range(200)]]
    for size in (50, 1 << 22):
        monkeypatch.setattr(words, "SLICE_BYTES", size)
        seen = {}
        n = 0
        for w in words.words(pa.array(texts)):
            assert w.first == n
            for k in range(len(w.bounds) - 1):
                a, b = w.bounds[k], w.bounds[k + 1]
                own = WORD.findall((texts[n] or "").translate(LOW))
                assert words.word_strings(w, np.arange(a, b)) == own
                for word, h in zip(own, w.hash[a:b].tolist(), strict=True):
                    assert seen.setdefault(word, h) == h
                n += 1
        assert n == len(texts) and len(set(seen.values())) == len(seen)


# separator scan


def scan(spark, streams, size, eod=9, head=2):
    blocks = [(f, i // size, np.array(t[i : i + size], "<u2").tobytes()) for f, t in streams.items() for i in range(0, len(t), size)] + [("z", 0, None)]
    df = tokenscan.documents(spark.createDataFrame(blocks, "file string, block long, data binary"), eod, head=head)
    return sorted((r["file"], r["document"], r["n_tokens"], tuple(r["head"] or ())) for r in df.collect())


@pytest.mark.parametrize("size", [1, 3, 7, 100])
def test_separators_stitched_over_blocks(spark, size):
    streams = {"a": [1, 2, 3, 9, 9, 4, 9, 5, 6], "b": [9], "c": [7] * 50 + [9], "d": []}
    want = []
    for f, t in streams.items():
        docs, now = [], []
        for x in t:
            if x == 9:
                docs.append(now)
                now = []
            else:
                now.append(x)
        docs += [now] if now else []
        want += [(f, i, len(x), tuple(x[:2])) for i, x in enumerate(docs)]
    assert scan(spark, streams, size) == sorted(want)


def test_token_files(spark, tmp_path):
    tokens = np.array([5, 6, 9, 7, 9] * 40, "<u4")
    tokens.tofile(tmp_path / "x.bin")
    blocks = tokenscan.read_files(spark, str(tmp_path), 4, block_tokens=16)
    rows = tokenscan.documents(blocks, 9, 4).collect()
    assert blocks.count() == 13 and sorted(r["n_tokens"] for r in rows) == [1] * 40 + [2] * 40
    (tmp_path / "y.bin").write_bytes(b"abc")
    with pytest.raises(Exception, match="no whole tokens"):
        tokenscan.read_files(spark, str(tmp_path), 2).collect()


# multi-index hashing


def test_search_equals_brute_force(spark):
    rng = np.random.default_rng(2)
    codes = rng.integers(-(2**63), 2**63 - 1, 300).tolist()
    codes[50:90] = [codes[0]] * 40
    codes[100:110] = [c ^ 5 for c in codes[:10]]
    rows = list(enumerate(codes)) + [(None, 3), (400, None)]
    df = spark.createDataFrame(rows, "id long, code long")
    for k in (1, 10, 400):
        got = {}
        for r in mih.search(df, df.filter("id % 20 = 0"), k).collect():
            got.setdefault(r["query_id"], []).append((r["rank"], r["distance"], r["id"]))
        for q in range(0, 300, 20):
            far = sorted(((codes[q] ^ c) & (2**64 - 1)).bit_count() * 10**6 + i for i, c in enumerate(codes) if i != q)[:k]
            assert sorted(got[q]) == [(n + 1, f // 10**6, f % 10**6) for n, f in enumerate(far)]


def test_codes_of_odd_vectors(spark):
    df = spark.createDataFrame([([1.0, -1.0, None, float("nan"), 0.5],), (None,), ([],)], "v array<float>")
    assert [r[0] for r in df.select(mih.code("v")).collect()] == [-(2**63) + 2**59, None, 0]


# revisits


def record(i, at, url, kind, digest=None, **headers):
    return (i, at, url, kind, digest, {k.replace("_", "-"): v for k, v in headers.items()})


def resolve(spark, rows):
    df = spark.createDataFrame(rows, "record_id long, at long, url string, kind string, digest string, headers map<string,string>")
    return {r["record_id"]: r for r in warc.resolve(df).collect()}


def test_revisits_by_hand(spark):
    rows = [
        record(1, 10, "http://www.A.com:80/x/index.html", "response", "d1", etag="v1", server="s", date="1"),
        record(2, 20, "https://a.com/x#f", "revisit", None, etag="W/v1", date="2", server="other"),
        record(3, 30, "https://a.com/x/", "revisit", None, etag="v2"),
        record(4, 40, "https://a.com/x", "response", "d2", etag="v2", last_modified="m"),
        record(5, 40, "https://a.com/x", "revisit", None, last_modified="m"),
        record(6, 50, "https://a.com/x?utm_source=1&b=2&a=1", "revisit", None),
        record(7, 5, "https://a.com/x", "revisit", None),
        record(8, 60, None, "revisit", None),
        record(9, 60, "https://a.com/x", None, None),
        record(10, 61, "https://a.com/x", "odd", "d3"),
        record(11, 62, "https://a.com/x", "revisit", None),
    ]
    got = resolve(spark, rows)
    assert {i: (r["status"], r["original_id"]) for i, r in got.items()} == {
        1: ("full", 1), 2: ("resolved", 1), 3: ("mismatch", None), 4: ("full", 4), 5: ("resolved", 4), 6: ("no original", None), 7: ("no original", None),
        8: ("no original", None), 9: ("resolved", 4), 10: ("full", 10), 11: ("resolved", 10),
    }
    assert got[2]["merged_headers"] == {"etag": "W/v1", "server": "s", "date": "2"} and got[2]["body_digest"] == "d1"
    assert got[6]["url_key"] == "a.com/x?a=1&b=2"


def test_one_hot_url_over_many_ranges(spark, monkeypatch):
    import random

    from tidewatch.llm import ordered

    monkeypatch.setattr(warc, "id_ranges", lambda df, c: ordered.id_ranges(df, c, rows=4))
    rng = random.Random(4)
    rows = [record(i, rng.randrange(300), "http://h/", rng.choice(["response", "revisit", "revisit"]), f"d{i}") for i in range(200)]
    got, last = resolve(spark, rows), None
    for i, _, _, kind, _, _ in sorted(rows, key=lambda r: (r[1], r[0])):
        last = i if kind == "response" else last
        assert got[i]["original_id"] == last
    assert warc.resolve(spark.createDataFrame([], "record_id long, at long, url string, kind string, digest string, headers map<string,string>")).count() == 0


# language model


def held(i):
    return i is not None and zlib.crc32(str(i).encode()) % 7 == 2


def test_scores_by_definition(spark, monkeypatch):
    monkeypatch.setattr(lbl, "BLOCK_BYTES", 3000)
    monkeypatch.setattr(lbl, "DRAWS", 20_000)
    rows = [(i, " ".join(["the cat sat", "le chat dort", "der hund"][i % 3] + f" n{i * j % 11}." for j in range(i % 9))) for i in range(150)]
    rows += [(1000, None), (1001, ""), (1002, "the unseen-word"), (None, "the cat"), (5, "the cat sat"), (1003, "z" * 5000)]
    docs = spark.createDataFrame([(i, t, 0.5) for i, t in rows], "doc_id long, text string, score double")
    got = lbl.score(docs.repartition(3)).collect()
    assert len(got) == len(rows)
    tokens = [(i, [*WORD.findall((t or "").translate(LOW)), None]) for i, t in rows]
    c = Counter(w for i, t in tokens if not held(i) for w in t)
    n, v = sum(c.values()), len(c)
    want = sorted((str(i), len(t), sum(c[w] > 0 for w in t), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in t), 6), held(i)) for i, t in tokens)
    assert sorted((str(r["doc_id"]), r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6), r["held_out"]) for r in got) == want
    assert sum(r["score"] for r in got if r["held_out"]) > sum(r["base_score"] for r in got if r["held_out"])
    assert all(r["score"] < 0 for r in got)


def test_model_is_normalised_and_learns():
    rng = np.random.default_rng(0)
    a = rng.integers(0, 2, 20_000) * 2
    keys = (a * lbl.CLASSES + a) * lbl.CLASSES + a + rng.integers(0, 2, len(a))  # classes 0, 1 after 0; 2, 3 after 2
    keys, counts = np.unique(keys, return_counts=True)
    share = np.bincount(keys % lbl.CLASSES, counts, lbl.CLASSES)
    first = lbl.first_model(share)
    noise = (share + 1) / (share + 1).sum()
    model = lbl.steps(lbl.first_model(share), keys, counts, noise, 60_000, 1)
    table = model.log10(np.array([0, 2 * lbl.CLASSES + 2]))
    assert np.allclose((10.0**table).sum(1), 1, atol=1e-5)
    assert table[0, 0] > first.log10(np.array([0]))[0, 0] + 0.15 and table[0, 2] < table[0, 0] - 0.5


def test_language_model_without_training_rows(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert lbl.score(docs).count() == 0
    alone = next(i for i in range(50) if held(i))
    r = lbl.score(spark.createDataFrame([(alone, "a b")], "doc_id long, text string")).first()
    assert r["train_tokens"] == 0 and r["n_known"] == 0 and r["base_score"] == 0.0


def test_training_takes_all_counts_however_tasks_are_split(spark):
    rng = np.random.default_rng(3)
    keys = np.unique(rng.integers(0, lbl.CLASSES**3, 4000))
    counts = np.maximum(1, (1e4 / np.arange(1, len(keys) + 1)).astype(np.int64))
    for least in (1, 50_000):
        at, weights = lbl.passes(counts, least, rng)
        assert len(at) >= least and np.allclose(np.bincount(at, weights) / weights.sum(), counts / counts.sum(), rtol=1e-4)
    shard = keys % 16
    rows = [(int(k), keys[shard == k].tobytes(), counts[shard == k].tobytes()) for k in range(16)]
    triples = spark.createDataFrame(rows, "shard int, keys binary, counts binary")
    share = np.bincount(keys % lbl.CLASSES, counts, lbl.CLASSES).astype(np.int64)
    with pytest.MonkeyPatch.context() as m:
        m.setattr(lbl, "DRAWS", 1000)
        one, many = (lbl.train(triples.repartition(n), share).flat() for n in (1, 7))
    assert (one == many).all() and not np.allclose(one, lbl.first_model(share).flat())


def test_words_with_own_vectors_grow_with_the_corpus(spark, monkeypatch):
    seen, train = [], lbl.train
    monkeypatch.setattr(lbl, "DRAWS", 2000)
    monkeypatch.setattr(lbl, "OWN_COUNT", 20, raising=False)
    monkeypatch.setattr(lbl, "train", lambda triples, counts: seen.append(counts) or train(triples, counts))
    docs = spark.createDataFrame([(i, " ".join(f"w{j}" for j in range(i % 2, 300))) for i in range(60)], "doc_id long, text string")
    rows = lbl.score(docs).collect()
    assert len(rows) == 60 and all(r["score"] < 0 for r in rows)
    assert len(seen[0]) == 300 + lbl.SUFFIXES + 1 and (seen[0][:300] >= 20).all() and seen[0][300:-1].sum() == 0


# quality


def test_quality_separates_and_ignores_other_columns(spark):
    good = [f"the quiet river number {i} runs past a small town and its {i % 13} old mills." for i in range(300)]
    junk = [" ".join(f"{w}&&&" for w in t.upper().split()) for t in good]
    rows = [(2 * i, t, "x") for i, t in enumerate(good)] + [(2 * i + 1, t, "x") for i, t in enumerate(junk)] + [(9001, None, None), (9002, "", "y"), (None, "text", "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, 1 - i % 2) for i in range(600)] + [(None, 1), (3, None)], "doc_id long, quality int")
    weights = quality.train(docs, labels)
    out = quality.score(docs.select("doc_id", "text"), weights)
    got = {r["doc_id"]: r for r in out.withColumn("held", quality.held_out(F.col("doc_id"))).collect()}
    away = [i for i in range(600) if got[i]["held"]]
    assert [i for i in away] == [i for i in range(600) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([(got[i]["score"] >= 0.5) == (i % 2 == 0) for i in away]) > 0.98
    assert got[9001]["score"] == got[9002]["score"] and len(got) == len(rows)
    assert quality.score(docs, weights).columns == ["doc_id", "text", "score"]
    assert quality.train(docs, labels) == weights
    none = quality.score(docs, quality.train(docs, labels.limit(0)))
    assert {r["score"] for r in none.collect()} == {0.5} and quality.score(docs.limit(0), weights).count() == 0


def test_quality_on_given_labels(spark):
    from tidewatch.llm.queries import op10_ftrl_quality

    d = "/root/testdata/sf0.01"
    rows = op10_ftrl_quality(spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").filter("held_out").collect()
    good = [r for r in rows if r["quality"] == 1]
    assert np.mean([r["predicted"] for r in good]) > 0.98
    assert np.mean([r["score"] for r in good]) > np.mean([r["score"] for r in rows if r["quality"] == 0]) + 0.4


def test_queries_with_sql(spark):
    import duckdb

    from tidewatch.llm.queries import QUERIES, SQL

    d = "/root/testdata/sf0.001"
    c = duckdb.connect()
    for t in ("documents", "pages", "embeddings", "benchmark"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{d}/{t}.parquet'")
    for name, sql in SQL.items():
        df = QUERIES[name](spark, d)
        rel = c.sql(sql)
        cols = sorted(df.columns)
        at = [rel.columns.index(k) for k in cols]
        assert sorted((tuple(r[k] for k in cols) for r in df.collect()), key=str) == sorted((tuple(r[i] for i in at) for r in rel.fetchall()), key=str), name


def by_the_book(rows):
    """Follow-the-regularised-leader one coordinate at a time, with dictionaries."""
    z, n = {}, {}

    def weight(i):
        zi = z.get(i, 0.0)
        return 0.0 if abs(zi) <= quality.L1 else -(zi - math.copysign(quality.L1, zi)) / ((quality.BETA + math.sqrt(n.get(i, 0.0))) / quality.ALPHA + quality.L2)

    for _ in range(quality.EPOCHS):
        for features, y in rows:
            w = {i: weight(i) for i in features}
            p = 1 / (1 + math.exp(-sum(w[i] * x for i, x in features.items())))
            for i, x in features.items():
                g = (p - y) * x
                sigma = (math.sqrt(n.get(i, 0.0) + g * g) - math.sqrt(n.get(i, 0.0))) / quality.ALPHA
                z[i] = z.get(i, 0.0) + g - sigma * w[i]
                n[i] = n.get(i, 0.0) + g * g
    return {i: weight(i) for i in z}


def test_weights_equal_single_coordinate_steps_however_rows_are_split(spark):
    rng = np.random.default_rng(6)
    texts = {i: " ".join(rng.choice(["mill", "river", "town", "QX&&", "zz9", "old"], rng.integers(0, 12))) for i in range(300)}
    docs = spark.createDataFrame([(i, t) for i, t in texts.items()] + [(7, None), (8, "long " * 5000)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 3 % 2) for i in range(300)] + [(9, 0)], "doc_id long, quality int")
    weights = quality.train(docs.repartition(5), labels)
    assert quality.train(docs.coalesce(1), labels.repartition(3)) == weights
    got = np.frombuffer(weights, np.float32)
    rows = docs.join(labels, "doc_id").filter(~quality.held_out(F.col("doc_id"))).select("quality", "text", F.xxhash64("doc_id", F.lit(7)).alias("rank"), F.xxhash64("text").alias("row")).orderBy("rank", "row", "quality").collect()
    made = list(quality.features(pa.array([r["text"] for r in rows])))
    want = by_the_book([(dict(zip(s.tolist(), v.tolist(), strict=True)), r["quality"]) for (s, v), r in zip(made, rows, strict=True)])
    assert len(want) > 50 and all(abs(got[i] - w) < 1e-3 for i, w in want.items()) and np.count_nonzero(got) == sum(w != 0 for w in want.values())


@pytest.mark.parametrize("sample", [150, 300])
def test_held_out_accuracy_at_several_label_counts(spark, sample):
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{d}/labels.parquet")
    rows = quality.score(docs, quality.train(docs, labels, sample)).join(labels, "doc_id").filter(quality.held_out(F.col("doc_id"))).collect()
    assert np.mean([(r["score"] >= quality.CUT) == (r["quality"] == 1) for r in rows]) > {150: 0.85, 300: 0.93}[sample]


def test_shared_folder_of_a_cluster_must_be_named(spark, monkeypatch):
    from tidewatch.llm import store

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        conf = type("C", (), {"get": staticmethod(lambda k, d: d)})
        sparkContext = Context()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        store.shared_folder(Session())


def test_shuffled_rdds_and_cached_tables_are_staged_and_files_are_not(spark):
    from tidewatch.llm.store import settled, staged

    rows = spark.createDataFrame([(i, "a") for i in range(9)], "doc_id long, text string")
    shuffled = spark.createDataFrame(rows.rdd.repartition(3), rows.schema)
    cached = rows.repartition(2).cache()
    files = staged(rows)
    assert settled(shuffled)._staged_at and settled(cached)._staged_at and settled(files) is files
    assert settled(spark.range(3)).count() == 3 and settled(shuffled).count() == 9
    cached.unpersist()


def test_inputs_behind_a_shuffle_are_staged(spark):
    from tidewatch.llm.store import settled

    df = spark.createDataFrame([(i, "a") for i in range(9)], "doc_id long, text string")
    assert settled(df) is df and settled(df.repartition(3))._staged_at and settled(df.repartition(3)).count() == 9


def test_scores_equal_probabilities_of_the_trained_model_on_any_layout(spark, monkeypatch):
    models, train = [], lbl.train
    monkeypatch.setattr(lbl, "DRAWS", 3000)
    monkeypatch.setattr(lbl, "train", lambda triples, counts: models.append((train(triples, counts), counts)) or models[-1][0])
    rows = [(i, " ".join(["the cat sat", "le chat dort"][i % 2] + f" n{i * j % 211} r{i * 7 + j}" for j in range(i % 6))) for i in range(150)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = [{r["doc_id"]: r["score"] for r in lbl.score(docs.repartition(n)).collect()} for n in (1, 8)]
    assert all(abs(got[0][i] - s) < 1e-4 for i, s in got[1].items())
    model, counts = models[0]
    c = Counter(w for i, t in rows if not held(i) for w in t.split())
    assert len(c) > lbl.TOPS + 50 and np.allclose((10.0 ** model.log10(np.arange(0, len(counts) ** 2, 97))).sum(1), 1, atol=1e-4)
    tops = sorted(c, key=lambda w: (-c[w], int(word_hash(w).view(np.int64))))[: lbl.TOPS]
    suffix = lambda w: int(lbl._suffix(next(words.words(pa.array([w]))))[0])
    kind = lambda w: tops.index(w) if w in tops else lbl.TOPS + suffix(w)
    end, n = len(counts) - 1, len(counts)
    inside = {}
    for w in {w for w in c if w not in tops}:
        inside.setdefault(suffix(w), []).append(c[w])
    for i, t in rows:
        before, total = [end, end], 0.0
        for w in [*t.split(), None]:
            k = end if w is None else kind(w)
            total += float(model.log10(np.array([before[-2] * n + before[-1]]))[0, k])
            if k >= lbl.TOPS and k != end:
                own = inside.get(suffix(w), [])
                total += math.log10((c[w] + 1) / (sum(own) + len(own) + 1))
            before.append(k)
        assert abs(total - got[0][i]) < 1e-3, (i, total, got[0][i])


def word_hash(w):
    return next(words.words(pa.array([w]))).hash[0]


def test_clashing_columns_and_null_headers_of_revisits(spark):
    rows = [(1, 10, "http://a.com/", "response", "d1", {"etag": "v", "server": "s"}), (2, 20, "http://a.com/", "revisit", None, None), (3, 30, "http://a.com/", "response", "d3", None), (4, 40, "http://a.com/", "revisit", None, {"date": "4"}), (5, 50, None, "revisit", None, None), (6, None, "http://a.com/", "revisit", None, None)]
    df = spark.createDataFrame(rows, "record_id long, at long, url string, kind string, digest string, headers map<string,string>")
    others = ["status", "url_key", "original_id", "carried", "__range", "near", "full", "range", "row", "id"]
    for c in others:
        df = df.withColumn(c, F.lit("own"))
    out = warc.resolve(df)
    assert out.columns == ["record_id", "at", "url", "kind", "digest", "headers", *others[3:], "url_key", "original_id", "status", "body_digest", "merged_headers"]
    got = {r["record_id"]: r for r in out.collect()}
    assert all(r[c] == "own" for r in got.values() for c in others[3:])
    assert {i: (r["status"], r["original_id"]) for i, r in got.items()} == {1: ("full", 1), 2: ("resolved", 1), 3: ("full", 3), 4: ("resolved", 3), 5: ("no original", None), 6: ("no original", None)}
    assert got[2]["merged_headers"] == {"etag": "v", "server": "s"} and got[4]["merged_headers"] == {"date": "4"} and got[5]["merged_headers"] is None


def test_ranges_hold_about_equal_numbers_of_rows(spark):
    from tidewatch.llm import ordered

    far = spark.range(20_000).select(F.col("id").alias("doc_id")).union(spark.createDataFrame([(2**60,), (-(2**62),), (None,)], "doc_id long"))
    half = spark.range(20_000).select(F.when(F.col("id") % 2 == 0, 77_777).otherwise(F.col("id")).alias("doc_id"), F.xxhash64("id").alias("h"))
    for df, hashed in ((far, None), (half, "h")):
        ranges = ordered.id_ranges(df, rows=512)
        rows = df.select("doc_id", ranges.of("doc_id", hashed).alias("r"))
        sizes = rows.groupBy("r").agg(F.count("*").alias("n"), F.min("doc_id").alias("a"), F.max("doc_id").alias("z")).orderBy("r").collect()
        assert max(s["n"] for s in sizes) < 3 * 512 and len(sizes) > 20
        known = [s for s in sizes if s["r"] >= 0]
        assert all(s["z"] <= t["a"] for s, t in zip(known, known[1:], strict=False))
    assert ordered.id_ranges(far.limit(0)).of("doc_id") is not None


def test_seeking_reads_of_longer_files(spark, tmp_path):
    rng = np.random.default_rng(3)
    want = []
    for k in range(3):
        tokens = rng.integers(0, 30, 5000 * k).astype("<u2")
        tokens.tofile(tmp_path / f"a b{k}.bin")
        ends = np.flatnonzero(tokens == 9)
        sizes = np.diff(np.concatenate(([-1], ends, [len(tokens)]))) - 1
        want += [(k, i, int(n)) for i, n in enumerate(sizes) if i < len(ends) or n]
    got = tokenscan.documents(tokenscan.read_files(spark, str(tmp_path), block_tokens=700), 9).collect()
    assert sorted((int(r["file"][-5]), r["document"], r["n_tokens"]) for r in got) == want


def test_search_over_groups_chunks_and_empty_tables(spark, monkeypatch):
    monkeypatch.setattr(mih, "SHARD", 40)
    monkeypatch.setattr(mih, "BLOCK", 4)
    rng = np.random.default_rng(4)
    base = rng.integers(-(2**63), 2**63 - 1, 3)
    flips = [sum(1 << int(b) for b in rng.choice(63, rng.integers(0, 7), replace=False)) for _ in range(300)]
    codes = [int(base[i % 3]) ^ f for i, f in enumerate(flips)]
    codes = [c ^ (c & 0xFFFF) if i % 2 else c for i, c in enumerate(codes)]  # one segment's value in half of the codes
    df = spark.createDataFrame(list(enumerate(codes)), "id long, code long")
    got = {}
    for r in mih.search(df, df.filter("id % 20 = 0"), 5).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["distance"], r["id"]))
    for q in range(0, 300, 20):
        far = sorted(((codes[q] ^ c) & (2**64 - 1)).bit_count() * 10**6 + i for i, c in enumerate(codes) if i != q)[:5]
        assert sorted(got[q]) == [(n + 1, f // 10**6, f % 10**6) for n, f in enumerate(far)]
    assert mih.search(df.limit(0), df.limit(0), 3).count() == 0 and mih.search(df.limit(0), df, 3).count() == 0
    assert tokenscan.documents(spark.createDataFrame([], "file string, block long, data binary"), 9).count() == 0


def test_very_long_texts_are_scored_by_all_their_words(spark):
    good = [f"the quiet river number {i} runs past a small town and its {i % 13} old mills." for i in range(60)]
    junk = [" ".join(f"{w}&&&" for w in t.upper().split()) for t in good]
    rows = [(2 * i, t) for i, t in enumerate(good)] + [(2 * i + 1, t) for i, t in enumerate(junk)] + [(500, " ".join(good * 100)), (501, " ".join(junk * 100)), (502, "z" * 300_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("weights", F.lit("own")).withColumn("quality", F.lit(-1))
    weights = quality.train(docs, spark.createDataFrame([(i, 1 - i % 2) for i in range(120)], "doc_id long, quality int"))
    got = {r["doc_id"]: r["score"] for r in quality.score(docs, weights).collect()}
    assert got[500] > 0.5 > got[501] and 0 <= got[502] <= 1


def test_a_repeated_labelled_id_fills_no_more_than_the_sample(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"good words here {i}" if i % 2 else f"bad noise there {i}") for i in range(60)], "doc_id long, text string")
    hot = docs.filter("doc_id = 7").crossJoin(spark.range(500)).select("doc_id", F.when(F.col("id") % 2 == 0, F.col("text")).otherwise(F.concat("text", F.lit(" "), F.col("id").cast("string"))).alias("text"))
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int")

    def rows_seen(batches):
        yield pa.RecordBatch.from_pydict({"weights": pa.array([str(sum(b.num_rows for b in batches)).encode()], pa.binary())})

    monkeypatch.setattr(quality, "_fit_rows", rows_seen)
    assert int(quality.train(docs.unionByName(hot), labels, 100)) == 100
    assert 40 < int(quality.train(docs, labels, 100)) < 60


def test_sums_of_a_bucket_with_a_row_from_every_block(monkeypatch):
    """However rows are split into batches, and sums into merges, blocks get the same counts."""
    monkeypatch.setattr(lbl._Sums, "MERGED", 50)
    rng = np.random.default_rng(4)
    rows, want = [], {}
    for bucket in range(3):
        for block in range(0 if bucket == 1 else 90):
            words_ = np.unique(rng.integers(0, 40, rng.integers(1, 12)).astype(np.uint64) * np.uint64(3) + np.uint64(bucket))
            counts = rng.integers(0, 9, len(words_)).astype(np.uint32)
            rows.append((bucket, block, lbl.pack(np.arange(len(words_))), words_.tobytes(), (words_ % np.uint64(lbl.SUFFIXES)).astype(np.uint8).tobytes(), lbl.pack(counts)))
            for w, c in zip(words_.tolist(), counts.tolist(), strict=True):
                want[w] = want.get(w, 0) + c
    schema = pa.schema([("bucket", pa.int32()), ("block", pa.int64()), ("at", pa.binary()), ("hash", pa.binary()), ("suffix", pa.binary()), ("count", pa.binary())])
    for size in (1, 7, 1000):
        batches = [pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows[i : i + size], strict=True), schema, strict=True)], schema=schema) for i in range(0, len(rows), size)]
        out = pa.Table.from_batches(list(lbl._sum_words(iter(batches)))).to_pylist()
        tops = {h: n for r in out if r["block"] is None for h, n in zip(r["top_hash"], r["top_count"], strict=True)}
        assert tops == want and sum(sum(r["tokens"]) for r in out if r["block"] is None) == sum(want.values())
        given = [r for r in out if r["block"] is not None]
        assert len(given) == len(rows)
        for r, (_, block, at, hashes, _, _) in zip(given, rows, strict=True):
            assert (r["block"], r["at"]) == (block, at) and lbl.unpack(r["count"]).tolist() == [want[h] for h in np.frombuffer(hashes, np.uint64).tolist()]
    assert list(lbl._sum_words(iter([]))) == []
