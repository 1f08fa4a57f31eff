import hashlib
import random
import re

from tidewatch.llm import omh
from tidewatch.llm.queries import op5_order_minhash

ALPHABET = ["lorem", "ipsum", "dolor", "sit", "amet", "consectetur", "adipiscing", "elit", "sed", "do"]


def prints(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r["doc_id"]: r["fp"] for r in omh.fingerprint(docs, "text", "fp").collect()}


def words(n, seed):
    rng = random.Random(seed)
    return [rng.choice(ALPHABET) + str(rng.randrange(90)) for _ in range(n)]


def test_order_and_edits_lower_the_likeness(spark):
    base = words(600, 3)
    texts = [" ".join(base), " ".join(base), " ".join(base[300:] + base[:300]), " ".join(base[:-60] + words(60, 7)), " ".join(words(600, 11)), " ".join(sorted(base))]
    docs = spark.createDataFrame([(i, t, texts[0]) for i, t in enumerate(texts)], "doc_id long, text string, base string")
    rows = omh.fingerprint(omh.fingerprint(docs, "text", "fp"), "base", "bfp").select("doc_id", omh.likeness("fp", "bfp").alias("s")).collect()
    s = {r["doc_id"]: r["s"] for r in rows}
    assert s[0] == s[1] == 1.0
    assert 0.5 < s[3] < 1 and s[2] < 0.9 and s[4] < 0.1
    assert s[5] < s[2] and s[5] < s[3]


def test_repeated_kmers_are_numbered(spark):
    fp = prints(spark, ["a b a b a b a b", "a b a b", "a b a b a b a b"])
    assert fp[0] == fp[2] != fp[1] and len(fp[0]) > len(fp[1]) - 1


def test_native_fingerprint_equals_definition(spark):
    """Cells, numbers and order recomputed from the same hashes, which Spark gives for single values."""
    text = " ".join(words(40, 5)) + " " + " ".join(words(12, 5))
    unit = re.findall(r"\S{1,8}", text)
    hashes = [r[0] for r in spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(zip(unit, unit[1:], strict=False))], "i int, a string, b string").orderBy("i").selectExpr("xxhash64(a, b) & 137438953471L").collect()]
    seen, rows = {}, []
    for i, h in enumerate(hashes):
        rows.append((i, h, seen.setdefault(h, 0)))
        seen[h] += 1
    g = {r["i"]: r["g"] for r in spark.createDataFrame(rows, "i int, h long, o int").selectExpr("i", "xxhash64(h, o) & 137438953471L AS g").collect()}
    cells = {}
    for i, v in g.items():
        cells.setdefault(v >> 31, []).append((v, i))
    want = []
    for c, members in sorted(cells.items()):
        two = sorted(members)[:2]
        want.append((c, [v for v, i in sorted(two, key=lambda x: x[1])]))
    pairs = spark.createDataFrame([(c, v[0], v[1] if len(v) > 1 else None) for c, v in want], "c long, a long, b long")
    entries = [r[0] for r in pairs.selectExpr("c", "shiftleft(c, 32) | (if(b IS NULL, xxhash64(a), xxhash64(a, b)) & 4294967295L) AS e").orderBy("c").select("e").collect()]
    assert prints(spark, [text])[0] == entries


def test_edge_texts(spark):
    fp = prints(spark, ["", "  \n", "x", "y", "x" * 100, "x" * 101])
    assert fp[0] == fp[1] == [] and len(fp[2]) == 1 and fp[2] != fp[3] and fp[4] != fp[5]
    df = spark.createDataFrame([([], []), ([], [1])], "a array<long>, b array<long>").select(omh.likeness("a", "b"))
    assert [r[0] for r in df.collect()] == [1.0, 0.0]


def test_edited_texts_by_hand(spark, tmp_path):
    rows = [(7, "abcdefghi"), (5, None), (900, "xyz" * 400), (-3, "éü"), (6, "0123456789")]
    spark.createDataFrame([(i, t, "e") for i, t in rows], "doc_id long, text string, edited string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: r for r in op5_order_minhash(spark, str(tmp_path)).collect()}
    order = sorted(rows, key=lambda r: -r[0])
    for n, (i, t) in enumerate(order):
        t, nxt = t or "", order[(n + 1) % len(order)][1] or ""
        k = len(t) // 3
        assert got[i]["edited_sha256"] == hashlib.sha256((t[: len(t) - k] + nxt[:k]).encode()).hexdigest() and got[i]["n_chars"] == len(t)
    assert got[5]["near_edited"] == 1.0 and got[5]["near_next"] == 0.0


def test_neighbours_over_many_ranges_and_repeats(spark, monkeypatch):
    ids = [i * 37 % 1000 for i in range(1000)] + [500, None]
    docs = spark.createDataFrame([(i, f"t{i}-{n}") for n, i in enumerate(ids)], "doc_id long, text string")
    monkeypatch.setattr(omh, "id_ranges", lambda df: __import__("tidewatch.llm.ordered", fromlist=["x"]).id_ranges(df, rows=16))
    rows = omh.with_next(docs, ["text"]).collect()
    assert len(rows) == len(ids)
    following = {r["text"]: r["next_text"] for r in rows}
    start = at = next(iter(following))
    seen = set()
    while at not in seen:
        seen.add(at)
        at = following[at]
    assert at == start and len(seen) == len(ids)
    assert following[f"t1-{ids.index(1)}"] == f"t0-{ids.index(0)}" and following["tNone-1001"].startswith("t999-")


def test_empty_table_and_native_plan(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    df = op5_order_minhash(spark, str(tmp_path))
    assert df.count() == 0 and "Python" not in df._jdf.queryExecution().executedPlan().toString()
