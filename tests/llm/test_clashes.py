"""Columns of the input may have any names: they come out as they went in."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidewatch.llm import mih, mixing, neardup, pii

#: Names that operators use inside, or have used.
NAMES = ["__id", "__row", "__text", "__spans", "__copies", "__each", "__copy", "__n", "__rows", "__doc", "__quality", "id", "row", "hash", "rows", "copies", "each", "copy", "given", "plain", "clean", "spans", "of_id", "of_row", "key", "n", "size", "word s", "a.b", "quality_score", "Row_Key", "told", "terms"]
ROWS = [(1, "mail me@here.org now", "s"), (2, "two words and five more here", "s"), (3, None, "t"), (None, "", "t"), (4, "me@here.org again Zoe", "t"), (4, "me@here.org again Zoe", "t")]


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string, source string")
    return df.select("*", *[F.concat(F.lit(f"{n} of "), F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))).alias(n) for n in NAMES])


def whole(r):
    """All own columns of a row still tell their name and the row's id."""
    return all(r[n] == f"{n} of {'-' if r['doc_id'] is None else r['doc_id']}" for n in NAMES)


def test_sanitise_keeps_columns_and_leaks_nothing(docs):
    out = pii.sanitise(docs)
    rows = out.collect()
    assert out.columns == docs.columns and len(rows) == len(ROWS) and all(map(whole, rows))
    assert not any("here.org" in str(v) for r in rows for v in r)
    assert sorted(str(r["text"]) for r in rows if r["doc_id"] in (2, 3, None)) == ["", "None", ROWS[1][1]]


def test_mix_keeps_columns(docs):
    out = mixing.mix(docs)
    rows = out.collect()
    assert out.columns == docs.columns and rows and all(map(whole, rows))


def test_stages_keep_columns(spark, docs, tmp_path):
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for stage, n in ((corpus_pipeline.keep_good, len(ROWS)), (corpus_pipeline.keep_firsts, len(ROWS) - 1)):
        out = stage(spark, docs, str(tmp_path))
        rows = out.collect()
        assert out.columns == docs.columns and len(rows) == n and all(map(whole, rows))


def test_query_tells_removed_and_generalised_spans(spark):
    from tidewatch.llm import queries

    rows = {r["doc_id"]: r for r in queries.op7_disclosure(spark, "/root/testdata/sf0.001").collect()}
    for r in rows.values():
        terms = [x for x in r["spans"].split(",") if x.startswith("term:")]
        told = [f"term:{a}:{b}" for a, b, *_ in (x.split(":") for x in [*r["removed"].split(","), *r["generalised"].split(",")] if x)]
        assert sorted(terms) == sorted(told)


def test_a_document_of_many_addresses_and_terms_makes_few_pairs(spark):
    many = " ".join(f"u{i}@x.org" for i in range(300)) + " " + " ".join("w" + chr(97 + i // 26) + chr(97 + i % 26) + "." for i in range(600))
    rows = [(1, many), (2, "u1@x.org waa. waa"), (3, "other text waa.")] + [(i, "plain filler") for i in range(10, 60)]
    found = pii.detect(spark.createDataFrame(rows, "doc_id long, text string"))
    got = {(r["doc_id"], r["entity"], r["term"]) for r in pii.contexts(found).collect()}
    assert got == {(1, "email:u1@x.org", "waa"), (2, "email:u1@x.org", "waa")}


def test_sampled_sketches_drop_no_near_pair():
    """Where sets are sampled the estimate may undercut the truth by SLACK: it doesn't, for sets of up to 20,000 shingles."""
    rng, lowest = np.random.default_rng(11), 0.0
    for percent in (80, 85):
        for i in range(400):
            n = int(rng.integers(1100, 20_000))
            inside = i % 2  # one set holds the other, or both are of one size
            common = -(-n * percent // 100) if inside else -(-2 * n * percent // (100 + percent))
            all_ = rng.integers(0, 2**63, n if inside else 2 * n - common, dtype=np.uint64)
            a, b = (all_, all_[:common]) if inside else (all_[:n], all_[n - common :])
            odd = int(np.bitwise_count((neardup.odd_sketch(a) ^ neardup.odd_sketch(b)).view(np.uint64)).sum())
            assert neardup.possible(odd, len(a), len(b), percent)
            lowest = min(lowest, float(neardup.likeness(odd, len(a), len(b))) - percent / 100)
    assert -neardup.SLACK < lowest < 0


def test_tables_are_copied_as_often_as_their_own_queries_fill_blocks(spark, monkeypatch):
    rng = np.random.default_rng(2)
    codes = rng.integers(-(2**63), 2**63, 3000)
    df = spark.createDataFrame([(i, int(c)) for i, c in enumerate(codes)], "id long, code long")
    monkeypatch.setattr(mih, "SHARD", 100)
    seen = []
    own = mih._search
    copies = spark.sparkContext.accumulator(0)

    def counting(k, radii):
        run = own(k, radii)

        def counted(batches):
            for batch in batches:
                copies.add(batch.num_rows)
                yield from run([batch])

        return counted

    monkeypatch.setattr(mih, "_search", counting)
    for queries in (20, 320):
        before = copies.value
        got = mih.search(df, df.filter(f"id < {queries}"), 3).count()
        seen.append(copies.value - before)
        assert got == 3 * queries
    assert seen[1] < 3 * seen[0]
