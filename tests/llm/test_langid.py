import re
import zlib

import numpy as np
import pytest
import zstandard

from tidewatch.llm import langid

DATA = "/root/testdata/sf0.01"


def is_held(i):
    return i is not None and zlib.crc32(str(i).encode()) % 5 == 0


def brute_dictionaries(rows, k):
    """All distinct pieces of the training texts at once, the k of the smallest hashes."""
    import xxhash

    seen, counts = {}, {}
    for i, text, lang in rows:
        if i is None or text is None or lang is None or is_held(i):
            continue
        counts[lang] = counts.get(lang, 0) + 1
        low = " " + " ".join(re.sub(r"[^a-z\u0080-\U0010FFFF]", " ", text.lower()).split(" ")) + " "
        low = re.sub(" +", " ", low).encode() if low.strip() else b"  "
        at = 0
        while at < len(low) - 1:
            to = low.find(b" ", at + 256)
            to = len(low) if to < 0 else to
            seen.setdefault(lang, {})[xxhash.xxh64_intdigest(low[at:to]) >> 1] = low[at:to]
            at = to
    return [(x, b"".join(p for _, p in sorted(sorted(seen[x].items())[:k], reverse=True))) for x in sorted(counts, key=lambda x: (-counts[x], x))]


def test_dictionaries_are_the_least_pieces_whatever_the_layout(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text", "lang")
    want = brute_dictionaries([tuple(r) for r in docs.collect()], langid.DICTIONARY // langid.PIECE)
    assert langid.learn(docs.repartition(7)) == want and langid.learn(docs.coalesce(1).unionAll(docs)) == want
    assert len(want) == 4 and all(100_000 < len(d) < 200_000 for _, d in want)


def test_held_out_accuracy_and_sizes(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    learned = langid.learn(docs)
    truth = {r["doc_id"]: r for r in docs.collect()}
    got = langid.classify(docs.select("doc_id", "text"), learned).collect()
    held = [r for r in got if is_held(r["doc_id"])]
    assert len(held) > 150 and np.mean([r["lang_pred"] == truth[r["doc_id"]]["lang"] for r in held]) >= 0.97
    sure = [r for r in held if r["accepted"]]
    assert len(sure) > 0.9 * len(held) and np.mean([r["lang_pred"] == truth[r["doc_id"]]["lang"] for r in sure]) >= 0.99
    assert all(0 <= r["score"] <= 1 for r in got)
    for r in held[:40]:  # the totals by plain calls
        low, sizes = langid.plain(r["text"]), []
        for _, d in learned:
            raw = zstandard.ZstdCompressionDict(d, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            level, step, more = (13, 256, {"min_match": 3}) if len(low) <= 256 else (6, 2048, {})
            z = zstandard.ZstdCompressor(dict_data=raw, compression_params=zstandard.ZstdCompressionParameters.from_level(level, write_content_size=False, write_dict_id=False, **more))
            sizes.append(sum(len(z.compress(low[i : i + step])) for i in range(0, len(low), step)))
        order = sorted(sizes)
        assert r["lang_pred"] == learned[sizes.index(order[0])][0] and r["accepted"] == (order[1] / order[0] - 1 >= langid.MARGIN)
        assert r["score"] == pytest.approx(1 / sum(np.exp(-60 * (s / order[0] - 1)) for s in sizes))


def test_defined_cases(spark):
    en, de = "the house and the garden are with the people of this land ", "das haus und der garten sind bei den leuten von diesem land "
    ids = [i for i in range(100) if not is_held(i)]
    rows = [(ids[0], en * 40, "en"), (ids[1], de * 40, "de"), (ids[2], en, "en"), (ids[3], "x", None), (None, "y", "xx"), (ids[4], None, "yy")]
    rows += [(next(i for i in range(100) if is_held(i)), "held " * 50, "zz")]
    learned = langid.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert [x for x, _ in learned] == ["en", "de"]
    texts = [None, "", " \n", "12 345 !?", "²", en, de * 3, de.upper(), "Q", "日本語", en * 4000, en]
    docs = spark.createDataFrame([(i if i else None, t, "old", 1.5) for i, t in enumerate(texts)], "doc_id long, text string, LANG_PRED string, Accepted double")
    out = langid.classify(docs, learned)
    assert out.columns == ["doc_id", "text", *langid.ADDED]
    got = [(r["lang_pred"], r["score"] > 0, r["accepted"]) for r in out.collect()]
    assert got[:5] == [("und", False, False)] * 5
    assert got[5:8] == [("en", True, True), ("de", True, True), ("de", True, True)]
    assert got[8:10] == [("en", True, False)] * 2  # nothing to tell by: the language of more texts
    assert got[10:] == [("en", True, True)] * 2
    assert langid.classify(docs.limit(0), learned).count() == 0
    assert {r["lang_pred"] for r in langid.classify(docs, langid.learn(docs.limit(0).selectExpr("doc_id", "text", "text AS lang"))).collect()} == {"und"}


def test_one_language_is_no_choice(spark):
    docs = spark.createDataFrame([(1, "a text", "aa"), (2, "b text", "aa")], "doc_id long, text string, lang string")
    got = langid.classify(docs, langid.learn(docs)).collect()
    assert [(r["lang_pred"], r["score"], r["accepted"]) for r in got] == [("aa", 1.0, True)] * 2
