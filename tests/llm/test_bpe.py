import base64
import hashlib

import numpy as np
import public_tokenizers
import pytest
import regex
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from tidewatch.llm import bpe
from tidewatch.llm.queries import ranks

RAW = ranks()
RANKS = bpe.parse_ranks(RAW)
ENC = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, RAW.splitlines())}, special_tokens={})
TEXTS = [None, "", " ", "a", "  two  spaces ", "x  y z \n\n w\t", "don't we'll 'S", "naïve Übung 日本語 ½ Ⅷ", "\x1c\x1d a\x1cb", "!" * 70 + "'s", "é" * 5000, "ab" * 3000, "🙂 a🙂b <|endoftext|>", "\x00\x01 z"]


@given(st.text(max_size=60))
@settings(max_examples=300, deadline=None)
def test_words_never_cut_pre_tokens(text):
    find = regex.compile(public_tokenizers.PATTERN).findall
    pieces = bpe._word_finder(public_tokenizers.PATTERN)(text)
    assert "".join(pieces) == text
    assert [t for p in pieces for t in find(p)] == find(text)


@given(st.text(alphabet=" \n\t  'sab1!", max_size=30))
@settings(max_examples=500, deadline=None)
def test_merges_equal_the_library(text):
    find = regex.compile(public_tokenizers.PATTERN).findall
    assert [i for t in find(text) for i in bpe.merge(t.encode(), RANKS)] == ENC.encode_ordinary(text)


def test_long_and_short_merges_agree():
    for w in (b"internationalisation" * 3, b"aaaaaaaaab" * 6, bytes(range(256))):
        assert bpe._merge_long(w, RANKS) == ENC._encode_single_piece(w)


def test_numbers_survive_packing():
    for x in ([], [0], [2**32 - 1, 5, 70_000]):
        assert bpe.unpack(bpe.pack(np.array(x, np.uint32))).tolist() == x


@pytest.mark.parametrize("block", [30, 8_000_000])
def test_documents_round_trip(spark, monkeypatch, block):
    monkeypatch.setattr(bpe, "BLOCK_CHARS", block)
    rows = [(None if i == 3 else i, t, i) for i, t in enumerate([*TEXTS, TEXTS[5], "common words are common"])] + [(1, "again", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids int").repartition(3)
    got = bpe.decode(bpe.encode(docs, RAW, public_tokenizers.PATTERN), RAW).collect()
    want = sorted((str(i), ENC.encode_ordinary(t or ""), (t or "").encode()) for i, t, _ in rows)
    assert sorted((str(r["doc_id"]), np.frombuffer(r["ids"], "<u4").tolist(), bytes(r["decoded"])) for r in got) == want
    both = bpe.encode(docs, RAW, public_tokenizers.PATTERN, decoded=True).collect()
    assert sorted((str(r["doc_id"]), np.frombuffer(r["ids"], "<u4").tolist(), bytes(r["decoded"])) for r in both) == want


def test_empty_table_and_null_ids(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert bpe.encode(docs, RAW, public_tokenizers.PATTERN).count() == 0
    one = spark.createDataFrame([(1, None)], "doc_id long, ids binary")
    assert bpe.decode(one, RAW).first()["decoded"] is None


def test_query_on_given_documents(spark):
    from tidewatch.llm.queries import op1_byte_bpe

    d = "/root/testdata/sf0.001"
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    rows = op1_byte_bpe(spark, d).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = ENC.encode_ordinary(texts[r["doc_id"]] or "")
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256((texts[r["doc_id"]] or "").encode()).hexdigest()
