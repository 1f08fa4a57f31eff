"""Byte-level BPE encoding and decoding by a global shuffle of distinct words.

Documents are cut into blocks of a few million characters. Within a block every word (white space, then what
follows up to the next white space: no pre-token crosses such a border) becomes a position in the block's list of
distinct words, so what travels with a document is one small number per word, in text order. The blocks' distinct
words are dealt by hash to buckets, where equal words of all blocks meet and each is split into pre-tokens and merged
once. The ids go back by block, join the documents' positions and are put together in text order. A word is there
once per block at most, however frequent it is; blocks are bounded, a longer document being a block of its own; the
number of buckets grows with the table, so a bucket's distinct words fit in memory; its rows stream by. Lists travel
packed, one row for each block and bucket that it has words in.

Blocks are made in two scans. An input that comes from a shuffle, whose rows may come in another order when a lost
executor's work is repeated, is written to the shared folder first.

Decoding joins ids with the token-byte table, whose size is that of the vocabulary file.

Nulls and odd rows: a null or empty text has no ids; rows with a null or repeated doc_id are encoded each for
itself; other columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import settled, small_batches

BLOCK_CHARS = 8_000_000
#: Documents a bucket of words; the number of buckets is a power of two that grows with the documents.
BUCKET_DOCS, FEWEST_BUCKETS = 4000, 32
#: Ids decoded at once.
PIECE = 1 << 16
_HUGE = 1 << 30


def parse_ranks(raw: bytes) -> dict[bytes, int]:
    return {base64.b64decode(word): int(rank) for word, rank in (line.split() for line in raw.splitlines() if line.strip())}


def merge(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one pre-token: the adjacent pair of lowest rank is joined, the leftmost of equals first, until none is left."""
    if word in ranks:
        return [ranks[word]]
    if len(word) > 48:
        return _merge_long(word, ranks)
    parts = [word[i : i + 1] for i in range(len(word))]
    while len(parts) > 1:
        pair = [ranks.get(a + b, _HUGE) for a, b in zip(parts, parts[1:], strict=False)]
        low = min(pair)
        if low == _HUGE:
            break
        i = pair.index(low)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return [ranks[p] for p in parts]


def _merge_long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same in n log n steps: a heap of pairs over a linked list of parts."""
    n = len(word)
    end, left, right = [i + 1 for i in range(n)], [i - 1 for i in range(n)], [i + 1 for i in range(n)]
    alive = [True] * n
    heap = [(ranks[word[i : i + 2]], i, i + 2) for i in range(n - 1) if word[i : i + 2] in ranks]
    heapq.heapify(heap)
    while heap:
        _, i, stop = heapq.heappop(heap)
        j = right[i]
        if not alive[i] or j >= n or end[j] != stop:
            continue
        alive[j], end[i], right[i] = False, stop, right[j]
        if right[i] < n:
            left[right[i]] = i
            if (r := ranks.get(word[i : end[right[i]]])) is not None:
                heapq.heappush(heap, (r, i, end[right[i]]))
        if left[i] >= 0 and (r := ranks.get(word[left[i] : stop])) is not None:
            heapq.heappush(heap, (r, left[i], stop))
    return [ranks[word[i : end[i]]] for i in range(n) if alive[i]]


def pack(numbers: np.ndarray) -> bytes:
    """Unsigned 32-bit numbers, byte by byte of equal rank, compressed."""
    planes = np.ascontiguousarray(numbers, "<u4").view(np.uint8).reshape(-1, 4).T
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpack(raw: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel()


def _word_finder(pattern: str):
    """White space is what \\s means to the pattern's engine, which is not quite what it means to re."""
    space = "".join(re.escape(chr(c)) for c in range(0x3001) if regex.fullmatch(r"\s", chr(c)))
    return re.compile(f"[{space}]*[^{space}]+|[{space}]+").findall


def _blocks(batches: Iterator[pa.RecordBatch], pattern: str) -> Iterator[tuple[int, list, list[np.ndarray], list[str]]]:
    """(block, doc ids, each document's positions, distinct words). The block's number comes from its task and texts."""
    find = _word_finder(pattern)
    part = TaskContext.get().partitionId() if TaskContext.get() else 0
    ids, codes, known, size, made, sign = [], [], {}, 0, 0, hashlib.blake2b(digest_size=8)

    def block():
        return int.from_bytes(hashlib.blake2b(f"{part}/{made}/{sign.hexdigest()}".encode(), digest_size=8).digest(), "little", signed=True)

    for batch in batches:
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            found = find(text) if text else []
            for w in found:
                if w not in known:
                    known[w] = len(known)
            ids.append(doc_id)
            codes.append(np.fromiter(map(known.__getitem__, found), np.uint32, len(found)))
            sign.update(f"{doc_id}/{len(found)}/{len(known)};".encode())
            size += len(text or "")
            if size >= BLOCK_CHARS:
                yield block(), ids, codes, list(known)
                ids, codes, known, size, made = [], [], {}, 0, made + 1
    if ids:
        yield block(), ids, codes, list(known)


def _words_of(pattern: str, buckets: int):
    schema = pa.schema([("bucket", pa.int32()), ("block", pa.int64()), ("at", pa.binary()), ("sizes", pa.binary()), ("words", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=1).compress
        for block, _, _, known in _blocks(batches, pattern):
            raw = [w.encode() for w in known]
            bucket = np.fromiter(map(zlib.crc32, raw), np.uint32, len(raw)) % buckets
            for b in np.unique(bucket).tolist():
                at = np.flatnonzero(bucket == b)
                own = [raw[i] for i in at.tolist()]
                row = [[b], [block], [pack(np.diff(at, prepend=0))], [pack(np.array([len(w) for w in own]))], [squeeze(b"".join(own))]]
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(row, schema, strict=True)], schema=schema)

    return run


def _documents_of(pattern: str):
    schema = pa.schema([("block", pa.int64()), ("ids", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int32())), ("codes", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, ids, codes, _ in _blocks(batches, pattern):
            row = {"block": [block], "ids": [ids], "sizes": [[len(c) for c in codes]], "codes": [pack(np.concatenate(codes))]}
            yield pa.RecordBatch.from_pydict(row, schema=schema)

    return run


def _encode_words(raw, pattern: str):
    schema = pa.schema([("block", pa.int64()), ("at", pa.binary()), ("sizes", pa.binary()), ("ids", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks, find, last, known = parse_ranks(raw.value), regex.compile(pattern).findall, None, {}
        for batch in batches:
            for row in batch.to_pylist():
                if row["bucket"] != last:  # sorted: a bucket's rows follow each other
                    last, known = row["bucket"], {}
                data = zstandard.ZstdDecompressor().decompress(row["words"])
                ends = np.cumsum(unpack(row["sizes"])).tolist()
                out = []
                for a, b in zip([0, *ends[:-1]], ends, strict=True):
                    w = data[a:b]
                    ids = known.get(w)
                    if ids is None:
                        ids = known[w] = [i for t in find(w.decode()) for i in merge(t.encode(), ranks)]
                    out.append(ids)
                flat = np.fromiter((i for ids in out for i in ids), np.uint32)
                made = [[row["block"]], [row["at"]], [pack(np.array([len(x) for x in out]))], [pack(flat)]]
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(made, schema, strict=True)], schema=schema)

    return run


def gather(flat: np.ndarray, start: np.ndarray, size: np.ndarray, which: np.ndarray) -> np.ndarray:
    """The pieces flat[start:start+size] at the positions `which`, one after the other."""
    n = size[which]
    ends = np.cumsum(n)
    if not len(ends) or not ends[-1]:
        return flat[:0]
    return flat[np.repeat(start[which] - ends + n, n) + np.arange(ends[-1])]


def _bytes_of(raw: bytes):
    """A function from ids to the bytes they stand for: the token-byte table, looked up for all ids at once."""
    table = sorted((rank, word) for word, rank in parse_ranks(raw).items())
    flat = np.frombuffer(b"".join(word for _, word in table), np.uint8)
    size, start = np.zeros(table[-1][0] + 1, np.int64), np.zeros(table[-1][0] + 1, np.int64)
    size[[rank for rank, _ in table]] = [len(word) for _, word in table]
    start[1:] = np.cumsum(size)[:-1]
    return lambda ids: b"".join(gather(flat, start, size, ids[i : i + PIECE]).tobytes() for i in range(0, len(ids), PIECE))


def _put_together(raw=None):
    """Ids of a block's documents; with raw (the broadcast vocabulary) the bytes they decode to as well."""
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.binary()), *([("decoded", pa.binary())] if raw else [])])
    kept = []

    def run(documents: pa.Table, words: pa.Table) -> pa.Table:
        if raw and not kept:
            kept.append(_bytes_of(raw.value))
        if not documents.num_rows:
            raise RuntimeError("blocks of two reads differ: the input changed between them")
        rows = words.to_pylist()
        at = [np.cumsum(unpack(r["at"])) for r in rows]
        sizes = [unpack(r["sizes"]).astype(np.int64) for r in rows]
        flat = np.concatenate([unpack(r["ids"]) for r in rows]) if rows else np.zeros(0, "<u4")
        n = sum(len(x) for x in at)
        start, size = np.zeros(n, np.int64), np.zeros(n, np.int64)
        if n:
            each = np.concatenate(sizes)
            where = np.concatenate(at)
            size[where], start[where] = each, np.cumsum(each) - each
        out = {name: [] for name in schema.names}
        for row in documents.to_pylist():
            codes = unpack(row["codes"])
            if len(codes) and int(codes.max()) >= n:
                raise RuntimeError("blocks of two reads differ: the input changed between them")
            ends = np.cumsum(row["sizes"]).tolist()
            for doc_id, a, b in zip(row["ids"], [0, *ends[:-1]], ends, strict=True):
                ids = gather(flat, start, size, codes[a:b])
                out["doc_id"].append(doc_id)
                out["ids"].append(ids.tobytes())
                if raw:
                    out["decoded"].append(kept[0](ids))
        return pa.table([pa.array(out[f.name], f.type) for f in schema], schema=schema)

    return run


def encode(docs: DataFrame, ranks: bytes, pattern: str, text: str = "text", decoded: bool = False) -> DataFrame:
    """doc_id, ids (binary: little-endian unsigned 32-bit) of every row of docs; ranks: the vocabulary file's bytes.

    decoded adds the bytes of the ids, as decode() does, in the tasks that make the ids.
    """
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(ranks)  # as large as the vocabulary, whatever the input
    texts = settled(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")))
    buckets = max(FEWEST_BUCKETS, 1 << (texts.count() // BUCKET_DOCS).bit_length())
    words = (
        texts.mapInArrow(_words_of(pattern, buckets), "bucket int, block long, at binary, sizes binary, words binary")
        .repartition("bucket")
        .sortWithinPartitions("bucket")
        .mapInArrow(_encode_words(shared, pattern), "block long, at binary, sizes binary, ids binary")
    )
    blocks = texts.mapInArrow(_documents_of(pattern), "block long, ids array<long>, sizes array<int>, codes binary")
    kinds = "doc_id long, ids binary" + ", decoded binary" * decoded
    return blocks.groupBy("block").cogroup(words.groupBy("block")).applyInArrow(_put_together(shared if decoded else None), kinds)


def decode(encoded: DataFrame, ranks: bytes) -> DataFrame:
    """Adds `decoded` (binary), in place of a column of that name: the bytes of `ids`, by a join of ids with the
    broadcast token-byte table. Null ids stay null."""
    small_batches(encoded.sparkSession)
    shared = encoded.sparkSession.sparkContext.broadcast(ranks)
    rows = encoded.select(*[F.col(f"`{c}`") for c in encoded.columns if c.lower() != "decoded"])
    columns = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bytes_of = _bytes_of(shared.value)
        for batch in batches:
            ids = batch.column(columns.index("ids")).to_pylist()
            out = [None if x is None else bytes_of(np.frombuffer(x, "<u4")) for x in ids]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary())], names=[*columns, "decoded"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(run, f"{kinds}, decoded binary")
