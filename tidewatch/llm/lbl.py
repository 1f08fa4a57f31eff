"""Language-model scores: a log-bilinear neural model over word classes, trained with noise-contrastive estimation.

Tokens are words and one end a document. Each of the 191 most frequent words, and each word seen OWN_COUNT times up to
MOST_TOPS of them, is a class of its own; other words fall into 64 classes by their last two bytes; the end is a class.
The model gives a class from the two before it by the dot product of its vector with the sum of theirs, plus a bias,
normalised over all classes by batched matrix products; within its class a word has add-one probability with one place
kept for unseen words. So probabilities sum to one.

What is learned from the corpus, from every training document: the count of every word (words are told apart by a
64-bit hash), and the count of every three adjacent classes. Counts are summed per block of documents, then in the
bucket of the word or the triple. Training runs on the triple counts: they are dealt by hash to shards and these to
units, whose number follows from the number of distinct triples. In each round a unit goes once or more through all of
its triples with their full counts, in steps against shared noise; then the units' parameters are averaged. Seeds go by
unit and the mean is a sum of whole numbers, so the model is the same however tasks are split. Its size is bounded.

Scoring puts each block's word counts beside the block's documents, coded by position in the block's word list. What
normalises the model is summed once for every pair of classes that can stand before a token.

Defined cases: null and empty texts are one end token. Null ids are training documents. Rows that repeat an id count
each for themselves. Without training documents the model is uniform over classes and N, V and c are 0.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import pack, unpack
from .store import freed, settled, small_batches, staged
from .words import Words, mix, words

TOPS, MOST_TOPS, SUFFIXES = 191, 959, 64
#: Words beyond the first TOPS have vectors of their own from this count on.
OWN_COUNT = 1000
#: Classes of a small corpus; the own words' come first, then the suffixes', then the end.
CLASSES = TOPS + SUFFIXES + 1
SIZE = 24
SHARDS = 256
#: DRAWS: the least number of steps' rows a unit takes in a round; it sets the number of units, too.
ROUNDS, DRAWS, BATCH, NOISE = 5, 150_000, 1024, 48
RATE = 0.25
#: Parameters are summed as multiples of this.
GRAIN = 2.0**-40
BLOCK_BYTES = 4 << 20
BUCKET_DOCS, FEWEST_BUCKETS = 4000, 32


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(7)) == 2, F.lit(False))


@dataclass
class Block:
    key: int
    ids: pa.Array
    held: np.ndarray
    words: Words


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[Block]:
    """Runs of documents (doc_id, held, text) of about BLOCK_BYTES; the same input gives the same blocks in every scan."""
    part, made = (TaskContext.get().partitionId() if TaskContext.get() else 0), 0

    def block(rows: list[pa.RecordBatch]) -> Iterator[Block]:
        nonlocal made
        table = pa.Table.from_batches(rows).combine_chunks()
        held = table.column(1).to_numpy(zero_copy_only=False).astype(bool)
        for w in words(table.column(2), BLOCK_BYTES):
            n = len(w.bounds) - 1
            sign = hashlib.blake2b(f"{part}/{made}/{n}".encode() + w.hash.tobytes(), digest_size=8).digest()
            made += 1
            yield Block(int.from_bytes(sign, "little", signed=True), table.column(0).slice(w.first, n), held[w.first : w.first + n], w)

    rows, size = [], 0
    for batch in batches:
        if batch.num_rows:
            rows.append(batch)
            size += batch.column(2).nbytes
        if size >= BLOCK_BYTES:
            yield from block(rows)
            rows, size = [], 0
    if rows:
        yield from block(rows)


def _local(w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A block's distinct hashes by falling count, the place where each first stands, and every word's number."""
    distinct, first, number, count = np.unique(w.hash, return_index=True, return_inverse=True, return_counts=True)
    order = np.argsort(-count, kind="stable")
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    return distinct[order], first[order], rank[number]


def _word_counts(buckets: int):
    schema = pa.schema([("bucket", pa.int32()), ("block", pa.int64()), ("at", pa.binary()), ("hash", pa.binary()), ("suffix", pa.binary()), ("count", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches):
            w = block.words
            distinct, first, number = _local(w)
            learn = np.repeat(~block.held, np.diff(w.bounds))
            count = np.bincount(number[learn], minlength=len(distinct)).astype(np.uint32)
            suffix = _suffix(w)[first].astype(np.uint8)
            bucket = (distinct % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            ends = np.searchsorted(bucket[order], np.arange(buckets + 1))
            rows = []
            for b in range(buckets):
                at = order[ends[b] : ends[b + 1]]
                if len(at):
                    rows.append((b, block.key, pack(np.diff(at, prepend=0)), distinct[at].tobytes(), suffix[at].tobytes(), pack(count[at])))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return run


def runs(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple[object, list[dict]]]:
    """Rows that follow each other with the same key."""
    last, rows = None, []
    for batch in batches:
        for row in batch.to_pylist():
            if rows and row[key] != last:
                yield last, rows
                rows = []
            last = row[key]
            rows.append(row)
    if rows:
        yield last, rows


def _stretches(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple[object, Iterator[pa.RecordBatch]]]:
    """Rows that follow each other with the same key, in slices of the batches they come in, which stay Arrow tables.

    Each stretch has to be read to its end before the next one is asked for.
    """
    slices = ((b[key][i].as_py(), b.slice(i, j - i)) for b in batches if b.num_rows for i, j in _cuts(b[key].to_numpy()))
    for value, same in groupby(slices, lambda x: x[0]):
        yield value, (b for _, b in same)


def _cuts(keys: np.ndarray) -> list[tuple[int, int]]:
    at = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
    return list(zip(at[:-1], at[1:], strict=True))


def _bytes_of(b: pa.RecordBatch, column: str, dtype: type) -> np.ndarray:
    """All rows' binary values of a column, end to end."""
    return np.frombuffer(b"".join(b[column].to_pylist()), dtype)


class _Sums:
    """Counts by key, added as they come: new keys wait until there are MERGED of them, so little more than the distinct
    keys is held, however many rows bring them."""

    MERGED = 1 << 20

    def __init__(self) -> None:
        self.keys, self.counts, self.more = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.uint8)
        self.wait: list[tuple[np.ndarray, ...]] = []
        self.waiting = 0

    def add(self, keys: np.ndarray, counts: np.ndarray, more: np.ndarray) -> None:
        """more: a value that depends on the key alone."""
        self.wait.append((keys, counts, more))
        self.waiting += len(keys)
        if self.waiting > self.MERGED:
            self.merge()

    def merge(self) -> None:
        keys, counts, more = (np.concatenate(x) for x in zip((self.keys, self.counts, self.more), *self.wait, strict=True))
        self.keys, first, at = np.unique(keys, return_index=True, return_inverse=True)
        self.counts, self.more = np.zeros(len(self.keys), np.int64), more[first]
        np.add.at(self.counts, at, counts.astype(np.int64))
        self.wait, self.waiting = [], 0


def _sum_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each block's words with their counts in all blocks; for each bucket its most frequent words and class totals.

    A bucket with a frequent word has a row from every block. Its rows are kept as Arrow slices, some 40 bytes a row
    beside the words, and read once more when the sums are known.
    """
    schema = pa.schema([("block", pa.int64()), ("at", pa.binary()), ("count", pa.binary()), ("top_hash", pa.list_(pa.int64())), ("top_count", pa.list_(pa.int64())), ("top_suffix", pa.list_(pa.int32())), ("tokens", pa.list_(pa.int64())), ("types", pa.list_(pa.int64()))])
    for _, slices in _stretches(batches, "bucket"):
        sums, kept = _Sums(), []
        for b in slices:
            counts = np.concatenate([unpack(c) for c in b["count"].to_pylist()])
            sums.add(_bytes_of(b, "hash", np.uint64), counts, _bytes_of(b, "suffix", np.uint8))
            # a copy, so a slice does not keep the whole of its batch
            kept.append(pa.Table.from_batches([b.select(["block", "at", "hash"])]).take(np.arange(b.num_rows)))
        sums.merge()
        distinct, total, suffix = sums.keys, sums.counts, sums.more
        top = np.lexsort((distinct, -total))[:MOST_TOPS]
        top = top[(np.arange(len(top)) < TOPS) | (total[top] >= OWN_COUNT)]
        tokens = np.bincount(suffix, total, SUFFIXES).astype(np.int64).tolist()
        types = np.bincount(suffix, total > 0, SUFFIXES).astype(np.int64).tolist()
        row = [[None], [None], [None], [distinct[top].view(np.int64).tolist()], [total[top].tolist()], [suffix[top].tolist()], [tokens], [types]]
        yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(row, schema, strict=True)], schema=schema)
        for table in kept:
            for i in range(0, table.num_rows, 64):
                part = table.slice(i, 64)
                each = [np.frombuffer(h, np.uint64) for h in part["hash"].to_pylist()]
                own = np.minimum(total[np.searchsorted(distinct, np.concatenate(each))], 2**32 - 1)
                ends = np.cumsum([len(h) for h in each])
                counts = pa.array([pack(x) for x in np.split(own, ends[:-1])], pa.binary())
                none = [pa.nulls(len(each), f.type) for f in list(schema)[3:]]
                yield pa.RecordBatch.from_arrays([part["block"].combine_chunks(), part["at"].combine_chunks(), counts, *none], schema=schema)


def _suffix(w: Words) -> np.ndarray:
    """The suffix class of every word, from its last two bytes."""
    if not len(w.hash):
        return np.zeros(0, np.int64)
    last = w.data[w.end - 1].astype(np.uint64)
    other = np.where(w.end - w.start > 1, w.data[np.maximum(w.end - 2, 0)], 0).astype(np.uint64)
    return (mix(other * np.uint64(256) + last) % np.uint64(SUFFIXES)).astype(np.int64)


def _classes(hashes: np.ndarray, suffix: np.ndarray, tops: np.ndarray, top_of: np.ndarray) -> np.ndarray:
    """tops: the top words' hashes, sorted; top_of: their classes."""
    own = max(TOPS, len(tops))
    if not len(tops):
        return own + suffix
    at = np.minimum(np.searchsorted(tops, hashes), len(tops) - 1)
    return np.where(tops[at] == hashes, top_of[at], own + suffix)


def _with_ends(classes: np.ndarray, bounds: np.ndarray, n_classes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All documents' classes with their ends, the two classes before each token, and the token each document starts at."""
    docs, end = len(bounds) - 1, n_classes - 1
    starts = bounds[:-1] + np.arange(docs)
    out = np.full(len(classes) + docs, end)
    inside = np.ones(len(out), bool)
    inside[bounds[1:] + np.arange(docs)] = False
    out[inside] = classes
    one = np.concatenate(([end], out[:-1]))
    one[starts] = end
    two = np.concatenate(([end, end], out[:-2]))[: len(out)]
    two[starts] = end
    long = np.diff(bounds) > 0
    two[starts[long] + 1] = end
    return out, two * n_classes + one, starts


def _triples(tops: np.ndarray, top_of: np.ndarray):
    schema = pa.schema([("shard", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary())])
    n_classes = max(TOPS, len(tops)) + SUFFIXES + 1

    def emit(keys: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
        shard = (mix(keys.astype(np.uint64)) % np.uint64(SHARDS)).astype(np.int64)
        order = np.argsort(shard, kind="stable")
        ends = np.searchsorted(shard[order], np.arange(SHARDS + 1))
        rows = [(s, pack(np.diff(keys[i], prepend=0)), pack(counts[i])) for s in range(SHARDS) if len(i := order[ends[s] : ends[s + 1]])]
        return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for block in _blocks(batches):
            w = block.words
            out, context, _ = _with_ends(_classes(w.hash, _suffix(w), tops, top_of), w.bounds, n_classes)
            learn = np.repeat(~block.held, np.diff(w.bounds) + 1)
            k, n = np.unique(context[learn] * n_classes + out[learn], return_counts=True)
            keys, at = np.unique(np.concatenate([keys, k]), return_inverse=True)
            counts = np.bincount(at, np.concatenate([counts, n]), len(keys)).astype(np.int64)
            if len(keys) > 2_000_000:
                yield emit(keys, counts)
                keys, counts = keys[:0], counts[:0]
        if len(keys):
            yield emit(keys, counts)

    return run


def _sum_triples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each shard's triples with their counts in all tasks, added as the rows come."""
    for shard, slices in _stretches(batches, "shard"):
        sums = _Sums()
        for b in slices:
            for keys, counts in zip(b["keys"].to_pylist(), b["counts"].to_pylist(), strict=True):
                keys = np.cumsum(unpack(keys), dtype=np.int64).view(np.uint64)
                sums.add(keys, unpack(counts), np.zeros(len(keys), np.uint8))
        sums.merge()
        yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "keys": [sums.keys.tobytes()], "counts": [sums.counts.tobytes()]})


@dataclass
class Model:
    """First and second context vectors, target vectors (classes x SIZE each) and biases."""

    two: np.ndarray
    one: np.ndarray
    target: np.ndarray
    bias: np.ndarray

    def flat(self) -> np.ndarray:
        return np.concatenate([x.ravel() for x in (self.two, self.one, self.target, self.bias)]).astype(np.float32)

    @staticmethod
    def of(flat: np.ndarray) -> Model:
        n = len(flat) // (3 * SIZE + 1) * SIZE
        return Model(*(flat[i * n : (i + 1) * n].reshape(-1, SIZE).copy() for i in range(3)), flat[3 * n :].copy())

    def before(self, contexts: np.ndarray) -> np.ndarray:
        n = len(self.bias)
        return self.two[contexts // n] + self.one[contexts % n]

    def log10(self, contexts: np.ndarray) -> np.ndarray:
        """Normalised log10 probabilities of all classes after each context."""
        s = self.before(contexts) @ self.target.T + self.bias
        return (s - self.log_sums(contexts)[:, None]) / np.float32(np.log(10))

    def log_sums(self, contexts: np.ndarray) -> np.ndarray:
        """The logarithms of what normalises each context, over all classes."""
        s = self.before(contexts) @ self.target.T
        s += self.bias
        top = s.max(1, keepdims=True)
        s -= top
        return np.log(np.exp(s, out=s).sum(1)) + top[:, 0]

    def log10_of(self, contexts: np.ndarray, out: np.ndarray, log_sums: np.ndarray) -> np.ndarray:
        """Normalised log10 probabilities of one class after each context; log_sums: of all contexts."""
        s = np.empty(len(out), np.float32)
        for i in range(0, len(out), 1 << 15):
            c, t = contexts[i : i + (1 << 15)], out[i : i + (1 << 15)]
            s[i : i + (1 << 15)] = np.einsum("ij,ij->i", self.before(c), self.target[t]) + self.bias[t] - log_sums[c]
        return s / np.float32(np.log(10))


def log_sums(spark: SparkSession, model: Model) -> np.ndarray:
    """Of every pair of classes as context: a matrix product and sum a row of pairs, in tasks; at most (MOST_TOPS + 65)**2 numbers."""
    n, shared = len(model.bias), spark.sparkContext.broadcast(model.flat())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model.of(shared.value)
        for batch in batches:
            two = batch.column(0).to_pylist()
            rows = [own.log_sums(i * n + np.arange(n)).astype(np.float32).tobytes() for i in two]
            yield pa.RecordBatch.from_pydict({"two": pa.array(two, pa.int64()), "sums": pa.array(rows, pa.binary())})

    rows = spark.range(0, n, 1, max(1, n // 32)).mapInArrow(run, "two long, sums binary").collect()
    return np.concatenate([np.frombuffer(r["sums"], np.float32) for r in sorted(rows, key=lambda r: r["two"])])


def first_model(class_counts: np.ndarray) -> Model:
    """Small vectors and the logarithms of the class frequencies: at first, the classes' own distribution."""
    rng = np.random.default_rng(5)
    vectors = [rng.normal(0, 0.1, (len(class_counts), SIZE)).astype(np.float32) for _ in range(3)]
    return Model(*vectors, np.log((class_counts + 1) / (class_counts + 1).sum()).astype(np.float32))


def passes(counts: np.ndarray, least: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """Places of triples in a random order, and their weights: as many whole passes as give `least` rows, one at least.

    A triple above the mean count stands several times, with its count shared out, so no step hangs on one triple. Over
    a pass the weights of each triple sum to its count, in units of the mean over rows.
    """
    copies = np.ceil(counts * (len(counts) / counts.sum())).astype(np.int64)
    rows = int(copies.sum())
    at = np.tile(np.repeat(np.arange(len(counts)), copies), -(-least // rows))
    rng.shuffle(at)
    return at, (counts / copies * (rows / counts.sum()))[at].astype(np.float32)


def _sums(rows: np.ndarray, grads: np.ndarray, n: int) -> np.ndarray:
    """n x columns: the sums of the gradients of each row of parameters."""
    width = grads.shape[1]
    cells = (rows[:, None] * width + np.arange(width)).ravel()
    return np.bincount(cells, grads.ravel(), n * width).reshape(n, width).astype(np.float32)


def steps(model: Model, keys: np.ndarray, counts: np.ndarray, noise: np.ndarray, draws: int, seed: int) -> Model:
    """Noise-contrastive estimation by AdaGrad in whole passes over the counted triples, of at least `draws` rows
    together; noise: the classes' distribution. Biases go with the target vectors as their last column."""
    rng = np.random.default_rng(seed)
    n = len(noise)
    params = [model.two, model.one, np.concatenate([model.target, model.bias[:, None]], 1)]
    state = [np.full_like(p, 1e-2) for p in params]
    two_of, one_of, target = params
    picked, weights = passes(counts, draws, rng)
    draw = np.cumsum(noise)
    often_log = np.log(NOISE * noise + 1e-12).astype(np.float32)
    half = np.float32(0.5)
    h = np.ones((BATCH, SIZE + 1), np.float32)

    for i in range(0, len(picked), BATCH):
        k, w = keys[picked[i : i + BATCH]], weights[i : i + BATCH] / np.float32(BATCH)
        context, t = np.divmod(k, n)
        two, one = np.divmod(context, n)
        z, often = np.unique(np.minimum(np.searchsorted(draw, rng.random(NOISE)), n - 1), return_counts=True)
        h = h[: len(k)]
        np.add(two_of[two], one_of[one], out=h[:, :SIZE])
        right, wrong = target[t], target[z]
        # 1 - sigmoid(x) and sigmoid(x) by tanh, which cannot overflow
        g = w * (half - half * np.tanh(half * (np.einsum("ij,ij->i", h, right) - often_log[t])))
        gz = h @ wrong.T
        gz -= often_log[z]
        gz *= half
        np.tanh(gz, out=gz)
        gz += 1
        gz *= w[:, None] * (-half * often.astype(np.float32))
        right *= g[:, None]
        dh = gz @ wrong
        dh += right
        moved = (_sums(two, dh[:, :SIZE], n), _sums(one, dh[:, :SIZE], n), _sums(t, g[:, None] * h, n))
        moved[2][z] += gz.T @ h
        for p_, q_, grad in zip(params, state, moved, strict=True):
            q_ += grad * grad
            p_ += np.float32(RATE) * grad / np.sqrt(q_)
    return Model(two_of, one_of, target[:, :SIZE].copy(), target[:, SIZE].copy())


def train(triples: DataFrame, class_counts: np.ndarray) -> Model:
    """triples: shard, keys, counts. Units step from the same model; a round ends with the mean, weighted by their counts."""
    spark = triples.sparkSession
    model = first_model(class_counts)
    noise = ((class_counts + 1) / (class_counts + 1).sum()).astype(np.float64)
    distinct = (triples.agg(F.sum(F.octet_length("keys"))).first()[0] or 0) // 8
    total = int(class_counts.sum())  # one triple ends at each token
    units = 1
    while units < SHARDS and distinct > units * DRAWS:
        units *= 2
    dealt = triples.withColumn("unit", F.pmod("shard", F.lit(units))).repartition(units, "unit").sortWithinPartitions("unit", "shard")
    for i in range(ROUNDS):
        now = spark.sparkContext.broadcast(model.flat())

        def run(batches: Iterator[pa.RecordBatch], now=now, i=i) -> Iterator[pa.RecordBatch]:
            summed = None
            for unit, rows in runs(batches, "unit"):
                keys = np.concatenate([np.frombuffer(r["keys"], np.int64) for r in rows])
                counts = np.concatenate([np.frombuffer(r["counts"], np.int64) for r in rows])
                done = steps(Model.of(now.value), keys, counts, noise, DRAWS, 1000 * i + unit)
                share = counts.sum() / total
                own = np.rint(done.flat() * (share / GRAIN)).astype(np.int64)
                summed = own if summed is None else summed + own
            if summed is not None:
                yield pa.RecordBatch.from_pydict({"model": pa.array([summed.tobytes()], pa.binary())})

        # at most SHARDS tasks, each with one model, whatever the input
        parts = dealt.mapInArrow(run, "model binary").collect()
        if parts:
            model = Model.of((sum(np.frombuffer(p["model"], np.int64) for p in parts) * GRAIN).astype(np.float32))
    return model


def _coded(tops: np.ndarray, top_of: np.ndarray):
    schema = pa.schema([("block", pa.int64()), ("ids", pa.list_(pa.int64())), ("held", pa.binary()), ("sizes", pa.binary()), ("codes", pa.binary()), ("classes", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches):
            w = block.words
            distinct, first, number = _local(w)
            classes = _classes(distinct, _suffix(w)[first], tops, top_of).astype(np.uint16)
            row = [[block.key], [block.ids.to_pylist()], [block.held.tobytes()], [pack(np.diff(w.bounds))], [pack(number)], [classes.tobytes()]]
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(row, schema, strict=True)], schema=schema)

    return run


def _score(shared: Broadcast, tokens: int, types: int, ends: int, class_tokens: np.ndarray, class_types: np.ndarray):
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])

    def run(documents: pa.Table, counted: pa.Table) -> pa.Table:
        flat, sums = shared.value
        model = Model.of(flat)
        rows, made = counted.to_pylist(), []
        for d in documents.to_pylist():
            classes = np.frombuffer(d["classes"], np.uint16).astype(np.int64)
            c = np.full(len(classes), -1, np.int64)
            for r in rows:
                c[np.cumsum(unpack(r["at"]), dtype=np.int64)] = unpack(r["count"])
            if len(c) and c.min() < 0:
                raise RuntimeError("blocks of two reads differ: the input changed between them")
            bounds = np.concatenate(([0], np.cumsum(unpack(d["sizes"]), dtype=np.int64)))
            number = unpack(d["codes"]).astype(np.int64)
            out, context, starts = _with_ends(classes[number], bounds, len(class_tokens))
            words_at = np.ones(len(out), bool)
            words_at[bounds[1:] + np.arange(len(starts))] = False
            seen = np.full(len(out), ends, np.int64)
            seen[words_at] = c[number]
            base = np.log10(seen + 1.0) - np.log10(tokens + types + 1.0)
            inside = np.log10(c + 1.0) - np.log10(class_tokens[classes] + class_types[classes] + 1.0)
            inside[classes < len(class_tokens) - SUFFIXES - 1] = 0
            score = np.zeros(len(out))
            score[words_at] = inside[number]
            score += model.log10_of(context, out, sums)
            total = lambda x: np.add.reduceat(x, starts)
            made.append(pa.table([pa.array(d["ids"], pa.int64()), pa.array(np.frombuffer(d["held"], bool)), pa.array(np.diff(bounds) + 1), pa.array(total((seen > 0).astype(np.int64))), pa.array(total(base)), pa.array(total(score))], schema=schema))
        if not made:
            raise RuntimeError("blocks of two reads differ: the input changed between them")
        return pa.concat_tables(made)

    return run


def score(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row of docs."""
    spark = docs.sparkSession
    small_batches(spark)
    doc_id = F.col("doc_id").cast("long")
    texts = settled(docs.select(doc_id.alias("doc_id"), held_out(doc_id).alias("held"), F.col("text").cast("string").alias("text")))
    all_, ends = texts.select("held").agg(F.count("*"), F.count_if(~F.col("held"))).first()
    buckets = max(FEWEST_BUCKETS, 1 << (all_ // BUCKET_DOCS).bit_length())
    counted = texts.mapInArrow(_word_counts(buckets), "bucket int, block long, at binary, hash binary, suffix binary, count binary")
    counted = counted.repartition("bucket").sortWithinPartitions("bucket")
    counted = staged(counted.mapInArrow(_sum_words, "block long, at binary, count binary, top_hash array<long>, top_count array<long>, top_suffix array<int>, tokens array<long>, types array<long>"))
    per_class = counted.filter("block IS NULL").select(F.posexplode(F.arrays_zip("tokens", "types")).alias("class", "n")).groupBy("class").agg(F.sum("n.tokens"), F.sum("n.types")).collect()
    tops = counted.filter("block IS NULL").select(F.explode(F.arrays_zip("top_hash", "top_count", "top_suffix")).alias("t")).select("t.*").filter("top_count > 0")
    tops = tops.orderBy(F.desc("top_count"), "top_hash").limit(MOST_TOPS).collect()  # at most MOST_TOPS words
    tops = [t for i, t in enumerate(tops) if i < TOPS or t["top_count"] >= OWN_COUNT]
    own = max(TOPS, len(tops))
    class_tokens, class_types = np.zeros(own + SUFFIXES + 1, np.int64), np.zeros(own + SUFFIXES + 1, np.int64)
    for k, n, v in per_class:
        class_tokens[own + k], class_types[own + k] = n, v
    tokens, types = int(class_tokens.sum()) + ends, int(class_types.sum()) + (ends > 0)
    for i, t in enumerate(tops):
        class_tokens[i], class_types[i] = t["top_count"], 1
        class_tokens[own + t["top_suffix"]] -= t["top_count"]
        class_types[own + t["top_suffix"]] -= 1
    class_tokens[-1], class_types[-1] = ends, 1
    hashes = np.array([t["top_hash"] for t in tops], np.int64).view(np.uint64)
    order = np.argsort(hashes)
    triples = texts.mapInArrow(_triples(hashes[order], order), "shard int, keys binary, counts binary")
    triples = staged(triples.repartition("shard").sortWithinPartitions("shard").mapInArrow(_sum_triples, "shard int, keys binary, counts binary"))
    model = train(triples, class_tokens)
    freed(triples)
    coded = texts.mapInArrow(_coded(hashes[order], order), "block long, ids array<long>, held binary, sizes binary, codes binary, classes binary")
    lists = counted.filter("block IS NOT NULL").select("block", "at", "count")
    shared = spark.sparkContext.broadcast((model.flat(), log_sums(spark, model)))
    run = _score(shared, tokens, types, ends, class_tokens, class_types)
    scored = coded.groupBy("block").cogroup(lists.groupBy("block")).applyInArrow(run, "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return scored.withColumn("train_tokens", F.lit(tokens).cast("long"))
