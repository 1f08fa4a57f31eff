"""Ranked lexical search by range-maximum queries over posting lists, best intervals of documents first.

Documents are read once for the terms of the queries alone; what stays is, for each document, its number of terms and
how often it holds each query term. Sums over that table give the weights. Then every task of a second pass builds
shards of at most SHARD_POSTINGS postings or so: posting lists of impacts, documents in the order of their lengths, and
over the lists a sparse table of the places of their maxima. A query starts with one interval, that of all documents of
the shard. An interval's bound is the sum, over the query's terms, of the greatest impact inside (one range-maximum
query each), by weight. The intervals of the highest bounds come first: a long one is split at the document of the
greatest weighted impact in it, which is scored; one of at most LEAF documents is scored whole. An interval whose bound
is below the k-th best score so far is never opened. Last, the best k of all tasks are merged.

Nothing is dealt by term, so a term that every document holds makes no group. Queries are taken in blocks of about
BLOCK_TERMS terms, each broadcast and run over all documents; the driver never holds more than one block.

Defined cases: null texts have no term; documents and queries without terms give no rows. Null ids rank after others of
equal score. Rows that repeat an id are documents of their own, and queries that repeat one are queries of their own.
Terms are told apart by 64-bit hashes. Columns other than the id and the text are never read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .store import small_batches, staged
from .words import words

#: Terms of a block of queries, with repeats over queries; a longer query is a block of its own.
BLOCK_TERMS = 200_000
SHARD_POSTINGS, SHARD_DOCS = 1 << 20, 1 << 16
#: Documents of an interval that is scored whole, and how many (interval, term) pairs are worked on at a time.
LEAF, AT_ONCE = 16, 1 << 15

_BETWEEN = np.ones(256, bool)
for _a, _b in (("0", "9"), ("A", "Z"), ("a", "z")):
    _BETWEEN[ord(_a) : ord(_b) + 1] = False
_BETWEEN[128:] = False


@dataclass
class Block:
    """Queries laid end to end: of query i, terms[at[i]:at[i+1]] (places in `hashes`, rising) and how often each stands there."""

    hashes: np.ndarray
    at: np.ndarray
    terms: np.ndarray
    repeats: np.ndarray


def blocks_of(queries: DataFrame, most: int | None = None) -> Iterator[tuple[list, Block]]:
    """(ids, block) for runs of queries; queries has the columns item_id and text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, n = [], []
            for w in words(batch.column(1), between=_BETWEEN):
                for a, b in zip(w.bounds[:-1].tolist(), w.bounds[1:].tolist(), strict=True):
                    h, c = np.unique(w.hash[a:b], return_counts=True)
                    found.append(h.view(np.int64))
                    n.append(c.astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int64())), pa.array(n, pa.list_(pa.int32()))], names=["item_id", "hashes", "repeats"])

    kind = queries.schema["item_id"].dataType
    schema = T.StructType([T.StructField("item_id", kind), T.StructField("hashes", T.ArrayType(T.LongType())), T.StructField("repeats", T.ArrayType(T.IntegerType()))])
    rows = queries.select("item_id", F.col("text").cast("string")).mapInArrow(run, schema).filter("size(hashes) > 0")

    def block(of: list) -> tuple[list, Block]:
        every = np.concatenate([np.array(r["hashes"], np.int64).view(np.uint64) for r in of])
        hashes, terms = np.unique(every, return_inverse=True)
        at = np.concatenate([[0], np.cumsum([len(r["hashes"]) for r in of])])
        return [r["item_id"] for r in of], Block(hashes, at, terms.astype(np.int64), np.concatenate([np.array(r["repeats"], np.int64) for r in of]))

    held, size = [], 0
    for r in rows.toLocalIterator():
        if held and size + len(r["hashes"]) > (most or BLOCK_TERMS):
            yield block(held)
            held, size = [], 0
        held.append(r)
        size += len(r["hashes"])
    if held:
        yield block(held)


def counted(docs: DataFrame, block: Block) -> DataFrame:
    """doc_id, n (terms with repeats), terms, counts: of each document with a term, which of the block's terms it holds how often."""
    shared = docs.sparkSession.sparkContext.broadcast(block.hashes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = shared.value
        for batch in batches:
            for w in words(batch.column(1), between=_BETWEEN):
                size = np.diff(w.bounds)
                place = np.minimum(np.searchsorted(hashes, w.hash), len(hashes) - 1)
                hit = np.flatnonzero(hashes[place] == w.hash)
                doc = np.repeat(np.arange(len(size)), size)[hit]
                key, n = np.unique(doc * len(hashes) + place[hit], return_counts=True)
                at = pa.array(np.searchsorted(key, np.arange(len(size) + 1) * len(hashes)), pa.int32())
                lists = [pa.ListArray.from_arrays(at, pa.array(x.astype(np.int32))) for x in (key % len(hashes), n)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(w.first, len(size)), pa.array(size, pa.int64()), *lists], names=["doc_id", "n", "terms", "counts"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n long, terms array<int>, counts array<int>").filter("n > 0")


def _holders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    df = np.zeros(0, np.int64)
    for batch in batches:
        own = np.bincount(batch.column(0).flatten().to_numpy(), minlength=len(df))
        own[: len(df)] += df
        df = own
    term = np.flatnonzero(df)
    yield pa.RecordBatch.from_arrays([pa.array(term, pa.int32()), pa.array(df[term], pa.int64())], names=["term", "df"])


class Shard:
    """Posting lists of some documents, laid end to end in the order of terms, each in the order of the documents.

    table[j][i] is the place of the greatest impact among the postings i .. i + 2**j - 1; it is only asked for inside one list.
    """

    def __init__(self, n_terms: int, n_docs: int, term: np.ndarray, doc: np.ndarray, impact: np.ndarray):
        order = np.argsort(term * n_docs + doc)
        self.n_docs, self.doc, self.impact = n_docs, doc[order].astype(np.int32), impact[order]
        self.key = term[order] * n_docs + doc[order]
        self.first = np.searchsorted(self.key, np.arange(n_terms + 1) * n_docs)
        most = int(np.diff(self.first).max(initial=0))
        rows = [np.arange(len(doc), dtype=np.int32)]
        while 2 ** len(rows) <= most:
            last, half = rows[-1], 2 ** (len(rows) - 1)
            row = last.copy()
            a, b = last[:-half], last[half:]
            row[:-half] = np.where(self.impact[b] > self.impact[a], b, a)
            rows.append(row)
        self.table = np.stack(rows)

    def _greatest(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Greatest impact and its place for the postings a .. b - 1; 0 for an empty range."""
        some = b > a
        level = np.frexp(np.maximum(b - a, 1))[1] - 1
        p = self.table[level, np.where(some, a, 0)]
        q = self.table[level, np.where(some, b - (1 << level), 0)]
        place = np.where(self.impact[q] > self.impact[p], q, p)
        return np.where(some, self.impact[place], 0), place

    def _bounds(self, a: np.ndarray, b: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bound of each interval, and the document of the greatest weighted impact in it."""
        most, place = self._greatest(a, b)
        most = most * weights
        top = most.argmax(1)
        return most.sum(1), self.doc[place[np.arange(len(top)), top]].astype(np.int64)

    def _whole(self, lo: np.ndarray, hi: np.ndarray, a: np.ndarray, b: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Scores of all documents of the intervals."""
        base = np.cumsum(hi - lo) - (hi - lo)
        size = (b - a).ravel()
        at = np.repeat(a.ravel() - (np.cumsum(size) - size), size) + np.arange(size.sum())
        slot = self.doc[at] + np.repeat(np.repeat(base - lo, a.shape[1]), size)
        scores = np.zeros(int((hi - lo).sum()), np.int64)
        np.add.at(scores, slot, self.impact[at] * np.repeat(np.tile(weights, len(lo)), size))
        return scores, np.repeat(lo - base, hi - lo) + np.arange(len(scores))

    def search(self, terms: np.ndarray, weights: np.ndarray, k: int, least: int, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Scores and documents of the best k whose score is `least` at least; of equal ones those of the smallest rank."""
        a, b = self.first[terms], self.first[terms + 1]
        live = (b > a) & (weights > 0)
        terms, weights, a, b = terms[live], weights[live], a[live][None], b[live][None]
        scores, docs = np.zeros(0, np.int64), np.zeros(0, np.int64)
        if not len(terms):
            return scores, docs
        lo, hi, width, widest = np.array([0]), np.array([self.n_docs]), 8, max(8, AT_ONCE // len(terms))
        bound, split = self._bounds(a, b, weights)
        while True:
            if not (open_ := bound >= least).all():
                lo, hi, a, b, bound, split = (x[open_] for x in (lo, hi, a, b, bound, split))
            if not len(lo):
                return scores, docs
            first = np.argpartition(-bound, width)[:width] if len(lo) > width else np.arange(len(lo))
            short = hi[first] - lo[first] <= LEAF
            w, s = first[short], first[~short]
            got, at = self._whole(lo[w], hi[w], a[w], b[w], weights)
            # the split documents: their postings, and the intervals on both sides
            r = np.searchsorted(self.key, terms * self.n_docs + split[s, None])
            here = (r < b[s]) & (self.doc[np.minimum(r, len(self.doc) - 1)] == split[s, None])
            own = (np.where(here, self.impact[np.minimum(r, len(self.doc) - 1)], 0) * weights).sum(1)
            sides = [np.concatenate(x) for x in ((lo[s], split[s] + 1), (split[s], hi[s]), (a[s], r + here), (r, b[s]))]
            more, parts = self._bounds(sides[2], sides[3], weights) if len(s) else (own, own)
            # the best k so far
            scores, docs = np.concatenate([scores, got, own]), np.concatenate([docs, at, split[s]])
            if (good := scores >= least).sum() < len(scores):
                scores, docs = scores[good], docs[good]
            best = np.lexsort((rank[docs], -scores))[:k]
            scores, docs = scores[best], docs[best]
            least = max(least, int(scores[-1])) if len(scores) == k else least
            rest = np.ones(len(lo), bool)
            rest[first] = False
            lo, hi, a, b, bound, split = (np.concatenate([x[rest], y]) for x, y in zip((lo, hi, a, b, bound, split), (*sides, more, parts), strict=True))
            width = min(2 * width, widest)


def _best(ids: np.ndarray, none: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    return np.lexsort((ids, none, -scores))[:k]


def _ranked(found: DataFrame, block: Block, n: int, total: int, weights: np.ndarray, k: int) -> DataFrame:
    """item, doc_id, score: the best k of the task for every query of the block."""
    shared = found.sparkSession.sparkContext.broadcast((block, weights))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, weights = shared.value
        queries = len(block.at) - 1
        best = [(np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.int64))] * queries

        def search(held: list[tuple]) -> None:
            size = np.concatenate([x[2] for x in held])
            new = np.argsort(size, kind="stable")  # documents by length
            ids, none = np.concatenate([x[0] for x in held])[new], np.concatenate([x[1] for x in held])[new]
            place = np.empty(len(new), np.int64)
            place[new] = np.arange(len(new))
            own = np.concatenate([x[3] for x in held])
            doc = np.repeat(np.arange(len(new)), own)
            term, tf = np.concatenate([x[4] for x in held]).astype(np.int64), np.concatenate([x[5] for x in held]).astype(np.int64)
            m = 100 - 25 + (25 * size * n) // total
            shard = Shard(len(block.hashes), len(new), term, place[doc], (1_000_000_000 * tf) // (1000 * tf + 12 * m[doc]))
            rank = np.empty(len(new), np.int64)
            rank[np.lexsort((ids, none))] = np.arange(len(new))
            for q in range(queries):
                at = slice(block.at[q], block.at[q + 1])
                before = best[q]
                least = int(before[2][-1]) if len(before[2]) == k else 1
                scores, docs = shard.search(block.terms[at], weights[block.terms[at]] * block.repeats[at], k, least, rank)
                both = [np.concatenate(x) for x in zip(before, (ids[docs], none[docs], scores), strict=True)]
                keep = _best(*both, k)
                best[q] = tuple(x[keep] for x in both)

        held, postings, n_docs = [], 0, 0
        for batch in batches:
            terms = batch.column("terms")
            ids = batch.column("doc_id")
            held.append((ids.fill_null(0).to_numpy(), ids.is_null().to_numpy(zero_copy_only=False), batch.column("n").to_numpy(), np.diff(terms.offsets.to_numpy()), terms.flatten().to_numpy(), batch.column("counts").flatten().to_numpy()))
            postings += len(held[-1][4])
            n_docs += len(ids)
            if postings >= SHARD_POSTINGS or n_docs >= SHARD_DOCS:
                search(held)
                held, postings, n_docs = [], 0, 0
        if n_docs:
            search(held)
        for q, (ids, none, scores) in enumerate(best):
            if len(ids):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), q), pa.int32()), pa.array(ids, pa.int64(), mask=none), pa.array(scores, pa.int64())], names=["item", "doc_id", "score"])

    return found.mapInArrow(run, "item int, doc_id long, score long")


def search(docs: DataFrame, queries: DataFrame, k: int = 20) -> DataFrame:
    """item_id, rank, doc_id, score: the k best documents of each query, of positive score, equal ones by rising id."""
    spark = docs.sparkSession
    small_batches(spark)
    kind, out = queries.schema["item_id"].dataType, None
    schema = T.StructType([T.StructField("item", T.IntegerType()), T.StructField("item_id", kind)])
    for ids, block in blocks_of(queries):
        found = staged(counted(docs, block))
        sums = found.agg(F.count("*").alias("n"), F.sum("n").alias("total")).first()
        if not sums["n"]:
            continue
        df = np.zeros(len(block.hashes), np.int64)
        for r in found.select("terms").mapInArrow(_holders, "term int, df long").groupBy("term").agg(F.sum("df").alias("df")).collect():
            df[r["term"]] = r["df"]
        weights = np.array([math.floor(1000 * math.log((2 * sums["n"] + 2) / (2 * x + 1))) for x in df.tolist()], np.int64)
        rows = _ranked(found, block, sums["n"], sums["total"], weights, k)
        best = rows.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))).filter(F.col("rank") <= k)
        names = spark.createDataFrame(list(enumerate(ids)), schema)
        one = best.join(F.broadcast(names), "item").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")  # one row a query of the block
        out = one if out is None else out.unionAll(one)
    return spark.createDataFrame([], T.StructType([T.StructField("item_id", kind), T.StructField("rank", T.IntegerType()), T.StructField("doc_id", T.LongType()), T.StructField("score", T.LongType())])) if out is None else out
