"""Exact nearest binary codes by incremental multi-index hashing.

Each 64-bit code is cut into four 16-bit segments, and a table for each segment lists the codes by its value. If two
codes differ in at most 4r + 3 bits, some segment of theirs differs in at most r. So a search looks up, for r = 0, 1,
..., the segment values at distance r from the query's in all four tables, verifies the codes found by their full
distance, and ends once the k-th verified distance is at most 4r + 3: nothing unseen can be nearer.

The tables lie over the cluster: a code goes to four groups, each named by a segment and the leading bits of its value,
so many bits that a group holds some SHARD codes; a group that holds more is cut into chunks by hash. In each round
the queries that are not covered yet go to the groups that their next radii reach, and nowhere else; the k best found
are kept for each query, and covered queries ask no more. Equal codes are one entry with its k smallest ids, so copies
never multiply.

Defined cases: a null, NaN, zero or negative element is bit 0, missing elements too, elements from the 65th on are
not used; null vectors and null ids are neither found nor queries. Equal distances are ranked by id. A row is not its
own neighbour; rows that repeat an id count once for each distinct code. Empty tables give an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import freed, small_batches, staged

SEGMENTS, BITS = 4, 16
#: Codes of a group or chunk, and queries that meet it in one row.
SHARD, BLOCK = 1 << 16, 512
#: The radii of each round; the first two rounds take two, as they cost less than a round does.
ROUNDS = [(0, 1), (2, 3), *[(r,) for r in range(4, BITS + 1)]]

_RING = [np.flatnonzero(np.bitwise_count(np.arange(1 << BITS, dtype=np.uint32)) == r).astype(np.uint32) for r in range(BITS + 1)]


def code(vector: str) -> Column:
    """The signs of a vector's first 64 elements as a bigint, the first element's the highest bit."""
    bits = f"transform(sequence(0, 63), i -> CASE WHEN NOT isnan(get({vector}, i)) AND get({vector}, i) > 0 THEN 1L ELSE 0L END)"
    return F.expr(f"CASE WHEN {vector} IS NOT NULL THEN aggregate({bits}, 0L, (s, b) -> shiftleft(s, 1) | b) END")


class Table:
    """One segment's table of a group: for each value the positions of the codes that have it."""

    def __init__(self, codes: np.ndarray, firsts: np.ndarray, segment: int):
        self.codes, self.firsts, self.shift = codes, firsts, np.uint64(BITS * segment)
        value = self.value(codes)
        self.order = np.argsort(value, kind="stable")
        self.start = np.searchsorted(value[self.order], np.arange((1 << BITS) + 1))

    def value(self, codes: np.ndarray) -> np.ndarray:
        return ((codes >> self.shift) & np.uint64((1 << BITS) - 1)).astype(np.int64)

    def nearest(self, query: np.uint64, radii: tuple[int, ...], k: int) -> tuple[np.ndarray, np.ndarray]:
        """Positions and distances of the k nearest among the codes whose segment is at one of the radii."""
        values = int(self.value(np.array([query]))[0]) ^ np.concatenate([_RING[r] for r in radii])
        a = self.start[values]
        n = self.start[values + 1] - a
        full = n > 0
        a, n = a[full], n[full]
        ends = np.cumsum(n)
        at = self.order[np.repeat(a - ends + n, n) + np.arange(n.sum())]
        far = np.bitwise_count(self.codes[at] ^ query).astype(np.int32)
        if len(at) > k:
            close = far <= np.partition(far, k - 1)[k - 1]
            at, far = at[close], far[close]
        best = np.lexsort((self.firsts[at], far))[:k]
        return at[best], far[best]


def _search(k: int, radii: tuple[int, ...]):
    schema = pa.schema([("query", pa.int64()), ("code", pa.int64()), ("distance", pa.int32()), ("first", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, table = None, None
        for batch in batches:
            for i in range(batch.num_rows):
                lists = {c: batch.column(c)[i].values.to_numpy() for c in ("codes", "firsts", "queries")}
                key = tuple(batch.column(c)[i].as_py() for c in ("segment", "group", "chunk"))
                if key != last:
                    last, table = key, Table(lists["codes"].view(np.uint64), lists["firsts"], key[0])
                queries = lists["queries"]
                found = [table.nearest(q, radii, k) for q in queries.view(np.uint64)]
                at, far = (np.concatenate([x[j] for x in found]) for j in (0, 1))
                arrays = [np.repeat(queries, [len(x[0]) for x in found]), table.codes[at].view(np.int64), far, table.firsts[at]]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in arrays], schema=schema)

    return run


def _leading(codes: DataFrame, bits: int, flips: list[int]) -> DataFrame:
    """Each code's four segments and their groups, with the group's bits flipped in each of the given ways."""
    value = "shiftright(shiftright(code, 16 * segment) & 65535L, {}) ^ flip"
    rows = codes.withColumn("segment", F.explode(F.array(*[F.lit(j) for j in range(SEGMENTS)]))).withColumn("flip", F.explode(F.array(*[F.lit(x).cast("long") for x in flips])))
    return rows.withColumn("group", F.expr(value.format(BITS - bits)).cast("int")).drop("flip")


def search(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """vectors, queries: id, code. Returns query_id, rank (1..k), id, distance: the k nearest of the others."""
    small_batches(vectors.sparkSession)
    wanted = k + 1  # a query may find itself
    rows = vectors.filter("id IS NOT NULL AND code IS NOT NULL").select("id", "code").distinct()
    rows = rows.withColumn("nth", F.row_number().over(Window.partitionBy("code").orderBy("id"))).filter(F.col("nth") <= wanted)
    index = staged(rows.groupBy("code").agg(F.array_sort(F.collect_list("id")).alias("ids")))  # at most k + 1 ids a code
    asked = staged(queries.filter("id IS NOT NULL AND code IS NOT NULL").select("id", "code").distinct())
    n, bits = index.count(), 0
    while bits < BITS and n > SHARD << bits:
        bits += 1
    least = min(wanted, n)

    entries = _leading(index.select("code", F.col("ids")[0].alias("first")), bits, [0])
    # one row a group, 4 * 2**16 at most
    sizes = staged(entries.groupBy("segment", "group").agg(F.ceil(F.count("*") / SHARD).cast("int").alias("chunks")))
    place = ["segment", "group", "chunk"]
    tables = entries.join(F.broadcast(sizes), ["segment", "group"]).withColumn("chunk", F.pmod(F.xxhash64("code"), "chunks").cast("int"))
    tables = tables.groupBy(*place).agg(F.sort_array(F.collect_list(F.struct("code", "first"))).alias("all"))
    tables = staged(tables.select(*place, F.col("all.code").alias("codes"), F.col("all.first").alias("firsts")))

    pending, best = staged(asked.select("code").distinct()), None
    best_of = Window.partitionBy("query").orderBy("distance", "first")
    for radii in ROUNDS:
        flips = [x for x in range(1 << bits) if any(0 <= r - x.bit_count() <= BITS - bits for r in radii)]
        sent = _leading(pending, bits, flips).join(F.broadcast(sizes), ["segment", "group"])
        # a group's queries go in as many blocks as they fill, so its table is copied once for each of those alone
        blocks = staged(_leading(pending, bits, flips).groupBy("segment", "group").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")))
        sent = sent.join(F.broadcast(blocks), ["segment", "group"]).withColumn("block", F.pmod(F.xxhash64("code", F.lit(3)), "blocks").cast("int"))  # one row a group
        sent = sent.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
        sent = sent.groupBy(*place, "block").agg(F.collect_list("code").alias("queries"))
        near = sent.join(tables, place).select(*place, "codes", "firsts", "queries").mapInArrow(_search(wanted, radii), "query long, code long, distance int, first long")
        near = near if best is None else near.unionByName(best)
        near = near.dropDuplicates(["query", "code"]).withColumn("nth", F.row_number().over(best_of)).filter(F.col("nth") <= wanted).drop("nth")
        before, best = best, staged(near)
        covered = best.groupBy("query").agg(F.count("*").alias("found"), F.max("distance").alias("farthest"))
        near_enough = (F.col("farthest") < SEGMENTS * (radii[-1] + 1)) | F.lit(least == n)  # with all codes found, none is unseen
        covered = covered.filter((F.col("found") >= least) & near_enough)
        left = staged(pending.join(covered.select(F.col("query").alias("code")), "code", "left_anti"))
        freed(pending, blocks, *([before] if before is not None else []))
        pending = left
        if pending.isEmpty():
            break
    near = best.join(index, "code").select("query", "distance", F.explode("ids").alias("id"))
    mine = asked.select(F.col("id").alias("query_id"), F.col("code").alias("query"))
    ranked = near.join(mine, "query").filter("id <> query_id")
    order = Window.partitionBy("query_id").orderBy("distance", "id")
    return ranked.select("query_id", F.row_number().over(order).alias("rank"), "id", "distance").filter(F.col("rank") <= k)
