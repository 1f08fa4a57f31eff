"""Near-duplicate groups by MinHash bands and odd sketches, confirmed on full shingle sets.

1. Each text becomes a set of 5-word shingles (64-bit hashes). Texts of equal sets form a class; from here on one
   row, the smallest id, stands for each class, so exact copies never meet in a bucket.
2. 125 MinHash values in 25 bands of 5 give buckets: two sets of likeness 0.85 share none of them with a chance of
   4e-7, of likeness 0.80 with one of 5e-5. The 1024 smallest hashes of a set (all of a smaller set) are folded into a parity bitmap of 2048 bits; the
   population count of two bitmaps' XOR estimates the sets' difference to within a few elements, and never exceeds it.
3. In each bucket every member is paired with the smallest one; pairs whose sketches leave room for the wanted
   likeness are confirmed on the full sets, and confirmed links joined into components.
4. Buckets that still hold more than one component are searched in full, but only between components: small ones by
   a join, larger ones in blocks of members against blocks, compared with numpy, so no task holds a whole bucket. Of the
   pairs in a block that the sketches let through, the likeliest that join the components are confirmed first; whatever
   pairs are left between components that are still apart are confirmed after that. Nothing is capped.

Defined cases: a null or empty text has an empty set and no links; 1 to 4 words are one shingle. Rows of the same
doc_id share a component; a null doc_id has a null component and is kept. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected
from .store import freed, small_batches, staged
from .words import Words, mix, powers, words

SHINGLE = 5
BANDS, ROWS = 25, 5
SAMPLE, BITS = 1024, 2048
#: Where a set of more than SAMPLE shingles is estimated from a sample, its likeness may fall short of the wanted one by
#: this much (five deviations) before a pair is dropped. Smaller sets need no slack: parities never show more elements
#: in one set alone than there are.
SLACK = 0.12
#: Buckets up to the first size are searched by a join, larger ones in blocks of as many members as the second.
SMALL, BLOCK = 12, 256
#: Ids broadcast at most; beyond it the tables are joined by a shuffle.
BROADCAST_IDS = 1_000_000

_FACTORS = np.random.default_rng(977).integers(1, 2**63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ORDER = mix(np.arange(11, 11 + SHINGLE, dtype=np.uint64)) | np.uint64(1)


def shingle_sets(column: pa.Array, width: int = SHINGLE) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of every text of a column, in order."""
    order = _ORDER if width == SHINGLE else mix(np.arange(11, 11 + width, dtype=np.uint64)) | np.uint64(1)
    for w in words(column):
        n = len(w.hash) - width + 1
        runs = np.zeros(0, np.uint64)
        if n > 0:
            runs = w.hash[:n] * order[0]
            for j in range(1, width):
                runs += w.hash[j : n + j] * order[j]
            runs = mix(runs)
        for a, b in zip(w.bounds[:-1].tolist(), w.bounds[1:].tolist(), strict=True):
            if b - a >= width:
                yield np.unique(runs[a : b - width + 1])
            elif b > a:
                yield _whole(w, a, b)
            else:
                yield runs[:0]


def _whole(w: Words, a: int, b: int) -> np.ndarray:
    h = (w.hash[a:b] * powers(b - a + 1)[1:]).sum(dtype=np.uint64) + np.uint64(b - a)
    return mix(mix(np.array([h], np.uint64)))


def minhash(s: np.ndarray) -> np.ndarray:
    low = np.full(len(_FACTORS), np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(s), 1024):
        np.minimum(low, (s[i : i + 1024, None] * _FACTORS).min(0), out=low)
    return low


def odd_sketch(s: np.ndarray) -> np.ndarray:
    """32 words of 64 bits: the parity of the number of sampled hashes that fall on each bit."""
    if len(s) > SAMPLE:
        s = np.partition(s, SAMPLE - 1)[:SAMPLE]
    odd = np.bincount((s & np.uint64(BITS - 1)).astype(np.int64), minlength=BITS) & 1
    return np.packbits(odd.astype(bool), bitorder="little").view(np.int64)


def difference(odd_bits):
    """Sampled elements in one set but not in the other, from the XOR's population count."""
    return -BITS / 2 * np.log1p(-2 * np.minimum(odd_bits, BITS / 2 - 1) / BITS)


def likeness(odd_bits, n, m):
    """Estimated Jaccard likeness of two sets of n and m elements."""
    sampled = np.minimum(n, SAMPLE) + np.minimum(m, SAMPLE)
    common = (sampled - np.minimum(difference(odd_bits), sampled)) / 2 * np.maximum(1, np.maximum(n, m) / SAMPLE)
    common = np.minimum(common, np.minimum(n, m))
    return common / (n + m - common)


def possible(odd_bits, n, m, percent: int):
    """Whether two sets may be as alike as wanted."""
    whole = 100 * (n + m - odd_bits) >= percent * (n + m + odd_bits)
    return np.where(np.maximum(n, m) > SAMPLE, likeness(odd_bits, n, m) >= percent / 100 - SLACK, whole)


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = list(shingle_sets(batch.column(1)))
        rows = {"doc_id": batch.column(0), "n_shingles": pa.array([len(s) for s in sets], pa.int64()), "set_a": [], "set_b": [], "bands": [], "sketch": []}
        for s in sets:
            if len(s):
                low = mix(minhash(s)).reshape(BANDS, ROWS)
                keys = mix((low * powers(ROWS + 1)[1:]).sum(1, dtype=np.uint64))
                rows["bands"].append(keys.view(np.int64))
                rows["sketch"].append(odd_sketch(s))
                at = powers(len(s) + 1)[1:]
                rows["set_a"].append(int((s * at).sum(dtype=np.uint64).view(np.int64)))
                rows["set_b"].append(int(mix(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64).view(np.int64)))
            else:
                for k in ("bands", "sketch", "set_a", "set_b"):
                    rows[k].append(None)
        yield pa.RecordBatch.from_arrays(
            [rows["doc_id"], rows["n_shingles"], pa.array(rows["set_a"], pa.int64()), pa.array(rows["set_b"], pa.int64()), pa.array(rows["bands"], pa.list_(pa.int64())), pa.array(rows["sketch"], pa.list_(pa.int64()))],
            names=["doc_id", "n_shingles", "set_a", "set_b", "bands", "sketch"],
        )


def _full_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = [s.view(np.int64) for s in shingle_sets(batch.column(1))]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.list_(pa.int64()))], names=["doc_id", "shingles"])


def _possible(a: str, b: str, n: str, m: str, percent: int):
    """The column form of possible()."""
    odd = F.expr(f"aggregate(zip_with({a}, {b}, (x, y) -> bit_count(x ^ y)), 0, (s, x) -> s + x)").cast("double")
    d = -BITS / 2 * F.log1p(-2 * F.least(odd, F.lit(BITS / 2 - 1)) / BITS)
    sampled = F.least(F.col(n), F.lit(SAMPLE)) + F.least(F.col(m), F.lit(SAMPLE))
    common = (sampled - F.least(d, sampled)) / 2 * F.greatest(F.lit(1.0), F.greatest(n, m) / SAMPLE)
    common = F.least(common, F.least(n, m))
    whole = 100 * (F.col(n) + F.col(m) - odd) >= percent * (F.col(n) + F.col(m) + odd)
    return F.when(F.greatest(n, m) > SAMPLE, common / (F.col(n) + F.col(m) - common) >= percent / 100 - SLACK).otherwise(whole)


def _confirmed(texts: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are as alike as wanted."""
    pairs = staged(pairs)
    ids = staged(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct())
    few = ids.count() <= BROADCAST_IDS
    some = texts.join(F.broadcast(ids) if few else ids, "doc_id", "left_semi")
    sets = staged(some.mapInArrow(_full_sets, "doc_id long, shingles array<long>"))
    left = sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("s"))
    right = sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("t"))
    both = F.size(F.array_intersect("s", "t")).cast("long")
    found = pairs.join(left, "a").join(right, "b").select("a", "b", both.alias("both"), (F.size("s") + F.size("t")).cast("long").alias("sum"))
    out = staged(found.filter(100 * F.col("both") >= percent * (F.col("sum") - F.col("both"))).select("a", "b").distinct())
    freed(pairs, ids, sets)
    return out


def _compare(percent: int, forest: bool):
    def run(table: pa.Table) -> pa.Table:
        """Left members against right ones of other components; a block alone against itself.

        Two members that share several buckets meet in each; they are given out by the first of these alone. With
        `forest`, of the pairs that join the same components only the likeliest are given out, and a row without ids
        tells that others were left.
        """
        table = table.combine_chunks()
        lists = lambda k, n: table[k].combine_chunks().flatten().to_numpy().reshape(-1, n)
        bands, sketch = lists("bands", BANDS), lists("sketch", BITS // 64).view(np.uint64)
        ids, part, n, left = (table[k].to_numpy() for k in ("doc_id", "component", "n_shingles", "left"))
        first = {k: table[k][0].as_py() for k in ("band", "key", "i", "j")}
        rows, cols = np.flatnonzero(left), np.flatnonzero(~left)
        alone = first["i"] == first["j"]
        one, two, like = [], [], []
        for i in rows:
            js = rows[rows > i] if alone else cols
            js = js[part[js] != part[i]]
            js = js[np.minimum(n[js], n[i]) * 100 >= percent * np.maximum(n[js], n[i])]
            if len(js):
                odd = np.bitwise_count(sketch[js] ^ sketch[i]).sum(1, dtype=np.int64)
                good = possible(odd, n[js], n[i], percent) & ((bands[js] == bands[i]).argmax(1) == first["band"])
                js = js[good]
                one.append(np.full(len(js), i))
                two.append(js)
                like.append(likeness(odd[good], n[js], n[i]))
        one, two, like = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (one, two, like))
        kept = _forest(part[one], part[two], like) if forest else np.arange(len(one))
        a, b = ids[one[kept]], ids[two[kept]]
        a, b = np.minimum(a, b).tolist(), np.maximum(a, b).tolist()
        if len(kept) < len(one):
            a, b = [*a, None], [*b, None]
        return pa.table({"band": pa.array([first["band"]] * len(a), pa.int32()), "key": pa.array([first["key"]] * len(a), pa.int64()), "a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def _forest(x: np.ndarray, y: np.ndarray, like: np.ndarray) -> np.ndarray:
    """Places of the pairs, likeliest first, that join what no pair before them has joined."""
    root: dict[int, int] = {}

    def find(i: int) -> int:
        while root.get(i, i) != i:
            root[i] = root.get(root[i], root[i])
            i = root[i]
        return i

    kept = []
    for k, i, j in zip((order := np.argsort(-like, kind="stable")).tolist(), x[order].tolist(), y[order].tolist(), strict=True):
        i, j = find(i), find(j)
        if i != j:
            root[i] = j
            kept.append(k)
    return np.array(kept, np.int64)


def _blocks_against_blocks(open_: DataFrame, nodes: DataFrame, percent: int, forest: bool) -> DataFrame:
    """Members of large buckets, dealt to pairs of blocks (i, j) and compared. Blocks 0..k-1 hold what is outside the
    bucket's main component and meet all blocks; blocks from k on hold the main component and meet only those."""
    large = open_.filter(F.col("size") > SMALL)
    main = large.groupBy("band", "key", "component").count().groupBy("band", "key")
    main = main.agg(F.max_by("component", F.struct("count", "component")).alias("main"), (F.sum("count") - F.max("count")).alias("outside")).filter("outside > 0")
    rest = F.ceil(F.col("outside") / BLOCK).cast("int")
    mains = F.ceil((F.col("size") - F.col("outside")) / BLOCK).cast("int")
    dealt = F.xxhash64("doc_id", "key")
    placed = (
        large.join(main, ["band", "key"])
        .withColumn("out", F.col("component") != F.col("main"))
        .withColumn("own", F.when(F.col("out"), F.pmod(dealt, rest)).otherwise(rest + F.pmod(dealt, mains)).cast("int"))
        .withColumn("meets", F.explode(F.when(F.col("out"), F.sequence(F.lit(0), rest + mains - 1)).otherwise(F.sequence(F.lit(0), rest - 1))))
        .select("band", "key", F.least("own", "meets").alias("i"), F.greatest("own", "meets").alias("j"), (F.col("own") <= F.col("meets")).alias("left"), "doc_id", "component")
    )
    placed = placed.join(nodes.select("doc_id", "n_shingles", "bands", "sketch"), "doc_id")
    return placed.groupBy("band", "key", "i", "j").applyInArrow(_compare(percent, forest), "band int, key long, a long, b long")


def groups(docs: DataFrame, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row: links are pairs with 100 * common >= percent * union."""
    spark = docs.sparkSession
    small_batches(spark)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sketches = staged(texts.mapInArrow(_sketches, "doc_id long, n_shingles long, set_a long, set_b long, bands array<long>, sketch array<long>"))
    linked = sketches.filter("n_shingles > 0 AND doc_id IS NOT NULL")
    same = ["set_a", "set_b", "n_shingles"]
    classes = staged(linked.groupBy(*same).agg(F.min("doc_id").alias("stands"), F.count("*").alias("copies")).filter("copies > 1").drop("copies"))
    member = sketches.select("doc_id", *same).join(classes, same, "left")
    member = staged(member.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("stands", "doc_id")).alias("stands")))
    nodes = staged(linked.join(classes, same, "left").filter("doc_id = coalesce(stands, doc_id)").select("doc_id", "n_shingles", "bands", "sketch"))

    freed(sketches, classes)
    rows = nodes.select("doc_id", F.posexplode("bands").alias("band", "key"))
    buckets = staged(rows.groupBy("band", "key").agg(F.min("doc_id").alias("center"), F.count("*").alias("size")).filter("size > 1"))
    members = staged(rows.join(buckets, ["band", "key"]).select("band", "key", "center", "size", "doc_id"))
    star = staged(members.filter("doc_id > center").select(F.col("center").alias("a"), F.col("doc_id").alias("b")).distinct())
    edges = _confirmed(texts, _sketched(star, nodes, percent), percent)
    freed(star, buckets)
    # rows that repeat a doc_id with another text hang together through it
    repeated = member.groupBy("doc_id").agg(F.min("stands").alias("a"), F.max("stands").alias("z")).filter("a < z").select("doc_id", "a")
    repeated = member.join(repeated, "doc_id").select("a", F.col("stands").alias("b")).distinct()
    found, edges = edges, staged(edges.unionByName(repeated))
    parts = connected(edges)

    placed = staged(members.select("band", "key", "size", "doc_id").join(parts, "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id")))
    split = placed.groupBy("band", "key").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low < high").select("band", "key")
    split = staged(split)
    open_ = staged(placed.join(split, ["band", "key"]))
    freed(found, parts, members, split, placed)
    few = open_.filter(F.col("size") <= SMALL)
    other = few.select("band", "key", F.col("doc_id").alias("b"), F.col("component").alias("of_b"))
    small = few.join(other, ["band", "key"]).filter("doc_id < b AND component <> of_b").select(F.col("doc_id").alias("a"), "b").distinct()
    small = staged(small)
    compared = staged(_blocks_against_blocks(open_, nodes, percent, True))
    tried = staged(_sketched(small, nodes, percent).unionByName(compared.filter("a IS NOT NULL").select("a", "b")).distinct())
    more = _confirmed(texts, tried, percent)
    edges, old = staged(edges.unionByName(more)), edges
    parts = connected(edges)
    # buckets in which other pairs were left, between what is not joined even now
    left = compared.filter("a IS NULL").select("band", "key").distinct()
    left = open_.drop("component").join(left, ["band", "key"]).join(parts, "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))
    left = staged(left)
    if not left.isEmpty():
        rest = _blocks_against_blocks(left, nodes, percent, False).select("a", "b").distinct().join(tried, ["a", "b"], "left_anti")
        last = _confirmed(texts, rest, percent)
        if not last.isEmpty():
            freed(parts)
            parts = connected(edges.unionByName(last))
        freed(last)
    freed(nodes, old, edges, open_, small, compared, tried, more, left)
    whole = member.join(parts.withColumnRenamed("doc_id", "stands"), "stands", "left").select("doc_id", "n_shingles", F.coalesce("component", "stands").alias("component_id"))
    return whole.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def _sketched(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """The pairs that sizes and sketches leave room for."""
    left = nodes.select(F.col("doc_id").alias("a"), F.col("n_shingles").alias("n"), F.col("sketch").alias("s"))
    right = nodes.select(F.col("doc_id").alias("b"), F.col("n_shingles").alias("m"), F.col("sketch").alias("t"))
    both = pairs.join(left, "a").join(right, "b").filter(100 * F.least("n", "m") >= percent * F.greatest("n", "m"))
    return both.filter(_possible("s", "t", "n", "m", percent)).select("a", "b")
