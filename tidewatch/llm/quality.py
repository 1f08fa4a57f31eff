"""Quality scores by logistic regression on hashed word n-grams, trained with follow-the-regularised-leader updates.

Features of a text are its words and pairs of adjacent words (A-Z lower-cased), the words' shapes (kinds of
characters and length) and pairs of them, their last two bytes, and how far words and shapes repeat, each hashed into 2**20 slots; a count c gives the value
1 + ln c, and a text's values are scaled to length one. A score is the sparse dot product of values and weights.

The fit takes the labelled rows of the smallest hashed ids, at most `sample` of them, so it needs bounded time and
memory whatever the input. Their features are made in parallel; one task then updates one model with them in the order
of their hashed ids, so the weights do not depend on how rows are split. Scoring covers every row of the input.

Defined cases: null and empty texts have no feature but the constant one, and get its score. Labels that are null
are not learned from; ids with more than one label count with each, and rows that repeat an id count each up to
`sample` rows in all, in the same order. Other columns are never read. With no labelled
rows all scores are 0.5.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .store import freed, quoted, small_batches, staged
from .words import LOWER, Words, mix, words

SLOTS = 1 << 20
#: Most labelled rows that the fit reads.
SAMPLE = 20_000
CUT = 0.3
EPOCHS = 4
ALPHA, BETA, L1, L2 = 2.0, 1.0, 0.01, 0.05

_AGAIN = np.uint64(0xA24BAED4963EE407)
_KIND = np.full(256, 3, np.uint8)  # signs
_KIND[ord("a") : ord("z") + 1] = 1
_KIND[ord("A") : ord("Z") + 1] = 2
_KIND[ord("0") : ord("9") + 1] = 0
_KIND[128:] = 1


def _slots(h: np.ndarray, salt: int) -> np.ndarray:
    return (mix(h + np.uint64(salt * 0x9E3779B97F4A7C15 & (2**64 - 1))) >> np.uint64(44)).astype(np.int64)


def _shapes(w: Words) -> np.ndarray:
    """For each word: which kinds of characters it starts with, ends with and holds, as a small number."""
    kind = _KIND[w.data]
    first, last = kind[w.start], kind[w.end - 1]
    has = [np.concatenate(([0], np.cumsum(kind == k))) for k in range(4)]
    share = sum((((c[w.end] - c[w.start]) > 0).astype(np.uint64) << np.uint64(i)) for i, c in enumerate(has))
    size = np.minimum(w.end - w.start, 15).astype(np.uint64)
    return (first.astype(np.uint64) << np.uint64(16)) | (last.astype(np.uint64) << np.uint64(12)) | (share << np.uint64(4)) | size


def features(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Slots (distinct, rising) and values of each text, in order; slot 0 is constant."""
    for w in words(column):
        one = _slots(w.hash, 1)
        two = _slots(w.hash[:-1] * np.uint64(3) + w.hash[1:], 2) if len(w.hash) > 1 else one[:0]
        shape = _shapes(w) if len(w.hash) else w.hash
        look = _slots(shape, 3)
        look2 = _slots(shape[:-1] * np.uint64(31) + shape[1:] + (w.hash[:-1] == w.hash[1:]).astype(np.uint64) * _AGAIN, 4) if len(shape) > 1 else look[:0]
        tail = _slots(w.data[w.end - 1].astype(np.uint64) * np.uint64(256) + LOWER[w.data[np.maximum(w.end - 2, 0)]], 5) if len(w.hash) else one
        for a, b in zip(w.bounds[:-1].tolist(), w.bounds[1:].tolist(), strict=True):
            if a == b:
                yield np.zeros(1, np.int64), np.ones(1)
                continue
            all_ = np.concatenate([one[a:b], two[a : b - 1], look[a:b], look2[a : b - 1], tail[a:b]])
            slot, n = np.unique(all_, return_counts=True)
            value = 1 + np.log(n)
            value /= np.sqrt((value**2).sum())
            spread = [np.unique(x).size / (b - a) for x in (one[a:b], look[a:b])]
            bins = _slots(np.array([int(s * 10) for s in spread], np.uint64) + np.array([100, 200], np.uint64), 6)
            slots, place = np.unique(np.concatenate([[0], bins, slot]), return_inverse=True)
            yield slots, np.bincount(place, np.concatenate([[0.3, 0.3, 0.3], value]))


def fit(slots: list[np.ndarray], values: list[np.ndarray], labels: np.ndarray) -> np.ndarray:
    """Weights after EPOCHS passes of per-coordinate follow-the-regularised-leader steps, in the order given.

    z gathers gradients less what they have moved the weights by, n the squared gradients; a slot of small z weighs 0.
    """
    z, n = np.zeros(SLOTS), np.zeros(SLOTS)

    def weights(zi, root):
        return np.where(np.abs(zi) <= L1, 0.0, -(zi - np.sign(zi) * L1) / ((BETA + root) / ALPHA + L2))

    for _ in range(EPOCHS):
        for i, x, y in zip(slots, values, labels.tolist(), strict=True):
            zi, ni = z[i], n[i]
            root = np.sqrt(ni)
            w = weights(zi, root)
            g = (1 / (1 + np.exp(-min(max(w @ x, -35.0), 35.0))) - y) * x
            ni += g * g
            z[i] = zi + g - (np.sqrt(ni) - root) / ALPHA * w
            n[i] = ni
    return weights(z, np.sqrt(n)).astype(np.float32)


def held_out(doc_id: Column) -> Column:
    """True for the ids whose labels are not learned from; a null id has none to learn from."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def _featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        both = list(features(batch.column(0)))
        rows = [pa.array([s.astype(np.int32) for s, _ in both], pa.list_(pa.int32())), pa.array([v.astype(np.float32) for _, v in both], pa.list_(pa.float32()))]
        yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), batch.column(3), *rows], names=["quality", "rank", "row", "slots", "values"])


def _fit_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One model from all rows, in their order; features stay in the batches they came in."""
    slots, values, labels = [], [], []
    for batch in batches:
        at = batch.column("slots").offsets.to_numpy().tolist()
        flat, weight = batch.column("slots").values.to_numpy(), batch.column("values").values.to_numpy()
        for a, b in zip(at[:-1], at[1:], strict=True):
            slots.append(flat[a:b])
            values.append(weight[a:b])
        labels += batch.column("quality").to_pylist()
    if labels:
        yield pa.RecordBatch.from_pydict({"weights": pa.array([fit(slots, values, np.array(labels)).tobytes()], pa.binary())})


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> bytes:
    """float32 weights of the model, as bytes, fitted on at most `sample` labelled rows outside the held-out fold."""
    small_batches(docs.sparkSession)
    key = ["rank", "row", "quality"]
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).filter("doc_id IS NOT NULL AND quality IS NOT NULL")
    known = known.filter(~held_out(F.col("doc_id"))).withColumn("rank", F.xxhash64("doc_id", F.lit(7)))
    chosen = staged(known.orderBy("rank", "doc_id", "quality").limit(sample))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # at most `sample` rows are broadcast, here and below
    rows = texts.join(F.broadcast(chosen), "doc_id").select("text", "quality", "rank", F.xxhash64("text").alias("row"))
    found = staged(rows.groupBy(*key).agg(F.min("text").alias("text"), F.count("*").alias("copies")))
    least = found.select(*key, "copies").orderBy(*key).limit(sample)
    before = F.coalesce(F.sum("copies").over(Window.orderBy(*key).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    least = least.withColumn("copies", F.least("copies", F.lit(sample) - before)).filter("copies > 0")
    rows = found.drop("copies").join(F.broadcast(least), key).withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).select("text", "quality", "rank", "row")
    made = rows.mapInArrow(_featurise, "quality int, rank long, row long, slots array<int>, values array<float>")
    # one task by the method: each step starts where the one before ended; its rows are bounded by `sample`
    made = made.repartition(1).sortWithinPartitions(*key)
    model = made.mapInArrow(_fit_rows, "weights binary").collect()  # one row at most
    freed(chosen, found)
    return model[0]["weights"] if model else np.zeros(SLOTS, np.float32).tobytes()


def score(docs: DataFrame, weights: bytes, name: str = "score") -> DataFrame:
    """Adds the column `name` (0 to 1, higher for better texts) to docs, in place of one of that name."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(weights)
    kept = [c for c in docs.columns if c.lower() != name.lower()]
    # the kept columns travel as one, so they may have any names
    rows = docs.select(F.struct(*[F.col(quoted(c)) for c in kept]).alias("row"), F.col("text").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = np.frombuffer(shared.value, np.float32)
        for batch in batches:
            dots = np.array([float(w[s] @ v) for s, v in features(batch.column(1))])
            out = 1 / (1 + np.exp(-np.clip(dots, -35, 35)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.float64())], names=["row", "score"])

    found = rows.mapInArrow(run, T.StructType([rows.schema["row"], T.StructField("score", T.DoubleType())]))
    return found.select(*[F.col("row").getField(c).alias(c) for c in kept], F.col("score").alias(name))
