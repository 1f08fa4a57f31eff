"""Language identification by compression: a text is in the language whose sample helps most to encode it.

For each language a zstandard dictionary of raw content is gathered, of at most `DICTIONARY` bytes: of all distinct
pieces of all training texts (about PIECE bytes each, cut at spaces) those of the smallest hashes, so every text
has its chance by its length and a text that stands there a thousand times counts once. A text is then encoded, in
blocks, with each dictionary, and the smallest total of bytes tells the language.

Before that, texts are lower-cased and all but letters becomes single spaces, so that signs, digits and shouting don't
decide. Short texts are encoded at a higher level, which finds shorter matches.

The score is 1 / sum of exp(-SHARP * excess), where a language's excess is how much larger, as a share, its total is
than the least one: 1 if all others are far off, 1 / languages if all are alike. A prediction is accepted where the
second-best total is larger by MARGIN at least.

Defined cases: null texts, and those without a letter, are "und" of score 0 and not accepted. Equal totals go to the
language with more training texts, then by name; so does a text too short to tell. Null languages and ids are not
learned from, nor are the rows of the held-out fold. If nothing is learned, all is "und". More than MAX_LANGUAGES
distinct labels are an error, as the dictionaries are broadcast. Rows that repeat an id are judged each for itself.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .quality import held_out
from .store import freed, quoted, small_batches, staged

DICTIONARY, PIECE, BLOCK = 128 << 10, 256, 2048
#: Of all dictionaries together, whatever the number of languages.
BROADCAST_BYTES, MAX_LANGUAGES = 32 << 20, 4096
LEVEL = (6, {})
#: Texts of at most SHORT bytes.
SHORT, SHORT_LEVEL = 256, (13, {"min_match": 3})
SHARP, MARGIN = 60.0, 0.02
ADDED = ("lang_pred", "score", "accepted")

_PLAIN = bytes(i if ord("a") <= i <= ord("z") or i >= 128 else 32 for i in range(256))
_SPREAD = 256


def plain(text: str) -> bytes:
    """Lower-case letters and single spaces, one at either end."""
    return b" " + b" ".join(text.lower().encode("utf-8", "replace").translate(_PLAIN).split()) + b" "


def pieces(text: bytes) -> Iterator[bytes]:
    at = 0
    while at < len(text) - 1:
        to = text.find(b" ", at + PIECE)
        to = len(text) if to < 0 else to
        yield text[at:to]
        at = to


def learn(docs: DataFrame) -> list[tuple[str, bytes]]:
    """(language, dictionary), that of most training texts first."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    rows = rows.filter(F.col("doc_id").isNotNull() & F.col("text").isNotNull() & F.col("lang").isNotNull() & ~held_out(F.col("doc_id"))).select("lang", "text")
    counts = sorted(rows.groupBy("lang").count().limit(MAX_LANGUAGES + 1).collect(), key=lambda r: (-r["count"], r["lang"]))
    if len(counts) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    if not counts:
        return []
    k = max(1, min(DICTIONARY, BROADCAST_BYTES // len(counts)) // PIECE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heaps: dict[str, list] = {}
        inside: dict[str, set] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                heap, seen = heaps.setdefault(lang, []), inside.setdefault(lang, set())
                for piece in pieces(plain(text.as_py())):
                    h = xxhash.xxh64_intdigest(piece) >> 1
                    if len(heap) < k:
                        if h not in seen:
                            heapq.heappush(heap, (-h, piece))
                            seen.add(h)
                    elif h < -heap[0][0] and h not in seen:
                        seen.add(h)
                        seen.discard(-heapq.heapreplace(heap, (-h, piece))[0])
        for lang, heap in heaps.items():
            yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(heap), pa.string()), "hash": pa.array([-h for h, _ in heap], pa.int64()), "piece": pa.array([p for _, p in heap], pa.binary())})

    found = rows.mapInArrow(run, "lang string, hash long, piece binary")
    # the least of each part of the hashes, then the least of those: no task gets what all tasks have gathered
    found = found.groupBy("lang", "hash").agg(F.min("piece").alias("piece")).withColumn("part", F.pmod(F.col("hash"), F.lit(_SPREAD)))
    found = found.withColumn("n", F.row_number().over(Window.partitionBy("lang", "part").orderBy("hash"))).filter(F.col("n") <= k)
    found = found.withColumn("n", F.row_number().over(Window.partitionBy("lang").orderBy("hash"))).filter(F.col("n") <= k).select("lang", "hash", "piece")
    kept = staged(found)
    of: dict[str, list] = {r["lang"]: [] for r in counts}
    for r in kept.collect():
        of[r["lang"]].append((r["hash"], bytes(r["piece"])))
    freed(kept)
    return [(r["lang"], b"".join(p for _, p in sorted(of[r["lang"]], reverse=True))) for r in counts]


class Encoders:
    """Compressors of one language at both levels."""

    def __init__(self, dictionary: bytes):
        self.long, self.short = (self._of(dictionary, x) for x in (LEVEL, SHORT_LEVEL))

    @staticmethod
    def _of(dictionary: bytes, how: tuple[int, dict]) -> zstandard.ZstdCompressor:
        params = zstandard.ZstdCompressionParameters.from_level(how[0], write_content_size=False, write_dict_id=False, **how[1])
        raw = zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT) if len(dictionary) >= 8 else None
        if raw:
            raw.precompute_compress(compression_params=params)
        return zstandard.ZstdCompressor(dict_data=raw, compression_params=params)

    def size(self, text: bytes) -> int:
        if len(text) <= SHORT:
            return len(self.short.compress(text))
        return sum(len(self.long.compress(text[i : i + BLOCK])) for i in range(0, len(text), BLOCK))


def judged(sizes: np.ndarray) -> tuple[int, float, bool]:
    """Which is smallest, its score, and whether it is accepted."""
    best = int(np.argmin(sizes))
    excess = sizes / sizes[best] - 1
    others = np.delete(excess, best)
    return best, float(1 / np.exp(-SHARP * excess).sum()), bool(len(others) == 0 or others.min() >= MARGIN)


def classify(docs: DataFrame, learned: list[tuple[str, bytes]]) -> DataFrame:
    """docs with lang_pred, score and accepted; columns of these names, in any case, are replaced, all others kept."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(learned)
    kept = [c for c in docs.columns if c.lower() not in ADDED]
    # the kept columns travel as one, so they may have any names
    rows = docs.select(F.struct(*[F.col(quoted(c)) for c in kept]).alias("row"), F.col("text").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs = [lang for lang, _ in shared.value]
        encoders = [Encoders(d) for _, d in shared.value]
        for batch in batches:
            said: list[tuple] = []
            for text in batch.column(1):
                text = text.as_py()
                if not langs or not text or not any(map(str.isalpha, text)):
                    said.append(("und", 0.0, False))
                    continue
                low = plain(text)
                best, score, accepted = judged(np.array([e.size(low) for e in encoders], float))
                said.append((langs[best], score, accepted))
            added = [pa.array([x[i] for x in said], kind) for i, kind in enumerate((pa.string(), pa.float64(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *added], names=["row", *ADDED])

    added = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("accepted", T.BooleanType())]
    found = rows.mapInArrow(run, T.StructType([rows.schema["row"], *added]))
    return found.select(*[F.col("row").getField(c).alias(c) for c in kept], *ADDED)
