"""Fill-in-middle: texts cut at two units and put together again with the middle last.

A unit is a run of ASCII letters or any other single code point. Each text is laid out in blocks of BLOCK bytes; a
Fenwick tree over the blocks holds how many units and code points start in each. The block in which a cut's unit starts
is found by binary lifting, and the place in it by a scan of that block alone. The trees of all texts of a slice lie in
one array, so building and descending are numpy steps over all of them at once.

Defined cases: null texts count as empty. An empty text, and one that holds a mark, stays plain, as do the texts that
the hash leaves out. A null id hashes as the empty string; rows that repeat an id and text come out alike. Columns of
the input that are called like an added one, in any case, are replaced; all others are kept. A text of any length is
worked on whole; it takes some ten times its bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .store import quoted, small_batches
from .words import SLICE_BYTES, text_slices

BLOCK = 1024
#: Marks before the prefix, the suffix and the middle. None of them may end with how another one starts.
MARKS = ("<P>", "<S>", "<M>")
ADDED = ("n_units", "form", "prefix_chars", "middle_chars", "output")

_LETTER = np.zeros(256, bool)
_LETTER[ord("A") : ord("Z") + 1] = _LETTER[ord("a") : ord("z") + 1] = True


class Trees:
    """One Fenwick tree for each text, over its blocks; node i of a text stands at base + i - 1."""

    def __init__(self, sizes: np.ndarray, units: np.ndarray, points: np.ndarray):
        self.sizes, self.base = sizes, np.cumsum(sizes) - sizes
        self.units, self.points = units.astype(np.int64), points.astype(np.int64)
        own = np.arange(len(units)) - np.repeat(self.base, sizes) + 1
        step, most = 1, int(sizes.max(initial=0))
        while 2 * step <= most:
            at = np.flatnonzero(own % (2 * step) == 0)
            for tree in (self.units, self.points):
                tree[at] += tree[at - step]
            step *= 2

    def totals(self) -> np.ndarray:
        """Units of each text."""
        out, at = np.zeros(len(self.sizes), np.int64), self.sizes.copy()
        while (live := np.flatnonzero(at)).size:
            out[live] += self.units[self.base[live] + at[live] - 1]
            at[live] &= at[live] - 1
        return out

    def descend(self, text: np.ndarray, k: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each (text, k): the block in which unit k (from 0) starts, the units that start in it before that one, and
        the code points before the block. Past the last unit it is the number of blocks."""
        block, rest, points = np.zeros(len(text), np.int64), k.astype(np.int64), np.zeros(len(text), np.int64)
        step = 1 << max(int(self.sizes.max(initial=0)).bit_length() - 1, 0)
        while step:
            to = block + step
            node = np.where(to <= self.sizes[text], self.base[text] + to - 1, 0)
            go = (to <= self.sizes[text]) & (self.units[node] <= rest) if len(self.units) else np.zeros(len(text), bool)
            rest = np.where(go, rest - self.units[node], rest) if len(self.units) else rest
            points = np.where(go, points + self.points[node], points) if len(self.units) else points
            block = np.where(go, to, block)
            step >>= 1
        return block, rest, points


def starts(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where code points start, and where units start."""
    lead, letter = (data & 0xC0) != 0x80, _LETTER[data]
    goes_on = np.zeros(len(data) + 1, bool)
    goes_on[1:-1] = letter[1:] & letter[:-1]
    goes_on[off] = False
    return lead, lead & ~goes_on[:-1]


def cut(data: np.ndarray, off: np.ndarray, h: np.ndarray, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """n units of each text, and for the cuts h % (n + 1), ordered, their bytes and code points from the text's start: (texts, 2)."""
    sizes = -(-np.diff(off) // block)
    lead, unit = starts(data, off)
    first = np.repeat(off[:-1], sizes) + (np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)) * block
    counts = [np.add.reduceat(x.astype(np.int32), first) if len(first) else np.zeros(0, np.int32) for x in (unit, lead)]
    trees = Trees(sizes, *counts)
    n = trees.totals()
    k = np.sort(h % (n[:, None] + 1), axis=1)
    text = np.repeat(np.arange(len(n)), k.shape[1])
    at, rest, points = trees.descend(text, k.ravel())
    length = np.diff(off)[text]
    place = np.minimum(at * block, length)
    for i in np.flatnonzero(at < sizes[text]).tolist():
        a = int(off[text[i]] + place[i])
        inside = np.flatnonzero(unit[a : min(a + block, int(off[text[i] + 1]))])[rest[i]]
        place[i] += inside
        points[i] += np.count_nonzero(lead[a : a + inside])
    return n, place.reshape(k.shape), points.reshape(k.shape)


def _number(hashed: Column, i: int) -> Column:
    return F.conv(F.substring(hashed, 8 * i + 1, 8), 16, 10).cast("long")


def transform(docs: DataFrame, seed: int = 1, percent: int = 90, spm: int = 20, marks: tuple[str, str, str] = MARKS) -> DataFrame:
    """docs with n_units, form (plain, psm, spm), prefix_chars, middle_chars (code points; null if plain) and output.

    The sha256 of seed:doc_id gives four numbers: two cuts, whether the text is transformed (percent of them), and in
    which order (spm per cent with the suffix first).
    """
    small_batches(docs.sparkSession)
    p, s, m = (x.encode() for x in marks)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    hashed = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256)
    plain = (text == "") | F.lit(False)
    for x in marks:
        plain = plain | F.contains(text, F.lit(x))
    form = F.when(plain | (_number(F.col("hashed"), 2) % 100 >= percent), "plain").when(_number(F.col("hashed"), 3) % 100 < spm, "spm").otherwise("psm")
    rows = docs.select(F.struct(*[F.col(quoted(c)) for c in docs.columns]).alias("row"), text.alias("text"), hashed.alias("hashed"))
    rows = rows.select("row", "text", _number(F.col("hashed"), 0).alias("h1"), _number(F.col("hashed"), 1).alias("h2"), form.alias("form"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in (2, 3)], 1)
            for first, data, off in text_slices(batch.column(1), SLICE_BYTES):
                n, place, points = cut(data, off, h[first : first + len(off) - 1])
                forms, out = batch.column(4).slice(first, len(n)), []
                for i, f in enumerate(forms.to_pylist()):
                    t, (a, b) = data[off[i] : off[i + 1]].tobytes(), place[i].tolist()
                    out.append(t if f == "plain" else p + t[:a] + s + t[b:] + m + t[a:b] if f == "psm" else s + t[b:] + p + t[:a] + m + t[a:b])
                told = np.array([f == "plain" for f in forms.to_pylist()])
                chars = [pa.array(x, pa.int64(), mask=told) for x in (points[:, 0], points[:, 1] - points[:, 0])]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(n)), pa.array(n, pa.int64()), forms, *chars, pa.array(out, pa.string())], names=["row", *ADDED])

    kinds = [T.LongType(), T.StringType(), T.LongType(), T.LongType(), T.StringType()]
    schema = T.StructType([rows.schema["row"], *[T.StructField(n, k) for n, k in zip(ADDED, kinds, strict=True)]])
    kept = [c for c in docs.columns if c.lower() not in ADDED]
    return rows.mapInArrow(run, schema).select(*[F.col("row").getField(c).alias(c) for c in kept], *ADDED)


def restored(output: Column, form: Column, marks: tuple[str, str, str] = MARKS) -> Column:
    """The text that an output was made from. The marks are found from the left: a transformed text holds none itself."""
    p, s, m = marks
    first, second = F.when(form == "psm", p).otherwise(s), F.when(form == "psm", s).otherwise(p)
    one = F.split_part(F.substr(output, F.length(first) + 1), second, F.lit(1))
    rest = F.substr(output, F.length(first) + F.length(one) + F.length(second) + 1)
    two = F.split_part(rest, F.lit(m), F.lit(1))
    middle = F.substr(rest, F.length(two) + len(m) + 1)
    return F.when(form == "plain", output).when(form == "psm", F.concat(one, middle, two)).otherwise(F.concat(two, middle, one))
