"""Order MinHash: fingerprints whose likeness falls with edit distance, order included.

The units of a text are its words, words of more than 8 code points being cut into runs of 8. The k-mers are the
pairs of adjacent units (a lone unit is its own k-mer); equal k-mers are numbered in the order they occur, so a
repeated one counts as often as it is there. One hash of k-mer and number deals each to one of 64 cells and ranks it
there. Each cell keeps its two smallest k-mers, puts them back into text order, and hashes the pair: the cell's entry
of the signature. Moving a passage changes entries even where it leaves the k-mers alone.

Everything is a DataFrame expression within one row, so long texts and frequent words need no shuffle.

Defined cases: null and empty texts, and texts of white space alone, have an empty fingerprint; two empty
fingerprints have likeness 1, an empty and another 0. Equal texts have equal fingerprints.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordered import id_ranges

UNIT = r"[^\\x20\\x09-\\x0D]{1,8}"
CELLS_BITS, PER_CELL = 6, 2
#: A packed k-mer: 37 bits of hash, then 26 bits of position.
_AT, _HASH = 26, 37
_CELL = _AT + _HASH - CELLS_BITS


def _packed(hash_: str, at: str) -> str:
    return f"shiftleft({hash_} & {(1 << _HASH) - 1}L, {_AT}) | cast({at} as bigint)"


def fingerprint(df: DataFrame, text: str, name: str) -> DataFrame:
    """Adds the column `name`: sorted array<bigint>, for each cell in use its number (upper half) and its hash (lower half)."""
    u, s, r, g, k = (f"__omh_{x}" for x in "usrgk")
    kept = [c for c in df.columns]
    df = df.withColumn(u, F.expr(f"regexp_extract_all({text}, '{UNIT}', 0)"))
    hashed = f"xxhash64(x, get({u}, i + 1))"
    df = df.select(*kept, F.expr(f"sort_array(transform(slice({u}, 1, greatest(size({u}) - 1, least(size({u}), 1))), (x, i) -> {_packed(hashed, 'i')}))").alias(s))
    df = df.select(*kept, s, F.expr(f"filter(transform({s}, (x, i) -> if(i = 0 OR shiftright(get({s}, i - 1), {_AT}) <> shiftright(x, {_AT}), i, -1)), i -> i >= 0)").alias(r))
    numbered = _packed(f"xxhash64(shiftright(x, {_AT}), o)", f"x & {(1 << _AT) - 1}L")
    run = f"transform(slice({s}, b + 1, coalesce(get({r}, j + 1), size({s})) - b), (x, o) -> {numbered})"
    df = df.select(*kept, F.expr(f"sort_array(flatten(transform({r}, (b, j) -> {run})))").alias(g))
    df = df.select(*kept, F.expr(f"filter({g}, (x, i) -> i < {PER_CELL} OR shiftright(get({g}, i - {PER_CELL}), {_CELL}) <> shiftright(x, {_CELL}))").alias(k))
    same = f"shiftright(get({k}, i + 1), {_CELL}) = shiftright(x, {_CELL})"
    place = f"(x & {(1 << _AT) - 1}L) < (get({k}, i + 1) & {(1 << _AT) - 1}L)"
    a, b = f"shiftright(x, {_AT})", f"shiftright(get({k}, i + 1), {_AT})"
    pair = f"CASE WHEN {same} THEN if({place}, xxhash64({a}, {b}), xxhash64({b}, {a})) ELSE xxhash64({a}) END"
    entry = f"shiftleft(shiftright(x, {_CELL}), 32) | ({pair} & {(1 << 32) - 1}L)"
    first = f"i = 0 OR shiftright(get({k}, i - 1), {_CELL}) <> shiftright(x, {_CELL})"
    return df.select(*kept, F.expr(f"filter(transform({k}, (x, i) -> if({first}, {entry}, -1L)), x -> x >= 0)").alias(name))


def likeness(a: str, b: str) -> Column:
    """Equal entries of two fingerprints over the cells that either uses."""
    cells = F.size(F.array_union(F.transform(a, lambda x: F.shiftright(x, 32)), F.transform(b, lambda x: F.shiftright(x, 32))))
    return F.when(cells == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / cells).cast("double")


def as_string(column: str) -> Column:
    return F.array_join(F.transform(column, lambda x: F.lpad(F.hex(x), 10, "0")), "")


def with_next(docs: DataFrame, carried: list[str], prepare: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """Adds next_<column> for the carried columns: those of the next row by descending doc_id, of the first after the last.

    `prepare` may add columns to the rows before they are dealt out; the ranges' edges come from docs as it is.

    Rows of the same doc_id follow each other by the hash of their text; null ids come after all others.
    """
    ranges = id_ranges(docs)
    least = F.lit(-(2**63)).cast("long")
    rows = docs.withColumn("__key", F.coalesce("doc_id", least)).withColumn("__hash", F.xxhash64("text"))
    rows = rows.withColumn("__range", ranges.of("doc_id", "__hash")).withColumn("__copy", F.lit(0))
    # one row a range, at most MAX_RANGES: its first row's key and, for the range above, where to send a copy of it
    tops = rows.groupBy("__range").agg(F.max(F.struct("__key", "__hash")).alias("top"))
    down = Window.orderBy(F.desc("__range"))
    edges = tops.select("__range", F.coalesce(F.lead("top").over(down), F.first("top").over(down)).alias("top")).select("__range", "top.*")
    copies = rows.drop("__range", "__copy").join(F.broadcast(edges), ["__key", "__hash"]).withColumn("__copy", F.lit(1))
    order = Window.partitionBy("__range").orderBy("__copy", F.desc("__key"), F.desc("__hash"))
    both = prepare(rows.unionByName(copies))
    found = both.select("*", *[F.lead(c).over(order).alias(f"next_{c}") for c in carried]).filter("__copy = 0")
    return found.drop("__range", "__key", "__copy", "__hash")


def edited_pairs(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited text, and the fingerprints of each text, its edited text and the next document."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = with_next(texts, ["text", "fp"], lambda df: fingerprint(df, "text", "fp")).withColumn("n_chars", F.length("text").cast("long"))
    tail = F.floor(F.col("n_chars") / 3).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), F.col("n_chars").cast("int") - tail), F.substring("next_text", F.lit(1), tail))
    rows = rows.select("doc_id", "n_chars", edited.alias("edited"), "fp", "next_fp")
    return fingerprint(rows, "edited", "edited_fp")
