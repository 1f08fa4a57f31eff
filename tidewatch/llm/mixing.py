"""Mixing sources to target weights by systematic sampling.

A document's expected copies are its source's target over its source's size, so the prefix sum of expected copies
within a source is the document's number there times that rate. With one offset in [0, 1) a source, a document is
emitted once for each integer boundary that its part of the prefix sum crosses. Documents are numbered by size, then
id, so the words taken differ from the target by about one document's words.

Numbers come from three levels of counts, none of which holds more rows in one group than there are sizes in a
source, id ranges in a size, or ids in a range; a source with a third of all rows is dealt like any other.

Defined cases: null texts have size 0; a null source is a source of its own, after all others; rows that repeat an id
count each for itself; null ids come last among their size. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordered import id_ranges
from .store import quoted, staged

#: No target is larger than so many times its source's size.
MOST = 3
CYCLE = 3


def offset(source: Column) -> Column:
    """A number in [0, 1) that depends on the source's name alone."""
    return F.conv(F.substring(F.md5(F.coalesce(source, F.lit("")).cast("binary")), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def targets(sizes: DataFrame) -> DataFrame:
    """source, source_size, target from one row a source: weights 1, 2, 3 by name, limited to MOST times the size.

    Sources are full up to some level of target a weight. Sorted by the level at which each is full, the first k are
    full where the level that the others then get is above the k-th's own, so one running sum finds the level. This sorts
    the sources, one row each, in one task.
    """
    by_name, by_level = Window.orderBy(F.col("source").asc_nulls_last()), Window.orderBy("level", "weight", F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    upto = by_level.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = sizes.withColumn("weight", F.pmod(F.row_number().over(by_name) - 1, F.lit(CYCLE)).cast("long") + 1)
    rows = rows.withColumn("level", F.lit(float(MOST)) * F.col("source_size") / F.col("weight"))
    rows = rows.withColumn("total", F.sum("source_size").over(everything)).withColumn("weights", F.sum("weight").over(everything))
    # what is left for the sources from this one on, if all before it are full
    rows = rows.withColumn("left", F.col("total") - MOST * (F.sum("source_size").over(upto) - F.col("source_size")))
    rows = rows.withColumn("among", F.col("weights") - (F.sum("weight").over(upto) - F.col("weight")))
    rows = rows.withColumn("share", F.col("left").cast("double") / F.col("among").cast("double"))
    level = F.min(F.when(F.col("level") >= F.col("share"), F.struct("level", "share"))).over(everything)["share"]
    full = F.col("level") < F.col("common")
    target = F.when(F.col("common").isNull() | full, MOST * F.col("source_size").cast("double")).otherwise(F.col("weight") * F.col("common"))
    return rows.withColumn("common", level).select("source", "source_size", target.alias("target"))


def numbered(rows: DataFrame) -> DataFrame:
    """Adds n: 1, 2, ... within source, by size, then id."""
    ranges = id_ranges(rows)
    rows = rows.withColumn("part", F.when(F.col("doc_id").isNull(), F.lit(2**62)).otherwise(ranges.of("doc_id", "row" if "row" in rows.columns else None)))
    cells = staged(rows.groupBy("source", "size", "part").count())
    by_size = cells.groupBy("source", "size").agg(F.sum("count").alias("rows"))
    before = lambda w, c: F.sum(c).over(w) - F.col(c)
    sizes = staged(by_size.select("source", "size", before(Window.partitionBy("source").orderBy("size"), "rows").alias("smaller")))
    parts = cells.select("source", "size", "part", before(Window.partitionBy("source", "size").orderBy("part"), "count").alias("earlier"))
    offsets = staged(parts.join(sizes, parts["source"].eqNullSafe(sizes["source"]) & (parts["size"] == sizes["size"])).select(parts["source"], parts["size"], "part", (F.col("smaller") + F.col("earlier")).alias("before")))
    own = rows.withColumn("own", F.row_number().over(Window.partitionBy("source", "size", "part").orderBy("doc_id", *[F.col("row")] * ("row" in rows.columns))))
    same = own["source"].eqNullSafe(offsets["source"]) & (own["size"] == offsets["size"]) & (own["part"] == offsets["part"])
    return own.join(offsets, same).select(*[own[c] for c in rows.columns if c != "part"], (F.col("before") + F.col("own")).alias("n"))


def copies(docs: DataFrame) -> DataFrame:
    """doc_id, row (a hash of the text), source, size, source_size, target, copies of every row of docs."""
    size = F.coalesce(F.regexp_count(F.col("text").cast("string"), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")
    text_hash = F.xxhash64(F.col("text").cast("string")).alias("row")
    rows = staged(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), size.alias("size"), text_hash))
    sources = staged(targets(staged(rows.groupBy("source").agg(F.sum("size").alias("source_size")))))
    rows = numbered(rows)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size").cast("double")).otherwise(0.0)
    reach = lambda n: F.floor(n.cast("double") * rate + offset(sources["source"]))
    both = rows.join(sources, rows["source"].eqNullSafe(sources["source"]))
    return both.select("doc_id", "row", rows["source"], "size", "source_size", "target", (reach(F.col("n")) - reach(F.col("n") - 1)).cast("long").alias("copies"))


def mix(docs: DataFrame) -> DataFrame:
    """The rows of docs, each as often as the mix takes it. Rows that repeat an id and text share their copies. Columns may
    have any names: they travel as one."""
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63)).cast("long"))
    taken = copies(docs).groupBy(key.alias("id"), F.col("row").alias("hash")).agg(F.sum("copies").alias("copies"), F.count("*").alias("rows"))
    taken = staged(taken)
    given = docs.select(F.struct(*[F.col(quoted(c)) for c in docs.columns]).alias("given"), key.alias("id"), F.xxhash64(F.col("text").cast("string")).alias("hash"))
    rows = given.join(taken, ["id", "hash"])
    once = rows.filter("rows = 1").withColumn("each", F.col("copies"))
    if not taken.filter("rows > 1").isEmpty():
        nth = F.row_number().over(Window.partitionBy("id", "hash").orderBy(F.xxhash64("given"))) - 1
        some = lambda n: F.floor(n * F.col("copies") / F.col("rows"))
        again = rows.filter("rows > 1").withColumn("n", nth)
        once = once.unionByName(again.withColumn("each", (some(F.col("n") + 1) - some(F.col("n"))).cast("long")).drop("n"))
    out = once.filter("each > 0").withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("each").cast("long"))))
    return out.select(*[F.col("given").getField(c).alias(c) for c in docs.columns])
