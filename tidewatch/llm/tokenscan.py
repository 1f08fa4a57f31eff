"""Documents of flat token files, found by their end-of-document identifiers.

A token file is a run of little-endian identifiers of two or four bytes and nothing else. It is read in blocks that
know nothing of documents. One vectorised search finds the separators of a block; the block then tells how many it
has and how many tokens each piece between them holds. A prefix scan of the separator counts over a file's blocks
gives every piece its document's number, and the pieces of one number, at most one a block, are added up. Spark's own
binary reader takes a file whole; here a task opens the file through pyarrow and seeks to its block, so files may be of
any size. Stores that pyarrow cannot open are an error.

Defined cases: a file's tokens after its last separator are a document of their own if there are any. Empty
documents (two separators in a row) count. Null or empty blocks hold nothing. A file whose bytes are no multiple of
the token size is an error.
"""

from __future__ import annotations

import re
import urllib.parse
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .store import small_batches, staged

BLOCK_TOKENS = 1 << 19
#: Blocks that a task reads, one at a time.
TASK_BLOCKS = 16


def open_file(path: str, write: bool = False):
    """A file of any store that pyarrow reaches, to be read from any place in it or to be written."""
    if path.startswith("file:") or "://" not in path:
        store, at = fs.LocalFileSystem(), re.sub("^file:/*", "/", path)
    else:
        store, at = fs.FileSystem.from_uri(urllib.parse.quote(path, safe="/:@"))
    return store.open_output_stream(at) if write else store.open_input_file(at)


def listed(spark: SparkSession, path: str) -> DataFrame:
    """file, length of all files under path; their content is not read."""
    return spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), F.col("length").cast("long").alias("length"))


def blocks_of(files: DataFrame, token_bytes: int = 2, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """file, block, data of token files (file, length). Each block is read by itself, so a file's tasks grow with its length."""
    step = block_tokens * token_bytes
    checked = F.when(F.col("length") % token_bytes == 0, F.col("length")).otherwise(F.raise_error(F.concat(F.lit("no whole tokens: "), "file")).cast("long"))
    blocks = files.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.floor((checked - 1) / step), F.lit(0)))))
    tasks = files.agg(F.sum(F.ceil(F.col("length") / step))).first()[0] or 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, block in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with open_file(file) as f:
                    data = f.read_at(step, block * step)
                yield pa.RecordBatch.from_pydict({"file": [file], "block": pa.array([block], pa.int64()), "data": pa.array([data], pa.binary())})

    dealt = blocks.select("file", "block").repartition(max(1, -(-int(tasks) // TASK_BLOCKS)), "file", "block")
    return dealt.mapInArrow(run, "file string, block long, data binary")


def read_files(spark: SparkSession, path: str, token_bytes: int = 2, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """file, block, data of all token files under path: listed by Spark, and read by the tasks with a seek to each block."""
    return blocks_of(listed(spark, path), token_bytes, block_tokens)


def _pieces(eod: int, dtype: str, head: int):
    schema = pa.schema([("file", pa.string()), ("block", pa.int64()), ("ends", pa.int64()), ("pieces", pa.list_(pa.struct([("at", pa.int32()), ("tokens", pa.int64()), ("open", pa.bool_()), ("head", pa.list_(pa.int64()))])))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for file, block, data in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                tokens = np.frombuffer(data or b"", dtype)
                stop = np.flatnonzero(tokens == eod)
                start = np.concatenate(([0], stop + 1))
                sizes = np.diff(np.concatenate((start, [len(tokens) + 1]))) - 1
                pieces = [{"at": i, "tokens": n, "open": i == len(stop), "head": tokens[a : a + min(n, head)].tolist()} for i, (a, n) in enumerate(zip(start.tolist(), sizes.tolist(), strict=True))]
                rows.append({"file": file, "block": block, "ends": len(stop), "pieces": pieces})
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return run


def documents(blocks: DataFrame, eod: int, token_bytes: int = 2, head: int = 0) -> DataFrame:
    """file, document (0, 1, ... in the file), n_tokens without the separator, head: its first tokens, for blocks (file, block, data)."""
    small_batches(blocks.sparkSession)
    kinds = "file string, block long, ends long, pieces array<struct<at:int,tokens:long,open:boolean,head:array<long>>>"
    found = staged(blocks.select(F.col("file").cast("string").alias("file"), F.col("block").cast("long").alias("block"), "data").mapInArrow(_pieces(eod, f"<u{token_bytes}", head), kinds))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = found.select("file", "block", F.coalesce(F.sum("ends").over(before), F.lit(0)).alias("before"))
    pieces = found.join(offsets, ["file", "block"]).select("file", "block", "before", F.explode("pieces").alias("p"))
    pieces = pieces.select("file", "block", (F.col("before") + F.col("p.at")).alias("document"), F.col("p.tokens").alias("tokens"), F.col("p.open").alias("open"), F.col("p.head").alias("head"), F.col("p.at").alias("at"))
    # only a block's first and last piece may belong with another block's
    inner = pieces.filter("at > 0 AND NOT open").select("file", "document", F.col("tokens").alias("n_tokens"), "head")
    edge = pieces.filter("at = 0 OR open").groupBy("file", "document").agg(F.sum("tokens").alias("n_tokens"), F.bool_and("open").alias("open"), F.array_sort(F.collect_list(F.when(F.size("head") > 0, F.struct("block", "head")))).alias("heads"))
    edge = edge.filter("NOT open OR n_tokens > 0").select("file", "document", "n_tokens", F.slice(F.flatten(F.transform("heads", lambda x: x["head"])), 1, max(head, 1)).alias("head"))
    return inner.unionByName(edge)
