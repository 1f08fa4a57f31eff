"""From raw documents to token ids: the corpus pipeline.

Each stage takes (spark, docs, sf_dir), works on every row its predecessor kept, and returns a DataFrame; all but the
last return the columns of documents. Between stages the rows are written to the shared folder and read again.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm import bpe, mixing, neardup, pii, quality
from tidewatch.llm.queries import ranks
from tidewatch.llm.store import freed, freed_since, fresh, mark, quoted, staged

#: Shingle sets at least so alike, in per cent, make near-duplicates of two documents.
LIKE = 80


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the quality classifier rejects.

    Null and empty texts are scored by the constant feature alone and stay or go by it; rows that repeat an id are judged
    each for itself; a null id is scored like any other; an empty table stays empty.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    name = fresh(docs, "quality_score")
    scored = quality.score(docs, quality.train(docs, labels), name)
    return scored.filter(F.col(name) >= quality.CUT).select(*[quoted(c) for c in docs.columns])


def keep_firsts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each near-duplicate group stays, that of the smallest id, and one of each repeated id and text.

    Rows are told apart by a key of their own, so near copies without an id or under one id are judged like others. A
    row without an id stays only where its group has no id. Null and empty texts are like nothing but themselves under one
    id. An empty table stays empty.
    """
    key = fresh(docs, "row_key")
    keyed = staged(docs.withColumn(key, F.monotonically_increasing_id()))
    parts = neardup.groups(keyed.select(F.col(key).alias("doc_id"), "text"), LIKE)
    parts = parts.select(F.col("doc_id").alias("key"), "n_shingles", "component_id")
    ids = keyed.select(F.col(key).alias("key"), F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("hash"))
    empty = (F.col("n_shingles") == 0) & F.col("id").isNotNull()
    group = [empty.alias("empty"), F.when(empty, F.col("id")).otherwise(F.col("component_id")).alias("group"), F.when(empty, F.col("hash")).alias("hash")]
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "key"))
    firsts = parts.join(ids, "key").select("key", "id", *group).groupBy("empty", "group", "hash").agg(first.alias("first"))
    firsts = firsts.select(F.col("first.key").alias(key))
    firsts = staged(firsts)
    gone = staged(keyed.select(key).join(firsts, key, "left_anti"))
    freed(firsts)
    few = gone.count() <= neardup.BROADCAST_IDS
    return keyed.join(F.broadcast(gone) if few else gone, key, "left_anti").select(*[quoted(c) for c in docs.columns])


def hide_personal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Masks personal data and the terms that disclose it. Null texts stay null, empty ones empty; repeated rows are masked alike; no row goes."""
    return pii.sanitise(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it. Null and empty texts count no words; rows that repeat an id and text share their copies; a null source is a source of its own."""
    return mixing.mix(docs)


def to_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian unsigned 32-bit) and the digest of the bytes they decode to, for each row; null and empty texts have no ids."""
    return bpe.encode(docs, ranks(), public_tokenizers.PATTERN, decoded=True).select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("quality classifier", keep_good),
    ("MinHash near-dedup", keep_firsts),
    ("PII", hide_personal),
    ("mixing sources to target weights", mix_sources),
    ("byte-level BPE encoding and decoding", to_tokens),
]

#: A trained model's decisions and random offsets per stage are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The token ids of what all stages keep. Each stage's tables go when the next one's input is written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        start, before = mark(), docs
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = staged(docs)
            freed_since(start, docs)
            if i:
                freed(before)
    return docs
