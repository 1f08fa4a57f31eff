"""Queries of the numbered operators and their SQL."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, fim, langid, lbl, lexical, mih, mixing, neardup, omh, pii, quality, tokenscan, warc
from .store import scratch, small_batches, staged
from .words import words


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ranks() -> bytes:
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        return f.read()


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids and the bytes they decode to, as digests."""
    return bpe.encode(table(spark, sf_dir, "documents"), ranks(), public_tokenizers.PATTERN, decoded=True).select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def captures(pages: DataFrame) -> DataFrame:
    """Four captures of every page: a full response and three later revisits, whose validators say the same (1),
    say it by time alone (2), or contradict it for every fifth page (3)."""
    md5 = F.md5(F.coalesce("html", F.lit("")).cast("binary"))
    rows = pages.withColumn("n", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(3).cast("long")))).withColumn("digest", md5)
    day = F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), (F.col("n") * 30).cast("int")), "yyyy-MM-dd")
    changed = F.date_format(F.date_add(F.lit("2020-01-01").cast("date"), F.pmod(F.col("page_id"), F.lit(900)).cast("int")), "yyyy-MM-dd")
    tag = F.when((F.col("n") == 3) & (F.col("page_id") % 5 == 0), F.lit("other")).otherwise(F.col("digest"))
    headers = F.map_filter(F.create_map(F.lit("date"), day, F.lit("etag"), F.when(F.col("n") != 2, F.when(F.col("n") == 1, F.concat(F.lit("W/"), tag)).otherwise(tag)), F.lit("last-modified"), changed, F.lit("server"), F.concat(F.lit("s"), F.col("n").cast("string"))), lambda k, v: v.isNotNull())
    return rows.select(
        (F.col("page_id") * 4 + F.col("n")).alias("record_id"),
        "page_id",
        (F.col("n") * 1_000_000_000 + F.col("page_id")).alias("at"),
        "url",
        F.when(F.col("n") == 0, "response").otherwise("revisit").alias("kind"),
        F.when(F.col("n") == 0, F.col("digest")).alias("digest"),
        headers.alias("headers"),
    )


def op2_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every capture of every page with the response that it stands for, -1 for none."""
    rows = warc.resolve(captures(table(spark, sf_dir, "pages").select("page_id", "url", "html")))
    headers = F.array_join(F.array_sort(F.transform(F.map_entries("merged_headers"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), ";")
    return rows.select("record_id", "page_id", "url_key", F.coalesce("original_id", F.lit(-1)).alias("original_id"), "status", "body_digest", headers.alias("headers"))


OP2_SQL = r"""
WITH p AS (
  SELECT page_id, url, md5(coalesce(html, '')) AS md5, unnest(range(4))::BIGINT AS n FROM pages
), u AS (
  SELECT *, regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS bare FROM p
), c AS (
  SELECT *, regexp_replace(regexp_replace(lower(regexp_extract(bare, '^([^/?]*)', 1)), ':(80|443)$', ''), '^(www|m)[.]', '')
    || regexp_replace(regexp_extract(bare, '^[^/?]*([^?]*)', 1), '(/index)?([.]html?)?/*$', '') AS place,
    array_to_string(list_sort(list_filter(string_split(regexp_extract(bare, '[?](.*)$', 1), '&'),
      lambda x: x <> '' AND NOT regexp_matches(x, '^(utm_[a-z]+|ref|fbclid|gclid)(=|$)'))), '&') AS query FROM u
), r AS (
  SELECT page_id * 4 + n AS record_id, page_id, n * 1000000000 + page_id AS t, n = 0 AS is_full, n, md5,
    place || CASE WHEN query <> '' THEN '?' || query ELSE '' END AS url_key,
    CASE WHEN n <> 2 THEN CASE WHEN n = 3 AND page_id % 5 = 0 THEN 'other' ELSE md5 END END AS tag,
    strftime(DATE '2020-01-01' + (page_id % 900)::INTEGER, '%Y-%m-%d') AS changed,
    strftime(DATE '2024-01-01' + (n * 30)::INTEGER, '%Y-%m-%d') AS day
  FROM c
), f AS (
  SELECT *, last_value(CASE WHEN is_full THEN {'id': record_id, 'md5': md5, 'tag': tag, 'changed': changed, 'n': n} END IGNORE NULLS)
    OVER (PARTITION BY url_key ORDER BY t, record_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS o FROM r
), s AS (
  SELECT *, CASE WHEN is_full THEN 'full' WHEN url_key IS NULL OR o IS NULL THEN 'no original'
    WHEN coalesce(tag = o.tag, changed = o.changed, true) THEN 'resolved' ELSE 'mismatch' END AS status FROM f
)
SELECT record_id, page_id, url_key, CASE status WHEN 'full' THEN record_id WHEN 'resolved' THEN o.id ELSE -1 END AS original_id, status,
  CASE status WHEN 'full' THEN md5 WHEN 'resolved' THEN o.md5 END AS body_digest,
  'date=' || day || CASE WHEN tag IS NOT NULL THEN ';etag=' || CASE WHEN n = 1 THEN 'W/' ELSE '' END || tag
    WHEN status = 'resolved' THEN ';etag=' || o.tag ELSE '' END
    || ';last-modified=' || changed || ';server=s' || CASE WHEN status = 'resolved' THEN o.n ELSE n END AS headers
FROM s
"""

#: The query's token files: 16-bit identifiers, the last one ends a document, five digits of an id go before its words.
EOD, HEAD, DIGIT, FLAT_BLOCK = 65535, 5, 15, 1 << 16


def token_files(docs: DataFrame) -> DataFrame:
    """file, length of one flat token file for each task that holds documents, in a new folder of the shared one.

    A document is the digits of its id, its words by hash, and the end. A task that runs again writes another file; only
    the files whose task has ended well are told.
    """
    folder = scratch(docs.sparkSession)
    # Spark makes the folder, as it makes those of its own tables
    docs.sparkSession.createDataFrame([], "file string").write.mode("append").parquet(folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, length, out = f"{folder}/{uuid.uuid4().hex}.bin", 0, None
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for w in words(batch.column(1)):
                tokens, n = (w.hash % np.uint64(EOD)).astype("<u2"), len(w.bounds) - 1
                out = out or tokenscan.open_file(path, write=True)
                for doc_id, a, b in zip(ids[w.first : w.first + n], w.bounds[:-1].tolist(), w.bounds[1:].tolist(), strict=True):
                    digits = [2**DIGIT - 1] * HEAD if doc_id is None else [(doc_id % 2**64) >> (DIGIT * i) & (2**DIGIT - 1) for i in range(HEAD)]
                    data = np.concatenate([np.array(digits, "<u2"), tokens[a:b], np.array([EOD], "<u2")]).tobytes()
                    length += out.write(data)
        if out:
            out.close()
            yield pa.RecordBatch.from_pydict({"file": [path], "length": pa.array([length], pa.int64())})

    return staged(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "file string, length long"))


def op3_separator_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of every document, from flat token files of the documents' words laid end to end."""
    small_batches(spark)
    files = token_files(table(spark, sf_dir, "documents"))
    rows = tokenscan.documents(tokenscan.blocks_of(files, block_tokens=FLAT_BLOCK), EOD, head=HEAD)
    doc_id = F.expr(f"aggregate(head, named_struct('id', 0L, 'at', 0), (s, x) -> named_struct('id', s.id | shiftleft(x, s.at), 'at', s.at + {DIGIT}), s -> s.id)")
    return rows.select(F.when(F.col("head")[HEAD - 1] < 2**DIGIT - 1, doc_id).alias("doc_id"), (F.col("n_tokens") - HEAD).alias("n_tokens"))


OP3_SQL = r"SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS n_tokens FROM documents"


def op4_multi_index_hashing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest sign codes of every vector whose id is divisible by 20, among all others."""
    codes = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("long").alias("id"), mih.code("embedding").alias("code"))
    found = mih.search(codes, codes.filter("id % 20 = 0"), 10)
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), "distance")


OP4_SQL = """
WITH c AS (
  SELECT DISTINCT vec_id, list_transform(range(1, 65), lambda i: coalesce(embedding[i] > 0 AND NOT isnan(embedding[i]), false)) AS bits
  FROM embeddings WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
), d AS (
  SELECT q.vec_id AS query_id, c.vec_id,
    list_sum(list_transform(range(1, 65), lambda i: (q.bits[i] <> c.bits[i])::INTEGER))::INTEGER AS distance
  FROM c q JOIN c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0
)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id)::INTEGER AS rank, vec_id, distance
FROM d QUALIFY rank <= 10
"""


def op5_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document, of its edited text, and their likenesses."""
    rows = omh.edited_pairs(table(spark, sf_dir, "documents"))
    return rows.select(
        "doc_id",
        "n_chars",
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        omh.as_string("fp").alias("fingerprint"),
        omh.as_string("edited_fp").alias("edited_fingerprint"),
        omh.likeness("fp", "edited_fp").alias("near_edited"),
        omh.likeness("fp", "next_fp").alias("near_next"),
    )


def op6_minhash_odd_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of documents at a likeness of 0.85."""
    return neardup.groups(table(spark, sf_dir, "documents"))


OP6_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS shingle FROM w
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY ALL
), links AS (
  SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * common >= 85 * (x.n + y.n - common)
), reach AS (SELECT a AS doc_id, a AS other FROM links UNION SELECT reach.doc_id, links.b FROM reach JOIN links ON links.a = reach.other
), c AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(c.component_id, w.doc_id) AS component_id,
  coalesce(c.component_id, w.doc_id) = w.doc_id AS kept
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN c USING (doc_id)
"""

def op7_disclosure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of personal data in every document, and of the terms that disclose it: which of them are removed, and which
    give way to which broader term ([TERM] where there is none)."""
    rows = pii.find(table(spark, sf_dir, "documents"), generalise=True)
    counts = [F.size(k).cast("long").alias(f"n_{k}") for k in pii.KINDS]
    digest = F.sha2(pii.listed(*pii.KINDS).cast("binary"), 256).alias("base_sha256")
    gone = F.filter("terms", lambda x: x["disclosure"] >= pii.REMOVE)
    wide = F.filter("terms", lambda x: x["disclosure"] < pii.REMOVE)
    removed = F.array_join(F.transform(gone, lambda x: F.concat_ws(":", x["start"], x["end"])), ",")
    generalised = F.array_join(F.transform(wide, lambda x: F.concat_ws(":", x["start"], x["end"], F.coalesce(x["broader"], F.lit("[TERM]")))), ",")
    return rows.select("doc_id", *counts, digest, pii.listed(*pii.KINDS, "terms").alias("spans"), removed.alias("removed"), generalised.alias("generalised"))


def op8_systematic_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words of every document the mix takes."""
    rows = mixing.copies(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


OP8_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight FROM d GROUP BY source
), l AS (
  SELECT *, 3.0::DOUBLE * source_size / weight AS level, sum(source_size) OVER ()::BIGINT AS total, sum(weight) OVER ()::BIGINT AS weights FROM s
), c AS (
  SELECT a.*, (SELECT (any_value(b.total) - 3 * coalesce(sum(b.source_size) FILTER (b.level < a.level), 0))::BIGINT::DOUBLE
    / (any_value(b.weights) - coalesce(sum(b.weight) FILTER (b.level < a.level), 0))::BIGINT::DOUBLE FROM l b) AS share FROM l a
), t AS (
  SELECT source, source_size, CASE WHEN level < (SELECT min_by(share, level) FROM c WHERE level >= share) THEN 3.0::DOUBLE * source_size
    ELSE weight * (SELECT min_by(share, level) FROM c WHERE level >= share) END AS target FROM c
), n AS (
  SELECT d.*, row_number() OVER (PARTITION BY source ORDER BY size, doc_id NULLS LAST) AS n FROM d
), r AS (
  SELECT n.*, source_size, target, CASE WHEN source_size > 0 THEN target / source_size::DOUBLE ELSE 0.0 END AS rate,
    ('0x' || substr(md5(coalesce(n.source, '')), 1, 8))::BIGINT::DOUBLE / 4294967296.0::DOUBLE AS offset_
  FROM n JOIN t ON n.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target, ((floor(n::DOUBLE * rate + offset_) - floor((n - 1)::DOUBLE * rate + offset_)) * size)::BIGINT AS taken FROM r
"""


def op9_log_bilinear(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log-probabilities of every document under the model learned from the training documents."""
    return lbl.score(table(spark, sf_dir, "documents"))


def op10_ftrl_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of every document by the model fitted on the labels outside the held-out fold."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    weights = quality.train(docs, table(spark, sf_dir, "labels"))
    rows = quality.score(docs, weights)
    return rows.select("doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= quality.CUT, 1).otherwise(0).alias("predicted"))


def op11_fenwick_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document in fill-in-middle form, and what it is put back to, as digests."""
    rows = fim.transform(table(spark, sf_dir, "documents").select("doc_id", "text"))
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    return rows.select("doc_id", F.col("n_units").alias("n"), "form", "prefix_chars", "middle_chars", sha(F.col("output")).alias("output_sha256"), sha(fim.restored(F.col("output"), F.col("form"))).alias("restored_sha256"))


OP11_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents
), u AS (
  SELECT *, CASE WHEN t = '' THEN [] ELSE regexp_extract_all(t, '[A-Za-z]+|[^A-Za-z]') END AS u,
    ('0x' || substr(h, 1, 8))::BIGINT AS h1, ('0x' || substr(h, 9, 8))::BIGINT AS h2, ('0x' || substr(h, 17, 8))::BIGINT AS h3, ('0x' || substr(h, 25, 8))::BIGINT AS h4 FROM d
), c AS (
  SELECT *, len(u)::BIGINT AS n, least(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS a, greatest(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS b,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM u
), p AS (
  SELECT *, array_to_string(u[1:a], '') AS pre, array_to_string(u[a + 1:b], '') AS mid, array_to_string(u[b + 1:n], '') AS suf FROM c
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM p
"""


def op12_zstd_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document by the dictionaries of the training texts; accepted tells wide margins."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    rows = langid.classify(docs.select("doc_id", "text"), langid.learn(docs))
    return rows.select("doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "accepted")


def op13_rmq_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best documents of every benchmark item, among all documents."""
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP13_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS k, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents
), q AS (
  SELECT item_id, term, count(*) AS c FROM (SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark) GROUP BY ALL
), g AS (SELECT count(*)::BIGINT AS n, sum(len(w))::BIGINT AS l FROM d WHERE len(w) > 0
), o AS (SELECT k, term, count(*)::BIGINT AS tf FROM (SELECT k, unnest(w) AS term FROM d) SEMI JOIN (SELECT DISTINCT term FROM q) USING (term) GROUP BY ALL
), t AS (SELECT term, floor(1000 * ln((2 * any_value(g.n) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS weight FROM o, g GROUP BY term
), i AS (
  SELECT o.k, o.term, t.weight * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + (25 * len(d.w)::BIGINT * g.n) // g.l))) AS impact FROM o JOIN t USING (term) JOIN d USING (k), g
), s AS (SELECT item_id, k, sum(c * impact)::BIGINT AS score FROM i JOIN q USING (term) GROUP BY ALL
)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST)::INTEGER AS rank, doc_id, score
FROM s JOIN d USING (k) WHERE score > 0 QUALIFY rank <= 20
"""


QUERIES = {f.__name__: f for f in (op1_byte_bpe, op2_warc_revisits, op3_separator_scan, op4_multi_index_hashing, op5_order_minhash, op6_minhash_odd_sketch, op7_disclosure, op8_systematic_mix, op9_log_bilinear, op10_ftrl_quality, op11_fenwick_fim, op12_zstd_language, op13_rmq_search)}
SQL = {
    "op2_warc_revisits": OP2_SQL,
    "op3_separator_scan": OP3_SQL,
    "op4_multi_index_hashing": OP4_SQL,
    "op6_minhash_odd_sketch": OP6_SQL,
    "op8_systematic_mix": OP8_SQL,
    "op11_fenwick_fim": OP11_SQL,
    "op13_rmq_search": OP13_SQL,
}
