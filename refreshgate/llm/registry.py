"""The operators over the test tables, one named query each, and their SQL where SQL can express them."""
import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from refreshgate.llm import (conversation_trie, filter_audit, language_id, license_scan, packing, piece_dropout, quality_model, quality_rules, simhash,
                             token_counts, top_k, url_filters, warc)
from refreshgate.llm.batches import id_remainder
from refreshgate.session import cut_lineage, shared_folder


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_packing(spark: SparkSession, folder: str) -> DataFrame:
    """All documents in sequences of 2048 tokens, without the ids themselves."""
    return packing.pack(_table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"), keep_ids=False)


def op2_language_id(spark: SparkSession, folder: str) -> DataFrame:
    """Rows without an id can be in no fold: they are never learned from and count as held out."""
    docs = _table(spark, folder, "documents")
    remainder = id_remainder(F.col("doc_id"), 4)
    model = language_id.fit(docs.where(remainder != 2))
    return language_id.identify(docs, model).select(
        "doc_id", F.coalesce(remainder == 2, F.lit(True)).alias("held_out"), "lang_pred", "score", "known")


def op3_top_k(spark: SparkSession, folder: str) -> DataFrame:
    """Of every vector whose id is divisible by 20, the 20 best of all others."""
    vectors = _table(spark, folder, "embeddings")
    return top_k.top_k(vectors, vectors.where(F.col("vec_id") % 20 == 0), k=20)


def op4_simhash(spark: SparkSession, folder: str) -> DataFrame:
    """All documents with their fingerprint, as hexadecimal digits, and their component."""
    found = simhash.classes(_table(spark, folder, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op5_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    """All documents judged by their counts and by a CRF that all labels teach."""
    docs = _table(spark, folder, "documents")
    return quality_rules.judge(docs, quality_rules.fit(docs, _table(spark, folder, "labels")))


def op6_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    """License phrases and templates in all documents."""
    return license_scan.scan(_table(spark, folder, "documents"))


def op7_warc(spark: SparkSession, folder: str) -> DataFrame:
    """All pages written as archives and read back; the last chunk of a record has its whole size and digest."""
    archives = f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}"
    warc.write_archives(_table(spark, folder, "pages"), archives)
    read = warc.read_chunks(spark, archives, payloads=False).where("last")
    return read.select(warc.page_id("record_id").alias("page_id"), F.col("bytes").alias("payload_bytes"),
                       F.col("digest").alias("payload_digest"), "record_type", warc.page_id("refers_to").alias("refers_to"))


def op8_quality_model(spark: SparkSession, folder: str) -> DataFrame:
    """Rows without an id have no label, are never learned from and count as held out."""
    statistics = cut_lineage(quality_model.document_statistics(_table(spark, folder, "documents")))
    remainder = id_remainder(F.col("doc_id"), 5)
    labels = _table(spark, folder, "labels").where(remainder != 0).select("doc_id", F.col("quality").alias("label"))
    scored = quality_model.score(statistics, quality_model.fit(statistics, labels))
    return scored.select("doc_id", F.coalesce(remainder == 0, F.lit(True)).alias("held_out"), "score",
                         (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op9_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Tokens of all documents, found in flat token files by their separators."""
    files = f"{shared_folder(spark)}/tokens-{uuid.uuid4().hex}"
    return token_counts.document_counts(_table(spark, folder, "documents"), files, public_tokenizers.path("byte_bpe_50k.json"))


def op10_sentencepiece(spark: SparkSession, folder: str) -> DataFrame:
    """All documents encoded with dropout and decoded again."""
    model = public_tokenizers.path("piece_bpe_32k.model")
    docs = piece_dropout.encoded(_table(spark, folder, "documents"), model, seed=17)
    text = F.coalesce("text", F.lit(""))
    return piece_dropout.decoded(docs, model).select(
        "doc_id", F.size("ids").cast("long").alias("n_pieces"), F.xxhash64("ids").alias("ids_hash"),
        F.octet_length("decoded").cast("long").alias("n_bytes"), (F.col("decoded") == text).alias("lossless"))


def op11_prefix_trie(spark: SparkSession, folder: str) -> DataFrame:
    """All conversations, each begun with the first turns of the first one of its family of five."""
    return conversation_trie.family_trie(_table(spark, folder, "conversations"))


def op12_url_filters(spark: SparkSession, folder: str) -> DataFrame:
    """Every page under four entries; a page that none of them fits is allowed."""
    return url_filters.judge(_table(spark, folder, "pages"), url_filters.PAGE_RULES)


def op13_filter_audit(spark: SparkSession, folder: str) -> DataFrame:
    """All documents, by language and by each of the 120 orders of the five filters."""
    return filter_audit.audit(_table(spark, folder, "documents"), _table(spark, folder, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_packing, op2_language_id, op3_top_k, op4_simhash, op5_quality_rules, op6_license_scan, op7_warc, op8_quality_model, op9_token_counts,
                            op10_sentencepiece, op11_prefix_trie, op12_url_filters, op13_filter_audit)}
SQL: dict[str, str] = {
    "op3_top_k": """
WITH whole AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
  FROM whole q JOIN whole c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM ranked WHERE rank <= 20""",
    "op6_license_scan": license_scan.oracle(),
    "op7_warc": """
WITH payloads AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
sized AS (SELECT page_id, payload, octet_length(payload) AS n FROM payloads),
newest AS (SELECT *, max(page_id) OVER (PARTITION BY CASE WHEN n >= 1000 THEN payload END) AS top FROM sized)
SELECT page_id, n::BIGINT AS payload_bytes, sha1(payload) AS payload_digest,
  CASE WHEN n >= 1000 AND top <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 1000 AND top <> page_id THEN top END AS refers_to
FROM newest""",
    "op11_prefix_trie": conversation_trie.oracle(),
    "op12_url_filters": url_filters.oracle(url_filters.PAGE_RULES),
    "op13_filter_audit": filter_audit.oracle(),
}
