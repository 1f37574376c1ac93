"""Queries of the training-text problems and the SQL that states the same result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keystrata.llm.bpe import count_tokens, decode_documents, encode_documents
from keystrata.llm.packing import fill_report, pack
from keystrata.llm.privacy import disclosure, find_candidates, find_personal, redact
from keystrata.llm.seen import SeenKeys, error_rate, seen_before
from keystrata.sources.scratch import new_folder, written
from keystrata.sources.tables import table


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Incoming records whose key occurred before."""
    return seen_before(table(spark, d, "row_entry"), table(spark, d, "incoming_key")).filter("seen").select("incoming_id")


def p4_decisions(spark: SparkSession, d: str) -> DataFrame:
    """The filter's and the exact answer for every incoming record."""
    return seen_before(table(spark, d, "row_entry"), table(spark, d, "incoming_key"))


def p4_seen(spark: SparkSession, d: str) -> DataFrame:
    """The exact answer for every incoming record."""
    return p4_decisions(spark, d).drop("maybe_seen")


def p4_batches(spark: SparkSession, d: str) -> DataFrame:
    """The exact answer for every incoming record, from filters kept over two batches of earlier records."""
    kept = SeenKeys(spark, f"{new_folder(spark, 'seen-keys')}/t")
    history = table(spark, d, "row_entry").select(F.monotonically_increasing_id().alias("incoming_id"), "key", (F.coalesce(F.col("wal_id"), F.lit(0)) % 2).alias("half"))
    for half in (0, 1):
        kept.check(history.filter(F.col("half") == half).drop("half"))
    return kept.check(table(spark, d, "incoming_key")).drop("maybe_seen")


def p4_error_rate(spark: SparkSession, d: str) -> DataFrame:
    """Measured rate of wrong answers of the filters."""
    return error_rate(table(spark, d, "row_entry"), table(spark, d, "incoming_key"))


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    """Token ids of every document."""
    return encode_documents(table(spark, d, "documents"))


def p6_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Whether decoding the ids of a document gives its text back, byte for byte."""
    documents = table(spark, d, "documents").select("doc_id", "text")
    back = decode_documents(encode_documents(documents)).withColumnRenamed("text", "decoded")
    return documents.join(back, "doc_id").select("doc_id", F.coalesce("text", F.lit("")).eqNullSafe(F.col("decoded")).alias("equal"))


def _packed(spark: SparkSession, d: str) -> DataFrame:
    sizes = written(count_tokens(table(spark, d, "documents")), "token-counts")
    return pack(sizes, table(spark, d, "container_spec"))


def p7_pack(spark: SparkSession, d: str) -> DataFrame:
    """Every document in containers of every capacity."""
    return _packed(spark, d).drop("refused")


def p7_fill(spark: SparkSession, d: str) -> DataFrame:
    """How full the containers of every capacity are, and how often each constraint refused one."""
    return fill_report(_packed(spark, d))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    """Places that name or reach a person, by kind."""
    return find_personal(table(spark, d, "documents"))


def p8_redacted(spark: SparkSession, d: str) -> DataFrame:
    """Every text with placeholders in the stead of personal information."""
    documents = table(spark, d, "documents")
    return redact(documents, find_personal(documents))


def p8_terms(spark: SparkSession, d: str) -> DataFrame:
    """Terms with the bits by which they disclose a protected entity."""
    return disclosure(written(find_candidates(table(spark, d, "documents")), "personal"))


QUERIES = {f.__name__: f for f in (p4_found, p4_decisions, p4_seen, p4_batches, p4_error_rate, p6_ids, p6_roundtrip, p7_pack, p7_fill, p8_found, p8_redacted, p8_terms)}

_P4 = """
WITH known AS (SELECT DISTINCT key FROM row_entry WHERE octet_length(key) > 0),
first AS (SELECT key, min(incoming_id) AS first_id FROM incoming_key WHERE octet_length(key) > 0 GROUP BY key),
answer AS (SELECT i.incoming_id, coalesce(octet_length(i.key) > 0 AND (k.key IS NOT NULL OR i.incoming_id > f.first_id), false) AS seen
           FROM incoming_key i LEFT JOIN known k ON i.key = k.key LEFT JOIN first f ON i.key = f.key)
"""

_SEEN = _P4 + "SELECT incoming_id, seen FROM answer"

ORACLE = {"p4_found": _P4 + "SELECT incoming_id FROM answer WHERE seen", "p4_seen": _SEEN, "p4_batches": _SEEN, "p6_roundtrip": "SELECT doc_id, true AS \"equal\" FROM documents"}
