"""Duplicate detection and removal plans."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.functions import pieces
from docloom.operators.scale import attach_groups, top_n
from docloom.operators.slices import ROWS_IN


def with_content_hash(docs: DataFrame, content_col: str = "text") -> DataFrame:
    return docs.withColumn("content_sha256", F.sha2(F.col(content_col).cast("binary"), 256))


def dedup_content(new: DataFrame, existing: DataFrame) -> DataFrame:
    """New documents whose hash is not stored yet; the first of a batch wins (D1). Both carry tenant_id, content_sha256."""
    known = existing.filter("content_sha256 is not null").select("tenant_id", "content_sha256").distinct()
    fresh = new.join(known, ["tenant_id", "content_sha256"], "left_anti")
    nulls = fresh.filter("content_sha256 is null")
    return top_n(fresh.filter("content_sha256 is not null"), ["tenant_id", "content_sha256"],
                 [F.col("ingested_at"), F.col("doc_id")], 1).unionByName(nulls)


def duplicate_groups(docs: DataFrame, key: str = "content_sha256") -> DataFrame:
    """Members of every group of equal hashes (D2): group_size, oldest_doc_id, is_oldest. One row per member, so a hot
    group stays spread; sort by (group_size desc, key, ingested_at) to read it as a list."""
    oldest = F.min(F.struct("ingested_at", "doc_id")).alias("_old")
    groups = (docs.filter(F.col(key).isNotNull()).groupBy("tenant_id", key).agg(F.count("*").alias("group_size"), oldest)
              .filter("group_size > 1").select("tenant_id", key, "group_size", F.col("_old.doc_id").alias("oldest_doc_id")))
    return attach_groups(docs.filter(F.col(key).isNotNull()), groups, ["tenant_id", key], "group_size", "doc_id").withColumn(
        "is_oldest", F.col("doc_id") == F.col("oldest_doc_id"))


@F.arrow_udf(T.StringType())
def _folded_hash(texts: pa.Array) -> pa.Array:
    # few texts at a time are Python objects
    cut = (texts.slice(low, ROWS_IN).to_pylist() for low in range(0, len(texts), ROWS_IN))
    return pa.array((pieces.folded_hash(t) for part in cut for t in part), pa.string(), size=len(texts))


def with_text_hash(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Hash of the letters and digits only (D3), for copies that differ in format."""
    return docs.withColumn("text_sha256", _folded_hash(text_col))


def text_duplicate_flags(docs: DataFrame, flags: DataFrame) -> DataFrame:
    """Flag each newer copy against the oldest of its text group, unless the pair is flagged in either direction (D3)."""
    members = duplicate_groups(docs, "text_sha256").filter("not is_oldest")
    pairs = members.select("tenant_id", F.col("doc_id").alias("new_doc_id"), F.col("oldest_doc_id").alias("existing_doc_id"))
    known = flags.select("new_doc_id", "existing_doc_id")
    known = known.unionByName(known.select(F.col("existing_doc_id").alias("new_doc_id"), F.col("new_doc_id").alias("existing_doc_id")))
    return (pairs.join(known, ["new_doc_id", "existing_doc_id"], "left_anti")
            .withColumn("kind", F.lit("duplicates")).withColumn("topic", F.lit("duplicate_text_hash"))
            .withColumn("confidence", F.lit(1.0)).withColumn("status", F.lit("pending")))


def answer_refs(answers: DataFrame, chunks: DataFrame) -> DataFrame:
    """How many approved answers cite each document."""
    cited = answers.select("answer_id", F.explode("source_chunk_ids").alias("chunk_id"))
    return (cited.join(chunks.select("chunk_id", "doc_id"), "chunk_id").select("doc_id", "answer_id").distinct()
            .groupBy("doc_id").agg(F.count("*").alias("ref_count")))


def fingerprint_siblings(docs: DataFrame) -> DataFrame:
    """Documents sharing (chars, pages, chunks) with others (D5): one row per member with the group's fingerprint, the
    number of siblings and the group's first id. Siblings are the other members of the same fingerprint."""
    key = ["tenant_id", "chars_extracted", "pages", "chunks_created"]
    known = docs.filter("chars_extracted is not null and pages is not null and chunks_created is not null")
    groups = known.groupBy(*key).agg(F.count("*").alias("group_size"), F.min("doc_id").alias("first_doc_id")).filter("group_size > 1")
    return (attach_groups(known, groups, key, "group_size", "doc_id")
            .withColumn("siblings", F.col("group_size") - 1).drop("group_size"))


def deletion_plan(docs: DataFrame, key: str = "content_sha256") -> DataFrame:
    """Every duplicate but the oldest of its group."""
    return duplicate_groups(docs, key).filter("not is_oldest").select("tenant_id", "doc_id", key, "oldest_doc_id")


def apply_deletes(requested: DataFrame, docs: DataFrame, chunks: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(report, documents, chunks) after a delete list (D6). requested(tenant_id, doc_id): the caller's own tenant; an id
    of another tenant is 'forbidden', an unknown one 'not_found', the rest 'deleted' together with their chunks."""
    owner = docs.select("doc_id", F.col("tenant_id").alias("_owner"))
    report = (requested.select("tenant_id", "doc_id").distinct().join(owner, "doc_id", "left")
              .withColumn("outcome", F.when(F.col("_owner").isNull(), "not_found")
                          .when(F.col("_owner") != F.col("tenant_id"), "forbidden").otherwise("deleted")).drop("_owner"))
    gone = report.filter("outcome = 'deleted'").select("doc_id")
    return report, docs.join(gone, "doc_id", "left_anti"), chunks.join(gone, "doc_id", "left_anti")
