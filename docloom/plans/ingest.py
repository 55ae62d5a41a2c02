"""Batch ingest: hash, dedup, gate, chunk, embed, index, flag."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.operators import dedup, documents, lexical, vector
from docloom.operators.hash_store import HashStore
from docloom.session import store_table


@dataclass
class Ingested:
    documents: DataFrame
    chunks: DataFrame
    postings: DataFrame
    rejects: DataFrame   # tenant_id, doc_id, reject_reason
    flags: DataFrame     # soft duplicate flags against the oldest copy by folded text


def ingest_batch(new_docs: DataFrame, stored: DataFrame, flags: DataFrame, profile: str = "hebrew", force: bool = False,
                 embedder: vector.Embedder | None = None, model: str = "hashed-words", hashes: HashStore | None = None) -> Ingested:
    """new_docs(tenant_id, doc_id, filename, text, pages, extraction_partial, ingested_at[, content_sha256]); stored are
    the documents already in the corpus. A row leaves through ``rejects`` with a reason instead of an error. With ``hashes``, the store of their
    content hashes, known copies are found through its filter instead of a join with ``stored``; adding the batch to it is the caller's."""
    hashed = new_docs if "content_sha256" in new_docs.columns else dedup.with_content_hash(new_docs)
    unique = dedup.dedup_content(hashed, stored) if hashes is None else hashes.fresh(hashed)
    copies = hashed.join(unique.select("doc_id"), "doc_id", "left_anti").select("tenant_id", "doc_id", F.lit("duplicate").alias("reject_reason"))
    gated = documents.gate(unique, force)
    passed = dedup.with_text_hash(gated.filter("reject_reason is null").drop("reject_reason")).withColumn(
        "chars_extracted", F.length("text")).withColumn("embedding_model", F.lit(model))
    # documents, chunks, postings and rejects all need these: hashed, cut and embedded once
    passed = store_table(passed, "passed")
    pieces = documents.tag_decisions(documents.chunk_documents(passed.select("tenant_id", "doc_id", "filename", "text"), profile))
    pieces = store_table(vector.embed(documents.with_embedding_input(pieces), "embedding_input", embedder).drop("embedding_input"), "pieces")
    counts = pieces.groupBy("doc_id").agg(F.count("*").alias("chunks_created"))
    counted = passed.drop("text").join(counts, "doc_id", "left")
    empty = counted.filter("chunks_created is null").select("tenant_id", "doc_id", F.lit("no_chunks").alias("reject_reason"))
    docs = counted.filter("chunks_created is not null")
    chunks = pieces.drop("filename")
    rejects = (copies.unionByName(gated.filter("reject_reason is not null").select("tenant_id", "doc_id", "reject_reason")).unionByName(empty))
    cols = ["tenant_id", "doc_id", "text_sha256", "ingested_at"]
    hashes = docs.select("text_sha256").distinct()
    everything = stored.select(*cols).join(hashes, "text_sha256", "left_semi").select(*cols).unionByName(docs.select(*cols))
    new_flags = (dedup.text_duplicate_flags(everything, flags).join(docs.select(F.col("doc_id").alias("new_doc_id")), "new_doc_id", "left_semi"))
    return Ingested(docs, chunks, lexical.build_postings(chunks), rejects, new_flags)
