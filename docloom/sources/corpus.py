"""Reading and writing corpus tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMAS = {
    "documents": """doc_id STRING, tenant_id STRING, filename STRING, doc_type STRING, forum STRING, doc_status STRING, folder STRING,
        effective_date DATE, superseded_by_id STRING, parent_doc_id STRING, source_uri STRING, content_sha256 STRING,
        text_sha256 STRING, ingested_at TIMESTAMP, summary STRING, ai_title STRING, metadata_reviewed BOOLEAN, document_date DATE,
        meeting_number STRING, decision_number STRING, bylaw_section_range STRING, extractor STRING, used_ocr BOOLEAN, pages INT,
        chars_extracted INT, chunks_created INT, extraction_partial BOOLEAN, extraction_note STRING, embedding_model STRING""",
    "chunks": """chunk_id STRING, doc_id STRING, tenant_id STRING, position INT, section_path STRING, section_ref STRING, text STRING,
        embedding ARRAY<DOUBLE>, decision_type STRING, effective_date DATE, superseded_by_amendment_id STRING, created_at TIMESTAMP""",
    "postings": "tenant_id STRING, lexeme STRING, chunk_id STRING, tf BIGINT, n_tokens INT",
    "amendments": """amendment_id STRING, tenant_id STRING, amendment_doc_id STRING, target_doc_id STRING, target_section STRING,
        action STRING, old_text STRING, new_text STRING, effective_date DATE, rationale STRING, extractor_confidence DOUBLE,
        needs_review BOOLEAN, evidence_span STRING, created_at TIMESTAMP""",
    "resolutions": """resolution_id STRING, tenant_id STRING, escalation_chunk_id STRING, escalation_doc_id STRING,
        terminal_doc_id STRING, terminal_chunk_id STRING, topic STRING, evidence_span STRING, extractor_confidence DOUBLE,
        needs_review BOOLEAN, created_at TIMESTAMP""",
    "flags": """flag_id STRING, tenant_id STRING, new_doc_id STRING, existing_doc_id STRING, new_chunk_id STRING,
        existing_chunk_id STRING, kind STRING, topic STRING, explanation STRING, evidence_new STRING, evidence_existing STRING,
        confidence DOUBLE, status STRING, created_at TIMESTAMP, reviewed_at TIMESTAMP""",
    "queries": """query_id STRING, tenant_id STRING, user_id STRING, conversation_id STRING, turn_index INT, question STRING,
        answer STRING, source_chunk_ids ARRAY<STRING>, confidence STRING, llm_used BOOLEAN, authoritative_answer_id STRING,
        golden_id STRING, feedback STRING, reviewer_action STRING, failure_mode STRING, retrieval_debug STRING, created_at TIMESTAMP""",
    "answers": """answer_id STRING, tenant_id STRING, canonical_question STRING, embedding ARRAY<DOUBLE>, answer STRING,
        source_chunk_ids ARRAY<STRING>, approved_at TIMESTAMP, status STRING, similarity_threshold DOUBLE""",
    "lexicon": """lexicon_id STRING, tenant_id STRING, term STRING, surface_forms ARRAY<STRING>, entry_type STRING, short_gloss STRING,
        answerer_expansion STRING, expansion STRING, notes STRING, source STRING, status STRING, confidence DOUBLE, updated_at TIMESTAMP""",
    "match_events": """tenant_id STRING, lexicon_id STRING, surface_form STRING, context STRING, text_id STRING, created_at TIMESTAMP""",
    "taxonomy": "folder_id STRING, tenant_id STRING, name STRING, description STRING, active BOOLEAN",
    "suggestions": """suggestion_id STRING, tenant_id STRING, proposed_name STRING, proposed_description STRING, source_doc_id STRING,
        source_title STRING, source_summary STRING, status STRING, created_at TIMESTAMP""",
    "runs": """run_id STRING, tenant_id STRING, git_sha STRING, trigger STRING, started_at TIMESTAMP, finished_at TIMESTAMP, total INT,
        avg_score DOUBLE, avg_retrieval DOUBLE, avg_keyword DOUBLE""",
}


def read_corpus(spark: SparkSession, path: str, pattern: str = "*.{txt,md}") -> DataFrame:
    """Text files under ``path``, one row each (S1): path, filename, content (bytes), text (UTF-8), modified_at, length."""
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path))
    return shape_files(files)


def shape_files(files: DataFrame) -> DataFrame:
    return files.select("path", F.regexp_extract("path", "([^/]+)$", 1).alias("filename"), "content",
                        F.try_validate_utf8(F.col("content").cast("string")).alias("text"),
                        F.col("modificationTime").alias("modified_at"), "length")


def load_table(spark: SparkSession, name: str, root: str, tenants: list[str] | None = None) -> DataFrame:
    """Typed parquet scan (S2). Tables partitioned by tenant_id read only the asked tenants' folders."""
    df = spark.read.schema(SCHEMAS[name]).parquet(f"{root.rstrip('/')}/{name}")
    return df.filter(F.col("tenant_id").isin(tenants)) if tenants else df


def write_table(df: DataFrame, name: str, root: str, mode: str = "overwrite") -> None:
    """Write partitioned by tenant; with dynamic overwrite only the tenants present in ``df`` are replaced. Rows of one
    tenant are spread by document so that a hot tenant is written by many tasks."""
    spread = "doc_id" if "doc_id" in df.columns else df.columns[0]
    (df.repartition("tenant_id", F.pmod(F.xxhash64(spread), F.lit(64))).write.mode(mode).partitionBy("tenant_id")
     .option("partitionOverwriteMode", "dynamic").option("maxRecordsPerFile", "5000000").parquet(f"{root.rstrip('/')}/{name}"))


def replace_by_document(old: DataFrame, new: DataFrame, emptied: DataFrame | None = None) -> DataFrame:
    """Chunk table after re-chunking (S3): every document present in ``new`` loses its old rows; running it twice changes
    nothing. ``emptied``: documents that now have no chunk at all."""
    ids = new.select("doc_id")
    if emptied is not None:
        ids = ids.unionByName(emptied.select("doc_id"))
    return old.join(ids.distinct(), "doc_id", "left_anti").unionByName(new, allowMissingColumns=True)


def needs_rechunk(docs: DataFrame, version: str, marker_col: str = "chunk_version") -> DataFrame:
    """Documents whose chunks were not made by this chunker version (S3)."""
    return docs.filter(~F.col(marker_col).eqNullSafe(F.lit(version)))
