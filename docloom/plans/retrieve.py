"""Hybrid retrieval of a whole table of questions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom import settings as S
from docloom.functions import text as X
from docloom.operators import fusion, governance, lexical, vector
from docloom.operators.documents import assemble_context
from docloom.session import store_table


@dataclass
class Retrieved:
    hits: DataFrame          # question_id, rank, chunk_id, doc_id, score, lanes, document columns, text
    lanes: DataFrame         # question_id, vector, bm25, title, year
    amendments: DataFrame | None
    resolutions: DataFrame | None
    context: DataFrame       # question_id, block, ord, body


META = ["chunk_id", "doc_id", "doc_type", "forum", "doc_status", "doc_date", "chunk_date"]


def with_document_columns(chunks: DataFrame, docs: DataFrame) -> DataFrame:
    """Chunks with the document columns that ranking needs; date columns get distinct names."""
    d = docs.select("doc_id", "filename", "doc_type", "forum", "doc_status", F.col("effective_date").alias("doc_date"),
                    *[c for c in ("decision_number", "meeting_number") if c in docs.columns])
    date = F.col("effective_date") if "effective_date" in chunks.columns else F.lit(None).cast("date")
    out = chunks.withColumn("chunk_date", date).drop("effective_date").join(d, "doc_id")
    for c in ("decision_number", "meeting_number"):
        if c not in out.columns:
            out = out.withColumn(c, F.lit(None).cast("string"))
    return out


def hybrid_retrieve(questions: DataFrame, chunks: DataFrame, docs: DataFrame, postings: DataFrame | None = None,
                    frequencies: DataFrame | None = None, stats: DataFrame | None = None, k: int = 5, as_of_year: int = 2024, include_superseded: bool = False,
                    scorer: fusion.Scorer | None = None, amendments: DataFrame | None = None,
                    resolutions: DataFrame | None = None, history: DataFrame | None = None,
                    matched_terms: DataFrame | None = None, lanes: tuple[str, ...] = ("vector", "bm25", "title", "year"),
                    **routes: int) -> Retrieved:
    """questions(tenant_id, question_id, question, embedding), chunks(tenant_id, chunk_id, doc_id, position, section_path,
    section_ref, text, decision_type, superseded_by_amendment_id, embedding), docs. Currency filters run before any top-k. ``postings``,
    ``frequencies`` and ``stats`` are stored index tables of all chunks; what is missing is computed."""
    lo, hi = X.year_bounds(F.col("question"))
    q = fusion.effective_k(questions.withColumn("year_from", lo).withColumn("year_to", hi), k)
    bound = max(k, S.MAX_RANGE_K)
    pool = chunks if include_superseded else fusion.current_only(chunks, docs)
    live_docs = docs if include_superseded else docs.filter("superseded_by_id is null")
    # every lane and the final texts read this table: joined once, then scanned column by column
    full = store_table(with_document_columns(pool, docs), "live-chunks")
    meta = full.select(*META)

    lane = {}
    if "vector" in lanes:
        lane["vector"] = vector.vector_search(q, full, k, bound, **routes)
    if "bm25" in lanes:
        index = postings if postings is not None else lexical.build_postings(chunks)
        allowed = None if include_superseded else meta
        lane["lexical"] = lexical.lexical_search(
            q.withColumn("_limit", 4 * F.col("k")), index, lexical.index_stats(chunks) if stats is None else stats, 4 * bound,
            allowed=allowed, limit_col="_limit", frequencies=frequencies)
    if "title" in lanes:
        lane["title"] = vector.seed_by_title(q, lexical.title_search(q, live_docs), full)
    if "year" in lanes:
        lane["year"] = vector.seed_by_year(q, full, **routes)

    fused = fusion.boost(fusion.rrf(fusion.lane_rows(**lane)), meta, as_of_year)
    cands = fusion.candidates(fused, q.select("question_id", "k"), bound)
    texts = full.select("chunk_id", "tenant_id", "position", "filename", "section_path", "section_ref", "decision_type",
                        "text", "decision_number", "meeting_number")
    if scorer is not None:
        cands = (cands.join(texts, "chunk_id").withColumn("rerank_text", fusion.rerank_text())
                 .join(q.select("question_id", "question"), "question_id"))
    final = fusion.diversify(fusion.rerank(cands, scorer, bound), bound)
    hits = final if scorer is not None else final.join(texts, "chunk_id")
    hits = hits.withColumn("effective_date", F.col("doc_date"))
    amended = governance.amendment_chain(hits, amendments, docs) if amendments is not None else None
    resolved = None
    if resolutions is not None:
        resolved = governance.resolution_chain(hits, resolutions, chunks, docs)
        hits = governance.append_terminals(hits, resolved, chunks, docs)
    return Retrieved(hits, fusion.lane_counts(final), amended, resolved,
                     assemble_context(hits, history, amended, resolved, matched_terms))
