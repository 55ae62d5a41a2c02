"""Rank fusion, boosts, reranking and diversity."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docloom import settings as S
from docloom.functions import text as X
from docloom.operators.scale import literal_map, top_n

Scorer = Callable[[list[str], list[str]], list[float]]


def lane_rows(vector: DataFrame | None = None, lexical: DataFrame | None = None, title: DataFrame | None = None,
              year: DataFrame | None = None) -> DataFrame:
    """All lanes as (question_id, chunk_id, lane, contribution): 1/(60 + 0-based rank) or a flat boost (F1, F2)."""
    parts = []
    for df, lane, value in (
        (vector, "vector", 1 / (S.RRF_OFFSET - 1 + F.col("rank"))),
        (lexical, "bm25", 1 / (S.RRF_OFFSET - 1 + F.col("rank"))),
        (title, "title", F.lit(S.TITLE_BOOST)),
        (year, "year", F.lit(S.YEAR_BOOST)),
    ):
        if df is not None:
            parts.append(df.select("question_id", "chunk_id", F.lit(lane).alias("lane"), value.cast("double").alias("contribution")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def rrf(lanes: DataFrame) -> DataFrame:
    """Fused score and lane set per (question, chunk); at most a few hundred rows per question."""
    return lanes.groupBy("question_id", "chunk_id").agg(
        F.sum("contribution").alias("score"), F.sort_array(F.collect_set("lane")).alias("lanes"))


def boost_expr(as_of_year: int) -> Column:
    """Recency + forum + status adjustment of one document."""
    age = F.greatest(F.lit(0), F.lit(as_of_year) - F.year("doc_date"))
    recency = F.when(F.col("doc_type").isin(S.RECENCY_TYPES) & F.col("doc_date").isNotNull() & (age < S.RECENCY_YEARS),
                     (S.RECENCY_YEARS - age) * S.RECENCY_PER_YEAR).otherwise(0.0)
    return (recency + literal_map(S.FORUM_BOOST, F.col("forum"), 0.0)
            + literal_map(S.STATUS_DEMOTION, F.col("doc_status"), 0.0))


def boost(scored: DataFrame, chunk_meta: DataFrame, as_of_year: int) -> DataFrame:
    """Add document attributes and the boosted score (F3); ``as_of_year`` replaces the clock."""
    joined = scored.join(chunk_meta, "chunk_id")
    return joined.withColumn("score", F.round(F.col("score") + boost_expr(as_of_year), 12))


def effective_k(questions: DataFrame, k: int = 5) -> DataFrame:
    """Per-question k (F8): ranges of three or more years widen it to span + 2, at most to 15; a caller's larger k stays."""
    span = F.col("year_to") - F.col("year_from") + 1
    return questions.withColumn("k", F.when(span >= 3, F.greatest(F.lit(k), F.least(span + 2, F.lit(S.MAX_RANGE_K))))
                                .otherwise(F.lit(k)))


def candidates(scored: DataFrame, ks: DataFrame, k_bound: int) -> DataFrame:
    """Best max(4k, 12) fused chunks, newer first on equal score (F4). ``ks``: (question_id, k)."""
    order = [F.col("score").desc(), F.col("chunk_date").desc_nulls_last(), F.col("chunk_id").asc()]
    cut = top_n(scored, ["question_id"], order, max(4 * k_bound, 12), "fused_rank")
    return cut.join(ks, "question_id").filter(F.col("fused_rank") <= F.greatest(4 * F.col("k"), F.lit(12)))


def rerank_text(title_chars: int | None = None) -> Column:
    """Chunk text behind a bracketed hint: type or title, date, section, non-adopted status."""
    stem = F.regexp_replace("filename", "\\.[^.]*\\z", "")
    title = X.blank_to_null(stem if title_chars is None else stem.substr(1, title_chars))

    def numbered(word: str, col: str) -> Column:
        return F.concat_ws(" ", F.lit(word), X.blank_to_null(F.col(col)))

    kind = (F.when(F.col("doc_type") == "decision", numbered("החלטה", "decision_number"))
            .when(F.col("doc_type") == "minutes", numbered("פרוטוקול", "meeting_number")).otherwise(title))
    status = F.when(F.col("doc_status") != "adopted",
                    F.coalesce(literal_map(S.STATUS_LABEL, F.col("doc_status"), None), F.col("doc_status")))
    tags = F.concat_ws(" · ", kind, F.col("doc_date").cast("string"),
                       F.when(F.col("section_path") != "", F.concat(F.lit("סעיף "), F.col("section_path"))),
                       F.when(status != "", status))
    return F.when(tags != "", F.concat(F.lit("["), tags, F.lit("] "), F.col("text"))).otherwise(F.col("text"))


def rerank(cands: DataFrame, scorer: Scorer | None = None, k_bound: int = 5) -> DataFrame:
    """Reorder candidates and keep max(3k, 12) (F5). Without a scorer the fused order stands.

    ``scorer(questions, texts)`` scores one Arrow batch; needs columns question and rerank_text. A batch whose scorer
    fails keeps the fused order."""
    if scorer is None:
        ranked = cands.withColumn("rank", F.col("fused_rank"))
    else:
        @F.pandas_udf("double")
        def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
            for questions, texts in batches:
                try:
                    yield pd.Series(scorer(questions.tolist(), texts.tolist()), dtype="float64")
                except Exception:
                    yield pd.Series([None] * len(texts), dtype="float64")
        scored = cands.withColumn("rerank_score", run("question", "rerank_text"))
        ranked = top_n(scored, ["question_id"], [F.col("rerank_score").desc_nulls_last(), F.col("fused_rank")],
                       max(4 * k_bound, 12), "rank")
    return ranked.filter(F.col("rank") <= F.greatest(3 * F.col("k"), F.lit(12)))


def diversify(ranked: DataFrame, k_bound: int = 5) -> DataFrame:
    """Final k per question (F6): at most 2/5 per document by type, then refilled with the overflow in rank order."""
    cap = literal_map(S.FINAL_CAP, F.col("doc_type"), S.FINAL_CAP_DEFAULT)
    in_doc = F.row_number().over(W.partitionBy("question_id", "doc_id").orderBy("rank"))
    over = ranked.withColumn("_over", (in_doc > cap).cast("int"))
    final = top_n(over.withColumnRenamed("rank", "rerank_rank"), ["question_id"],
                  [F.col("_over"), F.col("rerank_rank")], max(k_bound, S.MAX_RANGE_K), "rank")
    return final.filter("rank <= k").drop("_over")


def lane_counts(final: DataFrame) -> DataFrame:
    """How many final chunks each lane brought in, per question."""
    def n(lane: str) -> Column:
        return F.sum(F.array_contains("lanes", lane).cast("int")).alias(lane)
    return final.groupBy("question_id").agg(n("vector"), n("bm25"), n("title"), n("year"))


def current_only(chunks: DataFrame, docs: DataFrame) -> DataFrame:
    """Chunks in force: not superseded by an amendment, document not superseded."""
    gone = docs.filter("superseded_by_id is not null").select("doc_id")
    return chunks.filter("superseded_by_amendment_id is null").join(gone, "doc_id", "left_anti")
