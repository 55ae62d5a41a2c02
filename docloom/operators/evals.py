"""Golden-question scoring, runs and regressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom import settings as S
from docloom.operators.scale import top_n, with_next


def score_goldens(goldens: DataFrame, hits: DataFrame, answers: DataFrame) -> DataFrame:
    """Score per golden (E1): share of expected files retrieved, share of keywords in the answer, their mean; with neither
    expectation, 1 when confident else 0. A golden without hits counts as refused with an empty answer.

    hits(golden_id, filename) hold at most k rows per golden; answers(golden_id, answer, confidence)."""
    got = hits.groupBy("golden_id").agg(F.sort_array(F.collect_set("filename")).alias("retrieved_filenames"))
    g = goldens.join(got, "golden_id", "left").join(answers.select("golden_id", "answer", "confidence"), "golden_id", "left")
    none = F.array().cast("array<string>")
    found = F.col("retrieved_filenames").isNotNull()
    g = (g.withColumn("answer", F.when(found, F.coalesce("answer", F.lit(""))).otherwise(""))
         .withColumn("confidence", F.when(found, F.coalesce("confidence", F.lit("refused"))).otherwise("refused"))
         .withColumn("retrieved_filenames", F.coalesce("retrieved_filenames", none)))
    files, words = F.coalesce("expected_doc_filenames", none), F.coalesce("expected_keywords", none)
    missing_files = F.filter(files, lambda f: ~F.array_contains(F.col("retrieved_filenames"), f))
    missing_words = F.filter(words, lambda w: ~F.col("answer").contains(w))

    def share(all_: Column, missing: Column) -> Column:
        return F.when(F.size(all_) > 0, (F.size(all_) - F.size(missing)) / F.size(all_))
    g = (g.withColumn("retrieval_score", share(files, missing_files)).withColumn("keyword_score", share(words, missing_words))
         .withColumn("missing_filenames", missing_files).withColumn("missing_keywords", missing_words))
    r, k = F.col("retrieval_score"), F.col("keyword_score")
    score = F.when(r.isNotNull() & k.isNotNull(), (r + k) / 2).otherwise(
        F.coalesce(r, k, F.when(F.col("confidence") == "confident", 1.0).otherwise(0.0)))
    return g.withColumn("score", score)


def run_summary(scores: DataFrame, keys: tuple[str, ...] = ("tenant_id", "run_id")) -> DataFrame:
    """One row per run (E2): total, averages over present scores, count per confidence (a map of at most four keys)."""
    per_conf = scores.groupBy(*keys, "confidence").agg(
        F.count("*").alias("n"), F.sum("score").alias("s"), F.sum("retrieval_score").alias("r"), F.count("retrieval_score").alias("rn"),
        F.sum("keyword_score").alias("k"), F.count("keyword_score").alias("kn"))
    mean = lambda a, b: F.when(F.sum(b) > 0, F.sum(a) / F.sum(b))
    return per_conf.groupBy(*keys).agg(
        F.sum("n").alias("total"), (F.sum("s") / F.sum("n")).alias("avg_score"), mean("r", "rn").alias("avg_retrieval"),
        mean("k", "kn").alias("avg_keyword"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("confidence", "n")))).alias("confidence_counts"))


def _consecutive(runs: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    """(prev, cur) structs of neighbouring finished runs per tenant."""
    cols = ["run_id", "started_at", "avg_score", *extra]
    day = F.datediff(F.col("started_at").cast("date"), F.lit("1970-01-01").cast("date"))
    done = runs.filter("finished_at is not null").select("tenant_id", *cols)
    nxt = with_next(done, ["tenant_id"], ["started_at", "run_id"], day, cols)
    return nxt.filter("next is not null").select("tenant_id", F.struct(*cols).alias("prev"), F.col("next").alias("cur"))


def regressions(runs: DataFrame, threshold: float = S.EVAL_REGRESSION_THRESHOLD) -> DataFrame:
    """Each finished run against the finished run before it, flagged when the average fell by more than threshold."""
    p = _consecutive(runs).filter("prev.avg_score is not null and cur.avg_score is not null")
    delta = F.col("cur.avg_score") - F.col("prev.avg_score")
    return p.select("tenant_id", F.col("cur.run_id").alias("run_id"), F.col("prev.run_id").alias("prev_run_id"),
                    F.col("prev.avg_score").alias("prev_score"), F.col("cur.avg_score").alias("new_score"),
                    delta.alias("delta"), (delta < -threshold).alias("regressed"))


def golden_drops(runs: DataFrame, results: DataFrame) -> DataFrame:
    """Goldens that scored lower than in the previous finished run (E4). results(run_id, golden_id, question, score, …):
    the exploded result lists."""
    p = _consecutive(runs).select("tenant_id", F.col("prev.run_id").alias("prev_run_id"), F.col("cur.run_id").alias("run_id"))
    before = results.select(F.col("run_id").alias("prev_run_id"), "golden_id", F.col("score").alias("prev_score"))
    return (p.join(results.withColumnRenamed("score", "new_score"), "run_id").join(before, ["prev_run_id", "golden_id"])
            .filter("new_score < prev_score"))


def golden_report(goldens: DataFrame, queries: DataFrame) -> DataFrame:
    """Human pass rate per golden (E5): positive / negative / unmarked runs, newest run; goldens never run stay listed."""
    f = F.col("feedback")
    latest = F.max_by(F.struct("query_id", "answer", "confidence", "feedback"), F.struct("created_at", "query_id"))
    agg = queries.filter("golden_id is not null").groupBy("golden_id").agg(
        F.count("*").alias("total_runs"), F.count_if(f == "positive").alias("positive"), F.count_if(f == "negative").alias("negative"),
        F.max("created_at").alias("last_run_at"), latest.alias("_l"))
    out = goldens.join(agg, "golden_id", "left").fillna(0, ["total_runs", "positive", "negative"])
    marked = F.col("positive") + F.col("negative")
    return (out.withColumn("unmarked", F.col("total_runs") - marked)
            .withColumn("pass_rate", F.when(marked > 0, F.col("positive") / marked))
            .withColumn("last_feedback", F.col("_l.feedback")).withColumn("latest_query_id", F.col("_l.query_id"))
            .withColumn("latest_answer", F.col("_l.answer")).withColumn("latest_confidence", F.col("_l.confidence")).drop("_l"))


def golden_totals(report: DataFrame) -> DataFrame:
    """Overall line of the pass-rate report (E5)."""
    marked = F.sum(F.col("positive") + F.col("negative"))
    return report.groupBy("tenant_id").agg(
        F.count("*").alias("total_goldens"), F.count_if(F.col("total_runs") > 0).alias("goldens_with_runs"),
        F.count_if(F.col("positive") + F.col("negative") > 0).alias("goldens_with_feedback"), F.sum("total_runs").alias("total_runs"),
        F.sum("positive").alias("total_positive"), F.sum("negative").alias("total_negative"),
        F.when(marked > 0, F.sum("positive") / marked).alias("overall_pass_rate"))


def run_history(runs: DataFrame, n: int = 20) -> DataFrame:
    """Latest n runs per tenant."""
    return top_n(runs, ["tenant_id"], [F.col("started_at").desc(), F.col("run_id")], n, "rank")


def upsert_goldens(existing: DataFrame, new: DataFrame, replace: bool = False) -> DataFrame:
    """Golden table after seeding (E7): questions already present are skipped; ``replace`` drops the tenants' old rows."""
    if replace:
        existing = existing.join(new.select("tenant_id").distinct(), "tenant_id", "left_anti")
    fresh = new.join(existing.select("tenant_id", "question").distinct(), ["tenant_id", "question"], "left_anti")
    return existing.unionByName(fresh, allowMissingColumns=True)


def promote_goldens(queries: DataFrame, chunks: DataFrame, docs: DataFrame, overrides: DataFrame | None = None) -> DataFrame:
    """Queries as new goldens (E8): cited file names become the expectation; non-empty override fields win."""
    cited = (queries.select("query_id", F.explode("source_chunk_ids").alias("chunk_id"))
             .join(chunks.select("chunk_id", "doc_id"), "chunk_id").join(docs.select("doc_id", "filename"), "doc_id")
             .groupBy("query_id").agg(F.sort_array(F.collect_set("filename")).alias("_files")))
    g = queries.select("tenant_id", "query_id", "question", "answer").join(cited, "query_id", "left")
    if overrides is None:
        return g.select("tenant_id", F.col("query_id").alias("source_query_id"), F.trim("question").alias("question"),
                        F.col("_files").alias("expected_doc_filenames"), F.lit(None).cast("array<string>").alias("expected_keywords"),
                        F.col("answer").alias("expected_answer"), F.lit(None).cast("string").alias("notes"))
    o = overrides.select("query_id", F.col("question").alias("_q"), F.col("expected_doc_filenames").alias("_f"), "expected_keywords",
                         F.col("expected_answer").alias("_a"), "notes")
    g = g.join(o, "query_id", "left")
    given = lambda new, old: F.coalesce(F.when(F.col(new) != "", F.col(new)), F.col(old))
    return g.select("tenant_id", F.col("query_id").alias("source_query_id"), F.trim(given("_q", "question")).alias("question"),
                    F.coalesce(F.when(F.size("_f") > 0, F.col("_f")), F.col("_files")).alias("expected_doc_filenames"),
                    "expected_keywords", given("_a", "answer").alias("expected_answer"), "notes")
