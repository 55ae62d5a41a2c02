"""Engagement, corpus and review reports.

queries(tenant_id, query_id, user_id, conversation_id, turn_index, question, answer, confidence, feedback, failure_mode,
reviewer_action, golden_id, authoritative_answer_id, source_chunk_ids, retrieval_debug, created_at)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom import settings as S
from docloom.functions import text as X
from docloom.operators.documents import quality_expr
from docloom.operators.lexicon import _days_before
from docloom.operators.scale import top_n


def base_traffic(queries: DataFrame, staff: DataFrame | None = None) -> DataFrame:
    """Rows every metric counts: no evaluation runs, no staff; rows without a user stay."""
    rows = queries.filter("golden_id is null")
    return rows if staff is None else rows.join(staff.select("user_id").distinct(), "user_id", "left_anti")


def _ratio(a: Column, b: Column, digits: int) -> Column:
    return F.when(b > 0, F.round(a / b, digits)).otherwise(0.0)


def tenant_overview(queries: DataFrame, as_of: Column, staff: DataFrame | None = None) -> DataFrame:
    """Headline counters per tenant (A1). Distinct users and threads come from per-user and per-thread partial sums, so
    no row is expanded for several distinct counts and a hot tenant is split over its users."""
    rows = base_traffic(queries, staff)
    ts = F.col("created_at")
    d7, d30, d60 = (_days_before(as_of, d) for d in (7, 30, 60))
    per_user = rows.groupBy("tenant_id", "user_id").agg(
        F.count("*").alias("n"), F.count_if(ts >= d30).alias("q30"), F.count_if((ts >= d60) & (ts < d30)).alias("prev"),
        F.count_if((ts >= d30) & (F.col("confidence") == "refused")).alias("refused"),
        F.count_if((ts >= d30) & (F.col("feedback") == "negative")).alias("negative"),
        F.min(ts).alias("first_at"), F.max(ts).alias("last_at"))
    someone = F.col("user_id").isNotNull()
    totals = per_user.groupBy("tenant_id").agg(
        F.sum("n").alias("total_questions"), F.sum("q30").alias("questions_30d"), F.sum("prev").alias("questions_prev_30d"),
        F.count_if(someone & (F.col("last_at") >= d7)).alias("active_users_7d"),
        F.count_if(someone & (F.col("last_at") >= d30)).alias("active_users_30d"),
        F.sum("refused").alias("_refused"), F.sum("negative").alias("negative_feedback_30d"),
        F.min("first_at").alias("first_question_at"), F.max("last_at").alias("last_question_at"))
    threads = (rows.filter("conversation_id is not null").groupBy("tenant_id", "conversation_id").agg(F.count("*").alias("n"))
               .groupBy("tenant_id").agg(F.count("*").alias("total_conversations"), F.sum("n").alias("_turns")))
    prev, now = F.col("questions_prev_30d"), F.col("questions_30d")
    return (totals.join(threads, "tenant_id", "left")
            .withColumn("total_conversations", F.coalesce("total_conversations", F.lit(0)))
            .withColumn("avg_conversation_depth", _ratio(F.coalesce("_turns", F.lit(0)), F.col("total_conversations"), 2))
            .withColumn("refusal_rate_30d", _ratio(F.col("_refused"), now, 4))
            .withColumn("trend_pct", F.when(prev > 0, F.round((now - prev) / prev * 100, 1))).drop("_turns", "_refused"))


def first_impression(queries: DataFrame, n: int = S.FIRST_IMPRESSION_N, staff: DataFrame | None = None) -> DataFrame:
    """Refusals among each user's first n questions (A3); the per-user cut happens in the map tasks."""
    firsts = top_n(base_traffic(queries, staff).select("tenant_id", "user_id", "created_at", "query_id", "confidence"),
                   ["tenant_id", "user_id"], [F.col("created_at"), F.col("query_id")], n)
    return firsts.groupBy("tenant_id", "user_id").agg(
        F.count("*").alias("first_impression_n"), F.count_if(F.col("confidence") == "refused").alias("first_impression_refused"))


def user_engagement(queries: DataFrame, as_of: Column, staff: DataFrame | None = None) -> DataFrame:
    """One row per user who ever asked (A2), longest silent first."""
    rows = base_traffic(queries, staff)
    ts = F.col("created_at")
    agg = rows.groupBy("tenant_id", "user_id").agg(
        F.count("*").alias("total_questions"), F.count_if(ts >= _days_before(as_of, 30)).alias("questions_30d"),
        F.min(ts).alias("first_question_at"), F.max(ts).alias("last_question_at"),
        F.count_distinct("conversation_id").alias("conversations"),
        F.count_if(F.col("confidence") == "refused").alias("_refused"),
        F.count_if(F.col("feedback") == "negative").alias("negative_feedback"))
    first = first_impression(queries, staff=staff).withColumnsRenamed({"tenant_id": "_t", "user_id": "_u"})
    out = (agg.join(first, F.col("tenant_id").eqNullSafe(F.col("_t")) & F.col("user_id").eqNullSafe(F.col("_u")), "left")
           .drop("_t", "_u")
           .withColumn("days_since_last", F.floor((F.unix_micros(as_of) - F.unix_micros("last_question_at")) / 86_400_000_000))
           .withColumn("avg_turns_per_conversation", _ratio(F.col("total_questions"), F.col("conversations"), 2))
           .withColumn("refusal_rate", _ratio(F.col("_refused"), F.col("total_questions"), 4))
           .withColumn("is_dormant", (F.col("total_questions") >= S.DORMANT_MIN_QUESTIONS)
                       & (F.col("days_since_last") >= S.DORMANT_AFTER_DAYS)).drop("_refused"))
    return out.orderBy(F.col("days_since_last").desc(), F.col("total_questions").desc(), "tenant_id", "user_id")


def week_start(ts: Column, tz: str = S.LOCAL_TIME_ZONE) -> Column:
    """Sunday on or before the local date."""
    local = F.from_utc_timestamp(ts, tz) if tz != "UTC" else ts
    return F.date_sub(F.date_trunc("week", F.date_add(local.cast("date"), 1)).cast("date"), 1)


def weekly_activity(queries: DataFrame, weeks: int, as_of: Column, tz: str = S.LOCAL_TIME_ZONE,
                    staff: DataFrame | None = None) -> DataFrame:
    """Questions, askers and refusals per local Sunday week and tenant, silent weeks as zeros (A4)."""
    since = _days_before(as_of, 7 * weeks)
    rows = base_traffic(queries, staff)
    per_user = (rows.filter(F.col("created_at") >= since)
                .groupBy("tenant_id", week_start(F.col("created_at"), tz).alias("week_start"), "user_id")
                .agg(F.count("*").alias("n"), F.count_if(F.col("confidence") == "refused").alias("r")))
    counts = per_user.groupBy("tenant_id", "week_start").agg(
        F.sum("n").alias("questions"), F.count("user_id").alias("active_users"), F.sum("r").alias("refused"))
    spine = rows.select("tenant_id").distinct().withColumn(
        "week_start", F.explode(F.sequence(week_start(since, tz), week_start(as_of, tz), F.expr("interval 7 days"))))
    return (spine.join(counts, ["tenant_id", "week_start"], "left").fillna(0, ["questions", "active_users", "refused"])
            .orderBy("tenant_id", "week_start"))


def adoption(users: DataFrame, queries: DataFrame, include_staff: bool = False) -> tuple[DataFrame, DataFrame]:
    """(counts per tenant, roster users who never asked) (A5)."""
    roster = users if include_staff else users.filter("not coalesce(is_super_admin, false)")
    asked = queries.filter("golden_id is null and user_id is not null").select("user_id").distinct()
    never = roster.join(asked, "user_id", "left_anti").select("tenant_id", "user_id", F.coalesce(
        F.when(F.col("display_name") != "", F.col("display_name")), F.when(F.col("email") != "", F.col("email")),
        F.col("user_id").cast("string")).alias("name"))
    silent = never.groupBy("tenant_id").agg(F.count("*").alias("never_asked"))
    counts = (roster.groupBy("tenant_id").agg(F.count("*").alias("roster")).join(silent, "tenant_id", "left")
              .withColumn("never_asked", F.coalesce("never_asked", F.lit(0))))
    return counts, never


def corpus_stats(docs: DataFrame) -> DataFrame:
    """Documents per (tenant, type) with the newest file and its date (A6); grp 'all' is the whole tenant."""
    key = F.struct(F.col("effective_date").isNotNull().alias("dated"), "effective_date", "ingested_at", "doc_id")
    both = docs.withColumn("grp", F.explode(F.array(F.lit("all"), F.coalesce("doc_type", F.lit("unclassified")))))
    newest = F.struct("filename", F.coalesce(F.col("effective_date"), F.col("ingested_at").cast("date")).alias("d"))
    return (both.groupBy("tenant_id", "grp").agg(F.count("*").alias("n"), F.max_by(newest, key).alias("_n"))
            .select("tenant_id", "grp", "n", F.col("_n.filename").alias("newest_filename"), F.col("_n.d").alias("newest_date")))


def corpus_stats_line(stats: DataFrame) -> DataFrame:
    """One text block per tenant from corpus_stats (A6): totals, by type, newest overall, newest decision and minutes."""
    def cell(grp: str, col: str) -> Column:
        return F.max(F.when(F.col("grp") == grp, F.col(col))).alias(f"{grp}_{col}")
    groups = ["all", *S.DOC_TYPES, "unclassified"]
    wide = stats.groupBy("tenant_id").agg(*[cell(g, c) for g in groups for c in ("n", "newest_filename", "newest_date")])
    n = lambda g, label: F.when(F.col(f"{g}_n") > 0, F.concat(F.col(f"{g}_n").cast("string"), F.lit(f" {label}")))
    by_type = F.concat_ws(", ", *[n(t, S.DOC_TYPE_PLURAL[t]) for t in S.DOC_TYPES], n("unclassified", "ללא סיווג"))

    def newest(g: str, label: str) -> Column:
        name = F.concat(F.lit(f"{label}: '"), F.col(f"{g}_newest_filename"), F.lit("'"))
        date = F.when(F.col(f"{g}_newest_date").isNotNull(), F.concat(F.lit(" ("), F.col(f"{g}_newest_date").cast("string"), F.lit(")")))
        return F.concat(name, F.coalesce(date, F.lit("")), F.lit("."))
    lines = F.concat_ws("\n", F.concat(F.lit("מאגר הארגון: "), F.col("all_n").cast("string"), F.lit(' מסמכים סה"כ.')),
                        F.when(by_type != "", F.concat(F.lit("לפי סוג: "), by_type, F.lit("."))),
                        newest("all", "המסמך העדכני ביותר"),
                        *[newest(t, S.DOC_TYPE_LABEL[t] + " אחרון") for t in ("decision", "minutes")])
    return wide.select("tenant_id", lines.alias("stats_block"))


def tenant_counts(tenants: DataFrame, users: DataFrame, docs: DataFrame) -> DataFrame:
    """Users and documents per tenant."""
    u = users.groupBy("tenant_id").agg(F.count("*").alias("user_count"))
    d = docs.groupBy("tenant_id").agg(F.count("*").alias("document_count"))
    return tenants.join(u, "tenant_id", "left").join(d, "tenant_id", "left").fillna(0, ["user_count", "document_count"])


def folder_counts(taxonomy: DataFrame, docs: DataFrame) -> DataFrame:
    """Folders with document counts, active first."""
    c = docs.filter("folder is not null").groupBy("tenant_id", F.col("folder").alias("name")).agg(F.count("*").alias("doc_count"))
    return (taxonomy.join(c, ["tenant_id", "name"], "left").fillna(0, ["doc_count"])
            .orderBy(F.col("active").desc(), "name", "tenant_id"))


def seed_taxonomy(docs: DataFrame, taxonomy: DataFrame) -> DataFrame:
    """Folders in use that the taxonomy lacks, as new active rows."""
    used = docs.select("tenant_id", F.trim("folder").alias("name")).filter("name <> ''").distinct()
    return used.join(taxonomy.select("tenant_id", "name"), ["tenant_id", "name"], "left_anti").withColumn("active", F.lit(True))


def document_report(docs: DataFrame, chunks: DataFrame) -> DataFrame:
    """Documents with chunk count, characters and quality, newest first."""
    c = chunks.groupBy("doc_id").agg(F.count("*").alias("chunks"), F.sum(F.length("text")).alias("chars"))
    return (docs.join(c, "doc_id", "left").fillna(0, ["chunks", "chars"])
            .withColumn("quality", quality_expr(F.col("chars_extracted"), F.col("pages"), F.col("extraction_partial"), F.col("chunks")))
            .orderBy(F.col("ingested_at").desc(), "doc_id"))


@dataclass
class BrowseSpec:
    """Library filters; an empty list means no filter. 'unclassified' and '__none__' stand for NULL type and folder."""
    types: tuple[str, ...] = ()
    folders: tuple[str, ...] = ()
    text: str = ""
    since: Column | None = None      # documents without a date are kept
    only_with_file: bool = False
    only_reviewed: bool = False
    sort: str = "recent"             # recent | alpha | chunks
    group: str = "none"              # none | type | folder


def browse(docs: DataFrame, spec: BrowseSpec) -> DataFrame:
    """Library listing (A10): filters, sort, and grp for grouped views (folders by name, NULL last)."""
    kind, folder = F.coalesce("doc_type", F.lit("unclassified")), F.coalesce("folder", F.lit("__none__"))
    out = docs
    if spec.types:
        out = out.filter(kind.isin(*spec.types))
    if spec.folders:
        out = out.filter(folder.isin(*spec.folders))
    if spec.only_with_file:
        out = out.filter(F.coalesce("source_uri", F.lit("")).startswith("file://"))
    if spec.only_reviewed:
        out = out.filter("coalesce(metadata_reviewed, false)")
    if spec.since is not None:
        out = out.filter(F.col("effective_date").isNull() | (F.col("effective_date") >= spec.since))
    if spec.text.strip():
        hay = F.lower(F.concat_ws(" ", "filename", F.coalesce("summary", F.lit("")), F.coalesce("folder", F.lit(""))))
        out = out.filter(hay.contains(spec.text.strip().lower()))
    order = {"alpha": [F.col("filename")], "chunks": [F.col("chunks_created").desc()]}.get(spec.sort, [F.col("ingested_at").desc()])
    if spec.group == "type":
        position = F.array_position(F.array(*[F.lit(t) for t in [*S.DOC_TYPES, "unclassified"]]), kind)
        return out.withColumn("grp", kind).filter(position > 0).orderBy(position, *order, "doc_id")
    if spec.group == "folder":
        return out.withColumn("grp", folder).orderBy(F.col("folder").isNull(), "folder", *order, "doc_id")
    return out.orderBy(*order, "doc_id")


def facets(docs: DataFrame) -> DataFrame:
    """Counts by type and by folder over the unfiltered set in one pass (A10): facet, value, n."""
    kind, folder = F.coalesce("doc_type", F.lit("unclassified")), F.coalesce("folder", F.lit("__none__"))
    d = docs.select("tenant_id", kind.alias("kind"), folder.alias("fold"))
    g = d.groupingSets([["tenant_id", "kind"], ["tenant_id", "fold"]], "tenant_id", "kind", "fold").agg(
        F.count("*").alias("n"), F.grouping("kind").alias("_no_kind"))
    return g.select("tenant_id", F.when(F.col("_no_kind") == 0, "type").otherwise("folder").alias("facet"),
                    F.coalesce("kind", "fold").alias("value"), "n")


def chunk_listing(chunks: DataFrame, text: str = "") -> DataFrame:
    """Chunks in document order, kept when text or section contains the needle (A10)."""
    needle = text.strip()
    hit = F.col("text").contains(needle) | F.coalesce("section_path", F.lit("")).contains(needle)
    rows = chunks.filter(hit) if needle else chunks
    return rows.select("doc_id", "position", "section_path", F.length("text").alias("chars"), "text").orderBy("doc_id", "position")


def recent_questions(queries: DataFrame, n: int = 8) -> DataFrame:
    """Latest n distinct questions per tenant."""
    last = queries.filter("question is not null").groupBy("tenant_id", "question").agg(F.max("created_at").alias("last_at"))
    return top_n(last, ["tenant_id"], [F.col("last_at").desc(), F.col("question")], n, "rank")


def review_queue(queries: DataFrame, needs_review: bool = False, feedback_only: bool = False, n: int = 50) -> DataFrame:
    """Queue per tenant: negative feedback first, then positive, then none; newest first."""
    rows = queries
    if needs_review:
        rows = rows.filter("reviewer_action is null")
    if feedback_only:
        rows = rows.filter("feedback is not null")
    first = F.when(F.col("feedback") == "negative", 0).when(F.col("feedback").isNotNull(), 1).otherwise(2)
    out = top_n(rows, ["tenant_id"], [first, F.col("created_at").desc(), F.col("query_id")], n, "rank")
    return out.withColumn("served_from_cache", F.col("authoritative_answer_id").isNotNull())


def _thread_key() -> Column:
    return F.coalesce(F.col("conversation_id").cast("string"), F.concat(F.lit("q:"), F.col("query_id").cast("string")))


def turn_order() -> Column:
    """Sort struct of a turn inside its thread: numbered turns first, then time."""
    return F.struct(F.col("turn_index").isNull().alias("_u"), "turn_index", "created_at", "query_id")


@dataclass
class DebugQueue:
    threads: DataFrame   # thread_key, tenant_id, latest_flagged_at, flagged_count, turn_count, retrieval_debug
    turns: DataFrame     # every turn of those threads, in turn order, with flagged
    sources: DataFrame   # chunks of the last flagged turn in stored order


def debug_queue(queries: DataFrame, chunks: DataFrame, docs: DataFrame, n: int | None = None) -> DebugQueue:
    """Threads with flagged turns (A13), all or the latest ``n`` of each tenant. Turns without a thread stand alone. Turns and sources are
    separate row sets, because a thread has no upper length; a reader sorts them."""
    q = queries.withColumn("thread_key", _thread_key()).withColumn(
        "flagged", F.coalesce((F.col("feedback") == "negative") & (F.col("failure_mode") == "retrieval_miss"), F.lit(False)))
    last = F.struct("query_id", "tenant_id", "created_at", "retrieval_debug", "source_chunk_ids")
    flagged = (q.filter("flagged").groupBy("thread_key")
               .agg(F.count("*").alias("flagged_count"), F.max_by(last, F.struct("created_at", "query_id")).alias("_last")))
    if n is not None:
        flagged = top_n(flagged.withColumn("_tenant", F.col("_last.tenant_id")), ["_tenant"], [F.col("_last.created_at").desc(), F.col("thread_key")], n).drop("_tenant")
    turns = q.join(flagged.select("thread_key"), "thread_key", "left_semi")
    sizes = turns.groupBy("thread_key").agg(F.count("*").alias("turn_count"))
    threads = flagged.join(sizes, "thread_key").select(
        "thread_key", "_last.tenant_id", F.col("_last.created_at").alias("latest_flagged_at"), "flagged_count", "turn_count",
        F.col("_last.query_id").alias("last_query_id"), "_last.retrieval_debug")
    cited = flagged.select("thread_key", F.posexplode("_last.source_chunk_ids").alias("ord", "chunk_id"))
    sources = (cited.join(chunks.select("chunk_id", "doc_id", "section_path", "text"), "chunk_id")
               .join(docs.select("doc_id", "filename"), "doc_id"))
    ordered = turns.select("thread_key", "query_id", "turn_index", "question", "answer", "confidence", "created_at", "flagged")
    return DebugQueue(threads, ordered, sources)


def conversation_summary(conversations: DataFrame, queries: DataFrame, title_chars: int | None = None) -> DataFrame:
    """Turn count, last question, last answer and display title per thread (A14); a title made of the last question may be cut for display."""
    asked = F.col("last_user_question") if title_chars is None else F.col("last_user_question").substr(1, title_chars)

    def last(col: str) -> Column:
        return F.max_by(col, F.when(F.col(col) != "", turn_order()))
    s = queries.filter("conversation_id is not null").groupBy("conversation_id").agg(
        F.count("*").alias("turn_count"), last("question").alias("last_user_question"), last("answer").alias("last_assistant_answer"))
    return (conversations.join(s, "conversation_id", "left").withColumn("turn_count", F.coalesce("turn_count", F.lit(0)))
            .withColumn("title", F.coalesce(F.when(F.col("title") != "", F.col("title")), asked)))


def transcript(queries: DataFrame, chunks: DataFrame, docs: DataFrame) -> DataFrame:
    """Turns with their sources in stored order, vanished chunks dropped, and the reply mode."""
    cited = queries.select("query_id", F.posexplode("source_chunk_ids").alias("ord", "chunk_id"))
    named = (cited.join(chunks.select("chunk_id", "doc_id", "section_path"), "chunk_id").join(docs.select("doc_id", "filename"), "doc_id"))
    # bounded: the source list of one turn
    lists = named.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("ord", "chunk_id", "filename", "section_path"))).alias("sources"))
    return (queries.join(lists, "query_id", "left")
            .withColumn("mode", F.when(F.col("confidence") == "clarifying", "clarify").otherwise("answer"))
            .select("conversation_id", "query_id", "turn_index", "question", "answer", "confidence", "mode", "sources", "feedback",
                    "created_at").orderBy("conversation_id", F.col("turn_index").asc_nulls_last(), "created_at", "query_id"))


def prior_turns(queries: DataFrame) -> DataFrame:
    """Thread history as role rows: each turn's question, then its answer; blanks dropped."""
    pair = F.array(F.struct(F.lit("user").alias("role"), F.col("question").alias("body")),
                   F.struct(F.lit("assistant").alias("role"), F.col("answer").alias("body")))
    rows = queries.select("conversation_id", "query_id", "turn_index", "created_at", F.posexplode(pair).alias("part", "_p"))
    return rows.select("conversation_id", "query_id", "turn_index", "created_at", "part", "_p.*").filter("body <> ''")


def lane_report(queries: DataFrame, tz: str = S.LOCAL_TIME_ZONE) -> DataFrame:
    """Chunks each retrieval lane contributed per week, from the stored traces."""
    counts = F.from_json("retrieval_debug", "struct<lane_counts:map<string,int>>")["lane_counts"]
    rows = queries.filter("retrieval_debug is not null").select(
        "tenant_id", week_start(F.col("created_at"), tz).alias("week_start"), F.explode(counts).alias("lane", "n"))
    return rows.groupBy("tenant_id", "week_start", "lane").agg(F.sum("n").alias("chunks"), F.count("*").alias("queries"))


def product_metrics(queries: DataFrame) -> DataFrame:
    """Approved-without-edit share of reviewed confident answers, cache-served share, mean answer length."""
    live = queries.filter("golden_id is null")
    confident = F.col("confidence") == "confident"
    reviewed = confident & F.col("reviewer_action").isNotNull()
    g = live.groupBy("tenant_id").agg(
        F.count("*").alias("n"), F.count_if(reviewed).alias("reviewed"),
        F.count_if(reviewed & (F.col("reviewer_action") == "approved")).alias("approved"),
        F.count_if(F.col("authoritative_answer_id").isNotNull()).alias("cached"),
        F.round(F.avg(F.when(confident, F.length("answer"))), 6).alias("avg_answer_chars"))
    return g.select("tenant_id", "n", F.when(F.col("reviewed") > 0, F.round(F.col("approved") / F.col("reviewed"), 6)).alias("precision"),
                    F.round(F.col("cached") / F.col("n"), 6).alias("cache_share"), "avg_answer_chars")


def list_by_status(df: DataFrame, status: str | None, ts: str, id_col: str) -> DataFrame:
    """Status-filtered list, newest first."""
    rows = df.filter(F.col("status") == status) if status else df
    return rows.orderBy(F.col(ts).desc(), id_col)
