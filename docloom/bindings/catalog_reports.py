"""Analytics, evaluation and duplicate reports over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from docloom.bindings import tables as B
from docloom.bindings.registry import day, query, r6, us
from docloom.operators import analytics as A
from docloom.operators import dedup as D
from docloom.operators import evals as E

AS_OF = "TIMESTAMP '2024-01-31 00:00:00'"
LIVE = "live AS (SELECT q.* FROM q WHERE golden_id IS NULL AND (user_id IS NULL OR user_id NOT IN (SELECT user_id FROM u WHERE is_super_admin)))"


def _staff(s, d):
    return B.users(s, d).filter("is_super_admin")


# --- A: engagement -----------------------------------------------------------------------------------------------------

@query("tenant_overview", "q u", LIVE + f"""
SELECT tenant_id, CAST(count(*) AS BIGINT) AS total_questions,
  count(*) FILTER (created_at >= {AS_OF} - INTERVAL 30 DAY) AS questions_30d,
  count(*) FILTER (created_at >= {AS_OF} - INTERVAL 60 DAY AND created_at < {AS_OF} - INTERVAL 30 DAY) AS questions_prev_30d,
  count(DISTINCT user_id) FILTER (created_at >= {AS_OF} - INTERVAL 7 DAY) AS active_users_7d,
  count(DISTINCT user_id) FILTER (created_at >= {AS_OF} - INTERVAL 30 DAY) AS active_users_30d,
  count(*) FILTER (created_at >= {AS_OF} - INTERVAL 30 DAY AND feedback = 'negative') AS negative_feedback_30d,
  count(DISTINCT conversation_id) AS total_conversations,
  round(count(conversation_id)::DOUBLE / count(DISTINCT conversation_id), 2) AS avg_conversation_depth,
  round((count(*) FILTER (created_at >= {AS_OF} - INTERVAL 30 DAY AND confidence = 'refused'))::DOUBLE
        / count(*) FILTER (created_at >= {AS_OF} - INTERVAL 30 DAY), 4) AS refusal_rate_30d,
  epoch_us(min(created_at)) AS first_question_at, epoch_us(max(created_at)) AS last_question_at
FROM live GROUP BY tenant_id""")
def tenant_overview(s, d):
    out = A.tenant_overview(B.queries(s, d), B.as_of(), _staff(s, d))
    return out.drop("trend_pct").withColumns({c: us(c) for c in ("first_question_at", "last_question_at")})


# trend against the previous period, with the clock set mid-month so that both periods have traffic
@query("tenant_trend", "q", """live AS (SELECT * FROM q WHERE golden_id IS NULL), p AS (
  SELECT tenant_id, count(*) FILTER (created_at >= TIMESTAMP '2024-01-14') AS cur,
    count(*) FILTER (created_at >= TIMESTAMP '2023-12-15' AND created_at < TIMESTAMP '2024-01-14') AS prev FROM live GROUP BY 1)
SELECT tenant_id, cur AS questions_30d, prev AS questions_prev_30d, round((cur - prev)::DOUBLE / prev * 100, 1) AS trend_pct FROM p""")
def tenant_trend(s, d):
    mid = F.lit("2024-02-13").cast("timestamp")
    return A.tenant_overview(B.queries(s, d), mid).select("tenant_id", "questions_30d", "questions_prev_30d", "trend_pct")


_FIRST = """firsts AS (SELECT tenant_id, user_id, count(*) AS first_impression_n, count(*) FILTER (confidence = 'refused') AS first_impression_refused
  FROM (SELECT *, row_number() OVER (PARTITION BY tenant_id, user_id ORDER BY created_at, query_id) AS rn FROM live) WHERE rn <= 5 GROUP BY 1, 2)"""


@query("user_engagement", "q u", LIVE + ", " + _FIRST + f""", a AS (
  SELECT tenant_id, user_id, count(*) AS total_questions, count(*) FILTER (created_at >= {AS_OF} - INTERVAL 30 DAY) AS questions_30d,
    count(DISTINCT conversation_id) AS conversations, count(*) FILTER (confidence = 'refused') AS refused,
    count(*) FILTER (feedback = 'negative') AS negative_feedback,
    CAST(floor((epoch_us({AS_OF}) - epoch_us(max(created_at))) / 86400000000.0) AS BIGINT) AS days_since_last FROM live GROUP BY 1, 2)
SELECT a.tenant_id, a.user_id, total_questions, questions_30d, conversations, negative_feedback, days_since_last,
  round(total_questions::DOUBLE / conversations, 2) AS avg_turns_per_conversation, round(refused::DOUBLE / total_questions, 4) AS refusal_rate,
  first_impression_n, first_impression_refused, total_questions >= 5 AND days_since_last >= 21 AS is_dormant
FROM a JOIN firsts f ON a.tenant_id = f.tenant_id AND a.user_id IS NOT DISTINCT FROM f.user_id""")
def user_engagement(s, d):
    return A.user_engagement(B.queries(s, d), B.as_of(), _staff(s, d)).drop("first_question_at", "last_question_at")


@query("first_impression", "q u", LIVE + ", " + _FIRST + " SELECT * FROM firsts")
def first_impression(s, d):
    return A.first_impression(B.queries(s, d), staff=_staff(s, d))


@query("weekly_activity", "q u", LIVE + f""", w AS (
  SELECT tenant_id, CAST(date_trunc('week', created_at + INTERVAL 2 HOUR + INTERVAL 1 DAY) - INTERVAL 1 DAY AS DATE) AS week_start,
    count(*) AS questions, count(DISTINCT user_id) AS active_users, count(*) FILTER (confidence = 'refused') AS refused
  FROM live WHERE created_at >= {AS_OF} - INTERVAL 84 DAY GROUP BY 1, 2),
spine AS (SELECT tenant_id, unnest(generate_series(DATE '2023-11-05', DATE '2024-01-28', INTERVAL 7 DAY)) AS week_start FROM (SELECT DISTINCT tenant_id FROM live))
SELECT s.tenant_id, CAST(CAST(s.week_start AS DATE) AS VARCHAR) AS week_start, coalesce(questions, 0) AS questions, coalesce(active_users, 0) AS active_users,
  coalesce(refused, 0) AS refused FROM spine s LEFT JOIN w ON w.tenant_id = s.tenant_id AND w.week_start = CAST(s.week_start AS DATE)""")
def weekly_activity(s, d):
    return A.weekly_activity(B.queries(s, d), 12, B.as_of(), staff=_staff(s, d)).withColumn("week_start", day("week_start"))


@query("adoption_gap", "q u", """roster AS (SELECT * FROM u WHERE NOT is_super_admin),
asked AS (SELECT DISTINCT user_id FROM q WHERE golden_id IS NULL AND user_id IS NOT NULL)
SELECT tenant_id, count(*) AS roster, count(*) FILTER (user_id NOT IN (SELECT user_id FROM asked)) AS never_asked FROM roster GROUP BY 1""")
def adoption_gap(s, d):
    return A.adoption(B.users(s, d), B.queries(s, d))[0]


@query("never_asked", "q u", """asked AS (SELECT DISTINCT user_id FROM q WHERE golden_id IS NULL AND user_id IS NOT NULL)
SELECT tenant_id, user_id, display_name AS name FROM u WHERE NOT is_super_admin AND user_id NOT IN (SELECT user_id FROM asked)""")
def never_asked(s, d):
    return A.adoption(B.users(s, d), B.queries(s, d))[1]


@query("corpus_stats", "d", """x AS (SELECT *, 'all' AS grp FROM d UNION ALL SELECT *, coalesce(doc_type, 'unclassified') AS grp FROM d),
r AS (SELECT *, count(*) OVER (PARTITION BY tenant_id, grp) AS n, row_number() OVER (PARTITION BY tenant_id, grp
  ORDER BY effective_date DESC NULLS LAST, ingested_at DESC, doc_id DESC) AS rn FROM x)
SELECT tenant_id, grp, n, filename AS newest_filename, CAST(coalesce(effective_date, CAST(ingested_at AS DATE)) AS VARCHAR) AS newest_date FROM r WHERE rn = 1""")
def corpus_stats(s, d):
    return A.corpus_stats(B.docs(s, d)).withColumn("newest_date", day("newest_date"))


@query("corpus_stats_block", "d", """x AS (SELECT *, 'all' AS grp FROM d UNION ALL SELECT *, coalesce(doc_type, 'unclassified') AS grp FROM d),
r AS (SELECT *, count(*) OVER (PARTITION BY tenant_id, grp) AS n, row_number() OVER (PARTITION BY tenant_id, grp
  ORDER BY effective_date DESC NULLS LAST, ingested_at DESC, doc_id DESC) AS rn FROM x),
w AS (SELECT tenant_id, map_from_entries(list((grp, n))) AS n,
  map_from_entries(list((grp, ': ''' || filename || ''' (' || CAST(coalesce(effective_date, CAST(ingested_at AS DATE)) AS VARCHAR) || ').'))) AS f FROM r WHERE rn = 1 GROUP BY 1)
SELECT tenant_id, concat_ws(chr(10), 'מאגר הארגון: ' || n['all'] || ' מסמכים סה"כ.',
  'לפי סוג: ' || concat_ws(', ', n['bylaw'] || ' תקנונים ראשיים', n['sub_bylaw'] || ' תקנוני משנה', n['decision'] || ' החלטות', n['minutes'] || ' פרוטוקולים',
    n['other'] || ' אחרים', n['unclassified'] || ' ללא סיווג') || '.',
  'המסמך העדכני ביותר' || f['all'], 'החלטה אחרון' || f['decision'], 'פרוטוקול אחרון' || f['minutes']) AS stats_block FROM w""")
def corpus_stats_block(s, d):
    return A.corpus_stats_line(A.corpus_stats(B.docs(s, d)))


@query("tenant_counts", "d", """ten AS (SELECT DISTINCT tenant_id FROM d), us AS (SELECT 'src' || (c_custkey % 25) AS tenant_id FROM customer)
SELECT tenant_id, (SELECT count(*) FROM us WHERE us.tenant_id = ten.tenant_id) AS user_count, (SELECT count(*) FROM d WHERE d.tenant_id = ten.tenant_id) AS document_count FROM ten""")
def tenant_counts(s, d):
    docs = B.docs(s, d)
    users = B.raw(s, d, "customer").selectExpr("concat('src', c_custkey % 25) AS tenant_id", "c_custkey AS user_id")
    return A.tenant_counts(docs.select("tenant_id").distinct(), users, docs)


_TAX = """tax AS (SELECT DISTINCT tenant_id, 'folder_' || lang AS name, lang <> 'fr' AS active FROM d WHERE lang <> 'de')"""


def _taxonomy(s, d):
    return B.docs(s, d).filter("lang <> 'de'").selectExpr("tenant_id", "concat('folder_', lang) AS name", "lang <> 'fr' AS active").distinct()


@query("folder_counts", "d", _TAX + """ SELECT t.tenant_id, t.name, t.active, count(d.doc_id) AS doc_count FROM tax t
LEFT JOIN d ON d.tenant_id = t.tenant_id AND d.folder = t.name GROUP BY 1, 2, 3""")
def folder_counts(s, d):
    return A.folder_counts(_taxonomy(s, d), B.docs(s, d))


@query("taxonomy_seed", "d", _TAX + """ SELECT DISTINCT tenant_id, folder AS name, true AS active FROM d
WHERE folder IS NOT NULL AND NOT EXISTS (SELECT 1 FROM tax t WHERE t.tenant_id = d.tenant_id AND t.name = d.folder)""")
def taxonomy_seed(s, d):
    return A.seed_taxonomy(B.docs(s, d), _taxonomy(s, d))


_QUALITY = """CASE WHEN extraction_partial THEN 'partial' WHEN chars_extracted / pages < 200 THEN 'low_density' WHEN chunks = 0 THEN 'suspect' ELSE 'ok' END AS quality"""


@query("document_report", "c", f"""n AS (SELECT doc_id, count(*) AS chunks, CAST(sum(length(text)) AS BIGINT) AS chars FROM c GROUP BY 1),
j AS (SELECT d.*, coalesce(n.chunks, 0) AS chunks, coalesce(n.chars, 0) AS chars FROM d LEFT JOIN n USING (doc_id))
SELECT doc_id, tenant_id, filename, doc_type, chunks, chars, {_QUALITY} FROM j""")
def document_report(s, d):
    return A.document_report(B.docs(s, d), B.chunks(s, d)).select("doc_id", "tenant_id", "filename", "doc_type", "chunks", "chars", "quality")


@query("library_browse", "d", """SELECT doc_id, coalesce(folder, '__none__') AS grp, filename FROM d
WHERE coalesce(doc_type, 'unclassified') IN ('bylaw', 'minutes', 'unclassified') AND (effective_date IS NULL OR effective_date >= DATE '2015-01-31')
  AND contains(lower(filename || ' ' || coalesce(summary, '') || ' ' || coalesce(folder, '')), 'src1')""")
def library_browse(s, d):
    spec = A.BrowseSpec(types=("bylaw", "minutes", "unclassified"), text=" SRC1", since=F.lit("2015-01-31").cast("date"), group="folder")
    return A.browse(B.docs(s, d), spec).select("doc_id", "grp", "filename")


@query("library_facets", "d", """SELECT tenant_id, 'type' AS facet, coalesce(doc_type, 'unclassified') AS value, count(*) AS n FROM d GROUP BY 1, 3
UNION ALL SELECT tenant_id, 'folder', coalesce(folder, '__none__'), count(*) FROM d GROUP BY 1, 3""")
def library_facets(s, d):
    return A.facets(B.docs(s, d))


@query("chunk_listing", "c", """SELECT doc_id, position, section_path, length(text) AS chars, text FROM c
WHERE contains(text, 'ent') OR contains(coalesce(section_path, ''), 'ent')""")
def chunk_listing(s, d):
    return A.chunk_listing(B.chunks(s, d), " ent ")


@query("recent_questions", "q", """l AS (SELECT tenant_id, question, max(created_at) AS last_at FROM q GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY tenant_id ORDER BY last_at DESC, question) AS rank FROM l)
SELECT tenant_id, question, epoch_us(last_at) AS last_at, rank FROM r WHERE rank <= 8""")
def recent_questions(s, d):
    return A.recent_questions(B.queries(s, d)).withColumn("last_at", us("last_at"))


@query("review_queue", "q", """r AS (SELECT *, row_number() OVER (PARTITION BY tenant_id ORDER BY CASE WHEN feedback = 'negative' THEN 0 WHEN feedback IS NOT NULL THEN 1 ELSE 2 END,
  created_at DESC, query_id) AS rank FROM q WHERE reviewer_action IS NULL)
SELECT tenant_id, query_id, feedback, authoritative_answer_id IS NOT NULL AS served_from_cache, rank FROM r WHERE rank <= 50""")
def review_queue(s, d):
    return A.review_queue(B.queries(s, d), needs_review=True).select("tenant_id", "query_id", "feedback", "served_from_cache", "rank")


_DEBUG = """k AS (SELECT *, coalesce(conversation_id, 'q:' || query_id) AS thread_key, coalesce(feedback = 'negative' AND failure_mode = 'retrieval_miss', false) AS flagged FROM q),
f AS (SELECT *, count(*) OVER (PARTITION BY thread_key) AS flagged_count, row_number() OVER (PARTITION BY thread_key ORDER BY created_at DESC, query_id DESC) AS rn FROM k WHERE flagged),
top AS (SELECT * FROM f WHERE rn = 1)"""


@query("debug_queue", "q", _DEBUG + """ SELECT thread_key, tenant_id, epoch_us(created_at) AS latest_flagged_at, flagged_count,
  (SELECT count(*) FROM k WHERE k.thread_key = top.thread_key) AS turn_count, query_id AS last_query_id FROM top""")
def debug_queue(s, d):
    q = A.debug_queue(B.queries(s, d), B.chunks(s, d), B.docs(s, d))
    return q.threads.drop("retrieval_debug").withColumn("latest_flagged_at", us("latest_flagged_at"))


@query("debug_turns", "q", _DEBUG + " SELECT thread_key, query_id, turn_index, confidence, flagged FROM k WHERE thread_key IN (SELECT thread_key FROM top)")
def debug_turns(s, d):
    q = A.debug_queue(B.queries(s, d), B.chunks(s, d), B.docs(s, d))
    return q.turns.select("thread_key", "query_id", "turn_index", "confidence", "flagged")


@query("debug_sources", "q c", _DEBUG + """, cited AS (SELECT thread_key, unnest(source_chunk_ids) AS chunk_id, generate_subscripts(source_chunk_ids, 1) - 1 AS ord FROM top)
SELECT thread_key, ord, chunk_id, filename, section_path FROM cited JOIN c USING (chunk_id) JOIN d USING (doc_id)""")
def debug_sources(s, d):
    q = A.debug_queue(B.queries(s, d), B.chunks(s, d), B.docs(s, d))
    return q.sources.select("thread_key", "ord", "chunk_id", "filename", "section_path")


@query("conversation_summary", "t", """SELECT conversation_id, count(*) AS turn_count, arg_max(question, turn_index) FILTER (question <> '') AS last_user_question,
  arg_max(answer, turn_index) FILTER (answer <> '') AS last_assistant_answer, arg_max(question, turn_index) FILTER (question <> '') AS title FROM t GROUP BY 1""")
def conversation_summary(s, d):
    q = B.turns(s, d)
    conv = q.select("conversation_id").distinct().withColumn("title", F.lit(None).cast("string"))
    return A.conversation_summary(conv, q)


@query("transcript", "t c", """cited AS (SELECT query_id, unnest(source_chunk_ids) AS chunk_id, generate_subscripts(source_chunk_ids, 1) AS ord FROM t),
s AS (SELECT query_id, string_agg(chunk_id || '=' || filename, '|' ORDER BY ord) AS sources FROM cited JOIN c USING (chunk_id) JOIN d USING (doc_id) GROUP BY 1)
SELECT conversation_id, t.query_id, turn_index, CASE WHEN confidence = 'clarifying' THEN 'clarify' ELSE 'answer' END AS mode, s.sources FROM t LEFT JOIN s USING (query_id)""")
def transcript(s, d):
    out = A.transcript(B.turns(s, d), B.chunks(s, d), B.docs(s, d))
    flat = F.array_join(F.transform("sources", lambda x: F.concat(x["chunk_id"], F.lit("="), x["filename"])), "|")
    return out.select("conversation_id", "query_id", "turn_index", "mode", flat.alias("sources"))


@query("prior_turns", "t", """SELECT conversation_id, query_id, 0 AS part, 'user' AS role, question AS body FROM t WHERE question <> ''
UNION ALL SELECT conversation_id, query_id, 1, 'assistant', answer FROM t WHERE answer <> ''""")
def prior_turns(s, d):
    return A.prior_turns(B.turns(s, d)).select("conversation_id", "query_id", "part", "role", "body")


@query("lane_report", "q", """e AS (SELECT tenant_id, CAST(date_trunc('week', created_at + INTERVAL 26 HOUR) - INTERVAL 1 DAY AS DATE) AS w, k FROM q),
l AS (SELECT tenant_id, w, 'vector' AS lane, k AS n FROM e UNION ALL SELECT tenant_id, w, 'bm25', k % 3 FROM e)
SELECT tenant_id, CAST(w AS VARCHAR) AS week_start, lane, CAST(sum(n) AS BIGINT) AS chunks, count(*) AS queries FROM l GROUP BY 1, 2, 3""")
def lane_report(s, d):
    return A.lane_report(B.queries(s, d)).withColumn("week_start", day("week_start"))


@query("product_metrics", "q", """SELECT tenant_id, count(*) AS n,
  round((count(*) FILTER (confidence = 'confident' AND reviewer_action = 'approved'))::DOUBLE / count(*) FILTER (confidence = 'confident' AND reviewer_action IS NOT NULL), 6) AS precision,
  round(count(authoritative_answer_id)::DOUBLE / count(*), 6) AS cache_share, round(avg(length(answer)) FILTER (confidence = 'confident'), 6) AS avg_answer_chars
FROM q WHERE golden_id IS NULL GROUP BY 1""")
def product_metrics(s, d):
    return A.product_metrics(B.queries(s, d))


@query("flags_by_status", "fl", "SELECT flag_id, kind, epoch_us(created_at) AS created_at FROM fl WHERE status = 'pending'")
def flags_by_status(s, d):
    return A.list_by_status(B.flags(s, d), "pending", "created_at", "flag_id").select("flag_id", "kind", us("created_at"))


# --- E: evaluation -------------------------------------------------------------------------------------------------------

def _golden_scores(s, d):
    docs = B.docs(s, d)
    g = B.goldens(s, d)
    own = docs.select("doc_id", "filename")
    hits = g.join(own, "doc_id").select("golden_id", "filename").unionByName(
        g.join(own.select((F.col("doc_id") - 2).alias("doc_id"), "filename"), "doc_id").select("golden_id", "filename"))
    answers = g.join(docs.select("doc_id", F.col("text").alias("answer")), "doc_id").selectExpr(
        "golden_id", "answer", "CASE WHEN length(answer) > 500 THEN 'confident' ELSE 'uncertain' END AS confidence")
    return E.score_goldens(g, hits, answers)


_GSCORE = """h AS (SELECT golden_id, d.filename FROM go JOIN d USING (doc_id) UNION SELECT golden_id, d.filename FROM go JOIN d ON d.doc_id = go.doc_id + 2),
got AS (SELECT golden_id, list(filename) AS files FROM h GROUP BY 1),
x AS (SELECT go.*, d.text AS answer, CASE WHEN length(d.text) > 500 THEN 'confident' ELSE 'uncertain' END AS confidence, files FROM go JOIN d USING (doc_id) JOIN got USING (golden_id)),
y AS (SELECT *, list_filter(expected_doc_filenames, lambda f: NOT list_contains(files, f)) AS mf, list_filter(expected_keywords, lambda w: NOT contains(answer, w)) AS mk FROM x),
z AS (SELECT *, (len(expected_doc_filenames) - len(mf)) / len(expected_doc_filenames)::DOUBLE AS rs, (len(expected_keywords) - len(mk)) / len(expected_keywords)::DOUBLE AS ks FROM y),
sc AS (SELECT tenant_id, golden_id, confidence, rs, ks, coalesce(len(mf), 0) AS n_missing_files, coalesce(len(mk), 0) AS n_missing_keywords,
  CASE WHEN rs IS NOT NULL AND ks IS NOT NULL THEN (rs + ks) / 2 ELSE coalesce(rs, ks, CASE WHEN confidence = 'confident' THEN 1.0 ELSE 0.0 END) END AS score FROM z)"""


@query("golden_scores", "go", _GSCORE + """ SELECT tenant_id, golden_id, confidence, round(rs, 6) AS retrieval_score, round(ks, 6) AS keyword_score, round(score, 6) AS score,
  n_missing_files, n_missing_keywords FROM sc""")
def golden_scores(s, d):
    return _golden_scores(s, d).select("tenant_id", "golden_id", "confidence", r6("retrieval_score"), r6("keyword_score"), r6("score"),
                                       F.size("missing_filenames").cast("bigint").alias("n_missing_files"), F.size("missing_keywords").cast("bigint").alias("n_missing_keywords"))


@query("run_summary", "go", _GSCORE + """ SELECT tenant_id, 'r1' AS run_id, CAST(count(*) AS BIGINT) AS total, round(avg(score), 6) AS avg_score, round(avg(rs), 6) AS avg_retrieval,
  round(avg(ks), 6) AS avg_keyword, count(*) FILTER (confidence = 'confident') AS n_confident FROM sc GROUP BY 1""")
def run_summary(s, d):
    out = E.run_summary(_golden_scores(s, d).withColumn("run_id", F.lit("r1")))
    return out.select("tenant_id", "run_id", "total", r6("avg_score"), r6("avg_retrieval"), r6("avg_keyword"),
                      F.coalesce(F.col("confidence_counts")["confident"], F.lit(0)).alias("n_confident"))


_PAIRS = """fin AS (SELECT *, lag(run_id) OVER w AS prev_run_id, lag(avg_score) OVER w AS prev_score FROM ru WHERE finished_at IS NOT NULL WINDOW w AS (PARTITION BY tenant_id ORDER BY started_at, run_id))"""


@query("run_regressions", "ru", _PAIRS + """ SELECT tenant_id, run_id, prev_run_id, round(avg_score - prev_score, 6) AS delta, avg_score - prev_score < -0.05 AS regressed
FROM fin WHERE prev_score IS NOT NULL""")
def run_regressions(s, d):
    return E.regressions(B.runs(s, d)).select("tenant_id", "run_id", "prev_run_id", r6("delta"), "regressed")


@query("golden_drops", "ru rr", _PAIRS + """ SELECT f.run_id, f.prev_run_id, a.golden_id, a.question, b.score AS prev_score, a.score AS new_score
FROM fin f JOIN rr a ON a.run_id = f.run_id JOIN rr b ON b.run_id = f.prev_run_id AND b.golden_id = a.golden_id WHERE a.score < b.score""")
def golden_drops(s, d):
    return E.golden_drops(B.runs(s, d), B.run_results(s, d)).drop("tenant_id")


_GREP = """g AS (SELECT DISTINCT 'g' || (item_id % 50) AS golden_id, 't0' AS tenant_id FROM benchmark),
a AS (SELECT golden_id, count(*) AS total_runs, count(*) FILTER (feedback = 'positive') AS positive, count(*) FILTER (feedback = 'negative') AS negative,
  arg_max(query_id, created_at) AS latest_query_id FROM q WHERE golden_id IS NOT NULL GROUP BY 1),
rep AS (SELECT g.tenant_id, g.golden_id, coalesce(total_runs, 0) AS total_runs, coalesce(positive, 0) AS positive, coalesce(negative, 0) AS negative,
  coalesce(total_runs - positive - negative, 0) AS unmarked, CASE WHEN positive + negative > 0 THEN round(positive::DOUBLE / (positive + negative), 6) END AS pass_rate,
  latest_query_id, l.feedback AS last_feedback FROM g LEFT JOIN a USING (golden_id) LEFT JOIN q l ON l.query_id = latest_query_id)"""


def _golden_report(s, d):
    g = B.raw(s, d, "benchmark").selectExpr("concat('g', item_id % 50) AS golden_id", "'t0' AS tenant_id").distinct()
    return E.golden_report(g, B.queries(s, d))


@query("golden_report", "q", _GREP + " SELECT * FROM rep")
def golden_report(s, d):
    return _golden_report(s, d).select("tenant_id", "golden_id", "total_runs", "positive", "negative", "unmarked", r6("pass_rate"), "latest_query_id", "last_feedback")


@query("golden_totals", "q", _GREP + """ SELECT tenant_id, count(*) AS total_goldens, count(*) FILTER (total_runs > 0) AS goldens_with_runs,
  count(*) FILTER (positive + negative > 0) AS goldens_with_feedback, CAST(sum(total_runs) AS BIGINT) AS total_runs, CAST(sum(positive) AS BIGINT) AS total_positive,
  CAST(sum(negative) AS BIGINT) AS total_negative, round(sum(positive)::DOUBLE / sum(positive + negative), 6) AS overall_pass_rate FROM rep GROUP BY 1""")
def golden_totals(s, d):
    return E.golden_totals(_golden_report(s, d)).withColumn("overall_pass_rate", r6("overall_pass_rate"))


@query("run_history", "ru", """r AS (SELECT *, row_number() OVER (PARTITION BY tenant_id ORDER BY started_at DESC, run_id) AS rank FROM ru)
SELECT tenant_id, run_id, epoch_us(started_at) AS started_at, avg_score, total, rank FROM r WHERE rank <= 20""")
def run_history(s, d):
    return E.run_history(B.runs(s, d)).select("tenant_id", "run_id", us("started_at"), "avg_score", "total", "rank")


@query("golden_upsert", "go", """old AS (SELECT tenant_id, question FROM go WHERE expected_keywords IS NOT NULL), new AS (SELECT tenant_id, 'about ' || doc_id AS question FROM d)
SELECT tenant_id, question, 'old' AS origin FROM old UNION ALL
SELECT tenant_id, question, 'new' FROM new WHERE NOT EXISTS (SELECT 1 FROM old WHERE old.tenant_id = new.tenant_id AND old.question = new.question)""")
def golden_upsert(s, d):
    old = B.goldens(s, d).filter("expected_keywords is not null").selectExpr("tenant_id", "question", "'old' AS origin")
    new = B.docs(s, d).selectExpr("tenant_id", "concat('about ', doc_id) AS question", "'new' AS origin")
    return E.upsert_goldens(old, new)


@query("golden_promotion", "t c", """cited AS (SELECT DISTINCT query_id, filename FROM (SELECT query_id, unnest(source_chunk_ids) AS chunk_id FROM t) JOIN c USING (chunk_id) JOIN d USING (doc_id)),
f AS (SELECT query_id, string_agg(filename, '|' ORDER BY filename) AS files FROM cited GROUP BY 1)
SELECT query_id AS source_query_id, trim(question) AS question, files, answer AS expected_answer FROM t LEFT JOIN f USING (query_id)""")
def golden_promotion(s, d):
    out = E.promote_goldens(B.turns(s, d), B.chunks(s, d), B.docs(s, d))
    return out.select("source_query_id", "question", F.array_join("expected_doc_filenames", "|").alias("files"), "expected_answer")


# --- D: duplicates -----------------------------------------------------------------------------------------------------------

@query("content_dedup", "d", """stored AS (SELECT DISTINCT sha256(text) AS h FROM benchmark), r AS (SELECT *, row_number() OVER (PARTITION BY tenant_id, content_sha256 ORDER BY ingested_at, doc_id) AS rn FROM d)
SELECT tenant_id, doc_id, content_sha256 FROM r WHERE rn = 1 AND content_sha256 NOT IN (SELECT h FROM stored)""")
def content_dedup(s, d):
    docs = B.docs(s, d)
    stored = B.raw(s, d, "benchmark").select(F.sha2("text", 256).alias("content_sha256"))
    known = stored.join(docs.select("tenant_id", "content_sha256").distinct(), "content_sha256")
    return D.dedup_content(docs, known).select("tenant_id", "doc_id", "content_sha256")


_GROUPS = """g AS (SELECT *, count(*) OVER (PARTITION BY tenant_id, {k}) AS group_size, first_value(doc_id) OVER (PARTITION BY tenant_id, {k} ORDER BY ingested_at, doc_id) AS oldest_doc_id FROM {t})"""


_ORG = "(SELECT * REPLACE ('org' AS tenant_id) FROM d)"


def _one_tenant(s, d):
    return B.docs(s, d).withColumn("tenant_id", F.lit("org"))


@query("duplicate_groups", "d", _GROUPS.format(k="content_sha256", t=_ORG) + """ SELECT tenant_id, doc_id, content_sha256, group_size, oldest_doc_id, doc_id = oldest_doc_id AS is_oldest FROM g WHERE group_size > 1""")
def duplicate_groups(s, d):
    return D.duplicate_groups(_one_tenant(s, d)).select("tenant_id", "doc_id", "content_sha256", "group_size", "oldest_doc_id", "is_oldest")


@query("text_duplicate_flags", "d fl", r"""x AS (SELECT doc_id, 'org' AS tenant_id, ingested_at, nullif(regexp_replace(replace(lower(strip_accents(text)), 'ß', 'ss'), '[^\p{L}\p{N}]', '', 'g'), '') AS h FROM d), """
       + _GROUPS.format(k="h", t="(SELECT * FROM x WHERE h IS NOT NULL)") + """ SELECT doc_id AS new_doc_id, oldest_doc_id AS existing_doc_id FROM g WHERE doc_id <> oldest_doc_id
AND NOT EXISTS (SELECT 1 FROM fl WHERE (fl.new_doc_id = g.doc_id AND fl.existing_doc_id = g.oldest_doc_id) OR (fl.new_doc_id = g.oldest_doc_id AND fl.existing_doc_id = g.doc_id))""")
def text_duplicate_flags(s, d):
    docs = D.with_text_hash(B.docs(s, d).select("doc_id", "text", "ingested_at")).withColumn("tenant_id", F.lit("org")).drop("text")
    return D.text_duplicate_flags(docs, B.flags(s, d)).select("new_doc_id", "existing_doc_id")


@query("answer_refs", "t c", """x AS (SELECT query_id, unnest(source_chunk_ids) AS chunk_id FROM t) SELECT doc_id, count(DISTINCT query_id) AS ref_count FROM x JOIN c USING (chunk_id) GROUP BY 1""")
def answer_refs(s, d):
    answers = B.turns(s, d).withColumnRenamed("query_id", "answer_id")
    return D.answer_refs(answers, B.chunks(s, d))


_SIB = "k AS (SELECT d.*, coalesce(n.m, 0) AS chunks_created FROM d LEFT JOIN (SELECT doc_id, count(*) AS m FROM c GROUP BY 1) n USING (doc_id))"


def _fingerprinted(s, d):
    n = B.chunks(s, d).groupBy("doc_id").agg(F.count("*").alias("chunks_created"))
    return B.docs(s, d).join(n, "doc_id", "left").fillna(0, ["chunks_created"]).withColumn("tenant_id", F.lit("org"))


@query("fingerprint_siblings", "c", _SIB + """, w AS (SELECT doc_id, chars_extracted, pages, chunks_created, count(*) OVER p - 1 AS siblings, min(doc_id) OVER p AS first_doc_id
  FROM k WINDOW p AS (PARTITION BY chars_extracted, pages, chunks_created)) SELECT doc_id, siblings, first_doc_id FROM w WHERE siblings > 0""")
def fingerprint_siblings(s, d):
    return D.fingerprint_siblings(_fingerprinted(s, d)).select("doc_id", "siblings", "first_doc_id")


@query("deletion_plan", "d", _GROUPS.format(k="content_sha256", t=_ORG) + " SELECT tenant_id, doc_id, oldest_doc_id FROM g WHERE doc_id <> oldest_doc_id")
def deletion_plan(s, d):
    return D.deletion_plan(_one_tenant(s, d)).select("tenant_id", "doc_id", "oldest_doc_id")


_REQ = "req AS (SELECT 'src' || (doc_id % 20) AS tenant_id, doc_id * 2 AS doc_id FROM labels)"


def _requested(s, d):
    return B.raw(s, d, "labels").selectExpr("concat('src', doc_id % 20) AS tenant_id", "doc_id * 2 AS doc_id")


@query("delete_report", "d", _REQ + """ SELECT DISTINCT r.tenant_id, r.doc_id, CASE WHEN d.doc_id IS NULL THEN 'not_found' WHEN d.tenant_id <> r.tenant_id THEN 'forbidden' ELSE 'deleted' END AS outcome
FROM req r LEFT JOIN d ON d.doc_id = r.doc_id""")
def delete_report(s, d):
    return D.apply_deletes(_requested(s, d), B.docs(s, d), B.chunks(s, d))[0]


@query("chunks_after_delete", "c", _REQ + """, gone AS (SELECT d.doc_id FROM req r JOIN d ON d.doc_id = r.doc_id AND d.tenant_id = r.tenant_id)
SELECT doc_id, count(*) AS chunks FROM c WHERE doc_id NOT IN (SELECT doc_id FROM gone) GROUP BY 1""")
def chunks_after_delete(s, d):
    return D.apply_deletes(_requested(s, d), B.docs(s, d), B.chunks(s, d))[2].groupBy("doc_id").agg(F.count("*").alias("chunks"))
