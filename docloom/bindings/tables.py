"""Driver tables seen as corpus tables, in Spark and (for the correctness check) in SQL.

Each function returns a whole derived table; the SQL text of the same name in ``SQL`` builds the same rows from the same
parquet files. Attributes the driver data lacks (type, forum, dates, edges …) are fixed expressions over existing columns.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.operators import documents as P
from docloom.session import ensure_checkpoint_dir, store_table

AS_OF = "2024-01-31 00:00:00"
AS_OF_YEAR = 2024
SQL: dict[str, str] = {}


_SPREAD = {"documents": "doc_id", "embeddings": "vec_id"}


def raw(spark: SparkSession, d: str, name: str) -> DataFrame:
    """Parquet scan. Text-heavy tables that come in fewer splits than there are cores are spread by id first; a table
    with enough splits is scanned as it lies."""
    df = spark.read.parquet(f"{d}/{name}.parquet")
    if name == "events":
        return df.withColumn("ts", F.col("ts").cast("timestamp"))
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores, _SPREAD[name]) if name in _SPREAD and df.rdd.getNumPartitions() < cores else df


def as_of():
    return F.lit(AS_OF).cast("timestamp")


_TYPES = "'bylaw','sub_bylaw','decision','minutes','other',NULL"
_FORUMS = "'sub_committee','committee','assembly','ballot',NULL"
_STATUSES = "'proposal','draft','discussion','background','invitation','adopted',NULL"
_HEADS = "'הצעה','טיוטה','סיכום דיון','דוח','הזמנה','minutes','notes'"


def docs(spark: SparkSession, d: str) -> DataFrame:
    return raw(spark, d, "documents").selectExpr(
        "doc_id", "source AS tenant_id", "text", "lang", "n_chars",
        f"""concat_ws(' ', array({_HEADS})[cast(doc_id % 7 as int)], source, lang,
            CASE cast(doc_id % 5 as int)
              WHEN 1 THEN format_string('%04d-%02d-%02d', 2005 + doc_id % 18, 1 + doc_id % 12, 1 + doc_id % 28)
              WHEN 2 THEN format_string('%d.%d.%02d', 1 + doc_id % 28, 1 + doc_id % 12, (5 + doc_id) % 100)
              WHEN 3 THEN format_string('31.02.%02d', doc_id % 30)
              ELSE concat('n', doc_id) END) || '.pdf' AS filename""",
        f"array({_TYPES})[cast(doc_id % 6 as int)] AS doc_type",
        f"array({_FORUMS})[cast(doc_id % 5 as int)] AS forum",
        f"array({_STATUSES})[cast(doc_id % 7 as int)] AS doc_status",
        "CASE WHEN doc_id % 4 = 0 THEN NULL ELSE concat('folder_', lang) END AS folder",
        "CASE WHEN doc_id % 11 = 0 THEN NULL ELSE date_add(date'2005-01-01', cast(doc_id * 7 % 7000 as int)) END AS effective_date",
        "timestamp_seconds(1704067200 + doc_id * 60) AS ingested_at",
        "CASE WHEN doc_id % 13 = 5 THEN doc_id + 1 END AS superseded_by_id",
        "sha2(text, 256) AS content_sha256",
        "cast(CASE WHEN doc_id % 9 = 0 THEN 40 ELSE 1 + n_chars div 2500 END as int) AS pages",
        "cast(n_chars as int) AS chars_extracted", "doc_id % 17 = 0 AS extraction_partial",
        "CASE WHEN doc_id % 3 = 0 THEN 'hashed-words' WHEN doc_id % 3 = 1 THEN 'older' END AS embedding_model",
        "doc_id % 8 = 0 AS metadata_reviewed", "lang AS summary")


SQL["d"] = f"""SELECT doc_id, source AS tenant_id, text, lang, n_chars,
  concat_ws(' ', [{_HEADS}][1 + doc_id % 7], source, lang,
    CASE doc_id % 5
      WHEN 1 THEN printf('%04d-%02d-%02d', 2005 + doc_id % 18, 1 + doc_id % 12, 1 + doc_id % 28)
      WHEN 2 THEN printf('%d.%d.%02d', 1 + doc_id % 28, 1 + doc_id % 12, (5 + doc_id) % 100)
      WHEN 3 THEN printf('31.02.%02d', doc_id % 30)
      ELSE concat('n', doc_id) END) || '.pdf' AS filename,
  [{_TYPES}][1 + doc_id % 6] AS doc_type, [{_FORUMS}][1 + doc_id % 5] AS forum, [{_STATUSES}][1 + doc_id % 7] AS doc_status,
  CASE WHEN doc_id % 4 = 0 THEN NULL ELSE 'folder_' || lang END AS folder,
  CASE WHEN doc_id % 11 = 0 THEN NULL ELSE DATE '2005-01-01' + CAST(doc_id * 7 % 7000 AS INTEGER) END AS effective_date,
  make_timestamp((1704067200 + doc_id * 60) * 1000000) AS ingested_at,
  CASE WHEN doc_id % 13 = 5 THEN doc_id + 1 END AS superseded_by_id, sha256(text) AS content_sha256,
  CASE WHEN doc_id % 9 = 0 THEN 40 ELSE 1 + n_chars // 2500 END AS pages, n_chars AS chars_extracted,
  doc_id % 17 = 0 AS extraction_partial,
  CASE WHEN doc_id % 3 = 0 THEN 'hashed-words' WHEN doc_id % 3 = 1 THEN 'older' END AS embedding_model,
  doc_id % 8 = 0 AS metadata_reviewed, lang AS summary
FROM documents"""


def chunks(spark: SparkSession, d: str, tenant: str | None = None) -> DataFrame:
    """Lines of the documents with section, decision and currency attributes; ``tenant`` replaces the tenant id."""
    base = docs(spark, d).select("doc_id", "tenant_id", "text", F.col("effective_date"))
    lines = P.chunk_documents(base, profile="lines").drop("section_path", "section_ref")
    out = lines.selectExpr(
        "chunk_id", "doc_id", f"'{tenant}' AS tenant_id" if tenant else "tenant_id", "position", "text", "effective_date",
        "CASE position % 4 WHEN 1 THEN concat('סעיף ', position) WHEN 2 THEN 'פרק א' END AS section_path",
        "CASE (doc_id + position) % 5 WHEN 0 THEN 'escalation' WHEN 1 THEN 'terminal' END AS decision_type",
        "CASE WHEN (doc_id * 31 + position) % 23 = 0 THEN 'earlier' END AS superseded_by_amendment_id")
    return P.with_section_ref(out)


SQL["c"] = r"""SELECT doc_id || ':' || position AS chunk_id, doc_id, tenant_id, position, text, effective_date,
  CASE position % 4 WHEN 1 THEN 'סעיף ' || position WHEN 2 THEN 'פרק א' END AS section_path,
  CASE (doc_id + position) % 5 WHEN 0 THEN 'escalation' WHEN 1 THEN 'terminal' END AS decision_type,
  CASE WHEN (doc_id * 31 + position) % 23 = 0 THEN 'earlier' END AS superseded_by_amendment_id,
  CASE position % 4 WHEN 1 THEN CAST(position AS VARCHAR) END AS section_ref
FROM (SELECT doc_id, tenant_id, effective_date, position - 1 AS position, regexp_replace(line, '^\s+|\s+$', '', 'g') AS text
      FROM (SELECT doc_id, tenant_id, effective_date, unnest(string_split(text, chr(10))) AS line,
                   generate_subscripts(string_split(text, chr(10)), 1) AS position FROM d))
WHERE text <> ''"""


def event_stream(spark: SparkSession, d: str, parts: int = 4, rows_per_file: int = 250_000) -> DataFrame:
    """The event log as a file stream that arrives in ``parts`` slices of time, oldest first, one in each micro-batch. A slice is as many files as its
    rows fill; rows without a time arrive first, in a slice of their own."""
    events = raw(spark, d, "events")
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    low, high, rows, timed = events.agg(F.min(at), F.max(at), F.count("*"), F.count("ts")).first()
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/events-{uuid.uuid4().hex}"
    files = max(1, -(-rows // (parts * rows_per_file)))
    slices = [events.filter("ts IS NULL")] if low is None or rows > timed else []
    if low is not None:
        part = F.least(F.floor((at - F.lit(low)) * parts / F.lit(high - low + 1)), F.lit(parts - 1))
        slices += [events.filter(part == k) for k in range(parts)]
    for rows_of in slices:  # in turn, so that the files' times are in order
        rows_of.repartition(files).write.mode("append").parquet(folder)
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", files).parquet(folder)
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def queries(spark: SparkSession, d: str) -> DataFrame:
    return as_queries(raw(spark, d, "events"))


def as_queries(events: DataFrame) -> DataFrame:
    return events.selectExpr(
        "event_id AS query_id", "concat('t', user_id % 7) AS tenant_id",
        "CASE WHEN event_id % 97 = 0 THEN NULL ELSE user_id END AS user_id",
        "CASE WHEN event_id % 41 = 0 THEN NULL ELSE concat(user_id, '-', cast(ts as date)) END AS conversation_id",
        "CASE WHEN user_id % 2 = 1 THEN hour(ts) * 60 + minute(ts) END AS turn_index",
        "concat('question ', event_id % 211) AS question", "concat('answer ', event_type) AS answer",
        "CASE event_type WHEN 'error' THEN 'refused' WHEN 'signup' THEN 'clarifying' WHEN 'view' THEN 'uncertain' ELSE 'confident' END AS confidence",
        "CASE WHEN value < 5 THEN 'negative' WHEN value > 40 THEN 'positive' END AS feedback",
        "CASE WHEN value < 3 THEN 'retrieval_miss' WHEN value < 5 THEN 'other' END AS failure_mode",
        "array('approved','edited','rejected',NULL,NULL,NULL)[cast(event_id % 6 as int)] AS reviewer_action",
        "CASE WHEN event_id % 19 = 0 THEN concat('g', event_id % 40) END AS golden_id",
        "CASE WHEN event_id % 23 = 0 THEN concat('a', event_id % 50) END AS authoritative_answer_id",
        "array(concat(event_id % 1000, ':0'), concat(event_id * 7 % 1000, ':1')) AS source_chunk_ids",
        "concat('{\"lane_counts\":{\"vector\":', get_json_object(props, '$.k'), ',\"bm25\":', get_json_object(props, '$.k') % 3, '}}') AS retrieval_debug",
        "ts AS created_at", "event_type", "value")


SQL["q"] = """SELECT event_id AS query_id, 't' || (user_id % 7) AS tenant_id,
  CASE WHEN event_id % 97 = 0 THEN NULL ELSE user_id END AS user_id,
  CASE WHEN event_id % 41 = 0 THEN NULL ELSE user_id || '-' || CAST(CAST(ts AS DATE) AS VARCHAR) END AS conversation_id,
  CASE WHEN user_id % 2 = 1 THEN hour(ts) * 60 + minute(ts) END AS turn_index,
  'question ' || (event_id % 211) AS question, 'answer ' || event_type AS answer,
  CASE event_type WHEN 'error' THEN 'refused' WHEN 'signup' THEN 'clarifying' WHEN 'view' THEN 'uncertain' ELSE 'confident' END AS confidence,
  CASE WHEN value < 5 THEN 'negative' WHEN value > 40 THEN 'positive' END AS feedback,
  CASE WHEN value < 3 THEN 'retrieval_miss' WHEN value < 5 THEN 'other' END AS failure_mode,
  ['approved','edited','rejected',NULL,NULL,NULL][1 + event_id % 6] AS reviewer_action,
  CASE WHEN event_id % 19 = 0 THEN 'g' || (event_id % 40) END AS golden_id,
  CASE WHEN event_id % 23 = 0 THEN 'a' || (event_id % 50) END AS authoritative_answer_id,
  [(event_id % 1000) || ':0', (event_id * 7 % 1000) || ':1'] AS source_chunk_ids,
  CAST(regexp_extract(props, '[0-9]+') AS INTEGER) AS k, ts AS created_at, event_type, value
FROM events"""


def users(spark: SparkSession, d: str) -> DataFrame:
    """Roster: every customer; ids overlap the users seen in events."""
    return raw(spark, d, "customer").selectExpr("c_custkey AS user_id", "concat('t', c_custkey % 7) AS tenant_id",
                                                "c_name AS display_name", "CAST(NULL AS STRING) AS email", "c_custkey % 10 = 0 AS is_super_admin")


SQL["u"] = """SELECT c_custkey AS user_id, 't' || (c_custkey % 7) AS tenant_id, c_name AS display_name, c_custkey % 10 = 0 AS is_super_admin
FROM customer"""


def turns(spark: SparkSession, d: str) -> DataFrame:
    """Question turns of the conversations; the answer is the following assistant row."""
    c = raw(spark, d, "conversations")
    answer = c.filter("role = 'assistant'").selectExpr("conv_id", "turn - 1 AS turn", "text AS answer")
    return c.filter("role = 'user'").join(answer, ["conv_id", "turn"], "left").selectExpr(
        "concat('t', conv_id % 3) AS tenant_id", "conv_id * 1000 + turn AS query_id", "conv_id AS conversation_id", "turn AS turn_index",
        "text AS question", "answer", "timestamp_seconds(1704067200 + conv_id * 3600 + turn * 60) AS created_at",
        "array('confident','refused','uncertain','clarifying')[cast((conv_id + turn) % 4 as int)] AS confidence",
        "CASE WHEN conv_id % 5 = 0 THEN 'negative' END AS feedback",
        "array(concat(conv_id, ':0'), concat(conv_id + turn, ':1')) AS source_chunk_ids")


SQL["t"] = """SELECT 't' || (c.conv_id % 3) AS tenant_id, c.conv_id * 1000 + c.turn AS query_id, c.conv_id AS conversation_id, c.turn AS turn_index,
  c.text AS question, a.text AS answer, make_timestamp((1704067200 + c.conv_id * 3600 + c.turn * 60) * 1000000) AS created_at,
  ['confident','refused','uncertain','clarifying'][1 + (c.conv_id + c.turn) % 4] AS confidence,
  CASE WHEN c.conv_id % 5 = 0 THEN 'negative' END AS feedback, [c.conv_id || ':0', (c.conv_id + c.turn) || ':1'] AS source_chunk_ids
FROM conversations c LEFT JOIN conversations a ON a.conv_id = c.conv_id AND a.turn = c.turn + 1 AND a.role = 'assistant'
WHERE c.role = 'user'"""


def amendments(spark: SparkSession, d: str) -> DataFrame:
    """One edge per document: it edits a section of an earlier document."""
    return docs(spark, d).selectExpr(
        "doc_id AS amendment_id", "doc_id AS amendment_doc_id", "doc_id div 2 AS target_doc_id", "cast(1 + 4 * (doc_id % 3) as string) AS target_section",
        "array('replace','delete','add_after','clarify','add_before')[cast(doc_id % 5 as int)] AS action",
        "concat('text of ', doc_id) AS new_text", "CASE WHEN doc_id % 2 = 0 THEN concat('reason ', doc_id) END AS rationale",
        "effective_date", "doc_id % 4 = 3 AS needs_review", "ingested_at AS created_at")


SQL["am"] = """SELECT doc_id AS amendment_id, doc_id AS amendment_doc_id, doc_id // 2 AS target_doc_id, CAST(1 + 4 * (doc_id % 3) AS VARCHAR) AS target_section,
  ['replace','delete','add_after','clarify','add_before'][1 + doc_id % 5] AS action, 'text of ' || doc_id AS new_text,
  CASE WHEN doc_id % 2 = 0 THEN 'reason ' || doc_id END AS rationale, effective_date, doc_id % 4 = 3 AS needs_review, ingested_at AS created_at,
  coalesce(effective_date, CAST(ingested_at AS DATE)) AS sort_date
FROM d"""


def outlines(spark: SparkSession, d: str) -> DataFrame:
    """The chunks with n_chars instead of their text, stored, for jobs that meet them several times: the documents are cut once."""
    cut = chunks(spark, d)
    return store_table(cut.select(*[c for c in cut.columns if c != "text"], F.length("text").alias("n_chars")), "outlines")


def resolutions(spark: SparkSession, d: str, outline: DataFrame | None = None) -> DataFrame:
    """Long escalation chunks are resolved by the document after theirs; ``outline`` are the chunks' stored ``outlines``."""
    cut = chunks(spark, d).withColumn("n_chars", F.length("text")) if outline is None else outline
    return cut.filter("decision_type = 'escalation' and n_chars > 80").selectExpr(
        "concat('r', chunk_id) AS resolution_id", "chunk_id AS escalation_chunk_id", "doc_id AS escalation_doc_id", "doc_id + 1 AS terminal_doc_id",
        "CASE WHEN position % 2 = 0 THEN concat(doc_id + 1, ':1') ELSE 'vanished' END AS terminal_chunk_id",
        "CASE WHEN position % 3 = 0 THEN NULL ELSE concat('topic ', position) END AS topic", "doc_id % 4 = 1 AS needs_review",
        "timestamp_seconds(1704067200 + doc_id * 60 + position) AS created_at")


SQL["re"] = """SELECT 'r' || chunk_id AS resolution_id, chunk_id AS escalation_chunk_id, doc_id AS escalation_doc_id, doc_id + 1 AS terminal_doc_id,
  CASE WHEN position % 2 = 0 THEN (doc_id + 1) || ':1' ELSE 'vanished' END AS terminal_chunk_id,
  CASE WHEN position % 3 = 0 THEN NULL ELSE 'topic ' || position END AS topic, doc_id % 4 = 1 AS needs_review,
  make_timestamp((1704067200 + doc_id * 60 + position) * 1000000) AS created_at
FROM c WHERE decision_type = 'escalation' AND length(text) > 80"""


def flags(spark: SparkSession, d: str) -> DataFrame:
    """One finding per document against its predecessor; every other one is the mirror of its neighbour's."""
    return docs(spark, d).selectExpr(
        "doc_id AS flag_id", "CASE WHEN doc_id % 2 = 0 THEN doc_id ELSE doc_id div 2 * 2 + 2 END AS new_doc_id",
        "CASE WHEN doc_id % 2 = 0 THEN doc_id + 2 ELSE doc_id div 2 * 2 END AS existing_doc_id",
        "concat(doc_id, ':1') AS new_chunk_id", "CASE WHEN doc_id % 3 = 0 THEN NULL ELSE concat(doc_id + 1, ':1') END AS existing_chunk_id",
        "array('contradicts','supersedes','duplicates')[cast(doc_id div 2 % 3 as int)] AS kind",
        "array('pending','pending','confirmed','dismissed')[cast(doc_id % 4 as int)] AS status",
        "timestamp_seconds(1704067200 + doc_id * 90) AS created_at", "CAST(NULL AS TIMESTAMP) AS reviewed_at")


SQL["fl"] = """SELECT doc_id AS flag_id, CASE WHEN doc_id % 2 = 0 THEN doc_id ELSE doc_id // 2 * 2 + 2 END AS new_doc_id,
  CASE WHEN doc_id % 2 = 0 THEN doc_id + 2 ELSE doc_id // 2 * 2 END AS existing_doc_id, doc_id || ':1' AS new_chunk_id,
  CASE WHEN doc_id % 3 = 0 THEN NULL ELSE (doc_id + 1) || ':1' END AS existing_chunk_id,
  ['contradicts','supersedes','duplicates'][1 + doc_id // 2 % 3] AS kind,
  ['pending','pending','confirmed','dismissed'][1 + doc_id % 4] AS status, make_timestamp((1704067200 + doc_id * 90) * 1000000) AS created_at,
  CAST(NULL AS TIMESTAMP) AS reviewed_at
FROM d"""


def questions(spark: SparkSession, d: str, tenant: str = "org") -> DataFrame:
    """Every benchmark passage as a question."""
    return raw(spark, d, "benchmark").select(F.lit(tenant).alias("tenant_id"), F.col("item_id").alias("question_id"), F.col("text").alias("question"))


SQL["qu"] = "SELECT 'org' AS tenant_id, item_id AS question_id, text AS question FROM benchmark"


def mixed_questions(spark: SparkSession, d: str) -> DataFrame:
    """Three questions per benchmark passage: the passage, the passage with a year range, and a file-title question."""
    b = raw(spark, d, "benchmark")
    kinds = F.array(F.col("text"), F.concat(F.lit("2008-2012 "), F.col("text")), F.concat(F.lit("src"), (F.col("item_id") % 20).cast("string"), F.lit(" or en")))
    return b.select("item_id", F.posexplode(kinds).alias("kind", "question")).select(
        F.lit("org").alias("tenant_id"), (F.col("item_id") * 10 + F.col("kind")).alias("question_id"), "question")


SQL["mq"] = """SELECT item_id * 10 + kind AS question_id, CASE kind WHEN 0 THEN text WHEN 1 THEN '2008-2012 ' || text ELSE 'src' || (item_id % 20) || ' or en' END AS question,
  CASE kind WHEN 1 THEN 2008 END AS y0, CASE kind WHEN 1 THEN 2012 END AS y1, CASE kind WHEN 1 THEN 7 ELSE 5 END AS k FROM benchmark, range(3) r(kind)"""


def question_lines(spark: SparkSession, d: str, tenant: str = "org") -> DataFrame:
    """Every line of every benchmark passage as a question."""
    b = raw(spark, d, "benchmark").select("item_id", F.posexplode(F.split("text", "\n")).alias("ln", "question"))
    return b.select(F.lit(tenant).alias("tenant_id"), (F.col("item_id") * 1000 + F.col("ln")).alias("question_id"), "question")


SQL["ql"] = """SELECT 'org' AS tenant_id, item_id * 1000 + ln - 1 AS question_id, question FROM (
  SELECT item_id, unnest(string_split(text, chr(10))) AS question, generate_subscripts(string_split(text, chr(10)), 1) AS ln FROM benchmark)"""


def vectors(spark: SparkSession, d: str) -> DataFrame:
    """Embeddings as chunks of documents of five vectors, one tenant per label."""
    return raw(spark, d, "embeddings").selectExpr(
        "vec_id AS chunk_id", "vec_id div 5 AS doc_id", "cast(label as string) AS tenant_id", "cast(vec_id % 5 as int) AS position", "embedding",
        f"array({_TYPES})[cast(vec_id div 5 % 6 as int)] AS doc_type", f"array({_FORUMS})[cast(vec_id div 5 % 5 as int)] AS forum",
        "CASE WHEN vec_id div 5 % 11 = 0 THEN NULL ELSE date_add(date'2005-01-01', cast(vec_id * 7 % 7000 as int)) END AS doc_date",
        "CASE vec_id % 3 WHEN 0 THEN 'escalation' WHEN 1 THEN 'terminal' END AS decision_type",
        "CASE WHEN vec_id % 4 = 1 THEN concat('סעיף ', vec_id) END AS section_path", "CAST(NULL AS STRING) AS superseded_by_amendment_id")


SQL["v"] = f"""SELECT vec_id AS chunk_id, vec_id // 5 AS doc_id, CAST(label AS VARCHAR) AS tenant_id, vec_id % 5 AS position,
  CAST(embedding AS DOUBLE[]) AS embedding, [{_TYPES}][1 + vec_id // 5 % 6] AS doc_type, [{_FORUMS}][1 + vec_id // 5 % 5] AS forum,
  CASE WHEN vec_id // 5 % 11 = 0 THEN NULL ELSE DATE '2005-01-01' + CAST(vec_id * 7 % 7000 AS INTEGER) END AS doc_date,
  CASE vec_id % 3 WHEN 0 THEN 'escalation' WHEN 1 THEN 'terminal' END AS decision_type,
  CASE WHEN vec_id % 4 = 1 THEN 'סעיף ' || vec_id END AS section_path
FROM embeddings"""


def vector_docs(spark: SparkSession, d: str) -> DataFrame:
    """Documents of the vector table (one per (document, tenant), as labels mix inside a document)."""
    return vectors(spark, d).groupBy("doc_id").agg(F.min("tenant_id").alias("tenant_id"), F.first("doc_type").alias("doc_type"),
                                                   F.first("forum").alias("forum")).selectExpr(
        "*", "CASE WHEN doc_id % 13 = 5 THEN doc_id + 1 END AS superseded_by_id", "concat('v', doc_id, '.pdf') AS filename",
        "date_add(date'2005-01-01', cast(doc_id * 3 as int)) AS effective_date")


SQL["vd"] = """SELECT doc_id, min(tenant_id) AS tenant_id, min(doc_type) AS doc_type, min(forum) AS forum,
  CASE WHEN doc_id % 13 = 5 THEN doc_id + 1 END AS superseded_by_id, 'v' || doc_id || '.pdf' AS filename,
  DATE '2005-01-01' + CAST(doc_id * 3 AS INTEGER) AS effective_date FROM v GROUP BY doc_id"""


def lexicon(spark: SparkSession, d: str) -> DataFrame:
    """Entries from the words of the benchmark passages, one tenant, single-word forms."""
    w = raw(spark, d, "benchmark").select("item_id", F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z]{6,}"), F.lit(0))).alias("word"))
    return w.groupBy(F.lower("word").alias("term")).agg(F.min("item_id").alias("item_id")).selectExpr(
        "'org' AS tenant_id", "concat('x:', term) AS lexicon_id", "term", "array(term, concat(upper(substr(term, 1, 1)), substr(term, 2))) AS surface_forms",
        "array('active','active','pending','rejected')[cast(item_id % 4 as int)] AS status",
        "concat('about ', term) AS expansion", "timestamp_seconds(1704067200 + item_id * 3600) AS updated_at")


SQL["lx"] = """SELECT 'org' AS tenant_id, 'x:' || term AS lexicon_id, term, [term, upper(substr(term, 1, 1)) || substr(term, 2)] AS surface_forms,
  ['active','active','pending','rejected'][1 + item_id % 4] AS status, 'about ' || term AS expansion,
  make_timestamp((1704067200 + item_id * 3600) * 1000000) AS updated_at
FROM (SELECT lower(word) AS term, min(item_id) AS item_id FROM (
  SELECT item_id, unnest(regexp_extract_all(text, '[A-Za-z]{6,}')) AS word FROM benchmark) GROUP BY 1)"""


def runs(spark: SparkSession, d: str) -> DataFrame:
    """One evaluation run per tenant and day of the event log; days that ended early are unfinished."""
    return queries(spark, d).groupBy("tenant_id", F.col("created_at").cast("date").alias("day")).agg(
        F.min("created_at").alias("started_at"), F.max("created_at").alias("_end"), F.round(F.avg("value") / 100, 6).alias("avg_score"),
        F.count("*").alias("total")).selectExpr(
        "tenant_id", "concat(tenant_id, '/', day) AS run_id", "started_at", "CASE WHEN hour(_end) >= 22 THEN _end END AS finished_at", "avg_score", "total")


SQL["ru"] = """SELECT tenant_id, tenant_id || '/' || CAST(day AS VARCHAR) AS run_id, started_at, CASE WHEN hour(e) >= 22 THEN e END AS finished_at, avg_score, total
FROM (SELECT tenant_id, CAST(created_at AS DATE) AS day, min(created_at) AS started_at, max(created_at) AS e,
  round(avg(value) / 100, 6) AS avg_score, count(*) AS total FROM q GROUP BY 1, 2)"""


def run_results(spark: SparkSession, d: str) -> DataFrame:
    """Score per run and golden: the users of that day play the goldens."""
    return queries(spark, d).filter("user_id is not null").groupBy(
        F.concat("tenant_id", F.lit("/"), F.col("created_at").cast("date").cast("string")).alias("run_id"), F.col("user_id").alias("golden_id")).agg(
        F.round(F.avg("value") / 100, 6).alias("score"), F.concat(F.lit("asked by "), F.col("user_id").cast("string")).alias("question"))


SQL["rr"] = """SELECT tenant_id || '/' || CAST(CAST(created_at AS DATE) AS VARCHAR) AS run_id, user_id AS golden_id, round(avg(value) / 100, 6) AS score,
  'asked by ' || user_id AS question FROM q WHERE user_id IS NOT NULL GROUP BY 1, 2"""


def goldens(spark: SparkSession, d: str) -> DataFrame:
    """One golden per labelled document: expects its own file and its successor's; keywords from language and tenant."""
    own = docs(spark, d).select("doc_id", "tenant_id", "lang", "filename")
    nxt = own.select((F.col("doc_id") - 1).alias("doc_id"), F.col("filename").alias("_next"))
    return raw(spark, d, "labels").join(own, "doc_id").join(nxt, "doc_id", "left").selectExpr(
        "tenant_id", "concat('g', doc_id) AS golden_id", "doc_id", "concat('about ', doc_id) AS question",
        "CASE WHEN quality = 1 THEN array_compact(array(filename, _next)) END AS expected_doc_filenames",
        "CASE WHEN toxic = 0 THEN array(lang, 'the') END AS expected_keywords", "timestamp_seconds(1704067200 + doc_id) AS created_at")


SQL["go"] = """SELECT o.tenant_id, 'g' || l.doc_id AS golden_id, l.doc_id, 'about ' || l.doc_id AS question,
  CASE WHEN quality = 1 THEN list_filter([o.filename, n.filename], lambda f: f IS NOT NULL) END AS expected_doc_filenames,
  CASE WHEN toxic = 0 THEN [o.lang, 'the'] END AS expected_keywords
FROM labels l JOIN d o USING (doc_id) LEFT JOIN d n ON n.doc_id = l.doc_id + 1"""


# chunk vectors of the offline embedder, for the SQL side
SQL["ce"] = r"""SELECT chunk_id, [coalesce(m[i], 0)::DOUBLE for i in range(64)] AS embedding FROM (
  SELECT chunk_id, map_from_entries(list((slot, n))) AS m FROM (
    SELECT chunk_id, ('0x' || substr(md5(lower(tok)), 1, 6))::INT % 64 AS slot, count(*) AS n FROM (
      SELECT chunk_id, unnest(regexp_extract_all(concat_ws(' — ', filename, section_path) || chr(10) || c.text, '[A-Za-z0-9\x{0590}-\x{05FF}]+')) AS tok FROM c JOIN d USING (doc_id))
    GROUP BY 1, 2) GROUP BY 1)"""
SQL["qe"] = r"""SELECT question_id, [coalesce(m[i], 0)::DOUBLE for i in range(64)] AS embedding FROM (
  SELECT question_id, map_from_entries(list((slot, n))) AS m FROM (
    SELECT question_id, ('0x' || substr(md5(lower(tok)), 1, 6))::INT % 64 AS slot, count(*) AS n FROM (
      SELECT question_id, unnest(regexp_extract_all(question, '[A-Za-z0-9\x{0590}-\x{05FF}]+')) AS tok FROM qz)
    GROUP BY 1, 2) GROUP BY 1)"""

_DEPENDS = {"c": ["d"], "am": ["d"], "re": ["c"], "fl": ["d"], "ru": ["q"], "rr": ["q"], "go": ["d"], "vd": ["v"], "ce": ["c"], "qe": []}


def with_tables(names: str, body: str) -> str:
    """SQL with the named derived tables (and what they need) in front; ``body`` may open with further 'name AS (…)' terms."""
    needed: list[str] = []

    def need(n: str) -> None:
        for dep in _DEPENDS.get(n, []):
            need(dep)
        if n not in needed:
            needed.append(n)
    for n in names.split():
        need(n)
    head = ",\n".join(f"{n} AS ({SQL[n]})" for n in needed)
    sep = "\n" if body.lstrip().upper().startswith("SELECT") else ",\n"
    return f"WITH {head}{sep}{body}"
