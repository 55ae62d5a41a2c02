"""Term matching, span annotation and vocabulary mining."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom import settings as S
from docloom.functions import pieces
from docloom.functions import text as X
from docloom.operators.documents import turn_segment
from docloom.operators.scale import top_n, with_next
from docloom.operators.slices import flat_map

_NOTABLE = T.ArrayType(T.StructType().add("start", "integer").add("end", "integer").add("span", "string"))
_MATCH = "lexicon_id string, term string, surface_form string, start int, end int"
BROADCAST_ENTRIES = 20_000
BROADCAST_CHARS = 32 << 20


def _forms(lexicon: DataFrame) -> DataFrame:
    """Active entries with their forms; an entry without forms is matched by its term."""
    forms = F.when(F.size(F.coalesce("surface_forms", F.array().cast("array<string>"))) > 0, F.col("surface_forms"))
    return lexicon.filter("status = 'active'").select(
        F.col("tenant_id").cast("string").alias("tenant_id"), F.col("lexicon_id").cast("string").alias("lexicon_id"), "term",
        F.coalesce(forms, F.array("term")).alias("forms"))


def known_forms(lexicon: DataFrame) -> DataFrame:
    """Distinct lower-cased terms and forms per tenant, whatever their status."""
    both = F.concat(F.array("term"), F.coalesce("surface_forms", F.array().cast("array<string>")))
    low = lexicon.select("tenant_id", F.explode(both).alias("_f")).select("tenant_id", F.lower(F.trim("_f")).alias("known"))
    return low.filter("known <> ''").distinct()


def match_terms(texts: DataFrame, lexicon: DataFrame, broadcast_entries: int = BROADCAST_ENTRIES) -> DataFrame:
    """Lexicon matches in texts(tenant_id, text_id, text) (X1): lexicon_id, term, surface_form, start, end.

    A lexicon within the entry and size limits is broadcast as per-tenant indexes. A larger one is first narrowed by an
    equi-join of text words with the first words of the forms, so each text meets only entries that can occur in it; the
    same index then runs on those. Both routes give equal rows."""
    entries = _forms(lexicon)
    head = entries.orderBy("tenant_id", "lexicon_id").limit(broadcast_entries + 1)
    chars = head.agg(F.count("*").alias("n"), F.sum(F.length(F.array_join("forms", " "))).alias("c")).first()
    if chars["n"] <= broadcast_entries and (chars["c"] or 0) <= BROADCAST_CHARS:
        local: dict[str, list] = {}
        for r in head.collect():
            local.setdefault(r["tenant_id"], []).append((r["lexicon_id"], r["term"], list(r["forms"])))
        shared = texts.sparkSession.sparkContext.broadcast(local)

        def start():
            ready: dict[str, pieces.TermIndex] = {}

            def find(tenant: str | None, text: str | None) -> list[tuple]:
                if tenant not in ready:
                    ready[tenant] = pieces.TermIndex(shared.value.get(tenant, []))
                return ready[tenant].find(text or "")
            return find

        return flat_map(texts.withColumn("_tenant", F.col("tenant_id").cast("string")), ["_tenant", "text"], ["tenant_id", "text_id"], _MATCH, start)
    return _match_by_words(texts, entries)


def _match_by_words(texts: DataFrame, entries: DataFrame) -> DataFrame:
    first_word = F.regexp_extract(F.col("_f"), f"[{X.WORD}]+", 0)
    keys = (entries.select("tenant_id", "lexicon_id", F.explode("forms").alias("_f"))
            .filter("_f <> ''").select("tenant_id", "lexicon_id", first_word.alias("word")).distinct())
    words = F.array_distinct(F.regexp_extract_all("text", F.lit(f"[{X.WORD}]+"), F.lit(0)))
    if keys.filter("word = ''").head(1):  # forms of punctuation only: every text has to try them
        words = F.concat(words, F.array(F.lit("")))
    tried = (texts.select(F.col("tenant_id").cast("string").alias("tenant_id"), "text_id", F.explode(words).alias("word"))
             .join(keys, ["tenant_id", "word"]).select("tenant_id", "text_id", "lexicon_id").distinct()
             .join(entries, ["tenant_id", "lexicon_id"]))
    # bounded by the words of one text
    sets = tried.groupBy("tenant_id", "text_id").agg(F.array_sort(F.collect_list(F.struct("lexicon_id", "term", "forms"))).alias("_e"))

    def start():
        return lambda text, found: pieces.TermIndex([(e["lexicon_id"], e["term"], e["forms"]) for e in found]).find(text or "")

    typed = texts.withColumn("_tenant", F.col("tenant_id").cast("string"))
    return flat_map(typed.join(sets.withColumnRenamed("tenant_id", "_tenant"), ["_tenant", "text_id"]), ["text", "_e"], ["tenant_id", "text_id"], _MATCH, start)


@F.pandas_udf(_NOTABLE)
def _notable(texts: pd.Series) -> pd.Series:
    return pd.Series([[dict(start=s, end=e, span=t) for s, e, t in pieces.notable_spans(v or "")] for v in texts], dtype=object)


_SPAN = T.ArrayType(T.StructType().add("start", "integer").add("end", "integer").add("span", "string").add("kind", "string")
                    .add("lexicon_id", "string").add("term", "string"))


@F.pandas_udf(_SPAN)
def _settle(lists: pd.Series) -> pd.Series:
    def one(spans):
        items = [dict(s) for s in spans]
        items.sort(key=lambda s: (s["start"], s["end"], s["lexicon_id"] or ""))
        picked = pieces.pick_spans([(0 if s["kind"] == "known" else 1, s["start"], s["end"]) for s in items])
        return [items[i] for i in picked]
    return pd.Series([one(v) for v in lists], dtype=object)


def annotate(texts: DataFrame, lexicon: DataFrame, **options: int) -> DataFrame:
    """Answer spans (X2): known terms plus quoted phrases and acronyms not yet in the active lexicon, without overlaps
    (known first, then longer, then earlier): tenant_id, text_id, start, end, span, kind, lexicon_id, term."""
    known = match_terms(texts, lexicon, **options).select(
        "tenant_id", "text_id", "start", "end", F.col("surface_form").alias("span"), F.lit("known").alias("kind"), "lexicon_id", "term")
    none = F.lit(None).cast("string")
    fresh = (texts.select("tenant_id", "text_id", F.explode(_notable("text")).alias("_s"))
             .select("tenant_id", "text_id", "_s.*").withColumn("known", F.lower("span"))
             .join(known_forms(lexicon.filter("status = 'active'")), ["tenant_id", "known"], "left_anti")
             .select("tenant_id", "text_id", "start", "end", "span", F.lit("candidate").alias("kind"),
                     none.alias("lexicon_id"), none.alias("term")))
    # bounded: the spans of one text
    packed = known.unionByName(fresh).groupBy("tenant_id", "text_id").agg(
        F.collect_list(F.struct("start", "end", "span", "kind", "lexicon_id", "term")).alias("_s"))
    return packed.select("tenant_id", "text_id", F.explode(_settle("_s")).alias("_s")).select("tenant_id", "text_id", "_s.*")


def match_events(matches: DataFrame, context: str, as_of: Column) -> DataFrame:
    """One usage event per (text, entry, form)."""
    return (matches.select("tenant_id", "text_id", "lexicon_id", "surface_form").distinct()
            .withColumn("context", F.lit(context)).withColumn("created_at", as_of))


def _days_before(as_of: Column, days: int) -> Column:
    return as_of - F.make_dt_interval(F.lit(days))


def lexicon_usage(lexicon: DataFrame, events: DataFrame, as_of: Column, status: str | None = None) -> DataFrame:
    """Entries with 30-day match count and last match (X4); active and pending ones unless a status is asked for."""
    rows = lexicon.filter(F.col("status") == status) if status else lexicon.filter(F.col("status").isin("active", "pending"))
    recent = (events.filter(F.col("created_at") >= _days_before(as_of, S.USAGE_DAYS)).groupBy("lexicon_id")
              .agg(F.count("*").alias("match_count_30d"), F.max("created_at").alias("last_matched_at")))
    return (rows.join(recent, "lexicon_id", "left").withColumn("match_count_30d", F.coalesce("match_count_30d", F.lit(0)))
            .orderBy(F.col("status").desc(), "term", "lexicon_id"))


def prune_events(events: DataFrame, as_of: Column, days: int = S.MATCH_EVENT_DAYS) -> tuple[DataFrame, DataFrame]:
    """(kept events, pruned count per tenant)."""
    old = F.col("created_at") < _days_before(as_of, days)
    kept = events.filter(~F.coalesce(old, F.lit(False)))
    return kept, events.filter(old).groupBy("tenant_id").agg(F.count("*").alias("pruned"))


def mine_quoted(queries: DataFrame, lexicon: DataFrame, since: Column, min_distinct: int = S.QUOTED_MIN_DISTINCT) -> DataFrame:
    """Quoted phrases and acronyms of recent answers seen in enough distinct queries and unknown so far."""
    recent = queries.filter(F.col("created_at") >= since)  # a missing answer has no candidates
    found = recent.select("tenant_id", "query_id", F.explode(F.array_distinct(X.quoted_and_acronyms(F.col("answer")))).alias("candidate"))
    # a candidate stands once in an answer: only queries of several rows, or none of an id, need their ids told apart
    several = recent.groupBy("query_id").agg(F.count("*").alias("_n")).filter("_n > 1 or query_id is null")
    distinct = F.count("*") if several.isEmpty() else F.count_distinct("query_id")
    counts = found.groupBy("tenant_id", "candidate").agg(distinct.alias("distinct_queries"), F.min("query_id").alias("sample_query_id"))
    return _unknown(counts.filter(F.col("distinct_queries") >= min_distinct), "candidate", lexicon)


def _unknown(rows: DataFrame, col: str, lexicon: DataFrame) -> DataFrame:
    return (rows.withColumn("known", F.lower(F.trim(col))).join(known_forms(lexicon), ["tenant_id", "known"], "left_anti")
            .drop("known"))


def mine_gaps(chunks: DataFrame, queries: DataFrame, lexicon: DataFrame, since: Column, top: int | None = None,
              doc_min: int = S.DOC_FREQ_MIN, query_max: int = S.QUERY_FREQ_MAX, query_min: int = S.QUERY_FREQ_MIN,
              doc_max: int = S.DOC_FREQ_MAX) -> DataFrame:
    """Vocabulary gaps (X7, X8): the unknown terms of each signal per tenant, all or the ``top`` ones (e.g. 15), ranked before known terms leave.

    'doc_frequent': in many chunks, in few questions. 'query_frequent': asked often, in no chunk. Both vocabularies are counted in one
    aggregation."""
    def terms(df: DataFrame, col: str, of_docs: int) -> DataFrame:
        return df.select("tenant_id", F.explode(X.mining_tokens(F.col(col))).alias("candidate"), F.lit(of_docs).alias("_d"))
    every = terms(chunks, "text", 1).unionByName(terms(queries.filter(F.col("created_at") >= since), "question", 0))
    both = every.groupBy("tenant_id", "candidate").agg(F.sum("_d").alias("doc_freq"), F.sum(1 - F.col("_d")).alias("query_freq"))
    said = both.filter((F.col("doc_freq") >= doc_min) & (F.col("query_freq") <= query_max)).withColumn("signal", F.lit("doc_frequent"))
    asked = both.filter((F.col("query_freq") >= query_min) & (F.col("doc_freq") <= doc_max)).withColumn("signal", F.lit("query_frequent"))
    ranked = said.withColumn("_n", F.col("doc_freq")).unionByName(asked.withColumn("_n", F.col("query_freq")))
    cut = ranked if top is None else top_n(ranked, ["tenant_id", "signal"], [F.col("_n").desc(), F.col("candidate")], top, "rank")
    cut = cut.drop("_n")
    return _unknown(cut, "candidate", lexicon)


def mine_edits(pairs: DataFrame, lexicon: DataFrame) -> DataFrame:
    """Candidates a reviewer's edit introduced (X9): pairs(tenant_id, query_id, original_answer, edited_answer)."""
    changed = pairs.filter("edited_answer <> '' and not (edited_answer <=> original_answer)")
    new = F.array_except(X.quoted_and_acronyms(F.col("edited_answer")), X.quoted_and_acronyms(F.col("original_answer")))
    return _unknown(changed.select("tenant_id", "query_id", F.explode(new).alias("candidate")), "candidate", lexicon)


def failed(p: str = "") -> Column:
    return (F.col(p + "confidence").isin("clarifying", "refused")) | (F.coalesce(F.col(p + "feedback"), F.lit("")) == "negative")


def succeeded(p: str = "") -> Column:
    return (F.coalesce(F.col(p + "feedback"), F.lit("")) != "negative") & F.col(p + "confidence").isin("confident", "uncertain")


def refinement_pairs(queries: DataFrame, since: Column, n: int | None = None) -> DataFrame:
    """Consecutive turns of a recently active thread, first failed then succeeded (X10): tenant_id, conversation_id,
    from_query_id, to_query_id. Threads are windowed in slices, so one long thread is split over tasks. ``n`` keeps the
    first n pairs per tenant (in thread and turn order)."""
    threads = queries.filter("conversation_id is not null")
    active = (threads.groupBy("conversation_id").agg(F.max("created_at").alias("_u")).filter(F.col("_u") >= since)
              .select("conversation_id"))
    turns = (threads.join(active, "conversation_id", "left_semi")
             .select("tenant_id", "conversation_id", "query_id", "created_at", "turn_index", "confidence", "feedback",
                     F.coalesce("turn_index", F.lit(2_147_483_647)).alias("_turn")))
    nxt = with_next(turns, ["conversation_id"], ["_turn", "created_at", "query_id"], turn_segment(),
                    ["query_id", "confidence", "feedback"])
    pairs = nxt.filter(F.col("next").isNotNull() & F.coalesce(failed(), F.lit(False)) & F.coalesce(succeeded("next."), F.lit(False)))
    if n is not None:
        pairs = top_n(pairs, ["tenant_id"], [F.col("conversation_id"), F.col("_turn"), F.col("created_at"), F.col("query_id")], n)
    return pairs.select("tenant_id", "conversation_id", F.col("query_id").alias("from_query_id"),
                        F.col("next.query_id").alias("to_query_id"))


def new_documents(pairs: DataFrame, queries: DataFrame, chunks: DataFrame, docs: DataFrame) -> DataFrame:
    """Files cited by the second turn of a pair and not by the first (X11): one row per (pair, filename)."""
    cited = (queries.select("query_id", F.explode("source_chunk_ids").alias("chunk_id"))
             .join(chunks.select("chunk_id", "doc_id"), "chunk_id").join(docs.select("doc_id", "filename"), "doc_id")
             .select("query_id", "filename").distinct())
    ids = pairs.select("from_query_id", "to_query_id")
    after = ids.join(cited.withColumnRenamed("query_id", "to_query_id"), "to_query_id")
    before = ids.join(cited.withColumnRenamed("query_id", "from_query_id"), "from_query_id")
    return after.join(before, ["from_query_id", "to_query_id", "filename"], "left_anti").select("from_query_id", "to_query_id", "filename")


def gate_proposals(proposals: DataFrame, lexicon: DataFrame, min_confidence: float = 0.6) -> DataFrame:
    """Proposals worth a reviewer's look as pending entries (X12): term and expansion given, confident enough, unknown
    term, first of its spelling per tenant. proposals(tenant_id, ord, term, expansion, confidence, …evidence)."""
    ok = proposals.filter((F.trim("term") != "") & (F.trim("expansion") != "") & (F.coalesce("confidence", F.lit(0.0)) >= min_confidence))
    terms = lexicon.select("tenant_id", F.lower(F.trim("term")).alias("_t")).distinct()
    fresh = ok.withColumn("_t", F.lower(F.trim("term"))).join(terms, ["tenant_id", "_t"], "left_anti")
    return (top_n(fresh, ["tenant_id", "_t"], [F.col("ord"), F.col("term")], 1).drop("_t")
            .withColumn("term", F.trim("term")).withColumn("expansion", F.trim("expansion"))
            .withColumn("source", F.lit("learned")).withColumn("status", F.lit("pending")))


def failed_questions(queries: DataFrame, n: int = 10) -> DataFrame:
    """Latest n failures per tenant."""
    bad = queries.filter("feedback = 'negative' or failure_mode = 'retrieval_miss'")
    return top_n(bad, ["tenant_id"], [F.col("created_at").desc(), F.col("query_id")], n, "rank")


def lexicon_digest(lexicon: DataFrame, since: Column) -> DataFrame:
    """Entries touched since a date by tenant and status, busiest tenant first (X14); digest_entries lists them."""
    def n(cond: Column, name: str) -> Column:
        return F.count_if(cond).alias(name)
    s = F.col("status")
    return (lexicon.filter(F.col("updated_at") >= since).groupBy("tenant_id")
            .agg(n(s == "pending", "pending"), n(s == "active", "active"),
                 n(~s.isin("pending", "active"), "rejected"), F.count("*").alias("total"))
            .orderBy(F.col("total").desc(), "tenant_id"))


def digest_entries(lexicon: DataFrame, since: Column) -> DataFrame:
    s = F.col("status")
    bucket = F.when(s.isin("pending", "active"), s).otherwise("rejected")
    return (lexicon.filter(F.col("updated_at") >= since).select("tenant_id", bucket.alias("bucket"), "term", "expansion", "updated_at")
            .orderBy("tenant_id", "bucket", F.col("updated_at").desc(), "term"))
