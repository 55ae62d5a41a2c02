"""Document, chunk and question transforms."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom import settings as S
from docloom.functions import pieces
from docloom.functions import text as X
from docloom.operators.scale import top_n, with_last_before
from docloom.operators.slices import flat_map

_PIECES = "position int, text string, section_path string"


def chunk_documents(docs: DataFrame, profile: str = "hebrew", marker: str | None = None, space: str | None = None) -> DataFrame:
    """Cut documents into chunks (P1). ``profile``: 'hebrew', 'numbered', 'plain', or 'lines' (one chunk per non-blank
    line, positions kept); ``marker`` overrides the regex of a profile, ``space`` the signs its chunks lose at their ends (all white
    space). Other columns of ``docs`` are carried along."""
    others = [c for c in docs.columns if c != "text"]
    if profile == "lines":
        lines = docs.select(*others, F.posexplode(F.split("text", "\n")).alias("position", "text"))
        out = (lines.withColumn("text", X.strip_ws(F.col("text"))).filter("text != ''")
               .withColumn("section_path", F.lit(None).cast("string")))
    else:
        pattern = marker or pieces.MARKER_PROFILES[profile]

        def start():
            regex = re.compile(pattern, re.MULTILINE) if pattern else None
            return lambda text: pieces.cut_sections(text or "", regex, space)

        out = flat_map(docs, ["text"], others, _PIECES, start)
    return (out.withColumn("chunk_id", F.concat_ws(":", F.col("doc_id").cast("string"), F.col("position").cast("string")))
            .withColumn("section_ref", X.section_ref(F.col("section_path"))))


def tag_decisions(chunks: DataFrame) -> DataFrame:
    """Add decision_type (P2). Packed paragraphs of documents without markers are tagged by the same rule."""
    return chunks.withColumn("decision_type", X.decision_type(F.col("text")))


def retag_report(old: DataFrame, new: DataFrame, key: str = "chunk_id") -> DataFrame:
    """Counts of added / flipped / cleared / unchanged tags between two tag states."""
    before, after = F.col("before"), F.col("after")
    change = (F.when(before.eqNullSafe(after), "unchanged").when(before.isNull(), "added")
              .when(after.isNull(), "cleared").otherwise("flipped"))
    joined = old.select(key, F.col("decision_type").alias("before")).join(
        new.select(key, F.col("decision_type").alias("after")), key)
    return joined.groupBy(change.alias("change")).agg(F.count("*").alias("n"))


def with_section_ref(chunks: DataFrame) -> DataFrame:
    return chunks.withColumn("section_ref", X.section_ref(F.col("section_path")))


def with_embedding_input(chunks: DataFrame, title_col: str = "filename") -> DataFrame:
    """Add the header-prefixed text that is sent to the embedder."""
    return chunks.withColumn("embedding_input", X.embedding_input(F.col("text"), F.col("section_path"), F.col(title_col)))


def quality_expr(chars: Column, pages: Column, partial: Column, chunks: Column) -> Column:
    return (F.when(chars.isNull() & pages.isNull(), "unknown")
            .when(F.coalesce(partial, F.lit(False)), "partial")
            .when((pages > 0) & chars.isNotNull() & (chars / pages < S.MIN_CHARS_PER_PAGE), "low_density")
            .when(chunks == 0, "suspect").otherwise("ok"))


def quality_report(docs: DataFrame, chunks: DataFrame) -> DataFrame:
    """Quality verdict per document from extraction telemetry and its chunk count."""
    counts = chunks.groupBy("doc_id").agg(F.count("*").alias("chunks"))
    joined = docs.join(counts, "doc_id", "left").withColumn("chunks", F.coalesce("chunks", F.lit(0)))
    return joined.select("doc_id", "tenant_id", "chunks", quality_expr(
        F.col("chars_extracted"), F.col("pages"), F.col("extraction_partial"), F.col("chunks")).alias("quality"))


def gate(docs: DataFrame, force: bool = False) -> DataFrame:
    """Add reject_reason (NULL = accepted): empty, low_density, partial (P4). ``force`` keeps thin and partial texts."""
    empty = X.strip_ws(F.coalesce(F.col("text"), F.lit(""))) == ""
    reason = F.when(empty, "empty")
    if not force:
        reason = (reason.when((F.col("pages") > 0) & (F.length("text") / F.col("pages") < S.MIN_CHARS_PER_PAGE),
                              "low_density").when(F.coalesce("extraction_partial", F.lit(False)), "partial"))
    return docs.withColumn("reject_reason", reason)


def looks_mirrored(text: Column) -> Column:
    """True when mirrored function words clearly outnumber forward ones (P5)."""
    def check(t: Column) -> Column:
        forward = sum((X.count_of(t, w) for w in S.RTL_FUNCTION_WORDS), F.lit(0))
        mirrored = sum((X.count_of(t, w[::-1]) for w in S.RTL_FUNCTION_WORDS), F.lit(0))
        return (F.length(t) >= S.MIN_CHARS_FOR_RTL_CHECK) & (mirrored > forward + S.RTL_MARGIN)
    # bound to a lambda variable, so a computed text is built once and not per counted word
    return F.exists(F.array(text), check)


def unmirror(text: Column) -> Column:
    """Visually ordered right-to-left lines in reading order. A line is a row of segments, runs of Latin letters and digits and what stands
    between them; the segments change places, and only those between the runs are turned."""
    # fixed value: what belongs to a left-to-right run
    run = "0-9A-Za-z._/\\-"

    def line(t: Column) -> Column:
        segments = F.regexp_extract_all(t, F.lit(f"([{run}]+|[^{run}]+)"), F.lit(1))
        # most gaps are one sign, which needs no turning
        turned = F.transform(F.reverse(segments), lambda s: F.when((F.length(s) < 2) | s.rlike(f"^[{run}]"), s).otherwise(F.reverse(s)))
        return X.strip_ws(F.regexp_replace(F.array_join(turned, ""), " +", " "))
    return F.array_join(F.transform(F.split(text, "\n", -1), line), "\n")


def repair_rtl(chunks: DataFrame, mirrored_docs: DataFrame | None = None) -> DataFrame:
    """Repaired rows only: chunks of the given documents, or every chunk that itself looks mirrored (P5)."""
    broken = (chunks.join(mirrored_docs.select("doc_id").distinct(), "doc_id", "left_semi") if mirrored_docs is not None
              else chunks.filter(looks_mirrored(F.col("text"))))
    # exploded, as a filter on a plain column would repair each text twice
    return broken.withColumn("fixed_text", F.explode(F.array(unmirror(F.col("text"))))).filter("not (text <=> fixed_text)")


def backfill_dates(docs: DataFrame) -> DataFrame:
    """Fill a missing effective_date from the file name (P6); date_source says where it came from."""
    found = X.filename_date(F.col("filename"))
    return (docs.withColumn("date_source", F.when(F.col("effective_date").isNotNull(), "kept")
                            .when(found.isNotNull(), "filename").otherwise("none"))
            .withColumn("effective_date", F.coalesce("effective_date", found)))


def copy_dates_to_chunks(chunks: DataFrame, docs: DataFrame) -> DataFrame:
    """Chunks mirror their document's date; chunks of undated documents keep what they had."""
    dates = docs.filter("effective_date is not null").select("doc_id", F.col("effective_date").alias("_doc_date"))
    return (chunks.join(dates, "doc_id", "left")
            .withColumn("effective_date", F.coalesce("_doc_date", "effective_date")).drop("_doc_date"))


def dates_by_year(docs: DataFrame) -> DataFrame:
    """Documents newly dated by backfill_dates, per year."""
    return (docs.filter("date_source = 'filename'").groupBy(F.year("effective_date").alias("year"))
            .agg(F.count("*").alias("filled")))


def infer_status(docs: DataFrame, model_status_col: str | None = None) -> DataFrame:
    """Lifecycle status (P7): a file-name cue beats a missing or 'adopted' label; otherwise label, then stored value."""
    cue = X.filename_status(F.col("filename"))
    label = F.col(model_status_col) if model_status_col else F.lit(None).cast("string")
    valid = F.when(label.isin(S.DOC_STATUSES), label)
    picked = F.when(cue.isNotNull() & (valid.isNull() | (valid == "adopted")), cue).otherwise(valid)
    return docs.withColumn("doc_status", F.coalesce(picked, F.col("doc_status")))


def reevaluate_adopted(docs: DataFrame, model_status_col: str | None = None) -> DataFrame:
    """Second look at adopted documents (P7): only flips to background or invitation are applied; changed rows only."""
    label = F.col(model_status_col) if model_status_col else F.lit(None).cast("string")
    new = F.coalesce(X.filename_status(F.col("filename")), label)
    return (docs.filter("doc_status = 'adopted'").withColumn("new_status", new)
            .filter(F.col("new_status").isin("background", "invitation")))


def annotate_questions(questions: DataFrame, prior_col: str | None = None, terms_col: str | None = None,
                       answer_col: str | None = None) -> DataFrame:
    """Intent, year range, triage shortcut and self-clarifying flag."""
    q = F.col("question")
    lo, hi = X.year_bounds(q)
    none = F.lit(False)
    out = (questions.withColumn("intent", X.intent(q)).withColumn("year_from", lo).withColumn("year_to", hi)
           .withColumn("skip_triage", X.needs_no_triage(q, F.col(prior_col) if prior_col else none,
                                                        F.col(terms_col) if terms_col else none)))
    return out.withColumn("asks_back", X.asks_for_clarification(F.col(answer_col))) if answer_col else out


def turn_segment(turn_col: str = "turn_index", time_col: str = "created_at", width: int = 4096) -> Column:
    """Monotone slice of a conversation in (turn, time) order; turnless rows come last, by day."""
    day = F.datediff(F.col(time_col).cast("date"), F.lit("1970-01-01").cast("date"))
    return F.when(F.col(turn_col).isNotNull(), F.floor(F.col(turn_col) / width)).otherwise(
        F.lit(1 << 40) + F.coalesce(day, F.lit(1 << 30)))


def canonical_queries(turns: DataFrame, expansions: DataFrame | None = None) -> DataFrame:
    """Self-contained query per turn (P9): latest earlier question of the thread + question + term expansions.

    turns(query_id, conversation_id, turn_index, created_at, question); expansions(query_id, ord, expansion)."""
    thread = F.coalesce(F.col("conversation_id").cast("string"), F.concat(F.lit("q:"), F.col("query_id").cast("string")))
    q = turns.withColumn("_turn_key", F.coalesce("turn_index", F.lit(2_147_483_647))).withColumn("_thread", thread)
    with_prior = with_last_before(q, ["_thread"], ["_turn_key", "created_at", "query_id"], turn_segment(),
                                  F.when(F.col("question") != "", F.col("question")), "prior_question").drop("_turn_key", "_thread")
    parts = [X.blank_to_null(F.col("prior_question")), X.blank_to_null(F.col("question"))]
    if expansions is not None:
        # bounded: the terms matched inside one question
        lists = (expansions.filter(X.blank_to_null(F.col("expansion")).isNotNull()).groupBy("query_id")
                 .agg(F.array_sort(F.collect_list(F.struct("ord", X.strip_ws(F.col("expansion")).alias("x")))).alias("_e")))
        with_prior = with_prior.join(lists, "query_id", "left")
        parts.append(F.when(F.col("_e").isNotNull(), F.array_join(F.col("_e.x"), " ")))
    out = with_prior.withColumn("canonical_query", F.concat_ws(" ", *parts))
    return out.drop("_e") if expansions is not None else out


STRUCTURED_FIELDS = ["document_date", "meeting_number", "decision_number", "bylaw_section_range"]


def merge_metadata(docs: DataFrame, proposals: DataFrame, reviews: DataFrame | None = None) -> DataFrame:
    """Fold model proposals and human reviews into documents (P10).

    Proposals fill type, forum, status, folder and summary; dates and structured fields only where no human has reviewed
    the document. A review row wins over everything and marks the document reviewed; its '' clears a field. All three
    tables carry one row per doc_id."""
    loose = ["doc_type", "forum", "doc_status", "folder", "summary"]
    guarded = ["effective_date", *STRUCTURED_FIELDS]
    fields = loose + guarded
    p = proposals.select("doc_id", *[F.col(f).alias(f"_p_{f}") for f in fields if f in proposals.columns],
                         F.lit(True).alias("_p"))
    out = docs.join(p, "doc_id", "left")
    reviewed = F.coalesce("metadata_reviewed", F.lit(False))
    for f in fields:
        if f not in proposals.columns or f not in docs.columns:
            continue
        new = F.col(f"_p_{f}")
        if f in loose:
            if f == "doc_status":
                new = F.when(new.isin(S.DOC_STATUSES), new)
            value = F.coalesce(F.when(new.cast("string") != "", new), F.col(f))
            if f == "summary":
                value = F.when(F.col("_p"), new).otherwise(F.col(f))
        elif f == "effective_date":
            value = F.when(F.col("_p") & ~reviewed, F.coalesce(new, F.col(f))).otherwise(F.col(f))
        else:
            value = F.when(F.col("_p") & ~reviewed, new).otherwise(F.col(f))
        out = out.withColumn(f, value)
    out = out.drop("_p", *[c for c in out.columns if c.startswith("_p_")])
    if reviews is None:
        return out
    edited = [f for f in fields if f in reviews.columns and f in docs.columns]
    r = reviews.select("doc_id", *[F.col(f).alias(f"_r_{f}") for f in edited], F.lit(True).alias("_r"))
    out = out.join(r, "doc_id", "left")
    for f in edited:
        new = F.col(f"_r_{f}")
        kind = out.schema[f].dataType
        cleared = F.when(new.cast("string") != "", new).cast(kind)
        out = out.withColumn(f, F.when(F.col("_r") & new.isNotNull(), cleared).otherwise(F.col(f)))
    out = out.withColumn("metadata_reviewed", reviewed | F.coalesce("_r", F.lit(False)))
    return out.drop("_r", *[c for c in out.columns if c.startswith("_r_")])


def surface_forms(term: Column) -> Column:
    """Canonical term, prefixed forms, then naive plurals with their prefixes; first occurrence kept."""
    t = X.strip_ws(term)
    prefixes = F.array(*[F.lit(p) for p in S.TERM_PREFIXES_1 + S.TERM_PREFIXES_2])

    def family(word: Column) -> Column:
        return F.concat(F.array(word), F.transform(prefixes, lambda p: F.concat(p, word)))

    last = F.translate(t.substr(F.length(t), F.lit(1)), S.FINAL_LETTERS, S.MEDIAL_LETTERS)
    stem = F.concat(t.substr(F.lit(1), F.length(t) - 1), last)
    plurals = F.concat(*[family(F.concat(stem, F.lit(p))) for p in S.TERM_PLURALS])
    single_word = ~t.contains(" ") & (F.length(t) >= 2)
    forms = F.when(single_word, F.concat(family(t), plurals)).otherwise(family(t))
    return F.when(F.coalesce(t, F.lit("")) != "", F.array_distinct(forms)).otherwise(F.array().cast("array<string>"))


def expand_surface_forms(lexicon: DataFrame) -> DataFrame:
    """One row per (entry, form) with its order."""
    return lexicon.select("tenant_id", "lexicon_id", "term",
                          F.posexplode(surface_forms(F.col("term"))).alias("ord", "surface_form"))


# fixed values from here to the end: the sentences and labels of the notes

def source_header(rank: Column) -> Column:
    """Numbered header of one source: file / section / forum / status / date / decision type."""
    def tag(label: str, c: str) -> Column:
        return F.when(F.coalesce(F.col(c).cast("string"), F.lit("")) != "", F.concat(F.lit(f"{label}="), F.col(c).cast("string")))
    parts = F.concat_ws(" / ", F.col("filename"), F.when(F.col("section_path") != "", F.col("section_path")),
                        tag("פורום", "forum"), tag("מעמד", "doc_status"), tag("תאריך", "effective_date"),
                        tag("decision_type", "decision_type"))
    return F.concat(F.lit("["), rank.cast("string"), F.lit("] (מקור: "), parts, F.lit(")"))


def amendment_note() -> Column:
    head = F.concat(F.lit("[תיקון פעיל • תוקף "), F.coalesce(F.col("effective_date").cast("string"), F.lit("לא מפורש")),
                    F.lit(" • פעולה: "), F.col("action"), F.lit("] סעיף "), F.col("target_section"), F.lit(" של "),
                    F.col("target_filename"), F.lit(" תוקן ב-"), F.col("amendment_filename"), F.lit("."))
    return F.concat_ws("\n", head, F.when(F.col("new_text") != "", F.concat(F.lit("נוסח מעודכן: "), F.col("new_text"))),
                       F.when(F.col("rationale") != "", F.concat(F.lit("סיבה: "), F.col("rationale"))))


def resolution_note() -> Column:
    from docloom.operators.scale import literal_map
    forum = F.coalesce(literal_map(S.FORUM_LABEL, F.col("terminal_forum"), None),
                       F.when(F.col("terminal_forum") != "", F.col("terminal_forum")), F.lit("פורום גבוה יותר"))
    src = F.concat(F.col("escalation_filename"),
                   F.when(F.col("escalation_section") != "", F.concat(F.lit(" ("), F.col("escalation_section"), F.lit(")")))
                   .otherwise(""))
    topic = F.when(F.col("topic") != "", F.concat(F.lit('"'), F.col("topic"), F.lit('" '))).otherwise("")
    date = F.when(F.col("terminal_date").isNotNull(), F.concat(F.lit(", "), F.col("terminal_date").cast("string"))).otherwise("")
    return F.concat(F.lit("[שרשרת החלטות] הפריט מ-"), src, F.lit(" הוא escalation — הנושא "), topic, F.lit("הוכרע ב"), forum,
                    F.lit(" ("), F.col("terminal_filename"), date,
                    F.lit("). ההחלטה הטרמינלית היא המקור המחייב; הפריט המעביר הוא רקע בלבד."))


def assemble_context(hits: DataFrame, history: DataFrame | None = None, amendments: DataFrame | None = None,
                     resolutions: DataFrame | None = None, lexicon: DataFrame | None = None, turns: int | None = None) -> DataFrame:
    """Context blocks per question (P12): rows (question_id, block, ord, body), to be read in (block, ord) order.

    Rows rather than one string per question, because notes have no upper bound. Blocks: 1 history (all or the last ``turns``),
    2 lexicon, 3 amendment, 4 resolution, 5 source. hits carry rank and document columns; history(question_id, ord, role,
    body); amendments / resolutions are G1 / G2 rows; lexicon(question_id, term, answerer_expansion, expansion)."""
    def block(df: DataFrame, no: int, ord_col: Column, body: Column) -> DataFrame:
        return df.select("question_id", F.lit(no).alias("block"), ord_col.cast("string").alias("ord"), body.alias("body"))

    parts = [block(hits, 5, F.lpad(F.col("rank").cast("string"), 6, "0"),
                   F.concat(source_header(F.col("rank")), F.lit("\n"), F.col("text")))]
    if history is not None:
        last = history if turns is None else top_n(history, ["question_id"], [F.col("ord").desc()], turns)
        who = F.when(F.col("role") == "user", "משתמש").otherwise("מערכת")
        parts.append(block(last, 1, F.lpad(F.col("ord").cast("string"), 12, "0"),
                           F.concat(who, F.lit(": "), X.strip_ws(F.col("body")))))
    if lexicon is not None:
        body = F.coalesce(X.blank_to_null(F.col("answerer_expansion")), X.blank_to_null(F.col("expansion")))
        parts.append(block(lexicon.filter(body.isNotNull()), 2, F.col("term"),
                           F.concat(F.lit('- "'), F.col("term"), F.lit('": '), body)))
    if amendments is not None:
        parts.append(block(amendments, 3, F.concat_ws("|", F.col("sort_date").cast("string"), F.col("amendment_id").cast("string")),
                           amendment_note()))
    if resolutions is not None:
        parts.append(block(resolutions, 4, F.col("escalation_chunk_id"), resolution_note()))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
