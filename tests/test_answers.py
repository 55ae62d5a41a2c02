"""Feedback, citations, merging, learning and streams on small inputs."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from docloom import settings as S
from docloom.operators import answers as H
from docloom.operators import lexicon as V
from docloom.plans.ingest import ingest_batch
from docloom.sources import corpus as C
from docloom.streaming import jobs as T

T0 = dt.datetime(2024, 1, 1)


def replay(queries, answers, events):
    """The feedback rules one event at a time."""
    q = {r[0]: dict(zip(("id", "answer", "confidence", "feedback", "mode", "action", "auth"), r)) for r in queries}
    a = dict(answers)
    for eid, qid, at, act, val in sorted(events, key=lambda e: (e[2], e[0])):
        x = q[qid]
        refusal = x["confidence"] in ("refused", "clarifying")
        if act == "feedback" or act == "mark_broken":
            fb = val if act == "feedback" else "negative"
            x["feedback"] = fb
            if act == "mark_broken":
                x["mode"] = "retrieval_miss"
            if fb == "negative" and a.get(x["auth"]) == "active":
                a[x["auth"]] = "retired"
        elif act == "failure_mode":
            x["mode"] = val
            x["feedback"] = x["feedback"] or "negative"
        elif act == "mark_good":
            x["feedback"] = "positive"
            if not x["auth"] and x["answer"].strip() and not refusal:
                x["auth"], x["action"] = f"auth:{eid}", "approved"
                a[x["auth"]] = "active"
        elif act == "approve":
            if (val or x["answer"]).strip() and (val is not None or not refusal):
                x["auth"], x["action"] = f"auth:{eid}", "edited" if val else "approved"
                a[x["auth"]] = "active"
        elif act in ("reject", "dismiss"):
            x["action"] = "rejected"
            if act == "dismiss":
                x["mode"] = None
    return {i: (x["feedback"], x["mode"], x["action"], x["auth"]) for i, x in q.items()}, a


def test_feedback_equals_replay(spark):
    rng = random.Random(3)
    queries = [(i, rng.choice(["text", " "]), rng.choice(["confident", "refused"]), rng.choice([None, "positive"]), None, None, rng.choice([None, "a1", "a2"])) for i in range(60)]
    answers = [("a1", "active"), ("a2", "retired")]
    acts = [("feedback", "negative"), ("feedback", "positive"), ("failure_mode", "other"), ("mark_good", None), ("mark_broken", None), ("approve", None), ("approve", "edit"), ("reject", None), ("dismiss", None)]
    events = [(n, rng.randrange(60), T0 + dt.timedelta(hours=rng.randrange(200)), *rng.choice(acts)) for n in range(400)]
    q = spark.createDataFrame(queries, "query_id int, answer string, confidence string, feedback string, failure_mode string, reviewer_action string, authoritative_answer_id string").withColumns(
        {"tenant_id": F.lit("t"), "question": F.lit("q"), "source_chunk_ids": F.array(F.lit("c"))})
    a = spark.createDataFrame(answers, "answer_id string, status string")
    e = spark.createDataFrame(events, "event_id int, query_id int, at timestamp, action string, value string")
    out = H.apply_feedback(q, a, e)
    want_q, want_a = replay(queries, answers, events)
    assert {r.query_id: (r.feedback, r.failure_mode, r.reviewer_action, r.authoritative_answer_id) for r in out.queries.collect()} == want_q
    assert {r.answer_id: r.status for r in out.answers.collect()} == want_a


REF = "question_id int, ord int, title string, section_number string, source_type string, excerpt string"
SRC = "question_id int, ord int, document_id string, filename string, has_file boolean"


@pytest.mark.parametrize("title,ok", [("תקנון פנסיה 2019.pdf", True), ("תקנון  פנסיה 2019.pdf", True), ("תקנון פנסיה 2019.docx", True), ("תקנון פנסיה", True), ("משהו אחר לגמרי", False), (" ", False)])
def test_reference_tiers(spark, title, ok):
    refs = spark.createDataFrame([(1, 1, title, "", "bylaw", "")], REF)
    src = spark.createDataFrame([(1, 1, "d", "תקנון פנסיה 2019.pdf", True)], SRC)
    bound, dropped = H.bind_references(refs, src)
    assert [r.title for r in bound.collect()] == (["תקנון פנסיה 2019.pdf"] if ok else [])
    assert dropped.first().dropped == (0 if ok else 1)


def test_reference_ties_and_meta(spark):
    refs = spark.createDataFrame([(1, 1, "x", "", "bylaw", ""), (1, 2, S.META_TITLE, "", " Meta", "")], REF)
    src = spark.createDataFrame([(1, 1, "a", "x.pdf", True), (1, 2, "b", "x.docx", True), (1, 3, "b", "x.docx", True)], SRC)
    rows = sorted(H.bind_references(refs, src)[0].collect(), key=lambda r: r.ord)
    assert [(r.document_id, r.resolved) for r in rows] == [("b", True), (None, False)]


@pytest.mark.parametrize("conf,titles,violation", [
    ("confident", ["a"], None), ("confident", [], "no_references"), ("confident", ["zzz"], "unmatched_titles"), ("confident", ["zzz", "A.PDF"], None), ("confident", [" "], None),
    ("uncertain", [], None), ("refused", [], None), ("clarifying", ["zzz"], None), ("confident", ["META"], None)])
def test_cite_or_refuse(spark, conf, titles, violation):
    a = spark.createDataFrame([(1, "text", conf)], "question_id int, answer string, confidence string")
    r = spark.createDataFrame([(1, S.META_TITLE if t == "META" else t, "meta" if t == "META" else "bylaw") for t in titles], "question_id int, title string, source_type string")
    h = spark.createDataFrame([(1, "a.pdf")], "question_id int, filename string")
    row = H.enforce_citations(a, r, h).first()
    assert row.violation == violation and row.confidence == ("refused" if violation else conf) and (row.answer == S.REFUSAL_TEXT) == bool(violation)


LEX = "tenant_id string, lexicon_id string, term string, surface_forms array<string>, status string"


@pytest.mark.parametrize("entries", [20_000, 0])
def test_longer_terms_win(spark, entries):
    lx = spark.createDataFrame([("t", "1", "בית", ["בית", "הבית"], "active"), ("t", "2", "בית ילדים", ["בית ילדים"], "active"), ("t", "3", "ילד", ["ילדים"], "rejected"), ("t", "4", "יו״ר", None, "active")], LEX)
    tx = spark.createDataFrame([("t", 1, "בית ילדים ליד הבית, ביתן. היו״ר יו״ר"), ("u", 2, "בית")], "tenant_id string, text_id int, text string")
    rows = sorted((r.start, r.surface_form, r.lexicon_id) for r in V.match_terms(tx, lx, broadcast_entries=entries).collect())
    assert [(f, i) for _, f, i in rows] == [("בית ילדים", "2"), ("הבית", "1"), ("יו״ר", "4")]


def test_annotations_prefer_known(spark):
    lx = spark.createDataFrame([("t", "1", "קלפי", ["קלפי"], "active")], LEX)
    tx = spark.createDataFrame([("t", 1, 'אמר "הצבעת קלפי" וגם "מונח חדש" מנכ״ל')], "tenant_id string, text_id int, text string")
    rows = sorted((r.start, r.span, r.kind) for r in V.annotate(tx, lx).collect())
    assert [(s, k) for _, s, k in rows] == [("קלפי", "known"), ("מונח חדש", "candidate"), ("מנכ״ל", "candidate")]


def test_ingest_reasons_and_flags(spark):
    new = spark.createDataFrame([("t", "1", "a.txt", "x" * 300, None, False, T0), ("t", "2", "b.txt", "x" * 300, None, False, T0), ("t", "3", "c.txt", " ", None, False, T0),
                                 ("t", "4", "d.txt", "short", 3, False, T0), ("t", "5", "e.txt", "y" * 300, 1, True, T0), ("t", "6", "f.txt", "X" * 300 + ".", 1, False, T0 + dt.timedelta(1))],
                                "tenant_id string, doc_id string, filename string, text string, pages int, extraction_partial boolean, ingested_at timestamp")
    stored = spark.createDataFrame([], "tenant_id string, doc_id string, content_sha256 string, text_sha256 string, ingested_at timestamp")
    flags = spark.createDataFrame([], "new_doc_id string, existing_doc_id string")
    out = ingest_batch(new, stored, flags, profile="plain")
    assert {(r.doc_id, r.reject_reason) for r in out.rejects.collect()} == {("2", "duplicate"), ("3", "empty"), ("4", "low_density"), ("5", "partial")}
    assert sorted(r.doc_id for r in out.chunks.collect()) == ["1", "6"]
    assert [(r.new_doc_id, r.existing_doc_id) for r in out.flags.collect()] == [("6", "1")]


def test_files_round_trip(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "a.txt").write_text("שלום", encoding="utf-8")
    (tmp_path / "b.md").write_text("x")
    (tmp_path / "c.bin").write_text("no")
    assert sorted((r.filename, r.text) for r in C.read_corpus(spark, str(tmp_path)).collect()) == [("a.txt", "שלום"), ("b.md", "x")]


TURNS = "tenant_id string, conversation_id string, query_id string, turn_index int, confidence string, feedback string, created_at timestamp"


def test_streamed_pairs_equal_batch(spark, tmp_path):
    rng = random.Random(9)
    rows = [("t", f"c{i % 7}", f"{i:04d}", i, rng.choice(["confident", "refused", "uncertain"]), rng.choice([None, None, "negative"]), T0 + dt.timedelta(minutes=i)) for i in range(200)]
    whole = spark.createDataFrame(rows, TURNS)
    src = str(tmp_path / "in")
    for part in (rows[:80], rows[80:150], rows[150:]):
        spark.createDataFrame(part, TURNS).coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(whole.schema).option("maxFilesPerTrigger", 1).parquet(src)
    root = str(tmp_path / "out")
    writer = T.refinement_pairs_stream(stream).writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{root}/cp")
    writer.trigger(availableNow=True).start(f"{root}/o").awaitTermination()
    got = spark.read.parquet(f"{root}/o")
    pairs = lambda df: sorted((r.from_query_id, r.to_query_id) for r in df.collect())
    assert pairs(got) == pairs(V.refinement_pairs(whole, F.lit(T0)))
