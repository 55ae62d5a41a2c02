"""Chunking, tagging, dates, statuses, questions and lexical forms on small inputs."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from docloom import settings as S
from docloom.functions import pieces
from docloom.functions import text as X
from docloom.operators import documents as P
from docloom.operators import lexical as L


def one(spark, expr, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(expr(F.col("x")).alias("y")).first()["y"]


def chunks_of(spark, text, profile="hebrew"):
    df = spark.createDataFrame([(1, "t", text)], "doc_id int, tenant_id string, text string")
    return P.tag_decisions(P.chunk_documents(df, profile)).orderBy("position").collect()


BYLAW = "תקנון לדוגמה\n" + "מבוא ארוך דיו כדי להישמר כקטע נפרד בראש המסמך, לפני הסעיף הראשון של התקנון עצמו.\n" + "\n".join(
    f"סעיף {i}: הוראה מספר {i} שיש בה די מילים להישמר כקטע" for i in (1, 2, 3))


def test_sections_and_preamble(spark):
    rows = chunks_of(spark, BYLAW)
    assert [r.section_path for r in rows] == [None, "סעיף 1", "סעיף 2", "סעיף 3"]
    assert [r.position for r in rows] == [0, 1, 2, 3]
    assert [r.section_ref for r in rows] == [None, "1", "2", "3"]


def test_protocol_has_both_decision_kinds(spark):
    rows = chunks_of(spark, "פרוטוקול\nנוכחים: רבים וטובים\nהוחלט: לאשר את התקציב לשנה הבאה\nהוחלט להעביר את הנושא להצבעה בקלפי בהקדם")
    assert {r.decision_type for r in rows} >= {"terminal", "escalation"}


def test_no_markers_packs_paragraphs(spark):
    rows = chunks_of(spark, "פסקה ראשונה\n\nפסקה שנייה")
    assert [(r.section_path, r.text) for r in rows] == [(None, "פסקה ראשונה\n\nפסקה שנייה")]


def test_short_packs_leave_position_gaps(spark):
    text = "א" * 1490 + "\n\n" + "ב" * 20 + "\n\n" + "ג" * 1495
    assert [r.position for r in chunks_of(spark, text)] == [0, 2]


def test_empty_text_has_no_chunks(spark):
    assert chunks_of(spark, "  \n ") == []


def test_long_section_is_split_under_its_label(spark):
    rows = chunks_of(spark, "סעיף 1: " + "\n\n".join("מילה " * 60 for _ in range(20)))
    assert len(rows) > 1 and {r.section_path for r in rows} == {"סעיף 1"} and max(len(r.text) for r in rows) <= 3600


def test_one_paragraph_is_never_cut(spark):
    assert [len(r.text) for r in chunks_of(spark, "x" * 9000)] == [9000]


@pytest.mark.parametrize("text,kind", [
    ("הוחלט: לאשר", "terminal"), ("הוחלט להעביר לאסיפה", "escalation"), ("הוחלט להעביר את כל הנושא הזה להצבעה בקלפי", "escalation"),
    ("שמות החברים נקראו והוחלט להעביר את שלושת המקרים להצבעה בקלפי", "escalation"), ("חבר רשאי להביא את ערעורו בפני האסיפה", None),
    ("הוחלט: לאשר\n\nהוחלט להעביר לאסיפה", "terminal"), ("הוחלט: לאשר\nהחלטה להעביר לקלפי", "terminal"), ("  הוחלט\nלהעביר לקלפי", "escalation")])
def test_decision_type(spark, text, kind):
    assert one(spark, X.decision_type, text) == kind


@pytest.mark.parametrize("path,ref", [("סעיף 44", "44"), ("45.ב", "45.ב"), ("סעיף 12.3", "12.3"), ("פרק א", None), ("החלטה 5", None), (None, None), ("", None)])
def test_section_ref(spark, path, ref):
    assert one(spark, X.section_ref, path) == ref


@pytest.mark.parametrize("title,path,out", [("a.pdf", "סעיף 1", "a.pdf — סעיף 1\n\nt"), ("a.pdf", None, "a.pdf\n\nt"), (None, "s", "s\n\nt"), (None, None, "t"), ("", "", "t")])
def test_embedding_input(spark, title, path, out):
    df = spark.createDataFrame([("t", path, title)], "text string, section_path string, filename string")
    assert P.with_embedding_input(df).first()["embedding_input"] == out


@pytest.mark.parametrize("name,date", [("x 15.08.14.docx", dt.date(2014, 8, 15)), ("2019-3-7 x", dt.date(2019, 3, 7)), ("1.2.85", dt.date(1985, 2, 1)),
                                       ("32.13.24", None), ("2020-02-30 and 1.1.21", dt.date(2021, 1, 1)), ("plain", None), ("5.6.1999.pdf", dt.date(1999, 6, 5))])
def test_filename_date(spark, name, date):
    assert one(spark, X.filename_date, name) == date


@pytest.mark.parametrize("name,status", [("הצעה לסדר", "proposal"), ("מסמך טיוטה", "draft"), ("סיכום דיון", "discussion"), ('דו"ח שנתי', "background"), ("זימון", "invitation"), ("תקנון", None), (None, None)])
def test_filename_status(spark, name, status):
    assert one(spark, X.filename_status, name) == status


@pytest.mark.parametrize("q,kind", [("מה כתוב בסעיף 4", "rules"), ("תסכם לי את סעיף 4", "rules"), ("כמה מסמכים יש", "meta"), ("על מה דנו אתמול", "summary"), ("", "rules"), (None, "rules")])
def test_intent(spark, q, kind):
    assert one(spark, X.intent, q) == kind


@pytest.mark.parametrize("q,years", [("בין 2015 ל-2010", (2010, 2015)), ("ב2014", (2014, 2014)), ("2012 ואז 2009", (2009, 2012)), ("2010 עד 2013 ולא 1999", (2010, 2013)), ("12014", (None, None))])
def test_years(spark, q, years):
    row = spark.createDataFrame([(q,)], "q string").select(*X.year_bounds(F.col("q"))).first()
    assert tuple(row) == years


def test_triage_shortcut(spark):
    df = spark.createDataFrame([("מה הם תנאי הקבלה לחברות בקיבוץ שלנו", False, False), ("אחת שתיים שלוש ארבע חמש שש", False, False), ("אחת שתיים שלוש ארבע חמש שש", True, False),
                                ("אחת שתיים שלוש ארבע חמש שש", False, True), ("קצר מדי", False, False), ("אבל אחת שתיים שלוש ארבע חמש", False, False)], "question string, p boolean, t boolean")
    assert [r.skip_triage for r in P.annotate_questions(df, "p", "t").collect()] == [False, True, False, False, False, False]


def matches(spark, query, indexed):
    q = spark.createDataFrame([("t", 1, query)], "tenant_id string, question_id int, question string")
    c = spark.createDataFrame([("t", "c", indexed)], "tenant_id string, chunk_id string, text string")
    return L.lexical_search(q, L.build_postings(c), L.index_stats(c), 5).count() == 1


@pytest.mark.parametrize("query,indexed,hit", [
    ("ירושה", "דין ירושה", True), ("מה דין הירושה", "דין ירושה", True), ("ירושה", "בעניין הירושה נקבע", True), ("ירושת הבית", "ירושות של בתים והבית", True),
    ("פנסיה", "דין ירושה", False), ('יו"ר', "היו״ר אמר", True), ("חבר חבר", "חבר", True), ("ירושה פנסיה", "ירושה", False)])
def test_lexical_matching(spark, query, indexed, hit):
    assert matches(spark, query, indexed) is hit


def test_stop_words_only_ask_nothing(spark):
    q = spark.createDataFrame([("t", 1, "מה זה של the")], "tenant_id string, question_id int, question string")
    assert L.query_forms(q).count() == 0


def plain_forms(token):
    """The form rules in plain Python: greedy prefix by length, first listed suffix."""
    if not any("֐" <= c <= "׿" for c in token):
        return {token.lower()}
    base = token.translate(str.maketrans(S.FINAL_LETTERS, S.MEDIAL_LETTERS))

    def prefix(t):
        return next((t[len(p):] for group in (S.PREFIXES_3, S.PREFIXES_2, S.PREFIXES_1) for p in group if t.startswith(p) and len(t) - len(p) >= S.MIN_STEM), None)

    def suffix(t):
        return next((t[:-len(s)] for s in S.SUFFIXES if t.endswith(s) and len(t) - len(s) >= S.MIN_STEM), None)
    pre = prefix(base)
    return {f for f in (base, pre, suffix(base), suffix(pre) if pre else None) if f and len(f) >= 2}


def test_forms_equal_plain_rules(spark):
    import random
    rng = random.Random(5)
    heads, tails = S.PREFIXES_3 + S.PREFIXES_2 + S.PREFIXES_1 + [""], S.SUFFIXES + ["ים", "ך", ""]
    words = ["".join([rng.choice(heads), "".join(rng.choice("אבגדסקר") for _ in range(rng.randint(1, 5))), rng.choice(tails)]) for _ in range(600)] + ["ABc", "x", "ד"]
    df = spark.createDataFrame([(w,) for w in words], "tok string")
    got = X.explode_forms(df.withColumn("w", F.col("tok")), "tok").collect()
    assert {r.w: set(r._forms) for r in got} == {w: plain_forms(w) for w in words}


def test_title_lane_reads_file_names(spark):
    d = spark.createDataFrame([("t", "1", "ענף_הסיידר,סיכום-2020.docx"), ("t", "2", "אחר.pdf")], "tenant_id string, doc_id string, filename string")
    q = spark.createDataFrame([("t", 1, "סיידר")], "tenant_id string, question_id int, question string")
    assert [r.doc_id for r in L.title_search(q, d).collect()] == ["1"]


def test_mirrored_text_is_repaired(spark):
    good = "\n".join("הנוסח של התקנון על כל סעיף 12.3 את כי לא אם pdf" for _ in range(10))
    # visual order: letters mirrored, Latin and digit runs readable
    bad = "\n".join(line[::-1].replace("3.21", "12.3").replace("fdp", "pdf") for line in good.split("\n"))
    df = spark.createDataFrame([("a", good), ("b", bad)], "chunk_id string, text string")
    rows = P.repair_rtl(df).collect()
    assert [(r.chunk_id, r.fixed_text) for r in rows] == [("b", good)]


def test_surface_forms(spark):
    forms = one(spark, P.surface_forms, " שיוך ")
    assert forms[0] == "שיוך" and "השיוך" in forms and "לכשיוך" not in forms and "שיוכים" in forms and len(forms) == len(set(forms)) == 48
    assert one(spark, P.surface_forms, "בית ילדים")[-1] == "ומבית ילדים"


def test_folded_hash_ignores_format():
    assert pieces.folded_hash("Ab, ć 1") == pieces.folded_hash("aB c1") and pieces.folded_hash(" .,") is None
