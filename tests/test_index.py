"""Postings counted inside their row, and boolean search that verifies candidates only."""

import random

import pytest
from pyspark.sql import functions as F

from docloom.functions import text as X
from docloom.operators import lexical as L

WORDS = ["the", "The", "HEAD", "head", "והבית", "בית", "הבית", "בabc", "abc", "לשכה", "x1", "K", "שלוםָ", "מים", "א", "ספר״ים", "don't"]


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(7)
    texts = [" ".join(rng.choices(WORDS, [1 / (k + 1) for k in range(len(WORDS))], k=rng.randint(0, 12))) for _ in range(300)] + ["", None, "  \n"]
    return spark.createDataFrame([(f"t{k % 2}", k, t) for k, t in enumerate(texts)], "tenant_id string, chunk_id long, text string")


def by_shuffle(rows):
    """One row a token, counted by a shuffle."""
    listed = rows.select("tenant_id", "chunk_id", X.lexical_tokens(F.col("text")).alias("t")).withColumn("n_tokens", F.size("t"))
    forms = X.explode_forms(listed.select("tenant_id", "chunk_id", "n_tokens", F.explode("t").alias("k")), "k")
    forms = forms.select("tenant_id", "chunk_id", "n_tokens", F.explode("_forms").alias("lexeme"))
    return forms.groupBy("tenant_id", "lexeme", "chunk_id", "n_tokens").agg(F.count("*").alias("tf"))


def test_postings_equal_shuffled_counts(spark, rows):
    again = rows.unionByName(rows.filter("chunk_id < 40")).unionByName(spark.createDataFrame([("t0", None, "abc בabc"), ("t0", None, "abc x1")], rows.schema))
    for table in (rows, again):
        got = L.build_postings(table)
        assert got.schema.simpleString() == by_shuffle(table).schema.simpleString()
        assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, by_shuffle(table).collect()), key=repr)


def test_postings_are_not_shuffled(rows):
    assert "Exchange" not in L.build_postings(rows)._jdf.queryExecution().executedPlan().toString()


def test_tokens_are_made_once(rows):
    for df in (L.build_postings(rows), L.index_stats(rows)):
        assert df._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all") == 1


def test_white_space_at_the_ends(spark):
    signs = [chr(c) for c in (*range(0x21), 0x85, 0xA0, 0x1680, 0x180E, *range(0x2000, 0x2010), 0x2028, 0x2029, 0x202F, 0x205F, 0x2060, 0x3000, 0xFEFF)]
    texts = [None, ""] + [s + t + s for s in signs for t in ("", "a", f"a{s}b")]
    old = F.regexp_replace(F.regexp_replace("t", f"^[{X.WS}]+", ""), f"[{X.WS}]+\\z", "")
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert df.filter(~X.strip_ws(F.col("t")).eqNullSafe(old)).count() == 0


def test_routes_of_the_search(spark, rows):
    asked = ["the head abc x1 K", "head", "the head", "בית abc", "the nothing", "", "x1 K the head abc בית"]
    questions = spark.createDataFrame([(10 * t + k, f"t{t}", q) for t in range(2) for k, q in enumerate(asked)], "question_id int, tenant_id string, question string")
    postings, stats = by_shuffle(rows).localCheckpoint(), L.index_stats(rows)
    want = sorted(map(tuple, L.lexical_search(questions, postings, stats, 1000).collect()))
    assert want
    # plain: every word of every question against every posting
    forms = L.query_forms(questions)
    hits = forms.withColumnRenamed("form", "lexeme").join(postings, ["tenant_id", "lexeme"])
    whole = hits.groupBy("question_id", "chunk_id", "n_groups").agg(F.count_distinct("grp").alias("m")).filter("m = n_groups")
    assert {r[:2] for r in want} == {tuple(r) for r in whole.select("question_id", "chunk_id").collect()}
    for options in ({"small_forms": 0}, {"small_texts": 0}, {"small_forms": 0, "small_words": 0, "small_texts": 0}):
        assert sorted(map(tuple, L.lexical_search(questions, postings, stats, 1000, **options).collect())) == want


def test_hybrid_retrieval_stores_no_whole_posting_table(spark, monkeypatch):
    from docloom.bindings import catalog_retrieval as C
    stored = []

    def note(df, name, store=C.store_table):
        stored.append(name)
        return store(df, name)
    monkeypatch.setattr(C, "store_table", note)
    C._retrieved(spark, "/root/testdata/sf0.001")
    assert stored == ["chunks"]
