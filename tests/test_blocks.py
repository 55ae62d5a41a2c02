"""Search over posting blocks: the rows of the full boolean search, with fewer blocks read."""

import random

import pytest
from pyspark.sql import functions as F

from docloom.operators import blocks as K
from docloom.operators import lexical as L


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(4)
    words = [f"word{k}" for k in range(60)]
    texts = [" ".join(rng.choices(words, [1 / (k + 1) for k in range(60)], k=rng.choice([3, 8, 20, 60, 200]))) for _ in range(1500)]
    texts += [texts[3]] * 400 + ["", "word1 word2 word50"]  # copies of one text, all of one length
    rows = [(k, f"t{k % 2}", t) for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, "chunk_id long, tenant_id string, text string")


@pytest.fixture(scope="module")
def questions(spark):
    asked = ["word0", "word1 word2", "word0 word3 word9", "word40 word41", "word50 word1", "word2 word2 nothing", "", "word59"]
    return spark.createDataFrame([(100 * t + k, f"t{t}", q, 3) for t in range(2) for k, q in enumerate(asked)],
                                 "question_id long, tenant_id string, question string, lim int")


@pytest.mark.parametrize("size,k", [(32, 5), (128, 20), (5000, 3)])
def test_same_rows_as_full_search(spark, corpus, questions, size, k):
    postings, stats = L.build_postings(corpus), L.index_stats(corpus)
    index = K.build_blocks(postings, stats, size=size)
    want = sorted(map(tuple, L.lexical_search(questions, postings, stats, k).collect()))
    assert sorted(map(tuple, K.block_search(questions, index, k).collect())) == want and want
    if size == 32:
        asked = L.query_forms(questions).select("tenant_id", F.col("form").alias("lexeme")).distinct()
        assert sum(index.read) < 0.8 * index.blocks.join(asked, ["tenant_id", "lexeme"]).count()
        assert index.blocks.agg(F.max("n")).first()[0] <= 3 * size


def test_allowed_and_limits(spark, corpus, questions):
    postings, stats = L.build_postings(corpus), L.index_stats(corpus)
    allowed = corpus.filter("chunk_id % 3 = 1").select("chunk_id")
    index = K.build_blocks(postings, stats, size=64)
    want = L.lexical_search(questions, postings, stats, 6, allowed=allowed, limit_col="lim").select("question_id", "chunk_id", "score", "rank")
    got = K.block_search(questions, index, 6, allowed=allowed, limit_col="lim")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_empty(spark, corpus, questions):
    nothing = corpus.limit(0)
    assert K.block_search(questions, K.build_index(nothing, L.build_postings(nothing)), 4).count() == 0
    assert K.block_search(questions.limit(0), K.build_index(corpus, L.build_postings(corpus)), 4).count() == 0


def test_no_shuffle_of_the_blocks(spark, corpus, questions):
    """Heads and opened blocks are read by broadcast: no exchange stands above a scan that reads lists."""
    index = K.build_index(corpus, L.build_postings(corpus))
    keys = spark.createDataFrame([("t0", "word1", 0)], "tenant_id string, lexeme string, segment long")
    plan = index.blocks.join(F.broadcast(keys), ["tenant_id", "lexeme", "segment"])._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_blocks_of_texts_equal_blocks_of_postings(spark, corpus):
    """Blocks built from whole texts hold the postings, bounds included; words of rows that share an id are added up."""
    more = [(3, "t1", "word5 word5 word7"), (3, "t1", "word5 word8 word9"), (9_000, "t0", "word1 " * 700), (9_001, "t1", "...")]
    rows = corpus.unionByName(spark.createDataFrame(more, corpus.schema))
    stats = L.index_stats(rows)
    found, want = K.build_index(rows, size=32), K.build_blocks(L.build_postings(rows), stats, size=32)

    def postings(index):
        at = F.explode(F.arrays_zip("ids", "tfs", "lengths")).alias("_p")
        return sorted(map(tuple, index.blocks.select("tenant_id", "lexeme", at).select("tenant_id", "lexeme", "_p.*").collect()))

    assert postings(found) == postings(want)
    assert ("t1", "word5", 3, 3, 3) in postings(found)
    assert sorted(map(tuple, found.stats.collect())) == sorted(map(tuple, stats.collect()))
    best = lambda index: sorted((r[0], r[1], round(r[2], 12)) for r in index.blocks.groupBy("tenant_id", "lexeme").agg(F.max("best")).collect())
    assert best(found) == best(want)
    assert found.blocks.groupBy("tenant_id", "lexeme", "segment").count().filter("count > 1").isEmpty()
