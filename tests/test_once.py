"""Work that must be done once a row, or handed on in parts."""

import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from docloom.operators import documents as P
from docloom.operators import lexicon as V
from docloom.operators import vector


def test_texts_are_repaired_once(spark):
    text = "נמ לש תא לע אל יכ " * 12 + "12 abc, של ... (x)"
    df = spark.createDataFrame([(1, text), (2, "plain"), (3, None)], "doc_id int, text string")
    out = P.repair_rtl(df)
    assert out._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all") == 1
    assert [r.doc_id for r in out.collect()] == [1]


@pytest.mark.parametrize("repeat", [False, True])
def test_quoted_phrases_are_counted_without_their_ids(spark, repeat):
    rows = [(k, f'"alpha beta" «gamma{k % 2}» "alpha beta" ' if k % 7 else None) for k in range(20)]
    rows += [(1, '"alpha beta"'), (None, "«gamma1»"), (None, "«gamma1»")] if repeat else []
    queries = spark.createDataFrame(rows, "query_id int, answer string").selectExpr("'o' AS tenant_id", "query_id", "answer", "timestamp'2024-01-02' AS created_at")
    lexicon = spark.createDataFrame([("o", "x", "x", ["x"])], "tenant_id string, lexicon_id string, term string, surface_forms array<string>")
    out = V.mine_quoted(queries, lexicon, F.lit("2024-01-01").cast("timestamp"))
    want: dict = {}
    for k, answer in rows:
        for phrase in ("alpha beta", "gamma0", "gamma1"):
            if answer and phrase in answer and k is not None:
                want.setdefault(phrase, set()).add(k)
    assert {r.candidate: (r.distinct_queries, r.sample_query_id) for r in out.collect()} == {p: (len(ids), min(ids)) for p, ids in want.items() if len(ids) >= 3}
    if not repeat:
        assert "count(distinct" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_kept_neighbours_are_handed_on_in_parts():
    best = {(f"q{i}", i % 3): [np.arange(30) + i, np.full(30, 0.5), np.array(["minutes", None] * 15, dtype=object)] for i in range(20_000)}
    want = [(q, b, int(x)) for (q, b), (ids, _, _) in best.items() for x in ids[:2]]
    tracemalloc.start()
    got, n = [], 0
    for frame in vector._frames(best, ["doc_type"]):
        n += len(frame)
        got += [(r.question_id, r.bucket, r.item_id) for r in frame.iloc[np.arange(len(frame)) % 30 < 2].itertuples()]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == 600_000 and got == want and not best
    assert peak < 40e6, peak
    assert list(vector._rows({}, ["doc_type"]).columns) == ["question_id", "item_id", "bucket", "dist", "doc_type"]


def test_embedder_equals_plain_counts():
    texts = ["one two two", "", "!!", "א ב Two 2", None, "x " * 500]
    got = vector.hashed_words(16)(texts)
    for row, text in zip(got, texts):
        plain = np.zeros(16)
        for w in vector._TOKEN.findall(text or ""):
            plain[vector._slot(w.lower(), 16)] += 1
        assert (row == (plain / np.linalg.norm(plain) if plain.any() else plain)).all()
