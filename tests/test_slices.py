"""Rows made by Python are handed on a few at a time."""

import pytest

from docloom.operators import documents as P
from docloom.operators import lexicon as V
from docloom.operators.slices import ROWS_OUT, flat_map


def test_flat_map_keeps_columns_and_drops_rows_without_tuples(spark):
    df = spark.createDataFrame([(k, None if k == 2 else f"t{k}", [k]) for k in range(200)], "id long, text string, more array<long>").coalesce(1)
    out = flat_map(df, ["text"], ["id", "more"], "n int, word string", lambda: lambda t: [(n, t) for n in range(ROWS_OUT // 10)] if t else [])
    rows = out.collect()
    assert out.columns == ["id", "more", "n", "word"] and len(rows) == 199 * (ROWS_OUT // 10)
    assert all(r.more == [r.id] and r.word == f"t{r.id}" for r in rows) and len({(r.id, r.n) for r in rows}) == len(rows)


@pytest.mark.parametrize("entries", [20_000, 0])
def test_matches_and_sections_are_not_lists_of_a_whole_batch(spark, entries):
    texts = spark.createDataFrame([("a", 1, "one two one"), ("b", 2, "one"), (None, 3, "one"), ("a", 4, None)], "tenant_id string, text_id long, text string")
    lexicon = spark.createDataFrame([("a", "x", "one", ["one"], "active")], "tenant_id string, lexicon_id string, term string, surface_forms array<string>, status string")
    found = V.match_terms(texts, lexicon, broadcast_entries=entries)
    assert sorted(map(tuple, found.collect())) == [("a", 1, "x", "one", "one", 0, 3), ("a", 1, "x", "one", "one", 8, 11)]
    cut = P.chunk_documents(texts.withColumnRenamed("text_id", "doc_id"), profile="plain")
    for df in (found, cut):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "MapInArrow" in plan and "ArrowEvalPython" not in plan
