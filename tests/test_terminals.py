"""Binding chunks behind the hits: the new rows alone, from documents that are cut once."""

import pytest
from pyspark.sql import functions as F

from docloom.bindings import load_catalog
from docloom.bindings import tables as B
from docloom.bindings.catalog_governance import _hits
from docloom.operators import governance as G

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["appended_terminals", "resolution_chain"])
def test_documents_are_cut_once(spark, name):
    plan = load_catalog()[0][name](spark, FOLDER)._jdf.queryExecution().optimizedPlan().toString()
    assert "posexplode" not in plan  # the cut chunks are read back


def test_appended_rows_are_what_the_hits_get(spark):
    outline, docs = B.outlines(spark, FOLDER), B.docs(spark, FOLDER)
    assert sorted(B.resolutions(spark, FOLDER, outline).collect()) == sorted(B.resolutions(spark, FOLDER).collect())
    hits = _hits(spark, FOLDER, outline).filter("rank <= 3")
    chain = G.resolution_chain(hits, B.resolutions(spark, FOLDER, outline), outline, docs)
    whole = G.append_terminals(hits, chain, outline, docs)
    key = ["question_id", "chunk_id", "rank"]
    new = whole.join(hits.select(*key), key, "left_anti")
    rows = G.appended_terminals(hits, chain, outline, docs)
    assert sorted(map(tuple, rows.select(*key).collect())) == sorted(map(tuple, new.select(*key).collect())) != []
    assert whole.count() == hits.count() + rows.count() and rows.filter(F.col("filename").isNull()).isEmpty()
