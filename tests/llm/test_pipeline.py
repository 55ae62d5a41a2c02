"""The corpus pipeline and the registered queries on small tables."""

import random

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_module
import corpus_pipeline
from docloom.llm.queries import QUERIES
from tests.llm.test_operators import brute_components


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    rng, folder = random.Random(1), tmp_path_factory.mktemp("pipeline")
    word = lambda: "".join(rng.choice("ka lo mi tu re san".split()) for _ in range(3))
    prose = lambda n: " ".join(word() for _ in range(n))
    docs = [(k, prose(60)) for k in range(300)]
    docs = [(k, f"{t} badword badword {prose(3)}" if k % 5 == 0 else t) for k, t in docs]  # 60 toxic
    docs += [(400 + k, f"{prose(30)}\nshared line of them all\n{prose(30)}") for k in range(20)]
    docs += [(500, docs[1][1]), (501, docs[2][1].rsplit(" ", 1)[0] + " other"), (502, None), (503, ""), (None, prose(5))]
    item = prose(40)
    docs += [(600, f"{prose(50)} {item} {prose(20)}")]
    rows = [(i, t, "en", "s", len(t or "")) for i, t in docs]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{folder}/documents.parquet")
    labels = [(k, 1, int(k % 5 == 0)) for k in range(300)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, item), (2, prose(30))], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


def ids(frame):
    return {r["doc_id"] for r in frame.select("doc_id").distinct().collect()}


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    every = ids(docs)
    for (name, stage), gone in zip(corpus_pipeline.STAGES[:-1], [set(range(0, 300, 5)), set(), {500, 501}, {600}], strict=True):
        before, docs = docs.count(), spark.createDataFrame(stage(spark, docs, sf_dir).collect(), docs.schema)
        every -= gone
        assert ids(docs) == every, name
        assert docs.count() == before - len(gone)
        if name == "line dedup":
            assert docs.filter(F.col("text").contains("shared line")).count() == 0
            assert docs.filter("n_chars <> length(coalesce(text, ''))").count() == 0
        if name == "MinHash near-dedup":
            left = [(r["doc_id"], r["text"]) for r in docs.collect()]
            assert all(i == c for i, c in brute_components(left).items())
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir)
    assert ids(pieces) == every


def test_stages_keep_clashing_columns(spark, sf_dir):
    names = ["score", "row_key", "n_lines", "n_dropped", "cut", "component_id", "kept", "terms"]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").withColumns({c: F.concat(F.lit(c), F.col("doc_id").cast("string")) for c in names})
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert out.columns == docs.columns, name
        wrong = [F.col(c).eqNullSafe(F.concat(F.lit(c), F.col("doc_id").cast("string"))) for c in names]
        assert out.filter(~(wrong[0] & wrong[1] & wrong[2] & wrong[3] & wrong[4] & wrong[5] & wrong[6] & wrong[7])).count() == 0, name


def test_run(spark, sf_dir):
    kept = corpus_pipeline.run(spark, sf_dir)
    assert not ids(kept) & ({500, 501, 600} | set(range(0, 300, 5))) and {1, 2, 404, 502, 503, None} <= ids(kept)


def test_stages_on_empty_tables(spark, sf_dir, tmp_path):
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{sf_dir}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    for query in QUERIES.values():
        assert query(spark, str(tmp_path)).count() == 0


def test_registered():
    names = set(entry_module.queries())
    assert set(QUERIES) | {"pipeline"} <= names and {int(n[2:].split("_")[0]) for n in QUERIES} == set(range(1, 14))
