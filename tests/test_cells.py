"""Nearest neighbours over cells: equal to a full search, with few products where vectors are clustered."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from docloom.operators import cells as C
from docloom.operators import vector as V


def table(spark, vectors, scopes=1, name="chunk_id"):
    rows = [(k, f"t{k % scopes}", k % 5, k // 3, None if v is None else [float(x) for x in v]) for k, v in enumerate(vectors)]
    return spark.createDataFrame(rows, f"{name} long, tenant_id string, year int, doc_id long, embedding array<double>")


def same(a, b, columns=("question_id", "chunk_id", "bucket", "dist", "rank")):
    got, want = (sorted(map(tuple, x.select(*columns).collect())) for x in (a, b))
    assert got == want
    return len(got)


@pytest.fixture(scope="module")
def clustered():
    rng = np.random.default_rng(5)
    centres = rng.standard_normal((40, 24))
    vectors = [centres[k % 40] + 0.15 * rng.standard_normal(24) for k in range(4000)]
    return vectors + [vectors[7]] * 30 + [np.zeros(24), None]


def test_few_products_on_clusters(spark, clustered):
    items = table(spark, clustered)
    members, cells = C.build_cells(items)
    asked = items.filter("chunk_id % 20 = 0").withColumnRenamed("chunk_id", "question_id")
    n = same(V.nearest(asked, members, 5, cells=cells), V.nearest(asked, items, 5))
    asked_n, items_n = asked.filter("embedding is not null").count(), items.count()
    assert n == 5 * asked_n
    assert sum(cells.products) < 0.2 * asked_n * items_n


def test_scopes_owners_buckets(spark, clustered):
    items = table(spark, clustered[:600] + clustered[-4:], scopes=3)
    members, cells = C.build_cells(items, 12)
    asked = items.filter("chunk_id % 7 = 0").withColumnRenamed("chunk_id", "question_id")
    options = dict(bucket=F.col("year"), low=F.lit(1), high=F.lit(3), question_owner="doc_id", item_owner="doc_id")
    same(V.nearest(asked, members, 3, cells=cells, **options), V.nearest(asked, items, 3, **options))
    assert V.vector_search(asked, members.withColumn("doc_type", F.lit("minutes")), cells=cells).count() > 0


def test_directions_without_structure(spark):
    rng = np.random.default_rng(6)
    items = table(spark, rng.standard_normal((500, 16)))
    members, cells = C.build_cells(items)
    asked = items.limit(60).withColumnRenamed("chunk_id", "question_id")
    same(V.nearest(asked, members, 4, cells=cells), V.nearest(asked, items, 4))


def test_small_and_empty(spark, tmp_path):
    few = table(spark, [np.ones(4), np.ones(4), None, np.zeros(4)])
    members, cells = C.build_cells(few)
    C.save_cells(cells, spark, f"{tmp_path}/cells")
    again = C.load_cells(spark, f"{tmp_path}/cells")
    asked = few.withColumnRenamed("chunk_id", "question_id")
    assert same(V.nearest(asked, members, 9, cells=again), V.nearest(asked, few, 9)) == 4
    nothing = few.limit(0)
    members, cells = C.build_cells(nothing)
    assert V.nearest(asked, members, 2, cells=cells).count() == 0


def test_bounds_hold(clustered):
    points = np.stack(clustered[:800])
    points /= np.linalg.norm(points, axis=1, keepdims=True)
    centroids = points[:20]
    own = (points @ centroids.T).argmax(1)
    radii = np.array([np.arccos(np.clip(points[own == c] @ centroids[c], -1, 1)).max(initial=-1) for c in range(20)])
    bounds = C.Cells(centroids, radii).bounds(points[:100])
    angles = np.arccos(np.clip(points[:100] @ points.T, -1, 1))
    for c in range(20):
        assert (bounds[:, c] <= angles[:, own == c].min(1) + 1e-9).all()


def test_sample_of_the_fit_is_bounded(spark, monkeypatch):
    """Whatever the number of cells, the driver gets SAMPLE_BYTES of vectors at most, picked without an ordered limit."""
    asked = []
    fetch = type(spark.range(1)).toArrow
    monkeypatch.setattr(type(spark.range(1)), "toArrow", lambda df: asked.append((df._jdf.queryExecution().executedPlan().toString(), fetch(df))) or asked[-1][1])
    monkeypatch.setattr(C, "SAMPLE_BYTES", 300 * 8 * 4)
    rng = np.random.default_rng(3)
    rows = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(rng.standard_normal((3000, 4)))], "item_id long, embedding array<double>")
    cells = C.fit_cells(rows, 40)
    assert len(cells.centroids) == 40 and len(asked) == 1
    assert 150 < asked[0][1].num_rows <= 300 and "TakeOrdered" not in asked[0][0]


def test_only_items_within_the_kth_distance_are_looked_at_singly(monkeypatch):
    """Batches after the first hand on few items of each question, and the rows are those of a full sort; ties go to the smallest id."""
    rng = np.random.default_rng(4)
    vectors = rng.integers(-1, 2, (4000, 16)).astype(float)  # many equal distances
    vectors[::50] = 0
    questions = pd.DataFrame({"question_id": np.arange(20), "low": 0, "high": 0, "owner": [None, "1"] * 10, "embedding": list(vectors[1:21])})
    items = pd.DataFrame({"item_id": np.arange(4000)[::-1], "bucket": 0, "owner": (np.arange(4000) % 9).astype(str), "embedding": list(vectors)})
    seen, pick = [], V._best
    monkeypatch.setattr(V, "_best", lambda d, ids, k: seen.append(len(d)) or pick(d, ids, k))
    block, best = V._Block(questions), {}
    for start in range(0, 4000, 500):
        block.search(items.iloc[start:start + 500], 5, best, [])
    unit = V._unit(list(vectors))
    for r in range(20):
        d = np.round(1 - block.matrix[r] @ unit.T, 9)
        if r % 2:
            d[items["owner"].to_numpy() == "1"] = np.nan
        want = sorted((x, i) for x, i in zip(d, items["item_id"]) if np.isfinite(x))[:5]
        assert list(zip(best[(r, 0)][1], best[(r, 0)][0])) == want
    assert sum(seen) < 20 * 4000 / 3


def test_questions_are_not_sent_once_for_each_cell(spark, monkeypatch):
    """What is stored and sent grows with slices, not with cells: a question goes to its nearest cells and then once to each slice of items."""
    rng = np.random.default_rng(8)
    items = table(spark, rng.standard_normal((3000, 16)), scopes=2)  # without structure every question looks into every cell
    asked = items.filter("chunk_id % 3 = 0").withColumnRenamed("chunk_id", "question_id")
    members, cells = C.build_cells(items, 50)
    stored, keep = {}, C.store_table
    monkeypatch.setattr(C, "store_table", lambda df, name: stored.setdefault(name, []).append(keep(df, name)) or stored[name][-1])
    same(V.nearest(asked, members, 4, cells=cells), V.nearest(asked, items, 4))
    assert sum(cells.products) > 0.9 * 1000 * 1500
    assert sum(t.count() for name, tables in stored.items() if name != "cell-sizes" for t in tables) <= 8 * 1000


def test_slices_and_shares(spark, monkeypatch, clustered):
    """Many slices, a cell in several pieces, and limits from a share of the items: the rows of a full search."""
    monkeypatch.setattr(V, "SLICE_BYTES", 20_000)
    monkeypatch.setattr(C, "SHARED_FROM", 10)
    rng = np.random.default_rng(9)
    for vectors in (clustered[:900] + clustered[-30:], rng.integers(0, 3, (900, 8)).astype(float)):
        items = table(spark, vectors, scopes=2)
        members, cells = C.build_cells(items, 6)
        asked = items.filter("chunk_id % 2 = 0").withColumnRenamed("chunk_id", "question_id")
        options = dict(bucket=F.col("year"), low=F.lit(0), high=F.col("year"), question_owner="doc_id", item_owner="doc_id", carry=("doc_id",))
        want = V.nearest(asked, items, 3, **options)
        same(V.nearest(asked, members, 3, cells=cells, block_bytes=2000, **options), want)
        assert len(cells.products) == 3
        same(V.nearest(asked, items, 3, broadcast_bytes=0, block_bytes=2000, **options), want)


def test_small_blocks_travel_together(spark):
    """Blocks of a few rows don't multiply what is sent: questions and items of a small scope meet once, so no question has rows of several blocks."""
    rng = np.random.default_rng(10)
    items = table(spark, rng.integers(-1, 2, (600, 8)).astype(float), scopes=3).filter("array_max(embedding) > 0 or array_min(embedding) < 0")
    asked = items.withColumnRenamed("chunk_id", "question_id")
    same(V.nearest(asked, items, 5, broadcast_bytes=0, block_bytes=1000), V.nearest(asked, items, 5))
    side = [F.col("tenant_id").alias("scope"), F.lit(None).cast("string").alias("owner"), "embedding"]
    partial = V._by_blocks(asked.select(*side, "question_id", F.lit(0).alias("low"), F.lit(0).alias("high")),
                           items.select(*side, F.col("chunk_id").alias("item_id"), F.lit(0).alias("bucket")), 5, V._OUT.format(q="long", v="long"), 128, 1000, [])
    assert partial.count() == 5 * items.count()


def test_pairs_near_the_kth_distance_are_measured_in_double_precision():
    """Vectors that differ by less than single precision, and equal ones with ties by id."""
    import pyarrow as pa
    rng = np.random.default_rng(11)
    base = rng.standard_normal(12)
    vectors = np.stack([base + 1e-4 * (k % 7) * rng.standard_normal(12) for k in range(300)])
    ids = [f"{k}:{k % 3}" for k in range(300)]
    vs = pa.table({"item_id": ids, "bucket": pa.array([0] * 300, pa.int32()), "owner": [str(k % 5) for k in range(300)], "embedding": vectors.tolist()})
    qs = pa.table({"question_id": list(range(40)), "low": pa.array([0] * 40, pa.int32()), "high": pa.array([0] * 40, pa.int32()),
                   "owner": [None if k % 2 else "1" for k in range(40)], "embedding": vectors[:40].tolist()})
    got = V._meet(qs, vs, 6, []).to_pydict()
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    for r in range(40):
        want = sorted((round(1 - float(unit[r] @ unit[k]), 9), ids[k]) for k in range(300) if r % 2 or k % 5 != 1)[:6]
        assert [(d, i) for q, d, i in zip(got["question_id"], got["dist"], got["item_id"]) if q == r] == want
