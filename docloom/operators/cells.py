"""A stored coarse clustering of unit vectors, and exact nearest neighbours that skip its cells (V1, V3, V5, H1, H2).

Cells are the Voronoi cells of unit centroids. With ``radius`` the largest angle between a cell's centroid and its members, no member is nearer to a
question than ``angle(question, centroid) - radius``. A question visits the cells with the least bounds, and then those whose
bound is within the k-th angle it found there. What is visited is exact, so the rows equal a full search; how much is skipped depends on the vectors: clustered ones leave most cells unvisited, directions without structure in many dimensions leave none.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.operators.scale import top_n
from docloom.session import store_table

#: Most cells, sample rows for each cell that the centroids are fitted on, and passes over that sample.
MOST_CELLS, SAMPLE_PER_CELL, PASSES = 4096, 64, 8
#: Bytes of the sample on the driver, whatever the number of cells, and vectors that meet all centroids at once.
SAMPLE_BYTES, TILE = 16 << 20, 1024
GROWTH = 4
#: One item of so many gives the last limits, where that share is this many items at least.
SHARE, SHARED_FROM = 16, 1 << 16
_SLACK = 1e-6  # radians, far above rounding of distances to nine digits


@dataclass(frozen=True)
class Cells:
    """Unit centroids with the angle to their farthest member (-1: no member). ``products`` collects the vector products of each search round."""

    centroids: np.ndarray
    radii: np.ndarray
    products: list[int] = field(default_factory=list)

    def bounds(self, vectors: np.ndarray) -> np.ndarray:
        """Least angle between each vector and the members of each cell; infinite for empty cells."""
        angle = np.arccos(np.clip(_unit(vectors) @ self.centroids.T, -1, 1))
        return np.where(self.radii >= 0, np.maximum(angle - self.radii - _SLACK, 0), np.inf)

    def allowed(self, units: np.ndarray, limits: np.ndarray, cell: int) -> np.ndarray:
        """Which of the unit vectors may have members of the cell within their limit, a distance rounded to nine digits."""
        reach = np.arccos(np.clip(1 - np.minimum(limits, 2) - 1e-9, -1, 1)) + self.radii[cell] + _SLACK
        return (self.radii[cell] >= 0) & (units @ self.centroids[cell] >= np.cos(np.minimum(reach, math.pi)) - 1e-12)


def _unit(vectors: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(vectors, axis=1, keepdims=True)
    return vectors / np.where(norm > 0, norm, 1)


def _matrix(lists: pa.Array) -> np.ndarray:
    return np.stack([v.values.to_numpy(zero_copy_only=False) for v in lists]).astype(np.float64)


def fit_cells(items: DataFrame, n_cells: int | None = None, passes: int = PASSES) -> Cells:
    """Centroids from a bounded sample of the items: about ``SAMPLE_PER_CELL`` distinct vectors a cell and ``SAMPLE_BYTES`` at most, those with the
    smallest hash; by default as many cells as the square root of the number of items. The executors pick the rows by a bound on the hash, so
    nothing but the sample reaches the driver. Radii are still unknown, see ``measure``."""
    known = items.filter("embedding is not null")
    rows, dims = known.agg(F.count("*"), F.max(F.size("embedding"))).first()
    if n_cells is None:
        n_cells = min(MOST_CELLS, max(1, math.isqrt(rows)))
    most = max(1, min(n_cells * SAMPLE_PER_CELL, SAMPLE_BYTES // (8 * max(1, dims or 1))))
    drawn = known.select("embedding")
    if rows > most:
        drawn = drawn.filter(F.xxhash64("embedding") < -(1 << 63) + (most << 64) // rows).distinct().limit(most)
    drawn = drawn.toArrow()
    if not drawn.num_rows:
        return Cells(np.zeros((0, 0)), np.zeros(0))
    points = _matrix(drawn.column(0))
    points = _unit(points[np.linalg.norm(points, axis=1) > 0])
    distinct = np.unique(points, axis=0)
    if not len(distinct):
        return Cells(np.zeros((0, 0)), np.zeros(0))
    centroids = distinct[np.random.default_rng(17).permutation(len(distinct))[:n_cells]]
    for _ in range(passes):
        own = np.concatenate([np.argmax(points[k : k + TILE] @ centroids.T, axis=1) for k in range(0, len(points), TILE)])
        sums = np.zeros_like(centroids)
        np.add.at(sums, own, points)
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        centroids = np.where(norm > 1e-9, sums / np.where(norm > 1e-9, norm, 1), centroids)
    return Cells(centroids, np.full(len(centroids), -1.0))


def assign(items: DataFrame, cells: Cells) -> DataFrame:
    """``items`` with the ``cell`` of each vector and its ``cell_angle`` to the centroid; NULL for missing and zero vectors."""
    shared = items.sparkSession.sparkContext.broadcast(cells.centroids)

    def place(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            cell, angle = np.full(len(batch), -1), np.zeros(len(batch))
            full = [k for k, v in enumerate(batch) if v.is_valid and len(v)]
            for some in (full[low:low + TILE] for low in range(0, len(full) if len(shared.value) else 0, TILE)):
                vectors = _matrix(batch.take(pa.array(some)))
                dot = _unit(vectors) @ shared.value.T
                at = np.array(some)[np.linalg.norm(vectors, axis=1) > 0]
                dot = dot[np.linalg.norm(vectors, axis=1) > 0]
                cell[at] = dot.argmax(1)
                angle[at] = np.arccos(np.clip(dot.max(1), -1, 1))
            none = pa.array(cell < 0)
            yield pa.StructArray.from_arrays([pa.array(cell, pa.int32(), mask=none.to_numpy(zero_copy_only=False)),
                                              pa.array(angle, mask=none.to_numpy(zero_copy_only=False))], ["cell", "cell_angle"])

    out = items.withColumn("_c", F.arrow_udf(place, "cell int, cell_angle double")(F.col("embedding")))
    return out.withColumns({"cell": F.col("_c.cell"), "cell_angle": F.col("_c.cell_angle")}).drop("_c")


def measure(members: DataFrame, cells: Cells) -> Cells:
    """``cells`` with the radii that their stored members need: one row a cell comes back."""
    radii = np.full(len(cells.centroids), -1.0)
    for r in members.filter("cell is not null").groupBy("cell").agg(F.max("cell_angle").alias("radius")).collect():
        radii[r["cell"]] = r["radius"]
    return replace(cells, radii=radii, products=[])


def build_cells(items: DataFrame, n_cells: int | None = None) -> tuple[DataFrame, Cells]:
    """(members, cells): the items with their cells, written to the shared folder in order of cells, and the measured clustering."""
    cells = fit_cells(items, n_cells)
    members = store_table(assign(items, cells).sortWithinPartitions("cell"), "members")
    return members, measure(members, cells)


def save_cells(cells: Cells, spark: SparkSession, path: str) -> None:
    rows = pd.DataFrame({"cell": range(len(cells.radii)), "centroid": cells.centroids.tolist(), "radius": cells.radii})
    spark.createDataFrame(rows, "cell int, centroid array<double>, radius double").write.mode("overwrite").parquet(path)


def load_cells(spark: SparkSession, path: str) -> Cells:
    rows = sorted(tuple(r) for r in spark.read.parquet(path).collect())  # at most MOST_CELLS
    return Cells(np.array([r[1] for r in rows]), np.array([r[2] for r in rows]))


def _nearest_cells(cells: Cells, width: int):
    """Each question once for each of its ``width`` nearest cells."""
    def plan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(k, TILE) for b in batches for k in range(0, b.num_rows, TILE)):
            bounds = cells.bounds(_matrix(batch.column("embedding")))
            order = np.argsort(bounds, axis=1, kind="stable")[:, :width]
            rows, at = np.nonzero(np.isfinite(np.take_along_axis(bounds, order, 1)))
            yield pa.RecordBatch.from_arrays([*batch.take(pa.array(rows, pa.int64())).columns, pa.array(order[rows, at], pa.int32())],
                                             [*batch.schema.names, "cell"])
    return plan


def _open(cells: Cells):
    """(scope, cell, n): how many questions of a batch may look into a cell at their limit."""
    def plan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(k, TILE) for b in batches for k in range(0, b.num_rows, TILE)):
            vectors, limits = _unit(_matrix(batch.column("embedding"))), batch.column("limit").to_numpy(zero_copy_only=False)
            scopes = batch.column("scope").dictionary_encode()
            some = np.unique(scopes.indices.to_numpy(zero_copy_only=False))
            open_to = np.stack([cells.allowed(vectors, limits, c) for c in range(len(cells.radii))], axis=1)
            n = np.stack([open_to[scopes.indices.to_numpy(zero_copy_only=False) == s].sum(axis=0) for s in some])
            at, cell = np.nonzero(n)
            yield pa.RecordBatch.from_arrays([scopes.dictionary.take(pa.array(some[at])), pa.array(cell, pa.int32()), pa.array(n[at, cell], pa.int64())],
                                             ["scope", "cell", "n"])
    return plan


def search(questions: DataFrame, items: DataFrame, cells: Cells, k: int, visit) -> DataFrame:
    """Exact k nearest of each (question, bucket), found in two or three rounds.

    ``questions``(scope, question_id, low, high, owner, embedding) and ``items``(scope, item_id, bucket, owner, embedding, ..., cell) are the normalised
    sides of ``vector.nearest``; ``visit`` compares two sides that share scopes and gives their partial rows. First the questions go to the few cells
    nearest to them, whose rows bound the k-th distance of each; of many items, a share tightens these bounds. Then slices of questions meet slices of whole cells: a question is sent once for each
    slice of items and not for each cell, and looks only into cells whose bound is within its limit.
    """
    q = store_table(questions, "cell-questions")
    v = items.filter("cell is not null")
    del cells.products[:]
    if not len(cells.centroids):
        return visit(q.limit(0), v.drop("cell"))
    scoped = F.concat_ws("/", F.col("cell").cast("string"), "scope")
    sizes = store_table(v.groupBy("scope", "cell").agg(F.count("*").alias("n_items")), "cell-sizes")
    n_items, n_cells = sizes.agg(F.sum("n_items"), F.count("*")).first()
    width = 1
    while n_items and width * n_items < 2 * k * n_cells and width < len(cells.centroids):
        width *= GROWTH
    kinds = T.StructType([*q.schema.fields, T.StructField("cell", T.IntegerType())])
    asked = store_table(q.mapInArrow(_nearest_cells(cells, width), kinds), "cell-round")
    cells.products.append(asked.join(sizes, ["scope", "cell"]).agg(F.sum("n_items")).first()[0] or 0)
    found = visit(asked.withColumn("scope", scoped).drop("cell"), v.withColumn("scope", scoped).drop("cell"))
    buckets = F.col("high").cast("long") - F.col("low") + 1
    # each task starts from these limits, so that for many items a share of them comes first
    for share in (SHARE, 1) if n_items > SHARE * SHARED_FROM else (1,):
        found = top_n(found, ["question_id", "bucket"], [F.col("dist"), F.col("item_id")], k, "rank")
        full = found.filter(F.col("rank") == k).groupBy("question_id").agg(F.count("*").alias("n_full"), F.max("dist").alias("worst"))
        limited = q.join(full, "question_id", "left").withColumn("limit", F.when(F.col("n_full") >= buckets, F.col("worst")).otherwise(F.lit(math.inf)))
        limited = store_table(limited.drop("n_full", "worst"), "cell-limits")
        opened = limited.select("scope", "embedding", "limit").mapInArrow(_open(cells), "scope string, cell int, n long")
        cells.products.append((opened.join(sizes, ["scope", "cell"]).agg(F.sum(F.col("n") * F.col("n_items"))).first()[0] or 0) // share)
        found = visit(limited, v if share == 1 else v.filter(F.pmod(F.xxhash64("item_id"), F.lit(share)) == 0), cells)
    return found
