"""Quality by nearest-neighbour voting over latent-semantic vectors.

Terms are hashed byte trigrams and buckets of the text's shape. Document frequencies count all documents; the latent space and the labelled
vectors come from a bounded sample of labelled rows, so what is broadcast has a fixed size. Every document is compared with every labelled
vector, in blocks, and its nearest ones vote with their similarity.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import labelled_sample, one_blas_thread, raw_text, word_hashes

#: At most SAMPLE labelled rows are fitted on: 4096 x (64 + 1) floats are broadcast, about 1 MB.
SAMPLE, DIMS, NEIGHBOURS, SHARPNESS, BLOCK = 4096, 64, 25, 8, 512
GRAMS, SHAPE_WEIGHT = 4096, 0.35
_EDGES = {
    "upper": (0.05, 0.15, 0.4, 0.7), "symbols": (0.03, 0.06, 0.12, 0.25), "digits": (0.005, 0.03, 0.1, 0.3),
    "distinct": (0.2, 0.4, 0.6, 0.8), "again": (0.05, 0.2, 0.5, 0.8), "word": (3.0, 4.5, 6.0, 9.0), "length": (4.0, 5.5, 7.0, 8.5),
}
_WIDTH = 5
TERMS = GRAMS + _WIDTH * len(_EDGES)
_KIND = np.zeros(256, np.uint8)  # 1 lower, 2 upper, 3 digit, 4 blank, 5 symbol; other bytes are 0
_KIND[97:123], _KIND[65:91], _KIND[48:58] = 1, 2, 3
_KIND[[0x20, *range(9, 14)]] = 4
_KIND[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = 5


def shape(text: bytes) -> list[int]:
    """One column for each shape measure: the bucket that the text falls into."""
    data = np.frombuffer(text, np.uint8)
    kinds = np.bincount(_KIND[data], minlength=6) if len(data) else np.zeros(6, int)
    words = word_hashes(text)
    lines = text.split(b"\n")
    pairs = words[:-1] ^ (words[1:] << np.uint64(1))
    letters = max(1, kinds[0] + kinds[1] + kinds[2])
    measures = {
        "upper": kinds[2] / letters, "symbols": kinds[5] / max(1, len(data)), "digits": kinds[3] / max(1, len(data)),
        "distinct": len(np.unique(pairs)) / max(1, len(pairs)), "again": 1 - len(set(lines)) / len(lines),
        "word": letters / max(1, len(words)), "length": float(np.log(1 + len(data))),
    }
    return [GRAMS + _WIDTH * k + int(np.searchsorted(_EDGES[name], measures[name])) for k, name in enumerate(_EDGES)]


def counts(text: bytes) -> np.ndarray:
    """Hashed trigram counts of the text."""
    b = np.frombuffer(text, np.uint8).astype(np.uint32)
    if len(b) < 3:
        return np.zeros(GRAMS, np.int64)
    code = (b[:-2] * np.uint32(0x9E3779B1)) ^ (b[1:-1] * np.uint32(0x85EBCA77)) ^ (b[2:] * np.uint32(0xC2B2AE3D))
    code = (code ^ (code >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
    return np.bincount((code >> np.uint32(20)).astype(np.intp), minlength=GRAMS)


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen, docs = np.zeros(TERMS, np.int64), 0
    for batch in batches:
        for text in batch.column(0):
            text = text.as_py()
            seen[:GRAMS] += counts(text) > 0
            seen[shape(text)] += 1
            docs += 1
    if docs:
        yield pa.RecordBatch.from_arrays([pa.array(range(-1, TERMS), pa.int32()), pa.array([docs, *seen.tolist()], pa.int64())], ["term", "n"])


def weights(docs: DataFrame) -> np.ndarray:
    """Inverse document frequency of every term, over all documents."""
    found = docs.select(raw_text().alias("raw")).mapInArrow(_frequencies, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()
    n = np.zeros(TERMS + 1)
    for row in found:
        n[row["term"] + 1] = row["n"]
    return np.log((1 + n[0]) / (1 + n[1:])) + 0.1


def vectors(texts: list[bytes], idf: np.ndarray) -> np.ndarray:
    """TF-IDF rows of length 1: square roots of counts, shape buckets at a fixed share."""
    rows = np.zeros((len(texts), TERMS), np.float32)
    for k, text in enumerate(texts):
        grams = np.sqrt(counts(text)) * idf[:GRAMS]
        rows[k, :GRAMS] = grams / max(float(np.sqrt(grams @ grams)), 1e-9)
        rows[k, shape(text)] = SHAPE_WEIGHT
    return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-9)


def _unit(rows: np.ndarray) -> np.ndarray:
    return (rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-9)).astype(np.float32)


def fit(docs: DataFrame, labels: DataFrame, column: str = "quality", modulus: int = 5, rest: int = 0, rows: int = SAMPLE) -> dict:
    """Weights, projection and labelled vectors; labels only from rows outside the held-out fold, at most ``rows`` ids, of each the text with the
    smallest hash where several rows share it."""
    idf = weights(docs)
    drawn = labelled_sample(labels, column, modulus, rest, rows)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = vectors(batch.column(0).to_pylist(), idf).astype(np.float16)
            yield pa.RecordBatch.from_arrays([pa.array([x.tobytes() for x in found], pa.binary()), batch.column(1)], ["vector", "label"])

    slim = docs.select("doc_id", raw_text().alias("raw")).join(F.broadcast(drawn), "doc_id")
    once = slim.groupBy("doc_id", "label").agg(F.min_by("raw", F.xxhash64("raw")).alias("raw"))  # one text of an id that repeats
    known = once.select("raw", "label").mapInArrow(encode, "vector binary, label int").collect()  # at most ``rows``
    known = sorted((bytes(r["vector"]), r["label"]) for r in known)
    if not known:
        return {"idf": idf, "basis": np.zeros((TERMS, 1), np.float32), "points": np.zeros((0, 1), np.float32), "labels": np.zeros(0)}
    matrix = np.stack([np.frombuffer(v, np.float16) for v, _ in known]).astype(np.float32)
    rng, size = np.random.default_rng(7), min(DIMS + 8, *matrix.shape)
    basis = np.linalg.qr(matrix @ rng.standard_normal((TERMS, size), np.float32))[0]
    for _ in range(3):
        basis = np.linalg.qr(matrix @ (matrix.T @ basis))[0]
    right = np.linalg.svd(basis.T @ matrix, full_matrices=False)[2][: min(DIMS, size)].T
    return {"idf": idf, "basis": np.ascontiguousarray(right, np.float32), "points": _unit(matrix @ right),
            "labels": np.array([x for _, x in known], np.float32)}


def _voter(model):
    def vote(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        one_blas_thread()
        idf, basis, points, labels = (model.value[k] for k in ("idf", "basis", "points", "labels"))
        prior = (labels.sum() + 0.5) / (len(labels) + 1)
        for batch in batches:
            scores = np.full(len(batch), prior)
            for at in range(0, len(batch) if len(points) else 0, BLOCK):
                near = _unit(vectors(batch.slice(at, BLOCK).to_pylist(), idf) @ basis) @ points.T
                k = min(NEIGHBOURS, near.shape[1])
                best = np.argpartition(near, near.shape[1] - k, axis=1)[:, near.shape[1] - k :]
                pull = np.maximum(np.take_along_axis(near, best, 1), 1e-3) ** SHARPNESS
                scores[at : at + BLOCK] = (pull * labels[best]).sum(1) / pull.sum(1)
            yield pa.array(np.clip(scores, 0, 1), pa.float64())
    return F.arrow_udf(vote, "double")


def score(docs: DataFrame, model: dict) -> DataFrame:
    """(doc_id, score): the similarity-weighted share of label 1 among the nearest labelled vectors of each row's whole text.

    Null and empty texts are scored as the empty text, by its shape; without labelled rows all get the prior of 0.5. Equal texts get equal
    scores. Other columns are ignored; a row without an id is scored like any other.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return docs.select("doc_id", _voter(shared)(raw_text()).alias("score"))
