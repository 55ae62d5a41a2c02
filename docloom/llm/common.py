"""Helpers shared by the operators: folds, hot keys, Arrow columns, word hashing."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Keys that hold more than 1 / HOT_SHARE of all rows count as hot; there are at most HOT_SHARE of them, so their table can be broadcast.
HOT_SHARE = 4000

BLANK = "[\\x20\\x09-\\x0D]"


def fold_is(doc_id: str, modulus: int, rest: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``, equals ``rest``. Rows without an id count as held out: nothing is learned from them."""
    digest = F.crc32(F.col(doc_id).cast("string").cast("binary"))
    return F.coalesce(digest % modulus == rest, F.lit(True))


def raw_text(text: str = "text") -> Column:
    """UTF-8 bytes of the text; null counts as empty."""
    return F.coalesce(F.col(text), F.lit("")).cast("binary")


def fresh(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` doesn't have."""
    taken, name = {c.lower() for c in df.columns}, stem
    while name.lower() in taken:
        name = f"_{name}"
    return name


def hot_rows(counted: DataFrame, count: str, share: int = HOT_SHARE) -> DataFrame:
    """Rows of a table of key counts whose count exceeds the ``share``-th part of the sum: fewer than ``share`` rows by arithmetic."""
    total = counted.agg(F.sum(count)).first()[0] or 0
    return counted.filter(F.col(count) * share > total)


def labelled_sample(labels: DataFrame, column: str, modulus: int, rest: int, rows: int) -> DataFrame:
    """At most ``rows`` labelled training ids, those with the smallest hash: an even draw that doesn't depend on the order of the table.
    Ids with contradicting labels take the larger one."""
    known = labels.filter(F.col("doc_id").isNotNull() & F.col(column).isNotNull() & ~fold_is("doc_id", modulus, rest))
    once = known.groupBy("doc_id").agg(F.max(F.col(column).cast("int")).alias("label"))
    return once.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)


@lru_cache(maxsize=1)
def one_blas_thread() -> None:
    """Matrix products of a task stay on its own core: Spark runs a task on each, and threads of many tasks would only wait for each other."""
    for path in (Path(np.__file__).parent.parent / "numpy.libs").glob("*openblas*"):
        library = ctypes.CDLL(str(path))
        for name in ("scipy_openblas_set_num_threads64_", "openblas_set_num_threads64_", "openblas_set_num_threads"):
            if hasattr(library, name):
                getattr(library, name)(1)
                break


#: Blocks in which task sums of a matrix meet.
SLOTS = 64


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for slot, part in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            values = np.frombuffer(part.as_py(), np.float64)
            total[slot] = total[slot] + values if slot in total else values
    yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([v.tobytes() for v in total.values()], pa.binary())], ["slot", "part"])


def sum_over(table: DataFrame, function: Callable[[pa.RecordBatch, np.ndarray], None], shape: tuple[int, int]) -> np.ndarray:
    """Sum of a matrix of fixed shape that every task computes over its rows: cut in SLOTS blocks, summed block by block, then collected."""
    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one_blas_thread()
        total = np.zeros(shape)
        for batch in batches:
            function(batch, total)
        cut = np.array_split(total.ravel(), SLOTS)
        yield pa.RecordBatch.from_arrays([pa.array(range(SLOTS), pa.int32()), pa.array([c.tobytes() for c in cut], pa.binary())], ["slot", "part"])

    kind = "slot int, part binary"
    rows = table.mapInArrow(partial, kind).repartition(F.col("slot")).mapInArrow(_summed, kind).collect()
    parts = {r["slot"]: np.frombuffer(r["part"], np.float64) for r in rows}
    return np.concatenate([parts[k] for k in range(SLOTS)]).reshape(shape) if parts else np.zeros(shape)


# --- hashing of whole texts, vectorised over bytes -------------------------------------------------------------------------------

_MASK = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15 | 1
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the 64 output bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_LETTER = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))  # a random 64-bit value for each byte
_LETTER[65:91] = _LETTER[97:123]  # A-Z hash as a-z
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """_BASE ** i and its inverse modulo 2 ** 64, for i < n."""
    if "up" not in _POWERS or len(_POWERS["up"]) < n:
        size = max(1 << 14, 1 << int(n - 1).bit_length())
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _POWERS[name] = np.multiply.accumulate(p)
    return _POWERS["up"], _POWERS["down"]


def word_hashes(text: bytes) -> np.ndarray:
    """A 64-bit hash of each word ``[^\\x20\\x09-\\x0D]+`` of the text, A-Z read as a-z. Equal words have equal hashes wherever they stand."""
    data = np.frombuffer(text, np.uint8)
    if not len(data):
        return np.zeros(0, np.uint64)
    inside = np.zeros(len(data) + 2, bool)
    np.logical_not(_SPACE[data], out=inside[1:-1])
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    start, end = edge[0::2], edge[1::2]
    if not len(start):
        return np.zeros(0, np.uint64)
    up, down = _powers(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_LETTER[data] * up[: len(data)], out=total[1:])
    return mix64((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64))


def shingle_hashes(words: np.ndarray, size: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the ``size``-word shingles; fewer words make one shingle of the whole sequence, none make none."""
    if not len(words):
        return words
    size = min(size, len(words))
    n = len(words) - size + 1
    out = np.full(n, size, np.uint64)
    for k in range(size):
        out = mix64(out * np.uint64(_BASE) + words[k : k + n])
    return np.unique(out)
