"""Harmonic packing of token ids into sequences of a fixed length.

A piece of length ``r`` belongs to class ``j = capacity // r``: ``j`` of its kind always fit one sequence, so a bin of class ``j`` takes exactly
``j`` pieces and is closed. Each worker (input partition) fills the bins of every class by itself. What a document has beyond full sequences is
cut where its class would waste more than ``slack`` of a bin: the largest reciprocal ``capacity // (j + 1)`` below it is split off, which fills
its own class almost without waste. The bins that a worker can't close (fewer than ``j`` pieces for each class, so a bounded number of ids) are
filled again over groups of ``GROUP`` workers, and the few pieces left there are laid end to end, cut at sequence borders.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import raw_text
from docloom.session import store_table

CAPACITY, SLACK, WHOLE, GROUP = 1024, 0.02, 32, 16
_PIECE = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, worker int"
_NAMES = [x.split()[0] for x in _PIECE.split(", ")]


class Encoder:
    """Ids of a tokenizer file, with the rank file of the same vocabulary for speed. Texts that hold a special token's string go to the
    tokenizer file's own rules."""

    def __init__(self, vocabulary: str, ranks: str | None):
        from tokenizers import Tokenizer
        self.slow = Tokenizer.from_file(vocabulary)
        self.special = [t.content for t in self.slow.get_added_tokens_decoder().values()]
        self.fast = None
        if ranks:
            import public_tokenizers
            import tiktoken
            with open(ranks, "rb") as lines:
                table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
            self.fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})

    def __call__(self, text: str) -> np.ndarray:
        if self.fast is None or any(s in text for s in self.special):
            return np.array(self.slow.encode(text, add_special_tokens=False).ids, np.uint32)
        return np.array(self.fast.encode_ordinary(text), np.uint32)


def cut_rest(length: int, capacity: int = CAPACITY, slack: float = SLACK, whole: int = WHOLE) -> list[int]:
    """Piece lengths for the ids beyond a document's full sequences."""
    pieces = []
    while length:
        j = capacity // length
        if length <= whole or length * j >= (1 - slack) * capacity:
            pieces.append(length)
            break
        pieces.append(capacity // (j + 1))
        length -= pieces[-1]
    return pieces


class Bins:
    """Open bins of every class; closed ones come out as rows with a sequence number and an offset."""

    def __init__(self, first_id: int, capacity: int):
        self.next_id, self.capacity, self.open = first_id, capacity, {}

    def put(self, piece: list) -> list[list]:
        j = self.capacity // piece[2]
        bin_ = self.open.setdefault(j, [])
        bin_.append(piece)
        return self.close(self.open.pop(j)) if len(bin_) == j else []

    def close(self, bin_: list[list]) -> list[list]:
        offset = 0
        for piece in bin_:
            piece[5], piece[6] = self.next_id, offset
            offset += piece[2]
        self.next_id += 1
        return bin_


def _batch(rows: list[list]) -> pa.RecordBatch:
    kinds = [pa.binary() if n == "ids" else pa.int32() if n == "worker" else pa.int64() for n in _NAMES]
    columns = list(zip(*rows, strict=True)) if rows else [[]] * len(_NAMES)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], _NAMES)


def _worker(vocabulary: str, ranks: str | None, end_id: int, capacity: int, slack: float):
    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, worker = Encoder(vocabulary, ranks), TaskContext.get().partitionId()
        bins = Bins(worker << 32, capacity)
        for batch in batches:
            rows = []
            for k, (doc_id, text) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1), strict=True)):
                ids = np.append(encode(text.as_py()), np.uint32(end_id)).astype("<u4")
                n = len(ids)
                full, start = n - n % capacity, 0
                for length in [capacity] * (full // capacity) + cut_rest(n - full, capacity, slack):
                    rows += bins.put([doc_id, start, length, ids[start : start + length].tobytes(), n, None, None, worker])
                    start += length
                if k % 512 == 511:
                    yield _batch(rows)
                    rows = []
            yield _batch(rows)
        yield _batch([p for b in bins.open.values() for p in b])
    return fill


def _refill(capacity: int):
    def fill(group: tuple, left: pd.DataFrame) -> pd.DataFrame:
        bins, rows = Bins((1 << 62) + (int(group[0]) << 32), capacity), []
        left = left[_NAMES].astype(object).where(left[_NAMES].notna(), None)
        for piece in left.sort_values(["worker", "length", "doc_id", "start"], kind="stable").to_numpy().tolist():
            rows += bins.put(piece)
        line, room = [], capacity
        for piece in [p for j in sorted(bins.open) for p in bins.open[j]]:
            while piece:
                head, tail = piece, None
                if piece[2] > room:  # cut at the border of the sequence
                    head = [piece[0], piece[1], room, piece[3][: 4 * room], *piece[4:]]
                    tail = [piece[0], piece[1] + room, piece[2] - room, piece[3][4 * room :], *piece[4:]]
                line.append(head)
                room -= head[2]
                if not room:
                    rows += bins.close(line)
                    line, room = [], capacity
                piece = tail
        rows += bins.close(line) if line else []
        return pd.DataFrame({n: pd.array([r[i] for r in rows], dtype="object" if n == "ids" else "Int64") for i, n in enumerate(_NAMES)}).astype({"worker": "int32"})
    return fill


def pack(docs: DataFrame, vocabulary: str, ranks: str | None = None, end_id: int = 0, capacity: int = CAPACITY, slack: float = SLACK) -> DataFrame:
    """(doc_id, start, length, ids, doc_tokens, sequence_id, offset): the pieces of all documents, ``ids`` as little-endian 32-bit numbers.

    Every document ends with ``end_id``; null and empty texts are that id alone. Each id lies in one piece, offsets in a sequence run from 0
    without gaps. Sequences shorter than ``capacity`` are for the reader to pad. Rows without an id and repeated rows are packed like others,
    other columns are ignored, an empty table gives no pieces. ``vocabulary`` and ``ranks`` are paths that every worker can read.
    """
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    pieces = store_table(slim.mapInArrow(_worker(vocabulary, ranks, end_id, capacity, slack), _PIECE), "pieces")
    left = pieces.filter("sequence_id IS NULL").withColumn("worker", F.col("worker"))
    refilled = left.groupBy(F.floor(F.col("worker") / GROUP).alias("team")).applyInPandas(_refill(capacity), _PIECE)
    return pieces.filter("sequence_id IS NOT NULL").unionByName(refilled).drop("worker")
