"""Line dedup over levelled sorted runs of line hashes.

A run is a table (line, n_docs) sorted by line hash. A new batch of documents is counted, anti-joined with the settled run (lines that already
reached the limit need no further counts) and added as a run of level 0. When a level holds ``fan`` runs they are compacted into one run of the
next level; lines that reach the limit there move to the settled run. A last compaction merges what is left.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import fresh, hot_rows, raw_text
from docloom.session import store_table

BLANKS = b" \t\n\x0b\x0c\r"
MIN_DOCS, MIN_CHARS = 10, 1
BATCHES, FAN = 4, 2


def _key(line: bytes, min_chars: int) -> bytes | None:
    """Hash of a line's key, None where the key is shorter than ``min_chars`` code points."""
    key = line.strip(BLANKS).lower()  # bytes.lower changes A-Z only
    if len(key) < min_chars or len(key) < 4 * min_chars and len(key.decode()) < min_chars:
        return None
    return hashlib.md5(key, usedforsecurity=False).digest()


def _line_lister(min_chars: int):
    def lister(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, lines = [], []
            for row, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                keys = {_key(x, min_chars) for x in text.split(b"\n")}
                keys.discard(None)
                rows += [row] * len(keys)
                lines += keys
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(lines, pa.binary())], ["row_key", "line"])
    return lister


class LineRuns:
    """Counts of lines over documents that arrive in batches."""

    def __init__(self, min_docs: int = MIN_DOCS, fan: int = FAN):
        self.min_docs, self.fan = min_docs, fan
        self.levels: list[list[DataFrame]] = []
        self.settled: DataFrame | None = None

    def add(self, lines: DataFrame) -> None:
        """Count a batch: a row (line) for each document and distinct line of it."""
        counts = lines.groupBy("line").agg(F.count(F.lit(1)).alias("n_docs"))
        if self.settled is not None:
            counts = counts.join(self.settled.select("line"), "line", "left_anti")
        self._put(0, store_table(counts.sortWithinPartitions("line"), "line-run"))
        level = 0
        while level < len(self.levels) and len(self.levels[level]) >= self.fan:
            self._compact([level], level + 1)
            level += 1

    def frequent(self) -> DataFrame:
        """(line, n_docs) of the lines found in ``min_docs`` documents or more. ``n_docs`` counts up to the batch that settled the line."""
        self._compact(list(range(len(self.levels))), max(len(self.levels) - 1, 0))
        return self.settled

    def _put(self, level: int, run: DataFrame) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(run)

    def _compact(self, levels: list[int], to: int) -> None:
        runs = [run for level in levels for run in self.levels[level]]
        for level in levels:
            self.levels[level] = []
        if not runs:
            return
        merged = runs[0]
        for run in runs[1:]:
            merged = merged.unionByName(run)
        merged = merged.groupBy("line").agg(F.sum("n_docs").alias("n_docs")).sortWithinPartitions("line")
        merged = store_table(merged.withColumn("done", F.col("n_docs") >= self.min_docs), "line-run")
        done = merged.filter("done").drop("done")
        self.settled = done if self.settled is None else self.settled.unionByName(done)
        self._put(to, merged.filter("NOT done").drop("done"))


def _cutter(min_chars: int):
    def cut(texts: pa.Array, drops: pa.Array) -> pa.Array:
        kept, n_lines, n_dropped = [], [], []
        for text, drop in zip(texts.to_pylist(), drops.to_pylist(), strict=True):
            lines = text.split(b"\n")
            n_lines.append(len(lines))
            if drop:
                drop = set(drop)
                stay = [x for x in lines if _key(x, min_chars) not in drop]
                n_dropped.append(len(lines) - len(stay))
                text = b"\n".join(stay)
            else:
                n_dropped.append(0)
            kept.append(text)
        return pa.StructArray.from_arrays([pa.array(kept, pa.binary()).cast(pa.string()), pa.array(n_lines, pa.int64()),
                                           pa.array(n_dropped, pa.int64())], ["text", "n_lines", "n_dropped"])
    return cut


def dedup_lines(docs: DataFrame, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS, batches: int = BATCHES) -> DataFrame:
    """``docs`` with ``text`` cut and ``n_lines`` (before), ``n_dropped`` set; every other column is kept (a clashing ``n_lines`` or
    ``n_dropped`` is replaced).

    A line's key is the line without blanks at both ends, A-Z lower-cased; keys of ``min_chars`` code points or more that occur in ``min_docs``
    rows or more lose all their lines. Null and empty texts are one empty line and come back empty. A repeated row counts once per row. Ids are
    not needed: rows meet their lines by a hash of id and text, and two rows that share it only share keys that are frequent anyway.
    """
    row_key, cut = fresh(docs, "row_key"), fresh(docs, "cut")
    keyed = docs.withColumn(row_key, F.xxhash64("doc_id", raw_text()))
    lines = keyed.select(F.col(row_key).alias("row_key"), raw_text().alias("raw")).mapInArrow(_line_lister(min_chars), "row_key long, line binary")
    lines = store_table(lines.withColumn("batch", F.pmod("row_key", F.lit(batches))), "lines")
    runs = LineRuns(min_docs)
    for k in range(batches):
        runs.add(lines.filter(F.col("batch") == k))
    frequent = runs.frequent()
    hot = hot_rows(frequent, "n_docs").select("line")
    pairs = lines.select("row_key", "line")
    hits = pairs.join(F.broadcast(hot), "line").unionByName(
        pairs.join(F.broadcast(hot), "line", "left_anti").join(frequent.select("line"), "line", "left_semi"))
    drops = hits.groupBy(F.col("row_key").alias(row_key)).agg(F.collect_set("line").alias(cut))
    cutter = F.arrow_udf(_cutter(min_chars), "text string, n_lines long, n_dropped long")
    joined = keyed.join(drops, row_key, "left").withColumn(cut, cutter(raw_text(), F.col(cut)))
    joined = joined.withColumns({"text": F.col(f"{cut}.text"), "n_lines": F.col(f"{cut}.n_lines"), "n_dropped": F.col(f"{cut}.n_dropped")})
    return joined.drop(row_key, cut)
