"""Exact dedup by a tree merge of sorted digest runs.

Every input partition turns its texts into one run: entries (digest, length, probe, smallest id, count) sorted by digest, equal neighbours
collapsed. In each round the runs meet in groups of ``FAN`` (``log2(FAN)`` binomial steps at once): run ``r`` joins run ``r // FAN``, the
entries of a group are dealt over tasks by digest, sorted again (Spark's sorter merges the sorted pieces and spills) and collapsed, until one
run is left, spread over tasks by digest. A text with any number of copies is one entry per run, so no task gets the copies themselves.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import BLANK, hot_rows
from docloom.session import store_table

RUNS, FAN = 64, 8
_NO_ID = (1 << 63) - 1
_SCHEMA = pa.schema([("run", pa.int32()), ("digest", pa.string()), ("n_chars", pa.int64()), ("probe", pa.int64()), ("keep_id", pa.int64()),
                     ("group_size", pa.int64())])
_ENTRY = "run int, digest string, n_chars long, probe long, keep_id long, group_size long"


def normalised(text: str = "text"):
    """The text with each run of blanks as one space; null is empty."""
    return F.regexp_replace(F.coalesce(F.col(text), F.lit("")), f"{BLANK}+", " ")


def _collapse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Collapse equal neighbours of a stream sorted by (run, digest, n_chars, probe). Copies must agree in digest, length and second hash:
    entries that differ in any of them stay apart. The last entry of a batch waits for the next batch."""
    held: pa.RecordBatch | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        batch = pa.RecordBatch.from_arrays(batch.columns, schema=_SCHEMA)
        table = pa.Table.from_batches([held, batch] if held is not None else [batch]).combine_chunks()
        n = table.num_rows
        new = np.zeros(n, bool)
        new[0] = True
        for name in ("run", "digest", "n_chars", "probe"):
            column = table[name].chunk(0)
            new[1:] |= pc.not_equal(column[1:], column[:-1]).to_numpy(zero_copy_only=False)
        first = np.flatnonzero(new)
        keys = table.select(_SCHEMA.names[:4]).take(pa.array(first)).combine_chunks().to_batches()[0].columns
        kept = pa.array(np.minimum.reduceat(table["keep_id"].to_numpy(), first))
        size = pa.array(np.add.reduceat(table["group_size"].to_numpy(), first))
        out = pa.RecordBatch.from_arrays([*keys, kept, size], schema=_SCHEMA)
        if out.num_rows > 1:
            yield out.slice(0, out.num_rows - 1)
        held = out.slice(out.num_rows - 1)
    if held is not None:
        yield held


def merge_runs(entries: DataFrame, runs: int = RUNS, fan: int = FAN) -> DataFrame:
    """One entry per distinct text from the entries of ``runs`` runs."""
    key = ["run", "digest", "n_chars", "probe"]
    merged = entries.sortWithinPartitions(*key).mapInArrow(_collapse, _ENTRY)
    while runs > 1:
        runs = -(-runs // fan)
        merged = merged.withColumn("run", (F.col("run") / fan).cast("int"))
        merged = merged.repartition("run", "digest").sortWithinPartitions(*key).mapInArrow(_collapse, _ENTRY)
    return merged


def exact_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256), a row for each row of ``docs``.

    Texts are equal after each run of blanks became one space; null is the empty text. The row with the smallest id stays. Rows without an
    id stay only where their whole group has none (``keep_id`` is null then); rows that repeat the kept id are copies of the same row and
    all say ``kept``. Other columns are ignored, an empty table gives an empty result.
    """
    slim = docs.select(F.col(doc_id).cast("long").alias("doc_id"), normalised(text).alias("clean"))
    ids = store_table(slim.select("doc_id", F.sha2("clean", 256).alias("digest"), F.length("clean").cast("long").alias("n_chars"),
                                  F.xxhash64("clean").alias("probe")), "digests")
    entries = ids.select((F.spark_partition_id() % RUNS).alias("run"), "digest", "n_chars", "probe",
                         F.coalesce("doc_id", F.lit(_NO_ID)).alias("keep_id"), F.lit(1).cast("long").alias("group_size"))
    groups = merge_runs(entries).drop("run").filter("group_size > 1")
    groups = store_table(groups, "digest-groups")
    hot = hot_rows(groups, "group_size")
    key = ["digest", "n_chars", "probe"]
    often = ids.join(F.broadcast(hot), key)
    seldom = ids.join(F.broadcast(hot.select(*key)), key, "left_anti").join(groups, key, "left")
    keep = F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.nullif("keep_id", F.lit(_NO_ID)))
    return often.unionByName(seldom).select(
        "doc_id", keep.alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.col("doc_id").eqNullSafe(keep).alias("kept"), F.col("digest").alias("text_sha256"))
