"""Stored content hashes with Bloom filters: a batch meets the store only where the filter is not sure.

The store is append-only. Each addition writes its hashes in order, so that a lookup of few hashes reads few row groups, and one row of filter bits
for every bucket it touches, built inside tasks; rows of one bucket are merged by OR when they are read (or for good by ``compact``). A filter never
misses a stored hash. A false alarm only means that the hash is looked up.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.operators.scale import top_n
from docloom.session import store_table

#: Bits of one bucket (128 KB), bits set for each hash, and bits planned for each: about one false alarm in 2 000.
BUCKET_BITS, SET_BITS, BITS_PER_HASH = 1 << 20, 6, 16
#: Buckets, and suspected hashes, that are named in the scan's filter; more of them meet by join.
NAMED = 1000
#: Hashes of a batch that one Python call compares with a bucket's filter, on average.
PROBED = 50_000
_KEY = ["tenant_id", "content_sha256"]
_BITS = "bucket long, bits binary"


def _positions(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """The bits of each hash in its bucket."""
    one, two = one.view(np.uint64) >> np.uint64(20), two.view(np.uint64) | np.uint64(1)
    return ((one[:, None] + np.arange(SET_BITS, dtype=np.uint64) * two[:, None]) % np.uint64(BUCKET_BITS)).astype(np.int64)


def _build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row of bits for each run of equal buckets; rows come sorted by bucket."""
    held, bits = None, np.zeros(BUCKET_BITS, bool)

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([held], pa.int64()), pa.array([np.packbits(bits).tobytes()], pa.binary())], ["bucket", "bits"])

    for batch in batches:
        bucket, at = batch.column(0).to_numpy(), _positions(batch.column(1).to_numpy(), batch.column(2).to_numpy())
        for b in np.unique(bucket):
            if b != held:
                if held is not None:
                    yield row()
                held, bits = int(b), np.zeros(BUCKET_BITS, bool)
            bits[at[bucket == b]] = True
    if held is not None:
        yield row()


def _merged(rows: pd.DataFrame) -> pd.DataFrame:
    bits = np.zeros(BUCKET_BITS // 8, np.uint8)
    for part in rows["bits"]:
        bits |= np.frombuffer(part, np.uint8)
    return pd.DataFrame({"bucket": rows["bucket"].iloc[:1], "bits": [bits.tobytes()]})


class HashStore:
    """Hashes(tenant_id, content_sha256) and filter rows(bucket, bits) under one path. ``n_buckets`` is fixed when the store is made."""

    def __init__(self, spark: SparkSession, path: str, n_buckets: int) -> None:
        self.spark, self.path, self.n_buckets = spark, path.rstrip("/"), n_buckets

    @classmethod
    def create(cls, docs: DataFrame, path: str, expected: int) -> HashStore:
        """A store for about ``expected`` hashes that holds those of ``docs``. More hashes than expected raise false alarms and lose none."""
        store = cls(docs.sparkSession, path, max(1, -(-expected * BITS_PER_HASH // BUCKET_BITS)))
        store.add(docs)
        return store

    def _keyed(self, docs: DataFrame) -> DataFrame:
        one = F.xxhash64(*_KEY)
        return docs.withColumn("_bucket", F.pmod(one, F.lit(self.n_buckets))).withColumn("_one", one).withColumn("_two", F.xxhash64(F.lit("second"), *_KEY))

    def add(self, docs: DataFrame) -> None:
        """Append the hashes of ``docs``; documents without one are not stored. A repeated addition changes nothing but space."""
        known = store_table(docs.filter("content_sha256 is not null").select(*_KEY).distinct(), "new-hashes")
        known.sortWithinPartitions("content_sha256").write.mode("append").parquet(f"{self.path}/hashes")
        placed = self._keyed(known).select(F.col("_bucket").alias("bucket"), F.col("_one"), F.col("_two"))
        bits = placed.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_build, _BITS)
        bits.sortWithinPartitions("bucket").write.mode("append").parquet(f"{self.path}/filter")

    def compact(self, path: str) -> HashStore:
        """The same store at another path, with one filter row for each bucket."""
        self.hashes().distinct().repartitionByRange("content_sha256").sortWithinPartitions("content_sha256").write.parquet(f"{path}/hashes")
        self.filter_rows().groupBy("bucket").applyInPandas(_merged, _BITS).write.parquet(f"{path}/filter")
        return HashStore(self.spark, path, self.n_buckets)

    def hashes(self) -> DataFrame:
        return self.spark.read.schema("tenant_id string, content_sha256 string").parquet(f"{self.path}/hashes")

    def filter_rows(self, buckets: list[int] | None = None) -> DataFrame:
        rows = self.spark.read.schema(_BITS).parquet(f"{self.path}/filter")
        return rows if buckets is None else rows.filter(F.col("bucket").isin(buckets))

    def suspects(self, new: DataFrame) -> DataFrame:
        """(tenant_id, content_sha256) of ``new`` that may be stored: every stored one, and few others."""
        asked = self._keyed(new.filter("content_sha256 is not null").select(F.col("tenant_id").cast("string").alias("tenant_id"), "content_sha256").distinct())
        asked = store_table(asked.withColumnRenamed("_bucket", "bucket"), "asked-hashes")
        touched = [r["bucket"] for r in asked.select("bucket").distinct().limit(NAMED + 1).collect()]
        rows = self.filter_rows(touched if len(touched) <= NAMED else None)

        # what meets in one Python call is bounded by PROBED, however large the batch is beside the store
        parts = max(1, -(-asked.count() // (self.n_buckets * PROBED)))
        asked = asked.withColumn("part", F.pmod(F.col("_two"), F.lit(parts)))
        rows = rows.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)).cast("array<long>")))

        def probe(hashes: pa.Table, filters: pa.Table) -> pa.Table:
            keys = hashes.select(_KEY)
            if not hashes.num_rows or not filters.num_rows:
                return keys.slice(0, 0)
            bits = np.zeros(BUCKET_BITS // 8, np.uint8)
            for row in filters["bits"]:
                bits |= np.frombuffer(row.as_buffer(), np.uint8)
            at = _positions(hashes["_one"].to_numpy(), hashes["_two"].to_numpy())
            return keys.filter(pa.array(np.unpackbits(bits).astype(bool)[at].all(1)))

        key = ["bucket", "part"]
        return asked.groupBy(*key).cogroup(rows.groupBy(*key)).applyInArrow(probe, "tenant_id string, content_sha256 string")

    def stored(self, new: DataFrame) -> DataFrame:
        """(tenant_id, content_sha256) of ``new`` that are stored. Without suspects the hashes are not read at all; few suspects are named in the scan."""
        suspects = store_table(self.suspects(new), "suspects")
        named = [r["content_sha256"] for r in suspects.select("content_sha256").distinct().limit(NAMED + 1).collect()]
        if not named:
            return suspects
        hashes = self.hashes()
        if len(named) <= NAMED:
            hashes = hashes.filter(F.col("content_sha256").isin(named))
        return suspects.join(hashes.select(*_KEY).distinct(), _KEY, "left_semi")

    def fresh(self, new: DataFrame) -> DataFrame:
        """New documents whose hash is not stored yet; the first of a batch wins and documents without a hash stay (the rows of ``dedup_content``)."""
        left = new.join(self.stored(new), _KEY, "left_anti")
        order = [F.col("ingested_at"), F.col("doc_id")]
        return top_n(left.filter("content_sha256 is not null"), _KEY, order, 1).unionByName(left.filter("content_sha256 is null"))
