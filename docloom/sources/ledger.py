"""Tables that a stream writes batch by batch, with a ledger of the batches that are complete."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Ledger:
    """Under one path: ``<table>/batch=<id>`` for what a batch wrote, and a ledger row for each batch whose tables are all written.

    A batch that fails in between leaves no ledger row, so later batches don't see its tables, and when it is repeated it writes the same folders again.
    Everything is read back from the folder, so a new session goes on where the last one stopped."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self.spark.createDataFrame([], "batch long").write.mode("append").parquet(f"{self.path}/ledger")

    def committed(self, before: int | None = None) -> list[int]:
        """Ids of complete batches, those before ``before``; a row each."""
        rows = self.spark.read.schema("batch long").parquet(f"{self.path}/ledger").distinct()
        rows = rows if before is None else rows.filter(F.col("batch") < before)
        return sorted(r["batch"] for r in rows.collect())

    def write(self, df: DataFrame, table: str, batch_id: int) -> None:
        df.write.mode("overwrite").parquet(f"{self.path}/{table}/batch={batch_id}")

    def read(self, table: str, schema: str, before: int | None = None) -> DataFrame:
        """Rows of a table from complete batches."""
        folders = [f"{self.path}/{table}/batch={b}" for b in self.committed(before)]
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def commit(self, batch_id: int) -> None:
        """Call when all tables of the batch are written."""
        self.spark.createDataFrame([(batch_id,)], "batch long").coalesce(1).write.mode("append").parquet(f"{self.path}/ledger")
