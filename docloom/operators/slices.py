"""Rows that a Python function makes from rows, handed on a few at a time."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Rows taken in and given out at a time: what a worker holds as Python objects doesn't grow with Spark's batches.
ROWS_IN, ROWS_OUT = 64, 4096
_KINDS = {"string": pa.string(), "int": pa.int32()}


def flat_map(df: DataFrame, inputs: list[str], keep: list[str], fields: str, start: Callable[[], Callable[..., list[tuple]]]) -> DataFrame:
    """Columns ``keep`` of each row beside each of the tuples that the function from ``start()`` makes of its columns ``inputs``; rows without tuples go.
    ``fields`` names the tuples' values, string or int. ``start`` is called once a task."""
    made = [f.split() for f in fields.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        function = start()

        def emit(batch: pa.RecordBatch, at: list[int], rows: list[tuple]) -> pa.RecordBatch:
            kept = batch.select(list(range(len(keep)))).take(pa.array(at, pa.int64()))
            values = [pa.array([r[k] for r in rows], _KINDS[kind]) for k, (_, kind) in enumerate(made)]
            return pa.RecordBatch.from_arrays([*kept.columns, *values], [*keep, *(name for name, _ in made)])

        for batch in batches:
            at, rows = [], []
            for low in range(0, batch.num_rows, ROWS_IN):
                columns = [c.to_pylist() for c in batch.slice(low, ROWS_IN).columns[len(keep):]]
                for k, values in enumerate(zip(*columns, strict=True), low):
                    for row in function(*values):
                        at.append(k)
                        rows.append(row)
                        if len(rows) >= ROWS_OUT:
                            yield emit(batch, at, rows)
                            at, rows = [], []
            if rows:
                yield emit(batch, at, rows)

    kinds = T.StructType([df.schema[c] for c in keep] + T._parse_datatype_string(fields).fields)
    named = df.select(*keep, *[df[c].alias(f"_in{k}") for k, c in enumerate(inputs)])
    return named.mapInArrow(run, kinds)
