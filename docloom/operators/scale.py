"""Helpers that keep per-group work bounded when one key holds a large share of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

MAX_HOT_KEYS = 10_000


def top_n(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, rank_col: str | None = None) -> DataFrame:
    """First ``n`` rows of each group, 1-based rank in ``rank_col`` when asked for.

    The constant bound lets Spark cut every group to ``n`` rows inside each map task, so a hot key never travels whole.
    """
    col = rank_col or "_rn"
    out = df.withColumn(col, F.row_number().over(W.partitionBy(*keys).orderBy(*order))).filter(F.col(col) <= n)
    return out if rank_col else out.drop(col)


def attach_groups(rows: DataFrame, groups: DataFrame, keys: Sequence[str], size_col: str, spread: str,
                  how: str = "inner", rows_per_task: int = 2_000_000) -> DataFrame:
    """Join a one-row-per-key table back onto its member rows, splitting hot keys.

    ``size_col`` (in ``groups``) holds the member count; a key with more than ``rows_per_task`` members is salted by
    ``spread`` (a high-cardinality column of ``rows``). The table of hot keys is broadcast and is at most
    ``MAX_HOT_KEYS`` rows; keys past that bound join unsalted, which changes speed and not results.
    """
    keys = list(keys)
    hot = (groups.filter(F.col(size_col) > rows_per_task)
           .orderBy(F.desc(size_col)).limit(MAX_HOT_KEYS)
           .select(*keys, F.ceil(F.col(size_col) / rows_per_task).cast("int").alias("_salts")))
    salted_rows = (rows.join(F.broadcast(hot), keys, "left")
                   .withColumn("_salt", F.pmod(F.xxhash64(spread), F.coalesce("_salts", F.lit(1))))
                   .drop("_salts"))
    salted_groups = (groups.join(F.broadcast(hot), keys, "left")
                     .withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)) - 1)))
                     .withColumn("_salt", F.col("_salt").cast("bigint")).drop("_salts"))
    return salted_rows.join(salted_groups, [*keys, "_salt"], how).drop("_salt")


def with_next(df: DataFrame, keys: Sequence[str], order: Sequence[str], segment: Column, take: Sequence[str],
              out: str = "next") -> DataFrame:
    """Add struct ``out`` holding ``take`` of the following row in each group (NULL on the last row).

    ``segment`` is any monotone function of the sort order (e.g. ``floor(turn / 4096)`` or a day). Rows are windowed per
    (keys, segment), so a hot key is split over many tasks; segment borders are stitched through a table with one row
    per segment.
    """
    keys, order = list(keys), list(order)
    seg = df.withColumn("_seg", segment)
    val = F.struct(*[F.col(c) for c in take])
    inner = W.partitionBy(*keys, "_seg").orderBy(*order)
    firsts = (seg.groupBy(*keys, "_seg").agg(F.min_by(val, F.struct(*order)).alias("_first"))
              .withColumn("_border", F.lead("_first").over(W.partitionBy(*keys).orderBy("_seg")))
              .select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_seg").alias("_sg"), "_border"))
    cond = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)] + [F.col("_seg") == F.col("_sg")]
    joined = seg.withColumn("_in", F.lead(val).over(inner)).join(firsts, cond, "left")
    return joined.withColumn(out, F.coalesce("_in", "_border")).drop(
        "_in", "_border", "_seg", "_sg", *[f"_k{i}" for i in range(len(keys))])


def with_last_before(df: DataFrame, keys: Sequence[str], order: Sequence[str], segment: Column, value: Column,
                     out: str) -> DataFrame:
    """Add the latest non-NULL ``value`` seen strictly before each row in its group; split by segment as above."""
    keys, order = list(keys), list(order)
    seg = df.withColumn("_seg", segment).withColumn("_v", value)
    inner = W.partitionBy(*keys, "_seg").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    outer = W.partitionBy(*keys).orderBy("_seg").rowsBetween(W.unboundedPreceding, -1)
    lasts = (seg.groupBy(*keys, "_seg")
             .agg(F.max_by("_v", F.when(F.col("_v").isNotNull(), F.struct(*order))).alias("_last"))
             .withColumn("_carry", F.last("_last", ignorenulls=True).over(outer))
             .select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_seg").alias("_sg"), "_carry"))
    cond = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)] + [F.col("_seg") == F.col("_sg")]
    joined = seg.withColumn("_in", F.last("_v", ignorenulls=True).over(inner)).join(lasts, cond, "left")
    return joined.withColumn(out, F.coalesce("_in", "_carry")).drop(
        "_in", "_v", "_carry", "_seg", "_sg", *[f"_k{i}" for i in range(len(keys))])


def literal_map(mapping: dict[str, object], key: Column, default: object) -> Column:
    """Constant lookup as a CASE expression (stays inside code generation)."""
    expr = None
    for k, v in mapping.items():
        expr = F.when(key == k, F.lit(v)) if expr is None else expr.when(key == k, F.lit(v))
    return expr.otherwise(F.lit(default))
