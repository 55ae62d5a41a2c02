"""Structured Streaming forms of the table jobs."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from docloom import settings as S
from docloom.operators.answers import FeedbackResult, apply_feedback
from docloom.operators.lexicon import failed, succeeded
from docloom.sources.corpus import shape_files


def document_stream(spark: SparkSession, path: str, pattern: str = "*.{txt,md}", max_files: int = 1000) -> DataFrame:
    """Arriving text files as rows (T1); the checkpoint remembers which were taken."""
    schema = "path string, modificationTime timestamp, length bigint, content binary"
    files = (spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", "true")
             .option("pathGlobFilter", pattern).option("maxFilesPerTrigger", max_files).load(path))
    return shape_files(files)


def ingest_stream(spark: SparkSession, path: str, checkpoint: str, sink: Callable[[DataFrame, int], None], **options) -> StreamingQuery:
    """Drain all waiting files through ``sink`` (usually ingest_batch + writes), then stop (T1). The sink is called again
    with the same batch id after a failure, so it should write idempotently (e.g. dynamic overwrite or replace_by_document)."""
    return (document_stream(spark, path, **options).writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Rows that a task of ``first_attempts`` takes before it keeps the earliest of each key only.
HELD = 100_000


def _earliest(ts: str, order: tuple[str, ...]):
    """The earliest (ts, *order) row of each (tenant, key) of a task; rows without a time come last."""
    by = [(c, "ascending") for c in ("tenant_id", "key", ts, *order)]

    def compact(held: list[pa.RecordBatch]) -> pa.Table:
        rows = pa.Table.from_batches(held).sort_by(by).combine_chunks()  # a stable sort, nulls last
        starts = np.zeros(rows.num_rows, bool)
        starts[:1] = True
        for c in ("tenant_id", "key"):
            codes = rows[c].combine_chunks().dictionary_encode("encode").indices.to_numpy()
            starts[1:] |= codes[1:] != codes[:-1]
        return rows.filter(pa.array(starts))

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        n, room = 0, HELD
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n > room:
                held = compact(held).to_batches()
                n = sum(b.num_rows for b in held)
                room = max(HELD, 2 * n)
        if n:
            yield from compact(held).to_batches(max_chunksize=10_000)
    return pick


def first_attempts(attempts: DataFrame, delay: str = "1 day", ts: str = "created_at", order: tuple[str, ...] = ()) -> DataFrame:
    """First attempt per (tenant, key) (T2). A key is stripped and cut to its first 128 characters; attempts without one pass unchanged, as
    there is nothing to recognise them by. Within a micro-batch the earliest (ts, *order) wins, across batches the first to arrive. State is
    released once the watermark, ``delay`` behind the newest of these attempts, is ``delay`` past the attempt.

    A batch's rows meet by key and are sorted as columns, without a Python call for each key; Spark's own state then holds the keys that have passed, on
    disk (the RocksDB state store, which is set for the session)."""
    attempts.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", _ROCKS)
    key = F.substring(F.btrim("key", F.lit(" \t\n\r\x0b\x0c")), 1, S.IDEMPOTENCY_KEY_CHARS)
    named = attempts.withColumn("_key", F.when(key != "", key))
    keyed = named.filter("_key is not null").withColumn("key", F.col("_key")).drop("_key")
    best = keyed.repartition("tenant_id", "key").mapInArrow(_earliest(ts, order), keyed.schema)
    found = best.withWatermark(ts, delay).dropDuplicatesWithinWatermark(["tenant_id", "key"])
    return found.unionByName(named.filter("_key is null").drop("_key").withWatermark(ts, delay))


def weekly_activity_stream(queries: DataFrame, delay: str = "2 days", tz: str = S.LOCAL_TIME_ZONE, ts: str = "created_at") -> DataFrame:
    """Questions, askers and refusals per local Sunday week (T3), each week once, when the watermark has passed it. Askers are exact: a first
    aggregation keeps a row per week and asker, a second one counts them. Rows later than ``delay`` are dropped."""
    local = queries.filter("golden_id is null").withColumn("_local", F.from_utc_timestamp(ts, tz) if tz != "UTC" else F.col(ts))
    by_user = (local.withWatermark("_local", delay)
               .groupBy("tenant_id", "user_id", F.window("_local", "7 days", "7 days", "3 days").alias("_week"))
               .agg(F.count("*").alias("_n"), F.count_if(F.col("confidence") == "refused").alias("_refused")))
    # the window of a window is the same window; naming its time lets the second aggregation use the first one's watermark
    return (by_user.groupBy("tenant_id", F.window(F.window_time("_week"), "7 days", "7 days", "3 days"))
            .agg(F.sum("_n").alias("questions"), F.sum("_refused").alias("refused"), F.count("user_id").alias("active_users"))
            .select("tenant_id", F.col("window.start").cast("date").alias("week_start"), "questions", "refused", "active_users"))


def daily_usage_stream(events: DataFrame, delay: str = "1 day", ts: str = "created_at") -> DataFrame:
    """Match counts per entry and day (T4), each day once: one row of state per entry and open day."""
    return (events.withWatermark(ts, delay).groupBy("tenant_id", "lexicon_id", F.window(ts, "1 day"))
            .agg(F.count("*").alias("n"), F.max(ts).alias("last_matched_at"))
            .select("tenant_id", "lexicon_id", F.col("window.start").alias("day"), "n", "last_matched_at"))


def rolling_usage(daily: DataFrame, days: int = 30) -> DataFrame:
    """Rolling counts over ``days`` days from the table of daily counts (T4): a row per entry and day after a match, as of the day's start."""
    spread = daily.withColumn("as_of", F.explode(F.expr(f"transform(sequence(1, {days}), i -> day + make_dt_interval(i))")))
    return spread.groupBy("tenant_id", "lexicon_id", "as_of").agg(F.sum("n").alias("match_count_30d"), F.max("last_matched_at").alias("last_matched_at"))


_PAIR = "tenant_id string, conversation_id string, from_query_id string, to_query_id string"


class _LastTurn(StatefulProcessor):
    """The latest turn of a thread as value state that leaves ``life`` milliseconds of event time after it. A thread has one timer: where the thread went
    on after it was set, it is set anew when it fires, so that a turn costs no calls for timers. Rows, as a frame for each short thread costs far more."""

    def __init__(self, life: int) -> None:
        self.life = life

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "query_id string, failed boolean, expires bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        late = timerValues.getCurrentWatermarkInMs()  # Spark's own filter is one batch behind it
        turns = sorted((r.turn, r.at, _by_number(r.query_id), r.failed, r.succeeded) for r in rows if r.at.timestamp() * 1000 >= late)
        if not turns:
            return
        before = self.last.get()
        query_id, was_failed, expires = before if before is not None else (None, False, 0)
        for _, at, (_, this), failed_, succeeded_ in turns:
            when = int(at.timestamp() * 1000)
            if was_failed and succeeded_ and when <= expires:  # a timer fires after the batch that passes it
                yield Row(tenant_id=key[0], conversation_id=key[1], from_query_id=query_id, to_query_id=this)
            query_id, was_failed, expires = this, bool(failed_), max(expires, when + self.life)
        self.last.update((query_id, was_failed, expires))
        if before is None:
            self.handle.registerTimer(expires)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        expires = self.last.get()[2]
        if expires > timerValues.getCurrentWatermarkInMs():
            self.handle.registerTimer(expires)
        else:
            self.last.clear()
        return iter(())

    def close(self) -> None:
        pass


def refinement_pairs_stream(queries: DataFrame, ts: str = "created_at", delay: str = "1 day", life: str = "30 days") -> DataFrame:
    """Failed-then-succeeded neighbours per thread (T5). State is the latest turn of each thread and leaves ``life`` of event time after it, so a
    thread that goes on later starts anew. Turns are paired in (turn, time) order within a batch and across batches as they arrive; turns older than
    the watermark, ``delay`` behind the newest, and turns without a time are dropped. Needs the RocksDB state store, which is set for the session."""
    queries.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", _ROCKS)
    rows = (queries.filter(F.col("conversation_id").isNotNull() & F.col(ts).isNotNull()).withWatermark(ts, delay)
            .select(F.col("tenant_id").cast("string").alias("tenant_id"), F.col("conversation_id").cast("string").alias("conversation_id"),
                    F.col("query_id").cast("string").alias("query_id"), F.coalesce("turn_index", F.lit(2_147_483_647)).alias("turn"),
                    F.col(ts).alias("at"), F.coalesce(failed(), F.lit(False)).alias("failed"),
                    F.coalesce(succeeded(), F.lit(False)).alias("succeeded")))
    processor = _LastTurn(int(pd.Timedelta(life).total_seconds() * 1000))
    return rows.groupBy("tenant_id", "conversation_id").transformWithState(processor, _PAIR, "Append", "EventTime")


def _by_number(query_id: str) -> tuple[int, str]:
    """Numeric ids in the order of their numbers, others after them by text."""
    return (int(query_id) if query_id.isdigit() else 1 << 63, query_id)


def feedback_stream(events: DataFrame, load: Callable[[int], tuple[DataFrame, DataFrame]],
                    save: Callable[[FeedbackResult, int], None], checkpoint: str) -> StreamingQuery:
    """Apply feedback events as they arrive (T6): ``load(batch id)`` gives the (queries, answers) that the batch before stored, ``save`` stores
    the new state under its batch id, so a repeated batch starts from the same state again."""
    def step(batch: DataFrame, batch_id: int) -> None:
        queries, answers = load(batch_id)
        save(apply_feedback(queries, answers, batch), batch_id)
    return events.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
