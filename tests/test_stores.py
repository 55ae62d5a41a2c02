"""Hash store with filters, ledger of stream batches, threads with a life time."""

import datetime as dt
import random

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from docloom.operators import dedup as D
from docloom.operators import lexicon as V
from docloom.operators.hash_store import HashStore
from docloom.sources.ledger import Ledger
from docloom.streaming import jobs as T

T0 = dt.datetime(2024, 3, 1)


def documents(spark, keys, start=0):
    rows = [(k % 3 if k is not None else 0, start + n, None if k is None else f"{k:064x}", T0 + dt.timedelta(minutes=n)) for n, k in enumerate(keys)]
    return spark.createDataFrame([(f"t{t}", *r) for t, *r in rows], "tenant_id string, doc_id long, content_sha256 string, ingested_at timestamp")


@pytest.mark.parametrize("expected", [10, 200_000])
def test_fresh_documents_equal_the_join(spark, tmp_path, expected):
    rng = random.Random(3)
    old = documents(spark, [rng.randrange(4000) for _ in range(2000)] + [None, None])
    new = documents(spark, [rng.randrange(8000) for _ in range(900)] + [None] * 3, 10_000)
    store = HashStore.create(old.limit(0), f"{tmp_path}/s", expected)
    assert store.fresh(new).count() == D.dedup_content(new, old.limit(0)).count()
    store.add(old.filter("doc_id < 700"))
    store.add(old.filter("doc_id >= 700"))
    store.add(old.filter("doc_id < 50"))  # again
    want = sorted(r["doc_id"] for r in D.dedup_content(new, old).collect())
    assert sorted(r["doc_id"] for r in store.fresh(new).collect()) == want
    again = store.compact(f"{tmp_path}/c")
    assert sorted(r["doc_id"] for r in again.fresh(new).collect()) == want
    assert again.filter_rows().count() == again.filter_rows().select("bucket").distinct().count()


def test_small_batch_reads_filter_and_suspects(spark, tmp_path):
    old = documents(spark, range(30_000))
    store = HashStore.create(old, f"{tmp_path}/s", 60_000)
    batch = documents(spark, [*range(100, 110), *range(1 << 40, (1 << 40) + 90)], 90_000)
    suspects = {(r["tenant_id"], r["content_sha256"]) for r in store.suspects(batch).collect()}
    known = {(r["tenant_id"], r["content_sha256"]) for r in batch.limit(10).collect()}
    assert known <= suspects and len(suspects) <= 13  # about one false alarm in 2 000
    assert {tuple(r) for r in store.stored(batch).collect()} == known
    plan = store.hashes().filter(F.col("content_sha256").isin([k for _, k in known]))._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(content_sha256" in plan


def test_ledger_goes_on_after_a_stop(spark, tmp_path):
    source, root = f"{tmp_path}/in", f"{tmp_path}/corpus"

    def deliver(name, text):
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / "in" / name).write_text(text)

    def run(fail_at=None):
        ledger = Ledger(spark.newSession(), root)

        def sink(batch, batch_id):
            known = ledger.read("texts", "text string", batch_id)
            ledger.write(batch.select("text").join(known, "text", "left_anti"), "texts", batch_id)
            if batch_id == fail_at:
                raise RuntimeError("stop")
            ledger.commit(batch_id)
        query = T.ingest_stream(spark, source, f"{tmp_path}/checkpoint", sink, max_files=1)
        try:
            query.awaitTermination()
        except Exception:
            assert fail_at is not None
        return ledger

    deliver("a.txt", "one")
    run()
    deliver("b.txt", "two")
    ledger = run(fail_at=1)
    assert ledger.committed() == [0] and [r["text"] for r in ledger.read("texts", "text string").collect()] == ["one"]
    deliver("c.txt", "one")
    ledger = run()
    assert ledger.committed() == [0, 1, 2]
    assert sorted(r["text"] for r in ledger.read("texts", "text string").collect()) == ["one", "two"]


TURNS = "tenant_id string, conversation_id string, query_id string, turn_index int, confidence string, feedback string, created_at timestamp"


def test_threads_have_a_life_time(spark, tmp_path):
    """Four batches: equal to the table job inside the life time; the state of silent threads goes; late turns are dropped."""
    turn = lambda c, n, day, ok: ("t", c, f"{n}", n, "confident" if ok else "refused", None, T0 + dt.timedelta(days=day))
    parts = [[turn("a", 1, 0, False), turn("b", 2, 0, False), turn("c", 3, 0, True)],
             [turn("a", 4, 2, True), turn("x", 5, 4, True)],
             [turn("x", 6, 20, True), turn("b", 7, 1, True)],  # b's turn is three days late: dropped
             [turn("b", 8, 21, True), turn("x", 9, 22, False)]]  # b's first turn has left the state
    source = f"{tmp_path}/in"
    for part in parts:
        spark.createDataFrame(part, TURNS).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(TURNS).option("maxFilesPerTrigger", 1).parquet(source)
    out = T.refinement_pairs_stream(stream, delay="1 day", life="10 days")
    out.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start(f"{tmp_path}/o").awaitTermination()
    got = sorted((r.from_query_id, r.to_query_id) for r in spark.read.parquet(f"{tmp_path}/o").collect())
    assert got == [("1", "4")]
    inside = spark.createDataFrame([r for p in parts[:2] for r in p], TURNS)
    assert got == sorted((r.from_query_id, r.to_query_id) for r in V.refinement_pairs(inside, F.lit(T0)).collect())
    state = spark.read.format("statestore").option("stateVarName", "last").load(f"{tmp_path}/cp")
    assert {r["key"]["conversation_id"] for r in state.collect()} == {"x", "b"}


def test_a_turn_costs_few_state_calls():
    """A thread without a pair gives no rows, has one timer, and a thread that went on gets its timer anew when it fires."""
    day, calls = 86_400_000, []

    class Value:
        now = None

        def get(self):
            return self.now

        def update(self, value):
            self.now = value

        def clear(self):
            self.now = None

    class Handle:
        def getValueState(self, name, schema):
            return Value()

        def registerTimer(self, at):
            calls.append(("register", at))

        def deleteTimer(self, at):
            calls.append(("delete", at))

    class Watermark:
        def __init__(self, at):
            self.at = at

        def getCurrentWatermarkInMs(self):
            return self.at

    def turn(n, at, failed):
        return Row(query_id=str(n), turn=n, at=dt.datetime.fromtimestamp(at / 1000), failed=failed, succeeded=not failed)

    last = T._LastTurn(10 * day)
    last.init(Handle())
    assert list(last.handleInputRows(("t", "c"), iter([turn(1, day, True)]), Watermark(0))) == []
    pairs = list(last.handleInputRows(("t", "c"), iter([turn(3, 4 * day, True), turn(2, 3 * day, False)]), Watermark(day)))
    assert [(p.from_query_id, p.to_query_id) for p in pairs] == [("1", "2")] and calls == [("register", 11 * day)]
    assert list(last.handleExpiredTimer(("t", "c"), Watermark(12 * day), None)) == [] and calls[1:] == [("register", 14 * day)]
    assert list(last.handleExpiredTimer(("t", "c"), Watermark(14 * day), None)) == [] and last.last.now is None


def test_first_attempts_keep_one_of_each_key(spark, tmp_path, monkeypatch):
    """The earliest of a batch and the first batch win, with a bounded number of rows held; attempts without a time take part, those without a key pass."""
    monkeypatch.setattr(T, "HELD", 3)
    row = lambda n, key, minute, tenant="t": (tenant, n, key, None if minute is None else T0 + dt.timedelta(minutes=minute))
    parts = [[row(9, "a", 5), row(1, " a\t", 3), row(2, "a", 3), row(3, None, 1), row(4, " ", 1), row(5, "a", 4, "u"), row(6, "n", None), row(7, "n", 8),
              row(8, None, 1), row(20, "x" * 130, 2), row(21, "x" * 128, 1), row(22, "m", None), row(23, "a", 7, None), row(24, "a", 6, None)],
             [row(30, "a", 0), row(31, "b", 9), row(32, "m", 9), row(33, "a", None)]]
    source = f"{tmp_path}/in"
    for part in parts:
        spark.createDataFrame(part, "tenant_id string, event_id long, key string, created_at timestamp").coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema("tenant_id string, event_id long, key string, created_at timestamp").option("maxFilesPerTrigger", 1).parquet(source)
    out = T.first_attempts(stream, "60 days", order=("event_id",))
    assert out.columns == stream.columns
    out.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start(f"{tmp_path}/o").awaitTermination()
    got = sorted((r.event_id, r.key) for r in spark.read.schema(out.schema).parquet(f"{tmp_path}/o").collect())
    assert got == [(1, "a"), (3, None), (4, " "), (5, "a"), (7, "n"), (8, None), (21, "x" * 128), (22, "m"), (24, "a"), (31, "b")]


def test_probe_meets_bounded_slices(spark, tmp_path, monkeypatch):
    """A batch far larger than its store meets the one bucket in slices; every stored hash is still suspected."""
    monkeypatch.setattr("docloom.operators.hash_store.PROBED", 20)
    old, new = documents(spark, range(30)), documents(spark, range(600), 10_000)
    store = HashStore.create(old, f"{tmp_path}/s", 30)
    plan = store.suspects(new)._jdf.queryExecution().analyzed().toString()
    assert store.n_buckets == 1 and "sequence(0, 29" in plan
    assert {r["content_sha256"] for r in store.suspects(new).collect()} >= {f"{k:064x}" for k in range(30)}
    want = sorted(r["doc_id"] for r in D.dedup_content(new, old).collect())
    assert sorted(r["doc_id"] for r in store.fresh(new).collect()) == want


def test_text_hashes_and_vectors_keep_their_rows(spark):
    """More texts than a slice, nulls among them, stay with their hash and their vector; a failing call is tried again."""
    from docloom.functions import pieces
    from docloom.operators import vector as V8
    texts = [None if k % 50 == 7 else "" if k % 50 == 8 else f"Text {k} é" for k in range(300)]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, text string").coalesce(1)
    got = {r["id"]: r["text_sha256"] for r in D.with_text_hash(rows).collect()}
    assert got == {k: pieces.folded_hash(t) for k, t in enumerate(texts)}
    calls = []

    def embedder(part):
        calls.append(len(part))
        if len(calls) == 1:
            raise ValueError("once")
        assert len(part) <= 96
        return [[float(len(t)), 1.0] if t else None for t in part]
    found = {r["id"]: r["embedding"] for r in V8.embed(rows, "text", embedder).collect()}
    assert found == {k: [float(len(t)), 1.0] if t else None for k, t in enumerate(texts)}
