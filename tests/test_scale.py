"""Split, salted and blocked forms against plain ones."""

import random

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from docloom import settings as S
from docloom.functions import pieces
from docloom.operators import fusion, governance, vector
from docloom.operators.scale import attach_groups, top_n, with_last_before, with_next


@pytest.mark.parametrize("width", [1, 3, 1000])
def test_neighbours_split_by_segment(spark, width):
    rng = random.Random(width)
    rows = [(rng.choice("aab"), i, rng.choice([None, i])) for i in range(60)]
    df = spark.createDataFrame(rows, "k string, t int, v int")
    seg = F.floor(F.col("t") / width)
    nxt = {(r.k, r.t): r.next and r.next.t for r in with_next(df, ["k"], ["t"], seg, ["t"]).collect()}
    last = {(r.k, r.t): r.p for r in with_last_before(df, ["k"], ["t"], seg, F.col("v"), "p").collect()}
    for key in "ab":
        mine = [r for r in rows if r[0] == key]
        seen = None
        for i, r in enumerate(mine):
            assert nxt[(key, r[1])] == (mine[i + 1][1] if i + 1 < len(mine) else None)
            assert last[(key, r[1])] == seen
            seen = r[2] if r[2] is not None else seen


def test_hot_group_is_salted_without_loss(spark):
    df = spark.range(1000).withColumn("k", F.when(F.col("id") < 700, 0).otherwise(F.col("id")))
    groups = df.groupBy("k").agg(F.count("*").alias("n"))
    out = attach_groups(df, groups, ["k"], "n", "id", rows_per_task=50)
    assert out.count() == 1000 and out.filter("k = 0 and n = 700").count() == 700


def test_top_n_limits_before_the_shuffle(spark):
    df = spark.range(100).withColumn("k", F.col("id") % 2)
    plan = top_n(df, ["k"], [F.col("id")], 3)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


def greedy(rows, caps, k):
    """Plain loop: cap per document, stop at k, refill in rank order."""
    per, out = {}, []
    for rid, doc, kind in rows:
        if per.get(doc, 0) < caps.get(kind, 2) and len(out) < k:
            per[doc] = per.get(doc, 0) + 1
            out.append(rid)
    return out + [r[0] for r in rows if r[0] not in out][:k - len(out)]


def test_diversity_equals_greedy_loop(spark):
    rng = random.Random(1)
    cases, rows = {}, []
    for q in range(60):
        kinds = {d: rng.choice(["bylaw", "decision", None]) for d in range(4)}
        cases[q] = [(f"{q}-{i}", d, kinds[d]) for i, d in enumerate(rng.choices(range(4), k=rng.randint(1, 15)))]
        rows += [(q, rid, d, kind, i + 1, 5) for i, (rid, d, kind) in enumerate(cases[q])]
    df = spark.createDataFrame(rows, "question_id int, chunk_id string, doc_id int, doc_type string, rank int, k int")
    got = fusion.diversify(df).groupBy("question_id").agg(F.array_sort(F.collect_list(F.struct("rank", "chunk_id"))).alias("l")).collect()
    assert {r.question_id: [x.chunk_id for x in r.l] for r in got} == {q: greedy(c, S.FINAL_CAP, 5) for q, c in cases.items()}


def vectors(spark, n, seed, scopes=2):
    rng = np.random.default_rng(seed)
    base = rng.integers(-2, 3, size=(n, 4)).astype(float)  # many equal and some zero vectors
    return [(f"s{i % scopes}", i, i // 3, int(i % 4), base[i].tolist()) for i in range(n)]


@pytest.mark.parametrize("routes", [{}, {"broadcast_bytes": 0, "block_bytes": 2000}])
def test_nearest_equals_brute_force(spark, routes):
    items, asks = vectors(spark, 90, 1), vectors(spark, 30, 2)
    cols = "tenant_id string, id int, owner int, bucket int, embedding array<double>"
    v = spark.createDataFrame(items, cols).withColumnRenamed("id", "chunk_id")
    q = spark.createDataFrame(asks, cols).withColumnRenamed("id", "question_id")
    got = vector.nearest(q, v, 5, bucket=F.col("bucket"), low=F.lit(1), high=F.lit(2), question_owner="owner", item_owner="owner", **routes)
    want = set()
    for s, qid, own, _, qv in asks:
        for b in (1, 2):
            near = sorted((round(1 - float(np.dot(qv, iv) / np.linalg.norm(qv) / np.linalg.norm(iv)), 9), iid) for s2, iid, own2, b2, iv in items
                          if s2 == s and own2 != own and b2 == b and any(iv) and any(qv))
            want |= {(qid, b, iid, r) for r, (_, iid) in enumerate(near[:5], 1)}
    assert {(r.question_id, r.bucket, r.chunk_id, r["rank"]) for r in got.collect()} == want


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 1), st.integers(0, 20), st.integers(1, 6)), max_size=15))
def test_span_choice_equals_pairwise_check(raw):
    spans = [(p, s, s + n) for p, s, n in raw]
    chosen = []
    for i in sorted(range(len(spans)), key=lambda i: (spans[i][0], spans[i][1] - spans[i][2], spans[i][1])):
        if all(spans[i][2] <= spans[c][1] or spans[i][1] >= spans[c][2] for c in chosen):
            chosen.append(i)
    assert pieces.pick_spans(spans) == sorted(chosen, key=lambda i: spans[i][1])


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet='ab _-"', max_size=40), st.lists(st.lists(st.text(alphabet='ab -"', min_size=1, max_size=4), min_size=1, max_size=3), max_size=4))
def test_term_index_equals_alternation(text, entries):
    import re
    found = []
    for i, forms in enumerate(entries):
        alt = "|".join(re.escape(f) for f in sorted(set(forms), key=len, reverse=True))
        found += [(i, m.group(), m.start(), m.end()) for m in re.finditer(rf"(?<!\w)(?:{alt})(?!\w)", text)]
    want = [found[i] for i in pieces.pick_spans([(0, f[2], f[3]) for f in found])]
    got = [(i, f, s, e) for i, _, f, s, e in pieces.TermIndex([(i, "t", forms) for i, forms in enumerate(entries)]).find(text)]
    assert got == want


def test_results_do_not_depend_on_partitions(spark):
    v = spark.createDataFrame(vectors(spark, 80, 3), "tenant_id string, chunk_id int, doc_id int, bucket int, embedding array<double>").withColumn("doc_type", F.lit("minutes"))
    q = v.withColumn("question_id", F.col("chunk_id"))
    runs = [sorted(map(tuple, vector.vector_search(q.repartition(n), v.repartition(n)).collect())) for n in (1, 7)]
    assert runs[0] == runs[1]


@pytest.mark.parametrize("name", ["neighbor_pairs", "chain_candidates", "reconcile_pairs"])
def test_block_route_of_self_searches(spark, monkeypatch, name):
    """Questions and items from one table meet in blocks and give the rows of the broadcast route."""
    import __spark_entry__ as entry_module
    query, folder = entry_module.queries()[name], "/root/testdata/sf0.001"
    want = sorted(map(tuple, query(spark, folder).collect()), key=repr)
    plain = vector.nearest
    blocks = lambda *a, **k: plain(*a, **{**k, "broadcast_bytes": 0, "block_bytes": 64 << 10})
    monkeypatch.setattr(vector, "nearest", blocks)
    monkeypatch.setattr(governance, "nearest", blocks)
    assert sorted(map(tuple, query(spark, folder).collect()), key=repr) == want
