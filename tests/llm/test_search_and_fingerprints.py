"""Ranked search, spot signatures and periodic runs against plain Python, with nulls, ties, repeated rows, clashing columns and empty tables."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from docloom.llm import norm_buckets, periodic_runs, spot_signatures
from docloom.llm.queries import QUERIES, repeated_tail
from tests.llm.test_operators import SCHEMA, by_row, rows

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, 0.5, 1, 2, "k", 3, 4, "w", 5, "z") for r in rows()], SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


# --- ranked search ----------------------------------------------------------------------------------------------------------------

def ranked(documents, items, k=10):
    terms = [(i, TERM.findall((t or "").translate(LOW))) for i, t in documents]
    held = [(i, Counter(t)) for i, t in terms if t]
    big_n, length = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    wanted = {}
    for i, t in items:
        if i is not None:
            wanted.setdefault(i, set()).update(TERM.findall((t or "").translate(LOW)))
    for item, asked in sorted(wanted.items()):
        scores = []
        for i, c in held:
            m = 100 - 90 + (90 * sum(c.values()) * big_n) // length
            s = sum(math.floor(1000 * math.log((2 * big_n + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t in asked if c[t])
            if s > 0:
                scores.append((-s, i is None, i or 0, i))
        out += [(item, rank, i, -s) for rank, (s, _, _, i) in enumerate(sorted(scores, key=lambda x: x[:3])[:k], 1)]
    return sorted(out, key=repr)


def test_ranks_against_brute_force(spark, docs, empty):
    held = [(r[0], r[1]) for r in rows()]
    items = [(1, held[10][1][:200]), (2, held[12][1][:150] + " unknownword"), (3, "common line"), (4, None), (5, "!!"), (6, "nothing of this"),
             (None, "common"), (7, held[20][1]), (8, "B c"), (3, "ka lo"), (9, "É ü ß")]
    table = spark.createDataFrame([(*i, 1) for i in items], "item_id long, text string, doc_id int")
    assert by_row(norm_buckets.rank_documents(docs, table)) == ranked(held, items)
    assert by_row(norm_buckets.rank_documents(docs, table, 3)) == ranked(held, items, 3)
    assert norm_buckets.rank_documents(empty, table).count() == 0
    assert norm_buckets.rank_documents(docs, table.limit(0)).count() == 0


def test_ranks_of_copies_in_many_blocks(spark, monkeypatch):
    rng = random.Random(8)
    vocabulary = [f"w{k}" for k in range(300)]
    prose = lambda n: " ".join(rng.choices(vocabulary, [1 / (k + 1) for k in range(300)], k=n))
    leak = prose(40)
    held = [(k, leak if k % 3 == 0 else prose(rng.randint(1, 120))) for k in range(1500)]
    items = [(k, prose(rng.randint(1, 50))) for k in range(25)] + [(99, leak)]
    monkeypatch.setattr(norm_buckets, "ITEMS", 9)
    table = spark.createDataFrame(held, "doc_id long, text string").repartition(5)
    assert by_row(norm_buckets.rank_documents(table, spark.createDataFrame(items, "item_id long, text string"))) == ranked(held, items)


def test_blocks_lose_nothing_and_save_work():
    rng = np.random.default_rng(4)
    n_terms, n, n_items = 400, 3000, 30
    weight = rng.integers(1, 9000, n_terms)
    lists = [np.sort(rng.choice(n_terms, rng.integers(1, 40), replace=False)) for _ in range(n)]
    term, ends = np.concatenate(lists), np.concatenate([[0], np.cumsum([len(x) for x in lists])])
    impact = weight[term] * rng.integers(1, 1000, len(term))
    dense = np.zeros((n, n_terms), np.int64)
    dense[np.repeat(np.arange(n), np.diff(ends)), term] = impact
    norm = np.sqrt((dense.astype(float) ** 2).sum(1))
    asked = [rng.choice(n_terms, 12, replace=False) for _ in range(n_items)]
    items, best = norm_buckets.Items(asked, weight), norm_buckets.Best(10, np.zeros(n_items, np.int64))
    order, added = np.argsort(-norm), 0
    for at in range(0, n, 250):
        pick = order[at : at + 250]
        part = np.concatenate([[0], np.cumsum(np.diff(ends)[pick])])
        span = np.concatenate([np.arange(ends[k], ends[k + 1]) for k in pick])
        added += norm_buckets.search_block(items, best, pick, norm[pick], part, term[span], impact[span], n_terms)
    for i, terms in enumerate(asked):
        scores = dense[:, terms].sum(1)
        want = sorted(((-s, k) for k, s in enumerate(scores) if s), key=lambda x: x)[:10]
        mine = best.item == i
        assert list(zip((-best.score[mine]).tolist(), best.doc[mine].tolist(), strict=True)) == want
    assert added < 0.6 * sum((dense[:, t].sum(1) > 0).sum() for t in asked)


# --- fingerprints -----------------------------------------------------------------------------------------------------------------

def plain_signatures(text, anchors):
    """Signatures as tuples of words."""
    found = [spot_signatures.word_of(t) for t in text.encode().split()]
    out = set()
    for k, w in enumerate(found):
        chain = [x for x in found[k + 1 :] if x not in anchors][: spot_signatures.CHAIN]
        if w in anchors and len(chain) == spot_signatures.CHAIN:
            out.add((w, *chain))
    behind = [len([x for x in found[k + 1 :] if x not in anchors]) for k, w in enumerate(found) if w in anchors]
    if len({n for n in behind if n >= spot_signatures.CHAIN}) < spot_signatures.FEW:
        out |= {("each", *found[k : k + spot_signatures.CHAIN + 1]) for k in range(len(found))}
    return out


def plain_rows(held, anchors):
    falling = sorted(held, key=lambda r: (r[0] is None, -(r[0] or 0)))
    share = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
    out = []
    for k, (i, t) in enumerate(falling):
        text, after = t or "", falling[(k + 1) % len(falling)][1] or ""
        cut = len(text) // 3
        new = text[: len(text) - cut] + after[:cut]
        a, b, c = (plain_signatures(x, anchors) for x in (text, new, after))
        near = [s if s >= spot_signatures.FLOOR else 0.0 for s in (share(a, b), share(a, c))]
        out.append((i, len(text), hashlib.sha256(new.encode()).hexdigest(), round(near[0], 9), round(near[1], 9), len(a)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("ranges", [1, 5])
def test_fingerprints(spark, docs, empty, ranges, monkeypatch):
    monkeypatch.setattr(spot_signatures, "RANGES", ranges)
    once = {}
    for r in rows():
        once.setdefault(r[0], r[1])
    held = list(once.items())
    table = spark.createDataFrame([(i, t, "x", 1) for i, t in held], "doc_id long, text string, place string, border int").repartition(4)
    counts = Counter(spot_signatures.word_of(w) for _, t in held for w in (t or "").encode().split())
    anchors = {w for w, n in counts.items() if n * spot_signatures.ANCHOR >= sum(counts.values())}
    assert set(spot_signatures.common_words(table)) == anchors
    got = spot_signatures.fingerprints(table)
    columns = ["doc_id", "n_chars", "edited_sha256", F.round("near_edited", 9), F.round("near_next", 9), "n_signatures"]
    assert by_row(got.select(*columns)) == plain_rows(held, anchors)
    for r in got.collect():
        assert len(r["fingerprint"]) == 12 * r["n_signatures"]
    assert spot_signatures.fingerprints(docs).count() == len(rows())
    assert spot_signatures.fingerprints(empty).count() == 0
    alone = spot_signatures.fingerprints(table.filter("doc_id = 10")).first()
    assert alone["near_next"] == 1.0 and alone["near_edited"] > 0.3


def test_fingerprints_of_equal_texts_and_repeated_ids(spark):
    text = "the " + " the ".join(f"alpha{k} beta{k}" for k in range(30))
    table = spark.createDataFrame([(k % 7, text) for k in range(40)] + [(None, text), (100, None), (99, "")], "doc_id long, text string").repartition(3)
    got = spot_signatures.fingerprints(table).collect()
    assert len(got) == 43 and len({r["fingerprint"] for r in got if r["n_chars"]}) == 1
    assert {r["near_next"] for r in got if r["doc_id"] in range(1, 7)} == {1.0}
    assert next(r for r in got if r["doc_id"] == 100)["near_next"] == 1.0


def test_likeness_is_pruned_jaccard():
    rng = random.Random(2)
    for _ in range(400):
        a, b = (np.array(sorted(rng.sample(range(400), rng.choice([0, 1, 5, 30, 200]))), np.uint64) for _ in range(2))
        union = len(set(a.tolist()) | set(b.tolist()))
        exact = len(set(a.tolist()) & set(b.tolist())) / union if union else 1.0
        assert spot_signatures.likeness(a, b) == (exact if exact >= spot_signatures.FLOOR else 0.0)


# --- periodic runs ----------------------------------------------------------------------------------------------------------------

def plain_runs(words, least=12):
    found = {}
    for q in range(1, len(words) // 2 + 1):
        k = 0
        while k + q < len(words):
            s = k
            while k + q < len(words) and words[k] == words[k + q]:
                k += 1
            if k > s and k - s + q >= max(least, 2 * q):
                found.setdefault((s, k - s + q), q)
            k += 1
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def sequences():
    rng = random.Random(6)
    a, b = "a", "ab"
    while len(b) < 200:
        a, b = b, b + a
    yield from (list(b[k : k + n]) for k, n in ((0, 200), (3, 90), (7, 61)))
    yield from ([], ["x"], ["x"] * 11, ["x"] * 12, ["x"] * 150)
    for t in range(900):
        n, k = rng.randint(0, 80), rng.choice([1, 2, 2, 3, 6])
        w = [rng.randrange(k) for _ in range(n)]
        if t % 3 == 0 and w:
            w = (w[: rng.randint(1, 14)] * 90)[:n]
            for _ in range(rng.randint(0, 3)):
                w[rng.randrange(n)] = rng.randrange(k)
        yield w


def test_runs_against_brute_force():
    for w in sequences():
        number = {}
        codes = np.array([number.setdefault(x, len(number)) for x in w], np.int64)
        for least in (2, 12):
            assert [tuple(r) for r in periodic_runs.find_runs(codes, least).tolist()] == plain_runs(w, least)


def test_long_periodic_texts():
    assert periodic_runs.find_runs(np.zeros(300_000, np.int64)).tolist() == [[0, 300_000, 1]]
    assert periodic_runs.find_runs(np.tile(np.arange(7000), 20)).tolist() == [[0, 140_000, 7000]]


def test_runs_table(spark, docs, empty, monkeypatch):
    monkeypatch.setattr(periodic_runs, "BLOCK", 200)
    loops = [(1000 + k, " ".join(map(str, w))) for k, w in enumerate(sequences()) if k % 20 == 0]
    held = [(r[0], r[1]) for r in rows()] + loops
    table = docs.select("doc_id", "text").unionByName(spark.createDataFrame(loops, "doc_id long, text string")).withColumn("runs", F.lit("x"))
    want = []
    for i, t in held:
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        found = plain_runs(w)
        gone = {k for s, n, q in found for k in range(s + q, s + n)}
        want.append((i, len(w), str(found), " ".join(x for k, x in enumerate(w) if k not in gone)))
    got = [(r["doc_id"], r["n_words"], str([tuple(x) for x in r["runs"]]), bytes(r["collapsed"]).decode()) for r in periodic_runs.periodic_runs(table).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert periodic_runs.periodic_runs(empty).count() == 0


def test_runs_query(spark, tmp_path):
    """The digests of the registered query from a plain reading of its contract."""
    base = [f"w{k % 50} x{k}" for k in range(60)]
    held = [(k, None if k == 3 else " ".join(base[: k % 61])) for k in range(200)]
    spark.createDataFrame(held, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    planted = 0
    for r in QUERIES["op13_periodic_runs"](spark, str(tmp_path)).collect():
        w = (held[r["doc_id"]][1] or "").split()
        h, n = zlib.crc32(str(r["doc_id"]).encode()), len(w)
        if h % 10 == 0 and n:
            a = (h // 10) % n
            p = 1 + (n - a) // (3 + (h // 10) % 8)
            w = [w[k] if k < a else w[a + (k - a) % p] for k in range(n)]
            planted += 1
        assert [x.decode() for x in repeated_tail(r["doc_id"], [x.encode() for x in (held[r["doc_id"]][1] or "").split()])] == w
        found = plain_runs(w)
        best = min(found, key=lambda x: (-x[1], x[0], x[2]), default=None)
        assert (r["n_runs"], r["runs_sha256"]) == (len(found), hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in found).encode()).hexdigest())
        assert (r["start"], r["length"], r["period"]) == (best or (None, None, None))
        assert r["exponent_milli"] == (1000 * best[1] // best[2] if best else None)
        gone = {k for s, n, q in found for k in range(s + q, s + n)}
        assert r["collapsed_sha256"] == hashlib.sha256(" ".join(x for k, x in enumerate(w) if k not in gone).encode()).hexdigest()
    assert planted > 5
