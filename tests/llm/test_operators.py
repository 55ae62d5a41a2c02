"""Every operator on a small table with nulls, empty and long texts, ties, repeated rows and clashing columns, against plain Python."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from docloom.llm import attention_lm, decontam, digest_tree, langid, line_runs, minhash, packing, pii, quality, toxicity
from docloom.llm.common import shingle_hashes, word_hashes
from docloom.llm.queries import tokenizer

RANKS, VOCABULARY = tokenizer("byte_bpe_50k.tiktoken"), tokenizer("byte_bpe_50k.json")
SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, score double, label int, n_lines int, row_key string, cut int, "
          "rep int, word string, batch int, kept string")
SYLLABLES = "ka lo mi tu re san do vel pri nok".split()


def rows():
    rng = random.Random(3)
    word = lambda: "".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, 3)))
    prose = lambda n: " ".join(word() for _ in range(n))
    base = [prose(rng.randint(30, 90)) for _ in range(25)]
    texts = [None, "", " \t\n", "one", "A b\tC\n\nd", "!!! 123 ???", "x" * 3000, prose(9000), "é ü ß\ncommon line\r\n  Common LINE  \n"]
    texts += base + base[:6] + [b.upper() for b in base[:3]] + [b.replace(" ", "  ") for b in base[3:6]]
    for b in base[:10]:  # near copies
        w = b.split()
        w[rng.randrange(len(w))] = "changed"
        texts.append(" ".join(w))
    texts += [f"{prose(5)}\ncommon line\n{prose(6)}" for _ in range(12)]
    out = [(k, t, "en" if k % 3 else None, None, None) for k, t in enumerate(texts)]
    return out + [out[10], out[10], (None, base[1], "de", None, 4), (None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, 0.5, 1, 2, "k", 3, 4, "w", 5, "z") for r in rows()], SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(k, k % 2, (k + 1) % 2) for k in range(40)] + [(None, 1, 1), (5, None, None)], "doc_id long, quality int, toxic int")


def by_row(frame):
    return sorted(map(tuple, frame.collect()), key=repr)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))


# --- exact and line dedup ---------------------------------------------------------------------------------------------------------

def test_exact_dedup(docs, empty):
    groups = defaultdict(list)
    for i, t, *_ in rows():
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", t or "")].append(i)
    want = []
    for t, ids in groups.items():
        keep = min((i for i in ids if i is not None), default=None)
        want += [(i, keep, len(ids), i == keep, hashlib.sha256(t.encode()).hexdigest()) for i in ids]
    assert by_row(digest_tree.exact_dedup(docs)) == sorted(want, key=repr)
    assert digest_tree.exact_dedup(empty).count() == 0


@pytest.mark.parametrize("min_docs,batches", [(10, 4), (2, 1), (3, 7)])
def test_line_dedup(docs, min_docs, batches):
    blank = " \t\n\x0b\x0c\r"
    key = lambda x: re.sub("[A-Z]+", lambda m: m[0].lower(), x.strip(blank))
    seen = Counter(k for _, t, *_ in rows() for k in {key(x) for x in (t or "").split("\n")} if k)
    want = []
    for i, t, *_ in rows():
        lines = (t or "").split("\n")
        stay = [x for x in lines if seen[key(x)] < min_docs]
        want.append((i, len(lines), len(lines) - len(stay), "\n".join(stay)))
    got = line_runs.dedup_lines(docs, min_docs=min_docs, batches=batches)
    assert set(docs.columns) <= set(got.columns)
    assert by_row(got.select("doc_id", "n_lines", "n_dropped", "text")) == sorted(want, key=repr)


def test_line_dedup_empty(empty):
    assert line_runs.dedup_lines(empty).count() == 0


# --- near duplicates --------------------------------------------------------------------------------------------------------------

def shingles(text):
    w = words(text)
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def brute_components(items):
    sets = [(i, shingles(t)) for i, t in items if i is not None]
    root = {i: i for i, _ in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in root}


def test_near_components(docs, empty):
    found = brute_components([r[:2] for r in rows()])
    want = [(i, len(shingles(t)), found.get(i), found.get(i) == i) for i, t, *_ in rows()]
    assert by_row(minhash.near_components(docs)) == sorted(want, key=repr)
    assert minhash.near_components(empty).count() == 0


def test_near_components_chain_and_shared_passage(spark):
    """A chain whose ends are not alike, a large group, and many texts around one passage, which must stay apart."""
    rng = random.Random(8)
    new = lambda n: [f"w{rng.randrange(10**9)}" for _ in range(n)]
    items, base = [], new(80)
    for k in range(30):
        items.append((1000 - k, " ".join(base)))
        base = base[:]
        base[(7 * k) % 80] = new(1)[0]
    group = new(60)
    for k in range(120):
        w = group[:]
        for _ in range(2):
            w[rng.randrange(60)] = new(1)[0]
        items.append((2000 + k, " ".join(w)))
    passage = new(50)
    items += [(5000 + k, " ".join(new(12) + passage + new(9))) for k in range(150)]
    got = minhash.near_components(spark.createDataFrame(items, "doc_id long, text string").repartition(4))
    assert {r["doc_id"]: r["component_id"] for r in got.collect()} == brute_components(items)


def test_remaining_links_of_large_components(spark, monkeypatch):
    """Two large components of one template meet through one set each, not set by set."""
    rng = random.Random(9)
    template, seen, verified = [rng.randrange(1 << 60) for _ in range(100)], [], minhash._verified
    sets = [(k, template[:97] + [rng.randrange(1 << 60) for _ in range(3)]) for k in range(120)]
    sets.append((500, template[:40] + [rng.randrange(1 << 60) for _ in range(60)]))  # like no other
    table = spark.createDataFrame(sets, "node long, shingles array<long>")
    found = spark.createDataFrame([(k, 0 if k < 60 else 60) for k in range(120)], "node long, component long")
    shared = spark.createDataFrame([(band, k) for k, _ in sets for band in (1, 2)], "band long, node long")

    def counted(pairs, sets):
        seen.append(pairs.count())
        return verified(pairs, sets)
    monkeypatch.setattr(minhash, "_verified", counted)
    got = {r["node"]: r["component"] for r in minhash._complete(found, shared, table).collect()}
    assert {got[k] for k in range(120)} == {0} and got.get(500, 500) == 500
    assert max(seen) < 5


@pytest.mark.parametrize("block,side", [(256, 128), (16, 8)])
def test_components_apart_are_compared_in_blocks(spark, monkeypatch, block, side):
    """Clusters of near copies that are nearly alike: some join through a single pair, the others stay apart."""
    monkeypatch.setattr(minhash, "BLOCK", block)
    monkeypatch.setattr(minhash, "SIDE", side)
    rng = random.Random(10)
    new = lambda n: [rng.randrange(1 << 60) for _ in range(n)]
    base, sets, found = new(200), {}, {}
    for c in range(6):  # clusters share 170 of 200: similarity 0.74
        own = base[:170] + new(30)
        for k in range(40):
            sets[100 * c + k] = own[:198] + new(2)
            found[100 * c + k] = 100 * c
    sets[305] = sets[105][:175] + new(25)  # of cluster 3, alike to one set of cluster 1 only: 175 of 225
    pairs = [(a, b) for a in sets for b in sets if a < b and 100 * len(set(sets[a]) & set(sets[b])) >= 75 * len(set(sets[a]) | set(sets[b]))]
    root = {k: found[k] for k in sets}
    for _ in range(8):
        for a, b in pairs:
            low = min(root[a], root[b])
            for k, c in list(root.items()):
                if c in (root[a], root[b]):
                    root[k] = low
    table = spark.createDataFrame(list(sets.items()), "node long, shingles array<long>")
    shared = spark.createDataFrame([(7, k) for k in sets], "band long, node long")
    got = minhash._complete(spark.createDataFrame(list(found.items()), "node long, component long"), shared, table).collect()
    assert {r["node"]: r["component"] for r in got} == root
    assert len(set(root.values())) < 6


def test_one_template_with_many_unlike_texts(spark, monkeypatch):
    """2 000 texts of which three quarters are one template are 0.6 alike: they stay apart, and few of their pairs are ever looked at."""
    rng = random.Random(11)
    new = lambda n: [f"w{rng.randrange(10**9)}" for _ in range(n)]
    template, made, stored = new(79), {}, minhash.store_table

    def counted(frame, name):
        out = stored(frame, name)
        made[name] = max(made.get(name, 0), out.count())
        return out
    monkeypatch.setattr(minhash, "store_table", counted)
    items = [(k, " ".join(template + new(25))) for k in range(2000)]
    got = minhash.near_components(spark.createDataFrame(items, "doc_id long, text string").repartition(6)).collect()
    assert all(r["kept"] for r in got) and len(got) == 2000
    assert made["sides"] < 4000 and made["pairs"] <= 72 * 2000


def test_outliers_of_a_large_component_make_no_row_a_pair(spark, monkeypatch):
    """60 sets that are near all 200 of one component and like none: rows follow the sets in buckets, not the pairs of components and sets."""
    rng = random.Random(12)
    new = lambda n: [rng.randrange(1 << 60) for _ in range(n)]
    template, made, stored = new(200), {}, minhash.store_table
    sets = [(k, template[:195] + new(5)) for k in range(200)] + [(1000 + k, template[:168] + new(32)) for k in range(60)]  # 168 of 232: 0.724
    sets.append((999, sets[0][1][:172] + new(28)))  # 172 of 228: linked

    def counted(frame, name):
        out = stored(frame, name)
        made[name] = out.count()
        return out
    monkeypatch.setattr(minhash, "store_table", counted)
    table = spark.createDataFrame(sets, "node long, shingles array<long>")
    shared = spark.createDataFrame([(band, k) for k, _ in sets for band in range(4)], "band long, node long")
    found = spark.createDataFrame([(k, 0) for k in range(200)], "node long, component long")
    got = {r["node"]: r["component"] for r in minhash._complete(found, shared, table).collect()}
    assert got[999] == 0 and all(got.get(1000 + k, 1000 + k) == 1000 + k for k in range(60))
    assert made["sides"] <= 4 * len(sets)


def test_attach_has_one_plan_with_and_without_hot_keys(spark):
    for often in (1, 5000):
        left = spark.createDataFrame([(k, k) for k in range(9000)] + [(7, -k) for k in range(often)], "key long, v long")
        right = left.groupBy("key").count().filter("key % 2 = 1").localCheckpoint()
        for how, rows in (("inner", 4500 + often), ("left", 9000 + often)):
            out = minhash._attach(left, right, ["key"], "count", how)
            assert len(out.collect()) == rows
            assert "LeftAnti" in out._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]


def test_sketch_agreement_follows_similarity():
    rng = np.random.default_rng(1)
    for size, shared in [(40, 30), (300, 200), (2000, 1900), (7, 6)]:
        pool = rng.integers(0, 1 << 63, 2 * size, np.uint64)
        a, b = np.unique(pool[:size]), np.unique(np.concatenate([pool[:shared], pool[size : 2 * size - shared]]))
        agree = (minhash.sketch(a) == minhash.sketch(b)).mean()
        assert abs(agree - len(np.intersect1d(a, b)) / len(np.union1d(a, b))) < 0.12
    assert (minhash.sketch(np.array([5], np.uint64)) != np.uint64((1 << 64) - 1)).all()


def test_word_hashes():
    text = "Abc  def\tABC\x0bq\né abc x"
    hashes, plain = word_hashes(text.encode()), words(text)
    assert len(hashes) == len(plain)
    assert [len({h for h, w in zip(hashes, plain) if w == v}) for v in set(plain)] == [1] * len(set(plain))
    assert len(set(hashes.tolist())) == len(set(plain))
    assert len(shingle_hashes(word_hashes(b"a b"))) == 1 and not len(word_hashes(b" \n"))


# --- toxicity ---------------------------------------------------------------------------------------------------------------------

@pytest.fixture(scope="module")
def decoder(spark):
    text = "the idiot went home and the loser said hello to all of the letters in a good book while nobody was idle " * 20
    return toxicity.Decoder(toxicity.language_model(spark.createDataFrame([(1, text)], "doc_id long, text string")))


@pytest.mark.parametrize("written,meant", [("1d10t", "idiot"), ("l0$3r", "loser"), ("i.d.i.o.t", "idiot"), ("idiiiiiot", "idiot"), ("lo*ser", "loser"),
                                           ("good", "good"), ("2024", ""), ("the&&&", "the"), ("letters", "letters")])
def test_decoded_words(decoder, written, meant):
    assert decoder.word(written) == meant


def test_spaced_words_and_long_tokens(decoder):
    assert "idiot" in decoder.restore("you i d i o t you").split()
    assert decoder.spaced("no letters here") == []
    assert len(decoder.word("l0ser" * 400)) > 1000  # linear in the token


def test_viterbi_is_the_best_path(decoder):
    def paths(word, k=0):
        if k == len(word):
            yield "", 0.0
            return
        for to, letters, price in decoder.lattice(word)[k]:
            for tail, more in paths(word, to):
                yield letters + tail, price + more
    for word in ("1d10t", "looo0ser", "a@a!!b", "l|e"):
        def cost(reading, price):
            a = b = 0
            for x in reading + "\n":
                price += decoder.cost[a][b][toxicity.symbol(x)]
                a, b = b, toxicity.symbol(x)
            return price
        assert decoder.decode(word)[1] == pytest.approx(min(cost(*p) for p in paths(word)))


def test_toxicity_scores(spark, docs, labels, empty):
    rng = random.Random(4)
    texts = [" ".join(rng.choice(SYLLABLES) + rng.choice(SYLLABLES) for _ in range(30)) for _ in range(400)]
    toxic = [k % 4 == 0 for k in range(400)]
    texts = [t + (" you badword badword " if x else "") + " " + "".join(rng.choice("aeilnorst") for _ in range(14)) for (t, x) in zip(texts, toxic, strict=True)]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    marks = spark.createDataFrame([(k, int(x)) for k, x in enumerate(toxic)], "doc_id long, toxic int")
    model = toxicity.fit(table, marks)
    asked = table.unionByName(spark.createDataFrame([(-1, "so b@dw0rd and b a d w o r d here"), (-2, "calm words"), (-3, None)], table.schema))
    got = {r["doc_id"]: r["score"] for r in toxicity.scored(asked, model).collect()}
    assert all((got[k] >= 0.3) == x for k, x in enumerate(toxic))
    assert got[-1] >= 0.3 > got[-2] == got[-3] >= 0
    model = toxicity.fit(docs, labels)
    scored = toxicity.scored(docs, model)
    assert scored.columns == docs.columns and scored.filter("score BETWEEN 0 AND 1").count() == len(rows())
    assert toxicity.restored(docs, model["cost"]).count() == len(rows())
    nothing = toxicity.fit(empty, labels.limit(0))
    assert toxicity.scored(docs, nothing).select(F.max("score")).first()[0] == 0
    assert toxicity.scored(empty, nothing).count() == 0


def test_toxic_texts_with_one_footer(spark):
    """Texts that share their longest token are still texts of their own; copies of one text count once."""
    rng = random.Random(5)
    texts = [" ".join(rng.choice(SYLLABLES) + rng.choice(SYLLABLES) for _ in range(30)) for _ in range(300)]
    texts = [t + (" you badword" if k % 4 == 0 else "") + " licenselicenselicensefooter" for k, t in enumerate(texts)]
    texts += ["one rareword " + texts[1]] * 40
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    marks = spark.createDataFrame([(k, int(k % 4 == 0 or k >= 300)) for k in range(340)], "doc_id long, toxic int")
    evidence = toxicity.fit(table, marks)["evidence"]
    assert "1=badword" in evidence and "1=rareword" not in evidence


# --- decontamination --------------------------------------------------------------------------------------------------------------

def test_leaks(spark, docs, empty):
    rng = random.Random(6)
    filler = [f"f{k}" for k in range(3000)]
    item = lambda k, n: " ".join(rng.choice(filler[:600]) for _ in range(n)) + f". answer{k} is number{k} of items."
    items = [(k, item(k, 20 + 5 * k)) for k in range(8)] + [(50, "short item here"), (51, None), (52, ""), (53, "...")]
    text = {k: t for k, t in items if t}
    noise = lambda n: " ".join(rng.choice(filler) for _ in range(n))
    reworded = text[3].replace(".", " ,").upper().split()
    del reworded[4], reworded[9]
    reworded[12:12] = ["really", "so"]
    asked = [(0, f"{noise(100)} {text[0]} {noise(100)}"), (1, noise(300)), (2, " ".join(reworded)), (3, f"{text[7]}\n{text[5]}"), (4, None), (5, ""),
             (6, noise(30) + " a Short item, here " + noise(20)), (7, " ".join(text[4].split()[:8]) + noise(200)), (None, text[6])]
    got = decontam.find_leaks(spark.createDataFrame(asked, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert {(r["doc_id"], r["item_id"]) for r in got.collect()} == {(0, 0), (2, 3), (3, 7), (3, 5), (None, 6), (6, 50)}
    some = spark.createDataFrame(items, "item_id long, text string")
    assert decontam.find_leaks(docs, some).count() == 0 == decontam.find_leaks(empty, some).count()
    assert decontam.find_leaks(docs, some.limit(0)).count() == 0


def test_leak_of_a_third_of_all_rows(spark):
    """An item that very many rows hold, one of words that all rows hold, and one that few hold."""
    rng = random.Random(12)
    filler, common = [f"f{k}" for k in range(2000)], [f"c{k}" for k in range(12)]
    items = [(1, " ".join(f"hot{k}" for k in range(24))), (2, " ".join(common)), (3, " ".join(f"rare{k}" for k in range(20)))]
    asked = []
    for k in range(240):
        noise = [rng.choice(filler) for _ in range(50)]
        mixed = rng.sample(common, 12) if k % 9 != 1 else common
        asked.append((k, " ".join(noise + [w for c in mixed for w in ([c] if k % 9 == 1 else [c, *rng.choices(filler, k=6)])] + ([items[0][1]] if k % 3 == 0 else []))))
    asked.append((900, f"{asked[2][1]} {items[2][1]}"))
    got = decontam.find_leaks(spark.createDataFrame(asked, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    want = {(k, 1) for k in range(0, 240, 3)} | {(k, 2) for k in range(1, 240, 9)} | {(900, 3)}
    assert {(r["doc_id"], r["item_id"]) for r in got.collect()} == want


def test_leaks_against_brute_force(spark):
    """Short items and items of which 60 % are left, among other words of the benchmark: all that a plain search over all windows finds."""
    rng = random.Random(13)
    pool = [f"b{k}" for k in range(400)]
    items = [(k, [rng.choice(pool) for _ in range(n)]) for k, n in enumerate([33, 33, 20, 20, 12, 9, 6, 4, 40, 64, 17, 8])]
    items += [(100 + k, pool[k * 20 : k * 20 + 20]) for k in range(20)]  # every word of the pool is one of the benchmark
    asked = []
    for k in range(160):
        w = items[k % 12][1]
        gone = () if len(w) < 8 or k % 3 == 0 else rng.sample(range(len(w)), int(0.38 * len(w)))
        inner = [rng.choice(pool) if p in gone else x for p, x in enumerate(w)]
        asked.append((k, rng.choices(pool, k=rng.randrange(60)) + (inner if k % 8 else []) + rng.choices(pool, k=rng.randrange(60))))

    def common(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            old = row[:]
            for p, y in enumerate(b):
                row[p + 1] = old[p] + 1 if x == y else max(old[p + 1], row[p])
        return row[-1]

    def holds(w, doc):
        spans = [doc[p : p + len(w)] for p in range(max(1, len(doc) - len(w) + 1))]
        return w in spans if len(w) < 8 else any(len(set(w) & set(x)) >= 0.6 * len(w) and common(w, x) >= 0.6 * len(w) for x in spans)
    brute = {(k, i) for k, doc in asked for i, w in items if holds(w, doc)}
    assert {k % 12 for k, i in brute if i == k % 12} == set(range(12))
    got = decontam.find_leaks(spark.createDataFrame([(k, " ".join(d)) for k, d in asked], "doc_id long, text string"),
                              spark.createDataFrame([(i, " ".join(w)) for i, w in items], "item_id long, text string"))
    got = {(r["doc_id"], r["item_id"]) for r in got.collect()}
    assert len(brute & got) >= 0.9 * len(brute) and len(got - brute) <= 0.1 * len(brute)
    assert {x for x in brute if len(dict(items)[x[1]]) < 8} <= got


def test_heaviest_common():
    rng, weight = np.random.default_rng(2), np.array([0.0, 1.0, 2.5, 0.5, 3.0])

    def slow(a, b):
        if not len(a) or not len(b):
            return 0.0
        best = max(slow(a[1:], b), slow(a, b[1:]))
        return max(best, weight[a[0]] + slow(a[1:], b[1:])) if a[0] == b[0] else best
    for _ in range(30):
        a, b = rng.integers(0, 5, rng.integers(0, 6)), rng.integers(0, 5, rng.integers(0, 7))
        assert decontam.heaviest_common(a, b, weight) == pytest.approx(slow(a, b))


def test_latent_basis_is_the_svd(spark):
    rng = np.random.default_rng(3)
    texts = [[int(x) for x in rng.choice(30, 64, p=np.arange(1, 31) / 465)] for _ in range(200)]
    weight = np.concatenate([[0.0], rng.uniform(0.5, 2, 29)])
    numbered = spark.createDataFrame([(t,) for t in texts], "terms array<int>").repartition(3)
    basis, sigma = decontam.latent_basis(numbered, weight, 5)
    full = np.stack([np.bincount(t[k : k + 32], minlength=30) * weight for t in texts for k in (0, 32)])
    _, values, right = np.linalg.svd(full, full_matrices=False)
    right = right[:5]
    assert np.allclose(sigma, values[:5], rtol=0.05)
    assert np.linalg.svd(right @ basis)[1].min() > 0.95  # one pass over a flat spectrum


# --- personal data ----------------------------------------------------------------------------------------------------------------

PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
         "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def plain(text):
    out = []
    for k, (kind, pattern) in enumerate(PLAIN.items()):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": all(int(x) < 256 for x in m[0].split(".")) if kind == "ip" else True,
                  "card": 14 <= len(digits) <= 19 and pii._luhn(digits), "phone": 10 <= len(digits) <= 15}[kind]
            out += [(m.start(), k, m.end())] if ok else []
    return sorted(out)


def test_plain_spans():
    rng = random.Random(5)
    parts = ["a", "b.c", "@", "@x.y", ".", "-", "+", "1", "12", "300", " ", "é", "4111 1111 1111 1111", "+1 (555) 010-99 88", "1.2.3.4", "_", "%"]
    for _ in range(4000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 14)))
        assert pii.plain_spans(text) == plain(text), text
    assert pii.plain_spans("a" * 200_000 + "1" * 200_000) == []  # linear


@pytest.mark.parametrize("text,kind,disguised", [
    ("write to jоhn@exаmple.com now", "email", "jоhn@exаmple.com"),
    ("mail john.smith [at] example [dot] com please", "email", "john.smith [at] example [dot] com"),
    ("mail john at example dot com please", "email", "john at example dot com"),
    ("mail jo​hn＠example．com.", "email", "jo​hn＠example．com"),
    ("call plus one five five five zero one zero nine nine eight eight today", "phone", "plus one five five five zero one zero nine nine eight eight"),
    ("host one nine two dot one six eight dot one dot one up", "ip", "one nine two dot one six eight dot one dot one"),
    ("card ４１１１ 1111 1111 1111 ok", "card", "４１１１ 1111 1111 1111"),
])
def test_disguised_spans(text, kind, disguised):
    base, every = pii.find_spans(text)
    start = text.index(disguised)
    assert (start, pii.KINDS.index(kind), start + len(disguised)) in every
    assert set(base) <= set(every) and base == plain(text)


def test_harmless_text_has_no_spans():
    for text in ("we met at noon and saw a dot on the map", "Ünïcode à la carte", "привет мир", "one two three go", "zero tolerance at seven"):
        assert pii.find_spans(text) == ([], [])


def test_pii_table(docs, empty):
    assert pii.detect(docs).count() == len(rows()) and pii.detect(empty).count() == 0


# --- language model ---------------------------------------------------------------------------------------------------------------

def test_windows_score_each_token_once():
    for n in [1, 2, 7, 8, 9, 31, 32, 33, 55, 56, 57, 500]:
        at, scored = attention_lm.windows(n)
        assert sorted(at[scored].tolist()) == list(range(n))
        start = np.arange(len(at)) * attention_lm.STEP
        context = (at - start[:, None])[1:][scored[1:]]
        assert not len(context) or context.min() >= attention_lm.OVERLAP


def small_counts(size=30, seed=3):
    """Counts over few ids, with contexts that are not kept."""
    rng = np.random.default_rng(seed)
    tables = []
    for contexts in (range(size + 1), [7, 9], [5, 11, 13]):
        rows = [(c, y, int(rng.integers(1, 9))) for c in contexts for y in rng.choice(size, 5, replace=False)]
        totals = [(c, sum(n for x, _, n in rows if x == c) + 4) for c in contexts]
        tables.append(attention_lm.Counts.table(pa.table({"context": [r[0] for r in rows], "next": [r[1] for r in rows], "n": [r[2] for r in rows]}),
                                                pa.table({"context": [t[0] for t in totals], "n": [t[1] for t in totals]})))
    return attention_lm.Counts(size, rng.integers(0, 9, size + 1).astype(float), rng.integers(0, 3, size + 1).astype(float), *tables)


def test_counts_are_distributions():
    counts = small_counts()
    every = np.arange(31)
    for x in (0, 7, 30):
        assert counts.after_id(np.full(31, x), every)[0].sum() == pytest.approx(1)
    for context in (5, 11, 99):  # the last is not known
        share, left, _ = counts.look(counts.trie, np.full(31, context), every)
        assert share.sum() + left[0] == pytest.approx(1)


def model_inputs(rng, n=2, length=12, ids=6, dtype=np.float64):
    x = rng.integers(0, ids, (n, length + 1))
    one, two = (rng.dirichlet(np.ones(ids), (n, length)) for _ in range(2))
    pick = lambda p, y: np.take_along_axis(p, y[:, :, None], 2)[:, :, 0].astype(dtype)
    seen = rng.random((n, length, 2)).astype(dtype)
    return x, one, two, pick, seen, rng.integers(0, attention_lm.CLASSES, ids)


def random_weights(rng):
    return {k: v.astype(np.float64) + 0.4 * rng.standard_normal(v.shape) for k, v in attention_lm.first_weights().items()}


def test_attention_is_causal_and_normalised():
    rng = np.random.default_rng(0)
    w = random_weights(rng)
    x, one, two, pick, seen, class_of = model_inputs(rng)

    def probability(x, last):
        y = x[:, 1:].copy()
        y[:, -1] = last
        return attention_lm.forward(w, x[:, :-1], y, class_of, pick(one, y), pick(two, y), seen)["p"]
    assert np.allclose(sum(probability(x, k)[:, -1] for k in range(6)), 1)
    inputs = (x[:, :-1], x[:, 1:], class_of, pick(one, x[:, 1:]), pick(two, x[:, 1:]), seen)
    assert np.allclose(attention_lm.probabilities(w, *inputs), attention_lm.forward(w, *inputs)["p"])
    changed = x.copy()
    changed[:, 8:] = (changed[:, 8:] + 1) % 6
    assert np.allclose(probability(x, 0)[:, :7], probability(changed, 0)[:, :7])


def test_gradients_match_differences():
    rng = np.random.default_rng(1)
    w = random_weights(rng)
    x, one, two, pick, seen, class_of = model_inputs(rng, 3, 10)
    y, m = x[:, 1:], rng.random((3, 10)) < 0.8
    inputs = (x[:, :-1], y, class_of, pick(one, y), pick(two, y), seen)
    loss = lambda: -(np.log(attention_lm.forward(w, *inputs)["p"]) * m).sum() / m.sum()
    grads = attention_lm.gradients(w, m, *inputs)
    assert set(grads) == set(w)
    for k, g in grads.items():
        at = np.unravel_index(np.argmax(np.abs(g)), g.shape)
        keep = w[k][at]
        w[k][at] = keep + 1e-5
        up = loss()
        w[k][at] = keep - 1e-5
        down = loss()
        w[k][at] = keep
        assert g[at] == pytest.approx((up - down) / 2e-5, rel=2e-3), k


def plain_text_score(model, words, ranks):
    """Log10 probability of one text, id by id, in plain Python over dictionaries."""
    counts, w, class_of = model["counts"], model["weights"], model["class_of"]
    end, subwords = len(class_of) - 1, attention_lm.Subwords(ranks)
    dictionary = {}
    for name in ("pairs", "words", "trie"):
        t = getattr(counts, name)
        ends = [*t["first"][1:], len(t["next"])]
        dictionary[name] = {int(c): ({int(t["next"][k]): int(t["n"][k]) for k in range(a, b)}, int(t["total"][q]), float(t["left"][q]), float(t["all"][q]))
                            for q, (c, a, b) in enumerate(zip(t["names"], t["first"], ends, strict=True))}

    def look(name, context, y):
        found = dictionary[name].get(int(context))
        return (0.0, 1.0, 0) if found is None else (found[0].get(int(y), 0) / found[3], found[2] / found[3], found[1])
    ids, one, two, seen = [end], [], [], []
    before = [end]
    for word in [*words, attention_lm.END]:
        now = subwords.encode(word)
        for k, y in enumerate(now):
            share, left, times = look("pairs", ids[-1], y)
            p = share + left * counts.single[y]
            if k:
                h, left_h, starts = look("trie", attention_lm.prefixes(now)[k - 1], y)
                a, b = p, h + left_h * p
            else:
                share, left, _ = look("words", attention_lm.prefixes(before)[-1], y)
                done, left_h, starts = look("trie", attention_lm.prefixes(before)[-1], attention_lm.WORD_END)
                a = share + left * p
                b = done * counts.first[y] + left_h * p
            ids.append(y)
            one.append(a)
            two.append(b)
            seen.append((math.log1p(times), math.log1p(starts)))
        before = now
    total = 0.0
    for t in range(len(one)):
        low = 0 if t < attention_lm.WINDOW else (t - attention_lm.OVERLAP) // attention_lm.STEP * attention_lm.STEP
        c = class_of[ids[t]]
        weight, copied, value = [], 0.0, np.zeros(3)
        for j in range(low, t):
            same = j > low and ids[j] == ids[t]
            twice = same and j - 1 > low and ids[j - 1] == ids[t - 1]
            s = w["query"][c] @ w["key"][class_of[ids[j]]] + w["near"][t - j] + w["same"][0] * same + w["same"][1] * twice
            weight.append(math.exp(min(s, 30)))
        rest = math.exp(min(w["rest"][c], 30))
        z = sum(weight) + rest
        for j, a in zip(range(low, t), weight, strict=True):
            copied += a / z * (ids[j + 1] == ids[t + 1])
            value += a / z * w["value"][class_of[ids[j]]]
        copied += rest / z * two[t]
        gate = np.exp(w["gate"][c] + value + np.array(seen[t]) @ w["seen"])
        total += math.log10(gate / gate.sum() @ np.array([one[t], two[t], copied]))
    return total


def trained_model(texts, rng):
    words = Counter(w for t in texts for w in [*t, attention_lm.END])
    rows = [pa.RecordBatch.from_arrays([pa.array(list(words), pa.binary()), pa.array(list(words.values()), pa.int64())], ["word", "c"]),
            pa.RecordBatch.from_arrays([pa.array([b" ".join(t) for t in texts], pa.binary())], ["raw"])]
    tables = defaultdict(Counter)
    for function, batch in zip((attention_lm._beginnings(RANKS), attention_lm._between(RANKS)), rows, strict=True):
        for out in function([batch]):
            for kind, x, y, n in zip(*(out.column(k).to_pylist() for k in range(4)), strict=True):
                tables[kind][x, y] += n
    size = attention_lm.Subwords(RANKS).size
    single, first = np.zeros(size + 1), np.zeros(size + 1)
    for (_, y), n in tables[0].items():
        single[y] += n
    for (_, y), n in tables[2].items():
        first[y] += n
    kept = []
    for kind in (0, 3, 1):
        rows = [(x, y, n) for (x, y), n in tables[kind].items() if n > 1]
        totals = Counter()
        for (x, _), n in tables[kind].items():
            totals[x] += n
        kept.append(attention_lm.Counts.table(pa.table({"context": pa.array([r[0] for r in rows], pa.int64()), "next": pa.array([r[1] for r in rows], pa.int64()), "n": pa.array([r[2] for r in rows], pa.int64())}),
                                              pa.table({"context": pa.array(list(totals), pa.int64()), "n": pa.array(list(totals.values()), pa.int64())})))
    class_of = attention_lm.subword_classes(dict(words), attention_lm.Subwords(RANKS))
    return {"counts": attention_lm.Counts(size, single, first, *kept), "class_of": class_of,
            "weights": {k: v + 0.3 * rng.standard_normal(v.shape).astype(np.float32) for k, v in attention_lm.first_weights().items()}}


def test_scores_equal_a_plain_loop():
    rng = random.Random(5)
    texts = [[w.encode() for w in words(t)] for _, t, *_ in rows() if t][:40]
    model = trained_model(texts[:25], np.random.default_rng(2))
    asked = [*texts[20:32], [], [b"new"], [rng.choice(texts[10]) for _ in range(260)]]
    asked = [t for t in asked if len(t) < 400]
    got = attention_lm.text_scores(model, *attention_lm.Reader(model["counts"], RANKS).read(asked))
    want = [plain_text_score(model, t, RANKS) for t in asked]
    assert np.allclose(got, want, rtol=2e-4, atol=1e-3)


def held(i, modulus, rest):
    return i is None or zlib.crc32(str(i).encode()) % modulus == rest


def test_lm_scores(docs, empty):
    counts = Counter(w for i, t, *_ in rows() if not held(i, 7, 2) for w in [*words(t), "\n"])
    total, distinct = sum(counts.values()), len(counts)
    want = []
    for i, t, *_ in rows():
        w = [*words(t), "\n"]
        base = sum(np.log10((counts[x] + 1) / (total + distinct + 1)) for x in w)
        want.append((i, held(i, 7, 2), len(w), sum(counts[x] > 0 for x in w), total, round(base, 6)))
    got = attention_lm.score(docs, RANKS).collect()
    assert sorted([(*r[:5], round(r[5], 6)) for r in map(tuple, got)], key=repr) == sorted(want, key=repr)
    assert all(r["score"] < 0 for r in got)
    assert attention_lm.score(empty, RANKS).count() == 0


def test_lm_learns():
    """Trained weights do better on unseen text than the first ones: a mark comes back after a gap, which counts of neighbours can't say."""
    rng, order = random.Random(9), "a b c d e f g h".split()
    texts = []
    for _ in range(300):
        mark = rng.choice(order)
        texts.append([w.encode() for _ in range(12) for w in f"{mark} x y {mark}".split()])
    model = trained_model(texts[:250], np.random.default_rng(4))
    model["weights"] = attention_lm.first_weights()
    reader = attention_lm.Reader(model["counts"], RANKS)
    train, unseen = reader.read(texts[:250]), reader.read(texts[250:])
    before = attention_lm.text_scores(model, *unseen).sum()
    for k in range(12):
        model["weights"], _ = attention_lm.train_locally(model["weights"], model["class_of"], *train, k)
    after = attention_lm.text_scores(model, *unseen).sum()
    assert after > 0.6 * before and after > np.log10(np.maximum(unseen[0]["two"], 1e-30)).sum()


def test_lm_trains_on_every_row(spark):
    """Each training text alone moves the weights, whatever its id."""
    for i in range(4):
        training = spark.createDataFrame([(i, "a b a b c a b".encode())], "doc_id long, raw binary")
        words = attention_lm.word_counts(training)
        head = {bytes(r["word"]): r["c"] for r in words.collect()}
        weights, first = attention_lm.fit(training, words, head, RANKS)["weights"], attention_lm.first_weights()
        assert any((weights[k] != first[k]).any() for k in first)


# --- packing ----------------------------------------------------------------------------------------------------------------------

def test_packing_round_trip(docs, empty):
    encode = packing.Encoder(VOCABULARY, None)
    want = Counter((i, tuple(encode(t or "").tolist() + [0])) for i, t, *_ in rows())
    pieces = packing.pack(docs, VOCABULARY, RANKS).collect()
    places = defaultdict(list)
    for p in pieces:
        assert len(p["ids"]) == 4 * p["length"] > 0
        places[p["sequence_id"]].append((p["offset"], p["length"]))
    for spots in places.values():
        end = 0
        for offset, length in sorted(spots):
            assert offset == end
            end += length
        assert end <= 1024
    # rows that repeat an id are told apart by their sum only
    assert sum(p["length"] for p in pieces) == sum(len(ids) * n for (_, ids), n in want.items())
    once = {i: ids for (i, ids), n in want.items() if i is not None and n == 1}
    for i, ids in once.items():
        parts = sorted((p["start"], bytes(p["ids"])) for p in pieces if p["doc_id"] == i)
        assert np.frombuffer(b"".join(b for _, b in parts), "<u4").tolist() == list(ids)
        assert all(p["doc_tokens"] == len(ids) for p in pieces if p["doc_id"] == i)
    assert packing.pack(empty, VOCABULARY, RANKS).count() == 0


def test_cut_rest():
    for n in range(1, 1024):
        pieces = packing.cut_rest(n)
        assert sum(pieces) == n
        for p in pieces:
            full = 1024 // p
            assert p <= packing.WHOLE or p == 1024 // full or full * p >= (1 - packing.SLACK) * 1024


def test_special_strings_follow_the_tokenizer():
    fast, slow = packing.Encoder(VOCABULARY, RANKS), packing.Encoder(VOCABULARY, None)
    for text in ("a <|endoftext|> b", "plain  text\n\n x", "éß 你好 \U0001f600", "", "\x00\x7f"):
        assert fast(text).tolist() == slow(text).tolist()


# --- quality and language ---------------------------------------------------------------------------------------------------------

def test_quality(spark, docs, labels, empty):
    rng = random.Random(2)
    good = [" ".join(rng.choice(SYLLABLES) + rng.choice(SYLLABLES) for _ in range(60)) + "." for _ in range(150)]
    junk = [" ".join(rng.choice(SYLLABLES).upper() + "!!" for _ in range(60)) for _ in range(60)]
    table = spark.createDataFrame(list(enumerate(good + junk)), "doc_id long, text string")
    marks = spark.createDataFrame([(k, int(k < 150)) for k in range(210)], "doc_id long, quality int")
    model = quality.fit(table, marks)
    got = {r["doc_id"]: r["score"] for r in quality.score(table, model).collect()}
    assert np.mean([(got[k] >= 0.3) == (k < 150) for k in got]) > 0.97
    # the votes are those of a plain loop over all labelled vectors
    v = quality._unit(quality.vectors([good[0].encode()], model["idf"]) @ model["basis"])[0]
    near = model["points"] @ v
    best = np.argsort(-near, kind="stable")[: quality.NEIGHBOURS]
    pull = np.maximum(near[best], 1e-3) ** quality.SHARPNESS
    assert got[0] == pytest.approx(float((pull * model["labels"][best]).sum() / pull.sum()), abs=1e-4)
    model = quality.fit(docs, labels)
    assert quality.score(docs, model).filter("score BETWEEN 0 AND 1").count() == len(rows())
    nothing = quality.fit(empty, labels)
    assert {r["score"] for r in quality.score(docs, nothing).collect()} == {0.5}
    assert quality.score(empty, nothing).count() == 0


def test_language(spark, docs, empty):
    rng = random.Random(7)
    kinds = {"aa": "ka lo mi tu re".split(), "bb": "str zwo pfi gnu ach".split()}
    text = lambda lang: " ".join("".join(rng.choice(kinds[lang]) for _ in range(3)) for _ in range(40))
    table = spark.createDataFrame([(k, text(lang), lang) for k, lang in enumerate(["aa", "bb"] * 40)], "doc_id long, text string, lang string")
    known = langid.learn_dictionaries(table)
    assert sorted(known) == ["aa", "bb"]
    asked = table.unionByName(spark.createDataFrame([(-1, None, None), (-2, "", None), (-3, "123 !?", None), (-4, text("bb").upper() * 500, None)], table.schema))
    got = {r["doc_id"]: r for r in langid.identify(asked, known).collect()}
    assert all(got[k]["lang_pred"] == lang for k, lang in enumerate(["aa", "bb"] * 40))
    assert all(got[k]["lang_pred"] == "und" and got[k]["score"] == 0 for k in (-1, -2, -3)) and got[-4]["lang_pred"] == "bb"
    assert langid.identify(docs, langid.learn_dictionaries(docs)).filter("score BETWEEN 0 AND 1").count() == len(rows())
    assert {r["lang_pred"] for r in langid.identify(docs, langid.learn_dictionaries(empty)).collect()} == {"und"}
    assert langid.identify(empty, known).count() == 0
