"""Near-duplicate components by fast similarity sketching, banding and exact verification.

Sketch: in round ``i`` every shingle is thrown into a hashed bin with a hashed value; a bin keeps the smallest value of the first round that
reaches it. After ``SIZE`` such rounds, bin ``b`` that is still empty takes the minimum of its own hash over all shingles, so every coordinate is
filled. Coordinates of two sets agree with the probability of their similarity and are concentrated like independent ones. ``BANDS`` bands of
``ROWS`` coordinates miss a pair of similarity 0.75 with probability (1 - 0.75 ** ROWS) ** BANDS, under one in a million.

Links: in each bucket all sets are verified against the bucket's smallest id, which settles groups of near copies in linear work. What is left
are buckets that hold sets of several components. Their sets meet inside tasks, in blocks of at most BLOCK sets of a bucket and by low bits of
two sketches only: each component first takes its nearest other set, one verified pair a component; then every block names its sets that come within
AGREE of another component's, and these are verified against each other in the same block. No row is made for a pair of sets or of components:
rows grow with the sets in mixed buckets only, and a block hands on fewer links than it has components.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import HOT_SHARE, hot_rows, mix64, raw_text, shingle_hashes, word_hashes
from docloom.session import store_table

BANDS, ROWS, SHINGLE = 72, 6, 5
SIZE = BANDS * ROWS
SHARE_NUM, SHARE_DEN = 75, 100
#: Sets are compared by four bits of each coordinate of two sketches, which agree with probability s + (1 - s) / 16. A pair is taken up if this
#: many of SIZE and of 2 * SIZE agree, each five deviations under what a similarity of 0.75 gives: under one such pair in a million is missed.
AGREE = (287, 600)
#: Sets of one bucket that meet in one block by their sketches, and shingles of one side of a block whose sets are verified.
BLOCK, SIDE = 1024, 1 << 21
#: Rows of one leader that meet one copy of its set.
SPREAD = 256

_SEEDS = mix64(np.arange(1, 2 * SIZE + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
_SALT = mix64(np.arange(1, BANDS + 1, dtype=np.uint64))


def sketch(shingles: np.ndarray) -> np.ndarray:
    """SIZE coordinates of a non-empty set of hashes."""
    n, empty = len(shingles), np.uint64((1 << 64) - 1)
    out = np.full(SIZE, empty, np.uint64)
    at, step = 0, max(1, 1500 // n)
    while at < SIZE:
        rounds = np.arange(at, min(SIZE, at + step))
        h = mix64(shingles[None, :] ^ _SEEDS[rounds][:, None])
        value = (rounds[:, None].astype(np.uint64) << np.uint64(39)) | (h & np.uint64((1 << 39) - 1))
        key = np.sort((((h >> np.uint64(39)) % np.uint64(SIZE)) << np.uint64(48) | value).ravel())
        bins = (key >> np.uint64(48)).astype(np.intp)
        first = np.concatenate([[0], np.flatnonzero(bins[1:] != bins[:-1]) + 1])
        first = first[out[bins[first]] == empty]
        out[bins[first]] = key[first] & np.uint64((1 << 48) - 1)
        if not (out == empty).any():
            return out
        at += step
    for b in np.flatnonzero(out == empty):
        out[b] = (np.uint64(SIZE + b) << np.uint64(39)) | (mix64(shingles ^ _SEEDS[SIZE + b]).min() & np.uint64((1 << 39) - 1))
    return out


def band_keys(coordinates: np.ndarray) -> np.ndarray:
    key = _SALT.copy()
    for k in range(ROWS):
        key = mix64(key * np.uint64(0x9E3779B97F4A7C15) + coordinates[k::ROWS])
    return key.view(np.int64)


def _profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    nothing = np.zeros(0, np.int64)
    for batch in batches:
        sizes, ones, twos, bands = [], [], [], []
        for text in batch.column(1):
            s = shingle_hashes(word_hashes(text.as_py()), SHINGLE)
            sizes.append(len(s))
            ones.append(int(mix64(s ^ np.uint64(0xA5A5A5A5)).sum().view(np.int64)) if len(s) else 0)
            twos.append(int(mix64(s + np.uint64(0x5BD1E995)).sum().view(np.int64)) if len(s) else 0)
            bands.append(band_keys(sketch(s)) if len(s) else nothing)
        at = np.cumsum([0, *map(len, bands)])
        lists = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(np.concatenate([nothing, *bands])))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(ones, pa.int64()), pa.array(twos, pa.int64()), lists],
                                         ["doc_id", "n_shingles", "one", "two", "bands"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 500):
            part = batch.slice(at, 500)
            found = [shingle_hashes(word_hashes(t.as_py()), SHINGLE).view(np.int64) for t in part.column(1)]
            ends = np.cumsum([0, *map(len, found)])
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int64), *found])))
            yield pa.RecordBatch.from_arrays([part.column(0), lists], ["node", "shingles"])


def _attach(left: DataFrame, right: DataFrame, key: list[str], count: str, how: str) -> DataFrame:
    """Join with a table of unique keys that knows how many rows of ``left`` hold each: the few hot ones and the commonest are broadcast, the rest
    shuffled. As the commonest always counts as hot, the plan is the same for tables with and without hot keys."""
    total, most = right.agg(F.sum(count), F.max(F.struct(count, *key))).first()
    if most is None:
        return left.join(right, key, how)
    hot = right.filter((F.col(count) * HOT_SHARE > total) | reduce(and_, [F.col(k) == most[k] for k in key]))
    often = left.join(F.broadcast(hot), key)
    return often.unionByName(left.join(F.broadcast(hot.select(*key)), key, "left_anti").join(right, key, how))


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets reach the similarity. A node in many pairs gets as many copies of its set as it has SPREAD pairs."""
    degrees = store_table(pairs.groupBy("a").agg(F.count(F.lit(1)).alias("n_pairs")), "degrees")
    copies = F.ceil(F.col("n_pairs") / SPREAD).cast("int")
    hot = hot_rows(degrees, "n_pairs").select("a", copies.alias("n_copies"))
    dealt = pairs.join(F.broadcast(hot), "a", "left").withColumn("copy", F.pmod(F.xxhash64("b"), F.coalesce("n_copies", F.lit(1))).cast("int"))
    right = sets.join(hot.withColumnRenamed("a", "node"), "node", "left")
    right = right.withColumn("copy", F.explode(F.sequence(F.lit(0), F.coalesce("n_copies", F.lit(1)) - 1)))
    right = right.select(F.col("node").alias("a"), "copy", F.col("shingles").alias("of_a"))
    left = dealt.select("a", "b", "copy").join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("of_b")), "b")
    both = left.join(right, ["a", "copy"])
    common, total = F.size(F.array_intersect("of_a", "of_b")), F.size("of_a") + F.size("of_b")
    return both.filter(SHARE_DEN * common >= SHARE_NUM * (total - common)).select("a", "b").distinct()


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of the links (a, b): the smallest node reachable. Large-star and small-star rounds contract every
    component to a star in a logarithmic number of rounds. The minimum of a node is stored before it is joined, so that Spark can split the
    rows of a node with very many links over tasks."""
    edges = store_table(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "edges")

    def star(edges: DataFrame, large: bool) -> DataFrame:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
        least = store_table(both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m")), "stars")
        met = both.join(least, "u")
        if large:
            out = met.filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        else:
            out = met.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        return store_table(out.filter("u <> v").distinct(), "edges")

    for _ in range(max_rounds):
        edges = star(star(edges, True), False)
        ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("of"), F.lit(0).alias("at")).unionByName(
            edges.select(F.col("v").alias("node"), F.lit(0).alias("of"), F.lit(1).alias("at")))
        roles = ends.groupBy("node").agg(F.sum("of").alias("of"), F.max("at").alias("at"))
        if roles.filter((F.col("of") > 1) | (F.col("of") > 0) & (F.col("at") > 0)).isEmpty():  # only stars are left
            break
    else:
        raise RuntimeError("components did not settle")
    members = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return members.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()


def _faces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Low bits of two sketches of each of a table of sets."""
    low = np.uint64(15)
    for batch in batches:
        sizes = np.diff(batch.column(1).offsets.to_numpy())
        found = []
        for held in batch.column(1):
            s = held.values.to_numpy().view(np.uint64)
            found.append(((sketch(s) & low) | ((sketch(mix64(s)) & low) << np.uint64(4))).astype(np.uint8).tobytes())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(found, pa.binary())], ["node", "size", "face"])


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Rows with equal values in the first ``keys`` columns, of batches sorted by them."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        key = np.stack([batch.column(k).to_numpy() for k in range(keys)], 1)
        cuts = np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1
        for low, high in zip([0, *cuts], [*cuts, len(key)], strict=True):
            if held and (key[low] != last).any():
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(low, high - low))
            last = key[low]
    if held:
        yield pa.Table.from_batches(held)


def _near(table: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(first sets, second sets, agreement) of a block: places of its sets of different components, near enough in size and sketch."""
    low, high, part, comp, size = (table.column(k).to_numpy() for k in (1, 2, 3, 5, 6))
    face = np.frombuffer(b"".join(table.column(7).to_pylist()), np.uint8).reshape(-1, SIZE)
    left, right = face & 15, face >> 4
    across = low[0] != high[0]
    one, two = (np.flatnonzero(part == low[0]), np.flatnonzero(part == high[0])) if across else (np.arange(len(comp)),) * 2
    if not across:  # sets of the commonest component only meet the others
        values, counts = np.unique(comp, return_counts=True)
        one = np.flatnonzero(comp != values[np.argmax(counts)])
    for at in range(0, len(one), 32):
        x = one[at : at + 32]
        fit = (comp[x][:, None] != comp[two][None]) & (SHARE_DEN * np.minimum(size[x][:, None], size[two][None]) >= SHARE_NUM * np.maximum(size[x][:, None], size[two][None]))
        columns = np.flatnonzero(fit.any(0))
        if len(columns):
            y = two[columns]
            agree = (left[x][:, None] == left[y][None]).sum(2, dtype=np.int32)
            i, j = np.nonzero(fit[:, columns] & (agree >= AGREE[0]))
            total = agree[i, j] + (right[x[i]] == right[y[j]]).sum(1)
            good = total >= AGREE[1]
            yield x[i[good]], y[j[good]], total[good]


def _nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each component of a block the pair with another one's set that agrees most; ties go to the smallest ids."""
    for table in _groups(batches, 3):
        node, comp = table.column(4).to_numpy(), table.column(5).to_numpy()
        best: dict[int, tuple] = {}
        for x, y, agree in _near(table):
            for a, b in ((x, y), (y, x)):
                order = np.lexsort((node[b], node[a], -agree, comp[a]))
                c = comp[a][order]
                order = order[np.concatenate([[True], c[1:] != c[:-1]])] if len(order) else order
                for k in order.tolist():
                    found = (-int(agree[k]), int(node[a[k]]), int(node[b[k]]))
                    if found < best.get(int(comp[a[k]]), (0,)):
                        best[int(comp[a[k]])] = found
        rows = [(c, -f[0], f[1], f[2]) for c, f in best.items()]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(4)], ["component", "agree", "a", "b"])


def _sides(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(band, low, high, i, j, node, component): the sets of each block that are near one of another component. Where they have more than SIDE shingles
    they are cut in parts, and every two parts ``i`` and ``j`` meet."""
    for table in _groups(batches, 3):
        node, comp, size = (table.column(k).to_numpy() for k in (4, 5, 6))
        near = np.zeros(len(node), bool)
        for x, y, _ in _near(table):
            near[x] = near[y] = True
        names, first, of = np.unique(node[near], return_index=True, return_inverse=True)
        if not len(names):
            continue
        part = np.unique((np.cumsum(np.bincount(of, size[near])) - 1) // SIDE, return_inverse=True)[1]
        n = int(part.max()) + 1
        own = np.repeat(np.arange(len(names)), n)
        other = np.tile(np.arange(n), len(names))
        if n > 1:
            own, other = own[part[own] != other], other[part[own] != other]
        key = [np.full(len(own), table.column(k)[0].as_py(), np.int64) for k in range(3)]
        values = [*key, np.minimum(part[own], other), np.maximum(part[own], other), names[own], comp[near][first][own]]
        yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in values], ["band", "low", "high", "i", "j", "node", "component"])


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links between the components of each block of sets that join all it can join: fewer than it has components."""
    for table in _groups(batches, 5):
        node, comp = (table.column(k).to_numpy() for k in (5, 6))
        sets = [s.values.to_numpy() for s in table.column(7)]
        sizes = np.array([len(s) for s in sets])
        values, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
        order = np.argsort(values, kind="stable")
        values, owner = values[order], owner[order]
        commonest, of = np.unique(comp, return_inverse=True)
        one = np.flatnonzero(of != np.argmax(np.bincount(of, minlength=len(commonest))))  # sets of the commonest component only meet the others
        rows = []
        for a in one[np.argsort(node[one], kind="stable")].tolist():
            if (of == of[a]).all():
                break
            low, high = np.searchsorted(values, sets[a]), np.searchsorted(values, sets[a], "right")
            count = high - low
            at = np.repeat(low - (np.cumsum(count) - count), count) + np.arange(count.sum())
            common = np.bincount(owner[at], minlength=len(sets))
            good = np.flatnonzero((of != of[a]) & (SHARE_DEN * common >= SHARE_NUM * (len(sets[a]) + sizes - common)))
            while len(good):
                b = good[np.argmin(node[good])]
                rows.append((int(node[a]), int(node[b])))
                of[of == of[b]] = of[a]
                good = good[of[good] != of[a]]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(2)], ["a", "b"])


def _blocks(placed: DataFrame, mixed: DataFrame, faces: DataFrame) -> DataFrame:
    """(band, low, high, part, node, component, size, face): the sets of mixed buckets, dealt to blocks of about BLOCK sets. A bucket of more sets is
    cut in parts by a hash, and each part goes to a block with every part."""
    parts = F.ceil(F.col("n") / BLOCK).cast("int")
    rows = _attach(placed, mixed, ["band"], "n", "inner").withColumn("parts", parts)
    rows = rows.withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")).join(faces, "node")
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    rows = rows.select("band", F.least("part", "other").alias("low"), F.greatest("part", "other").alias("high"), "part", "node", "component", "size", "face")
    return rows.repartition("band", "low", "high").sortWithinPartitions("band", "low", "high", "node")


def _with_sets(rows: DataFrame, sets: DataFrame) -> DataFrame:
    """Join with the sets of the nodes. A node in many rows gets as many copies of its set as it has SPREAD rows."""
    degrees = store_table(rows.groupBy("node").agg(F.count(F.lit(1)).alias("n_rows")), "degrees")
    hot = hot_rows(degrees, "n_rows").select("node", F.ceil(F.col("n_rows") / SPREAD).cast("int").alias("n_copies"))
    dealt = rows.join(F.broadcast(hot), "node", "left")
    dealt = dealt.withColumn("copy", F.pmod(F.xxhash64("band", "low", "high", "i", "j"), F.coalesce("n_copies", F.lit(1))).cast("int")).drop("n_copies")
    copies = sets.join(F.broadcast(hot), "node", "left").withColumn("copy", F.explode(F.sequence(F.lit(0), F.coalesce("n_copies", F.lit(1)) - 1)))
    return dealt.join(copies.select("node", "copy", "shingles"), ["node", "copy"]).drop("copy")


def _joined(found: DataFrame, links: DataFrame) -> DataFrame:
    """(node, component) after more links between nodes. Only the components that the links join are worked on."""
    named = links.select("a", "b")
    for side in ("a", "b"):
        own = found.select(F.col("node").alias(side), F.col("component").alias(f"c{side}"))
        named = named.join(own, side, "left").withColumn(side, F.coalesce(f"c{side}", side)).drop(f"c{side}")
    merged = components(named).select(F.col("node").alias("component"), F.col("component").alias("joined"))
    kept = found.join(merged, "component", "left").select("node", F.coalesce("joined", "component").alias("component"))
    single = merged.join(found.select(F.col("node").alias("component")), "component", "left_anti")  # nodes that had no link so far
    return store_table(kept.unionByName(single.select(F.col("component").alias("node"), F.col("joined").alias("component"))), "components")


def _mixed(placed: DataFrame) -> DataFrame:
    """The buckets that hold several components, with their sizes."""
    spans = placed.groupBy("band").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count(F.lit(1)).alias("n"))
    return store_table(spans.filter("low <> high").select("band", "n"), "mixed")


def _complete(found: DataFrame, shared: DataFrame, sets: DataFrame) -> DataFrame:
    """``found`` after every link between components that share a bucket."""
    def place(found: DataFrame) -> DataFrame:
        placed = shared.select("band", "node").join(found, "node", "left")
        return store_table(placed.select("band", "node", F.coalesce("component", "node").alias("component")), "placed")

    placed = place(found)
    mixed = _mixed(placed)
    if mixed.isEmpty():
        return found
    opened = _attach(placed, mixed, ["band"], "n", "inner").select("node").distinct()
    faces = store_table(sets.join(opened, "node", "left_semi").mapInArrow(_faces, "node long, size long, face binary"), "faces")
    nearest = _blocks(placed, mixed, faces).mapInArrow(_nearest, "component long, agree long, a long, b long")
    nearest = nearest.groupBy("component").agg(F.min_by(F.struct("a", "b"), F.struct(-F.col("agree"), "a", "b")).alias("pair"))
    pairs = nearest.select(F.least("pair.a", "pair.b").alias("a"), F.greatest("pair.a", "pair.b").alias("b")).distinct()
    links = store_table(_verified(store_table(pairs, "pairs"), sets), "links")
    if not links.isEmpty():
        found = _joined(found, links)
        placed = place(found)
        mixed = _mixed(placed)
        if mixed.isEmpty():
            return found
    block = ["band", "low", "high", "i", "j"]
    kind = ", ".join(f"{c} long" for c in [*block, "node", "component"])
    sides = store_table(_blocks(placed, mixed, faces).mapInArrow(_sides, kind), "sides")
    dealt = _with_sets(sides, sets).select(*block, "node", "component", "shingles").repartition(*block).sortWithinPartitions(*block)
    links = store_table(dealt.mapInArrow(_linked, "a long, b long"), "links")
    return found if links.isEmpty() else _joined(found, links)


def near_components(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), a row for each row of ``docs``.

    Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased; a row's set are its distinct five-word shingles (64-bit hashes), the whole sequence if
    it is shorter. Rows without words have no set and are linked with nothing, as are rows without an id. ``component_id`` is the smallest id
    reachable over links, ``kept`` says that it is the row's own. Rows that share an id count as one document with several texts. Other columns
    are ignored; an empty table gives an empty result.
    """
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), raw_text().alias("raw"))
    base = store_table(slim.mapInArrow(_profile, "doc_id long, n_shingles long, one long, two long, bands array<long>"), "sketches")
    key = ["n_shingles", "one", "two"]
    real = base.filter("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = real.groupBy(*key).agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("n_copies")).filter("n_copies > 1")
    classes = store_table(classes, "classes")
    rows = _attach(real, classes, key, "n_copies", "left").withColumn("rep", F.coalesce("rep", "doc_id"))
    members = store_table(rows.select("doc_id", "n_shingles", "rep"), "members")

    banded = store_table(rows.filter("doc_id = rep").select(F.col("doc_id").alias("node"), F.explode("bands").alias("band")), "bands")
    buckets = banded.groupBy("band").agg(F.min("node").alias("leader"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    buckets = store_table(buckets, "buckets")
    shared = store_table(_attach(banded, buckets, ["band"], "n", "inner").select("band", "leader", "node"), "shared")
    wanted = shared.select("node").distinct()
    sets = slim.withColumnRenamed("doc_id", "node").join(wanted, "node", "left_semi").select("node", "raw").mapInArrow(_sets, "node long, shingles array<long>")
    sets = store_table(sets, "sets")
    pairs = shared.filter("leader <> node").select(F.col("leader").alias("a"), F.col("node").alias("b")).distinct()
    links = store_table(_verified(store_table(pairs, "pairs"), sets), "links")
    found = store_table(components(links), "components")
    found = _complete(found, shared, sets)

    sizes = members.groupBy("rep").agg(F.count(F.lit(1)).alias("n"))
    named = store_table(found.withColumnRenamed("node", "rep").join(sizes, "rep"), "named")
    linked = _attach(members, named, ["rep"], "n", "left")
    linked = linked.select("doc_id", "n_shingles", F.coalesce("component", "rep").alias("component_id"))
    alone = base.filter("n_shingles = 0 OR doc_id IS NULL").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
