"""Ranked lexical search over norm buckets.

A document's impact vector has, for each term of the items, ``w * ((1000000000 * tf) div (1000 * tf + 8 * m))``; an item is the vector of ones over
its terms, so a score is their inner product. Vectors are stored by length (Euclidean norm) and searched in buckets from the longest on; the k-th best
score of each item after one bucket is its threshold in the next. Inside a bucket a task takes its vectors in blocks of similar length and for each item

* leaves the block if sqrt(number of terms) * longest vector, or the sum of the terms' largest coordinates, stays under the threshold;
* else splits the item's terms, rarest first, so that the last ones together stay under it in the same two ways: only documents that hold one of the
  first terms can reach the threshold, and their postings give candidates with partial sums;
* drops candidates whose partial sum and bound on the rest stay under it, and adds up the rest of the others exactly, in integers.

Nothing is left out that could reach a threshold, so the result is exact. Each task hands on its k best of an item at most.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docloom.llm.common import raw_text
from docloom.session import store_table

#: Items searched in one go; their terms are what is broadcast.
ITEMS = 20_000
#: Shares of the vectors, by falling norm, at which buckets end.
BUCKETS = (1 / 64, 1 / 8)
#: Vectors, entries and (item, vector) cells of a block.
ROWS, ENTRIES, CELLS = 1024, 400_000, 1_000_000
MEMO = 400_000
NO_ID = (1 << 63) - 1

# Bytes of a term are digits, letters and all beyond ASCII; only A-Z are lower-cased.
_TERM = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(_TERM).split()


def impacts(weight: np.ndarray, tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return weight * ((1_000_000_000 * tf) // (1000 * tf + 8 * m))


def weights(total: int, df: np.ndarray) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * total + 2) / (2 * d + 1))) for d in df.tolist()], np.int64)


def _counter(vocabulary):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = vocabulary.value.get
        for batch in batches:
            ids, sizes, terms, tfs, ends = [], [], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [0]
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                words = terms_of(text.as_py())
                if words:
                    found, n = np.unique(np.array([k for k in map(get, words) if k is not None], np.int64), return_counts=True)
                    ids.append(doc_id)
                    sizes.append(len(words))
                    terms.append(found)
                    tfs.append(n)
                    ends.append(ends[-1] + len(found))
            offsets = pa.array(ends, pa.int32())
            lists = [pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(x), pa.int32())) for x in (terms, tfs)]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), *lists], ["doc_id", "n", "terms", "tfs"])
    return count


def _holders(size: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            total += np.bincount(batch.column(0).flatten().to_numpy(), minlength=size)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int32()), pa.array(total[seen], pa.int64())], ["term", "df"])
    return count


def _vectors(shared, total: int, length: int):
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight = shared.value
        for batch in batches:
            sizes = np.diff(batch.column(2).offsets.to_numpy())
            terms, tf = batch.column(2).flatten().to_numpy(), batch.column(3).flatten().to_numpy().astype(np.int64)
            # 90 * n * N may pass 64 bits on very large tables, so it is worked out in Python's integers
            m = np.array([100 - 90 + (90 * n * total) // length for n in batch.column(1).to_pylist()], np.int64)
            y = impacts(weight[terms], tf, np.repeat(m, sizes))
            row = np.repeat(np.arange(len(sizes)), sizes)
            norm = np.sqrt(np.bincount(row, y.astype(np.float64) ** 2, minlength=len(sizes)))
            held = pa.ListArray.from_arrays(batch.column(2).offsets, pa.array(y))
            found = pa.RecordBatch.from_arrays([batch.column(0), pa.array(norm), batch.column(2), held], ["doc_id", "norm", "terms", "impacts"])
            yield found.filter(pa.array(norm > 0))
    return build


class Best:
    """The k best documents of each item met so far, and the score that another one must reach."""

    def __init__(self, k: int, threshold: np.ndarray):
        self.k, self.threshold = k, threshold.copy()
        self.item, self.score, self.doc = (np.zeros(0, np.int64) for _ in range(3))

    def add(self, item: np.ndarray, score: np.ndarray, doc: np.ndarray) -> None:
        item, score, doc = (np.concatenate(x) for x in ((self.item, item), (self.score, score), (self.doc, doc)))
        order = np.lexsort((doc, -score, item))
        item = item[order]
        place = np.arange(len(item)) - np.searchsorted(item, item)
        order = order[place < self.k]
        full = item[place == self.k - 1]
        self.item, self.score, self.doc = item[place < self.k], score[order], doc[order]
        last = self.score[np.searchsorted(self.item, full, "right") - 1]
        self.threshold[full] = np.maximum(self.threshold[full], last)


class Items:
    """Terms of each item, rarest first, as one flat list."""

    def __init__(self, terms: list[np.ndarray], weight: np.ndarray):
        kept = [t[np.lexsort((t, -weight[t]))] for t in (t[weight[t] > 0] for t in terms)]
        self.sizes = np.array([len(t) for t in kept], np.int64)
        self.ends = np.concatenate([[0], np.cumsum(self.sizes)])
        self.term = np.concatenate([np.zeros(0, np.int64), *kept])
        self.of = np.repeat(np.arange(len(kept)), self.sizes)


def search_block(items: Items, best: Best, doc: np.ndarray, norm: np.ndarray, ends: np.ndarray, term: np.ndarray, impact: np.ndarray, n_terms: int) -> int:
    """Add what a block of vectors holds to ``best``; the number of candidates that were added up."""
    n, longest = len(doc), float(norm.max())
    row = np.repeat(np.arange(n), np.diff(ends))
    by_term = np.lexsort((row, term))
    first = np.searchsorted(term[by_term], np.arange(n_terms + 1))
    largest = np.zeros(n_terms, np.int64)
    np.maximum.at(largest, term, impact)
    # bounds on what the terms of an item from each place on can add
    peak = np.concatenate([[0], np.cumsum(largest[items.term])])
    held = np.concatenate([[0], np.cumsum(largest[items.term] > 0)])
    to = items.ends[1:][items.of]
    place = np.arange(len(items.term))
    rest_peak, rest_held = peak[to] - peak[place], held[to] - held[place]
    bound = np.minimum(rest_peak, np.sqrt(rest_held) * longest * (1 + 1e-9) + 1)
    need = best.threshold[items.of]
    focus = (rest_peak > 0) & (bound >= need)  # bounds fall along an item, so these are its first terms
    cut = items.ends[:-1] + np.bincount(items.of[focus], minlength=len(items.sizes))
    after_peak = np.append(rest_peak, 0)[cut] * (cut < items.ends[1:])
    after_held = np.append(rest_held, 0)[cut] * (cut < items.ends[1:])
    key = row * np.int64(n_terms) + term  # entries of a row are in order of their terms
    added = 0
    step = max(1, CELLS // n)
    for low in range(0, len(items.sizes), step):
        high = min(len(items.sizes), low + step)
        here = np.flatnonzero(focus[items.ends[low] : items.ends[high]]) + items.ends[low]
        if not len(here):
            continue
        count = first[items.term[here] + 1] - first[items.term[here]]
        entry = by_term[np.repeat(first[items.term[here]] - (np.cumsum(count) - count), count) + np.arange(count.sum())]
        cell = np.repeat(items.of[here] - low, count) * n + row[entry]
        sums = np.bincount(cell, impact[entry].astype(np.float64), minlength=(high - low) * n)  # whole numbers under 2 ** 53: exact
        cell = np.flatnonzero(sums)
        item, at = cell // n + low, cell % n
        partial = sums[cell].astype(np.int64)
        rest = np.minimum(after_peak[item], np.sqrt(after_held[item]) * norm[at] * (1 + 1e-9) + 1)
        keep = partial + rest >= best.threshold[item]
        item, at, score = item[keep], at[keep], partial[keep]
        more = items.ends[1:][item] - cut[item]
        which = np.repeat(np.arange(len(item)), more)
        asked = at[which] * np.int64(n_terms) + items.term[np.repeat(cut[item] - (np.cumsum(more) - more), more) + np.arange(len(which))]
        found = np.minimum(np.searchsorted(key, asked), len(key) - 1)
        hit = key[found] == asked
        np.add.at(score, which[hit], impact[found[hit]])
        added += len(item)
        keep = score >= np.maximum(best.threshold[item], 1)
        best.add(item[keep], score[keep], doc[at[keep]])
    return added


def _searcher(shared, k: int):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, items, threshold, n_terms = shared.value
        best = Best(k, threshold)
        for batch in batches:
            ids = batch.column(0).fill_null(NO_ID).to_numpy()
            norm = batch.column(1).to_numpy()
            ends = batch.column(2).offsets.to_numpy().astype(np.int64)
            term, impact = batch.column(2).values.to_numpy().astype(np.int64), batch.column(3).values.to_numpy()
            at = 0
            while at < len(ids):
                to = min(len(ids), at + ROWS, max(at + 1, int(np.searchsorted(ends, ends[at] + ENTRIES, "right")) - 1))
                span = slice(ends[at], ends[to])
                search_block(items, best, ids[at:to], norm[at:to], ends[at : to + 1] - ends[at], term[span], impact[span], n_terms)
                at = to
        yield pa.RecordBatch.from_arrays([pa.array(names[best.item], pa.int64()), pa.array(best.doc), pa.array(best.score)], ["item_id", "doc_id", "score"])
    return search


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = W.partitionBy("item_id").orderBy(F.desc("score"), F.asc("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def rank_documents(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` best rows of ``docs`` for each item, those with a score above 0.

    Terms are maximal stretches of ASCII letters and digits and of all characters beyond ASCII, A-Z lower-cased. Statistics count every row with a
    term. Equal scores rank by id, rows without an id last; repeated rows rank one after the other. Rows of ``items`` with one id are one item with the
    terms of all of them; items without an id, text or term have no result, as has any item over an empty table. Other columns are ignored. Items
    are taken in blocks of ITEMS, each with a pass over the texts.
    """
    asked = items.filter("item_id IS NOT NULL AND text IS NOT NULL").select(F.col("item_id").cast("long").alias("item_id"), raw_text().alias("raw"))
    blocks = max(1, math.ceil(asked.count() / ITEMS))
    parts = [_rank_block(docs, asked.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b), k) for b in range(blocks)]
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out


def _rank_block(docs: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    session = docs.sparkSession
    terms: dict[int, set[bytes]] = {}
    for r in asked.collect():
        terms.setdefault(r["item_id"], set()).update(terms_of(bytes(r["raw"])))
    names = sorted(i for i, t in terms.items() if t)
    vocabulary = {t: n for n, t in enumerate(sorted(set().union(*terms.values())))}
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), raw_text().alias("raw"))
    counted = slim.mapInArrow(_counter(session.sparkContext.broadcast(vocabulary)), "doc_id long, n long, terms array<int>, tfs array<int>")
    counted = store_table(counted, "counted")
    total, length = counted.agg(F.count(F.lit(1)), F.sum("n")).first()
    df = np.zeros(len(vocabulary), np.int64)
    held = counted.select("terms").mapInArrow(_holders(len(vocabulary)), "term int, df long")
    for r in held.groupBy("term").agg(F.sum("df").alias("df")).collect():  # a row for each term of the items at most
        df[r["term"]] = r["df"]
    weight = weights(total, df)
    vectors = counted.mapInArrow(_vectors(session.sparkContext.broadcast(weight), total, length or 1), "doc_id long, norm double, terms array<int>, impacts array<long>")
    vectors = store_table(vectors.sortWithinPartitions(F.desc("norm")), "vectors")
    shares = [1 - s for s in BUCKETS]
    bounds = vectors.agg(F.percentile_approx("norm", shares, 10_000)).first()[0] or []
    edges = [math.inf, *bounds, 0.0]
    these = Items([np.array(sorted(vocabulary[t] for t in terms[i]), np.int64) for i in names], weight)
    numbered, threshold = np.array(names, np.int64), np.zeros(len(names), np.int64)
    found = None
    for high, low in zip(edges[:-1], edges[1:], strict=True):
        shared = session.sparkContext.broadcast((numbered, these, threshold, len(vocabulary)))
        bucket = vectors.filter((F.col("norm") < high) & (F.col("norm") >= low))
        part = store_table(_ranked(bucket.mapInArrow(_searcher(shared, k), "item_id long, doc_id long, score long"), k).drop("rank"), "bucket")
        found = part if found is None else found.unionByName(part)
        if low:
            last = _ranked(found, k).filter(F.col("rank") == k).select("item_id", "score").collect()  # an item each
            threshold = threshold.copy()
            for r in last:
                threshold[np.searchsorted(numbered, r["item_id"])] = r["score"]
    return _ranked(found, k).select("item_id", F.col("rank").cast("int").alias("rank"), F.nullif("doc_id", F.lit(NO_ID)).alias("doc_id"), "score")
