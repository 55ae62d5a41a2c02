"""Maximal periodic runs of words by a dictionary of basic factors.

Level ``k`` of the dictionary names every factor of ``2 ** k`` words, equal factors alike; a name of the next level is a pair of names. A run with
smallest period ``q``, ``2 ** k <= q < 2 ** (k + 1)``, starts with a factor of ``2 ** k`` words that stands again ``q`` words on. So from every
position the successors of its factor within twice the factor's length are walked. Successors at most half the factor's length apart form an
arithmetic progression, whose difference is the factor's own period. Of the position's own progression nothing is proposed on this level: a distance
inside it is a multiple of that period. Of every other progression two members are: the first, and the one with as many members behind it as the
position has, because a run that holds the end of one progression holds its copy ``q`` words on. That leaves a handful of proposals for each position. A proposal that could be moved to the left is dropped, the others are
extended to the right through the dictionary, and of those that cover the same words the one with the smallest period stays.

Time is O(n log n) for a text of n words and memory O(n) for each level that still has a repeated factor; texts are never cut.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import raw_text

LEAST = 12
#: Words of several short texts that go through the dictionary together.
BLOCK = 50_000

Rewrite = Callable[[int | None, list[bytes]], list[bytes]]


def _named(keys: np.ndarray, positions: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(name of each of ``n`` positions, -1 where its key occurs once; positions in order of key and place; their names)."""
    order = np.argsort(keys, kind="stable")
    keys, positions = keys[order], positions[order]
    new = np.concatenate([[True], keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, bool)
    group = np.cumsum(new) - 1
    often = np.bincount(group)[group] > 1 if len(group) else np.zeros(0, bool)
    positions, group = positions[often], group[often]
    name = np.full(n, -1, np.int32)
    if len(group):
        group = np.cumsum(np.concatenate([[0], group[1:] != group[:-1]]))
    name[positions] = group
    return name, positions, group


def _proposals(places: np.ndarray, group: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions, periods from ``length`` to twice that) that the successors of the factors of one level propose."""
    index = np.arange(len(places))
    gap = np.append(np.where(group[1:] == group[:-1], places[1:] - places[:-1], 0), 0)  # 0: no successor
    turn = np.flatnonzero(np.append(gap[1:] != gap[:-1], True))
    end = np.where((gap > 0) & (2 * gap <= length), turn[np.searchsorted(turn, index)] + 1, index)  # last of the progression that holds this place
    behind = end - index
    start, at, found = index, end + 1, []
    while True:
        ok = at < len(places)
        start, at = start[ok], at[ok]
        ok = (group[at] == group[start]) & (places[at] - places[start] < 2 * length)
        start, at = start[ok], at[ok]
        if not len(at):
            break
        for to in (at, end[at] - behind[start]):  # the first of a progression, and the one that has as much of it behind
            period = places[to] - places[start]
            fit = (to >= at) & (period >= length) & (period < 2 * length)
            found.append((places[start[fit]], period[fit]))
        at = end[at] + 1
    return tuple(np.concatenate([f[k] for f in found]) if found else np.zeros(0, np.int64) for k in range(2))


def find_runs(codes: np.ndarray, least: int = LEAST) -> np.ndarray:
    """Rows (start, length, period) of all runs of a sequence of word numbers, by start and period: stretches with smallest period ``period`` and at
    least ``max(least, 2 * period)`` words that cannot be extended on either side."""
    n = len(codes)
    names: list[np.ndarray] = []
    starts, periods = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    name, places, group = _named(codes.astype(np.int64), np.arange(n), n)
    while len(places):
        length = 1 << len(names)
        names.append(name)
        start, period = _proposals(places, group, length)
        left = start == 0
        left[~left] = codes[start[~left] - 1] != codes[start[~left] - 1 + period[~left]]
        starts.append(start[left])
        periods.append(period[left])
        at = np.flatnonzero((name[: max(0, n - length)] >= 0) & (name[length:] >= 0)) if n > length else np.zeros(0, np.int64)
        name, places, group = _named(name[at].astype(np.int64) * n + name[at + length], at, n)
    start, period = np.concatenate(starts), np.concatenate(periods)
    one, two = start.copy(), start + period
    for k in range(len(names) - 1, -1, -1):  # no factor beyond the top level occurs twice, so each level is taken once at most
        ok = two < n
        ok[ok] = (names[k][one[ok]] >= 0) & (names[k][one[ok]] == names[k][two[ok]])
        one[ok] += 1 << k
        two[ok] += 1 << k
    length = two - start
    keep = length >= np.maximum(least, 2 * period)
    start, length, period = start[keep], length[keep], period[keep]
    order = np.lexsort((period, length, start))
    start, length, period = start[order], length[order], period[order]
    if len(start):  # equal stretches: the smallest period
        first = np.concatenate([[True], (start[1:] != start[:-1]) | (length[1:] != length[:-1])])
        start, length, period = start[first], length[first], period[first]
    order = np.lexsort((period, start))
    return np.stack([start[order], length[order], period[order]], 1)


def kept_words(n: int, runs: np.ndarray) -> np.ndarray:
    """True for words that stay: those that no run holds after its first period."""
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, runs[:, 0] + runs[:, 2], 1)
    np.add.at(step, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(step[:n]) == 0


def _block(texts: list[list[bytes]], least: int) -> list[np.ndarray]:
    """The runs of each list of words. Words are numbered anew in each list and a number of its own stands between lists, so that no factor is
    shared by two lists and no run crosses them."""
    codes, at, total = [], [0], 0
    for words in texts:
        number: dict[bytes, int] = {}
        codes.append(np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words)) + total)
        total += len(number)
        codes.append(np.array([total]))
        total += 1
        at.append(at[-1] + len(words) + 1)
    runs = find_runs(np.concatenate(codes), least)
    of = np.searchsorted(runs[:, 0], at)
    return [runs[a:b] - np.array([[s, 0, 0]]) for a, b, s in zip(of[:-1], of[1:], at[:-1], strict=True)]


def _scan(least: int, rewrite: Rewrite | None):
    def blocks(batch: pa.RecordBatch) -> Iterator[tuple[list, list[list[bytes]]]]:
        ids, texts, held = [], [], 0
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            words = text.as_py().split()
            ids.append(doc_id)
            texts.append(rewrite(doc_id, words) if rewrite else words)
            held += len(words)
            if held >= BLOCK:
                yield ids, texts
                ids, texts, held = [], [], 0
        if ids:
            yield ids, texts

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, texts in blocks(batch):
                found = _block(texts, least)
                rows = np.concatenate(found)
                ends = np.cumsum([0, *map(len, found)])
                runs = pa.StructArray.from_arrays([pa.array(rows[:, k], pa.int64()) for k in range(3)], ["start", "length", "period"])
                kept = [b" ".join(w for w, k in zip(t, kept_words(len(t), r).tolist(), strict=True) if k) if len(r) else b" ".join(t)
                        for t, r in zip(texts, found, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, pa.int64()), pa.array([len(t) for t in texts], pa.int64()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), runs),
                     pa.array(kept, pa.binary())], ["doc_id", "n_words", "runs", "collapsed"])
    return scan


def periodic_runs(docs: DataFrame, least: int = LEAST, rewrite: Rewrite | None = None) -> DataFrame:
    """(doc_id, n_words, runs, collapsed), a row for each row of ``docs``.

    Words are ``[^\\x20\\x09-\\x0D]+``, compared byte by byte and numbered from 0. ``runs`` holds (start, length, period) by start and period;
    ``collapsed`` (UTF-8 bytes) the words that stay when each run keeps its first period only, joined by single blanks. Null and empty texts have no
    words, no runs and an empty ``collapsed``. Rows are worked on one by one: repeated rows give repeated rows, null ids stay null, other columns are
    ignored, an empty table gives an empty result. ``rewrite`` may change the words of a row before they are searched. Nothing is shuffled.
    """
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), raw_text().alias("raw"))
    kind = "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed binary"
    return slim.mapInArrow(_scan(least, rewrite), kind)
