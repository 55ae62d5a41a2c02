"""Benchmark decontamination by latent semantic retrieval.

Passages are stretches of words, terms the words of the benchmark (words that no item has can't make a passage like an item). Term weights count
passages of all documents, and a randomised SVD over all of them, computed as sums of small blocks, gives the latent space. Windows of an item's own
length, at every eighth word of every document, are compared with it by cosine there; those from COSINE on are candidates. Where the rare words around
a candidate can add up to a leak at all, the regions that hold it are compared with the item by the heaviest common subsequence of words, and with
its answer, the last sentence.

What the cosine leaves is caught by an exact net: every region that holds enough of an item's rarest words to hold the least share of its weight
is compared as well, so nothing that would be a leak is dropped. ``by_cosine`` says which leaks the cosine found by itself. Items under eight words
are looked up word for word. So rewordings, dropped words and changed punctuation are found as well as copies.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import one_blas_thread, raw_text, sum_over
from docloom.session import store_table

DIMS, OVERSAMPLE, PASSAGE = 64, 16, 32
SHARE, SHARE_WITH_ANSWER, ANSWER = 0.6, 0.45, 0.8
#: Weights in the latent space are inverse document frequencies to this power, so that it follows rare words and not the language of a text.
POWER = 3
#: Cosine of a candidate window, share of the item's length that its projection on the item has, and words of the blocks that windows are made of.
COSINE, PROJECTION, STEP = 0.45, 0.4, 8
#: Items of fewer words count only where they stand word for word.
SHORT = 8
#: Share of an item's weight, from its rarest word on, whose words are looked up; the search is exact for any share over 1 - SHARE_WITH_ANSWER.
SOUGHT = 0.8
#: Quarters of a window in the region that is compared with an item.
SPAN = 6
#: Terms that are worked on at a time, in sums and in the search, and cells of a block of cosines. They bound what a task holds.
STRETCH, CELLS = 20_000, 1_000_000
#: Bytes of benchmark text searched with one reading of the documents; what is broadcast is a small multiple of it.
ITEM_BYTES = 16 << 20
MEMO, VERDICTS = 400_000, 20_000

_EDGE = b" \t\n\x0b\x0c\r.,;:?!\"'()[]{}<>#%&*_-$|/\\=~^`"
_SENTENCE = re.compile(rb"(?<=[.!?])\s+|\n+")


def words_of(text: bytes) -> list[bytes]:
    """Words in lower case without marks at their ends."""
    return [w for t in text.lower().split() if (w := t.strip(_EDGE))]


class _Numbers(dict):
    """The number of each token met, 0 for words that no item has, -1 for tokens without a word."""

    def __init__(self, vocabulary: dict[bytes, int]):
        super().__init__()
        self.vocabulary = vocabulary

    def __missing__(self, token: bytes) -> int:
        if len(self) >= MEMO:
            self.clear()
        word = token.strip(_EDGE)
        self[token] = k = self.vocabulary.get(word, 0) if word else -1
        return k


def _numberer(vocabulary):
    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = _Numbers(vocabulary.value)
        for batch in batches:
            parts, ends = [np.zeros(0, np.int32)], [0]
            for text in batch.column(2):
                words = text.as_py().lower().split()
                found = np.fromiter(map(memo.__getitem__, words), np.int32, len(words))
                parts.append(found[found >= 0])
                ends.append(ends[-1] + len(parts[-1]))
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(parts)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), lists], ["row_key", "doc_id", "terms"])
    return number


def _stretches(lists: pa.ListArray, limit: int = STRETCH) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(number of the first row, all terms, ends of the rows) of stretches of whole rows with about ``limit`` terms; a longer row stands alone."""
    ends = lists.offsets.to_numpy().astype(np.int64)
    values = lists.values.to_numpy()
    k = 0
    while k < len(ends) - 1:
        to = max(k + 1, int(np.searchsorted(ends, ends[k] + limit, "right")) - 1)
        yield k, values[ends[k] : ends[to]], ends[k : to + 1] - ends[k]
        k = to


def _padded(terms: np.ndarray, start: np.ndarray, size: np.ndarray, width: int) -> np.ndarray:
    """The terms of each piece as a row of ``width`` places, filled up with 0."""
    at = start[:, None] + np.arange(width)[None]
    return np.where(np.arange(width)[None] < size[:, None], terms[np.minimum(at, len(terms) - 1)], 0)


def _row_sums(padded: np.ndarray, side: np.ndarray) -> np.ndarray:
    """Sum of the rows of ``side`` that each row names; row 0 of ``side`` is zero."""
    total = side.take(padded[:, 0], 0)
    for k in range(1, padded.shape[1]):
        total += side.take(padded[:, k], 0)
    return total


def _passages(lists: pa.ListArray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Terms, about STRETCH at a time whatever the length of a row, and the running number of the passage that each stands in."""
    whole = STRETCH // PASSAGE * PASSAGE
    for _, terms, ends in _stretches(lists):
        if len(ends) == 2:
            for at in range(0, len(terms), whole):
                part = terms[at : at + whole]
                yield part, np.arange(len(part)) // PASSAGE
            continue
        sizes = np.diff(ends)
        within = np.arange(len(terms)) - np.repeat(ends[:-1], sizes)
        per_doc = -(-sizes // PASSAGE)
        yield terms, np.repeat(np.cumsum(per_doc) - per_doc, sizes) + within // PASSAGE


def _frequencies(n_terms: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(n_terms + 1, np.int64)
        for batch in batches:
            for terms, passage in _passages(batch.column(0)):
                if len(terms):
                    known = terms > 0
                    pairs = np.unique(passage[known] * (n_terms + 1) + terms[known])
                    seen += np.bincount(pairs % (n_terms + 1), minlength=n_terms + 1)
                    seen[0] += passage[-1] + 1  # slot 0 counts passages
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(n_terms + 1), pa.int32()), pa.array(seen)], ["term", "n"])
    return count


def latent_basis(numbered: DataFrame, weight: np.ndarray, dims: int = DIMS) -> tuple[np.ndarray, np.ndarray]:
    """(term rows of the leading right singular vectors, singular values) of the passage matrix, by a randomised range finder: two sums over
    all passages. A task holds STRETCH rows of the width of the space at a time, besides its sum."""
    terms_only, size = numbered.select("terms"), min(len(weight), dims + OVERSAMPLE)
    start = np.random.default_rng(11).standard_normal((len(weight), size)).astype(np.float32)

    def rows(batch: pa.RecordBatch, side: np.ndarray):
        for terms, passage in _passages(batch.column(0)):
            if len(terms):
                first = np.flatnonzero(np.concatenate([[True], passage[1:] != passage[:-1]]))
                yield terms, first, _row_sums(_padded(terms, first, np.diff(np.append(first, len(terms))), PASSAGE), side)

    scaled = (start * weight[:, None]).astype(np.float32)
    scaled[0] = 0

    def spread(batch: pa.RecordBatch, total: np.ndarray) -> None:
        for terms, first, y in rows(batch, scaled):
            of = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(terms))))
            keep = np.flatnonzero(weight[terms] > 0)
            order = keep[np.argsort(terms[keep], kind="stable")]
            if len(order):
                starts = np.flatnonzero(np.concatenate([[True], terms[order][1:] != terms[order][:-1]]))
                ids = terms[order][starts]
                total[ids] += weight[ids, None] * np.add.reduceat(y.take(of[order], 0), starts, axis=0)

    basis = np.linalg.qr(sum_over(terms_only, spread, start.shape))[0]
    projected = (basis * weight[:, None]).astype(np.float32)
    projected[0] = 0

    def inner(batch: pa.RecordBatch, total: np.ndarray) -> None:
        for _, _, y in rows(batch, projected):
            total += y.T @ y

    values, turn = np.linalg.eigh(sum_over(terms_only, inner, (basis.shape[1],) * 2))
    first = np.argsort(-values)[:dims]
    return (basis @ turn[:, first]).astype(np.float32), np.sqrt(np.maximum(values[first], 0))


def heaviest_common(item: np.ndarray, region: np.ndarray, weight: np.ndarray) -> float:
    """Weight of the heaviest common subsequence of two term sequences."""
    best = np.zeros(len(region) + 1)
    for t in item:
        step = np.where(region == t, best[:-1] + weight[t], best[1:])
        best[1:] = np.maximum.accumulate(np.maximum(step, best[1:]))
    return float(best[-1])


def _unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.maximum(np.linalg.norm(rows, axis=-1, keepdims=True), 1e-9)


def _posted(postings: tuple, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, entry) for each place whose term heads posting entries."""
    first = postings[0]
    counts = first[terms + 1] - first[terms]
    at = np.flatnonzero(counts)
    counts = counts[at]
    entry = np.repeat(first[terms[at]] - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
    return np.repeat(at, counts), entry


def _cosine_windows(side: np.ndarray, classes: list, terms: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, first word, item) of the windows of each item's own length whose cosine with it reaches COSINE."""
    sizes = -(-np.diff(ends) // STEP)
    last = np.cumsum(sizes)
    row = np.repeat(np.arange(len(sizes)), sizes)
    word = (np.arange(last[-1]) - np.repeat(last - sizes, sizes)) * STEP
    total = np.zeros((len(word) + 1, side.shape[1]), np.float32)
    total[1:] = _row_sums(_padded(terms, ends[row] + word, np.minimum(STEP, ends[1:][row] - ends[row] - word), STEP), side)
    np.cumsum(total, axis=0, out=total)
    found = []
    for width, numbers, vectors, floors in classes:
        step = max(1, CELLS // len(numbers))
        for low in range(0, len(word), step):
            begin = np.arange(low, min(len(word), low + step))
            window = total[np.minimum(begin + width, last[row[begin]])] - total[begin]
            norm = np.sqrt(np.einsum("ij,ij->i", window, window))
            long = norm >= floors.min()  # no projection is longer
            begin, window, norm = begin[long], window[long], norm[long]
            dot = window @ vectors.T
            hit, which = np.nonzero((dot >= COSINE * norm[:, None]) & (dot >= floors[None]))
            found.append((begin[hit], numbers[which]))
    begin, item = (np.concatenate([np.zeros(0, np.int64), *(f[k] for f in found)]) for k in range(2))
    return row[begin], word[begin], item


class _Mass:
    """Weight of the rarest words of items with one width of window, in the quarters of a stretch of rows where they stand."""

    def __init__(self, width: int, postings: tuple, weight: np.ndarray, terms: np.ndarray, ends: np.ndarray):
        self.quarter = width // 4
        place, entry = _posted(postings, terms)
        row = np.searchsorted(ends, place, "right") - 1
        gap = np.diff(ends) // self.quarter + 1 + 2 * SPAN  # regions of two rows never meet
        self.base, self.total = np.cumsum(gap) - gap + SPAN, int(gap.sum())
        key = postings[1][entry] * self.total + self.base[row] + (place - ends[row]) // self.quarter
        order = np.argsort(key, kind="stable")
        key = key[order]
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
        self.held = np.concatenate([[0.0], np.cumsum(weight[terms[place[order]]])])[np.append(first, len(key))]
        self.key, self.row = key[first], row[order][first]

    def of(self, item: np.ndarray, row: np.ndarray, start: np.ndarray) -> np.ndarray:
        """Weight held by the regions that start at these quarters."""
        key = item * self.total + self.base[row] + start
        return self.held[np.searchsorted(self.key, key + SPAN)] - self.held[np.searchsorted(self.key, key)]


def _searcher(shared):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one_blas_thread()
        model = shared.value
        weight, side, items = model["weight"], model["side"], model["items"]
        memo: dict[tuple[int, bytes], tuple | None] = {}

        def cosine(i: int, window: np.ndarray) -> float:
            return float(_unit(side[window].sum(0)) @ items[i]["vector"])

        def verdict(i: int, region: np.ndarray) -> tuple[float, float] | None:
            key = (i, region.tobytes())  # copies are compared once
            if key not in memo:
                if len(memo) >= VERDICTS:
                    memo.clear()
                memo[key] = _verdict(items[i]["sequence"], items[i]["answer"], region, weight)
            return memo[key]

        def hopeless(i: int, words: np.ndarray) -> bool:
            """Whether these words can't hold the least share of the item, in any order."""
            this, inside = items[i], set(words.tolist())
            met = [t in inside for t in this["terms"]]
            return sum(met) < SHARE_WITH_ANSWER * len(met) or this["worth"][met].sum() < this["least"]

        def compare(i: int, r: int, spots, text: np.ndarray, found: dict, done: set, by_cosine: bool) -> None:
            quarter = items[i]["quarter"]
            for s in spots:
                best = found.get(r, {}).get(i)
                if best and best[1:3] == (1.0, 1.0):
                    return
                if (i, r, s) in done:
                    continue
                done.add((i, r, s))
                seen = verdict(i, text[max(0, s * quarter) : (s + SPAN) * quarter])
                if seen and (not best or seen > best[1:3]):
                    mine = by_cosine or bool(best and best[3])
                    found.setdefault(r, {})[i] = (cosine(i, text[max(0, (s + 1) * quarter) : (s + SPAN - 1) * quarter]), *seen, mine)

        def near(masses: list[_Mass], terms: np.ndarray, ends: np.ndarray, found: dict, done: set) -> None:
            """Windows that are near an item in the latent space, each with the regions that hold it."""
            row, word, item = _cosine_windows(side, model["classes"], terms, ends)
            for mass in masses:
                mine = np.flatnonzero(model["quarters"][item] == mass.quarter)
                r, i, high = row[mine], item[mine], word[mine] // mass.quarter
                low = -(-(word[mine] + model["sizes"][i]) // mass.quarter) - SPAN
                spots = [np.zeros((0, 3), np.int64)]
                for back in range(SPAN):
                    ok = high - back >= low
                    r, i, high, low = r[ok], i[ok], high[ok], low[ok]
                    heavy = mass.of(i, r, high - back) >= model["needs"][i]
                    spots.append(np.stack([r, i, high - back], 1)[heavy])
                for r, i, s in np.unique(np.concatenate(spots), axis=0)[::-1].tolist():
                    compare(i, r, (s,), terms[ends[r] : ends[r + 1]], found, done, True)

        def verbatim(terms: np.ndarray, ends: np.ndarray, found: dict) -> None:
            """Items under SHORT words, each looked up by its rarest word."""
            place, entry = _posted(model["short"], terms)
            item, start = model["short"][1][entry], place - model["short"][2][entry]
            row = np.searchsorted(ends, place, "right") - 1
            size = model["sizes"][item]
            ok = (start >= ends[row]) & (start + size <= ends[row + 1])
            item, start, row, size = item[ok], start[ok], row[ok], size[ok]
            for k in range(SHORT - 1):
                inside = k < size
                ok = ~inside
                ok[inside] = terms[start[inside] + k] == model["letters"][item[inside], k]
                item, start, row, size = item[ok], start[ok], row[ok], size[ok]
            _, once = np.unique(row * len(items) + item, return_index=True)
            for k in once.tolist():
                i = int(item[k])
                found.setdefault(int(row[k]), {})[i] = (cosine(i, terms[start[k] : start[k] + size[k]]), 1.0, 1.0, False)

        def worded(mass: _Mass, terms: np.ndarray, ends: np.ndarray, found: dict, done: set) -> None:
            """The net: items whose windows have this width, by their rarest words. A region are SPAN stretches of a quarter of it."""
            item = mass.key // mass.total
            start = mass.key % mass.total - mass.base[mass.row]
            heavy = mass.held[np.searchsorted(mass.key, mass.key + SPAN)] - mass.held[:-1] >= model["needs"][item]
            for i, r, block in zip(item[heavy].tolist(), mass.row[heavy].tolist(), start[heavy].tolist(), strict=True):
                text = terms[ends[r] : ends[r + 1]]
                if not hopeless(i, text[max(0, block - SPAN + 1) * mass.quarter : (block + SPAN) * mass.quarter]):
                    compare(i, r, range(block, block - SPAN, -1), text, found, done, False)

        def searched(terms: np.ndarray, ends: np.ndarray) -> dict[int, dict]:
            found: dict[int, dict] = {}
            done: set = set()
            if len(terms):
                verbatim(terms, ends, found)
                masses = [_Mass(width, postings, weight, terms, ends) for width, postings in model["scales"]]
                near(masses, terms, ends, found, done)
                for mass in masses:
                    worded(mass, terms, ends, found, done)
            return found

        widest = max([PASSAGE, *(w for w, _ in model["scales"])])
        step = -(-STRETCH // widest) * widest

        def in_pieces(terms: np.ndarray) -> dict[int, dict]:
            """One long row, in pieces that overlap by more than any region and start on the grid of all regions."""
            best: dict[int, tuple] = {}
            for low in range(0, len(terms), step):
                part = terms[low : low + step + 2 * widest]
                for i, v in searched(part, np.array([0, len(part)])).get(0, {}).items():
                    if i not in best or v[1:3] > best[i][1:3]:
                        best[i] = v
            return {0: best} if best else {}

        for batch in batches:
            rows = []
            for at, terms, ends in _stretches(batch.column(2)):
                found = in_pieces(terms) if len(terms) > step + 2 * widest and len(ends) == 2 else searched(terms, ends)
                for r in sorted(found):
                    names = (batch.column(0)[at + r].as_py(), batch.column(1)[at + r].as_py())
                    rows += [(*names, items[i]["id"], *v) for i, v in sorted(found[r].items())]
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)],
                                             ["row_key", "doc_id", "item_id", "cosine", "lcs_share", "answer_share", "by_cosine"])
    return search


def _posting_lists(entries: list[tuple[int, int, int]], size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Postings (term, item, offset), as first entry of each term, items and offsets."""
    table = np.array(sorted(entries), np.int64).reshape(-1, 3)
    return np.searchsorted(table[:, 0], np.arange(size + 1)), table[:, 1], table[:, 2]


def _sought(sequence: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, float]:
    """(rarest terms of an item, weight of them that a leak must hold at least). A leak holds SHARE_WITH_ANSWER of the whole weight, of which at
    most the other terms can come from elsewhere."""
    terms, counts = np.unique(sequence, return_counts=True)
    order = np.lexsort((terms, -weight[terms]))
    held = np.cumsum((weight[terms] * counts)[order])
    k = int(np.searchsorted(held, SOUGHT * held[-1])) + 1
    chosen = order[:k]
    return terms[chosen], float(held[min(k, len(held)) - 1] - (1 - SHARE_WITH_ANSWER) * held[-1]) * (1 - 1e-9)


def _verdict(sequence: np.ndarray, answer: np.ndarray, region: np.ndarray, weight: np.ndarray) -> tuple[float, float] | None:
    """(share of the item's words, share of the answer's words) in the common subsequence, None where they don't make a leak. The share must hold
    for the rare words, by weight, as well as for all words."""
    whole = weight[sequence].sum()
    if weight[sequence[np.isin(sequence, region)]].sum() < SHARE_WITH_ANSWER * whole:
        return None
    rare = heaviest_common(sequence, region, weight) / whole
    if rare < SHARE_WITH_ANSWER:
        return None
    every = np.ones_like(weight)
    share = heaviest_common(sequence, region, every) / len(sequence)
    answered = heaviest_common(answer, region, every) / len(answer)
    return (share, answered) if min(share, rare) >= SHARE or min(share, rare) >= SHARE_WITH_ANSWER and answered >= ANSWER else None


def _answer(text: bytes, sequence: list[bytes]) -> list[bytes]:
    """Words of the last sentence; of the last third where the item is one sentence."""
    sentences = [w for s in _SENTENCE.split(text) if (w := words_of(s))]
    return sentences[-1] if len(sentences) > 1 else sequence[-max(1, len(sequence) // 3) :]


def find_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(row_key, doc_id, item_id, cosine, lcs_share, answer_share, by_cosine): each item that a row's whole text holds, at its best window.

    ``row_key`` is ``xxhash64(doc_id, text)``, to find rows without an id again. A leak holds 60 % of the item's words in the item's order, or 45 %
    and 80 % of its answer, and the same share of its rare words; items under eight words must stand word for word. ``by_cosine`` is false where only
    the net or the word-for-word search found it. Null or wordless items and texts leak nothing. Items with equal texts are all reported, repeated rows
    and rows that share an id each; a window that ties with an earlier one doesn't replace it. Texts of any length are read whole, a stretch at a
    time in the sums. Other columns are ignored; empty tables give an empty result. Items are taken in blocks of ITEM_BYTES.
    """
    slim = docs.select(F.xxhash64("doc_id", raw_text()).alias("row_key"), F.col("doc_id").cast("long").alias("doc_id"), raw_text().alias("raw"))
    items = benchmark.filter("item_id IS NOT NULL AND text IS NOT NULL").select(F.col("item_id").cast("long").alias("item_id"), raw_text().alias("raw"))
    blocks = max(1, math.ceil((items.agg(F.sum(F.length("raw"))).first()[0] or 0) / ITEM_BYTES))
    found = [_leaks_of_block(slim, items.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == k)) for k in range(blocks)]
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def _width_in_blocks(length: int) -> int:
    """Blocks of STEP words in a window for an item of ``length`` words; two widths for each doubling, so that items share them."""
    width = -(-length // STEP)
    coarse = 1 << max(0, width.bit_length() - 2)
    return -(-width // coarse) * coarse


def _leaks_of_block(slim: DataFrame, items: DataFrame) -> DataFrame:
    session = slim.sparkSession
    texts = sorted({(r["item_id"], bytes(r["raw"])) for r in items.collect()})
    worded = [(i, t, w) for i, t in texts if (w := words_of(t))]
    vocabulary = {w: k for k, w in enumerate(sorted({w for _, _, words in worded for w in words}), 1)}
    numbered = slim.mapInArrow(_numberer(session.sparkContext.broadcast(vocabulary)), "row_key long, doc_id long, terms array<int>")
    numbered = store_table(numbered, "terms")
    seen = np.zeros(len(vocabulary) + 1)
    for row in numbered.select("terms").mapInArrow(_frequencies(len(vocabulary)), "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).collect():
        seen[row["term"]] = row["n"]
    weight = np.log((2 + seen[0]) / (1 + np.minimum(seen, seen[0])))  # over 0 for every word, however often an item is copied
    weight[0] = 0
    latent = weight**POWER
    basis, sigma = latent_basis(numbered, latent)
    # passages are folded in by V / sigma, so that the strong common directions don't drown what sets passages apart
    kept = sigma > 0.01 * sigma.max(initial=0)  # directions that the passages hardly have would only add noise
    side = (basis * latent[:, None] * np.where(kept, 1 / np.where(kept, sigma, 1), 0)).astype(np.float32)
    held, short, scales, classes = [], [], {}, {}
    for i, (item_id, text, words) in enumerate(worded):
        sequence = np.array([vocabulary[w] for w in words], np.int32)
        answer = np.array([vocabulary[w] for w in _answer(text, words)], np.int32)
        terms, need = _sought(sequence, weight)
        width = max(PASSAGE, 1 << (len(words) - 1).bit_length())
        held.append({"id": item_id, "sequence": sequence, "answer": answer, "terms": sequence.tolist(), "worth": weight[sequence],
                     "least": SHARE_WITH_ANSWER * weight[sequence].sum() - 1e-9, "quarter": width // 4, "vector": _unit(side[sequence].sum(0)), "need": need,
                     "floor": PROJECTION * float(np.linalg.norm(side[sequence].sum(0)))})
        if len(words) < SHORT:
            rarest = int(np.argmax(weight[sequence]))
            short.append((int(sequence[rarest]), i, rarest))
        else:
            scales.setdefault(width, []).extend((t, i, 0) for t in terms.tolist())
            classes.setdefault(_width_in_blocks(len(words)), []).append(i)
    letters = np.zeros((len(held), SHORT - 1), np.int32)
    for i, item in enumerate(held):
        letters[i, : len(item["sequence"])] = item["sequence"][: SHORT - 1]
    shared = session.sparkContext.broadcast({
        "weight": weight, "side": side, "items": held, "letters": letters, "needs": np.array([x["need"] for x in held]),
        "classes": [(w, np.array(k), np.stack([held[i]["vector"] for i in k]), np.array([held[i]["floor"] for i in k], np.float32)) for w, k in sorted(classes.items())],
        "quarters": np.array([x["quarter"] for x in held], np.int64),
        "sizes": np.array([len(x["sequence"]) for x in held], np.int64), "short": _posting_lists(short, len(weight)),
        "scales": [(width, _posting_lists(entries, len(weight))) for width, entries in sorted(scales.items())]})
    kind = "row_key long, doc_id long, item_id long, cosine double, lcs_share double, answer_share double, by_cosine boolean"
    return numbered.mapInArrow(_searcher(shared), kind)
