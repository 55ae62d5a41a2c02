"""Language-model scoring with a causal self-attention model in numpy over subword ids.

A text is the subword ids of its words, each word with a blank in front, and an end; the model gives the next id a probability that is a mixture of three
distributions over all ids, each of which sums to 1:

* the id after this id, and the first id of a word after the whole word before: counts of all training rows, backed off to single ids;
* the id after what the word has so far, or the word's end and a first id: counts of word beginnings of all training rows, backed off
  to the id after this id;
* the id that stood after an earlier position of the window, by causal self-attention: positions are weighed by learned vectors of the classes of both ids,
  by distance, and by whether the ids there, and those before them, are the same; a share of the attention stays with the second distribution.

The attention also carries values of the attended classes to the gate, which weighs the three. The counts are sums over all training rows; the weights are
trained by gradient steps on all training rows, dealt to rounds by id: every batch of a round's rows takes its steps, then the weights are averaged. Windows
overlap; every id is scored once, with OVERLAP positions of context at least. Nothing but bounded tables meets on the driver: counts are kept where they reach a
fixed fraction of all ids, so fewer than TRIE and PAIRS by arithmetic; what is dropped goes to the back-off, so all distributions still sum to 1.

The word base: log10((c + 1) / (N + V + 1)) for each word and the end. Words with at least N / HEAD occurrences, fewer than HEAD by arithmetic, are
broadcast; what a document has of other words is joined by shuffle.
"""

from __future__ import annotations

import base64
import math
from array import array
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import fold_is, one_blas_thread, raw_text, sum_over
from docloom.session import store_table

END = b"\n"  # no word holds a line end
HEAD, COUNTER, MEMO, PENDING = 500_000, 400_000, 300_000, 3_000_000
TRIE, PAIRS = 1 << 22, 1 << 21
#: Counts that a context gives to the back-off for each of its successors.
NEW = 0.5
CLASSES, SINGLES, DIM, WINDOW, OVERLAP = 192, 95, 16, 32, 8
STEP = WINDOW - OVERLAP
ROUNDS, BATCH, RATE, SLICE = 3, 24, 1e-2, 256
_LOG10 = math.log(10)
_MASK64 = (1 << 64) - 1


# --- words -----------------------------------------------------------------------------------------------------------------------

def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: Counter = Counter()

    def emit() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], ["word", "c"])
        counts.clear()
        return out

    for batch in batches:
        for text in batch.column(0):
            counts.update(text.as_py().lower().split())
            counts[END] += 1
            if len(counts) > COUNTER:
                yield emit()
    yield emit()


def word_counts(training: DataFrame) -> DataFrame:
    """(word, c) over the training texts (column ``raw``), the end of a text included."""
    return training.select("raw").mapInArrow(_count_words, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


# --- subword ids and their counts ------------------------------------------------------------------------------------------------

@lru_cache(maxsize=2)
def _encoding(ranks: str) -> tuple:
    """The tokenizer of a rank file and the number of its ids."""
    import public_tokenizers
    import tiktoken
    with open(ranks, "rb") as lines:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={}), max(table.values()) + 1


class Subwords:
    """Subword ids of single words."""

    def __init__(self, ranks: str):
        self.encoding, self.size = _encoding(ranks)

    def encode(self, word: bytes) -> list[int]:
        """The ids of a word; the end is an id of its own, the last."""
        return [self.size] if word == END else self.encoding.encode_ordinary(f" {word.decode('utf-8', 'replace')}")


def subword_classes(head: dict[bytes, int], subwords: Subwords, classes: int = CLASSES, singles: int = SINGLES) -> np.ndarray:
    """A class for each subword id and for the end (last entry). The most frequent ids have classes of their own; the others are grouped by the
    company they keep inside the frequent words; ids that no frequent word has share one class."""
    size, span = subwords.size, 64
    total, company = np.zeros(size), {}
    for word, c in sorted(head.items()):
        if word == END:
            continue
        ids = subwords.encode(word)
        for k, i in enumerate(ids):
            total[i] += c
            left = ids[k - 1] % (span - 1) + 1 if k else 0
            right = ids[k + 1] % (span - 1) + 1 if k + 1 < len(ids) else 0
            row = company.setdefault(i, np.zeros(2 * span))
            row[left] += c
            row[span + right] += c
    class_of = np.zeros(size + 1, np.int32)  # 0: ids not met
    class_of[size] = 1
    order = np.argsort(-total, kind="stable")
    order = order[total[order] > 0]
    class_of[order[:singles]] = np.arange(len(order[:singles])) + 2
    rest, groups = order[singles:], classes - singles - 2
    if len(rest):
        rows = np.stack([company[i] for i in rest])
        rows = np.sqrt(rows / rows.sum(1, keepdims=True))
        weight = np.sqrt(total[rest])
        centres = rows[np.linspace(0, len(rest) - 1, min(groups, len(rest))).astype(int)]
        for _ in range(12):
            near = np.argmin((centres**2).sum(1)[None] - 2 * rows @ centres.T, axis=1)
            for g in range(len(centres)):
                mine = near == g
                if mine.any():
                    centres[g] = np.average(rows[mine], axis=0, weights=weight[mine])
        class_of[rest] = near + 2 + singles
    return class_of


def prefixes(ids: list[int]) -> list[int]:
    """A 64-bit number for each beginning of a word, the whole word included."""
    out, h = [], 0x243F6A8885A308D3
    for i in ids:
        h = ((h ^ (i + 1)) * 0x9E3779B97F4A7C15 & _MASK64) ^ (h >> 29)
        out.append(h - (1 << 64) if h >> 63 else h)
    return out


WORD_END = -1  # what follows a whole word in the counts of beginnings


def _beginnings(ranks: str):
    """(kind, context, next, n) of distinct words: 0 for ids after an id inside the word, 1 for ids and ends after a beginning, 2 for first ids."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        subwords = Subwords(ranks)
        for batch in batches:
            rows: list[tuple[int, int, int, int]] = []
            for word, c in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                ids = subwords.encode(word.as_py())
                rows.append((2, 0, ids[0], c))
                if ids[0] == subwords.size:
                    continue
                for k, h in enumerate(prefixes(ids)):
                    following = ids[k + 1] if k + 1 < len(ids) else WORD_END
                    rows.append((1, h, following, c))
                rows += [(0, x, y, c) for x, y in zip(ids, ids[1:])]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(4)], ["kind", "context", "next", "n"])
    return count


class _Ends(dict):
    """A number for each word met, under which its first id, last id and the number of its whole beginning stand."""

    def __init__(self, ranks: str):
        super().__init__()
        self.subwords = Subwords(ranks)
        self.restart()

    def restart(self) -> None:
        self.clear()
        self.first, self.last, self.whole = array("q"), array("q"), array("q")
        self[END]

    def __missing__(self, word: bytes) -> int:
        ids = self.subwords.encode(word)
        self.first.append(ids[0])
        self.last.append(ids[-1])
        self.whole.append(prefixes(ids)[-1])
        self[word] = k = len(self.first) - 1
        return k


def _between(ranks: str):
    """(kind, context, next, n) for the first id of each word and for the end: 0 after the last id of the word before, 3 after that whole word. The end
    stands before and after a text."""
    def summed(pairs: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        keys, n = (np.concatenate([p[k] for p in pairs]) for k in range(2))
        keys, of = np.unique(keys, return_inverse=True)
        return keys, np.bincount(of, n).astype(np.int64)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ends = _Ends(ranks)
        after_id: list[tuple[np.ndarray, np.ndarray]] = []
        after_word: list[tuple[np.ndarray, np.ndarray]] = []
        held = 0

        def emit() -> Iterator[pa.RecordBatch]:
            whole = np.array(ends.whole)
            for kind, parts in ((0, after_id), (3, after_word)):
                if parts:
                    keys, n = summed(parts)
                    context = keys >> 32 if kind == 0 else whole[keys >> 32]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), kind, np.int64)), pa.array(context), pa.array(keys & 0xFFFFFFFF), pa.array(n)],
                                                     ["kind", "context", "next", "n"])
                parts.clear()

        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                flat = [0]
                for text in batch.column(0).slice(at, 512):
                    flat += map(ends.__getitem__, text.as_py().lower().split())
                    flat.append(0)
                words = np.array(flat, np.int64)
                first, last = np.array(ends.first)[words[1:]], np.array(ends.last)[words[:-1]]
                for parts, key in ((after_id, last << 32 | first), (after_word, words[:-1] << 32 | first)):
                    parts.append(np.unique(key, return_counts=True))
                held += len(after_word[-1][0])
                if held > PENDING or len(ends) > MEMO:
                    yield from emit()
                    held = 0
                    if len(ends) > MEMO:
                        ends.restart()
        yield from emit()
    return count


_COUNTS = "kind long, context long, next long, n long"


class Counts:
    """Sorted tables of the kept counts, and the distributions they give."""

    def __init__(self, size: int, single: np.ndarray, first: np.ndarray, pairs: dict, words: dict, trie: dict):
        self.size, self.pairs, self.words, self.trie = size, pairs, words, trie
        self.single = (single + 0.1) / (single.sum() + 0.1 * (size + 1))
        self.first = first / max(1, first.sum())

    @staticmethod
    def table(rows: pa.Table, totals: pa.Table) -> dict:
        """Kept (context, next) counts, and for each context the total, and the part of it that goes to the back-off."""
        context, following, n = (rows[c].to_numpy() for c in ("context", "next", "n"))
        order = np.lexsort((following, context))
        context, following, n = context[order], following[order], n[order]
        first = np.flatnonzero(np.concatenate([[True], context[1:] != context[:-1]])) if len(context) else np.zeros(0, np.int64)
        kept, distinct = np.add.reduceat(n, first) if len(first) else np.zeros(0, np.int64), np.diff(np.append(first, len(n)))
        names, total = totals["context"].to_numpy(), totals["n"].to_numpy()
        by_name = np.argsort(names)
        total = total[by_name][np.searchsorted(names[by_name], context[first])] if len(first) else kept
        return {"names": context[first], "first": first, "next": following, "n": n, "total": total,
                "left": total - kept + NEW * distinct, "all": total + NEW * distinct}

    @staticmethod
    def look(table: dict, context: np.ndarray, following: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(share of ``following`` by count, share left to the back-off, total) of each context; unknown contexts leave all."""
        names = table["names"]
        if not len(names):
            return np.zeros(len(context)), np.ones(len(context)), np.zeros(len(context))
        at = np.minimum(np.searchsorted(names, context), len(names) - 1)
        known = names[at] == context
        low, high = table["first"][at], np.append(table["first"], len(table["next"]))[at + 1]
        end = high.copy()
        while (low < high).any():  # binary search inside the context
            middle = (low + high) // 2
            less = (low < high) & (table["next"][np.minimum(middle, len(table["next"]) - 1)] < following)
            low, high = np.where(less, middle + 1, low), np.where(less | (low >= high), high, middle)
        here = np.minimum(low, len(table["next"]) - 1)
        hit = known & (low < end) & (table["next"][here] == following)
        share = np.where(hit, table["n"][here], 0) / table["all"][at]
        return share, np.where(known, table["left"][at] / table["all"][at], 1.0), np.where(known, table["total"][at], 0.0)

    def after_id(self, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(probability of ``y`` after the id ``x``, how often ``x`` was seen)."""
        share, left, total = self.look(self.pairs, x, y)
        return share + left * self.single[y], total


class Reader:
    """Words of texts as flat arrays of ids with what the first two distributions give them; remembers the words it has met."""

    FIELDS = ("ids", "one", "two", "seen_id", "seen_start")

    def __init__(self, counts: Counts, ranks: str):
        self.counts, self.subwords = counts, Subwords(ranks)
        self.forget()

    def forget(self) -> None:
        self.number: dict[bytes, int] = {}
        self.flat = {k: np.zeros(0, np.int64 if k == "ids" else np.float32) for k in self.FIELDS}
        self.start, self.size, self.whole = (np.zeros(0, np.int64) for _ in range(3))
        self.to_end, self.end_left, self.end_seen = (np.zeros(0) for _ in range(3))
        self.learn([END])

    def learn(self, words: list[bytes]) -> None:
        """Look up words that are new: all but the first id of a word has its probabilities from the word alone."""
        listed = [self.subwords.encode(w) for w in words]
        for w in words:
            self.number[w] = len(self.number)
        sizes = np.array([len(x) for x in listed], np.int64)
        ids = np.array([i for x in listed for i in x], np.int64)
        before = np.array([h for x in listed for h in prefixes(x)], np.int64)
        last = np.cumsum(sizes) - 1
        x, y, h = ids[:-1], ids[1:], before[:-1]
        one, seen_id = self.counts.after_id(x, y)
        share, left, seen = self.counts.look(self.counts.trie, h, y)
        two = share + left * one
        pad = lambda v: np.concatenate([[0.0], v]).astype(np.float32)  # noqa: E731  the first id of each word is filled in later
        new = {"ids": ids, "one": pad(one), "two": pad(two), "seen_id": pad(np.log1p(seen_id)), "seen_start": pad(np.log1p(seen))}
        self.whole = np.concatenate([self.whole, before[last]])
        share, left, seen = self.counts.look(self.counts.trie, before[last], np.full(len(last), WORD_END))
        self.start = np.concatenate([self.start, len(self.flat["ids"]) + last - sizes + 1])
        self.size = np.concatenate([self.size, sizes])
        self.flat = {k: np.concatenate([self.flat[k], new[k]]) for k in self.FIELDS}
        self.to_end, self.end_left, self.end_seen = (np.concatenate(v) for v in ((self.to_end, share), (self.end_left, left), (self.end_seen, np.log1p(seen))))

    def read(self, texts: list[list[bytes]]) -> tuple[dict[str, np.ndarray], np.ndarray]:
        """(arrays over all ids of the texts, each text's end included; ends of the texts in them)."""
        if len(self.number) > MEMO:
            self.forget()
        get = self.number.get
        new = list(dict.fromkeys(w for words in texts for w in words if get(w) is None))
        if new:
            self.learn(new)
        number = self.number
        flat: list[int] = []
        bounds = []
        for words in texts:
            flat += [number[w] for w in words]
            flat.append(0)  # the end
            bounds.append(len(flat))
        words, bounds = np.array(flat, np.int64), np.array(bounds, np.int64)
        size = self.size[words]
        ends = np.cumsum(size)
        at = np.arange(ends[-1]) - np.repeat(ends - size, size) + np.repeat(self.start[words], size)
        out = {k: v[at] for k, v in self.flat.items()}
        first = ends - size
        before = np.concatenate([[0], words[:-1]])  # the end also stands before a text
        y = out["ids"][first]
        x = self.flat["ids"][self.start[before] + self.size[before] - 1]
        one, seen = self.counts.after_id(x, y)
        share, left, _ = self.counts.look(self.counts.words, self.whole[before], y)
        after_word = share + left * one
        out["one"][first] = after_word
        out["two"][first] = self.to_end[before] * self.counts.first[y] + self.end_left[before] * one
        out["seen_id"][first], out["seen_start"][first] = np.log1p(seen), self.end_seen[before]
        return out, ends[bounds - 1]


# --- the model -------------------------------------------------------------------------------------------------------------------

def first_weights(seed: int = 5) -> dict[str, np.ndarray]:
    """Small vectors, attention to equal ids, and a gate that prefers the second distribution."""
    rng = np.random.default_rng(seed)
    w = {"query": rng.standard_normal((CLASSES, DIM)) * 0.1, "key": rng.standard_normal((CLASSES, DIM)) * 0.1, "value": np.zeros((CLASSES, 3)),
         "near": np.zeros(WINDOW), "same": np.array([2.0, 2.0]), "rest": np.full(CLASSES, 3.0), "gate": np.tile([0.0, 2.0, -1.0], (CLASSES, 1)), "seen": np.zeros((2, 3))}
    return {k: v.astype(np.float32) for k, v in w.items()}


def forward(w: dict, x: np.ndarray, y: np.ndarray, class_of: np.ndarray, one: np.ndarray, two: np.ndarray, seen: np.ndarray) -> dict:
    """The probability of each next id ``y`` at every position of windows (n, length) of ids ``x``, and what the backward pass needs."""
    length, c = x.shape[1], class_of[x]
    at = np.arange(length)
    earlier = at[None, :] < at[:, None]
    hit = y[:, :, None] == y[:, None, :]  # the id after position j is the one asked for at position t
    same = np.zeros(hit.shape, bool)  # the ids at both positions are equal
    same[:, 1:, 1:] = hit[:, :-1, :-1]
    twice = np.zeros(hit.shape, bool)
    twice[:, 1:, 1:] = same[:, 1:, 1:] & same[:, :-1, :-1]
    q, k = w["query"][c], w["key"][c]
    a = q @ k.transpose(0, 2, 1)
    a += w["near"][np.maximum(at[:, None] - at[None, :], 0)]
    a += w["same"][0] * same
    a += w["same"][1] * twice
    a = np.exp(np.minimum(a, 30, out=a), out=a)
    a *= earlier
    rest = np.exp(np.minimum(w["rest"][c], 30))
    total = a.sum(2) + rest
    a /= total[:, :, None]
    rest = rest / total
    hit &= earlier
    copied = (a * hit).sum(2) + rest * two
    logits = w["gate"][c] + a @ w["value"][c] + seen @ w["seen"]
    logits -= logits.max(2, keepdims=True)
    gate = np.exp(logits)
    gate /= gate.sum(2, keepdims=True)
    parts = np.stack([one, two, copied], 2)
    return {"p": (gate * parts).sum(2), "gate": gate, "parts": parts, "a": a, "rest": rest, "hit": hit, "same": same, "twice": twice, "q": q, "k": k, "c": c,
            "earlier": earlier}


def probabilities(w: dict, x: np.ndarray, y: np.ndarray, class_of: np.ndarray, one: np.ndarray, two: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """What ``forward`` gives as ``p``, without what only the backward pass needs."""
    length, c = x.shape[1], class_of[x]
    at = np.arange(length)
    hit = y[:, :, None] == y[:, None, :]
    bias = np.where(at[None, :] < at[:, None], w["near"][np.maximum(at[:, None] - at[None, :], 0)], np.float32(-1e9))
    a = w["query"][c] @ w["key"][c].transpose(0, 2, 1)
    a += bias
    same = hit[:, :-1, :-1]
    a[:, 1:, 1:] += w["same"][0] * same
    a[:, 2:, 2:] += w["same"][1] * (same[:, 1:, 1:] & same[:, :-1, :-1])
    np.exp(np.minimum(a, 30, out=a), out=a)
    rest = np.exp(np.minimum(w["rest"], 30))[c]
    total = a.sum(2) + rest
    carried = (a @ w["value"][c]) / total[:, :, None]
    a *= hit
    copied = (a.sum(2) + rest * two) / total
    gate = carried + w["gate"][c]
    gate += seen @ w["seen"]
    e0, e1, e2 = (np.exp(np.minimum(gate[:, :, k], 60)) for k in range(3))
    return (e0 * one + e1 * two + e2 * copied) / (e0 + e1 + e2)


def gradients(w: dict, counted: np.ndarray, x, y, class_of, one, two, seen) -> dict[str, np.ndarray]:
    """Mean cross entropy's gradient over the counted positions."""
    f = forward(w, x, y, class_of, one, two, seen)
    a, c, gate = f["a"], f["c"], f["gate"]
    scale = (counted / max(1, counted.sum())).astype(w["query"].dtype)
    ratio = f["parts"] / f["p"][:, :, None]
    dz = gate * (1 - ratio) * scale[:, :, None]
    dcopied = -gate[:, :, 2] / f["p"] * scale
    v = w["value"][c]
    da = dcopied[:, :, None] * f["hit"] + dz @ v.transpose(0, 2, 1)
    drest = dcopied * two
    mean = (a * da).sum(2) + f["rest"] * drest
    ds = a * (da - mean[:, :, None])
    flat = c.ravel()

    def by_class(rows: np.ndarray, width: int) -> np.ndarray:
        out = np.zeros((CLASSES, width), rows.dtype)
        np.add.at(out, flat, rows.reshape(-1, width))
        return out

    length = x.shape[1]
    at = np.arange(length)
    near = np.zeros(WINDOW, ds.dtype)
    np.add.at(near, np.maximum(at[:, None] - at[None, :], 0), ds.sum(0))
    return {"query": by_class(ds @ f["k"], DIM), "key": by_class(ds.transpose(0, 2, 1) @ f["q"], DIM), "value": by_class(a.transpose(0, 2, 1) @ dz, 3),
            "near": near, "same": np.array([(ds * f["same"]).sum(), (ds * f["twice"]).sum()]),
            "rest": by_class(f["rest"] * (drest - mean), 1).ravel(), "gate": by_class(dz, 3), "seen": np.einsum("ntk,nte->ke", seen, dz)}


def windows(n: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions, scored) of windows over ``n`` ids to predict: every one is scored in exactly one window, and from the second window on with OVERLAP
    positions of context at least."""
    start = np.arange(0, max(1, n - OVERLAP), STEP)
    at = start[:, None] + np.arange(WINDOW)[None]
    scored = (at < n) & ((np.arange(WINDOW) >= OVERLAP)[None] | (start == 0)[:, None])
    return np.minimum(at, n - 1), scored


def _windowed(read: dict, ends: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(positions in the flat arrays, scored, text, previous ids) of all windows of a few texts."""
    starts = np.concatenate([[0], ends[:-1]])
    parts = [windows(int(n)) for n in ends - starts]
    at = np.concatenate([p[0] + s for p, s in zip(parts, starts, strict=True)])
    scored = np.concatenate([p[1] for p in parts])
    owner = np.repeat(np.arange(len(parts)), [len(p[0]) for p in parts])
    before = np.concatenate([[end_id], read["ids"][:-1]])
    before[starts] = end_id
    return at, scored, owner, before


def _inputs(read: dict, before: np.ndarray, at: np.ndarray, class_of: np.ndarray, dtype=np.float32) -> tuple:
    seen = np.stack([read["seen_id"][at], read["seen_start"][at]], 2).astype(dtype)
    return before[at], read["ids"][at], class_of, read["one"][at].astype(dtype), read["two"][at].astype(dtype), seen


def text_scores(model: dict, read: dict, ends: np.ndarray, block: int = 64) -> np.ndarray:
    """Log10 probability of each text, its end included."""
    w, class_of = model["weights"], model["class_of"]
    at, scored, owner, before = _windowed(read, ends, len(class_of) - 1)
    out = np.zeros(len(ends))
    longest = np.where(scored.any(1), WINDOW - np.argmax(scored[:, ::-1], axis=1), 0)
    order = np.argsort(longest, kind="stable")
    for low in range(0, len(order), block):
        pick = order[low : low + block]
        length = int(longest[pick].max())
        p = probabilities(w, *_inputs(read, before, at[pick, :length], class_of))
        np.add.at(out, owner[pick], np.where(scored[pick, :length], np.log10(np.maximum(p, 1e-30)), 0).sum(1, dtype=np.float64))
    return out


def _pack(w: dict) -> np.ndarray:
    return np.concatenate([w[k].ravel() for k in sorted(w)]).astype(np.float64)


def _unpack(flat: np.ndarray, like: dict) -> dict:
    out, at = {}, 0
    for k in sorted(like):
        out[k] = flat[at : at + like[k].size].reshape(like[k].shape).astype(np.float32)
        at += like[k].size
    return out


def train_locally(w: dict, class_of: np.ndarray, read: dict, ends: np.ndarray, seed: int = 0) -> tuple[dict, int]:
    """One pass of Adam over the windows of the texts; the weights and the number of positions."""
    at, scored, _, before = _windowed(read, ends, len(class_of) - 1)
    order = np.random.default_rng(seed).permutation(len(at))
    w = {k: v.copy() for k, v in w.items()}
    one, two = ({k: np.zeros_like(v) for k, v in w.items()} for _ in range(2))
    for t, low in enumerate(range(0, len(order), BATCH), 1):
        pick = order[low : low + BATCH]
        for k, g in gradients(w, scored[pick], *_inputs(read, before, at[pick], class_of)).items():
            one[k] = 0.9 * one[k] + 0.1 * g
            two[k] = 0.99 * two[k] + 0.01 * g * g
            w[k] -= (RATE / (1 - 0.9**t) * one[k] / (np.sqrt(two[k] / (1 - 0.99**t)) + 1e-6)).astype(np.float32)
    return w, int(scored.sum())


def gather(training: DataFrame, words: DataFrame, ranks: str) -> Counts:
    """The counts of all training texts (column ``raw``) and their words (word, c)."""
    size = Subwords(ranks).size
    rows = words.mapInArrow(_beginnings(ranks), _COUNTS).unionByName(training.select("raw").mapInArrow(_between(ranks), _COUNTS))
    table = store_table(rows.groupBy("kind", "context", "next").agg(F.sum("n").alias("n")), "id-counts")
    single, first = np.zeros(size + 1), np.zeros(size + 1)
    for r in table.filter("kind = 0").groupBy("next").agg(F.sum("n").alias("n")).collect():  # at most an id each
        single[r["next"]] = r["n"]
    for r in table.filter("kind = 2").collect():
        first[r["next"]] = r["n"]
    kept = []
    for kind, most in ((0, PAIRS), (3, PAIRS), (1, TRIE)):
        mine = table.filter(F.col("kind") == kind)
        often = mine.filter(F.col("n") * most >= int(single.sum())).select("context", "next", "n")
        totals = mine.groupBy("context").agg(F.sum("n").alias("n")).join(often.select("context").distinct(), "context")
        kept.append(Counts.table(often.toArrow(), totals.toArrow()))
    return Counts(size, single, first, *kept)


def fit(training: DataFrame, words: DataFrame, head: dict[bytes, int], ranks: str, rounds: int = ROUNDS) -> dict:
    """Counts, classes and weights from all training texts (columns ``doc_id``, ``raw``); each text takes part in the steps of one round."""
    class_of = subword_classes(head, Subwords(ranks))
    counts = gather(training, words, ranks)
    weights = first_weights()
    shared = training.sparkSession.sparkContext.broadcast((counts, class_of))
    for k in range(rounds):
        current = weights

        def steps(batch: pa.RecordBatch, total: np.ndarray, current=current, k=k) -> None:
            w, reader = current, Reader(shared.value[0], ranks) if batch.num_rows else None
            for at in range(0, batch.num_rows, SLICE):
                texts = [t.as_py().lower().split() for t in batch.column(0).slice(at, SLICE)]
                w, n = train_locally(w, shared.value[1], *reader.read(texts), k)
                total[0, :-1] += n * _pack(w)
                total[0, -1] += n

        dealt = training.filter(F.pmod(F.xxhash64("doc_id"), F.lit(rounds)) == k).select("raw")
        summed = sum_over(dealt, steps, (1, sum(v.size for v in weights.values()) + 1)).ravel()
        if summed[-1]:
            weights = _unpack(summed[:-1] / summed[-1], weights)
    return {"class_of": class_of, "counts": counts, "weights": weights}


# --- scoring ---------------------------------------------------------------------------------------------------------------------

def _scan(shared, ranks: str):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one_blas_thread()
        model, head = shared.value
        get = {w: (c, math.log10(c + 1)) for w, c in head.items()}.get
        reader, row = Reader(model["counts"], ranks), TaskContext.get().partitionId() << 36
        end = get(END)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = [t.as_py().lower().split() for t in part.column(1)]
                columns: dict[str, list] = {k: [] for k in ("row", "n_tokens", "known", "base")}
                others, numbers, ends = [], [], [0]
                for words in texts:
                    known = base = 0
                    for w, n in Counter(words).items():
                        if hit := get(w):
                            known += n
                            base += n * hit[1]
                        else:
                            others.append(w)
                            numbers.append(n)
                    if end:
                        known, base = known + 1, base + end[1]
                    else:
                        others.append(END)
                        numbers.append(1)
                    ends.append(len(others))
                    for k, v in zip(columns, (row, len(words) + 1, known, float(base)), strict=True):
                        columns[k].append(v)
                    row += 1
                score = text_scores(model, *reader.read(texts)) if texts else []
                pairs = pa.StructArray.from_arrays([pa.array(others, pa.binary()), pa.array(numbers, pa.int64())], ["word", "n"])
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.float64()]
                arrays = [pa.array(v, kind) for v, kind in zip(columns.values(), kinds, strict=True)]
                arrays.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pairs))
                yield pa.RecordBatch.from_arrays([part.column(0), *arrays, pa.array(score, pa.float64())],
                                                 ["doc_id", "row", "n_tokens", "known", "base", "rest", "score"])
    return scan


def score(docs: DataFrame, ranks: str, modulus: int = 7, rest: int = 2) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score), a row for each row of ``docs``.

    Learns from rows whose id's crc32 modulo ``modulus`` is not ``rest``; rows without an id are held out. Null and empty texts are the end alone.
    Tokens are ``[^\\x20\\x09-\\x0D]+`` words with A-Z lower-cased and one end. ``score`` is the attention model's log10 probability of the words
    and the end. Without training rows nothing is known and shares are even. Repeated rows count and score like others; other columns are ignored.
    """
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), raw_text().alias("raw"))
    training = slim.filter(~fold_is("doc_id", modulus, rest))
    counts = store_table(word_counts(training), "word-counts")
    total, distinct = counts.agg(F.sum("c"), F.count(F.lit(1))).first()
    total = total or 0
    head = {bytes(r["word"]): r["c"] for r in counts.filter(F.col("c") * HEAD >= total).collect()}
    model = fit(training, counts, head, ranks)
    shared = docs.sparkSession.sparkContext.broadcast((model, head))
    kind = "doc_id long, row long, n_tokens long, known long, base double, rest array<struct<word: binary, n: long>>, score double"
    scanned = store_table(slim.mapInArrow(_scan(shared, ranks), kind), "scanned")
    seldom = scanned.select("row", F.explode("rest").alias("at")).select("row", "at.word", "at.n").join(counts, "word")
    more = seldom.groupBy("row").agg(F.sum("n").alias("more_known"), F.sum(F.col("n") * F.log10(F.col("c") + 1)).alias("more_base"))
    joined = scanned.drop("rest").join(more, "row", "left")
    base = F.col("base") + F.coalesce("more_base", F.lit(0.0)) - F.col("n_tokens") * F.lit(math.log10(total + distinct + 1))
    return joined.select("doc_id", fold_is("doc_id", modulus, rest).alias("held_out"), "n_tokens",
                         (F.col("known") + F.coalesce("more_known", F.lit(0))).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"),
                         base.alias("base_score"), "score")
