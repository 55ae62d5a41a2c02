"""Toxicity of text restored from disguise by noisy-channel decoding.

A character trigram model of all documents is the source model. The channel may write a letter as a look-alike sign ("1", "@", "$"), drop signs
between letters, repeat letters, or put blanks between them. A word that shows any of these becomes a lattice of readings, and Viterbi decoding
keeps the one of least cost; other words have one reading. The restored words are scored by the evidence of labelled training rows.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import labelled_sample

#: At most SAMPLE labelled rows are learned from. Evidence needs MIN_SEEN toxic texts and a lower bound (Z deviations) of PRECISION.
SAMPLE, MIN_SEEN, Z, PRECISION = 20_000, 5, 3.5, 0.5
SYMBOLS = 40  # 0 is the border of a word, 1-26 are a-z, other letters share the rest
MEMO = 300_000
MOST = 3

# Signs and the letters they stand for; cost of each act of the channel in nats.
_SIGNS = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i",
          "|": "il", "+": "t", "€": "e", "(": "c", "<": "c", "¡": "i", "£": "l"}
_SIGN_COST, _DROP_COST, _REPEAT_COST, _KEEP_COST = 1.0, 1.5, 0.7, 8.0
_EDGE = " \t\n\x0b\x0c\r.,;:?\"'“”„«»…()[]{}<>#%&*_-–/\\=~^`"
_ODD = re.compile(r"[^\W\d_][^\w\s'’]+[^\W\d_]|[\d@$!|+€£¡(<][^\W\d_]|[^\W\d_][\d@$!|+€£¡(<]|(.)\1\1")
_SPACED = re.compile(r"(?<!\S)\S(?:\x20\S){2,}(?!\S)")


def symbol(char: str) -> int:
    code = ord(char)
    return code - 96 if 97 <= code <= 122 else 27 + code % (SYMBOLS - 27) if code > 127 and char.isalpha() else 0


_TABLE = np.zeros(0x3000, np.int32)
for _c in range(0x3000):
    _TABLE[_c] = symbol(chr(_c))


def _trigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(SYMBOLS**3, np.int64)
    for batch in batches:
        texts = batch.column(0).to_pylist()
        for at in range(0, len(texts), 256):
            codes = np.frombuffer("\n".join(["", *texts[at : at + 256], "\n"]).lower().encode("utf-32-le"), np.uint32)
            s = _TABLE[np.minimum(codes, len(_TABLE) - 1)]
            if len(s) > 2:
                total += np.bincount((s[:-2] * SYMBOLS + s[1:-1]) * SYMBOLS + s[2:], minlength=SYMBOLS**3)
    seen = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int32()), pa.array(total[seen], pa.int64())], ["code", "n"])


def language_model(docs: DataFrame) -> np.ndarray:
    """Cost (negative log probability) of a character given two before it, from counts over all documents, backed off to shorter contexts."""
    found = docs.select(F.coalesce("text", F.lit("")).alias("text")).mapInArrow(_trigrams, "code int, n long")
    counts = np.zeros(SYMBOLS**3)
    for row in found.groupBy("code").agg(F.sum("n").alias("n")).collect():  # at most SYMBOLS ** 3 rows
        counts[row["code"]] = row["n"]
    three = counts.reshape(SYMBOLS, SYMBOLS, SYMBOLS)
    two, one = three.sum(0), three.sum((0, 1))
    p1 = (one + 1) / (one.sum() + SYMBOLS)
    p2 = (two + 5 * p1) / (two.sum(1, keepdims=True) + 5)
    p3 = (three + 5 * p2) / (three.sum(2, keepdims=True) + 5)
    return -np.log(p3)


def _without_tail(word: str) -> str:
    """The word without marks of emphasis at its end: any of !|+, or one other sign three times or more."""
    cut = word.rstrip("!|+")
    if cut != word or not word or word[-1].isalnum() or word[-1] == "_":
        return cut
    cut = word.rstrip(word[-1])
    return cut if len(word) - len(cut) > 2 else word


class Decoder:
    """Readings of disguised words under the character model."""

    def __init__(self, cost: np.ndarray):
        self.cost = cost.tolist()

    def lattice(self, word: str) -> list[list[tuple[int, str, float]]]:
        """For each position the arcs (next position, letters, channel cost). A run of one sign that is longer than three has arcs from its start
        to its end only: one letter, two, or none of a sign that is no letter, and digits that are kept."""
        arcs: list[list[tuple[int, str, float]]] = [[] for _ in word]
        start = 0
        for c, signs in groupby(word):
            size = sum(1 for _ in signs)
            end = start + size
            letters = c if c.isalpha() else _SIGNS.get(c, "")
            for k in range(start, end if size <= 3 else start + 1):
                here, run = arcs[k], end - k
                for x in letters:
                    price = 0.0 if x == c else _SIGN_COST
                    if size <= 3:
                        here.append((k + 1, x, price))
                    if run > 1:
                        here.append((end, x, price + _REPEAT_COST))
                    if run > 2:
                        here.append((end, x + x, price + _REPEAT_COST))
                if not c.isalpha():
                    here.append((end, "", _DROP_COST))
                    if c.isdigit():
                        here.append((k + 1, c, _KEEP_COST) if size <= 3 else (end, c * size, _KEEP_COST * size))
            start = end
        return arcs

    def decode(self, word: str) -> tuple[str, float]:
        """(reading of least cost, its cost). A run of one letter is kept, made two or one, and never kept beyond three; ties go to the first in order."""
        best: list[dict] = [{} for _ in range(len(word) + 1)]
        best[0][0, 0] = (0.0, None, "")
        cost = self.cost
        for k, arcs in enumerate(self.lattice(word)):
            for state, (paid, _, _) in best[k].items():
                for to, letters, price in arcs:
                    a, b, total = *state, paid + price
                    for x in letters:
                        s = symbol(x)
                        total += cost[a][b][s]
                        a, b = b, s
                    old = best[to].get((a, b))
                    if old is None or total < old[0] - 1e-12:
                        best[to][a, b] = (total, (k, state), letters)
        ends = best[len(word)]
        if not ends:
            return word, math.inf
        state = min(ends, key=lambda s: (ends[s][0] + cost[s[0]][s[1]][0], s))
        total, k, out = ends[state][0] + cost[state[0]][state[1]][0], len(word), []
        while k:
            _, (back, before), letters = best[k][state]
            out.append(letters)
            k, state = back, before
        return "".join(reversed(out)), total

    def word(self, token: str) -> str:
        """The restored form of a blank-free token of lower case, '' if no letter is left."""
        inner = token.strip(_EDGE)
        inner = _without_tail(inner).strip(_EDGE) or inner
        if inner.isalpha() and not _ODD.search(inner):
            return inner
        if not any(map(str.isalpha, inner)):
            return ""
        return self.decode(inner)[0] if _ODD.search(inner) else inner

    def spaced(self, text: str) -> list[str]:
        """Words written with blanks between their letters, where the joined reading costs less than the single letters."""
        found = []
        for m in _SPACED.finditer(text):
            letters = m[0].split(" ")
            joined, price = self.decode("".join(letters))
            apart = sum(self.decode(x)[1] for x in letters if x.isalnum())
            if any(map(str.isalpha, joined)) and price + _DROP_COST < apart:
                found.append(joined)
        return found

    def restore(self, text: str) -> str:
        """The whole text in lower case, word by word, then the words that were spaced out."""
        low = text.lower()
        return " ".join([w for t in low.split() if (w := self.word(t))] + self.spaced(low))


def stems(word: str) -> list[str]:
    """The word itself and its beginnings."""
    return [f"={word}", *(f"^{word[:n]}" for n in (4, 5, 6) if len(word) >= n)]


def features(counts: Counter) -> list[str]:
    """A feature for each stem and each number of times, up to MOST, that the text reaches."""
    return [f"{k}{stem}" for stem, n in counts.items() for k in range(1, min(n, MOST) + 1)]


def _evidence(cost: np.ndarray, wanted: frozenset | None):
    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(cost)
        for batch in batches:
            rows = []
            for text in batch.column(0):
                words = decoder.restore(text.as_py()).split()
                if not words:
                    continue
                cluster = hashlib.sha256(" ".join(words).encode()).digest()  # copies of one text count once, other texts each
                found = features(Counter(s for w in words for s in stems(w)))
                rows += [(f, cluster) for f in found if wanted is None or f in wanted]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in ((0, pa.string()), (1, pa.binary()))], ["feature", "cluster"])
    return collect


def lower_bound(toxic: int, clean: int, z: float = Z) -> float:
    """Lower end of the score interval for the share of toxic texts."""
    n = toxic + clean
    p = toxic / n
    return (p + z * z / (2 * n) - z * math.sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)


def fit(docs: DataFrame, labels: DataFrame, column: str = "toxic", modulus: int = 4, rest: int = 2, rows: int = SAMPLE) -> dict:
    """Character model over all documents, and evidence of words from labelled rows outside the held-out fold."""
    cost = language_model(docs)
    drawn = labelled_sample(labels, column, modulus, rest, rows)
    known = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(drawn), "doc_id").select("text", "label")
    shares = {r["label"]: r["n"] for r in drawn.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}

    def counted(label: int, wanted: frozenset | None) -> DataFrame:
        rows = known.filter(F.col("label") == label).select("text").mapInArrow(_evidence(cost, wanted), "feature string, cluster binary")
        return rows.distinct().groupBy("feature").agg(F.count(F.lit(1)).alias("n"))

    toxic = {r["feature"]: r["n"] for r in counted(1, None).filter(F.col("n") >= MIN_SEEN).collect()}
    clean = {r["feature"]: r["n"] for r in counted(0, frozenset(toxic)).collect()} if toxic else {}
    evidence = {f: p for f, n in toxic.items() if (p := lower_bound(n, clean.get(f, 0))) >= PRECISION}
    total = sum(shares.values())
    return {"cost": cost, "evidence": evidence, "floor": min(0.25, shares.get(1, 0) / total / 2) if total else 0.0}


def _scorer(model):
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        decoder, evidence, floor = Decoder(model.value["cost"]), model.value["evidence"], model.value["floor"]
        known = {f[1:] for f in evidence}
        memo: dict[str, tuple] = {}
        for batch in batches:
            out = []
            for text in batch:
                low = (text.as_py() or "").lower()
                met: Counter = Counter()
                for token in low.split():
                    hit = memo.get(token)
                    if hit is None:
                        if len(memo) >= MEMO:
                            memo.clear()
                        word = decoder.word(token)
                        hit = memo[token] = tuple(s for s in stems(word) if s in known) if word else ()
                    if hit:
                        met.update(hit)
                for word in decoder.spaced(low):
                    met.update(s for s in stems(word) if s in known)
                doubts: dict[str, float] = {}  # stems that begin alike are one piece of evidence
                for feature in features(met):
                    if p := evidence.get(feature):
                        doubts[feature[2:6]] = min(doubts.get(feature[2:6], 1.0), 1 - p)
                out.append(1 - (1 - floor) * math.prod(doubts[s] for s in sorted(doubts)))
            yield pa.array(out, pa.float64())
    return F.arrow_udf(score, "double")


def scored(docs: DataFrame, model: dict, column: str = "score") -> DataFrame:
    """``docs`` with a column of scores from 0 to 1 for each row's whole text: one less the product of the doubts that its evidence leaves, where
    evidence is a word or a beginning of words met once, twice or more often.

    Null, empty and letterless texts get the floor, half the share of label 1 and never over 0.25. Without labelled rows there is no evidence and
    the floor is 0. Equal texts get equal scores; other columns are kept as they are, one named ``column`` is replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return docs.withColumn(column, _scorer(shared)(F.col("text")))


def restored(docs: DataFrame, cost: np.ndarray) -> DataFrame:
    """(doc_id, restored): the decoded text of each row; '' for null."""
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        decoder = Decoder(cost)
        for batch in batches:
            yield pa.array([decoder.restore(t.as_py() or "") for t in batch], pa.string())
    return docs.select("doc_id", F.arrow_udf(run, "string")(F.col("text")).alias("restored"))
