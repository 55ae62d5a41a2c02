"""Document fingerprints from spot signatures.

Anchors are the common words of the corpus: those that make up at least one in ANCHOR of all its words, so fewer than ANCHOR words in any number of
languages. Every anchor and the CHAIN content words that follow it make a signature; the fingerprint of a text is the set of its signatures. Texts
with fewer than FEW chains also take the chain that starts at each of their words, so that headlines and texts without anchors have fingerprints too.

Fingerprints are partitioned by set length, in classes of powers of two. The likeness of two is their Jaccard similarity, under FLOOR reported as 0:
sets whose classes or sizes alone keep it under FLOOR are not intersected.

Each text is also compared with the next one by falling id and with itself after an edit that takes in the beginning of the next one. For that, texts
are dealt to ranges of ids once, and the first text of each range is dealt to the range before it as well.
"""

from __future__ import annotations

import hashlib
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import mix64, raw_text
from docloom.session import store_table

ANCHOR, CHAIN, FEW, FLOOR = 1000, 2, 8, 0.05
#: Ranges of ids for each shuffle partition, and at most.
RANGES, MOST_RANGES = 4, 10_000
COUNTER, MEMO, OUT = 400_000, 400_000, 128
NO_ID = -(1 << 63)

_EDGE = b".,;:?!\"'()[]{}<>#%&*_-$|/\\=~^`"


def word_of(token: bytes) -> bytes:
    """The token in lower case (A-Z) without marks at its ends; the whole token where nothing else is left."""
    low = token.lower()
    return low.strip(_EDGE) or low


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    tokens: Counter = Counter()

    def emit() -> pa.RecordBatch:
        words: Counter = Counter()
        for token, n in tokens.items():
            words[word_of(token)] += n
        tokens.clear()
        return pa.RecordBatch.from_arrays([pa.array(list(words), pa.binary()), pa.array(list(words.values()), pa.int64())], ["word", "n"])

    for batch in batches:
        for text in batch.column(0):
            tokens.update(text.as_py().split())
            if len(tokens) > COUNTER:
                yield emit()
    yield emit()


def common_words(docs: DataFrame, share: int = ANCHOR) -> list[bytes]:
    """Words that make up at least one in ``share`` of all words, fewer than ``share`` by arithmetic but for ties at exactly that share."""
    counts = docs.select(raw_text().alias("raw")).mapInArrow(_count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    counts = store_table(counts, "words")
    total = counts.agg(F.sum("n")).first()[0] or 0
    return [bytes(r["word"]) for r in counts.filter(F.col("n") * share >= total).collect()]


class _Codes(dict):
    """For each token met 63 bits of its word's hash, and a last bit that says whether the word is an anchor."""

    def __init__(self, anchors: frozenset[bytes]):
        super().__init__()
        self.anchors = anchors

    def __missing__(self, token: bytes) -> int:
        if len(self) >= MEMO:
            self.clear()
        word = word_of(token)
        self[token] = code = xxhash.xxh3_64_intdigest(word) & ~1 | (word in self.anchors)
        return code


class Signer:
    """Signature sets of texts; remembers the words it has met."""

    def __init__(self, anchors: frozenset[bytes]):
        self.seen = _Codes(anchors)

    def codes(self, tokens: list[bytes]) -> np.ndarray:
        seen = self.seen
        return np.array([seen[t] for t in tokens], np.uint64)

    def joined(self, head: bytes, of_head: np.ndarray, tail: bytes, of_tail: np.ndarray) -> np.ndarray:
        """Codes of ``head + tail``, which begin two texts with known codes: only words at the cuts are looked up."""
        one, two = head.split(), tail.split()
        if not one or not two:
            return self.codes((head + tail).split())
        whole = (head[-1:] + tail[:1]).split()
        seam = [one[-1] + two[0]] if len(whole) == 1 and len(whole[0]) == 2 else [one[-1], two[0]]
        if len(two) == 1:
            return np.concatenate([of_head[: len(one) - 1], self.codes(seam)])
        return np.concatenate([of_head[: len(one) - 1], self.codes(seam), of_tail[1 : len(two) - 1], self.codes(two[-1:])])

    def signatures(self, codes: np.ndarray) -> np.ndarray:
        """Sorted distinct 48-bit hashes."""
        if not len(codes):
            return codes
        anchor = (codes & np.uint64(1)) == 1
        content = codes[~anchor]
        first = np.cumsum(~anchor)[anchor]
        whole = first + CHAIN <= len(content)
        first, found = first[whole], codes[anchor][whole]
        for k in range(CHAIN):
            found = mix64(found * np.uint64(0x9E3779B97F4A7C15) + content[first + k])
        if len(first) < FEW or len(np.unique(first)) < FEW:
            chain = codes
            for k in range(1, CHAIN + 1):
                after = np.concatenate([codes[k:], np.zeros(min(k, len(codes)), np.uint64)])
                chain = mix64(chain * np.uint64(0xD1342543DE82EF95) + after)
            found = np.concatenate([found, chain])
        return np.unique(found >> np.uint64(16))


def written(signatures: np.ndarray) -> str:
    """The fingerprint as text: 12 hexadecimal digits for each signature, in order."""
    return signatures.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 2:].tobytes().hex()


def length_class(size: int) -> int:
    return size.bit_length()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sorted sets, 0 where it is under FLOOR; 1 for two empty ones."""
    few, many = sorted((len(a), len(b)))
    if not many:
        return 1.0
    if length_class(many) - length_class(few) > 1 - math.log2(FLOOR) or few < FLOOR * many:
        return 0.0
    common = len(np.intersect1d(a, b, assume_unique=True))
    found = common / (few + many - common)
    return found if found >= FLOOR else 0.0


def _stream(shared):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signer = Signer(shared.value)
        columns: list[list] = [[] for _ in range(9)]

        def add(row: tuple, following: tuple) -> None:
            doc_id, text, codes, own = row
            cut = len(text) // 3  # the last third gives way to as many characters of the next text, or all it has
            head, tail = text[: len(text) - cut].encode(), following[1][:cut].encode()
            changed = signer.signatures(signer.joined(head, codes, tail, following[2]))
            values = (doc_id, len(text), hashlib.sha256(head + tail).hexdigest(), written(own), written(changed), likeness(own, changed),
                      likeness(own, following[3]), len(own), length_class(len(own)))
            for column, value in zip(columns, values, strict=True):
                column.append(value)

        def flush() -> pa.RecordBatch:
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int64(), pa.int32()]
            out = pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, kinds, strict=True)], _NAMES)
            for c in columns:
                c.clear()
            return out

        segment, waiting = None, None
        for batch in batches:
            for doc_id, text, place, border in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if place != segment:
                    segment, waiting = place, None
                elif waiting is None:
                    continue  # rows behind the first of the next range
                raw = text.as_py()
                codes = signer.codes(raw.encode().split())
                row = (doc_id, raw, codes, signer.signatures(codes))
                if waiting is not None:
                    add(waiting, row)
                waiting = None if border else row
                if len(columns[0]) >= OUT:
                    yield flush()
        yield flush()
    return scan


_NAMES = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "n_signatures", "length_class"]
_KIND = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, "
         "n_signatures long, length_class int")


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, n_signatures, length_class), a row for each row of
    ``docs``.

    The next row is that with the next smaller id, of the last row the first; rows without an id come last, rows that share one in order of a hash
    of their texts. Null texts are empty; an empty text has an empty fingerprint, and two of them are alike. Equal texts have equal fingerprints.
    The only row of a table follows itself. Other columns are ignored; an empty table gives an empty result.
    """
    from pyspark.ml.feature import Bucketizer  # here, so that tasks don't load it

    session = docs.sparkSession
    anchors = session.sparkContext.broadcast(frozenset(common_words(docs)))
    ids = F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID))
    ranges = min(MOST_RANGES, RANGES * int(session.conf.get("spark.sql.shuffle.partitions")))
    only = docs.select(ids.alias("id"))
    cuts = only.agg(F.percentile_approx("id", [k / ranges for k in range(1, ranges)], 100_000)).first()[0] or []
    splits = [-math.inf, *sorted({float(c) for c in cuts or [0]}), math.inf]
    cut = Bucketizer(splits=splits, inputCol="at", outputCol="place")

    def placed(df: DataFrame) -> DataFrame:
        return cut.transform(df.withColumn("at", F.col("id").cast("double"))).drop("at").withColumn("place", F.col("place").cast("int"))

    tops = sorted((tuple(r) for r in placed(only).groupBy("place").agg(F.max("id").alias("id")).collect()), reverse=True)  # a row for each range
    before = [(tops[k - 1][0], top) for k, (_, top) in enumerate(tops)]  # the last range comes before the first
    borders = session.createDataFrame([(top, place) for place, top in before], "id long, before int")
    slim = placed(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), ids.alias("id")))
    here = F.struct(F.col("place"), F.lit(False).alias("border"))
    there = F.struct(F.col("before").alias("place"), F.lit(True).alias("border"))
    dealt = slim.join(F.broadcast(borders), "id", "left")
    dealt = dealt.withColumn("to", F.explode(F.when(F.col("before").isNull(), F.array(here)).otherwise(F.array(here, there))))
    dealt = dealt.select("doc_id", "text", F.col("to.place").alias("place"), F.col("to.border").alias("border"), "id")
    dealt = dealt.repartitionById(len(splits) - 1, F.col("place"))
    ordered = dealt.sortWithinPartitions("place", "border", F.desc("id"), F.xxhash64("text"))
    return ordered.select("doc_id", "text", "place", "border").mapInArrow(_stream(anchors), _KIND)
