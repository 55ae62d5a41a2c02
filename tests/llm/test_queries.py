"""Digest columns of registered queries against plain re-computation from the written contract, and long texts."""

import hashlib
import time
import zlib
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from docloom.llm import pii, toxicity
from docloom.llm.queries import QUERIES, tokenizer
from tests.llm.test_operators import plain, rows


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    texts = [t for _, t, *_ in rows()]
    texts += ["write to a.b@c.org or +49 (30) 1234-56789, 10.0.0.1 or 4111 1111 1111 1111.", "name at host.com", "jane dot doe at mail dot example dot org",
              "plus four nine three zero one two three four five six seven", "a@b.c" * 40, "1.2.3.4.5 and 300.1.1.1", "ｊｏｅ@ｈｏｓｔ.com", "no dots at all. then more"]
    held = list(enumerate(texts))
    spark.createDataFrame(held, "doc_id long, text string").repartition(3).write.parquet(f"{path}/documents.parquet")
    return path, dict(held)


def written(spans):
    return ",".join(f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in spans)


def test_pii_query(spark, folder):
    path, held = folder
    got = {r["doc_id"]: r for r in QUERIES["op4_pii"](spark, path).collect()}
    assert set(got) == set(held)
    added = 0
    for i, text in held.items():
        base, row = plain(text or ""), got[i]
        assert row["base_sha256"] == hashlib.sha256(written(base).encode()).hexdigest()
        spans = [s.split(":") for s in row["spans"].split(",") if s]
        found = [(int(a), pii.KINDS.index(kind), int(b)) for kind, a, b in spans]
        assert found == sorted(found) and set(base) <= set(found)
        for k, kind in enumerate(pii.KINDS):
            assert row[f"n_{kind}"] == sum(x == k for _, x, _ in found)
        for start, k, end in set(found) - set(base):  # what the method adds is plain once it is rewritten
            inner = pii.rewritten(text[start:end]).text
            assert any(x == k for _, x, _ in plain(inner)), (text[start:end], inner)
            added += 1
    assert added >= 4


def test_packing_query(spark, folder):
    path, held = folder
    reference = Tokenizer.from_file(tokenizer("byte_bpe_50k.json"))
    reference.encode_special_tokens = True
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in QUERIES["op6_packing"](spark, path).collect():
        pieces[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    assert set(pieces) == set(held)
    for i, text in held.items():
        ids = [*reference.encode(text or "", add_special_tokens=False).ids, 0]
        end = 0
        for r in sorted(pieces[i], key=lambda r: r["start"]):
            assert r["start"] == end and r["doc_tokens"] == len(ids)
            end += r["length"]
            assert r["ids_crc32"] == zlib.crc32(np.array(ids[r["start"] : end], "<u4").tobytes())
        assert end == len(ids)
    for spots in sequences.values():
        end = 0
        for offset, length in sorted(spots):
            assert offset == end
            end += length
        assert end <= 1024


def test_long_runs_of_one_sign():
    decoder = toxicity.Decoder(np.random.default_rng(0).random((toxicity.SYMBOLS,) * 3) * 5)
    for word, size in (("a" * 200_000, 1), ("b" + "!" * 200_000, 1), ("1" * 200_000, 0), ("x" + "@" * 100_000 + "y", None)):
        start = time.time()
        read = decoder.word(word)
        assert time.time() - start < 5
        assert size is None or len(read) in (size, size + 1)


def test_tail_of_emphasis():
    import re
    tail = re.compile(r"(\W)\1{2,}$|[!|+]+$")
    for word in ("ab!!!", "ab@@@", "ab!@@@", "ab+|!", "ab__", "ab???x", "", "!!!", "a€€€", "ab@@", "abc"):
        assert toxicity._without_tail(word) == tail.sub("", word)
