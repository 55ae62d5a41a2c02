"""Language identification by compression: the language whose dictionary lets zstandard write the text in the fewest bytes."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docloom.llm.common import fold_is

#: Bounded sample: whole texts of at most ROWS labelled rows of a language, of which DICT_BYTES bytes become its dictionary.
ROWS, DICT_BYTES = 64, 112_640
LEVEL, PIECE_CHARS, MARGIN = 3, 12_000, 0.01

_NO_LETTER = re.compile(r"[\W\d_]+")


def letters(text: str) -> str:
    """Lower case, with one space for whatever stands between letters: case, marks and layout say little about the language."""
    return _NO_LETTER.sub(" ", text.lower())


def learn_dictionaries(docs: DataFrame, rows: int = ROWS, dict_bytes: int = DICT_BYTES) -> dict[str, bytes]:
    """Raw-content dictionaries by language, from rows outside the held-out fold, drawn by a hash of the id. Each drawn text gives an equal
    share of the bytes, taken from its middle; the longest shares stand last, where matches are cheapest."""
    known = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~fold_is("doc_id", 4, 2))
    order = Window.partitionBy("lang").orderBy(F.xxhash64(F.col("doc_id").cast("long")), "doc_id", "text")
    drawn = known.select("doc_id", "lang", "text").withColumn("at", F.row_number().over(order)).filter(F.col("at") <= rows)
    share = dict_bytes // rows
    middle = F.substring("text", F.greatest(F.lit(1), F.floor((F.length("text") - share) / 2).cast("int") + 1), F.lit(share))
    found: dict[str, list[tuple]] = {}
    for row in drawn.select("lang", "at", middle.alias("part")).collect():
        found.setdefault(row["lang"], []).append((len(row["part"]), row["at"], row["part"]))
    return {lang: " ".join(letters(x[2]) for x in sorted(parts)).encode()[-dict_bytes:] for lang, parts in sorted(found.items())}


def _judge(dictionaries: dict[str, bytes]):
    langs = [x for x, content in dictionaries.items() if len(content) >= 8]

    def judge(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        import zstandard as zstd
        packers = []
        for lang in langs:
            content = zstd.ZstdCompressionDict(dictionaries[lang], dict_type=zstd.DICT_TYPE_RAWCONTENT)
            content.precompute_compress(level=LEVEL)
            packers.append(zstd.ZstdCompressor(level=LEVEL, dict_data=content, write_content_size=False, write_dict_id=False))
        for batch in batches:
            out = []
            for text in batch:
                text = text.as_py()
                if not packers or not text or not any(map(str.isalpha, text)):
                    out.append(("und", 0.0, True))
                    continue
                sizes = [0] * len(langs)
                text = letters(text)
                for at in range(0, len(text), PIECE_CHARS):  # short inputs keep the dictionary within reach
                    piece = text[at : at + PIECE_CHARS].encode()
                    for k, packer in enumerate(packers):
                        sizes[k] += len(packer.compress(piece))
                best = min(range(len(langs)), key=lambda k: (sizes[k], k))
                rest = [s for k, s in enumerate(sizes) if k != best]
                margin = (min(rest) - sizes[best]) / min(rest) if rest else 1.0
                out.append((langs[best], 1 / (1 + math.exp(-min(50 * margin, 50.0))), margin < MARGIN))
            yield pa.StructArray.from_arrays([pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.float64()),
                                              pa.array([x[2] for x in out], pa.bool_())], ["lang_pred", "score", "rejected"])
    return F.arrow_udf(judge, "lang_pred string, score double, rejected boolean")


def identify(docs: DataFrame, dictionaries: dict[str, bytes]) -> DataFrame:
    """(doc_id, lang_pred, score, rejected) for each row.

    ``lang_pred`` is the language with the smallest total over the whole text, the first by name in a tie; ``und`` with score 0 where the text
    is null, has no letter, or nothing was learned. ``score`` grows from 0.5 with the relative margin to the second language; ``rejected`` marks
    margins under 1 %. Long texts are compressed in pieces. Repeated rows get equal answers, rows without an id too; other columns are ignored.
    """
    found = docs.select("doc_id", _judge(dictionaries)(F.col("text")).alias("found"))
    return found.select("doc_id", "found.lang_pred", "found.score", "found.rejected")


