"""A corpus run over ``documents``: toxicity, line dedup, near-dedup, decontamination, packing.

Each stage takes (spark, docs, sf_dir), works on what the stage before kept and returns documents with their own columns; the last returns the
packed pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm.common import fresh, raw_text
from docloom.llm.decontam import find_leaks
from docloom.llm.line_runs import dedup_lines
from docloom.llm.minhash import near_components
from docloom.llm.packing import pack
from docloom.llm.queries import table, tokenizer
from docloom.llm.toxicity import fit, scored
from docloom.session import store_table

TOXIC_AT = 0.3
#: The decoders and learners have no SQL form; the stages are tested against brute force.
ORACLE_SQL = None


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under TOXIC_AT."""
    score = fresh(docs, "score")
    model = fit(docs.select("doc_id", "text"), table(spark, sf_dir, "labels"), "toxic", 4, 2)
    return scored(docs, model, score).filter(F.col(score) < TOXIC_AT).drop(score)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that ten or more of them share. ``n_chars`` follows the text; columns with the names of the operator's own
    counts stay what they were."""
    own = {c: fresh(docs, f"_{c}") for c in docs.columns if c.lower() in ("n_lines", "n_dropped")}
    cut = dedup_lines(docs.withColumnsRenamed(own))
    if "n_chars" in docs.columns:
        cut = cut.withColumn("n_chars", F.when(F.col("n_dropped") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return cut.select(*[F.col(own.get(c, c)).alias(c) for c in docs.columns])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that with the smallest id. Documents without words or without an id all stay."""
    gone = near_components(docs).filter(~F.col("kept")).select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    row_key = fresh(docs, "row_key")
    leaks = store_table(find_leaks(docs, table(spark, sf_dir, "benchmark")).select(F.col("row_key").alias(row_key)).distinct(), "leaks")
    keyed = docs.withColumn(row_key, F.xxhash64("doc_id", raw_text()))
    return keyed.join(leaks, row_key, "left_anti").select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the surviving documents, packed into sequences."""
    pieces = pack(docs, tokenizer("byte_bpe_50k.json"), tokenizer("byte_bpe_50k.tiktoken"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [("toxicity", toxicity), ("line dedup", line_dedup), ("MinHash near-dedup", near_dedup), ("decontamination", decontaminate),
          ("packing", packing)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's result; what each stage keeps is written to the shared folder and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = store_table(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
