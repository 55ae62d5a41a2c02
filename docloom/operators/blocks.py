"""Posting blocks with upper bounds, and boolean search that skips blocks (L1, L2).

Texts are dealt to segments of similar length, at most about ``SEGMENT`` texts each, the same for all words. A block is what one word has in one
segment: ids, counts and lengths, with the largest BM25 part any of its texts reaches. Short texts reach the largest parts, so segments differ in what
they can offer. A search first reads the heads of the asked words' blocks (no lists): a segment counts for a question if all its word groups have a
block there, and is worth at most the sum of their bounds. Segments are opened from the most valuable on, in rounds, until the next one is worth less
than the k-th score; only the blocks of opened segments are read, and the posting table is never shuffled.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docloom.operators.lexical import BM25_B, BM25_K1, SMALL_FORMS, counted_texts, index_stats, query_forms, shared_ids
from docloom.operators.scale import top_n
from docloom.session import store_table

SEGMENT = 1024
#: A text counts as so many texts of a segment as it has stretches of LONG tokens, one at least, so that a segment of long texts stays small.
LONG = 256
#: Segments that a question opens in the first round; each further round opens GROWTH times as many.
FIRST, GROWTH = 4, 4
#: Block keys of one round that are broadcast; beyond it keys and blocks meet by shuffle.
SMALL_KEYS = 1_000_000


@dataclass
class Index:
    """Stored blocks(tenant_id, lexeme, segment, n, best, <id>s, tfs, lengths) and stats(tenant_id, n_texts, avg_tokens); ``read`` holds the blocks
    that each round of the last search read."""

    blocks: DataFrame
    stats: DataFrame
    id_col: str = "chunk_id"
    read: list[int] = field(default_factory=list)


def _classes(lengths: DataFrame, size: int) -> DataFrame:
    """(n_tokens, _class, _parts) of lengths (n_tokens, _n), a row for each length of a text: texts in order of length, ``size`` at a time; texts of one
    length beyond that are split into parts."""
    room = F.col("_n") * F.greatest(F.lit(1), F.ceil(F.col("n_tokens") / LONG))
    before = F.coalesce(F.sum(room).over(W.orderBy("n_tokens").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return lengths.select("n_tokens", F.floor(before / size).alias("_class"), F.ceil(room / size).alias("_parts"))


def _with_segment(rows: DataFrame, lengths: DataFrame, id_col: str, size: int) -> DataFrame:
    split = F.pmod(F.xxhash64(id_col, "n_tokens"), F.col("_parts"))
    placed = rows.join(F.broadcast(_classes(lengths, size)), "n_tokens")
    return placed.withColumn("segment", F.col("_class") * F.lit(1 << 20) + split).drop("_class", "_parts")


def _segments(postings: DataFrame, id_col: str, size: int) -> DataFrame:
    """Postings with their segment."""
    lengths = postings.select(id_col, "n_tokens").distinct().groupBy("n_tokens").agg(F.count("*").alias("_n"))
    return _with_segment(postings, lengths, id_col, size)


def _part(tf, n_tokens, avg_tokens):
    """The BM25 part of a word, without its idf."""
    return tf * (BM25_K1 + 1) / (tf + BM25_K1 * (1 - BM25_B + BM25_B * n_tokens / avg_tokens))


def _grouped(rows: DataFrame, id_col: str) -> DataFrame:
    """Blocks of postings with segment and avg_tokens, grouped by (word, segment)."""
    # bounded: the texts of one segment
    listed = rows.withColumn("_part", _part(F.col("tf"), F.col("n_tokens"), F.col("avg_tokens"))).groupBy("tenant_id", "lexeme", "segment").agg(
        F.count("*").alias("n"), F.max("_part").alias("best"), F.array_sort(F.collect_list(F.struct(F.col(id_col).alias("id"), "tf", "n_tokens"))).alias("_l"))
    return listed.select("tenant_id", "lexeme", "segment", "n", "best", F.col("_l.id").alias("ids"), F.col("_l.tf").alias("tfs"),
                         F.col("_l.n_tokens").alias("lengths"))


def _blocks_of(texts: pa.Table) -> pa.Table:
    """All blocks of one segment from its texts (tenant_id, segment, avg_tokens, id, n_tokens, words)."""
    texts = texts.sort_by("id").combine_chunks()
    words = texts["words"].combine_chunks()
    sizes = np.diff(words.offsets.to_numpy())
    flat = words.flatten()
    coded = flat.field("lexeme").dictionary_encode()
    codes, tf = coded.indices.to_numpy(), flat.field("tf").to_numpy()
    order = np.argsort(codes, kind="stable")  # ids stay in order inside a block
    owner, codes, tf = np.repeat(np.arange(len(sizes)), sizes)[order], codes[order], tf[order]
    lengths = texts["n_tokens"].to_numpy()[owner]
    start = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]]))
    offsets = pa.array(np.append(start, len(codes)), pa.int32())
    best = np.maximum.reduceat(_part(tf, lengths, texts["avg_tokens"].to_numpy()[owner]), start)
    same = pa.array(np.zeros(len(start), np.int32))
    lists = [pa.ListArray.from_arrays(offsets, v) for v in (texts["id"].combine_chunks().take(pa.array(owner)), pa.array(tf, pa.int64()), pa.array(lengths, pa.int32()))]
    columns = [texts["tenant_id"].take(same), coded.dictionary.take(pa.array(codes[start])), texts["segment"].take(same), pa.array(np.diff(offsets.to_numpy()), pa.int64()), pa.array(best), *lists]
    return pa.table(columns, ["tenant_id", "lexeme", "segment", "n", "best", "ids", "tfs", "lengths"])


def _stored(blocks: DataFrame, stats: DataFrame, id_col: str) -> Index:
    return Index(store_table(blocks.sortWithinPartitions("tenant_id", "lexeme", "segment"), "blocks"), stats, id_col)


def build_blocks(postings: DataFrame, stats: DataFrame, id_col: str = "chunk_id", size: int = SEGMENT) -> Index:
    """Store the blocks of a posting table (L1) in order of words, so that a search reads the files' parts that hold its words. ``stats`` are the
    index_stats of the same texts; bounds and scores use them."""
    stats = store_table(stats, "block-stats")
    return _stored(_grouped(_segments(postings, id_col, size).join(F.broadcast(stats), "tenant_id"), id_col), stats, id_col)


def build_index(rows: DataFrame, postings: DataFrame | None = None, id_col: str = "chunk_id", text_col: str = "text", size: int = SEGMENT) -> Index:
    """Blocks of a posting table of ``rows``, or, without one, of the texts themselves: each text is cut once, goes to its segment as one row, and the
    segment's blocks are built there, so that postings are not shuffled. Only rows that share an id with another are grouped by (word, segment), in
    segments of their own."""
    if postings is not None:
        return build_blocks(postings, index_stats(rows, id_col, text_col), id_col, size)
    texts = store_table(counted_texts(rows, id_col, text_col), "counted-texts").select(
        "tenant_id", id_col, F.col("_t.n_tokens").alias("n_tokens"), F.col("_t.words").alias("words"))
    stats = store_table(texts.filter("n_tokens > 0").groupBy("tenant_id").agg(F.count("*").alias("n_texts"), F.avg("n_tokens").alias("avg_tokens")), "block-stats")
    texts = texts.filter("n_tokens > 0")
    lengths = store_table(texts.groupBy("n_tokens").agg(F.count("*").alias("_n")), "lengths")
    shared = shared_ids(texts, id_col)
    again, some = F.col(id_col).eqNullSafe(F.col("_id")), not shared.isEmpty()
    alone = texts.join(shared, again, "left_anti") if some else texts
    alone = _with_segment(alone.filter(F.size("words") > 0), lengths, id_col, size).join(F.broadcast(stats), "tenant_id")
    kinds = {k: rows.schema[c].dataType.simpleString() for k, c in (("tenant", "tenant_id"), ("id", id_col))}
    blocks = (alone.select("tenant_id", "segment", "avg_tokens", F.col(id_col).alias("id"), "n_tokens", "words").groupBy("tenant_id", "segment")
              .applyInArrow(_blocks_of, f"tenant_id {kinds['tenant']}, lexeme string, segment long, n long, best double, ids array<{kinds['id']}>, tfs array<long>, lengths array<int>"))
    if some:
        posted = texts.join(shared, again, "left_semi").select("tenant_id", id_col, "n_tokens", F.explode("words").alias("_w"))
        merged = posted.groupBy("tenant_id", F.col("_w.lexeme").alias("lexeme"), id_col, "n_tokens").agg(F.sum("_w.tf").alias("tf"))
        merged = _with_segment(merged, lengths, id_col, size).withColumn("segment", -1 - F.col("segment"))
        blocks = blocks.unionByName(_grouped(merged.join(F.broadcast(stats), "tenant_id"), id_col))
    return _stored(blocks, stats, id_col)


def block_search(questions: DataFrame, index: Index, k: int, allowed: DataFrame | None = None, limit_col: str | None = None) -> DataFrame:
    """Texts matching every word group of a question, BM25 score, best first: (question_id, <id>, score, rank), the rows of ``lexical_search``.

    Scores are rounded to nine digits, and a segment is left only if its bound is below the k-th score by more than that. ``allowed`` restricts texts
    before ranking; ``limit_col`` in questions may lower ``k`` per question."""
    forms = query_forms(questions)
    fetched = forms.limit(SMALL_FORMS + 1).toArrow()
    small = fetched.num_rows <= SMALL_FORMS
    forms = questions.sparkSession.createDataFrame(fetched) if small else store_table(forms, "forms")
    side = F.broadcast if small else (lambda df: df)
    asked = forms.withColumnRenamed("form", "lexeme")
    # few asked words: their blocks are picked in one pass over the index, which the rounds then need not scan again
    words = asked.select("tenant_id", "lexeme").distinct()
    blocks = store_table(index.blocks.join(F.broadcast(words), ["tenant_id", "lexeme"]), "asked-blocks") if small else index.blocks
    heads = blocks.select("tenant_id", "lexeme", "segment", "n", "best")
    heads = store_table(heads if small else heads.join(words, ["tenant_id", "lexeme"]), "heads")
    df = heads.groupBy("tenant_id", "lexeme").agg(F.sum("n").alias("df")).join(F.broadcast(index.stats), "tenant_id")
    idf = F.log(1 + (F.col("n_texts") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    worth = store_table(asked.join(df, ["tenant_id", "lexeme"]).withColumn("idf", idf), "worth")  # at most a row for each form
    by_group = (heads.select("tenant_id", "lexeme", "segment", "best").join(side(worth), ["tenant_id", "lexeme"])
                .groupBy("tenant_id", "question_id", "n_groups", "segment", "grp").agg(F.sum(F.col("idf") * F.col("best")).alias("_b")))
    by_segment = (by_group.groupBy("tenant_id", "question_id", "n_groups", "segment").agg(F.count("*").alias("_g"), F.sum("_b").alias("bound"))
                  .filter("_g = n_groups"))
    order = W.partitionBy("question_id").orderBy(F.desc("bound"), "segment")
    queue = store_table(by_segment.withColumn("place", F.row_number().over(order) - 1).drop("_g", "n_groups"), "queue")
    found, first, width = None, 0, FIRST
    index.read.clear()
    while True:
        opened = queue.filter((F.col("place") >= first) & (F.col("place") < first + width))
        if found is not None:
            least = found.filter(F.col("rank") == k).select("question_id", F.col("score").alias("_least"))
            opened = opened.join(least, "question_id", "left").filter(F.col("_least").isNull() | (F.col("bound") >= F.col("_least") - 1e-8)).drop("_least")
        lists = store_table(opened.join(worth, ["tenant_id", "question_id"]).select(
            "tenant_id", "question_id", "n_groups", "segment", "grp", "lexeme", "idf"), "opened")
        if lists.isEmpty():
            break
        keys = lists.select("tenant_id", "lexeme", "segment").distinct()
        n_keys = keys.count()
        met = blocks.join(F.broadcast(keys) if n_keys <= SMALL_KEYS else keys, ["tenant_id", "lexeme", "segment"])
        met = store_table(met, "met")
        index.read.append(met.count())
        part = _scored(met, lists, index, allowed)
        both = part if found is None else part.unionByName(found.drop("rank"))
        found = store_table(top_n(both, ["question_id"], [F.desc("score"), F.asc(index.id_col)], k, "rank"), "found")
        first, width = first + width, width * GROWTH
    if found is None:
        kinds = f"question_id {questions.schema['question_id'].dataType.simpleString()}, {index.id_col} {index.blocks.schema['ids'].dataType.elementType.simpleString()}"
        return questions.sparkSession.createDataFrame([], f"{kinds}, score double, rank int")
    if limit_col:
        limits = questions.select("question_id", F.col(limit_col).alias("_lim"))
        found = found.join(limits, "question_id").filter("rank <= _lim").drop("_lim")
    return found.select("question_id", index.id_col, "score", "rank")


def _scored(met: DataFrame, lists: DataFrame, index: Index, allowed: DataFrame | None) -> DataFrame:
    """Scores of the texts of opened segments that hold all groups of a question. Each question meets a segment's rarest group first; the other
    lists are only joined with the ids that this leaves."""
    sized = met.select("tenant_id", "lexeme", "segment", "n")
    rarest = (lists.join(sized, ["tenant_id", "lexeme", "segment"]).groupBy("question_id", "segment", "grp").agg(F.sum("n").alias("_n"))
              .groupBy("question_id", "segment").agg(F.min_by("grp", F.struct("_n", "grp")).alias("grp")))
    seed = lists.join(rarest, ["question_id", "segment", "grp"]).select("tenant_id", "question_id", "segment", "lexeme")
    keys = ["tenant_id", "lexeme", "segment"]
    ids = met.select(*keys, F.explode("ids").alias(index.id_col)).join(seed, keys).select("question_id", "segment", index.id_col).distinct()
    if allowed is not None:
        ids = ids.join(allowed.select(index.id_col), index.id_col, "left_semi")
    posted = met.select(*keys, F.explode(F.arrays_zip("ids", "tfs", "lengths")).alias("_p")).select(
        *keys, F.col("_p.ids").alias(index.id_col), F.col("_p.tfs").alias("tf"), F.col("_p.lengths").alias("n_tokens"))
    hits = ids.join(lists, ["question_id", "segment"]).join(posted, [*keys, index.id_col]).join(F.broadcast(index.stats), "tenant_id")
    norm = BM25_K1 * (1 - BM25_B + BM25_B * F.col("n_tokens") / F.col("avg_tokens"))
    word = F.col("idf") * F.col("tf") * (BM25_K1 + 1) / (F.col("tf") + norm)
    return (hits.groupBy("question_id", index.id_col, "n_groups").agg(F.size(F.collect_set("grp")).alias("_m"), F.round(F.sum(word), 9).alias("score"))
            .filter("_m = n_groups").select("question_id", index.id_col, "score"))
