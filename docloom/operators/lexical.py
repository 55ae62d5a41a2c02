"""Inverted index and boolean search with BM25 order (L1-L4)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom import settings as S
from docloom.functions import text as X
from docloom.operators.scale import top_n
from docloom.session import store_table

BM25_K1 = 1.2
BM25_B = 0.75


def counted_texts(rows: DataFrame, id_col: str = "chunk_id", text_col: str = "text") -> DataFrame:
    """A row for each text: (tenant_id, <id>, _t struct<n_tokens, words array<struct<lexeme, tf>>>). Every text is cut once, so store it before its
    parts are used."""
    def entry(tokens: Column) -> Column:
        words = F.transform(X.counted(X.token_forms(tokens), "lexeme"), lambda r: F.struct(r["lexeme"].alias("lexeme"), r["n"].alias("tf")))
        return F.struct(F.size(tokens).alias("n_tokens"), words.alias("words"))

    return rows.select("tenant_id", id_col, X.bound(X.lexical_tokens(F.col(text_col)), entry).alias("_t"))


def shared_ids(rows: DataFrame, id_col: str = "chunk_id") -> DataFrame:
    """Ids (``_id``) that more than one row has."""
    return store_table(rows.groupBy(F.col(id_col).alias("_id")).agg(F.count("*").alias("_n")).filter("_n > 1").select("_id"), "shared-ids")


def build_postings(rows: DataFrame, id_col: str = "chunk_id", text_col: str = "text") -> DataFrame:
    """postings(tenant_id, lexeme, <id>, tf, n_tokens) (L1).

    Words are counted inside their row, without a shuffle of postings. Only rows that share an id with another (looked up first, in a shuffle of
    the ids alone) are counted by (lexeme, id), which spreads even an id of very many rows."""
    def entries(tokens: Column) -> Column:
        return F.transform(X.counted(X.token_forms(tokens), "lexeme"), lambda r: F.struct(r["lexeme"].alias("lexeme"), r["n"].alias("tf"), F.size(tokens).alias("n_tokens")))

    # one expression, as a column of tokens would be built again for each of its uses
    posted = rows.select("tenant_id", id_col, F.explode(X.bound(X.lexical_tokens(F.col(text_col)), entries)).alias("_p")).select(
        "tenant_id", "_p.lexeme", id_col, "_p.n_tokens", "_p.tf")
    shared = shared_ids(rows, id_col)
    if shared.isEmpty():
        return posted
    again = F.col(id_col).eqNullSafe(F.col("_id"))
    merged = (posted.join(shared, again, "left_semi").groupBy("tenant_id", "lexeme", id_col, "n_tokens").agg(F.sum("tf").alias("tf")))
    return posted.join(shared, again, "left_anti").unionByName(merged)


def document_frequencies(postings: DataFrame) -> DataFrame:
    return postings.groupBy("tenant_id", "lexeme").agg(F.count("*").alias("df"))


def index_stats(rows: DataFrame, id_col: str = "chunk_id", text_col: str = "text") -> DataFrame:
    """Texts and mean length per tenant, over texts with at least one token."""
    sized = rows.select("tenant_id", F.size(X.lexical_tokens(F.col(text_col))).alias("_n"))
    some = F.when(F.col("_n") > 0, F.col("_n"))  # a filter would cut the texts into tokens twice
    return sized.groupBy("tenant_id").agg(F.count(some).alias("n_texts"), F.avg(some).alias("avg_tokens")).filter("n_texts > 0")


def query_forms(questions: DataFrame) -> DataFrame:
    """(tenant_id, question_id, grp, form, n_groups): one group per distinct word; its forms are alternatives (L2)."""
    words = F.filter(X.lexical_tokens(F.col("question")), lambda t: ~F.lower(t).isin(S.QUERY_STOP_WORDS))
    w = (X.explode_forms(questions.select("tenant_id", "question_id", F.explode(words).alias("_tok")), "_tok")
         .withColumn("_forms", F.array_sort("_forms"))
         .filter((F.size("_forms") > 0) & ~F.col("_base").isin(S.QUERY_STOP_WORDS)))
    # bounded: the distinct words of one question
    grouped = (w.groupBy("tenant_id", "question_id").agg(F.array_sort(F.collect_set("_forms")).alias("_groups")))
    return (grouped.select("tenant_id", "question_id", F.size("_groups").alias("n_groups"),
                           F.posexplode("_groups").alias("grp", "_forms"))
            .select("tenant_id", "question_id", "n_groups", "grp", F.explode("_forms").alias("form")))


SMALL_FORMS = 200_000
#: Asked words, and hashes of texts to be verified, that are broadcast; beyond it they meet the postings by shuffle.
SMALL_WORDS, SMALL_TEXTS = 500_000, 4_000_000
SEED_GROUPS = 3
SEED_SPREAD = 10


def _fits(df: DataFrame, bound: int) -> bool:
    return df.limit(bound + 1).count() <= bound


def lexical_search(questions: DataFrame, postings: DataFrame, stats: DataFrame, k: int, id_col: str = "chunk_id",
                   allowed: DataFrame | None = None, limit_col: str | None = None, frequencies: DataFrame | None = None,
                   small_forms: int = SMALL_FORMS, small_words: int = SMALL_WORDS, small_texts: int = SMALL_TEXTS) -> DataFrame:
    """Texts matching every word group of a question, BM25 score, best first (L2): (question_id, <id>, score, rank).

    * Posting lists of asked words are written once, and only they are looked at; ``postings`` may be a plan that makes them. When the question
      forms fit ``small_forms`` rows (checked by a bounded fetch) they are broadcast; otherwise they meet the postings by shuffle joins, and only
      the distinct asked words are broadcast as long as they fit ``small_words``.
    * Each question starts from its rarest groups (up to three, none ten times as common as the rarest), whose parts of the score are summed up on
      the way; a frequent word is only checked against the few candidates they share. Questions that have seed groups alone are done with that. The
      others' candidates, while at most ``small_texts``, cut the postings by a hash of the id before the well-spread (lexeme, id) join.

    ``allowed`` (unique ids) restricts texts before ranking. ``k`` bounds every question; ``limit_col`` in questions may
    lower the bound per question. ``frequencies`` is a stored document_frequencies table; without it the frequencies of
    the asked words are counted."""
    forms = query_forms(questions)
    fetched = forms.limit(small_forms + 1).toArrow() if small_forms else None
    small = fetched is not None and fetched.num_rows <= small_forms
    forms = questions.sparkSession.createDataFrame(fetched) if small else store_table(forms, "forms")
    side = F.broadcast if small else (lambda df: df)
    lexemes = forms.select("tenant_id", F.col("form").alias("lexeme")).distinct()
    few = F.broadcast if small or _fits(lexemes, small_words) else (lambda df: df)
    wanted = store_table(postings.join(few(lexemes), ["tenant_id", "lexeme"]), "wanted")
    df = frequencies.join(few(lexemes), ["tenant_id", "lexeme"]) if frequencies is not None else document_frequencies(wanted)
    # bounded: the word groups of one question
    per_group = (forms.join(df.withColumnRenamed("lexeme", "form"), ["tenant_id", "form"], "left")
                 .groupBy("tenant_id", "question_id", "n_groups", "grp")
                 .agg(F.sum("df").alias("_gdf"), F.collect_list(F.when(F.col("df") > 0, F.struct(F.col("form").alias("lexeme"), "df"))).alias("_fs")))
    per_question = (per_group.groupBy("tenant_id", "question_id", "n_groups")
                    .agg(F.array_sort(F.collect_list(F.struct(F.coalesce("_gdf", F.lit(0)).alias("n"), "grp", "_fs"))).alias("_gs"))
                    .filter(F.col("_gs")[0]["n"] > 0))
    seeds = F.filter(F.slice("_gs", 1, SEED_GROUPS), lambda g: g["n"] <= SEED_SPREAD * F.col("_gs")[0]["n"])
    live = (per_question.select("tenant_id", "question_id", "n_groups", F.size(seeds).alias("_n_seeds"), F.posexplode("_gs").alias("_at", "_g"))
            .select("tenant_id", "question_id", "n_groups", "_n_seeds", "_at", F.col("_g.grp").alias("grp"), F.explode("_g._fs").alias("_f"))
            .select("tenant_id", "question_id", "n_groups", "_n_seeds", "_at", "grp", "_f.*").join(stats, "tenant_id"))
    idf = F.log(1 + (F.col("n_texts") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    live = live.withColumn("_idf", idf).drop("n_texts", "df")
    if small:  # no more rows than forms
        live = questions.sparkSession.createDataFrame(live.toArrow(), schema=live.schema)
    else:
        live = store_table(live, "live")
    norm = BM25_K1 * (1 - BM25_B + BM25_B * F.col("n_tokens") / F.col("avg_tokens"))
    part = F.col("_idf") * F.col("tf") * (BM25_K1 + 1) / (F.col("tf") + norm)

    seed = live.filter("_at < _n_seeds").drop("grp")
    lists = wanted if small else wanted.join(few(seed.select("tenant_id", "lexeme").distinct()), ["tenant_id", "lexeme"], "left_semi")
    cand = (lists.join(side(seed), ["tenant_id", "lexeme"]).withColumn("_s", part)
            .groupBy("tenant_id", "question_id", id_col, "n_groups", "_n_seeds")
            .agg(F.bit_or(F.expr("shiftleft(1, _at)")).alias("_bits"), F.sum("_s").alias("_s"))
            .filter(F.expr("_bits = shiftleft(1, _n_seeds) - 1")).drop("_bits"))
    if allowed is not None:
        cand = cand.join(allowed.select(id_col), id_col)
    cand = store_table(cand, "candidates")
    done = cand.filter("_n_seeds = n_groups").select("question_id", id_col, "_s")
    rest = cand.filter("_n_seeds < n_groups")
    hashed = rest.select(F.xxhash64(id_col).alias("_h")).distinct()
    lists = wanted.join(F.broadcast(hashed), F.xxhash64(id_col) == F.col("_h"), "left_semi") if _fits(hashed, small_texts) else wanted
    words = live.filter("_at >= _n_seeds").select("tenant_id", "question_id", "lexeme", "grp", "_idf", "avg_tokens")
    hits = rest.join(side(words), ["tenant_id", "question_id"]).join(lists, ["tenant_id", "lexeme", id_col])
    full = (hits.withColumn("_p", part).groupBy("question_id", id_col, "n_groups", "_n_seeds", "_s")
            .agg(F.size(F.collect_set("grp")).alias("_matched"), F.sum("_p").alias("_p"))
            .filter("_matched + _n_seeds = n_groups").select("question_id", id_col, (F.col("_s") + F.col("_p")).alias("_s")))
    scored = done.unionByName(full).select("question_id", id_col, F.round("_s", 9).alias("score"))
    ranked = top_n(scored, ["question_id"], [F.col("score").desc(), F.col(id_col).asc()], k, "rank")
    if limit_col:
        ranked = (ranked.join(questions.select("question_id", F.col(limit_col).alias("_lim")), "question_id")
                  .filter("rank <= _lim").drop("_lim"))
    return ranked


def title_search(questions: DataFrame, docs: DataFrame, k: int = S.TITLE_DOCS) -> DataFrame:
    """Best documents by file name and stored title (L3): (question_id, doc_id, score, rank)."""
    title = X.title_text(F.col("filename"))
    if "ai_title" in docs.columns:
        title = F.concat_ws(" ", title, F.col("ai_title"))
    titled = docs.select("tenant_id", "doc_id", title.alias("text"))
    return lexical_search(questions, build_postings(titled, "doc_id"), index_stats(titled, "doc_id"), k, "doc_id")


def peek(questions: DataFrame, postings: DataFrame, stats: DataFrame, chunks: DataFrame, k: int = 2,
         max_chars: int = 400, **options) -> DataFrame:
    """Short excerpts of the best lexical hits (L4)."""
    hits = lexical_search(questions, postings, stats, k, **options)
    return (hits.join(chunks.select("chunk_id", "text"), "chunk_id")
            .select("question_id", "rank", "chunk_id", F.col("text").substr(1, max_chars).alias("excerpt")))
