"""The operators over the given tables, as registered queries, and their SQL where SQL can express them."""

from __future__ import annotations

import zlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return add


def tokenizer(name: str) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op8_line_dedup", r"""
    WITH lines AS (
      SELECT doc_id, p, list_extract(parts, p) AS line, len(parts) AS n_lines
      FROM (SELECT doc_id, parts, unnest(range(1, len(parts) + 1)) AS p
            FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents))),
    keyed AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(11) || chr(12) || chr(13)),
                'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines),
    frequent AS (SELECT k FROM keyed WHERE length(k) >= 1 GROUP BY k HAVING count(DISTINCT doc_id) >= 10)
    SELECT doc_id, max(n_lines) AS n_lines, count(*) FILTER (WHERE f.k IS NOT NULL) AS n_dropped,
           sha256(coalesce(string_agg(line, chr(10) ORDER BY p) FILTER (WHERE f.k IS NULL), '')) AS kept_sha256
    FROM keyed LEFT JOIN frequent f USING (k) GROUP BY doc_id""")
def op8_line_dedup(spark, sf_dir):
    from docloom.llm.line_runs import dedup_lines
    cut = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return cut.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


@query("op9_exact_dedup", r"""
    WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
    SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, sha256(t) AS text_sha256
    FROM d WINDOW w AS (PARTITION BY t)""")
def op9_exact_dedup(spark, sf_dir):
    from docloom.llm.digest_tree import exact_dedup
    return exact_dedup(table(spark, sf_dir, "documents"))


@query("op6_packing")
def op6_packing(spark, sf_dir):
    from docloom.llm.packing import pack
    pieces = pack(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"), tokenizer("byte_bpe_50k.tiktoken"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


@query("op7_quality")
def op7_quality(spark, sf_dir):
    from docloom.llm.common import fold_is
    from docloom.llm.quality import fit, score
    docs = table(spark, sf_dir, "documents")
    scored = score(docs, fit(docs, table(spark, sf_dir, "labels"), "quality", 5, 0))
    return scored.select("doc_id", fold_is("doc_id", 5, 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


@query("op10_langid")
def op10_langid(spark, sf_dir):
    from docloom.llm.common import fold_is
    from docloom.llm.langid import identify, learn_dictionaries
    docs = table(spark, sf_dir, "documents")
    return identify(docs, learn_dictionaries(docs)).select("doc_id", fold_is("doc_id", 4, 2).alias("held_out"), "lang_pred", "score", "rejected")


@query("op4_pii")
def op4_pii(spark, sf_dir):
    from docloom.llm.pii import KINDS, detect
    found = detect(table(spark, sf_dir, "documents"))
    counts = [F.regexp_count("spans", F.lit(f"{kind}:")).cast("long").alias(f"n_{kind}") for kind in KINDS]
    return found.select("doc_id", *counts, F.sha2("base", 256).alias("base_sha256"), "spans")


@query("op1_toxicity")
def op1_toxicity(spark, sf_dir):
    from docloom.llm.common import fold_is
    from docloom.llm.toxicity import fit, scored
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = scored(docs, fit(docs, table(spark, sf_dir, "labels"), "toxic", 4, 2))
    return found.select("doc_id", fold_is("doc_id", 4, 2).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


@query("op3_minhash_dedup", r"""
    WITH RECURSIVE w AS (
      SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents),
    s AS (SELECT DISTINCT doc_id, array_to_string(list_slice(words, p, p + 4), ' ') AS shingle
          FROM (SELECT *, unnest(range(1, greatest(len(words) - 3, 2))) AS p FROM w WHERE len(words) > 0)),
    n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
    p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b USING (shingle) WHERE a.doc_id < b.doc_id GROUP BY ALL),
    l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
    e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
    r AS (SELECT doc_id AS node, doc_id AS reached FROM documents UNION SELECT r.node, e.b FROM r JOIN e ON e.a = r.reached),
    c AS (SELECT node, min(reached) AS component_id FROM r GROUP BY node)
    SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
    FROM documents d JOIN c ON c.node = d.doc_id LEFT JOIN n USING (doc_id)""")
def op3_minhash_dedup(spark, sf_dir):
    from docloom.llm.minhash import near_components
    return near_components(table(spark, sf_dir, "documents"))


@query("op2_decontaminate")
def op2_decontaminate(spark, sf_dir):
    from docloom.llm.decontam import find_leaks
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("row_key")


@query("op5_attention_lm")
def op5_attention_lm(spark, sf_dir):
    from docloom.llm.attention_lm import score
    return score(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.tiktoken"))


def repeated_tail(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The text of the periodic-run query: for a tenth of the ids the words from a drawn place on repeat with a drawn period."""
    h = zlib.crc32(str(doc_id).encode())
    n, g = len(words), h // 10
    if doc_id is None or h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    tail = words[a : a + p]
    return words[:a] + (tail * (-(-(n - a) // p)))[: n - a]


@query("op13_periodic_runs", r"""
    WITH t AS (
      SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w0,
             xor(4294967295::BIGINT, list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(doc_id::VARCHAR, ''),
               lambda c: [ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
               lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) WHEN c % 2 = 1 THEN xor(c // 2, 3988292384::BIGINT) ELSE c // 2 END)) AS h
      FROM documents),
    u AS (SELECT *, len(w0) AS n, CASE WHEN len(w0) > 0 AND h % 10 = 0 THEN (h // 10) % len(w0) END AS a, h // 10 AS g FROM t),
    d AS (SELECT doc_id, n, CASE WHEN a IS NULL THEN w0 ELSE list_transform(range(0, n),
                   lambda i: w0[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // (3 + g % 8)) END]) END AS w FROM u),
    six AS (SELECT doc_id, i, array_to_string(list_slice(w, i + 1, i + 6), ' ') AS f
            FROM (SELECT doc_id, w, unnest(range(0, n - 5)) AS i FROM d WHERE n >= 12)),
    again AS (SELECT x.doc_id, x.i, y.i - x.i AS q FROM six x JOIN six y ON x.doc_id = y.doc_id AND x.f = y.f AND x.i < y.i),
    island AS (SELECT doc_id, q, i, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM again),
    stretch AS (SELECT doc_id, min(i) AS start, count(*) + 5 + q AS length, q FROM island GROUP BY doc_id, q, island
                HAVING count(*) + 5 + q >= greatest(12, 2 * q)),
    run AS (SELECT doc_id, start, length, min(q) AS period FROM stretch GROUP BY doc_id, start, length),
    gone AS (SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM run),
    kept AS (SELECT s.doc_id, string_agg(s.word, ' ' ORDER BY s.i) AS collapsed
             FROM (SELECT doc_id, unnest(range(0, n)) AS i, unnest(w) AS word FROM d) s ANTI JOIN gone USING (doc_id, i) GROUP BY s.doc_id),
    per AS (SELECT doc_id, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS runs,
                   arg_max(struct_pack(s := start, l := length, p := period), struct_pack(l := length, s := -start, p := -period)) AS best
            FROM run GROUP BY doc_id)
    SELECT d.doc_id, coalesce(n_runs, 0) AS n_runs, best.s AS start, best.l AS length, best.p AS period, (1000 * best.l) // best.p AS exponent_milli,
           sha256(coalesce(runs, '')) AS runs_sha256, sha256(coalesce(collapsed, '')) AS collapsed_sha256
    FROM d LEFT JOIN per USING (doc_id) LEFT JOIN kept USING (doc_id)""")
def op13_periodic_runs(spark, sf_dir):
    from docloom.llm.periodic_runs import periodic_runs
    found = periodic_runs(table(spark, sf_dir, "documents"), rewrite=repeated_tail)
    listed = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    ranked = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    best = found.withColumn("best", F.when(F.size("runs") > 0, ranked))
    length, period = F.col("best.length"), -F.col("best.period")
    return best.select("doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("best.start")).alias("start"), length.alias("length"),
                       period.alias("period"), F.expr("(1000 * best.length) div -best.period").alias("exponent_milli"),
                       F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


@query("op11_norm_buckets", r"""
    WITH t AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                 '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
    s AS (SELECT count(*)::BIGINT AS big_n, sum(len(terms))::BIGINT AS l FROM t WHERE len(terms) > 0),
    c AS (SELECT doc_id, term, max(n)::BIGINT AS n, count(*)::BIGINT AS tf FROM (SELECT doc_id, len(terms) AS n, unnest(terms) AS term FROM t) GROUP BY ALL),
    d AS (SELECT term, floor(1000 * ln((2 * big_n + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM c, s GROUP BY term, big_n),
    i AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
    p AS (SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * big_n) // l))))::BIGINT AS score
          FROM i JOIN d USING (term) JOIN c USING (term), s GROUP BY item_id, doc_id)
    SELECT item_id, rank, doc_id, score
    FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank FROM p WHERE score > 0) WHERE rank <= 10""")
def op11_norm_buckets(spark, sf_dir):
    from docloom.llm.norm_buckets import rank_documents
    return rank_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op12_spot_signatures")
def op12_spot_signatures(spark, sf_dir):
    from docloom.llm.spot_signatures import fingerprints
    return fingerprints(table(spark, sf_dir, "documents"))
