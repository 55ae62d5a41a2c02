"""Amendments, supersession, escalation chains and reconciliation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docloom import settings as S
from docloom.operators.scale import literal_map, top_n
from docloom.operators.vector import mean_vectors, nearest, neighbor_pairs

REPLACING = ["replace", "delete"]


def forum_rank(forum: Column) -> Column:
    """Position in the escalation chain; -1 outside it."""
    return F.coalesce(literal_map(S.FORUM_RANK, forum, -1), F.lit(-1))


def _amendment_date() -> Column:
    return F.coalesce(F.col("effective_date"), F.col("created_at").cast("date"))


def approved(edges: DataFrame) -> DataFrame:
    return edges.filter("not needs_review")


# --- amendments --------------------------------------------------------------------------------------------------------

def amendment_chain(hits: DataFrame, amendments: DataFrame, docs: DataFrame) -> DataFrame:
    """Approved amendments of the retrieved sections, exact (document, section) match (G1); read in sort_date order."""
    sections = (hits.filter("section_ref is not null and section_ref <> ''")
                .groupBy("question_id", F.col("doc_id").alias("target_doc_id"), F.col("section_ref").alias("target_section"))
                .agg(F.max_by("chunk_id", "rank").alias("superseded_chunk_id")))
    names = docs.select("doc_id", "filename")
    return (approved(amendments).withColumn("sort_date", _amendment_date())
            .select("amendment_id", "target_doc_id", "target_section", "amendment_doc_id", "action", "new_text", "rationale",
                    "effective_date", "sort_date")
            .join(sections, ["target_doc_id", "target_section"])
            .join(names.select(F.col("doc_id").alias("target_doc_id"), F.col("filename").alias("target_filename")), "target_doc_id")
            .join(names.select(F.col("doc_id").alias("amendment_doc_id"), F.col("filename").alias("amendment_filename")),
                  "amendment_doc_id"))


def apply_supersession(chunks: DataFrame, amendments: DataFrame) -> DataFrame:
    """Mark chunks whose section an approved replace/delete amendment rewrote; the latest one wins."""
    latest = (approved(amendments).filter(F.col("action").isin(REPLACING))
              .groupBy(F.col("target_doc_id").alias("doc_id"), F.col("target_section").alias("section_ref"))
              .agg(F.max_by("amendment_id", F.struct(_amendment_date(), F.col("amendment_id"))).alias("_by")))
    return (chunks.join(latest, ["doc_id", "section_ref"], "left")
            .withColumn("superseded_by_amendment_id", F.coalesce("_by", "superseded_by_amendment_id")).drop("_by"))


def current_sections(chunks: DataFrame, amendments: DataFrame) -> DataFrame:
    """Sections after replaying approved amendments in date order (G4), as rows (doc_id, section_ref, part, ord, text,
    amendment_id, in_force).

    part 0 is the body (original chunks, or the newest replacing text; a deleted section has in_force = false and no
    text), part 1 the additions and clarifications after the newest replace/delete. Rows, not arrays: a section may
    collect any number of additions."""
    acts = approved(amendments).withColumn("sort_key", F.struct(_amendment_date().alias("d"), F.col("amendment_id").alias("id")))
    last = (acts.filter(F.col("action").isin(REPLACING)).groupBy("target_doc_id", "target_section")
            .agg(F.max("sort_key").alias("_last"), F.max_by(F.struct("amendment_id", "action", "new_text"), "sort_key").alias("_act")))
    sections = chunks.filter("section_ref is not null")
    kept = (sections.join(last.select(F.col("target_doc_id").alias("doc_id"), F.col("target_section").alias("section_ref")),
                          ["doc_id", "section_ref"], "left_anti")
            .select("doc_id", "section_ref", F.lit(0).alias("part"), F.lpad(F.col("position").cast("string"), 9, "0").alias("ord"),
                    "text", F.lit(None).cast(amendments.schema["amendment_id"].dataType).alias("amendment_id"),
                    F.lit(True).alias("in_force")))
    known = sections.select(F.col("doc_id").alias("target_doc_id"), F.col("section_ref").alias("target_section")).distinct()
    replaced = (last.join(known, ["target_doc_id", "target_section"])
                .select(F.col("target_doc_id").alias("doc_id"), F.col("target_section").alias("section_ref"), F.lit(0).alias("part"),
                        F.lpad(F.lit("0"), 9, "0").alias("ord"),
                        F.when(F.col("_act.action") == "replace", F.col("_act.new_text")).alias("text"),
                        F.col("_act.amendment_id").alias("amendment_id"), (F.col("_act.action") == "replace").alias("in_force")))
    added = (acts.filter(~F.col("action").isin(REPLACING)).join(last, ["target_doc_id", "target_section"], "left")
             .filter("_last is null or sort_key > _last").join(known, ["target_doc_id", "target_section"])
             .select(F.col("target_doc_id").alias("doc_id"), F.col("target_section").alias("section_ref"), F.lit(1).alias("part"),
                     F.concat_ws("|", F.col("sort_key.d").cast("string"), F.col("sort_key.id").cast("string")).alias("ord"),
                     F.col("new_text").alias("text"), "amendment_id", F.lit(True).alias("in_force")))
    return kept.unionByName(replaced).unionByName(added)


# --- escalations and resolutions -----------------------------------------------------------------------------------------

def resolution_chain(hits: DataFrame, resolutions: DataFrame, chunks: DataFrame, docs: DataFrame) -> DataFrame:
    """Approved resolutions of retrieved escalations with their binding chunk (G2); a missing terminal chunk falls back
    to the first chunk of the terminal document."""
    r = (approved(resolutions).select("resolution_id", "escalation_chunk_id", "terminal_doc_id", "terminal_chunk_id", "topic")
         .join(hits.select("question_id", F.col("chunk_id").alias("escalation_chunk_id"),
                           F.col("filename").alias("escalation_filename"), F.col("section_path").alias("escalation_section")),
               "escalation_chunk_id"))
    # resolutions without a terminal chunk join on a key of their own instead of meeting on NULL in one task
    r = r.withColumn("_t", F.coalesce(F.col("terminal_chunk_id").cast("string"), F.concat(F.lit("none:"), F.col("resolution_id").cast("string"))))
    exact = chunks.select(F.col("chunk_id").cast("string").alias("_t"), F.col("chunk_id").alias("_exact"),
                          F.col("doc_id").alias("_exact_doc"))
    first = (chunks.groupBy(F.col("doc_id").alias("terminal_doc_id"))
             .agg(F.min_by("chunk_id", F.struct("position", "chunk_id")).alias("_first")))
    d = docs.select(F.col("doc_id").alias("binding_doc_id"), F.col("filename").alias("terminal_filename"),
                    F.col("forum").alias("terminal_forum"), F.col("effective_date").alias("terminal_date"))
    return (r.join(exact, "_t", "left").drop("_t").join(first, "terminal_doc_id", "left")
            .withColumn("binding_chunk_id", F.coalesce("_exact", "_first"))
            .withColumn("binding_doc_id", F.coalesce("_exact_doc", F.when(F.col("_first").isNotNull(), F.col("terminal_doc_id"))))
            .filter("binding_chunk_id is not null").join(d, "binding_doc_id").drop("_exact", "_exact_doc", "_first"))


def appended_terminals(hits: DataFrame, chain: DataFrame, chunks: DataFrame, docs: DataFrame) -> DataFrame:
    """The binding chunks that were not retrieved, as rows ranked after the hits of their question."""
    new = (chain.select("question_id", F.col("binding_chunk_id").alias("chunk_id"), "resolution_id")
           .join(hits.select("question_id", "chunk_id"), ["question_id", "chunk_id"], "left_anti")
           .groupBy("question_id", "chunk_id").agg(F.min("resolution_id").alias("_o")))
    base = hits.groupBy("question_id").agg(F.max("rank").alias("_n"))
    keep = [c for c in hits.columns if c in chunks.columns and c not in ("chunk_id", "doc_id", "effective_date")]
    doc_cols = [c for c in hits.columns if c in docs.columns and c not in keep and c not in ("doc_id", "tenant_id")]
    return (new.join(base, "question_id")
            .withColumn("rank", F.col("_n") + F.row_number().over(W.partitionBy("question_id").orderBy("_o", "chunk_id")))
            .join(chunks.select("chunk_id", "doc_id", *keep), "chunk_id").join(docs.select("doc_id", *doc_cols), "doc_id")
            .drop("_n", "_o"))


def append_terminals(hits: DataFrame, chain: DataFrame, chunks: DataFrame, docs: DataFrame) -> DataFrame:
    """Hits plus the binding chunks that were not retrieved, ranked after them."""
    return hits.unionByName(appended_terminals(hits, chain, chunks, docs), allowMissingColumns=True)


def open_escalations(chunks: DataFrame, docs: DataFrame, resolutions: DataFrame) -> DataFrame:
    """Escalation chunks of current documents inside the forum chain with no resolution (G5), with forum_rank."""
    d = docs.filter("superseded_by_id is null").select("doc_id", "forum", forum_rank(F.col("forum")).alias("forum_rank"))
    return (chunks.filter("decision_type = 'escalation'").join(d.filter("forum_rank >= 0"), "doc_id")
            .join(resolutions.select(F.col("escalation_chunk_id").alias("chunk_id")), "chunk_id", "left_anti"))


def _leading_class(chunks: DataFrame, klass: Column, n: int | None) -> DataFrame:
    """Chunks of each document's best class, all or the first n: rows of the best class sort first, so a top-n holds them all."""
    if n is None:
        classed = chunks.withColumn("_class", klass)
        best = classed.groupBy("doc_id").agg(F.min("_class").alias("_best"))
        return classed.join(best, "doc_id").filter("_class = _best").drop("_class", "_best")
    ranked = top_n(chunks.withColumn("_class", klass), ["doc_id"], [F.col("_class"), F.col("position"), F.col("chunk_id")], n, "_r")
    best = ranked.filter("_r = 1").select("doc_id", F.col("_class").alias("_best"))
    return ranked.join(best, "doc_id").filter("_class = _best").drop("_class", "_best", "_r")


def chain_candidates(new_docs: DataFrame, docs: DataFrame, chunks: DataFrame, resolutions: DataFrame, n_open: int = S.MAX_OPEN_ESCALATIONS,
                     n_terminals: int = S.TERMINALS_PER_ESCALATION, max_own: int | None = None, max_own_terminals: int | None = None,
                     **routes: int) -> DataFrame:
    """What a matcher is offered per new document (G6): (doc_id, direction, role, chunk_id, for_escalation).

    Direction A: the ``n_open`` open escalations of lower forums nearest to the document's mean vector (the first by id where it has no
    vector) against its terminal-tagged chunks, else its leading ones. Direction B: own open escalations, each with the ``n_terminals``
    nearest chunks of higher forums. ``max_own`` and ``max_own_terminals`` cut a document's own lists, e.g. 12 and 20."""
    chained = (new_docs.select("tenant_id", "doc_id", forum_rank(F.col("forum")).alias("forum_rank")).filter("forum_rank >= 0"))
    open_esc = open_escalations(chunks, docs, resolutions)
    doc_chunks = chunks.join(chained.select("doc_id", F.col("forum_rank").alias("doc_rank")), "doc_id")

    above = open_esc.select("tenant_id", "chunk_id", "embedding", "forum_rank")
    by_rank = above.withColumn("for_rank", F.explode(F.sequence(F.col("forum_rank") + 1, F.lit(3)))) \
        .filter("forum_rank < 3")
    short = top_n(by_rank.select("tenant_id", "for_rank", "chunk_id"), ["tenant_id", "for_rank"], [F.col("chunk_id")],
                  n_open)
    means = mean_vectors(doc_chunks.select("doc_id", "embedding"))
    upper = (chained.filter("forum_rank > 0")
             .join(doc_chunks.select("doc_id").distinct(), "doc_id", "left_semi").join(means, "doc_id", "left"))
    # a tenant's short list is at most n_open rows per rank, and only documents without any vector meet it
    few = (upper.filter("embedding is null").select("doc_id", "tenant_id", F.col("forum_rank").alias("for_rank"))
           .join(short, ["tenant_id", "for_rank"]).select("doc_id", "chunk_id"))
    near = nearest(upper.filter("embedding is not null").withColumn("question_id", F.col("doc_id")), above, n_open,
                   bucket=F.col("forum_rank"), low=F.lit(0), high=F.col("forum_rank") - 1, **routes)
    many = top_n(near, ["question_id"], [F.col("dist"), F.col("chunk_id")], n_open).select(
        F.col("question_id").alias("doc_id"), "chunk_id")
    esc_a = few.unionByName(many)
    term_a = _leading_class(doc_chunks.join(esc_a.select("doc_id").distinct(), "doc_id", "left_semi"),
                            (~F.col("decision_type").eqNullSafe("terminal")).cast("int"), max_own_terminals)

    own = (doc_chunks.filter("decision_type = 'escalation' and doc_rank < 3")
           .join(resolutions.select(F.col("escalation_chunk_id").alias("chunk_id")), "chunk_id", "left_anti"))
    if max_own is not None:
        own = top_n(own, ["doc_id"], [F.col("position"), F.col("chunk_id")], max_own)
    ranks = docs.filter("superseded_by_id is null").select("doc_id", forum_rank(F.col("forum")).alias("forum_rank"))
    higher = chunks.join(ranks.filter("forum_rank > 0"), "doc_id")
    hits = nearest(own.withColumn("question_id", F.col("chunk_id")), higher, n_terminals,
                   bucket=F.col("forum_rank"), low=F.col("doc_rank") + 1, high=F.lit(3),
                   question_owner="doc_id", item_owner="doc_id", **routes)
    hits = top_n(hits, ["question_id"], [F.col("dist"), F.col("chunk_id")], n_terminals)
    term_b = hits.join(own.select(F.col("chunk_id").alias("question_id"), F.col("doc_id")), "question_id")

    def rows(df: DataFrame, direction: str, role: str, esc: Column) -> DataFrame:
        return df.select("doc_id", F.lit(direction).alias("direction"), F.lit(role).alias("role"), "chunk_id",
                         esc.cast("string").alias("for_escalation"))
    none = F.lit(None)
    return (rows(esc_a, "A", "escalation", none).unionByName(rows(term_a, "A", "terminal", none))
            .unionByName(rows(term_b.select("doc_id", F.col("question_id").alias("chunk_id")).distinct(), "B", "escalation", none))
            .unionByName(rows(term_b, "B", "terminal", F.col("question_id"))))


def validate_links(matches: DataFrame, offered: DataFrame, chunks: DataFrame, docs: DataFrame, resolutions: DataFrame) -> DataFrame:
    """Accepted links (G7). Dropped: ids that were not offered, escalations already resolved, confidence < 0.5. First
    match per escalation wins; needs_review at confidence <= 0.75, when the forum is not higher or the date is earlier.

    matches(doc_id, ord, escalation_chunk_id, terminal_chunk_id, confidence, topic, evidence_span)."""
    offer = offered.select("doc_id", "role", "chunk_id").distinct()
    ok = (matches.filter(F.coalesce("confidence", F.lit(0.0)) >= S.MIN_LINK_CONFIDENCE)
          .join(offer.filter("role = 'escalation'").select("doc_id", F.col("chunk_id").alias("escalation_chunk_id")),
                ["doc_id", "escalation_chunk_id"], "left_semi")
          .join(offer.filter("role = 'terminal'").select("doc_id", F.col("chunk_id").alias("terminal_chunk_id")),
                ["doc_id", "terminal_chunk_id"], "left_semi")
          .join(resolutions.select("escalation_chunk_id"), "escalation_chunk_id", "left_anti"))
    first = top_n(ok, ["escalation_chunk_id"], [F.col("doc_id"), F.col("ord")], 1)
    d = docs.select("doc_id", forum_rank(F.col("forum")).alias("r"), F.col("effective_date").alias("d"))

    def side(name: str) -> DataFrame:
        return (chunks.select(F.col("chunk_id").alias(f"{name}_chunk_id"), "doc_id").join(d, "doc_id")
                .select(f"{name}_chunk_id", F.col("doc_id").alias(f"{name}_doc_id"), F.col("r").alias(f"_{name}_r"),
                        F.col("d").alias(f"_{name}_d")))
    both = first.drop("doc_id").join(side("escalation"), "escalation_chunk_id").join(side("terminal"), "terminal_chunk_id")
    forum_ok = (F.col("_escalation_r") >= 0) & (F.col("_terminal_r") > F.col("_escalation_r"))
    dates_ok = F.coalesce(F.col("_terminal_d") >= F.col("_escalation_d"), F.lit(True))
    blank = lambda c: F.when(F.trim(c) != "", F.trim(c)).alias(c)
    return both.select("escalation_chunk_id", "escalation_doc_id", "terminal_chunk_id", "terminal_doc_id",
                       blank("topic"), blank("evidence_span"), F.col("confidence").alias("extractor_confidence"),
                       ((F.col("confidence") <= S.AUTO_APPLY_CONFIDENCE) | ~forum_ok | ~dates_ok).alias("needs_review"))


def gap_report(chunks: DataFrame, docs: DataFrame, resolutions: DataFrame) -> DataFrame:
    """Escalations without any resolution row (G8), whole texts. A reader sorts by doc_date."""
    d = docs.select("doc_id", "filename", "forum", F.col("effective_date").alias("doc_date"))
    return (chunks.filter("decision_type = 'escalation'").select("chunk_id", "doc_id", "section_path", "text")
            .join(resolutions.select(F.col("escalation_chunk_id").alias("chunk_id")), "chunk_id", "left_anti")
            .join(d, "doc_id"))


# --- reconciliation --------------------------------------------------------------------------------------------------------

def operative_chunks(chunks: DataFrame, n: int | None = None) -> DataFrame:
    """Chunks worth checking per document (G9): terminal decisions, else sections, else all; the first n by position where n is given."""
    klass = (F.when(F.col("decision_type") == "terminal", 0)
             .when(F.coalesce("section_path", F.lit("")) != "", 1).otherwise(2))
    # a terminal chunk that also has a section belongs to class 0 only when the document has terminals, which it then has
    return _leading_class(chunks, klass, n)


def reconcile_pairs(new_docs: DataFrame, docs: DataFrame, chunks: DataFrame, flags: DataFrame, **options) -> DataFrame:
    """Candidate pairs of eligible documents not reconciled before (G10): G9 chunks against the current corpus (V5)."""
    eligible = (new_docs.filter(F.col("doc_type").isin(S.RECONCILED_TYPES)).select("doc_id")
                .join(flags.select(F.col("new_doc_id").alias("doc_id")), "doc_id", "left_anti"))
    live = docs.filter(F.col("doc_type").isin(S.RECONCILED_TYPES) & F.col("superseded_by_id").isNull()).select("doc_id")
    existing = chunks.filter("superseded_by_amendment_id is null").join(live, "doc_id", "left_semi")
    return neighbor_pairs(operative_chunks(chunks.join(eligible, "doc_id", "left_semi")), existing, **options)


def flags_from_verdicts(pairs: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Pending flags from pair verdicts (G11): allowed kind, confidence >= 0.5, an existing pair index."""
    v = verdicts.filter(F.trim("kind").isin(S.FLAG_KINDS) & (F.coalesce("confidence", F.lit(0.0)) >= S.MIN_FLAG_CONFIDENCE))
    return (v.withColumn("kind", F.trim("kind")).join(pairs.drop("dist"), ["new_doc_id", "pair_index"])
            .withColumn("status", F.lit("pending")))


# --- version links ---------------------------------------------------------------------------------------------------------

def _pair(a: str, b: str) -> Column:
    return F.array_sort(F.array(F.col(a).cast("string"), F.col(b).cast("string")))


def version_order(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """older_id / newer_id of each (new_doc_id, existing_doc_id): dated by effective_date, else ingest date; then ingest time."""
    key = F.struct(F.coalesce(F.col("effective_date"), F.col("ingested_at").cast("date")).alias("d"), F.col("ingested_at").alias("t"))
    k = docs.select("doc_id", key.alias("k"))
    both = (pairs.join(k.select(F.col("doc_id").alias("new_doc_id"), F.col("k").alias("_a")), "new_doc_id")
            .join(k.select(F.col("doc_id").alias("existing_doc_id"), F.col("k").alias("_b")), "existing_doc_id"))
    new_is_older = F.col("_a") <= F.col("_b")
    return (both.withColumn("older_id", F.when(new_is_older, F.col("new_doc_id")).otherwise(F.col("existing_doc_id")))
            .withColumn("newer_id", F.when(new_is_older, F.col("existing_doc_id")).otherwise(F.col("new_doc_id"))).drop("_a", "_b"))


def link_versions(links: DataFrame, flags: DataFrame, docs: DataFrame, as_of: Column) -> tuple[DataFrame, DataFrame]:
    """Confirm flags and point the older document at the newer (G12): (documents, flags) after the change.

    links(flag_id, ord): flags to act on, later ``ord`` wins where two touch the same older document. Pending flags of
    the same unordered pair are confirmed too."""
    acted = (flags.join(links, "flag_id").filter(F.col("kind").isin(S.VERSION_KINDS)))
    ordered = version_order(acted, docs)
    pointers = ordered.groupBy(F.col("older_id").alias("doc_id")).agg(
        F.max_by("newer_id", F.struct("ord", "flag_id")).alias("_newer"))
    new_docs = (docs.join(pointers, "doc_id", "left")
                .withColumn("superseded_by_id", F.coalesce("_newer", "superseded_by_id")).drop("_newer"))
    pairs = ordered.select(_pair("new_doc_id", "existing_doc_id").alias("_pair")).distinct().withColumn("_mirror", F.lit(True))
    direct = ordered.select("flag_id", F.lit(True).alias("_direct"))
    marked = (flags.withColumn("_pair", _pair("new_doc_id", "existing_doc_id")).join(pairs, "_pair", "left")
              .join(direct, "flag_id", "left"))
    hit = F.coalesce("_direct", F.lit(False)) | (F.coalesce("_mirror", F.lit(False)) & (F.col("status") == "pending")
                                                 & F.col("kind").isin(S.VERSION_KINDS))
    new_flags = (marked.withColumn("_hit", hit).withColumn("status", F.when(F.col("_hit"), "confirmed").otherwise(F.col("status")))
                 .withColumn("reviewed_at", F.when(F.col("_hit"), as_of).otherwise(F.col("reviewed_at")))
                 .drop("_hit", "_pair", "_mirror", "_direct"))
    return new_docs, new_flags


def unlink_versions(flag_ids: DataFrame, flags: DataFrame, docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Undo version links inside the given flags' pairs and reopen those flags."""
    acted = flags.join(flag_ids.select("flag_id").distinct(), "flag_id", "left_semi")
    edges = (acted.select(F.col("new_doc_id").alias("doc_id"), F.col("existing_doc_id").alias("superseded_by_id"))
             .unionByName(acted.select(F.col("existing_doc_id").alias("doc_id"), F.col("new_doc_id").alias("superseded_by_id")))
             .distinct().withColumn("_cut", F.lit(True)))
    new_docs = (docs.join(edges, ["doc_id", "superseded_by_id"], "left")
                .withColumn("superseded_by_id", F.when(F.col("_cut").isNull(), F.col("superseded_by_id"))).drop("_cut"))
    opened = acted.select("flag_id", F.lit(True).alias("_open"))
    new_flags = (flags.join(opened, "flag_id", "left").withColumn("status", F.when(F.col("_open"), "pending").otherwise(F.col("status")))
                 .withColumn("reviewed_at", F.when(F.col("_open").isNull(), F.col("reviewed_at"))).drop("_open"))
    return new_docs, new_flags


def flag_report(flags: DataFrame, docs: DataFrame, chunks: DataFrame, status: str | None = "pending") -> DataFrame:
    """Flags with both file names, both sections and versions_linked, newest first."""
    rows = flags if status in (None, "all") else flags.filter(F.col("status") == status)

    def doc(name: str) -> DataFrame:
        return docs.select(F.col("doc_id").alias(f"{name}_doc_id"), F.col("filename").alias(f"{name}_filename"),
                           F.col("superseded_by_id").alias(f"_{name}_to"))

    def section(name: str) -> DataFrame:
        return chunks.select(F.col("chunk_id").alias(f"{name}_chunk_id"), F.col("section_path").alias(f"{name}_section"))
    # many flags carry no chunk: those join on a key of their own instead of meeting on NULL in one task
    for c in ("new_chunk_id", "existing_chunk_id"):
        rows = rows.withColumn(c, F.coalesce(F.col(c), F.concat(F.lit("none:"), F.col("flag_id").cast("string"))))
    out = (rows.join(doc("new"), "new_doc_id", "left").join(doc("existing"), "existing_doc_id", "left")
           .join(section("new"), "new_chunk_id", "left").join(section("existing"), "existing_chunk_id", "left"))
    for c in ("new_chunk_id", "existing_chunk_id"):
        out = out.withColumn(c, F.when(~F.col(c).startswith("none:"), F.col(c)))
    linked = F.coalesce((F.col("_new_to") == F.col("existing_doc_id")), F.lit(False)) | F.coalesce(
        F.col("_existing_to") == F.col("new_doc_id"), F.lit(False))
    both = F.col("new_filename").isNotNull() & F.col("existing_filename").isNotNull()
    return (out.withColumn("versions_linked", both & linked)
            .withColumn("new_filename", F.coalesce("new_filename", F.lit("?")))
            .withColumn("existing_filename", F.coalesce("existing_filename", F.lit("?"))).drop("_new_to", "_existing_to")
            .orderBy(F.col("created_at").desc(), "flag_id"))


def resolution_report(resolutions: DataFrame, docs: DataFrame, chunks: DataFrame) -> DataFrame:
    """Escalation-decision links for review with whole texts (G15). Links without a terminal chunk join on a key of their own."""
    none = F.concat(F.lit("none:"), F.col("resolution_id").cast("string"))
    resolutions = resolutions.withColumn("_terminal", F.col("terminal_chunk_id")).withColumn("terminal_chunk_id", F.coalesce(F.col("terminal_chunk_id").cast("string"), none))
    def doc(name: str) -> DataFrame:
        cols = [F.col("doc_id").alias(f"{name}_doc_id"), F.col("filename").alias(f"{name}_filename")]
        return docs.select(*cols, *([F.col("forum").alias("terminal_forum")] if name == "terminal" else []))

    def chunk(name: str) -> DataFrame:
        cols = [F.col("chunk_id").alias(f"{name}_chunk_id"), F.col("text").alias(f"{name}_text")]
        return chunks.select(*cols, *([F.col("section_path").alias("escalation_section")] if name == "escalation" else []))
    return (resolutions.join(doc("escalation"), "escalation_doc_id", "left").join(doc("terminal"), "terminal_doc_id", "left")
            .join(chunk("escalation"), "escalation_chunk_id", "left").join(chunk("terminal"), "terminal_chunk_id", "left")
            .withColumn("escalation_filename", F.coalesce("escalation_filename", F.lit("?")))
            .withColumn("terminal_filename", F.coalesce("terminal_filename", F.lit("?")))
            .withColumn("terminal_chunk_id", F.col("_terminal")).drop("_terminal"))
