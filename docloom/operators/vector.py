"""Batch embedding and exact nearest-neighbour search (V1-V8)."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom import settings as S
from docloom.operators import cells as C
from docloom.operators.scale import literal_map, top_n
from docloom.session import store_table

Embedder = Callable[[list[str]], "list[list[float]] | np.ndarray"]

BROADCAST_BYTES = 64 << 20
BLOCK_BYTES = 128 << 20
TILE_BYTES = 16 << 20
#: Blocks below this size travel together, so that their number doesn't multiply the rows that are sent.
SLICE_BYTES = 16 << 20
#: Most scopes whose numbers of blocks are sent to every task.
GRID_ROWS = 1_000_000
#: Questions and items of one product of matrices between slices, and pairs that are looked at singly at once.
QUESTIONS_AT_ONCE, ITEMS_AT_ONCE, PAIRS_AT_ONCE = 512, 2048, 1 << 16
_OUT = "question_id {q}, item_id {v}, bucket int, dist double"


# --- V8 embedding --------------------------------------------------------------------------------------------------------

_TOKEN = re.compile("[A-Za-z0-9֐-׿]+")


@lru_cache(maxsize=1 << 16)
def _slot(token: str, dims: int) -> int:
    return int(hashlib.md5(token.encode()).hexdigest()[:6], 16) % dims


def hashed_words(dims: int = 64) -> Embedder:
    """Offline embedder: token counts hashed into ``dims`` slots, scaled to unit length (zero vector for no tokens)."""
    def embed(texts: list[str]) -> np.ndarray:
        words = [_TOKEN.findall(t or "") for t in texts]
        slots = [_slot(w, dims) for part in words for w in map(str.lower, part)]
        at = np.repeat(np.arange(len(texts)), [len(part) for part in words]) * dims + np.asarray(slots, dtype=np.int64)
        out = np.bincount(at, minlength=len(texts) * dims).reshape(len(texts), dims).astype(float)
        return out / np.maximum(np.sqrt((out * out).sum(axis=1, keepdims=True)), 1)
    return embed


def embed(df: DataFrame, text_col: str, embedder: Embedder | None = None, out_col: str = "embedding",
          batch: int = 96, tries: int = 3) -> DataFrame:
    """Add ``out_col`` (V8): provider batches of at most ``batch`` texts, order kept, up to ``tries`` attempts each."""
    call = embedder or hashed_words()

    @F.arrow_udf("array<double>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            vectors = [pa.array([], pa.list_(pa.float64()))]
            for start in range(0, len(texts), batch):
                part = [t or "" for t in texts.slice(start, batch).to_pylist()]
                for attempt in range(tries):
                    try:
                        found = call(part)
                        break
                    except Exception:
                        if attempt == tries - 1:
                            raise
                vectors.append(pa.array([None if v is None else np.asarray(v, dtype=float) for v in found], pa.list_(pa.float64())))
            yield pa.concat_arrays(vectors)

    return df.withColumn(out_col, run(text_col))


def stale_embeddings(docs: DataFrame, model: str) -> DataFrame:
    """Documents whose vectors come from another model (V6); a missing marker counts as stale."""
    return docs.filter(~F.col("embedding_model").eqNullSafe(F.lit(model)))


def reembed(chunks: DataFrame, docs: DataFrame, embedder: Embedder | None = None, model: str = "hashed-words") -> DataFrame:
    """New state of the chunks of stale documents (V7); write it back with replace_by_document."""
    from docloom.operators.documents import with_embedding_input
    stale = stale_embeddings(docs, model).select("doc_id", "filename")
    renewed = embed(with_embedding_input(chunks.drop("embedding").join(stale, "doc_id")), "embedding_input", embedder)
    return renewed.drop("embedding_input", "filename").withColumn("embedding_model", F.lit(model))


# --- exact nearest neighbours ----------------------------------------------------------------------------------------------

def _unit(vectors: list) -> np.ndarray:
    m = np.asarray(np.stack([np.asarray(v, dtype=np.float64) for v in vectors]))
    norm = np.linalg.norm(m, axis=1, keepdims=True)
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(norm > 0, m / norm, np.nan)


def _best(dist: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k smallest (dist, id); equal distances at the border are settled by id."""
    ok = np.flatnonzero(np.isfinite(dist))
    if len(ok) > k:
        ok = ok[dist[ok] <= np.partition(dist[ok], k - 1)[k - 1]]
    return ok[np.lexsort((ids[ok], dist[ok]))[:k]]


class _Block:
    """Questions of one scope: unit matrix plus bucket range and owner to skip."""

    def __init__(self, pdf: pd.DataFrame) -> None:
        self.ids = pdf["question_id"].to_numpy()
        self.low, self.high = pdf["low"].to_numpy(), pdf["high"].to_numpy()
        self.owner = pdf["owner"].to_numpy()
        self.matrix = _unit(pdf["embedding"].tolist())

    def _tiles(self, rows: np.ndarray, items_t: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(places in ``rows``, distances of these questions to the items), in matrices of at most TILE_BYTES."""
        step = max(1, TILE_BYTES // (8 * max(1, items_t.shape[1])))
        for start in range(0, len(rows), step):
            part = rows[start:start + step]
            yield np.arange(start, start + len(part)), 1.0 - self.matrix[part] @ items_t

    def search(self, items: pd.DataFrame, k: int, best: dict, carry: list[str]) -> None:
        """Merge the k nearest items per (question, bucket) into ``best``. Only items within a question's k-th distance so far are looked at singly."""
        for bucket, part in items.groupby("bucket", sort=False):
            rows = np.flatnonzero((self.low <= bucket) & (bucket <= self.high))
            if not len(rows):
                continue
            vid, owner = part["item_id"].to_numpy(), part["owner"].to_numpy()
            extra = [part[c].to_numpy() for c in carry]
            items_t = _unit(part["embedding"].tolist()).T
            keys = [(q, int(bucket)) for q in self.ids[rows]]
            limit = np.array([best[key][1][-1] if key in best and len(best[key][1]) == k else np.inf for key in keys])
            for places, dist in self._tiles(rows, items_t):
                near = dist <= limit[places][:, None] + 1e-8  # far above the rounding below
                for at in np.flatnonzero(near.any(axis=1)).tolist():
                    cols_at = np.flatnonzero(near[at])
                    d = np.round(dist[at, cols_at], 9)
                    mine = self.owner[rows[places[at]]]
                    if mine is not None and mine == mine:
                        d = np.where(owner[cols_at] == mine, np.nan, d)
                    keep = _best(d, vid[cols_at], k)
                    if not len(keep):
                        continue
                    chosen = cols_at[keep]
                    cols = [vid[chosen], d[keep], *(e[chosen] for e in extra)]
                    key = keys[places[at]]
                    if key in best:
                        cols = [np.concatenate(pair) for pair in zip(best[key], cols)]
                        keep = _best(cols[1], cols[0], k)
                        cols = [c[keep] for c in cols]
                    best[key] = cols


def _rows(best: dict, carry: list[str], keys: list | None = None) -> pd.DataFrame:
    """Kept items of the keys as one frame, column by column: rows as Python objects would take many times their size."""
    keys = list(best) if keys is None else keys
    names = ["item_id", "dist", *carry]
    out = {name: np.concatenate([best[key][k] for key in keys]) if keys else [] for k, name in enumerate(names)}
    sizes = [len(best[key][0]) for key in keys]
    for k, name in enumerate(("question_id", "bucket")):
        out[name] = np.repeat(pd.Series([key[k] for key in keys]).to_numpy(), sizes) if keys else []
    return pd.DataFrame(out)[["question_id", "item_id", "bucket", "dist", *carry]]


def _frames(best: dict, carry: list[str], size: int = 1024) -> Iterator[pd.DataFrame]:
    """The same rows in frames of ``size`` keys, which leave ``best`` as they are handed on."""
    while best:
        keys = list(islice(best, size))
        yield _rows(best, carry, keys)
        for key in keys:
            del best[key]


def nearest(questions: DataFrame, items: DataFrame, k: int, *, scope: str | None = "tenant_id",
            item_id: str = "chunk_id", bucket: Column | None = None, low: Column | None = None,
            high: Column | None = None, question_owner: str | None = None, item_owner: str | None = None,
            carry: tuple[str, ...] = (),
            broadcast_bytes: int = BROADCAST_BYTES, block_bytes: int = BLOCK_BYTES, cells: C.Cells | None = None) -> DataFrame:
    """Exact k nearest items per (question, bucket) by cosine distance: question_id, <item_id>, bucket, dist, rank.

    A question sees items of its own scope, of buckets in [low, high], and not of its own owner. Zero vectors have no
    direction and are left out. Three routes give equal rows:

    * with ``cells``, the measured clustering of ``items`` (which then carry their ``cell``, see ``cells.build_cells``), questions visit their nearest
      cells and then meet only the members of cells that can still improve their k nearest;
    * questions that fit ``broadcast_bytes`` (checked on a bounded fetch) are broadcast as matrices; one scan of the items keeps k
      survivors per question and task;
    * otherwise questions and items are hashed into blocks of ``block_bytes``, as many as fit SLICE_BYTES travel as one slice, and every pair of
      slices meets in one bounded cogroup task, so neither a hot scope nor a large question table lands in one place.
    """
    qtype = questions.schema["question_id"].dataType.simpleString()
    vtype = items.schema[item_id].dataType.simpleString()
    carry = list(carry)
    schema = _OUT.format(q=qtype, v=vtype) + "".join(
        f", {c} {items.schema[c].dataType.simpleString()}" for c in carry)
    q = questions.filter("embedding is not null").select(
        (F.col(scope).cast("string") if scope else F.lit("")).alias("scope"), "question_id",
        (low if low is not None else F.lit(0)).cast("int").alias("low"),
        (high if high is not None else F.lit(0)).cast("int").alias("high"),
        (F.col(question_owner) if question_owner else F.lit(None)).cast("string").alias("owner"), "embedding")
    v = items.filter("embedding is not null").select(
        (F.col(scope).cast("string") if scope else F.lit("")).alias("scope"), F.col(item_id).alias("item_id"),
        (bucket if bucket is not None else F.lit(0)).cast("int").alias("bucket"),
        (F.col(item_owner) if item_owner else F.lit(None)).cast("string").alias("owner"), "embedding",
        *carry, *(["cell"] if cells is not None else [])).filter("bucket is not null")
    q = q.filter("low is not null and high is not null and scope is not null")

    first = q.select(F.size("embedding").alias("dims")).head(1)
    row_bytes = 8 * (first[0]["dims"] if first else 1) + 64
    if cells is not None:
        partial = C.search(q, v, cells, k, lambda qs, vs, bounds=None: _by_blocks(qs, vs, k, schema, row_bytes, block_bytes, carry, bounds))
        return top_n(partial, ["question_id", "bucket"], [F.col("dist"), F.col("item_id")], k, "rank").withColumnRenamed("item_id", item_id)
    fits = broadcast_bytes // row_bytes
    local = q.limit(fits + 1).toPandas() if fits else None
    if local is not None and len(local) <= fits:
        shared = q.sparkSession.sparkContext.broadcast(
            {s: _Block(part.reset_index(drop=True)) for s, part in local.groupby("scope", sort=False)})

        def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            best: dict = {}
            for pdf in batches:
                for s, part in pdf.groupby("scope", sort=False):
                    if s in shared.value:
                        shared.value[s].search(part, k, best, carry)
            yield from _frames(best, carry)

        partial = v.mapInPandas(scan, schema)
    else:
        partial = _by_blocks(q, v, k, schema, row_bytes, block_bytes, carry)
    ranked = top_n(partial, ["question_id", "bucket"], [F.col("dist"), F.col("item_id")], k, "rank")
    return ranked.withColumnRenamed("item_id", item_id)


def _by_blocks(q: DataFrame, v: DataFrame, k: int, schema: str, row_bytes: int, block_bytes: int,
               carry: list[str], cells: C.Cells | None = None) -> DataFrame:
    """Partial rows of all pairs of slices. With ``cells``, questions carry the ``limit`` of their k-th distance and items their ``cell``; items of a
    cell stay together, and a question meets only the cells that its limit allows."""
    per_slice = max(1, max(block_bytes, SLICE_BYTES) // row_bytes)
    q_sizes = q.groupBy("scope").agg(F.count("*").alias("_nq"))
    v_sizes = v.groupBy("scope").agg(F.count("*").alias("_nv"))
    # twice the mean fill, so hashing noise stays under the size of a slice
    grid = q_sizes.join(v_sizes, "scope").select(
        "scope", F.ceil(2 * F.col("_nq") / per_slice).alias("_na"), F.ceil(2 * F.col("_nv") / per_slice).alias("_nb"))
    # few scopes go to every task: joined by a shuffle, all rows of a hot scope would pass one task first
    grid = store_table(grid, "grid")
    if grid.count() <= GRID_ROWS:
        grid = F.broadcast(grid)
    piece = F.col("item_id")
    if cells is not None:  # at most MOST_CELLS rows
        pieces = v.groupBy("cell").agg(F.ceil(4 * F.count("*") / per_slice).alias("_pieces"))
        v = v.join(F.broadcast(pieces), "cell").withColumn("_piece", F.struct("cell", F.pmod(F.xxhash64("item_id"), F.col("_pieces")))).drop("_pieces")
        piece = F.col("_piece")

    def place(df: DataFrame, own: str, own_n: str, other: str, other_n: str, key: Column) -> DataFrame:
        return (df.join(grid, "scope")
                .withColumn(own, F.pmod(F.xxhash64(key), F.col(own_n)))
                .withColumn(other, F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(other_n) - 1)))
                .drop("_na", "_nb", "_piece"))

    # both sides may come from one table: every column gets a new name on its side before they meet
    left, right = place(q, "_a", "_na", "_b", "_nb", F.col("question_id")), place(v, "_b", "_nb", "_a", "_na", piece)
    q_cols, v_cols = left.columns, right.columns
    left = left.toDF(*[f"q_{c}" for c in q_cols]).groupBy("q_scope", "q__a", "q__b")
    right = right.toDF(*[f"v_{c}" for c in v_cols]).groupBy("v_scope", "v__a", "v__b")

    def meet(qs: pa.Table, vs: pa.Table) -> pa.Table:
        qs, vs = qs.rename_columns(q_cols), vs.rename_columns(v_cols)
        return _meet(qs, vs, k, carry, cells)

    return left.cogroup(right).applyInArrow(meet, schema)


def _column(table: pa.Table, name: str) -> pa.Array:
    return pa.concat_arrays(table.column(name).chunks) if table.num_rows else pa.array([], table.schema.field(name).type)


def _units(table: pa.Table) -> np.ndarray:
    """Unit vectors of a table's embeddings, NaN for zero vectors."""
    lists = _column(table, "embedding")
    dims = pc.min_max(pc.list_value_length(lists)).as_py()
    if dims["min"] != dims["max"]:
        raise ValueError(f"embeddings of {dims['min']} and {dims['max']} dimensions")
    m = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(lists), -1)
    norm = np.linalg.norm(m, axis=1, keepdims=True)
    with np.errstate(divide="ignore", invalid="ignore"):
        m /= np.where(norm > 0, norm, np.nan)
    return m


class _Nearest:
    """The k nearest items so far of each question, as places in the table of items. Products in single precision find the pairs that can be within a
    question's k-th distance; only these are measured in double precision, so the rows are those of a full search in double precision."""

    def __init__(self, questions: np.ndarray, items: np.ndarray, q_owner: np.ndarray, v_owner: np.ndarray, order: np.ndarray, limit: np.ndarray,
                 k: int) -> None:
        self.questions, self.items, self.q_owner, self.v_owner, self.order, self.k = questions, items, q_owner, v_owner, order, k
        self.single = questions.astype(np.float32)
        self.limit = limit.copy()
        self.dist, self.at = np.full((len(questions), k), np.inf), np.full((len(questions), k), -1)
        # bound of the error of a product in single precision, and of rounding distances
        self.slack = (questions.shape[1] + 8) * 2.0 ** -23 + 1e-8

    def add(self, rows: np.ndarray, cols: np.ndarray) -> None:
        for start in range(0, len(cols), ITEMS_AT_ONCE):
            some = cols[start:start + ITEMS_AT_ONCE]
            items = np.ascontiguousarray(self.items[some].T, dtype=np.float32)
            for low in range(0, len(rows), QUESTIONS_AT_ONCE):
                self._tile(rows[low:low + QUESTIONS_AT_ONCE], some, items)

    def _tile(self, rows: np.ndarray, cols: np.ndarray, items: np.ndarray) -> None:
        dot = self.single[rows] @ items
        floor = (1 - self.limit[rows] - self.slack).astype(np.float32) - np.float32(1e-6)
        new = np.flatnonzero(np.isinf(self.limit[rows]))
        if len(new) and len(cols) >= self.k:  # no k-th distance yet: that of the items here bounds it
            own = np.where(self.q_owner[rows[new]][:, None] == self.v_owner[cols], np.float32(-np.inf), dot[new])
            floor[new] = np.partition(own, len(cols) - self.k, axis=1)[:, len(cols) - self.k] - np.float32(2 * self.slack)
        hot = np.flatnonzero(dot.max(axis=1) >= floor)
        if not len(hot):
            return
        dot = dot[hot]
        at, col = np.nonzero(dot >= floor[hot][:, None])
        value, row, col = dot[at, col], rows[hot[at]], cols[col]
        other = np.flatnonzero(self.q_owner[row] != self.v_owner[col])
        if len(other) > self.k * len(hot):  # the k-th product of a question bounds the others
            at, value = at[other], value[other]
            sort = np.argsort(4.0 * at - value)
            ranked = at[sort]
            kth = np.full(len(hot), -np.inf)
            last = np.flatnonzero(np.arange(len(ranked)) - np.searchsorted(ranked, ranked) == self.k - 1)
            kth[ranked[last]] = value[sort[last]]
            other = other[value >= kth[at] - 2 * self.slack]
        row, col = row[other], col[other]
        dist = np.empty(len(row))
        for low in range(0, len(row), PAIRS_AT_ONCE):
            part = slice(low, low + PAIRS_AT_ONCE)
            dist[part] = np.round(1 - np.einsum("ij,ij->i", self.questions[row[part]], self.items[col[part]]), 9)
        keep = dist <= self.limit[row]
        if keep.any():
            self._merge(row[keep], col[keep], dist[keep])

    def _merge(self, row: np.ndarray, col: np.ndarray, dist: np.ndarray) -> None:
        touched, own = np.unique(row, return_inverse=True)
        own = np.concatenate([np.repeat(np.arange(len(touched)), self.k), own])
        dist = np.concatenate([self.dist[touched].ravel(), dist])
        col = np.concatenate([self.at[touched].ravel(), col])
        own, dist, col = own[col >= 0], dist[col >= 0], col[col >= 0]
        sort = np.lexsort((self.order[col], dist, own))
        own, dist, col = own[sort], dist[sort], col[sort]
        rank = np.arange(len(own)) - np.searchsorted(own, own)
        first = rank < self.k
        at = touched[own[first]], rank[first]
        self.dist[at], self.at[at] = dist[first], col[first]
        self.limit[touched] = np.minimum(self.limit[touched], self.dist[touched, self.k - 1])


def _meet(qs: pa.Table, vs: pa.Table, k: int, carry: list[str], cells: C.Cells | None = None) -> pa.Table:
    """The k nearest items per (question, bucket) of two slices."""
    item_id, question_id = _column(vs, "item_id"), _column(qs, "question_id")
    found: list[tuple[np.ndarray, np.ndarray, int, np.ndarray]] = []
    if len(item_id) and len(question_id):
        questions, items = _units(qs), _units(vs)
        if questions.shape[1] != items.shape[1]:
            raise ValueError(f"questions of {questions.shape[1]} and items of {items.shape[1]} dimensions")
        order = np.empty(len(item_id), np.int64)
        order[pc.array_sort_indices(item_id).to_numpy()] = np.arange(len(item_id))
        owners = _column(vs, "owner").dictionary_encode()
        v_owner = owners.indices.fill_null(-1).to_numpy()
        q_owner = pc.index_in(_column(qs, "owner"), value_set=owners.dictionary, skip_nulls=True).fill_null(-2).to_numpy()
        low, high, bucket = (_column(t, c).to_numpy() for t, c in ((qs, "low"), (qs, "high"), (vs, "bucket")))
        limit = _column(qs, "limit").to_numpy() if "limit" in qs.column_names else np.full(len(questions), np.inf)
        cell = _column(vs, "cell").to_numpy() if cells is not None else np.zeros(len(items), np.int32)
        known, whole = np.isfinite(questions).all(axis=1), np.isfinite(items).all(axis=1)
        for b in np.unique(bucket).tolist():
            rows, cols = np.flatnonzero(known & (low <= b) & (b <= high)), np.flatnonzero(whole & (bucket == b))
            if not len(rows) or not len(cols):
                continue
            cols = cols[np.argsort(cell[cols], kind="stable")]
            near = _Nearest(questions[rows], items, q_owner[rows], v_owner, order, limit[rows], k)
            for part in np.split(cols, np.flatnonzero(np.diff(cell[cols])) + 1):
                near.add(np.arange(len(rows)) if cells is None else np.flatnonzero(cells.allowed(near.questions, near.limit, int(cell[part[0]]))), part)
            at, rank = np.nonzero(near.at >= 0)
            found.append((rows[at], near.at[at, rank], b, near.dist[at, rank]))
    at = pa.array(np.concatenate([f[0] for f in found]) if found else [], pa.int64())
    col = pa.array(np.concatenate([f[1] for f in found]) if found else [], pa.int64())
    buckets = np.concatenate([np.full(len(f[0]), f[2], np.int32) for f in found]) if found else []
    dist = np.concatenate([f[3] for f in found]) if found else []
    return pa.Table.from_arrays([question_id.take(at), item_id.take(col), pa.array(buckets, pa.int32()), pa.array(dist, pa.float64()),
                                 *(_column(vs, c).take(col) for c in carry)], ["question_id", "item_id", "bucket", "dist", *carry])


def cosine_distance(a: Column, b: Column) -> Column:
    """Row-wise cosine distance on the JVM, rounded as in ``nearest``."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda i, j: i.cast("double") * j), F.lit(0.0), lambda acc, p: acc + p)
    norm = F.sqrt(dot(a, a) * dot(b, b))
    return F.when(norm > 0, F.round(1 - dot(a, b) / norm, 9))


def cap_expr(doc_type: Column, table: dict[str, int], default: int) -> Column:
    return literal_map(table, doc_type, default)


def vector_search(questions: DataFrame, chunks: DataFrame, k: int = 5, k_max: int | None = None, **routes) -> DataFrame:
    """Vector lane (V1): nearest 8k chunks, at most 3/6 per document by type, first 4k: (question_id, chunk_id, doc_id,
    dist, rank). ``chunks`` carry doc_type and are already filtered for currency; an optional ``k`` column in
    ``questions`` overrides ``k``, bounded by ``k_max``."""
    bound = max(k, k_max or k)
    raw = nearest(questions, chunks, 8 * bound, carry=("doc_id", "doc_type"), **routes)
    own_k = F.col("k") if "k" in questions.columns else F.lit(k)
    ks = questions.select("question_id", own_k.alias("_k"))
    near = raw.join(ks, "question_id").filter("rank <= 8 * _k")
    order = [F.col("dist"), F.col("chunk_id")]
    # at most 8k rows per question from here on
    capped = (near.withColumn("_in_doc", F.row_number().over(_w(["question_id", "doc_id"], order)))
              .filter(F.col("_in_doc") <= cap_expr(F.col("doc_type"), S.VECTOR_CAP, S.VECTOR_CAP_DEFAULT)).drop("rank"))
    final = top_n(capped, ["question_id"], order, 4 * bound, "rank").filter("rank <= 4 * _k")
    return final.select("question_id", "chunk_id", "doc_id", "dist", "rank")


def _w(keys: list[str], order: list[Column]):
    from pyspark.sql import Window
    return Window.partitionBy(*keys).orderBy(*order)


def seed_by_title(questions: DataFrame, title_hits: DataFrame, chunks: DataFrame,
                  per_doc: int = S.TITLE_CHUNKS_PER_DOC) -> DataFrame:
    """Nearest chunks of each title-matched document (V2): (question_id, chunk_id, doc_id, dist).

    At most five documents per question; the per-document cut happens before the shuffle."""
    q = questions.select("question_id", F.col("embedding").alias("_q"))
    pairs = (title_hits.select("question_id", "doc_id").join(q, "question_id")
             .join(chunks.filter("embedding is not null").select("doc_id", "chunk_id", "embedding"), "doc_id"))
    dist = pairs.select("question_id", "doc_id", "chunk_id", cosine_distance(F.col("embedding"), F.col("_q")).alias("dist"))
    return top_n(dist.filter("dist is not null"), ["question_id", "doc_id"], [F.col("dist"), F.col("chunk_id")], per_doc)


def seed_by_year(questions: DataFrame, chunks: DataFrame, per_year: int = S.YEAR_CHUNKS_PER_YEAR,
                 total: int = S.YEAR_CHUNKS_TOTAL, **routes) -> DataFrame:
    """Nearest chunks per year of the question's range (V3), filled in year order up to ``total``: (question_id, chunk_id,
    year, dist). questions carry year_from / year_to; chunks carry the document's date as ``doc_date``."""
    found = nearest(questions.filter("year_from is not null"), chunks, per_year, bucket=F.year("doc_date"),
                    low=F.col("year_from"), high=F.col("year_to"), **routes).withColumnRenamed("bucket", "year").drop("rank")
    return top_n(found, ["question_id"], [F.col("year"), F.col("dist"), F.col("chunk_id")], total)


def mean_vectors(chunks: DataFrame, key: str = "doc_id") -> DataFrame:
    """Mean vector per document (V4): component sums merge map-side, so a huge document moves one row per dimension."""
    parts = chunks.filter("embedding is not null").select(key, F.posexplode("embedding").alias("_i", "_x"))
    means = parts.groupBy(key, "_i").agg(F.avg(F.col("_x").cast("double")).alias("_m"))
    # bounded: one entry per dimension
    return means.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("_i", "_m"))).alias("_v")).select(
        key, F.col("_v._m").alias("embedding"))


def neighbor_pairs(new_chunks: DataFrame, existing: DataFrame, per_chunk: int = S.NEIGHBORS_PER_CHUNK,
                   max_distance: float = S.MAX_NEIGHBOR_DISTANCE, per_doc: int | None = None,
                   **routes) -> DataFrame:
    """Close chunks of other documents (V5): (new_doc_id, new_chunk_id, existing_chunk_id, existing_doc_id, dist, pair_index)."""
    q = new_chunks.withColumn("question_id", F.col("chunk_id"))
    near = nearest(q, existing, per_chunk, question_owner="doc_id", item_owner="doc_id", carry=("doc_id",), **routes).filter(
        F.col("dist") <= max_distance)
    pairs = (near.select(F.col("question_id").alias("new_chunk_id"), F.col("chunk_id").alias("existing_chunk_id"),
                         F.col("doc_id").alias("existing_doc_id"), "dist")
             .join(new_chunks.select(F.col("chunk_id").alias("new_chunk_id"), F.col("doc_id").alias("new_doc_id"), "position"),
                   "new_chunk_id"))
    order = [F.col("position"), F.col("new_chunk_id"), F.col("dist"), F.col("existing_chunk_id")]
    if per_doc is None:  # all pairs, numbered within their document
        ranked = pairs.withColumn("_r", F.row_number().over(_w(["new_doc_id"], order)))
    else:
        ranked = top_n(pairs, ["new_doc_id"], order, per_doc, "_r")
    return ranked.withColumn("pair_index", F.col("_r") - 1).drop("_r", "position")
