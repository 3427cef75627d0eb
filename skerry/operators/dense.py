"""Vectors: the hashing embedder, the cache of embeddings, and exact nearest vectors."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skerry.config import Dense
from skerry.functions import text as T
from skerry.sources.store import Store
from skerry.tables import cut

#: Queries of one pass over all vectors; more are compared in blocks of so many with slices of so many vectors.
BLOCK, SLICE = 4_096, 200_000

_WORD = re.compile(r"\w+")


class _Buckets(dict):
    """Bucket of each word: the first eight bytes of its digest, the least first, modulo the dimensions."""

    def __init__(self, dim: int = 256):
        super().__init__()
        self.dim = dim

    def __missing__(self, w: str) -> int:
        b = int.from_bytes(hashlib.md5(w.encode()).digest()[:8], "little") % self.dim
        if len(self) >= 500_000:
            self.clear()
        self[w] = b
        return b


def _count(texts: list[str | None], cache: _Buckets) -> np.ndarray:
    """Unit vectors of texts, one a row; zeros for a text without words."""
    dim = cache.dim
    lists = [_WORD.findall(t.lower()) if t else [] for t in texts]
    lens = np.fromiter(map(len, lists), np.int64, len(lists))
    b = np.fromiter((cache[w] for ws in lists for w in ws), np.int64, int(lens.sum()))
    n = np.bincount(np.repeat(np.arange(len(lists)), lens) * dim + b, minlength=len(lists) * dim).reshape(-1, dim).astype(np.float64)
    return n / np.maximum(np.sqrt((n * n).sum(1, keepdims=True)), 1e-300)


class HashEmbedder:
    """Counts of hashed words, scaled to length 1: needs no model."""

    def __init__(self, dim: int = 256, model: str = "hash"):
        self.name, self.dim, self._cache = f"hash-{dim}", dim, _Buckets(dim)

    def embed(self, texts: list[str], query: bool = False) -> np.ndarray:
        return _count(texts, self._cache)


class ModelEmbedder:
    """A sentence model, if its library is installed. Batches shrink where memory runs out."""

    def __init__(self, dim: int, model: str):
        try:
            from sentence_transformers import SentenceTransformer
        except ImportError as e:
            raise RuntimeError(f"embedder {model!r} needs sentence_transformers; install it or use the hash embedder") from e
        self._model = SentenceTransformer(model)
        self.name, self.dim = model, self._model.get_sentence_embedding_dimension()

    def embed(self, texts: list[str], query: bool = False) -> np.ndarray:
        prompt = {"prompt_name": "query"} if query and "query" in getattr(self._model, "prompts", {}) else {}
        for size in (32, 8, 1):
            try:
                return np.asarray(self._model.encode(texts, batch_size=size, normalize_embeddings=True, **prompt), np.float64)
            except RuntimeError as e:
                if size == 1 or "memory" not in str(e).lower():
                    raise
        raise AssertionError


EMBEDDERS: dict[str, Callable] = {"hash": HashEmbedder}
"""By name: what makes an embedder of a dimension and a model's name, with ``name``, ``dim`` and ``embed(texts, query)``.
A name that isn't registered is taken for a sentence model."""


def embedder(conf: Dense):
    make = EMBEDDERS.get(conf.embedder, ModelEmbedder)
    return make(conf.dim, conf.model or conf.embedder)


def hash_embed(texts: DataFrame, id_col: str, text_col: str, dim: int = 256) -> DataFrame:
    """``id, bucket, weight`` of the non-zero parts of each vector: words are counted by the first byte of their
    digest, counts scaled to length 1. Texts without words give no rows. A narrow pass: a vector needs its own
    row only, which grouping exploded words would shuffle."""
    if dim != 256:
        raise ValueError("only 256 dimensions are kept sparse")
    kind = texts.schema[id_col].dataType.simpleString()

    def run(batches):
        cache = _Buckets()
        for b in batches:
            for lo in range(0, b.num_rows, 2000):
                part = b.slice(lo, 2000)
                v = _count(part.column(1).to_pylist(), cache)
                r, c = np.nonzero(v)
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(r)), pa.array(c.astype(np.int32)), pa.array(v[r, c])], names=["id", "bucket", "weight"])

    return texts.select(id_col, text_col).mapInArrow(run, f"id {kind}, bucket int, weight double")


def embed(rows: DataFrame, conf: Dense = Dense(), kind: str = "float") -> DataFrame:
    """``key, vec`` of distinct ``key, text``, in Arrow batches; the embedder is set up once a task."""

    def run(batches):
        e = None
        for b in batches:
            e = e or embedder(conf)
            for lo in range(0, b.num_rows, 1000):
                part = b.slice(lo, 1000)
                v = e.embed([t or "" for t in part.column(1).to_pylist()]).astype(kind if kind == "double" else np.float32)
                flat = pa.array(v.ravel())
                offs = pa.array(np.arange(len(v) + 1, dtype=np.int32) * v.shape[1])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(offs, flat)], names=["key", "vec"])

    return rows.select("key", "text").mapInArrow(run, f"key string, vec array<{kind}>")


def vectors(passages: DataFrame, cache: DataFrame | None, conf: Dense = Dense(), kind: str = "float") -> tuple[DataFrame, DataFrame]:
    """``(vectors, fresh)``: ``passage_id, path, vec`` of every passage with a text, and what to add to the cache
    (``key, model, dim, vec``). Texts the cache has, and repeated ones, aren't embedded again."""
    e = embedder(conf)
    keyed = passages.filter("text IS NOT NULL").select("passage_id", "path", "text", T.cache_key(F.lit(e.name), F.col("text")).alias("key"))
    todo = keyed.select("key", "text")
    if cache is not None:
        have = cache.filter(F.col("model") == e.name)
        todo = todo.join(have.select("key").distinct(), "key", "left_anti")
    fresh = cut(embed(todo.dropDuplicates(["key"]), conf, kind).select("key", F.lit(e.name).alias("model"), F.lit(e.dim).alias("dim"), "vec"))
    every = fresh.select("key", "vec")
    if cache is not None:
        every = every.unionByName(have.select("key", "vec").dropDuplicates(["key"]))
    return keyed.select("passage_id", "path", "key").join(every, "key").select("passage_id", "path", "vec"), fresh


def built(store: Store, passages: DataFrame, conf: Dense = Dense(), kind: str = "float") -> dict:
    """What a commit needs to store the vectors of all passages; those in the store's cache aren't made again."""
    e = embedder(conf)
    v, fresh = vectors(passages, store.table("cache") if store.has("cache") else None, conf, kind)
    return {"replace": {"vectors": ("path", v)}, "append": {"cache": ("key", fresh)}, "embedder": {"name": e.name, "dim": e.dim}}


def updated(store: Store, changed: DataFrame, new: DataFrame, conf: Dense = Dense(), kind: str = "float") -> dict:
    """What a commit needs to replace the vectors of ``changed`` paths by those of the ``new`` passages."""
    check(store, conf)
    v, fresh = vectors(new, store.table("cache") if store.has("cache") else None, conf, kind)
    return {"upsert": {"vectors": ("path", changed, v)}, "append": {"cache": ("key", fresh)}}


def check(store: Store, conf: Dense) -> None:
    """Fails if there are no vectors, or those of another embedder."""
    if not store.has("vectors"):
        store.table("vectors")
    e, has = embedder(conf), store.meta().get("embedder", {})
    if has != {"name": e.name, "dim": e.dim}:
        raise ValueError(f"the vectors were made by {has.get('name')} ({has.get('dim')} dimensions), not by {e.name} ({e.dim}); index again in full")


def search(vecs: DataFrame, queries: DataFrame, k: int = 10, conf: Dense = Dense(), above: float | None = None) -> DataFrame:
    """``query_id, rank, passage_id, score``: exact cosine of stored unit vectors (``passage_id, vec``). The queries are
    a stated set and go to every task as one matrix; a task keeps its best ``k`` of each, so ``k`` rows a query and task are
    shuffled. ``above``: only similarities greater than that."""
    asked = queries.select("query_id", "query").collect()  # a stated query set
    q = embedder(conf).embed([r.query or "" for r in asked], query=True)
    kind = queries.schema["query_id"].dataType.simpleString()
    given = vecs.sparkSession.sparkContext.broadcast((np.array([r.query_id for r in asked], np.int64), q))
    return _nearest(vecs.select("passage_id", "vec"), given, k, "passage_id", "string", above).withColumn("query_id", F.col("query_id").cast(kind))


def _nearest(vecs: DataFrame, given, k: int, name: str, kind: str, above: float | None = None) -> DataFrame:
    """Best ``k`` of ``id, vec`` for each of the unit vectors ``given`` to all tasks; equal similarity goes by id."""

    def run(batches):
        qid, q = given.value
        best = [(np.zeros(0, np.int64), np.zeros(0, object), np.zeros(0))]
        for b in batches:
            col = b.column(1)
            keep = np.flatnonzero(np.diff(col.offsets.to_numpy()) == q.shape[1]) if len(qid) else []
            if not len(keep):
                continue
            t = b.take(pa.array(keep))
            ids = np.array(t.column(0).to_pylist(), object)
            v = t.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, q.shape[1])
            for lo in range(0, len(v), 4000):
                s = np.round(q @ unit(v[lo : lo + 4000]).T, 6)
                least = np.partition(s, -k, axis=1)[:, -k][:, None] if s.shape[1] > k else -2.0
                r, c = np.nonzero((s >= least) & (s > (-2.0 if above is None else above)))
                best.append((r, ids[lo : lo + 4000][c], s[r, c]))
            best = [_best(best, k)]
        r, i, s = best[0]
        yield pa.RecordBatch.from_arrays([pa.array(qid[r]), pa.array(list(i), pa.string() if kind == "string" else pa.int64()), pa.array(s)], names=["query_id", name, "score"])

    got = vecs.mapInArrow(run, f"query_id bigint, {name} {kind}, score double")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), name)
    return got.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def unit(v: np.ndarray) -> np.ndarray:
    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300)


def _best(parts: list[tuple], k: int) -> tuple:
    """The best ``k`` of each row over parts of (row, id, score)."""
    r, i, s = (np.concatenate(x) for x in zip(*parts))
    order = sorted(range(len(r)), key=lambda j: (r[j], -s[j], i[j]))
    r, i, s = r[order], i[order], s[order]
    keep = np.arange(len(r)) - np.searchsorted(r, r) < k
    return r[keep], i[keep], s[keep]


def topk(vectors: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding", block: int = BLOCK, slice_: int = SLICE) -> DataFrame:
    """``query_id, rank, id, score``: exact cosine of every query against all vectors of as many dimensions, for any number
    of queries. Up to ``block`` of them go to every task as one matrix and the vectors aren't shuffled; more are cut into
    blocks, the vectors into slices, and each block meets each slice in a task of its own."""
    q = queries.select(F.col(id_col).cast("bigint").alias("query_id"), F.col(vec_col).alias("qvec")).filter("qvec IS NOT NULL")
    x = vectors.select(F.col(id_col).cast("bigint").alias("id"), F.col(vec_col).alias("vec")).filter("vec IS NOT NULL")
    dims = [r.d for r in q.select(F.size("qvec").alias("d")).distinct().orderBy("d").collect()]  # few: one a model
    if q.limit(block + 1).count() <= block:
        outs = []
        for d in dims:
            rows = q.filter(F.size("qvec") == d).collect()  # at most a block
            given = vectors.sparkSession.sparkContext.broadcast((np.array([r.query_id for r in rows], np.int64), unit(np.array([r.qvec for r in rows], np.float64).reshape(-1, d))))
            outs.append(_nearest(x.filter(F.size("vec") == d), given, k, "id", "bigint"))
        return reduce(DataFrame.unionByName, outs) if outs else vectors.sparkSession.createDataFrame([], "query_id bigint, id bigint, score double, rank int")
    nq, nx = -(-q.count() // block), max(1, -(-x.count() // slice_))
    by = ["dim", "b", "s"]
    q = q.withColumn("dim", F.size("qvec")).withColumn("b", F.pmod(F.xxhash64("query_id"), F.lit(nq))).withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(nx - 1))))
    x = x.withColumn("dim", F.size("vec")).withColumn("s", F.pmod(F.xxhash64("id"), F.lit(nx)).cast("int")).withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(nq - 1)))).withColumn("b", F.col("b").cast("bigint"))

    def meet(a: pa.Table, b: pa.Table) -> pa.Table:
        none = np.zeros(0, np.int64)
        best = [(none, none, np.zeros(0))]
        if a.num_rows and b.num_rows:
            m = lambda t, c: unit(t.column(c).combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(t.num_rows, -1))
            qs, xs, ids = m(a, "qvec"), m(b, "vec"), b.column("id").to_numpy()
            for lo in range(0, len(qs), 256):
                s = np.round(qs[lo : lo + 256] @ xs.T, 6)
                least = np.partition(s, -k, axis=1)[:, -k][:, None] if s.shape[1] > k else -2.0
                r, c = np.nonzero(s >= least)
                best.append(_best([(r + lo, ids[c], s[r, c])], k))
        r, i, s = (np.concatenate(c) for c in zip(*best))
        return pa.table({"query_id": pa.array(a.column("query_id").to_numpy()[r] if a.num_rows else none, pa.int64()), "id": pa.array(i.astype(np.int64)), "score": pa.array(s)})

    got = q.groupBy(*by).cogroup(x.groupBy(*by)).applyInArrow(meet, "query_id bigint, id bigint, score double")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return got.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def cache_keys(passages: DataFrame, model: str) -> DataFrame:
    return passages.filter("text IS NOT NULL").select("passage_id", T.cache_key(F.lit(model), F.col("text")).alias("key")).distinct()


def cache_hits(passages: DataFrame, cache: DataFrame, model: str) -> DataFrame:
    """``passage_id, key, hit`` of every text: whether the cache has a vector for it."""
    have = cache.filter(F.col("model") == model).select("key").distinct().withColumn("hit", F.lit(True))
    return cache_keys(passages, model).join(have, "key", "left").select("passage_id", "key", F.coalesce("hit", F.lit(False)).alias("hit"))
