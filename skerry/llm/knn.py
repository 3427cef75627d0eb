"""The most similar vectors of every vector (problem 5).

An inverted multi-index: each half of the unit vectors is quantised by its own codebook, so ``K``
centroids a half give ``K * K`` cells. A query walks the pairs of centroids by summed distance with
a heap until the cells it has met hold enough vectors, the vectors of those cells are compared
exactly, and the best ``k`` of each cell are merged. ``K`` grows with the square root of the number
of vectors, so a cell holds about as many of them at any size. Codebooks are fitted on a bounded
sample (``FIT_ROWS`` vectors of a model); every vector is indexed and every one is a query.

How many vectors are enough is measured on the table itself: the nearest neighbours of ``TRIED``
vectors of each model are found by brute force, in one pass over all vectors, and enough is what
they have to meet for the recall asked for. So recall doesn't sink as the table grows. ``exact``
meets all cells instead.

Equal vectors are one entry of the index, with their ``k + 1`` smallest keys: more can't be among
the ``k`` nearest of any vector. A cell with many entries is compared in salted blocks of at most
``BLOCK``, none is cut off.

Cases: only vectors of exactly ``dim`` finite values, not all zero, take part; null and repeated
rows don't; equal similarity goes by key; models are never mixed; an empty table gives no rows.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skerry.tables import cut, table

FIT_ROWS = 20_000
#: Vectors of a cell, entries compared at once, centroids of a half at most (with more than ``CELL * MOST ** 2`` vectors of a
#: model, 4 billion, cells grow beyond ``CELL``), vectors of a model that enough is measured on.
CELL, BLOCK, MOST, TRIED = 4_000, 4_096, 1_024, 256
#: Recall aimed at for all neighbours, and for those of a least similarity.
RECALL, RECALL_NEAR = 0.95, 1.0


def usable(df: DataFrame, key: str = "key", model: str = "model", dim: str = "dim", vec: str = "vec") -> DataFrame:
    """``key, model, vec`` with unit vectors; a key of a model counts once."""
    ok = F.col(key).isNotNull() & F.col(model).isNotNull() & (F.size(vec) == F.col(dim)) & (F.col(dim) > 0)
    ok = ok & ~F.exists(vec, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(vec, lambda x: x != 0)
    rows = df.filter(ok).select(F.col(key).cast("string").alias("key"), F.col(model).cast("string").alias("model"), F.col(vec).alias("vec"))

    def unit(batches):
        for b in batches:
            v = b.column(2)
            flat, offs = v.flatten().to_numpy(zero_copy_only=False).astype(np.float64), np.diff(v.offsets.to_numpy())
            norm = np.sqrt(np.add.reduceat(flat * flat, np.cumsum(offs) - offs))
            out = (flat / np.repeat(norm, offs)).astype(np.float32)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(offs)]).astype(np.int32)), pa.array(out))], names=["key", "model", "vec"])

    return rows.mapInArrow(unit, "key string, model string, vec array<float>")


def kmeans(x: np.ndarray, k: int, seed: int = 7, rounds: int = 12) -> np.ndarray:
    rng = np.random.default_rng(seed)
    k = min(k, len(x))
    c = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        a = (x @ c.T - (c * c).sum(1) / 2).argmax(1)
        for j in range(k):
            m = a == j
            c[j] = x[m].mean(0) if m.any() else x[rng.integers(len(x))]
    return c


def walk(da: np.ndarray, db: np.ndarray, sizes: np.ndarray, enough: int) -> list[int]:
    """Cells by summed half distances until they hold ``enough`` vectors: the multi-sequence walk."""
    ia, ib = da.argsort(), db.argsort()
    sa, sb = da[ia].tolist(), db[ib].tolist()
    ia, ib, k = ia.tolist(), ib.tolist(), len(db)
    heap, done, out, have = [(sa[0] + sb[0], 0, 0)], set(), [], 0
    while heap and have < enough:
        _, i, j = heapq.heappop(heap)
        cell = ia[i] * k + ib[j]
        if sizes[cell]:
            out.append(cell)
            have += sizes[cell]
        done.add((i, j))
        if i + 1 < len(sa) and (j == 0 or (i + 1, j - 1) in done):
            heapq.heappush(heap, (sa[i + 1] + sb[j], i + 1, j))
        if j + 1 < len(sb) and (i == 0 or (i - 1, j + 1) in done):
            heapq.heappush(heap, (sa[i] + sb[j + 1], i, j + 1))
    return out


def needed(q: np.ndarray, cells: np.ndarray, a: np.ndarray, b: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """How many vectors a walk from the queries ``q`` meets before it is through with the ``cells``, one a query."""
    h = q.shape[1] // 2
    out = np.zeros(len(q))
    for i, (x, c) in enumerate(zip(q, cells)):
        d = ((a * a).sum(1) - 2 * a @ x[:h])[:, None] + ((b * b).sum(1) - 2 * b @ x[h:])[None, :]
        out[i] = sizes.reshape(d.shape)[d <= d.flat[c]].sum()
    return out


def knn(df: DataFrame, k: int = 10, min_sim: float | None = None, enough: int | None = None, exact: bool = False, **cols: str) -> DataFrame:
    """``model, key, neighbour, sim, rank``; with ``min_sim`` only neighbours at least that similar.
    ``enough`` is the number of vectors a query meets, by default as measured; ``exact``: all of them."""
    spark = df.sparkSession
    raw = usable(df, **cols)
    bits = F.xxhash64("vec")
    entries = cut(raw.groupBy("model", "vec").agg(F.slice(F.array_sort(F.collect_set("key")), 1, k + 1).alias("keys")).withColumn("id", bits))
    models = [(r.model, r.n) for r in entries.groupBy("model").agg(F.count("*").alias("n")).collect()]  # one row a model
    books = {}
    for m, n in models:
        share = min(1.0, 1.2 * FIT_ROWS / n)
        s = entries.filter(F.col("model") == m).filter(F.pmod(F.xxhash64("id", F.lit(3)), F.lit(1_000_000)) < int(share * 1_000_000) + 1).select("vec").limit(FIT_ROWS).toPandas()
        by_dim: dict[int, list] = {}
        for v in s.vec:
            by_dim.setdefault(len(v), []).append(v)
        for d, v in by_dim.items():
            x = np.array(v, np.float32)
            kk = int(max(1, min(MOST, round((n / CELL) ** 0.5))))
            books[(m, d)] = (kmeans(x[:, : d // 2], kk) if d > 1 else np.zeros((1, 0), np.float32), kmeans(x[:, d // 2 :], kk))
    given = spark.sparkContext.broadcast(books)  # at most MOST centroids a half

    def halves(m, v):
        a, b = given.value[(m, v.shape[1])]
        h = v.shape[1] // 2
        return [((c * c).sum(1)[None, :] - 2 * x @ c.T) for x, c in ((v[:, :h], a), (v[:, h:], b))]

    def blocks(batch):
        """Rows of one model and dimension, with their vectors."""
        col = batch.column("vec")
        dims, names = np.diff(col.offsets.to_numpy()), np.array(batch.column("model").to_pylist())
        flat, at = col.flatten().to_numpy(), np.cumsum(dims) - dims
        for m, d in sorted(set(zip(names.tolist(), dims.tolist()))):
            if (m, d) in given.value:
                rows = np.flatnonzero((names == m) & (dims == d))
                yield m, d, rows, flat[at[rows][:, None] + np.arange(d)]

    def assign(batches):
        for b in batches:
            for _, d, rows, v in blocks(b):
                da, db = halves(_, v)
                cell = (da.argmin(1) * db.shape[1] + db.argmin(1)).astype(np.int32)
                t = b.take(pa.array(rows))
                yield pa.RecordBatch.from_arrays([t.column("model"), pa.array(np.full(len(rows), d, np.int32)), pa.array(cell), t.column("id"), t.column("vec"), t.column("keys")], names=["model", "dim", "cell", "id", "vec", "keys"])

    placed = cut(entries.mapInArrow(assign, "model string, dim int, cell int, id bigint, vec array<float>, keys array<string>"))
    sizes = {}
    for r in placed.groupBy("model", "dim", "cell").agg(F.count("*").alias("n")).collect():  # at most MOST * MOST cells a model
        a, b = books[(r.model, r.dim)]
        sizes.setdefault((r.model, r.dim), np.zeros(len(a) * len(b), np.int64))[r.cell] = r.n
    load = spark.sparkContext.broadcast(sizes)

    def measured() -> dict:
        """Enough, by model and dimension."""
        if exact or enough is not None:
            return {key: int(sizes[key].sum()) if exact else enough for key in sizes}
        tried = {}
        for (m, d), n in sizes.items():
            share = min(1_000_000, int(1_200_000 * TRIED / max(1, n.sum())) + 1)
            rows = placed.filter((F.col("model") == m) & (F.col("dim") == d) & (F.pmod(F.xxhash64("id", F.lit(5)), F.lit(1_000_000)) < share)).select("id", "vec").limit(TRIED).collect()
            tried[(m, d)] = np.array([r.id for r in rows], np.int64), np.array([r.vec for r in rows], np.float32).reshape(-1, d)
        asked = spark.sparkContext.broadcast(tried)

        def best(batches):
            for b in batches:
                for m, d, rows, v in blocks(b):
                    ids, q = asked.value[(m, d)]
                    s = q @ v.T
                    s[ids[:, None] == b.column("id").to_numpy()[rows][None, :]] = -2
                    top = np.argpartition(-s, k, axis=1)[:, :k] if s.shape[1] > k else np.broadcast_to(np.arange(s.shape[1]), s.shape)
                    sim = np.take_along_axis(s, top, 1)
                    n, w = sim.size, top.shape[1]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([m] * n, pa.string()), pa.array(np.full(n, d, np.int32)), pa.array(np.repeat(np.arange(len(ids)), w).astype(np.int32)), pa.array(b.column("cell").to_numpy()[rows][top].ravel()), pa.array(sim.ravel().astype(np.float32))],
                        names=["model", "dim", "q", "cell", "sim"],
                    )

        near = placed.select("model", "id", "cell", "vec").mapInArrow(best, "model string, dim int, q int, cell int, sim float")
        w = Window.partitionBy("model", "dim", "q").orderBy(F.desc("sim"))
        got = near.withColumn("r", F.row_number().over(w)).filter((F.col("r") <= k) & (F.col("sim") >= F.lit(-1.5 if min_sim is None else min_sim))).toPandas()  # k rows of TRIED vectors a model
        out = {}
        for (m, d), n in sizes.items():
            g = got[(got.model == m) & (got.dim == d)]
            met = needed(tried[(m, d)][1][g.q.to_numpy()], g.cell.to_numpy(), *books[(m, d)], n) if len(g) else np.zeros(1)
            out[(m, d)] = int(max(np.quantile(met, RECALL if min_sim is None else RECALL_NEAR), 4 * CELL))
        return out

    fill = measured()

    def probe(batches):
        for b in batches:
            for m, d, rows, v in blocks(b):
                da, db = halves(m, v)
                n = load.value[(m, d)]
                for lo in range(0, len(rows), 500):
                    cells = [walk(x, y, n, fill[(m, d)]) for x, y in zip(da[lo : lo + 500], db[lo : lo + 500])]
                    t = b.take(pa.array(np.repeat(rows[lo : lo + 500], [len(c) for c in cells])))
                    yield pa.RecordBatch.from_arrays([t.column("model"), pa.array(np.full(t.num_rows, d, np.int32)), pa.array(np.concatenate(cells).astype(np.int32)), t.column("id"), t.column("vec")], names=["model", "dim", "cell", "qid", "qvec"])

    queries = placed.select("model", "vec", "id").mapInArrow(probe, "model string, dim int, cell int, qid bigint, qvec array<float>")
    # Blocks of a cell: entries are salted into blocks, a query visits each block of its cells.
    nb = {(m, d, int(c)): int(-(-n[c] // BLOCK)) for (m, d), n in sizes.items() for c in np.flatnonzero(n > BLOCK)}
    if nb:
        many = spark.createDataFrame([(*key, n) for key, n in nb.items()], "model string, dim int, cell int, nb int")
        members = placed.join(F.broadcast(many), ["model", "dim", "cell"], "left").withColumn("block", F.pmod("id", F.coalesce("nb", F.lit(1))).cast("int"))
        queries = queries.join(F.broadcast(many), ["model", "dim", "cell"], "left").withColumn("block", F.explode(F.sequence(F.lit(0), F.coalesce("nb", F.lit(1)) - 1)))
    else:
        members, queries = placed.withColumn("block", F.lit(0)), queries.withColumn("block", F.lit(0))
    floor = -2.0 if min_sim is None else min_sim - 1e-6

    def rank(q: pa.Table, x: pa.Table) -> pa.Table:
        def matrix(t, col):
            c = t.column(col).combine_chunks()
            return c.flatten().to_numpy().reshape(len(c), -1)

        outs = []
        if q.num_rows and x.num_rows:
            ids, v = x.column("id").to_numpy(), matrix(x, "vec")
            for lo in range(0, q.num_rows, 1000):
                part = q.slice(lo, 1000)
                qid = part.column("qid").to_numpy()
                s = matrix(part, "qvec") @ v.T
                if min_sim is not None:
                    # Few are as similar as that: only rows with such neighbours are ranked.
                    some = (s >= floor).any(axis=1)
                    s, qid = s[some], qid[some]
                top = np.argpartition(-s, k, axis=1)[:, : k + 1] if s.shape[1] > k + 1 else np.broadcast_to(np.arange(s.shape[1]), s.shape)
                best = np.take_along_axis(s, top, 1)
                got = ids[top]
                r, c = np.nonzero((best >= floor) & (got != qid[:, None]))
                outs.append((qid[r], got[r, c], best[r, c]))
        cols = [np.concatenate([o[i] for o in outs]) if outs else np.zeros(0, t) for i, t in enumerate((np.int64, np.int64, np.float32))]
        name = x.column("model")[0].as_py() if x.num_rows else ""
        return pa.table({"model": pa.array([name] * len(cols[0]), pa.string()), "qid": pa.array(cols[0], pa.int64()), "id": pa.array(cols[1], pa.int64()), "sim": pa.array(cols[2], pa.float32())})

    by = ["model", "dim", "cell", "block"]
    near = queries.groupBy(*by).cogroup(members.select(*by, "id", "vec").groupBy(*by)).applyInArrow(rank, "model string, qid bigint, id bigint, sim float")
    w = Window.partitionBy("model", "qid").orderBy(F.desc("sim"), "id")
    near = near.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= k).drop("r")
    keys = placed.select("model", "id", "keys")
    own = keys.filter(F.size("keys") > 1).select("model", F.col("id").alias("qid"), "id", F.lit(1.0).cast("float").alias("sim"))
    every = near.unionByName(own)
    # Keys of an entry beyond the k + 1 kept still have neighbours of their own: queries come from the raw rows.
    asked = raw.select("model", "key", bits.alias("qid")).distinct()
    pairs = every.join(keys.withColumnRenamed("keys", "nkeys"), ["model", "id"]).join(asked, ["model", "qid"]).select("model", "key", F.explode("nkeys").alias("neighbour"), "sim").filter("key <> neighbour")
    w = Window.partitionBy("model", "key").orderBy(F.desc("sim"), "neighbour")
    out = pairs.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
    return out if min_sim is None else out.filter(F.col("sim") >= F.lit(min_sim - 1e-6).cast("float"))


def mutual(near: DataFrame, min_sim: float) -> DataFrame:
    a = near.filter(F.col("sim") >= F.lit(min_sim - 1e-6).cast("float"))
    b = a.select("model", F.col("neighbour").alias("key"), F.col("key").alias("neighbour"))
    return a.join(b, ["model", "key", "neighbour"], "left_semi").filter("key < neighbour").select(F.col("key").alias("key_a"), F.col("neighbour").alias("key_b")).distinct()


def p5_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knn(table(spark, sf_dir, "emb")).withColumn("sim", F.round(F.col("sim").cast("double"), 5))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mutual(knn(table(spark, sf_dir, "emb"), k=10, min_sim=0.9), 0.9)
