"""Indexing a folder and searching it, as one object over a store."""

from __future__ import annotations

import hashlib
import re
import time
from dataclasses import dataclass, field
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skerry.config import Config
from skerry.functions import text as T
from skerry.operators import chunks, dense, folders, fusion, manifest, sparse
from skerry.plans.index import merged
from skerry.session import ship
from skerry.sources import files
from skerry.sources.store import Store
from skerry.tables import cut

POOL = 20  # hits of each retriever that fusion sees at least
PASSAGE = ["passage_id", "doc_id", "path", "ordinal", "page", "offset", "text"]
FILES = "path string, size bigint, mtime double, content_hash string, n_passages int, indexed_version int, indexed_at double"


class Retriever(Protocol):
    """What a search mode is: ``query_id, rank, doc_id, passage_id, path, snippet, score, ...`` of a text or of a frame of
    queries. Others may be put into ``Engine.retrievers`` under a name that the settings have a section for."""

    def __call__(self, query: str | DataFrame, k: int = 10) -> DataFrame: ...


@dataclass
class Hybrid:
    results: DataFrame
    used: list[str]
    skipped: dict[str, str] = field(default_factory=dict)


def index_folder(home: str, root: str) -> str:
    """The folder of the index of ``root`` under ``home``: its name made safe, and a part of a hash of its path."""
    path = root.rstrip("/") or "/"
    name = re.sub(r"[^A-Za-z0-9._-]", "_", path.rsplit("/", 1)[-1]) or "root"
    return f"{home.rstrip('/')}/{name}-{hashlib.sha256(path.encode()).hexdigest()[:12]}"


class Engine:
    def __init__(self, spark: SparkSession, root: str, store: str, conf: Config = Config()):
        self.spark, self.root, self.conf, self.store = ship(spark), root, conf, Store(spark, store)
        self.retrievers: dict[str, Retriever] = {"sparse": self.search_sparse, "dense": self.search_dense, "kb": self.search_kb, "graph": self.search_graph}

    # Indexing

    def reindex(self, full: bool = False) -> dict:
        """One run: scan, compare, read what changed, write a new version. Returns the counters of the run and what went
        wrong (``errors``): a part of the index that fails doesn't stop the others."""
        now, store = time.time(), self.store
        scan = files.scan(self.spark, self.root, self.conf)
        known = store.table("files") if store.has("files") else self.spark.createDataFrame([], FILES)
        old = known.select("path", F.col("size").alias("o_size"), F.col("mtime").alias("o_mtime"), "content_hash")
        # Only files whose size or time differ are opened, once, by their names.
        seen = scan.join(old, "path", "left").withColumn("same", F.col("o_size").eqNullSafe(F.col("size")) & F.col("o_mtime").eqNullSafe(F.col("mtime")))
        seen = cut(seen.withColumn("same", F.col("same") & ~F.lit(full)))
        read = cut(files.opened(self.root, seen.filter("NOT same").select("path", "content_hash"), self.conf, full))
        now_seen = seen.filter("same").select("path", "size", "mtime", "content_hash").unionByName(
            seen.filter("NOT same").select("path", "size", "mtime").join(read.select("path", "content_hash"), "path").select("path", "size", "mtime", "content_hash")
        )
        delta = cut(manifest.changes(now_seen, known, full))
        todo = delta.filter("change IN ('added', 'modified')").select("path")
        pages = read.select(F.col("path").alias("doc_id"), F.explode("pages").alias("p")).select("doc_id", "p.page", "p.text").join(todo.withColumnRenamed("path", "doc_id"), "doc_id", "left_semi")
        new = cut(chunks.chunk(pages, self.conf.chunk.size, self.conf.chunk.overlap).select(*PASSAGE))
        stubs = chunks.stubs(todo.join(new.select("path").distinct(), "path", "left_anti")).select(*PASSAGE)
        counters = manifest.report(delta).first().asDict()
        counters["name_only"] = stubs.count()
        new = cut(new.unionByName(stubs))
        n = new.groupBy("path").agg(F.count("*").cast("int").alias("n_passages"))
        rows = now_seen.join(todo, "path", "left_semi").join(n, "path", "left").select(
            "path", "size", "mtime", "content_hash", F.coalesce("n_passages", F.lit(0)).alias("n_passages"), F.lit(store.version + 1).alias("indexed_version"), F.lit(now).alias("indexed_at")
        )
        errors = [f"{r.path}: {r.error}" for r in read.filter("error IS NOT NULL").limit(100).collect()]
        self._commit(delta.filter("change <> 'unchanged'").select("path"), new, cut(rows.select(*manifest.FILE)), full, errors, source=self.root, last_indexed_at=now)
        counters |= {"n_files": store.table("files").count(), "n_passages": store.table("passages").count(), "errors": errors}
        return counters

    def _commit(self, changed: DataFrame, new: DataFrame, rows: DataFrame, full: bool, errors: list[str], **settings) -> None:
        """Brings every table up to date for the ``changed`` paths, in one version."""
        store, conf = self.store, self.conf
        if full or not store.has("passages"):
            every, every_file = new, rows
            do = {"replace": {"files": ("path", rows), "passages": ("path", new)}}
        else:
            every = store.table("passages").join(changed, "path", "left_anti").unionByName(new)
            every_file = store.table("files").join(changed, "path", "left_anti").unionByName(rows)
            do = {"upsert": {"files": ("path", changed, rows), "passages": ("path", changed, new)}}
        todo = [do, settings]
        # Folders and their notes change only with the set of paths.
        old_paths = store.table("files").select("path") if store.has("files") else every_file.select("path").limit(0)
        moved = full or not store.has("folders") or not every_file.select("path").exceptAll(old_paths).isEmpty() or not old_paths.exceptAll(every_file.select("path")).isEmpty()
        if moved:
            todo.append({"replace": {"folders": ("folder", folders.folders(every_file)), "folder_tokens": ("folder", folders.tokens(every_file)), "vault": ("note", folders.notes(every_file))}})
        for name, step in (("sparse", self._sparse), ("dense", self._dense)):
            if getattr(conf, name).enabled:
                try:
                    todo.append(step(changed, every, new, full))
                except Exception as e:  # noqa: BLE001 - one part of the index failing shouldn't sink the run
                    errors.append(f"{name}: {e}")
        store.commit(**merged(*todo))

    def _sparse(self, changed: DataFrame, every: DataFrame, new: DataFrame, full: bool) -> dict:
        language = self.conf.sparse.language
        if full or not self.store.has("postings") or self.store.meta().get("language") != language:
            return sparse.built(self.store, every, language)
        gone = self.store.table("passages").join(changed, "path", "left_semi")
        return sparse.updated(self.store, changed, gone, new, language)

    def _dense(self, changed: DataFrame, every: DataFrame, new: DataFrame, full: bool) -> dict:
        e = dense.embedder(self.conf.dense)
        if full or not self.store.has("vectors") or self.store.meta().get("embedder") != {"name": e.name, "dim": e.dim}:
            return dense.built(self.store, every, self.conf.dense)
        return dense.updated(self.store, changed, new, self.conf.dense)

    def status(self, check_staleness: bool = True) -> dict:
        if not self.store.exists():
            return {"indexed": False}
        meta, known = self.store.meta(), self.store.table("files")
        out = {"indexed": True, "index_version": meta["version"], "last_indexed_at": meta.get("last_indexed_at"), "n_files": known.count(), "n_passages": self.store.table("passages").count()}
        if check_staleness:
            scan = files.scan(self.spark, self.root, self.conf).withColumn("content_hash", F.lit(None).cast("string"))
            out |= manifest.staleness(manifest.changes(scan, known)).first().asDict()
        return out

    def write_vault(self, folder: str) -> None:
        """The notes of all folders as Markdown lines, in a folder for each note."""
        v = self.store.table("vault").withColumn("name", F.url_encode("note"))
        v.repartition("name").sortWithinPartitions("name", "section", "item").select("name", F.col("line").alias("value")).write.mode("overwrite").partitionBy("name").text(folder)

    # Searching: a text or a frame of ``query_id, query``

    def queries(self, query) -> DataFrame:
        return query if isinstance(query, DataFrame) else self.spark.createDataFrame([(1, query)], "query_id int, query string")

    def _passage_hits(self, hits: DataFrame, name: str) -> DataFrame:
        hits = cut(hits.select("query_id", "rank", "passage_id", "score"))  # k a query
        p = self.store.table("passages").join(F.broadcast(hits.select("passage_id").distinct()), "passage_id", "left_semi")
        return self._finish(hits.join(p, "passage_id").withColumn("snippet", T.snippet(F.col("text"))).withColumn("retriever", F.lit(name)))

    def _finish(self, rows: DataFrame) -> DataFrame:
        for c, t in (("page", "int"), ("offset", "int"), ("doc_id", "string")):
            if c not in rows.columns:
                rows = rows.withColumn(c, F.col("path") if c == "doc_id" else F.lit(None).cast(t))
        rows = manifest.metadata(rows, self.store.table("files"), self.root.rstrip("/") + "/")
        return rows.select("query_id", "rank", "doc_id", "passage_id", "path", "snippet", "score", "retriever", "page", "offset", "abs_path", "filename", "ext", "size", "mtime")

    def search_sparse(self, query, k: int = 10, prf: bool | None = None) -> DataFrame:
        """With ``prf`` (by default as in the settings) by an expanded query; where expansion fails, by the query itself."""
        index, q, conf = sparse.Index.open(self.store), self.queries(query), self.conf.sparse
        if conf.prf if prf is None else prf:
            try:
                return self._passage_hits(sparse.bm25_prf(index, q, k, conf), "sparse")
            except Exception:  # noqa: BLE001 - a query that can't be expanded is still a query
                pass
        return self._passage_hits(sparse.bm25(index, sparse.query_terms(q, index.language), k, conf), "sparse")

    def search_dense(self, query, k: int = 10) -> DataFrame:
        dense.check(self.store, self.conf.dense)
        return self._passage_hits(dense.search(self.store.table("vectors"), self.queries(query), k, self.conf.dense), "dense")

    def search_graph(self, query, k: int = 10) -> DataFrame:
        g, t = self.conf.graph, self.store.table
        hits = folders.search(t("files"), self.queries(query), k, g.hops, g.max_folders, t("folders"), t("folder_tokens"))
        return self._finish(hits.withColumn("retriever", F.lit("graph")))

    def search_kb(self, query, k: int = 10) -> DataFrame:
        """Notes are the Markdown files of the index as a whole (those under ``kb.vault``, if that is set), linked by ``[[name]]``."""
        p = self.store.table("passages").filter("lower(path) LIKE '%.md'")
        if self.conf.kb.vault:
            p = p.filter(F.col("path").startswith(self.conf.kb.vault.strip("/") + "/"))
        notes = cut(chunks.whole(p, self.conf.chunk.size, self.conf.chunk.overlap))
        edges = folders.links(notes.select(F.col("path").alias("note"), F.col("text").alias("line")), notes)
        hits = folders.kb_search(notes, edges, self.queries(query), k, max(0, self.conf.kb.hops), max(1, self.conf.kb.search_limit))
        return self._finish(hits.withColumn("passage_id", F.col("path")).withColumn("retriever", F.lit("kb"))).withColumn("abs_path", F.lit(None).cast("string"))

    def search_hybrid(self, query, k: int = 10, retrievers: list[str] | None = None, prf: bool | None = None) -> Hybrid:
        """All retrievers asked for (by default those enabled), fused by rank. One that is disabled or fails is skipped, with
        the reason in ``skipped``."""
        on = lambda n: bool(getattr(getattr(self.conf, n, None), "enabled", False)) and n in self.retrievers
        lists, skipped, pool = {}, {}, max(k, POOL)
        for n in retrievers or [n for n in self.retrievers if on(n)]:
            if not on(n):
                skipped[n] = "disabled in config"
                continue
            try:
                lists[n] = cut(self.retrievers[n](query, pool, **({"prf": prf} if n == "sparse" else {})))
            except FileNotFoundError as e:
                skipped[n] = str(e)
            except Exception as e:  # noqa: BLE001 - one retriever failing shouldn't sink the query
                skipped[n] = f"error: {e}"
        if not lists:
            cols = "query_id int, rank int, doc_id string, passage_id string, path string, snippet string, score double, retriever string, page int, offset int, abs_path string, filename string, ext string, size bigint, mtime double"
            return Hybrid(self.spark.createDataFrame([], cols), [], skipped)
        fused = fusion.reciprocal_rank(lists, top_n=k)
        every = None
        for n, d in lists.items():
            d = d.withColumn("source", F.lit(n))
            every = d if every is None else every.unionByName(d)
        rows = fused.join(every.drop("rank", "score", "doc_id", "retriever"), ["query_id", "passage_id", "source"])
        cols = [c for c in every.columns if c not in ("source",)]
        return Hybrid(rows.withColumn("retriever", F.lit("hybrid")).select(*cols), list(lists), skipped)

    def search(self, mode: str, query, k: int = 10, prf: bool | None = None) -> DataFrame:
        if mode == "hybrid":
            return self.search_hybrid(query, k, prf=prf).results
        if mode not in self.retrievers:
            raise ValueError(f"unknown mode {mode!r}")
        return self.retrievers[mode](query, k, **({"prf": prf} if mode == "sparse" else {}))


def indexes(spark: SparkSession, home: str) -> list[dict]:
    """The indexes under ``home``: ``store``, ``source`` (the folder indexed), numbers of files and passages."""
    path = spark._jvm.org.apache.hadoop.fs.Path(home)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    out = []
    for name in sorted(f.getPath().getName() for f in fs.listStatus(path)) if fs.exists(path) else []:
        store = Store(spark, f"{home.rstrip('/')}/{name}")
        if store.has("files"):
            meta = store.meta()
            out.append({"store": store.root, "source": meta.get("source"), "index_version": meta["version"], "n_files": store.table("files").count(), "n_passages": store.table("passages").count()})
    return out


def default_index(spark: SparkSession, home: str, root: str | None = None) -> str | None:
    """The store to search where none is named: that of ``root`` if there is one, else the first."""
    found = [i["store"] for i in indexes(spark, home)]
    mine = index_folder(home, root) if root else None
    return mine if mine in found else found[0] if found else None


def forget(spark: SparkSession, home: str, root: str) -> bool:
    """Deletes the index of a folder, never the folder; only what is an index directly under ``home``."""
    store = Store(spark, index_folder(home, root))
    if store.root.rsplit("/", 1)[0] != home.rstrip("/") or not store.exists():
        return False
    return bool(store._fs.delete(store._path(store.root), True))
