"""The engine's queries over the driver's tables, by name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skerry.config import Config
from skerry.functions import porter
from skerry.functions import text as T
from skerry.operators import chunks, dense, folders, fusion, manifest, sparse
from skerry.plans import globs, index
from skerry.sources import extract, files
from skerry.sources.store import Store
from skerry.tables import cut, table

CONF = Config()
OLD_VERSION = 20  # the manifest as of this version stands for an earlier run
VAULT_MODEL = "hash-64"


def _passages(s: SparkSession, d: str) -> DataFrame:
    return index.passages(s, d)


def _manifest(s: SparkSession, d: str) -> DataFrame:
    return manifest.current(table(s, d, "files"))


def _paths(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "files").select("path").distinct()


def _queries(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "queries").select("query_id", "query")


def _delta(s: SparkSession, d: str) -> DataFrame:
    files = table(s, d, "files")
    return manifest.changes(manifest.current(files), manifest.as_of(files, OLD_VERSION))


def manifest_current(s, d):
    return _manifest(s, d)


def files_scan(s, d):
    m = _manifest(s, d)
    return m.select("path", T.basename(F.col("path")).alias("filename"), T.extension(F.col("path")).alias("ext"), "size", "mtime")


def include_exclude_filter(s, d):
    return _paths(s, d).select("path", globs.selected(F.col("path"), CONF.include, CONF.exclude).alias("kept"))


def extract_dispatch(s, d):
    return _paths(s, d).select("path", extract.kind(F.col("path")).alias("extractor"))


def walk_extract(s, d):
    """Documents written as files, found by a walk with their sizes, opened and read."""
    root = index.folder(s, "files")
    files.write_texts(table(s, d, "documents").filter("text IS NOT NULL").select(F.concat(F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"), "text").distinct(), root)
    found = files.scan(s, root)
    read = files.opened(root, found.withColumn("content_hash", F.lit(None).cast("string")))
    pages = read.select("path", "content_hash", F.explode_outer("pages").alias("p")).select("path", "content_hash", "p.page", "p.text")
    return found.select("path", "size").join(pages, "path")


def content_hash(s, d):
    return table(s, d, "documents").select("doc_id", T.content_hash(F.col("text")).alias("content_hash"))


def clean_text(s, d):
    return table(s, d, "extracted_pages").distinct().select("path", "page", T.clean_text(F.col("text")).alias("text"))


def textual_ratio(s, d):
    return table(s, d, "documents").select("doc_id", F.coalesce(T.textual(T.clean_text(F.col("text"))), F.lit(False)).alias("textual"))


def chunk_passages(s, d):
    pages = table(s, d, "documents").select("doc_id", F.lit(None).cast("int").alias("page"), "text")
    return chunks.chunk(pages, CONF.chunk.size, CONF.chunk.overlap).select("passage_id", "ordinal", "offset", "text")


def chunk_pages(s, d):
    pages = table(s, d, "extracted_pages").select(F.col("path").alias("doc_id"), "page", "text").distinct()
    return chunks.chunk(pages, 64, 16).groupBy("doc_id", "page").agg(F.count("*").alias("windows"), F.min("offset").alias("first"), F.max("offset").alias("last"))


def stub_passages(s, d):
    f = _paths(s, d).filter(extract.kind(F.col("path")) == "name only")
    return chunks.stubs(f).select("passage_id", "path", "text")


def path_fields(s, d):
    return _paths(s, d).select("path", T.spaced(T.basename(F.col("path"))).alias("filename"), T.spaced(F.col("path")).alias("pathtext"))


def tokenize(s, d):
    w = _passages(s, d).select("passage_id", F.explode(T.words(F.col("text"))).alias("word"))
    return w.groupBy("word").agg(F.count("*").alias("n"), F.count_distinct("passage_id").alias("passages"))


def analyze_terms(s, d):
    return _passages(s, d).select(F.explode(T.terms(F.col("text"))).alias("term")).groupBy("term").agg(F.count("*").alias("n"))


def analyze_stems(s, d):
    t = _passages(s, d).select(F.explode(T.terms(F.col("text"))).alias("term")).groupBy("term").agg(F.count("*").alias("n"))
    return t.join(porter.stems(t), "term").groupBy("stem").agg(F.sum("n").alias("n"), F.count("*").alias("forms"))


def cjk_bigrams(s, d):
    runs = _passages(s, d).select(F.explode(F.regexp_extract_all("text", F.lit(f"[{T.CJK}]+"), F.lit(0))).alias("run"))
    return runs.select(F.explode(T.bigrams(F.col("run"))).alias("bigram")).groupBy("bigram").agg(F.count("*").alias("n"))


def analyze_terms_en(s, d):
    t = _passages(s, d).select(F.explode(T.analyzed(F.col("text"), "en")).alias("term")).groupBy("term").agg(F.count("*").alias("n"))
    return t.join(porter.stems(t), "term").groupBy("stem").agg(F.sum("n").alias("n"))


def _stored(s, d, language=sparse.PLAIN):
    return sparse.live(index.store(s, d, language))


def postings(s, d):
    return _stored(s, d).select("field", "term", "passage_id", "dl", "tf")


def term_stats(s, d):
    return sparse.term_stats(_stored(s, d))


def field_stats(s, d):
    return index.postings(s, d).stats


def index_build(s, d):
    """Statistics of an index as stored."""
    store = Store(s, index.folder(s, "build"))
    store.commit(**sparse.built(store, _passages(s, d), sparse.PLAIN))
    return sparse.term_stats(store.table("postings"))


def _before(p: DataFrame) -> DataFrame:
    """The passages as an earlier run may have seen them: no notes yet, text files with other words, and files that are gone."""
    old = p.filter("lower(path) NOT LIKE '%.md'").withColumn("text", F.when(F.lower("path").endswith(".txt"), F.concat(F.lit("stale words "), F.coalesce("text", F.lit("")))).otherwise(F.col("text")))
    gone = p.filter("lower(path) LIKE '%.csv'").withColumn("path", F.concat(F.lit("gone/"), "path")).withColumn("passage_id", F.concat(F.lit("gone/"), "passage_id"))
    return old.unionByName(gone)


def _changed(old: DataFrame, new: DataFrame) -> DataFrame:
    return old.unionByName(new).select("path").distinct().filter("lower(path) LIKE '%.md' OR lower(path) LIKE '%.txt' OR path LIKE 'gone/%'")


def index_update(s, d):
    """An index of earlier texts, brought up to date, has the statistics of a new one."""
    p = _passages(s, d)
    old, store = cut(_before(p)), Store(s, index.folder(s, "update"))
    store.commit(**sparse.built(store, old, sparse.PLAIN))
    changed = cut(_changed(old, p))
    pick = lambda rows: rows.join(changed, "path", "left_semi")
    store.commit(**sparse.updated(store, changed, pick(old), pick(p), sparse.PLAIN))
    return sparse.term_stats(sparse.live(store))


def bm25_contents(s, d):
    return sparse.bm25(index.postings(s, d), sparse.query_terms(_queries(s, d)), boosts={"contents": 1.0})


def bm25_multifield(s, d, k=10):
    return sparse.bm25(index.postings(s, d), sparse.query_terms(_queries(s, d)), k)


def bm25_stemmed(s, d):
    i = index.postings(s, d, CONF.sparse.language)
    return sparse.bm25(i, sparse.query_terms(_queries(s, d), i.language))


def prf_terms(s, d):
    i, q = index.postings(s, d), _queries(s, d)
    seeds = cut(sparse.bm25(i, sparse.query_terms(q), CONF.sparse.fb_docs).select("query_id", "passage_id", "score"))
    return sparse.expansion(i, q, seeds).withColumn("weight", F.round("weight", 6))


def bm25_prf(s, d):
    return sparse.bm25_prf(index.postings(s, d), _queries(s, d))


def hash_embed(s, d):
    e = dense.hash_embed(_passages(s, d).select("passage_id", "text"), "passage_id", "text")
    return e.select(F.col("id").alias("passage_id"), "bucket", F.round("weight", 6).alias("weight"))


def hash_dense_search(s, d, k=10):
    return dense.search(index.vectors(s, d), _queries(s, d), k, above=0.0)


def _parts(v: DataFrame) -> DataFrame:
    return v.select("passage_id", F.posexplode("vec").alias("bucket", "weight")).filter("weight <> 0").withColumn("weight", F.round("weight", 6))


def vectors_build(s, d):
    """Vectors as stored."""
    store = Store(s, index.folder(s, "vectors"))
    store.commit(**dense.built(store, _passages(s, d), kind="double"))
    return _parts(store.table("vectors"))


def vectors_update(s, d):
    """Vectors of earlier texts, brought up to date; what the cache has isn't made again."""
    p = _passages(s, d)
    old, store = cut(_before(p)), Store(s, index.folder(s, "vectors"))
    store.commit(**dense.built(store, old, kind="double"))
    changed = cut(_changed(old, p))
    store.commit(**dense.updated(store, changed, p.join(changed, "path", "left_semi"), kind="double"))
    return _parts(store.table("vectors"))


def embed_cache_put(s, d):
    """What the store of vectors has put into its cache."""
    return index.store(s, d, "vectors").table("cache").select("key", "model", "dim", F.size("vec").alias("n"))


def dense_topk(s, d):
    e = table(s, d, "embeddings")
    return dense.topk(e, e.filter("vec_id % 100 = 0"))


def embed_cache_keys(s, d):
    return dense.cache_keys(_passages(s, d), VAULT_MODEL)


def embed_cache_hits(s, d):
    return dense.cache_hits(_passages(s, d), table(s, d, "emb"), VAULT_MODEL)


def folder_tree(s, d):
    return folders.folders(_paths(s, d))


def folder_contents(s, d):
    return folders.contents(_paths(s, d))


def folder_tokens(s, d):
    return folders.tokens(_paths(s, d))


def folder_scores(s, d):
    return folders.scores(_paths(s, d), _queries(s, d))


def folder_neighbors(s, d):
    return folders.neighbours(_paths(s, d))


def folder_subtree_files(s, d):
    return folders.ancestors(_paths(s, d)).groupBy("folder").agg(F.count("*").alias("files"), F.min(T.depth_first_key(F.col("path"))).alias("first_key"))


def graph_hop_expand(s, d):
    p = _paths(s, d)
    seeds = folders.best_folders(folders.scores(p, _queries(s, d)), CONF.graph.max_folders).select("query_id", "folder", "score")
    return folders.expand(folders.folders(p), seeds, 2)


def graph_search(s, d, k=10):
    return folders.search(_paths(s, d), _queries(s, d), k, CONF.graph.hops, CONF.graph.max_folders)


def vault_notes(s, d):
    return folders.notes(_paths(s, d))


def kb_links(s, d):
    return folders.links(folders.notes(_paths(s, d)))


def _kb(s, d):
    """Notes as a whole, put together from their windows, each linked with the note of its folder."""
    p = table(s, d, "passages").filter("lower(path) LIKE '%.md'").select("path", "page", "ordinal", "text").distinct()
    n = chunks.whole(p, CONF.chunk.size, CONF.chunk.overlap)
    folder = T.parent_of(F.col("path"))
    up = n.select(F.col("path").alias("src"), F.concat(F.when(folder == "", "_root").otherwise(folder), F.lit(".md")).alias("dst"))
    return n, up.unionByName(up.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()


def kb_expand(s, d):
    n, edges = _kb(s, d)
    return folders.expand_links(edges, folders.note_seeds(n, _queries(s, d)), 2).withColumn("score", F.round("score", 6))


def kb_search(s, d):
    n, edges = _kb(s, d)
    return folders.kb_search(n, edges, _queries(s, d), 10, CONF.kb.hops, CONF.kb.search_limit)


def kb_snippet(s, d):
    n, _ = _kb(s, d)
    q = F.lit("the committee versiegelten 2023")
    return n.select("path", T.match_snippet(T.without_front_matter(F.coalesce("text", F.lit(""))), q).alias("snippet"))


def highlight(s, d):
    return _passages(s, d).filter("text IS NOT NULL").select("passage_id", T.highlight(T.snippet(F.col("text")), F.lit("The committee (GARDEN) a 5")).alias("marked")).distinct()


POOL = 20  # hits of each list that fusion sees at least


def _with_doc(s, d, hits):
    p = table(s, d, "passages").select("passage_id", "doc_id")
    return hits.join(p.join(F.broadcast(hits.select("passage_id").distinct()), "passage_id", "left_semi").distinct(), "passage_id").select("query_id", "rank", "doc_id", "passage_id", "score")


def _sparse_list(s, d, k=POOL):
    return _with_doc(s, d, bm25_multifield(s, d, k))


def _dense_list(s, d, k=POOL):
    return _with_doc(s, d, hash_dense_search(s, d, k))


def rrf_fusion(s, d):
    return fusion.reciprocal_rank({"sparse": _sparse_list(s, d), "dense": _dense_list(s, d)})


def hybrid_search(s, d):
    g = graph_search(s, d, POOL).select("query_id", "rank", F.col("path").alias("doc_id"), "passage_id", "score")
    return fusion.reciprocal_rank({"sparse": _sparse_list(s, d), "dense": _dense_list(s, d), "graph": g})


def result_metadata(s, d):
    r = _sparse_list(s, d, 10).withColumnRenamed("doc_id", "path")
    return manifest.metadata(r, _manifest(s, d), "/data/").select("query_id", "rank", "passage_id", "path", "filename", "ext", "abs_path", "size", "mtime")


def change_detection(s, d):
    return _delta(s, d)


def deleted_files(s, d):
    files = table(s, d, "files")
    # The scan sees the files of later versions only; all others count as deleted.
    scan = manifest.current(files.filter(F.col("indexed_version") > OLD_VERSION))
    return manifest.changes(scan, manifest.as_of(files, OLD_VERSION)).filter("change = 'deleted'").select("path")


def removed_passages(s, d):
    return manifest.removed_passages(_passages(s, d), _delta(s, d))


def incremental_apply(s, d):
    files = table(s, d, "files")
    now = manifest.current(files)
    return manifest.apply(manifest.as_of(files, OLD_VERSION), now, manifest.changes(now, manifest.as_of(files, OLD_VERSION)))


def index_report(s, d):
    return manifest.report(_delta(s, d))


def staleness(s, d):
    return manifest.staleness(_delta(s, d))


def index_stats(s, d):
    return manifest.stats(_manifest(s, d), _passages(s, d))


def manifest_lookup(s, d):
    want = table(s, d, "extracted_pages").select("path").distinct()
    return _passages(s, d).join(want, "path", "left_semi").select("path", "ordinal", "passage_id", "page", "offset")


NAMES = """manifest_current files_scan walk_extract include_exclude_filter extract_dispatch content_hash clean_text textual_ratio chunk_passages chunk_pages
stub_passages path_fields tokenize analyze_terms analyze_terms_en analyze_stems cjk_bigrams index_build index_update postings term_stats field_stats bm25_contents bm25_multifield bm25_stemmed
prf_terms bm25_prf hash_embed vectors_build vectors_update embed_cache_put hash_dense_search dense_topk embed_cache_keys embed_cache_hits folder_tree folder_contents folder_tokens folder_scores folder_neighbors
folder_subtree_files graph_hop_expand graph_search vault_notes kb_links kb_expand kb_search kb_snippet highlight rrf_fusion hybrid_search result_metadata
change_detection deleted_files removed_passages incremental_apply index_report staleness index_stats manifest_lookup""".split()

QUERIES = {n: globals()[n] for n in NAMES}
