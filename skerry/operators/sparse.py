"""Inverted index, multi-field BM25 and feedback expansion, for whole sets of queries at once."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skerry.config import Sparse
from skerry.functions import porter
from skerry.functions import text as T
from skerry.sources.store import Store
from skerry.tables import cut, small

FIELDS = ("contents", "filename", "pathtext")
#: An analyzer that neither stems nor leaves out words.
PLAIN = "plain"
#: Segments of stored postings from which an update merges them into one.
SEGMENTS = 8
# Words that never expand a query.
STOPWORDS = (
    "the a an and or of to in on for with is are was were be been by at as it this that"
    " these those from but not we you he she they i my our your their its his her also"
    " which what when where who how can will would should could may might do does did has"
    " have had than then there here such into about over under via per etc page pages"
    " pdf doc docx ppt pptx xls xlsx txt file files figure table http https www com"
).split()


def fields(passages: DataFrame, language: str = PLAIN) -> DataFrame:
    """``passage_id, path, field, terms, dl``: one row for each field of a passage that has terms (not yet stemmed).
    Passages are taken as they come; repeated rows are left out before."""
    each = [F.struct(F.lit(f).alias("field"), T.analyzed(F.coalesce(c, F.lit("")), language).alias("terms")) for f, c in (("contents", F.col("text")), ("filename", T.spaced(T.basename(F.col("path")))), ("pathtext", T.spaced(F.col("path"))))]
    p = passages.select("passage_id", "path", F.explode(F.array(*each)).alias("f")).select("passage_id", "path", "f.field", "f.terms")
    return p.withColumn("dl", F.size("terms")).filter("dl > 0")


def postings(passages: DataFrame, language: str = PLAIN) -> DataFrame:
    """``field, term, passage_id, path, tf, dl``. Terms are counted within their passage before anything is shuffled,
    and stemmed by way of their vocabulary."""
    f = fields(passages, language).select("passage_id", "path", "field", "dl", F.explode("terms").alias("term"))
    keys = ["field", "term", "passage_id", "path", "dl"]
    post = f.groupBy(*keys).agg(F.count("*").cast("int").alias("tf"))
    if T.stemmed(language):
        post = cut(post)
        stems = cut(porter.stems(post.select("term")))
        post = post.join(small(stems), "term").withColumn("term", F.col("stem")).groupBy(*keys).agg(F.sum("tf").cast("int").alias("tf"))
    return post


def term_stats(post: DataFrame) -> DataFrame:
    return post.groupBy("field", "term").agg(F.count("*").alias("df"), F.sum("tf").alias("ttf"))


def field_stats(flds: DataFrame) -> DataFrame:
    return flds.groupBy("field").agg(F.count("*").alias("n_docs"), F.sum("dl").alias("sum_ttf"))


def norm(dl, quantize: bool):
    """Field length as kept in one byte: exact below 40, above with four significant bits."""
    if not quantize:
        return dl
    s = F.greatest(F.lit(0), F.floor(F.log2(F.greatest(dl - 24, F.lit(1)).cast("double"))) - 3)
    step = F.pow(F.lit(2.0), s.cast("double"))
    return F.when(dl < 40, dl.cast("double")).otherwise(24 + F.floor((dl - 24) / step) * step)


def query_terms(queries: DataFrame, language: str = PLAIN) -> DataFrame:
    """``query_id, term, qtf`` by the analyzer of the index."""
    q = queries.select("query_id", F.explode(T.analyzed(F.coalesce("query", F.lit("")), language)).alias("term"))
    if T.stemmed(language):
        q = q.join(F.broadcast(porter.stems(q.select("term"))), "term").select("query_id", F.col("stem").alias("term"))  # the words of a stated query set
    return q.groupBy("query_id", "term").agg(F.count("*").alias("qtf"))


@dataclass
class Index:
    """Postings to look terms up in, the numbers of passages and terms of each field, and the passages themselves.
    ``lookup`` takes a small frame of ``term`` and gives ``field, term, passage_id, dl, tf``."""

    lookup: Callable[[DataFrame], DataFrame]
    stats: DataFrame  # field, n_docs, sum_ttf
    passages: DataFrame
    language: str = PLAIN

    @classmethod
    def of(cls, passages: DataFrame, language: str = PLAIN) -> Index:
        """An index that isn't stored: the terms looked up filter the postings before these are grouped."""
        post = postings(passages, language)
        return cls(lambda terms: post.join(F.broadcast(terms), "term", "left_semi"), field_stats(fields(passages, language)), passages, language)

    @classmethod
    def open(cls, store: Store) -> Index:
        """The stored one; fails if there is none. Only the parts that hold a term looked up are read."""
        meta = store.meta()
        if not store.has("postings"):
            store.table("postings")
        stats = store.spark.createDataFrame([(f, *n) for f, n in sorted(meta["field_stats"].items())], "field string, n_docs bigint, sum_ttf bigint")

        def lookup(terms: DataFrame) -> DataFrame:
            parts = {r.p for r in terms.select(store.part_of("term").alias("p")).distinct().collect()}  # at most the parts
            return live(store, parts).join(F.broadcast(terms), "term", "left_semi")

        return cls(lookup, stats, store.table("passages"), meta["language"])


def live(store: Store, parts: set[int] | None = None) -> DataFrame:
    """Stored postings, without those of files that a later run replaced or deleted."""
    post = store.table("postings", parts)
    if not store.has("dead"):
        return post
    dead = cut(store.table("dead").groupBy(F.col("path").alias("gone")).agg(F.max("before").alias("before")))
    return post.join(small(dead), (F.col("path") == F.col("gone")) & (F.col("segment") < F.col("before")), "left_anti")


def _counts(passages: DataFrame, language: str) -> dict[str, tuple[int, int]]:
    return {r.field: (r.n_docs, r.sum_ttf) for r in field_stats(fields(passages, language)).collect()}  # a row a field


def built(store: Store, passages: DataFrame, language: str) -> dict:
    """What a commit needs to store a whole new index: its tables and settings."""
    post = postings(passages, language).withColumn("segment", F.lit(store.version + 1))
    return {"replace": {"postings": ("term", post)}, "drop": ("dead",), "language": language, "field_stats": _counts(passages, language)}


def updated(store: Store, changed: DataFrame, old: DataFrame, new: DataFrame, language: str) -> dict:
    """What a commit needs to bring the stored index up to date: a segment of postings of the ``new`` passages, and the
    ``changed`` paths, whose older postings don't count any more. Statistics lose the ``old`` passages of these paths and gain
    the new ones, so they are always those of a rebuild. Many segments are merged; another language means a rebuild."""
    meta = store.meta()
    if not store.has("postings") or meta.get("language") != language:
        raise ValueError("no index of that language to update")
    post = postings(new, language).withColumn("segment", F.lit(store.version + 1))
    gone, come = _counts(old, language), _counts(new, language)
    names = sorted({*meta["field_stats"], *come})
    stats = {f: [meta["field_stats"].get(f, (0, 0))[i] - gone.get(f, (0, 0))[i] + come.get(f, (0, 0))[i] for i in (0, 1)] for f in names}
    out = {"language": language, "field_stats": {f: n for f, n in stats.items() if n[0]}}
    if store.segments("postings") + 1 >= SEGMENTS:
        rest = live(store).join(changed.select("path").distinct(), "path", "left_anti")
        return {**out, "replace": {"postings": ("term", rest.unionByName(post))}, "drop": ("dead",)}
    return {**out, "append": {"postings": ("term", post), "dead": ("path", changed.select("path", F.lit(store.version + 1).alias("before")))}}


def bm25(index: Index, qterms: DataFrame, k: int = 10, conf: Sparse = Sparse(), boosts: dict | None = None) -> DataFrame:
    """``query_id, rank, passage_id, score`` of the best ``k`` passages for ``query_id, term, qtf``.

    Terms of the queries are a stated, small set: only their postings are read, and document frequencies come
    from these. Equal scores go by passage id.
    """
    boosts = conf.field_boosts if boosts is None else boosts
    qterms = cut(qterms)
    post = cut(index.lookup(qterms.select("term").distinct()).filter(F.col("field").isin(list(boosts))).select("passage_id", "field", "term", "dl", "tf"))
    df = post.groupBy("field", "term").agg(F.count("*").alias("df"))
    fs = index.stats.withColumn("avgdl", F.col("sum_ttf") / F.col("n_docs"))
    boost = F.create_map(*(x for f, b in boosts.items() for x in (F.lit(f), F.lit(float(b)))))
    weights = df.join(F.broadcast(fs), "field").join(qterms, "term")  # a row for each field
    idf = F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weights = cut(weights.select("query_id", "field", "term", "avgdl", (boost[F.col("field")] * F.col("qtf") * idf).alias("weight")))
    tfn = F.col("tf") / (F.col("tf") + conf.k1 * (1 - conf.b + conf.b * norm(F.col("dl"), conf.quantize_norms) / F.col("avgdl")))
    scored = post.join(small(weights), ["field", "term"]).groupBy("query_id", "passage_id").agg(F.round(F.sum(F.col("weight") * tfn), 6).alias("score"))
    return top(scored, k)


def top(scored: DataFrame, k: int, key: str = "passage_id") -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), key)
    return scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def expansion(index: Index, queries: DataFrame, seeds: DataFrame, conf: Sparse = Sparse()) -> DataFrame:
    """``query_id, term, weight``: feedback terms of the seeds (``query_id, passage_id, score``), by relative
    frequency weighted by score, the best 50 ranked again by times inverse document frequency. Only the texts of the
    seeds are taken apart, and only the postings of the best terms are read."""
    total = seeds.groupBy("query_id").agg(F.sum("score").alias("total"))
    s = seeds.join(total, "query_id").withColumn("w", F.col("score") / F.when(F.col("total") == 0, 1.0).otherwise(F.col("total")))
    s = cut(s.select("query_id", "passage_id", "w"))
    few = cut(index.passages.select("passage_id", "path", "text").join(small(s.select("passage_id").distinct()), "passage_id", "left_semi"))
    post = postings(few, index.language).filter("field = 'contents'")
    tf = post.join(s, "passage_id")
    rm = tf.groupBy("query_id", "term").agg(F.round(F.sum(F.col("w") * F.col("tf") / F.col("dl")), 9).alias("rm"))
    own = queries.select("query_id", F.explode(T.words(F.coalesce("query", F.lit("")))).alias("term")).distinct()
    rm = rm.join(own, ["query_id", "term"], "left_anti").filter((F.length("term") >= 2) & F.col("term").rlike(r"[\p{L}\p{N}]") & ~F.col("term").isin(STOPWORDS))
    w = Window.partitionBy("query_id").orderBy(F.desc("rm"), "term")
    rm = cut(rm.withColumn("r", F.row_number().over(w)).filter("r <= 50"))
    df = index.lookup(rm.select("term").distinct()).filter("field = 'contents'").groupBy("term").agg(F.count("*").alias("df"))
    n = index.stats.filter("field = 'contents'").select(F.col("n_docs").alias("n"))
    scored = rm.join(df, "term").join(F.broadcast(n)).withColumn("weight", F.round(F.col("rm") * F.log((F.col("n") + 1) / (F.col("df") + 0.5)), 9))
    w = Window.partitionBy("query_id").orderBy(F.desc("weight"), "r")
    return scored.withColumn("k", F.row_number().over(w)).filter(F.col("k") <= conf.fb_terms).select("query_id", "term", "weight")


def bm25_prf(index: Index, queries: DataFrame, k: int = 10, conf: Sparse = Sparse()) -> DataFrame:
    """BM25 of the query, counted twice, and its expansion, which is analysed once more."""
    qt = cut(query_terms(queries, index.language))
    seeds = cut(bm25(index, qt, conf.fb_docs, conf).select("query_id", "passage_id", "score"))
    more = query_terms(expansion(index, queries, seeds, conf).select("query_id", F.col("term").alias("query")), index.language)
    every = qt.withColumn("qtf", F.col("qtf") * 2).unionByName(more).groupBy("query_id", "term").agg(F.sum("qtf").alias("qtf"))
    return bm25(index, every, k, conf)
