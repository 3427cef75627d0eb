"""The manifest: current versions, changes between a scan and the manifest, and what follows from them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FILE = ["path", "size", "mtime", "content_hash", "n_passages", "indexed_version", "indexed_at"]


def current(files: DataFrame) -> DataFrame:
    """The latest version of each path, by aggregation (a path with many versions is no hot window)."""
    order = F.struct(F.coalesce("indexed_version", F.lit(-1)), F.coalesce("indexed_at", F.lit(-1.0)), F.coalesce("mtime", F.lit(-1.0)), F.coalesce("size", F.lit(-1)), F.coalesce("content_hash", F.lit("")), F.coalesce("n_passages", F.lit(-1)))
    rest = [c for c in FILE if c != "path"]
    top = files.groupBy("path").agg(F.max_by(F.struct(*rest), order).alias("r"))
    return top.select("path", "r.*")


def as_of(files: DataFrame, version: int) -> DataFrame:
    return current(files.filter(F.col("indexed_version") <= version))


def changes(scan: DataFrame, manifest: DataFrame, full: bool = False) -> DataFrame:
    """``path, change`` of every file on either side: added, modified, unchanged or deleted. Size and time are
    compared first; a hash is only asked for where they differ."""
    m = manifest.select("path", F.col("size").alias("m_size"), F.col("mtime").alias("m_mtime"), F.col("content_hash").alias("m_hash"), F.lit(True).alias("known"))
    both = scan.select("path", "size", "mtime", "content_hash", F.lit(True).alias("seen")).join(m, "path", "full")
    same = (F.col("size").eqNullSafe(F.col("m_size")) & F.col("mtime").eqNullSafe(F.col("m_mtime"))) | (F.col("content_hash") == F.col("m_hash"))
    change = (
        F.when(F.col("seen").isNull(), "deleted").when(F.col("known").isNull(), "added").when(F.lit(full), "modified").when(F.coalesce(same, F.lit(False)), "unchanged").otherwise("modified")
    )
    return both.select("path", change.alias("change"))


def removed_passages(passages: DataFrame, delta: DataFrame) -> DataFrame:
    gone = delta.filter("change IN ('modified', 'deleted')").select("path")
    return passages.join(gone, "path", "left_semi").select("passage_id").distinct()


def apply(manifest: DataFrame, scan: DataFrame, delta: DataFrame) -> DataFrame:
    """The manifest after a run: changed paths from the scan, all others but the deleted as they were."""
    changed = delta.filter("change IN ('added', 'modified')").select("path")
    touched = delta.filter("change <> 'unchanged'").select("path")
    return manifest.join(touched, "path", "left_anti").select(*FILE).unionByName(scan.join(changed, "path", "left_semi").select(*FILE))


def report(delta: DataFrame) -> DataFrame:
    n = lambda c: F.sum((F.col("change") == c).cast("long"))
    return delta.agg(*(F.coalesce(n(c), F.lit(0)).alias(c) for c in ("added", "modified", "deleted", "unchanged")))


def staleness(delta: DataFrame) -> DataFrame:
    r = report(delta)
    return r.select((F.col("added") + F.col("modified") + F.col("deleted")).alias("pending"), F.col("added").alias("pending_added"), F.col("modified").alias("pending_modified"), F.col("deleted").alias("pending_deleted")).withColumn("stale", F.col("pending") > 0)


def stats(manifest: DataFrame, passages: DataFrame) -> DataFrame:
    f = manifest.agg(F.count("*").alias("n_files"), F.max("indexed_version").alias("index_version"), F.max("indexed_at").alias("last_indexed_at"))
    return f.join(passages.agg(F.count_distinct("passage_id").alias("n_passages")))


def metadata(results: DataFrame, manifest: DataFrame, root: str = "") -> DataFrame:
    """Results with the name, extension, place, size and time of their files; null where the file isn't known."""
    from skerry.functions import text as T

    m = manifest.select("path", "size", "mtime")
    out = results.join(m, "path", "left")
    return out.withColumn("filename", T.basename(F.col("path"))).withColumn("ext", T.extension(F.col("path"))).withColumn("abs_path", F.concat(F.lit(root), F.col("path")))
