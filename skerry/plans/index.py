"""Indexes over the driver's tables, built once a session.

The first query that needs one stores it in the shared folder; later ones read it. It is known by the folder of
the tables, the names, sizes and times of their files, and the analyzer, so a changed table means a new index.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from skerry.operators import dense, sparse
from skerry.sources.store import Store
from skerry.tables import distinct_rows, scratch, table

_BUILT: dict[tuple, str] = {}


def passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "passages").select("passage_id", "doc_id", "path", "ordinal", "page", "offset", "text")
    return distinct_rows(rows, "passage_id")


def _state(spark: SparkSession, sf_dir: str) -> tuple:
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{sf_dir.rstrip('/')}/passages.parquet")
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    return tuple(sorted((f.getPath().toString(), f.getLen(), f.getModificationTime()) for f in fs.listStatus(path)))


def folder(spark: SparkSession, name: str) -> str:
    """A folder of the shared folder that goes with the session."""
    root = scratch(spark, name)
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    return root


def store(spark: SparkSession, sf_dir: str, kind: str) -> Store:
    """``kind``: ``vectors``, or the analyzer of a store of postings."""
    key = (spark.sparkContext.applicationId, kind, _state(spark, sf_dir))
    if key not in _BUILT:
        s = Store(spark, folder(spark, "index"))
        rows = passages(spark, sf_dir)
        if kind == "vectors":
            s.commit(**dense.built(s, rows, kind="double"))
        else:
            s.commit(**merged(sparse.built(s, rows, kind), {"replace": {"passages": ("path", rows)}}))
        _BUILT[key] = s.root
    return Store(spark, _BUILT[key])


def postings(spark: SparkSession, sf_dir: str, language: str = sparse.PLAIN) -> sparse.Index:
    return sparse.Index.open(store(spark, sf_dir, language))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store(spark, sf_dir, "vectors").table("vectors")


def merged(*commits: dict) -> dict:
    """Several commits as one."""
    out: dict = {}
    for c in commits:
        for k, v in c.items():
            out[k] = {**out.get(k, {}), **v} if k in ("upsert", "replace", "append") else out.get(k, ()) + v if k == "drop" else v
    return out
