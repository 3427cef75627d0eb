"""Reading tables, cutting lineage, and what every operator asks about the size of a side."""

from __future__ import annotations

import tempfile
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes up to which a side may be broadcast.
BROADCAST_BYTES = 16_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, which all executors must see. Only a session that runs in one
    process may do without: it gets a temporary one."""
    sc = spark.sparkContext
    named = sc._jsc.sc().getCheckpointDir()
    if named.isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors see")
            folder = tempfile.mkdtemp(prefix="skerry-ckpt-")
        sc.setCheckpointDir(folder)
        named = sc._jsc.sc().getCheckpointDir()
    return named.get()


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder name in the shared folder."""
    return f"{shared_folder(spark)}/skerry-{name}-{uuid.uuid4().hex}"


#: Spark's own switch for dropping the shuffle files of an execution when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut(df: DataFrame) -> DataFrame:
    """Materialise in the shared checkpoint folder, so that a lost executor costs no recomputation. The shuffle files of
    that run aren't needed after it, and Spark drops them at its end."""
    spark = df.sparkSession
    shared_folder(spark)
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        return df.select("*").checkpoint(eager=True)
    finally:
        spark.conf.set(CLEANUP, before)


def small(df: DataFrame, most: int = BROADCAST_BYTES) -> DataFrame:
    """Broadcast hint for a side that is small enough, by the bytes of its values; else the planner shuffles. For a side that
    is dear to compute, ``cut`` it first: it is measured here."""
    def width(name: str, kind: str):
        c = F.col(f"`{name}`")
        if kind == "string" or kind == "binary":
            return F.coalesce(F.octet_length(c), F.lit(0)) + 16
        if kind.startswith("array"):
            return F.greatest(F.coalesce(F.size(c), F.lit(0)), F.lit(0)) * 24 + 16
        return F.lit(8)

    each = reduce(lambda a, b: a + b, (width(n, k) for n, k in df.dtypes), F.lit(16))
    size = df.agg(F.sum(each.cast("bigint")).alias("n")).first().n or 0
    return F.broadcast(df) if size <= most else df


def distinct_rows(df: DataFrame, key: str) -> DataFrame:
    """``df.distinct()`` for rows that are told apart by ``key`` but for repeated ones: only the keys and the rows of
    repeated keys are shuffled, not the texts of all others. Null keys count as repeated."""
    again = cut(df.groupBy(key).agg(F.count("*").alias("n")).filter((F.col("n") > 1) | F.col(key).isNull()).select(F.col(key).alias("again")))
    if again.isEmpty():
        return df
    few = small(again)
    if few is again:
        return df.distinct()
    same = F.col(key).eqNullSafe(F.col("again"))
    return df.join(few, same, "left_anti").unionByName(df.join(few, same, "left_semi").distinct())
