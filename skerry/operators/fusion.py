"""Joining ranked lists."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

RANK_CONSTANT = 60


def reciprocal_rank(lists: dict[str, DataFrame], k: int = RANK_CONSTANT, top_n: int = 10) -> DataFrame:
    """``query_id, rank, doc_id, passage_id, score, source`` of ``query_id, rank, doc_id, passage_id, score`` lists.

    Ranks count from 1 and weigh ``1 / (k + rank - 1)``; a passage in several lists keeps as its source the
    list with the highest score of its own, the earlier one of equals; equal sums go by first list, then rank.
    """
    each = [d.select("query_id", "doc_id", "passage_id", F.col("rank"), F.col("score").cast("double").alias("own"), F.lit(i).alias("list"), F.lit(name).alias("source")) for i, (name, d) in enumerate(lists.items())]
    rows = reduce(DataFrame.unionByName, each)
    fused = rows.groupBy("query_id", "doc_id", "passage_id").agg(
        F.round(F.sum(1 / (F.lit(float(k)) + F.col("rank") - 1)), 9).alias("score"), F.max_by("source", F.struct("own", (-F.col("list")).alias("l"))).alias("source"), F.min(F.struct("list", "rank")).alias("first")
    )
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "first", "passage_id")
    return fused.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top_n).drop("first")
