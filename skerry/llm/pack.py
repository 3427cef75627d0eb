"""Filling containers of fixed capacity (problem 8).

Shortest pack first over the histogram of lengths: lengths are placed longest first, each into the
open pattern with the most room; a pattern stands for a contiguous range of containers, so placing
``n`` items of a length moves a whole range at once. The histogram has at most ``capacity`` rows,
and each placing step uses up a length or a pattern, or fills new containers with one length; so ranges
number at most ``capacity * (2 + ln capacity)`` or so, whatever the number of documents. Documents find their container by their rank among the items of
their length; ranks are counted in salted blocks, so a length that a third of all rows share is no
hot group.

Cases: an item larger than the capacity is cut into full pieces and a rest, no other item is cut;
a text without tokens is an item of size 0 and takes no room (they go to container ``id hash mod
containers``, or container 0 if there is none); repeated rows of one document count once.
"""

from __future__ import annotations

import heapq
from collections import defaultdict

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skerry.tables import cut, table

from .tokens import DEFAULT_VOCAB, count_tokens


def plan_containers(hist: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int]], int]:
    """``[(length, first rank, first container, offset in container)]`` and the number of containers."""
    open_: dict[int, list[tuple[int, int]]] = defaultdict(list)  # room -> ranges of containers
    rooms: list[int] = []  # heap of rooms, largest first
    ranges, containers = [], 0

    def put(room: int, first: int, n: int) -> None:
        if not open_[room]:
            heapq.heappush(rooms, -room)
        open_[room].append((first, n))

    for length in sorted((k for k, n in hist.items() if k > 0 and n > 0), reverse=True):
        left, rank = hist[length], 0
        while left:
            while rooms and not open_[-rooms[0]]:
                heapq.heappop(rooms)
            room = -rooms[0] if rooms else 0
            if room < length:
                # One after the other, the items that are left fill new containers: each as many as it holds.
                per = capacity // length
                full, rest = divmod(left, per)
                for j in range(min(per, left)):
                    n = full + (j < rest)
                    ranges.append((length, rank, containers, j * length))
                    rank += n
                if full and capacity > per * length:
                    put(capacity - per * length, containers, full)
                if rest:
                    put(capacity - rest * length, containers + full, 1)
                containers += full + (rest > 0)
                break
            first, n = open_[room].pop()
            take = min(n, left)
            ranges.append((length, rank, first, capacity - room))
            if take < n:
                put(room, first + take, n - take)
            if room > length:
                put(room - length, first, take)
            rank += take
            left -= take
    return ranges, containers


def pack(sizes: DataFrame, capacity: int, id_col: str = "doc_id", size_col: str = "n_tokens", block: int = 200_000) -> DataFrame:
    """``id_col, piece, start_token, n_tokens, container_id, container_offset``, one row per piece."""
    spark = sizes.sparkSession
    full = F.expr(f"{size_col} div {capacity}").cast("int")
    items = cut(
        sizes.select(F.col(id_col), F.coalesce(F.col(size_col), F.lit(0)).alias(size_col))
        .dropDuplicates()
        .withColumn("_full", full)
        .withColumn("_rest", (F.col(size_col) % capacity).cast("int"))
        .withColumn("_last", F.when((F.col("_rest") > 0) | (F.col("_full") == 0), F.col("_full")).otherwise(F.col("_full") - 1))
        .withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("_last"))))
        .select(id_col, "piece", (F.col("piece") * capacity).alias("start_token"), F.when(F.col("piece") < F.col("_full"), capacity).otherwise(F.col("_rest")).cast("int").alias("n_tokens"))
    )
    hist = {r.n_tokens: r.n for r in items.groupBy("n_tokens").agg(F.count("*").alias("n")).collect()}  # at most capacity + 1 rows
    ranges, containers = plan_containers(hist, capacity)
    salts = max(1, -(-sum(hist.values()) // block))
    by: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
    for length, rank, first, off in ranges:
        by[length].append((rank, first, off))
    places = spark.sparkContext.broadcast({k: np.array(v, np.int64) for k, v in by.items()})  # bounded by the capacity, see above

    salted = items.withColumn("_salt", F.pmod(F.xxhash64(id_col, "piece"), F.lit(salts)).cast("int"))
    counts = salted.groupBy("n_tokens", "_salt").agg(F.count("*").alias("_n"))
    base = counts.select("n_tokens", "_salt", (F.sum("_n").over(Window.partitionBy("n_tokens").orderBy("_salt")) - F.col("_n")).alias("_base"))
    ranked = salted.withColumn("_rank", F.row_number().over(Window.partitionBy("n_tokens", "_salt").orderBy(id_col, "piece")) - 1).join(base, ["n_tokens", "_salt"]).withColumn("_rank", F.col("_rank") + F.col("_base"))

    @F.pandas_udf("struct<c: bigint, o: int>")
    def place(size: pd.Series, rank: pd.Series, h: pd.Series) -> pd.DataFrame:
        size, rank = size.to_numpy(), rank.to_numpy()
        c = h.to_numpy() % max(1, containers)
        o = np.zeros(len(size), np.int32)
        for s in np.unique(size):
            if s == 0:
                continue
            m = size == s
            a = places.value[int(s)]
            k = np.searchsorted(a[:, 0], rank[m], side="right") - 1
            c[m] = a[k, 1] + rank[m] - a[k, 0]
            o[m] = a[k, 2]
        return pd.DataFrame({"c": c, "o": o})

    got = ranked.withColumn("_p", place("n_tokens", "_rank", F.pmod(F.xxhash64(id_col, F.lit(7)), F.lit(1 << 40))))
    return got.select(id_col, "piece", "start_token", "n_tokens", F.col("_p.c").alias("container_id"), F.col("_p.o").alias("container_offset"))


def p8_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    capacity = table(spark, sf_dir, "size_limits").filter("applies_to = 'documents'").first().max_size
    docs = table(spark, sf_dir, "documents")
    return pack(count_tokens(docs, vocab=DEFAULT_VOCAB), capacity)
