"""Passages that share most of their content (problem 3).

Each text of enough words gets a sketch of its set of word shingles by fast similarity sketching:
in round ``i`` every shingle falls into one bin with a value between ``i`` and ``i + 1``; a bin keeps
its least value, and rounds go on only while bins are empty; from round ``SIZE`` on, round
``SIZE + b`` sends every shingle to bin ``b``, so every coordinate fills. Two sketches agree at a
coordinate with a probability equal to the Jaccard similarity, with concentration bounds, and a
sketch costs time about linear in the text. Bands of coordinates give candidates; one bit of each
coordinate travels along, so that pairs far below the threshold are dropped inside the join; what
is left is verified exactly on the shingles. A band that many classes share, such as that of a
template, is joined in blocks.

Texts with the same words form a class: only one member of it per task sends bands, only classes
are compared, and members are joined back at the end. So a text that a third of all rows share
costs one comparison. ``pairs`` names all pairs of members, as its caller asks; ``groups`` gives a
row per passage with its group and number of links, and never expands members.

Cases: null texts and texts of fewer than ``min_words`` words take no part; repeated rows count
once; a passage makes no pair with itself; an empty table gives no rows.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skerry.tables import cut, small, table

SIZE, ROWS = 128, 4  # coordinates of a sketch, coordinates of a band
#: Runs in which the bands are joined, each with its share of them: what is shuffled at once shrinks with them.
RUNS = 2
#: Classes of a band, or passages of a class, that a task compares among themselves; larger ones are cut into blocks that
#: meet each other in tasks of their own. Hot bands are told from a sample of one class in ``SAMPLE``.
HOT, SAMPLE = 4_000, 64
WORD = re.compile(r"\w+")
_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)
_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)


def step(i: int) -> np.uint64:
    """The i-th multiple of an odd 64-bit constant."""
    return np.uint64(0x9E3779B97F4A7C15 * i & 0xFFFFFFFFFFFFFFFF)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: two rounds of multiply and shift."""
    x = (x ^ (x >> np.uint64(33))) * _M1
    x = (x ^ (x >> np.uint64(33))) * _M2
    return x ^ (x >> np.uint64(33))


class WordHash(dict):
    def __missing__(self, w: str) -> int:
        h = xxhash.xxh3_64_intdigest(w)
        if len(self) >= 500_000:
            self.clear()
        self[w] = h
        return h


def shingle_hashes(words: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of ``n`` consecutive words of the same text, and their texts."""
    m = len(words) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h = np.zeros(m, np.uint64)
    for i in range(n):
        h = mix(h + step(i + 1) + words[i : i + m])
    same = doc[:m] == doc[n - 1 :]
    return h[same], doc[:m][same]


def sketch(sh: np.ndarray, doc: np.ndarray, docs: int) -> np.ndarray:
    """``docs x SIZE`` sketches; ``doc`` is sorted and every text has a shingle."""
    out = np.full(docs * SIZE, _EMPTY, np.uint64)
    for rnd in range(2 * SIZE):
        x = mix(sh + step(rnd + 1))
        bins = (x & np.uint64(SIZE - 1)).astype(np.int64) if rnd < SIZE else np.full(len(x), rnd - SIZE)
        at = doc * SIZE + bins
        free = out[at] == _EMPTY
        np.minimum.at(out, at[free], (np.uint64(rnd) << np.uint64(55)) | (x[free] >> np.uint64(9)))
        empty = (out.reshape(docs, SIZE) == _EMPTY).any(axis=1)
        if not empty.any():
            break
        keep = empty[doc]
        sh, doc = sh[keep], doc[keep]
    return out.reshape(docs, SIZE)


def _members(df: DataFrame, id_col: str, text_col: str, shingle: int, min_words: int) -> DataFrame:
    """``id, f, s0, s1, bands``: f, s0, s1 identify the sequence of words; bands only at the first of a class in its task."""

    def run(batches):
        cache, seen = WordHash(), set()
        for b in batches:
            ids, texts, lo = b.column(0), b.column(1).to_pylist(), 0
            while lo < len(texts):
                hi, size, keep, lists, fps = lo, 0, [], [], []
                while hi < len(texts) and size < 1_500_000:
                    t = texts[hi]
                    if t:
                        size += len(t)
                        w = WORD.findall(t.lower())
                        if len(w) >= max(min_words, shingle):
                            keep.append(hi)
                            lists.append(w)
                            fps.append(xxhash.xxh3_64_intdigest(" ".join(w)))
                    hi += 1
                lo = hi
                if not keep:
                    continue
                lens = np.fromiter(map(len, lists), np.int64, len(lists))
                words = np.fromiter((cache[w] for ws in lists for w in ws), np.uint64, int(lens.sum()))
                sh, doc = shingle_hashes(words, np.repeat(np.arange(len(lists)), lens), shingle)
                sk = sketch(sh, doc, len(lists))
                bits = np.packbits((sk & np.uint64(1)).astype(np.uint8), axis=1).view(np.int64)
                bands = np.zeros((len(lists), SIZE // ROWS), np.uint64)
                for i in range(ROWS):
                    bands = mix(bands + sk[:, i::ROWS] + step(i + 1))
                bands = mix(bands + np.arange(SIZE // ROWS, dtype=np.uint64)[None, :] * _M2).view(np.int64)
                fresh = []
                for f in fps:
                    fresh.append(f not in seen)
                    if len(seen) > 1_000_000:
                        seen.clear()
                    seen.add(f)
                offs = np.concatenate([[0], np.cumsum(np.where(fresh, SIZE // ROWS, 0))]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array(keep, pa.int32())), pa.array(np.array(fps, np.uint64).view(np.int64)), pa.array(bits[:, 0]), pa.array(bits[:, 1]), pa.ListArray.from_arrays(pa.array(offs), pa.array(bands[np.array(fresh)].ravel()))],
                    names=["id", "f", "s0", "s1", "bands"],
                )

    return df.select(F.col(id_col).cast("string").alias("id"), text_col).filter(F.col("id").isNotNull() & F.col(text_col).isNotNull()).mapInArrow(run, "id string, f bigint, s0 bigint, s1 bigint, bands array<bigint>")


CLASS = ("f", "s0", "s1")


def _side(df: DataFrame, s: str, *more: str) -> DataFrame:
    return df.select(*(F.col(c).alias(s + c) for c in (*CLASS, *more)))


def _blocks(rows: DataFrame, key: str, sizes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Two sides of a self-join of ``rows`` on ``key`` and ``block``. ``sizes`` (``key, blocks``) names the keys that have too
    many rows for a task: one side's rows go to a block each by a hash, the other's to all blocks of their key."""
    if sizes.isEmpty():
        one = rows.withColumn("block", F.lit(0))
        return one, one
    known = rows.join(small(sizes), key, "left")
    n = F.coalesce("blocks", F.lit(1))
    left = known.withColumn("block", F.pmod(F.xxhash64(*CLASS), n).cast("int"))
    return left.drop("blocks"), known.withColumn("block", F.explode(F.sequence(F.lit(0), n.cast("int") - 1))).drop("blocks")


def class_pairs(df: DataFrame, id_col: str, text_col: str, shingle: int, min_words: int, threshold: float) -> tuple[DataFrame, DataFrame]:
    """``(members, pairs)``: members ``id, f, s0, s1``; pairs of classes ``a*, b*, jaccard`` with different words."""
    members = cut(_members(df, id_col, text_col, shingle, min_words))
    # One bit of each coordinate agrees with probability (1 + J) / 2; four standard deviations are allowed below that,
    # which loses 3 in 100,000 of the pairs at the threshold and none above it.
    p = (1 + threshold) / 2
    differ = int(SIZE * (1 - p) + 4 * (SIZE * p * (1 - p)) ** 0.5)
    n = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    found = None
    for run in range(RUNS):
        # ``seen`` of a task holds most copies back; the rest meet here.
        mine = F.filter("bands", lambda _, i: i % RUNS == run)
        bands = members.select(F.explode(mine).alias("band"), *CLASS)
        few = bands.filter(F.pmod(F.xxhash64("f"), F.lit(SAMPLE)) == 0).groupBy("band").agg(F.count_distinct(*CLASS).alias("n"))
        hot = cut(few.filter(F.col("n") * SAMPLE > HOT / 2).select("band", F.ceil(F.col("n") * SAMPLE / HOT).cast("int").alias("blocks")))
        left, right = _blocks(bands.repartition(n, "band").distinct(), "band", hot)
        a, b = _side(left, "a", "band", "block"), _side(right, "b", "band", "block")
        alike = F.bit_count(F.col("as0").bitwiseXOR(F.col("bs0"))) + F.bit_count(F.col("as1").bitwiseXOR(F.col("bs1"))) <= differ
        got = a.join(b, (F.col("aband") == F.col("bband")) & (F.col("ablock") == F.col("bblock")) & alike & (F.struct("af", "as0", "as1") < F.struct("bf", "bs0", "bs1")))
        got = cut(got.select("af", "as0", "as1", "bf", "bs0", "bs1").distinct())
        found = got if found is None else found.unionByName(got)
    cand = cut(found.distinct())
    used = cand.select(*(F.col("a" + c).alias(c) for c in CLASS)).union(cand.select(*(F.col("b" + c).alias(c) for c in CLASS))).distinct()
    used = cut(used)
    ids = members.select("id", *CLASS).join(small(used), list(CLASS)).groupBy(*CLASS).agg(F.min("id").alias("id"))
    ids = cut(ids)
    texts = df.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("t")).filter(F.col("t").isNotNull())
    texts = texts.join(small(ids), "id").dropDuplicates([*CLASS])
    both = cand.join(_side(texts, "a", "t"), ["a" + c for c in CLASS]).join(_side(texts, "b", "t"), ["b" + c for c in CLASS])

    def verify(batches):
        sets: dict[str, set] = {}  # rows of one text follow each other

        def shingles(t: str) -> set:
            if t not in sets:
                if len(sets) >= 5_000:
                    sets.clear()
                w = WORD.findall(t.lower())
                sets[t] = set(zip(*(w[i:] for i in range(shingle))))
            return sets[t]

        for x in batches:
            js = []
            for ta, tb in zip(x.column(6).to_pylist(), x.column(7).to_pylist()):
                sa, sb = shingles(ta), shingles(tb)
                both_ = len(sa & sb)
                js.append(both_ / (len(sa) + len(sb) - both_) if sa or sb else 0.0)
            yield pa.RecordBatch.from_arrays([*x.columns[:6], pa.array(js, pa.float64())], names=[*x.schema.names[:6], "jaccard"])

    six = [s + c for s in "ab" for c in CLASS]
    pairs = both.select(*six, "at", "bt").mapInArrow(verify, ", ".join(f"{c} bigint" for c in six) + ", jaccard double").filter(F.col("jaccard") >= threshold - 1e-12)
    return members.select("id", *CLASS).distinct(), pairs


def pairs(df: DataFrame, id_col: str = "passage_id", text_col: str = "text", shingle: int = 3, min_words: int = 40, threshold: float = 0.6) -> DataFrame:
    """``id_a, id_b, jaccard`` of all pairs of different passages, the smaller id first."""
    members, found = class_pairs(df, id_col, text_col, shingle, min_words, threshold)
    a, b = _side(members, "a", "id"), _side(members, "b", "id")
    other = found.join(a, ["a" + c for c in CLASS]).join(b, ["b" + c for c in CLASS]).select("aid", "bid", "jaccard")
    sized = members.groupBy(*CLASS).agg(F.count("*").alias("n")).filter(F.col("n") > 1).select(*CLASS, F.ceil(F.col("n") / HOT).cast("int").alias("blocks"))
    copies = members.join(sized, list(CLASS))  # only classes of several passages; one side block by block, the other in all blocks
    left = copies.withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    right = copies.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    a, b = _side(left, "a", "id", "block"), _side(right, "b", "id", "block")
    same = a.join(b, [F.col("a" + c) == F.col("b" + c) for c in (*CLASS, "block")] + [F.col("aid") < F.col("bid")]).select("aid", "bid", F.lit(1.0).alias("jaccard"))
    every = other.unionByName(same)
    return every.filter("aid <> bid").select(F.least("aid", "bid").alias("id_a"), F.greatest("aid", "bid").alias("id_b"), "jaccard").distinct()


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """``node, root``: connected components by alternating large-star and small-star until nothing changes, each round cut
    from its lineage; rounds grow with the logarithm of the longest chain."""
    e = cut(edges.select(F.least(a, b).alias("u"), F.greatest(a, b).alias("v")).filter("u <> v").distinct())
    while True:
        both = e.select("u", "v").union(e.select(F.col("v"), F.col("u")))
        m = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(m, "u").select(F.col("m").alias("u"), "v").filter("u <> v").distinct()
        m2 = large.groupBy("v").agg(F.min("u").alias("m"))
        nxt = cut(large.join(m2, "v").select(F.col("m"), F.col("u"), F.col("v")).selectExpr("stack(2, m, v, m, u) AS (u, v)").filter("u <> v").distinct())
        if nxt.exceptAll(e).isEmpty() and e.exceptAll(nxt).isEmpty():
            break
        e = nxt
    return e.select(F.col("v").alias("node"), F.col("u").alias("root"))


def groups(df: DataFrame, id_col: str = "passage_id", text_col: str = "text", shingle: int = 3, min_words: int = 40, threshold: float = 0.6) -> DataFrame:
    """``id, class_id, group_id, links`` of every passage alike to another: its class of equal words, its
    group (both named by their smallest id), and the number of classes linked to its own."""
    members, found = class_pairs(df, id_col, text_col, shingle, min_words, threshold)
    cls = members.groupBy(*CLASS).agg(F.min("id").alias("class_id"), F.count("*").alias("n"))
    a, b = _side(cls, "a", "class_id"), _side(cls, "b", "class_id")
    edges = cut(found.join(a, ["a" + c for c in CLASS]).join(b, ["b" + c for c in CLASS]).select("aclass_id", "bclass_id"))
    roots = components(edges, "aclass_id", "bclass_id")
    links = edges.select(F.col("aclass_id").alias("class_id")).union(edges.select("bclass_id")).groupBy("class_id").agg(F.count("*").alias("links"))
    full = cls.join(links, "class_id", "left").join(roots, F.col("class_id") == F.col("node"), "left").filter("n > 1 OR links IS NOT NULL")
    return members.join(full.select(*CLASS, "class_id", F.coalesce("root", "class_id").alias("group_id"), F.coalesce("links", F.lit(0)).alias("links")), list(CLASS)).select("id", "class_id", "group_id", "links")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs(table(spark, sf_dir, "passages")).select(F.col("id_a").alias("passage_id_a"), F.col("id_b").alias("passage_id_b"))


def p3_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups(table(spark, sf_dir, "passages")).withColumnRenamed("id", "passage_id")
