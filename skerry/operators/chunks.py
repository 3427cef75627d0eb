"""Cutting pages into overlapping windows of words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skerry.functions import text as T
from skerry.tables import cut, small

ELEMENT = rf"[{T.SPACE}]*+[^{T.SPACE}]++"


def _windows(el: Column, n: Column, size: int, step: int) -> Column:
    """All windows of a page, as an array of ``text, offset``: one pass over its elements, each a word with the blanks before it."""
    gap = lambda e: F.regexp_replace(e, rf"^[{T.SPACE}]+", "")
    none = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
    chars = lambda o: F.length(F.array_join(F.slice(el, o * step + 1, F.lit(step)), ""))
    starts = F.aggregate(F.sequence(F.lit(0), n - 1), none, lambda acc, o: F.struct((acc["at"] + chars(o)).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")), lambda acc: acc["out"])
    first = lambda o: F.get(el, o * step)
    text = lambda o: F.regexp_replace(gap(F.array_join(F.slice(el, o * step + 1, F.lit(size)), "")), rf"[{T.SPACE}]++", " ")
    return F.transform(starts, lambda at, o: F.struct(o.alias("o"), text(o).alias("text"), (at + F.length(first(o)) - F.length(gap(first(o)))).cast("int").alias("offset")))


def chunk(pages: DataFrame, size: int = 512, overlap: int = 64) -> DataFrame:
    """``passage_id, doc_id, path, ordinal, page, offset, text`` of ``doc_id, page, text``.

    Windows never cross pages; ordinals run over the pages of a document; pages that are blank or don't
    read as text give none; pages of equal number go by a hash of their text. Offsets count code points of
    the cleaned page. All of it is built-in functions. Texts aren't shuffled: only documents of several
    pages need to know how many windows come before a page, and for these the numbers of windows are.
    """
    size, step = max(1, size), max(1, max(1, size) - overlap)
    # Bound in an array, the cleaned text is made once for all tests of it.
    kept = F.get(F.filter(F.array(T.clean_text(F.col("text"))), T.textual), F.lit(0))
    words = F.coalesce(F.size("el"), F.lit(0))
    n = F.when(words <= 0, 0).when(words <= size, 1).otherwise(1 + F.ceil((words - size) / step)).cast("int")
    p = pages.select("doc_id", "page", F.xxhash64("text").alias("h"), F.regexp_extract_all(kept, F.lit(ELEMENT), F.lit(0)).alias("el")).withColumn("n", n)
    several = pages.groupBy("doc_id").agg(F.count("*").alias("k")).filter("k > 1").select("doc_id")
    if several.isEmpty():
        p = p.withColumn("base", F.lit(0))
    else:
        counts = p.join(small(cut(several)), "doc_id", "left_semi").select("doc_id", "page", "h", "n")
        w = Window.partitionBy("doc_id").orderBy(F.col("page").asc_nulls_first(), "h").rowsBetween(Window.unboundedPreceding, -1)
        base = cut(counts.withColumn("base", F.coalesce(F.sum("n").over(w), F.lit(0)).cast("int")).filter("base > 0").groupBy("doc_id", "page", "h").agg(F.min("base").alias("base")))
        b = base.select(F.col("doc_id").alias("d"), F.col("page").alias("pg"), F.col("h").alias("hh"), "base")
        p = p.join(small(b), (F.col("doc_id") == F.col("d")) & F.col("page").eqNullSafe(F.col("pg")) & (F.col("h") == F.col("hh")), "left").withColumn("base", F.coalesce("base", F.lit(0)))
    # Pages without windows are left out by the explosion: a filter would be pushed down and take texts apart once more.
    p = p.select("doc_id", "page", "base", F.explode(F.when(F.col("n") > 0, _windows(F.col("el"), F.col("n"), size, step))).alias("w"))
    p = p.withColumn("ordinal", (F.col("base") + F.col("w.o")).cast("int"))
    return p.select(F.concat(F.col("doc_id").cast("string"), F.lit("#"), F.col("ordinal").cast("string")).alias("passage_id"), "doc_id", F.col("doc_id").cast("string").alias("path"), "ordinal", "page", "w.offset", "w.text")


def whole(passages: DataFrame, size: int = 512, overlap: int = 64) -> DataFrame:
    """``path, text``: what ``chunk`` cut with this size and overlap, put together; words two windows share count once."""
    size = max(1, size)
    shared = size - max(1, size - overlap)
    rows = passages.groupBy("path", "page", "ordinal").agg(F.coalesce(F.min("text"), F.lit("")).alias("text"))
    nth = F.row_number().over(Window.partitionBy("path", "page").orderBy("ordinal"))
    rest = F.array_join(F.slice(F.split("text", " "), shared + 1, F.greatest(F.size(F.split("text", " ")), F.lit(1))), " ")
    parts = rows.withColumn("nth", nth).select("path", F.struct("ordinal", F.when(F.col("nth") == 1, F.col("text")).otherwise(rest).alias("text")).alias("part"))
    return parts.groupBy("path").agg(F.array_sort(F.collect_list("part")).alias("parts")).select("path", F.array_join(F.col("parts.text"), " ").alias("text"))


def stubs(files: DataFrame) -> DataFrame:
    """The one passage of a file that is known by name only."""
    return files.select(F.concat("path", F.lit("#0")).alias("passage_id"), F.col("path").alias("doc_id"), "path", F.lit(0).alias("ordinal"), F.lit(None).cast("int").alias("page"), F.lit(0).alias("offset"), T.spaced(F.col("path")).alias("text"))
