"""Cutting oversized texts at natural boundaries (problem 2).

For a text over the limit the fewest pieces that could do are taken, their cuts set at equal
distances, and each cut moved to the strongest boundary near its target (blank line, line end
after a sentence, sentence end, other line end, clause, word), the nearest of equals. If a piece then breaks the limit, one more
piece is tried. Each piece but the first begins exactly ``overlap`` code points before the end of
the one before it.

Cases: texts within the limit, null and empty ones give no pieces; without any boundary near a
target the cut falls on the target, but not inside a combining sequence; repeated rows count once;
a null page stays null, a null offset gives null offsets.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left, bisect_right

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skerry.tables import table

#: Strength of each kind of boundary; a cut falls after the match.
KINDS = (
    (6, re.compile(r"\n[ \t]*\n\s*")),
    (5, re.compile(r"(?<=[.!?…:。！？\"”»])[ \t]*\n\s*")),
    (4, re.compile(r"[.!?…][\"'”’»)\]]*\s+|[。！？]+[”’」』]*")),
    (3, re.compile(r"\n")),
    (2, re.compile(r"[;:,]\s+|[，；：、]+|;")),
    (1, re.compile(r"\s+")),
)


def boundaries(text: str) -> tuple[list[int], dict[int, int]]:
    strong: dict[int, int] = {}
    for s, pat in KINDS:
        for m in pat.finditer(text):
            strong.setdefault(m.end(), s)
    return sorted(strong), strong


def cuts(text: str, limit: int, overlap: int) -> list[tuple[int, int]]:
    """``[(start, end)]`` of the pieces, each of at most ``limit`` code points."""
    n = len(text)
    if n <= limit:
        return [(0, n)]
    if not 0 <= overlap < limit:
        raise ValueError("the overlap must be less than the limit")
    at, strong = boundaries(text)
    k = -(-(n - overlap) // (limit - overlap))
    while True:
        step = (n - overlap) / k
        reach = max(1, int(min(step / 2, max(limit - overlap - step, step / 4))))
        out, start = [], 0
        for i in range(1, k):
            target = min(round(i * step + overlap), start + limit)
            lo, hi = max(start + overlap + 1, target - reach), min(start + limit, target + reach, n - 1)
            near = at[bisect_left(at, lo) : bisect_right(at, hi)]
            end = min(near, key=lambda x: (-strong[x], abs(x - target), x), default=None)
            if end is None:
                end = target
                while end > lo and unicodedata.combining(text[end]):
                    end -= 1
            out.append((start, end))
            start = end - overlap
            if n - start <= limit and i < k - 1 and n - start <= overlap + 1:
                break
        out.append((start, n))
        if n - start <= limit and all(a < b <= a + limit for a, b in out):
            return out
        k += 1


def split(df: DataFrame, limit: int, overlap: int, id_col: str = "passage_id", text_col: str = "text", page_col: str = "page", offset_col: str = "offset") -> DataFrame:
    """``id_col, piece int, page int, offset int, text string`` of every text longer than ``limit``.

    The length filter runs in the JVM, so only oversized rows reach Python.
    """
    big = df.select(F.col(id_col).cast("string"), F.col(page_col).cast("int"), F.col(offset_col).cast("int"), F.col(text_col)).filter(F.length(text_col) > limit).distinct()

    def run(batches):
        for b in batches:
            rows = [(k, i, p, None if o is None else o + s, t[s:e]) for k, p, o, t in zip(*(c.to_pylist() for c in b.columns)) for i, (s, e) in enumerate(cuts(t, limit, overlap))]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.string()))], names=[id_col, "piece", "page", "offset", "text"])

    return big.mapInArrow(run, f"`{id_col}` string, piece int, page int, offset int, text string")


def p2_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    lim = table(spark, sf_dir, "size_limits").filter("applies_to = 'passages'").first()
    return split(table(spark, sf_dir, "passages"), lim.max_size, lim.overlap)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p2_pieces(spark, sf_dir).filter("piece = 1").select("passage_id").distinct()
