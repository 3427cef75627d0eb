"""Keyword-stuffed and link-list pages (problem 9).

From the corpus come, per document once, the counts of words and of pairs of neighbouring words; a
hashtag is a unit like a word, the same one whatever it says. Each pair has a normalised pointwise
mutual information and is common or seldom met in other documents. Sentences, tables, logs and code
are made of pairs that go together wherever they occur; keyword salad is not, and a stuffed page
repeats a few collocations far too often, be they of words, of the parts of links or of tags. A
document is cut into lines (long ones into stretches), each is judged together with its neighbours,
and the document is flagged if the judged stretches hold more than half of its characters.

Only words above a relative document frequency are kept (``WORD_DF``), and pairs above ``PAIR_DF``:
so at most (mean distinct words or pairs of a document) / threshold entries go to the workers. Repetition
within a document is counted over all its words; coherence is judged for pairs of kept words only, as it
can't tell a made-up name from salad.

Texts are taken apart once, by blanks: what a part between blanks consists of is looked up, and worked
out only for parts not met before. Words become hashes of 31 bits, of which two of a million words share
one with a probability of 0.05 % each; a document is kept as these numbers and the sizes of its
stretches, and all later passes read them instead of the text.

Cases: null, empty and blank texts and texts without enough pairs are not flagged; repeated rows
count once; texts are read whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skerry.tables import cut, table

WORD_DF, PAIR_DF = 0.0015, 0.0003
#: Characters of a stretch; pairs in fewer documents are seldom met; coherence of a stuffed stretch at most; share of a repeated pair, and of one that other documents have too.
#: The four commonest pairs of a text of a few collocations make up that share of its pairs.
STRETCH, LOW, LIMIT, REPEAT, OFTEN, FEW = 160, 0.003, 0.8, 0.15, 0.25, 0.42
#: A hashtag, a word, or digits or Chinese characters, which part their neighbours (Chinese words aren't set apart).
TOKEN = re.compile(r"#(?=\d*[^\W\d])\w+|[^\W\d_㐀-鿿]{2,}|[㐀-鿿]+|\d+")
TAG = "##"  # the unit of all hashtags
#: A link: its digits are parts of a name, not figures.
LINK = re.compile(r"://|www\.|[\w-]\.[\w-]+/", re.I)
#: Characters of a part between blanks that is remembered, and remembered parts; none changes a result.
LONG, PARTS = 40, 1_000_000


def number(word: str) -> int:
    return xxhash.xxh32_intdigest(word) & 0x7FFFFFFF


class Units(dict):
    """The numbers of the units of a part between blanks, as the bytes of 32-bit integers: hashes of words, -2 for
    a digit, -1 for a Chinese character or a digit of a link."""

    def __missing__(self, part: str) -> bytes:
        out: list[int] = []
        figure = -1 if ("/" in part or "www." in part) and LINK.search(part) else -2
        for w in TOKEN.findall(part.lower()):
            ch = w[0]
            if ch.isdigit():
                out += [figure] * len(w)
            elif "㐀" <= ch <= "鿿":
                out += [-1] * len(w)
            else:
                out.append(number(TAG if ch == "#" else w))
        got = np.array(out, np.int32).tobytes()
        if len(part) <= LONG:
            if len(self) >= PARTS:
                self.clear()
            self[part] = got
        return got

    def numbers(self, text: str) -> bytes:
        return b"".join(map(self.__getitem__, text.split()))


def _ints(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The 32-bit integers of a column of bytes, and how many each row has."""
    offs = np.frombuffer(col.buffers()[1], np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64) if len(col) else np.zeros(1, np.int64)
    data = col.buffers()[2] if len(col) else None
    flat = np.frombuffer(data, np.uint8)[offs[0] : offs[-1]].view(np.int32) if data is not None else np.zeros(0, np.int32)
    return flat.astype(np.int64), np.diff(offs) // 4


def _slices(size: np.ndarray, most: int = 1_000_000) -> Iterator[tuple[int, int]]:
    """Runs of rows of at most about ``most`` units."""
    at = np.concatenate([[0], np.cumsum(size)])
    lo = 0
    while lo < len(size):
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + most)) - 1)
        yield lo, hi
        lo = hi


class Counts:
    def __init__(self, docs: int, vocab: list[tuple], pairs: list[tuple]):
        """``vocab``: hash, left and right count of pairs, by hash; ``pairs``: key of two places in it, count."""
        self.docs = max(1, docs)
        self.vocab = np.array([x[0] for x in vocab] or [-9], np.int64)
        self.left = np.array([x[1] for x in vocab] or [1], float)
        self.right = np.array([x[2] for x in vocab] or [1], float)
        keys = np.array([k for k, _ in pairs], np.int64)
        order = np.argsort(keys)
        self.keys, self.n = keys[order], np.array([n for _, n in pairs], float)[order]
        self.total = max(1.0, float(self.left.sum()))
        self.base = len(vocab) + 1

    def kept(self, x: np.ndarray) -> np.ndarray:
        """Places of hashes in the vocabulary; -1 for what it doesn't have."""
        at = np.minimum(np.searchsorted(self.vocab, x), len(self.vocab) - 1)
        return np.where((x >= 0) & (self.vocab[at] == x), at, -1)

    def pairs(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Keys of neighbouring kept words, and the place of the first word of each."""
        kept = x >= 0
        ok = np.flatnonzero(kept[:-1] & kept[1:])
        return x[ok] * self.base + x[ok + 1], ok

    def judge(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Coherence of each pair, and whether other documents seldom have it. Coherence adds to the
        normalised mutual information the share of the rarer word's pairs that are this one, both in
        other documents."""
        at = np.minimum(np.searchsorted(self.keys, keys), max(0, len(self.keys) - 1))
        n = np.where(self.keys[at] == keys, self.n[at], 0.0) - 1 if len(self.keys) else np.zeros(len(keys))
        c = np.maximum(n, 0.3)
        a, b = keys // self.base, keys % self.base
        la, rb = np.maximum(self.left[a], 1), np.maximum(self.right[b], 1)
        npmi = np.log(c * self.total / (la * rb)) / np.maximum(-np.log(c / self.total), 1e-6)
        return npmi + np.maximum(n, 0) / np.minimum(la, rb), n < LOW * self.docs


def stretches(text: str) -> list[tuple[int, int]]:
    """Lines, and parts of about ``STRETCH`` characters of long ones."""
    spans, at = [], 0
    for line in text.split("\n"):
        end = at + len(line)
        while end - at > 2 * STRETCH:
            mid = text.find(" ", at + STRETCH, end)
            if mid < 0:
                break
            spans.append((at, mid))
            at = mid + 1
        spans.append((at, end))
        at = end + 1
    return spans


def shares(units: np.ndarray, of_text: np.ndarray, per: np.ndarray, chars: np.ndarray, lines: np.ndarray, c: Counts) -> np.ndarray:
    """Share of the characters of each text that lie in stuffed stretches; all texts are judged in one go.
    ``units``: numbers of all texts, ``of_text``: how many each text has; ``per``, ``chars``: units and characters of
    all stretches, ``lines``: how many stretches each text has."""
    texts = len(lines)
    owner = np.repeat(np.arange(texts), lines)
    # Two empty stretches and a sign that makes no pairs after each text keep neighbours apart.
    m = len(per) + 2 * texts
    place = np.arange(len(per)) + 2 * owner
    of = np.repeat(place, per)
    ends = np.cumsum(of_text)
    every = np.insert(units, ends, -1)
    of = np.insert(of, ends, np.cumsum(lines) + 2 * np.arange(texts))
    sizes = np.zeros(m)
    sizes[place] = chars
    owner = np.repeat(np.arange(texts), lines + 2)
    x = c.kept(every)
    keys, first = c.pairs(x)
    coherence, seldom = c.judge(keys)
    line = of[first]
    n = np.bincount(line, minlength=m).astype(float)
    s = np.bincount(line, coherence, minlength=m)
    size = np.bincount(of[every != -2], minlength=m)
    digits = np.bincount(of[every == -2], minlength=m)
    tag = number(TAG)
    # Collocations repeated too often in a text, whether or not their words are kept.
    begins = np.flatnonzero((every[:-1] >= 0) & (every[1:] >= 0))
    rare = np.ones(len(every), bool)  # other documents seldom have the pair that begins here
    rare[first] = seldom
    rare[:-1] |= (every[:-1] == tag) & (every[1:] == tag)  # tags in a row are a list of them, however common these are
    where = of[begins]
    doc = owner[where]
    total = np.bincount(doc, minlength=texts)
    wide = int(every.max(initial=0)) + 1
    pair, same = np.unique(every[begins] * wide + every[begins + 1], return_inverse=True)
    both = doc * len(pair) + same
    _, at, inv, times = np.unique(both, return_index=True, return_inverse=True, return_counts=True)
    whose = doc[at]
    heavy = (times >= 6) & (times >= REPEAT * total[whose]) & (rare[begins[at]] | (times >= OFTEN * total[whose]))
    order = np.lexsort((-times, whose))
    rank = np.arange(len(order)) - np.searchsorted(whose[order], whose[order])
    most = order[rank < 4]
    few = np.bincount(whose[most], times[most], minlength=texts) >= FEW * np.maximum(total, 1)
    heavy[most[few[whose[most]]]] = True
    heavy &= (times >= 6) & (total[whose] >= 20)
    r = np.bincount(where, heavy[inv], minlength=m)
    pairs = np.bincount(where, minlength=m)
    # Neighbouring lines count too, less with distance, so that a short line isn't judged by a word or two.
    nn, ss = (np.convolve(v, (0.25, 0.5, 1, 0.5, 0.25))[2:-2] for v in (n, s))
    bad = (nn >= 3) & (n > 0) & (n >= 0.2 * size) & (ss < LIMIT * nn)
    # Lines that differ by their numbers, as in logs, aren't one phrase over and over.
    bad |= (r >= 0.12 * pairs) & (r > 0) & (digits < 0.5 * size)
    # A stretch without pairs between two stuffed ones belongs to them.
    for i in np.flatnonzero((n[1:-1] == 0) & bad[2:]) + 1:
        bad[i] |= bad[i - 1]
    return np.bincount(owner, sizes * bad, minlength=texts) / np.maximum(np.bincount(owner, sizes, minlength=texts), 1)


def parsed(rows: DataFrame, id_col: str) -> DataFrame:
    """A row for each text: ``id_col``, its ``units`` and, by stretch, numbers of units (``per``) and characters
    (``chars``), as bytes of 32-bit integers; and rows of ``w, n``: in how many texts of a part of the table a word is."""
    kind = rows.schema[id_col].dataType.simpleString()
    names = [id_col, "units", "per", "chars", "w", "n"]

    def run(batches):
        units, kept, size, kind = Units(), [], 0, None

        def counted():
            w, n = np.unique(np.concatenate([*kept, np.zeros(0, np.int64)]), return_counts=True)
            none = [pa.nulls(len(w), t) for t in (kind, pa.binary(), pa.binary(), pa.binary())]
            return pa.RecordBatch.from_arrays([*none, pa.array(w.astype(np.int32)), pa.array(n.astype(np.int64))], names=names)

        for b in batches:
            kind = b.schema.field(0).type
            ids, texts = b.column(0), b.column(1).to_pylist()
            for lo, hi in _slices(np.fromiter(map(len, texts), np.int64, len(texts)), 4_000_000):
                flat, per, chars = [], [], []
                for text in texts[lo:hi]:
                    mine = stretches(text)
                    each = [units.numbers(text[x:y]) for x, y in mine]
                    flat.append(b"".join(each))
                    per.append(np.fromiter(map(len, each), np.int32, len(each)) // 4)
                    chars.append(np.array([y - x for x, y in mine], np.int32))
                x = np.frombuffer(b"".join(flat), np.int32).astype(np.int64)
                doc = np.repeat(np.arange(hi - lo), np.fromiter(map(len, flat), np.int64, hi - lo) // 4)
                kept.append(np.unique(doc[x >= 0] << 31 | x[x >= 0]) & 0x7FFFFFFF)  # each word of a text once
                size += len(kept[-1])
                none = [pa.nulls(hi - lo, t) for t in (pa.int32(), pa.int64())]
                columns = [pa.array(flat, pa.binary()), *(pa.array([v.tobytes() for v in c], pa.binary()) for c in (per, chars))]
                yield pa.RecordBatch.from_arrays([ids.slice(lo, hi - lo), *columns, *none], names=names)
                if size > 8_000_000:
                    yield counted()
                    kept, size = [], 0
        if kept:
            yield counted()

    return rows.select(id_col, "text").mapInArrow(run, f"`{id_col}` {kind}, units binary, per binary, chars binary, w int, n bigint")


def corpus_counts(texts: DataFrame) -> tuple[int, list, list]:
    """``(documents, vocabulary, pairs)`` of the rows of ``parsed``."""
    docs = texts.filter("units IS NOT NULL").count()
    floor = max(3, int(np.ceil(WORD_DF * docs)))
    words = texts.filter("w IS NOT NULL").groupBy("w").agg(F.sum("n").alias("n")).filter(F.col("n") >= floor)
    vocab = sorted(r.w for r in words.select("w").collect())
    given = texts.sparkSession.sparkContext.broadcast(vocab)

    def pair_docs(batches):
        c, kept, size = Counts(docs, [(w, 0, 0) for w in given.value], []), [], 0

        def counted():
            k, n = np.unique(np.concatenate([*kept, np.zeros(0, np.int64)]), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(k), pa.array(n.astype(np.int64))], names=["k", "n"])

        for b in batches:
            flat, each = _ints(b.column(0))
            at = np.concatenate([[0], np.cumsum(each)])
            for lo, hi in _slices(each):
                x, doc = c.kept(flat[at[lo] : at[hi]]), np.repeat(np.arange(hi - lo), each[lo:hi])
                keys, first = c.pairs(x)
                same = doc[first] == doc[first + 1]
                kept.append(np.unique(doc[first][same] * c.base**2 + keys[same]) % c.base**2)  # each pair of a text once
                size += len(kept[-1])
                if size > 8_000_000:
                    yield counted()
                    kept, size = [], 0
        yield counted()

    pairs = cut(texts.filter("units IS NOT NULL").select("units").mapInArrow(pair_docs, "k bigint, n bigint").groupBy("k").agg(F.sum("n").alias("n")))
    base = len(vocab) + 1
    left = dict(pairs.groupBy(F.expr(f"k div {base}").alias("w")).agg(F.sum("n")).collect())  # at most the vocabulary
    right = dict(pairs.groupBy((F.col("k") % base).alias("w")).agg(F.sum("n")).collect())
    kept = pairs.filter(F.col("n") >= max(2, int(np.ceil(PAIR_DF * docs)))).toPandas()
    return docs, [(w, left.get(i, 0), right.get(i, 0)) for i, w in enumerate(vocab)], list(zip(kept.k.tolist(), kept.n.tolist()))


def stuffed(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, share`` of every document: the share of its characters in stuffed stretches."""
    kind = df.schema[id_col].dataType.simpleString()
    rows = df.select(id_col, F.col(text_col).alias("text")).filter("text IS NOT NULL AND length(text) > 0")
    taken = cut(parsed(rows, id_col))
    given = df.sparkSession.sparkContext.broadcast(corpus_counts(taken))

    def run(batches):
        c = Counts(*given.value)
        for b in batches:
            (units, n), (per, lines), (chars, _) = (_ints(b.column(i)) for i in (1, 2, 3))
            at, line = np.concatenate([[0], np.cumsum(n)]), np.concatenate([[0], np.cumsum(lines)])
            got = [
                shares(units[at[lo] : at[hi]], n[lo:hi], per[line[lo] : line[hi]], chars[line[lo] : line[hi]], lines[lo:hi], c)
                for lo, hi in _slices(n)
            ]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.concatenate([*got, np.zeros(0)]), pa.float64())], names=[id_col, "share"])

    return taken.filter("units IS NOT NULL").select(id_col, "units", "per", "chars").mapInArrow(run, f"`{id_col}` {kind}, share double")


def p9_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stuffed(table(spark, sf_dir, "documents")).withColumn("share", F.round("share", 4)).distinct()


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stuffed(table(spark, sf_dir, "documents")).filter("share > 0.5").select("doc_id").distinct()
