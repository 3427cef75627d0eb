"""Encoding texts with a public byte-level BPE vocabulary (problem 7).

Pre-tokenisation doesn't use a regular expression. Every code point has a class; every class is a
transition function of a small automaton; the functions form a finite monoid whose composition
table is built once. An associative scan over the monoid ids of a whole Arrow batch gives the state
before each character, and with it the places where a pre-token starts. Slices then go through a
cache of merged pairs.

Cases: null and empty texts give an empty list; a repeated ``doc_id`` with the same text gives one
row; names of special tokens are ordinary text; texts of any length are encoded whole.
"""

from __future__ import annotations

import base64
import heapq
import sys
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from skerry.tables import distinct_rows, table

DEFAULT_VOCAB = "/opt/tokenizers/byte_bpe_50k.tiktoken"

# Character classes. A1 and A2 are an apostrophe before one or two letters of a contraction.
L, N, O, A1, A2, SP, WS = range(7)
# States: reset, after a blank, in letters, in digits, in other signs, 1 and 2 letters of a contraction to come.
RESET, BLANK, IN_L, IN_N, IN_O, C1, C2 = range(7)


def _step(state: int, cls: int) -> tuple[int, bool]:
    """Next state, and whether a pre-token starts at a character of this class (white space apart)."""
    if cls == SP:
        return BLANK, False
    if cls == WS:
        return RESET, False
    if state == C2:
        return C1, False
    if state == C1:
        return RESET, False
    if cls in (A1, A2) and state in (RESET, IN_L, IN_N):
        return (C1 if cls == A1 else C2), True
    to = {L: IN_L, N: IN_N}.get(cls, IN_O)
    return to, state not in (BLANK, to)


def _automaton() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Monoid id of each class (classes 7..13: first of its text), composition, application, starts."""
    gens, starts = [], np.zeros((7, 14), bool)
    for c in range(14):
        pairs = [_step(s if c < 7 else RESET, c % 7) for s in range(7)]
        gens.append(tuple(p[0] for p in pairs))
        starts[:, c] = [p[1] for p in pairs]
    elems = {tuple(range(7)): 0}
    todo = [tuple(range(7))]
    while todo:
        f = todo.pop()
        for g in gens:
            h = tuple(g[s] for s in f)
            if h not in elems:
                elems[h] = len(elems)
                todo.append(h)
    each = sorted(elems, key=elems.get)
    comp = np.array([[elems[tuple(g[s] for s in f)] for g in each] for f in each], np.uint16)
    return np.array([elems[g] for g in gens], np.uint16), comp, np.array(each, np.uint8), starts


GEN, COMP, APPLY, STARTS = _automaton()


def _classes() -> np.ndarray:
    import regex

    cls = np.full(sys.maxunicode + 1, O, np.uint8)
    every = "".join(map(chr, chain(range(0xD800), range(0xE000, sys.maxunicode + 1))))
    for pat, c in ((r"\p{L}+", L), (r"\p{N}+", N), (r"\p{White_Space}+", WS)):
        for m in regex.finditer(pat, every):
            a = ord(every[m.start()])
            cls[a : a + m.end() - m.start()] = c
    cls[0x20] = SP
    return cls


_CLS: np.ndarray | None = None


def _scan(ids: np.ndarray, width: int = 256) -> np.ndarray:
    """Inclusive prefix compositions of monoid ids, in blocks; the block totals are scanned in turn."""
    n, m = len(ids), len(APPLY)
    flat = COMP.ravel()
    if n <= width:
        out, acc = np.empty(n, np.uint16), 0
        for i, x in enumerate(ids.tolist()):
            acc = int(flat[acc * m + x])
            out[i] = acc
        return out
    rows = -(-n // width)
    buf = np.zeros(rows * width, np.uint16)
    buf[:n] = ids
    cols = np.ascontiguousarray(buf.reshape(rows, width).T)
    for j in range(1, width):
        cols[j] = flat[cols[j - 1].astype(np.uint32) * m + cols[j]]
    before = np.zeros(rows, np.uint32)
    before[1:] = _scan(cols[-1].copy(), width)[:-1]
    return flat[before[None, :] * m + cols].T.ravel()[:n]


def pretoken_starts(text: str, firsts: np.ndarray) -> np.ndarray:
    """Offsets in ``text`` (texts laid end to end, beginning at ``firsts``) where a pre-token starts."""
    global _CLS
    if _CLS is None:
        _CLS = _classes()
    cp = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    n = len(cp)
    cls = _CLS[cp]
    first = np.zeros(n + 3, bool)
    first[firsts[firsts < n]] = True
    apos = np.flatnonzero(cp == 39)
    if len(apos):
        ext = np.concatenate([cp, np.zeros(2, np.uint32)])
        c1, c2, same1 = ext[apos + 1], ext[apos + 2], ~first[apos + 1]
        one = same1 & np.isin(c1, [115, 116, 109, 100])
        two = same1 & ~first[apos + 2] & (((c2 == 101) & ((c1 == 114) | (c1 == 118))) | ((c1 == 108) & (c2 == 108)))
        cls[apos[one]], cls[apos[two]] = A1, A2
    first = first[:n]
    ws = cls >= SP
    cls = cls + 7 * first.astype(np.uint8)
    state = np.zeros(n, np.uint8)
    state[1:] = APPLY[_scan(GEN[cls])[:-1], RESET]
    start = STARTS[state, cls]
    gap = np.zeros(n, bool)  # the next character is of the same text and no white space
    gap[:-1] = ~ws[1:] & ~first[1:]
    prev = np.zeros(n, bool)
    prev[1:] = ws[:-1]
    start |= ws & (first | ~prev | gap)
    return np.flatnonzero(start)


def load_ranks(data: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in (x.split() for x in data.splitlines() if x)}


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Byte pair merging by lowest rank, leftmost first; a heap over linked parts, so long pieces are no worse."""
    if piece in ranks:
        return [ranks[piece]]
    n = len(piece)
    end = list(range(1, n + 1))
    prev = list(range(-1, n - 1))
    alive = [True] * n
    heap = []
    for i in range(n - 1):
        r = ranks.get(piece[i : i + 2])
        if r is not None:
            heap.append((r, i, i + 2))
    heapq.heapify(heap)
    while heap:
        _, i, e = heapq.heappop(heap)
        if not alive[i] or end[i] >= n or end[end[i]] != e:
            continue
        j = end[i]
        alive[j] = False
        end[i] = e
        if e < n:
            prev[e] = i
            r = ranks.get(piece[i : end[e]])
            if r is not None:
                heapq.heappush(heap, (r, i, end[e]))
        p = prev[i]
        if p >= 0:
            r = ranks.get(piece[p:e])
            if r is not None:
                heapq.heappush(heap, (r, p, e))
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : end[i]]])
        i = end[i]
    return out


class PieceCache(dict):
    """Ids by pre-token; emptied when full, so a worker's memory is bounded. Long pieces aren't kept."""

    def __init__(self, ranks: dict[bytes, int], most: int = 400_000):
        self.ranks, self.most = ranks, most

    def __missing__(self, piece: str) -> list[int]:
        ids = merge(piece.encode(), self.ranks)
        if len(piece) <= 40:
            if len(self) >= self.most:
                self.clear()
            self[piece] = ids
        return ids


_CACHE: dict[int, PieceCache] = {}


def _cache(data: bytes) -> PieceCache:
    key = hash(data)
    if key not in _CACHE:
        _CACHE.clear()
        _CACHE[key] = PieceCache(load_ranks(data))
    return _CACHE[key]


def encode_texts(texts: list[str | None], cache: PieceCache, most: int = 2_000_000):
    """Yields ``(ids, counts, starts)`` for runs of texts of about ``most`` characters: all ids end to
    end, ids for each text, and for each id the offset in its text of the pre-token it comes from."""
    i = 0
    while i < len(texts):
        run, size = [], 0
        while i < len(texts) and (not run or size < most):
            run.append(texts[i] or "")
            size += len(run[-1])
            i += 1
        whole = "".join(run)
        lens = np.fromiter(map(len, run), np.int64, len(run))
        firsts = np.cumsum(lens) - lens
        if not whole:
            yield np.zeros(0, np.int32), np.zeros(len(run), np.int64), np.zeros(0, np.int32)
            continue
        at = pretoken_starts(whole, firsts[lens > 0])
        cuts = at.tolist()
        lists = [cache[whole[a:b]] for a, b in zip(cuts, [*cuts[1:], len(whole)])]
        per = np.fromiter(map(len, lists), np.int64, len(lists))
        ids = np.fromiter(chain.from_iterable(lists), np.int32, int(per.sum()))
        total = np.concatenate([[0], np.cumsum(per)])
        lo = np.searchsorted(at, firsts)
        hi = np.searchsorted(at, firsts + lens)
        doc = np.repeat(np.arange(len(run)), hi - lo)
        yield ids, total[hi] - total[lo], np.repeat((at - firsts[doc]).astype(np.int32), per)


def encode(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocab: str = DEFAULT_VOCAB, offsets: bool = False) -> DataFrame:
    """One row per distinct (id, text): ``id_col, ids array<int>`` and, if asked for, ``starts array<int>``.

    Repeated rows are dropped before encoding, by their ids; all else is one narrow pass.
    """
    spark = df.sparkSession
    data = spark.sparkContext.broadcast(open(vocab, "rb").read())  # a fixed file of under 2 MB
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches):
        cache = _cache(data.value)
        for b in batches:
            keys, pos = b.column(0), 0
            for ids, counts, starts in encode_texts(b.column(1).to_pylist(), cache):
                offs = pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32))
                cols = [keys.slice(pos, len(counts)), pa.ListArray.from_arrays(offs, pa.array(ids))]
                if offsets:
                    cols.append(pa.ListArray.from_arrays(offs, pa.array(starts)))
                pos += len(counts)
                yield pa.RecordBatch.from_arrays(cols, names=[id_col, "ids", "starts"][: len(cols)])

    schema = f"`{id_col}` {kind}, ids array<int>" + (", starts array<int>" if offsets else "")
    return distinct_rows(df.select(id_col, text_col), id_col).mapInArrow(run, schema)


def count_tokens(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocab: str = DEFAULT_VOCAB) -> DataFrame:
    """``id_col, n_tokens int``; 0 for null and empty texts."""
    data = df.sparkSession.sparkContext.broadcast(open(vocab, "rb").read())
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches):
        cache = _cache(data.value)
        for b in batches:
            counts = [c for _, c, _ in encode_texts(b.column(1).to_pylist(), cache)]
            n = np.concatenate(counts) if counts else np.zeros(0)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n.astype(np.int32))], names=[id_col, "n_tokens"])

    return df.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, n_tokens int")


def decode(ids, ranks: dict[bytes, int]) -> str:
    back = {v: k for k, v in ranks.items()}
    return b"".join(back[i] for i in ids).decode()


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents"))
