"""Texts decoded with a wrong character encoding (problem 4).

A noisy channel: the source is the corpus, as counts of its units (runs of letters with at least
one character outside ASCII, or such characters alone) and of the words beside short units; the
channel writes the true text in one encoding and reads it in another, and may lose bytes. For each
unit every pair of encodings is undone on a lattice of bytes, in which a replacement character
stands for any byte, however many there are; a Viterbi search over the units of a text chooses between leaving a unit as it
is and undoing a pair, with a cost for changing the pair, so a stretch is restored by one of them.

The counts cover all texts. Only units of a relative frequency above ``PHI`` are kept, so at most
``1 / PHI`` entries of a kind are sent to the workers, whatever the size of the corpus.

Cases: null, empty and pure ASCII texts are no cases; replacement characters and C1 controls always
are, restorable or not; repeated rows count once; texts are searched whole.
"""

from __future__ import annotations

import heapq
import math
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skerry.tables import table

PHI = 1 / 200_000
UNIT = re.compile(r"[A-Za-z]*[^\x00-\x7f](?:[A-Za-z]|[^\x00-\x7f])*")
PIECE = re.compile(r"[^\W\d_]+|.", re.S)
CJK = re.compile(r"[㐀-鿿豈-﫿]")
BAD = re.compile(r"[�\x80-\x84\x86-\x9f]")
RIGHT = re.compile(r"(\s?)([A-Za-z]+|\S)?")
LOST = "�"
#: Characters of the longest word. A longer unit is a run of signs without blanks, mostly garbled Chinese; it is searched
#: like any other, but it and its parts teach nothing about words.
WORD = 40
#: Readings of a byte lattice, the best by their characters, that are compared as units.
NBEST = 64

READ_AS = ("cp1252", "cp1250", "cp1251", "cp437", "cp850", "mac_roman", "cp866", "koi8_r", "gb18030")
WRITTEN = ("utf-8", "cp1252", "cp1251", "mac_roman", "cp850", "cp437", "cp866", "koi8_r", "gb18030", "big5")
#: Encodings with undefined bytes, which a reader replaces; what they lose is looked for in UTF-8.
LOSSY = ("cp1252", "cp1250", "cp1251", "gb18030")
ODD = re.compile(r"[a-zß-öø-ÿа-я][A-ZÀ-ÖØ-ÞЀ-Я]")
#: Signs as they stand about words in right text: opening ones before, closing ones after, an apostrophe within.
PLAUSIBLE = re.compile(r"[“‘«‹„]*(?:[^\W\d_]+(?:’(?:t|s|re|ve|ll|d|m)|(?<=\b[ldnscjmt])’[^\W\d_]+|(?<=qu|un|ll|om|st|[ln]t)’[^\W\d_]+)?)?[”’»›]*|[–—…§°½¼¾×²³€£¥¢±·•©®™¶†‡]|°[CF]|m[²³]", re.I)
CJK_SIGNS = frozenset("，。、；：？！“”‘’《》（）「」『』…—·")


def _table(codec: str) -> dict[str, int]:
    """Character to byte; bytes that the encoding leaves undefined stand for the control of that number."""
    out = {chr(b): b for b in range(256)} if codec != "gb18030" else {}
    for b in range(0x80, 0x100):
        try:
            out[bytes([b]).decode(codec)] = b
        except UnicodeDecodeError:
            pass
    return out


TABLES = {c: _table(c) for c in READ_AS if c != "gb18030"}


def unread(text: str, codec: str) -> list[int | None] | None:
    """Bytes that were read as ``text``; None for a lost one; None in all if the encoding can't give it."""
    out: list[int | None] = []
    if codec == "gb18030":
        for ch in text:
            if ch == LOST:
                out.append(None)
            elif ord(ch) < 0xD800 or ord(ch) > 0xDFFF:
                out.extend(ch.encode("gb18030"))
        return out
    t = TABLES[codec]
    for ch in text:
        b = None if ch == LOST else t.get(ch, -1)
        if b == -1:
            return None
        out.append(b)
    return out


class Source:
    """The corpus as counts: ``u`` units, ``c`` single characters, ``l`` and ``r`` neighbours of short units."""

    def __init__(self, rows: list[tuple[str, str, int]], floor: float):
        self.n = {k: {} for k in "uclr"}
        for kind, key, n in rows:
            self.n[kind][key] = n
        self.total = max(1, sum(self.n["u"].values()))
        self.floor = max(0.5, floor / 2)
        self.mask: dict[str, tuple[int, str]] = {}
        for u, n in self.n["u"].items():
            if LOST not in u:
                m = re.sub(r"[^\x00-\x7f]", LOST, u)
                self.mask[m] = max(self.mask.get(m, (0, "")), (n, u))
        self.cache: dict[str, tuple[float, list]] = {}
        self.unknown = math.log(self.floor / self.total) - 4
        self.bad: dict[str, bool] = {}
        self.chars = {ch for u, n in self.n["u"].items() if n >= 4 * self.floor for ch in u}
        seen: Counter = Counter()
        for kind in "uc":
            for u, n in self.n[kind].items():
                for ch in u:
                    if not ch.isascii() and not BAD.match(ch):
                        seen[ch] += n
        every = max(1, sum(seen.values()))
        self.charp = {ch: math.log(n / every) for ch, n in seen.items()}
        self.by_len: dict[int, list[tuple[float, str, bytes]]] = defaultdict(list)
        for ch, lp in self.charp.items():
            self.by_len[len(ch.encode())].append((lp, ch, ch.encode()))
        self.by_bytes: dict[int, tuple[list[str], np.ndarray]] = {}
        self.fits: dict[tuple, list[tuple[float, str]]] = {}
        self.beside: dict[str, dict[str, int]] = defaultdict(dict)
        for key, n in self.n["l"].items():
            left, u = key.split("\t", 1)
            if len(u) == 1 and not BAD.match(u):
                self.beside[left][u] = n

    def count(self, unit: str) -> float:
        n = self.n["u"]
        return n.get(unit) or (unit[1:] != unit[1:].lower() and n.get(unit.lower(), 0) / 4) or 0

    def clean(self, unit: str) -> bool:
        """Ordinary Chinese text, told by the counts of its characters."""
        c = self.n["c"]
        return sum(math.log(c.get(ch, self.floor / 8) / self.total) for ch in unit) > -9.5 * len(unit)

    def garbled(self, word: str) -> bool:
        """Whether a unit of the corpus is itself better explained as a wrong reading of another."""
        if word not in self.bad:
            n, found = self.count(word), False
            for y in READ_AS[:-1]:
                data = unread(word, y)
                for x in WRITTEN if data and None not in data else ():
                    try:
                        alt = bytes(data).decode(x) if x != y else word
                    except UnicodeDecodeError:
                        continue
                    found = found or alt != word and len(alt) > (x != "utf-8") and self.count(alt) > 8 * n
            self.bad[word] = found
        return self.bad[word]

    def known(self, alt: str, utf8: bool) -> bool:
        """Whether the corpus uses such a text; of UTF-8 only its characters must be usual."""
        if CJK.search(alt):
            return all(ch.isascii() or ch in CJK_SIGNS or ch in self.n["c"] and CJK.match(ch) for ch in alt) and (len(alt) < 2 or self.clean(alt))
        if utf8:
            return all(ch < "\u0250" or "\u2000" <= ch < "\u2200" or ch in self.n["c"] or ch in self.chars for ch in alt)
        if ODD.search(alt):
            return False
        if alt in self.n["u"]:
            return len(alt) < 3 or not self.garbled(alt)
        return PLAUSIBLE.fullmatch(alt) is not None and all(p.isascii() or (self.count(p) and not self.garbled(p) if p.isalpha() else p in self.n["c"]) for p in PIECE.findall(alt))

    def logp(self, unit: str) -> float:
        n = self.count(unit)
        if n and not CJK.search(unit):
            return math.log(n / self.total)
        score = 0.0
        for p in PIECE.findall(unit):
            if p.isascii():
                score += -2.0 - 1.5 * len(p) if p.isalpha() else -1.0
            elif CJK.search(p):
                for ch in p:
                    score += math.log(self.n["c"][ch] / self.total) if ch in self.n["c"] else self.unknown - (4 if BAD.match(ch) else 0)
            elif self.count(p):
                score += math.log(self.count(p) / self.total)
            elif len(p) == 1 and p in self.n["c"]:
                score += math.log(self.n["c"][p] / self.total) - 1
            else:
                score += self.unknown - 2.5 * (len(p) - 1) - (4 if BAD.search(p) else 0)
        return score

    def decode(self, data: list[int | None], codec: str) -> str | None:
        """The likeliest text of a byte lattice. Without lost bytes there is but one; else, of the units of the corpus that
        fit and of the texts that are best by their characters, the best as a unit."""
        if None not in data:
            try:
                return bytes(data).decode(codec)
            except UnicodeDecodeError:
                return None
        texts = [*self.fitting(data), *self.lattice(tuple(data))]
        return max(texts, key=lambda s: (self.logp(s), s)) if texts else None

    def fitting(self, data: list[int | None]) -> list[str]:
        """Units of the corpus whose bytes fit."""
        if not self.by_bytes:
            of: dict[int, list[str]] = defaultdict(list)
            for u in self.n["u"]:
                if not BAD.search(u):
                    of[len(u.encode())].append(u)
            self.by_bytes = {n: (us, np.frombuffer("".join(us).encode(), np.uint8).reshape(len(us), n)) for n, us in of.items()} or {0: ([], np.zeros((0, 0), np.uint8))}
        us, m = self.by_bytes.get(len(data), ([], np.zeros((0, len(data)), np.uint8)))
        at = [i for i, b in enumerate(data) if b is not None]
        return [us[i] for i in np.flatnonzero((m[:, at] == np.array([data[i] for i in at], np.uint8)).all(1))] if us else []

    def lattice(self, data: tuple) -> list[str]:
        """The ``NBEST`` likeliest readings of bytes as UTF-8, by a Viterbi search over their places: a character ends at a
        place and begins one to four bytes before, lost bytes are filled by the characters of the corpus."""
        best: list[list[tuple[float, str]]] = [[(0.0, "")]] + [[] for _ in data]
        for end in range(1, len(data) + 1):
            here: list[tuple[float, str]] = []
            for n in range(1, min(4, end) + 1):
                before = best[end - n]
                if before:
                    for p, ch in self.filled(data[end - n : end]):
                        here += [(q + p, t + ch) for q, t in before]
            best[end] = heapq.nlargest(NBEST, here)
        return [t for _, t in best[-1]]

    def filled(self, part: tuple) -> list[tuple[float, str]]:
        """Characters whose bytes fit, with their log probabilities."""
        if part not in self.fits:
            lead = part[0]
            if None not in part:
                try:
                    ch = bytes(part).decode("utf-8")
                except UnicodeDecodeError:
                    ch = ""
                out = [(self.charp.get(ch, self.unknown), ch)] if len(ch) == 1 else []
            elif lead is not None and not (0xC0 <= lead < 0xF8 and len(part) == (lead >= 0xC0) + 1 + (lead >= 0xE0) + (lead >= 0xF0)):
                out = []
            else:
                out = [(p, ch) for p, ch, code in self.by_len.get(len(part), ()) if len(part) > 1 and all(a is None or a == b for a, b in zip(part, code))]
            self.fits[part] = out
        return self.fits[part]

    def readings(self, unit: str) -> tuple[float, list[tuple[str, str, float]]]:
        """Own score, and ``(pair, text, score)`` of every way to undo a wrong reading."""
        if unit in self.cache:
            return self.cache[unit]
        own, out, seen = self.logp(unit), [], {}
        for y in READ_AS:
            data = unread(unit, y)
            if data is None or (y == "gb18030" and not CJK.search(unit)):
                continue
            if None in data and y not in LOSSY:
                continue
            for x in WRITTEN if None not in data else WRITTEN[:1]:
                if x == y or (x == "gb18030" and len(unit) < 4):
                    continue
                alt = self.decode(data, x)
                if not alt or alt == unit:
                    continue
                extra = 0.0
                if x == "utf-8":
                    # Valid sequences hardly come about by chance.
                    extra = 3.0
                    twice = unread(alt, y)
                    again = self.decode(twice, x) if twice and not alt.isascii() else None
                    if again and again != alt and not BAD.search(again):
                        out.append((f"{x}>{y}*2", again, self.logp(again) + 4.0))
                if BAD.search(alt) or not alt.isprintable() and any(ord(c) < 32 for c in alt) or not self.known(alt, x == "utf-8"):
                    continue
                s = self.logp(alt) + extra
                if seen.get(alt, -1e9) < s:
                    seen[alt] = s
                    out.append((f"{x}>{y}", alt, s))
        if LOST in unit:
            n, alt = self.mask.get(unit, (0, ""))
            if n:
                out.append(("lost", alt, self.logp(alt) + 2))
        best = sorted(out, key=lambda r: -r[2])
        if len(self.cache) > 300_000:
            self.cache.clear()
        if len(unit) <= WORD:  # longer ones seldom come again; they are worked out anew
            self.cache[unit] = own, best
        return own, best

    def gain(self, text: str, start: int, end: int, unit: str, own: float, alt: str, s: float) -> float:
        """How much likelier the reading is; for short units by their neighbours, where these are known."""
        g = s - own
        if len(unit) > 2 or LOST in unit:
            return min(g, 1.0) if "’" in alt and "’" not in unit and alt not in self.n["u"] and len(alt) == len(unit) else g
        left, right = context(text, start, end)
        mine = self.n["l"].get(f"{left}\t{unit}", 0) + self.n["r"].get(f"{unit}\t{right}", 0)
        its = self.n["l"].get(f"{left}\t{alt}", 0) + self.n["r"].get(f"{alt}\t{right}", 0)
        if mine or its:
            h = math.log((its + self.floor / 4) / (mine + self.floor / 4))
            if len(alt) > 2:
                return min(g, h + 3)
            return min(h, 1.0) if unit.isalpha() and alt.isalpha() else h
        return min(g - 1.5, 0.0 if unit.isalpha() else 1.0)


def context(text: str, start: int, end: int) -> tuple[str, str]:
    """The words or signs on both sides of a unit, with the blank between."""
    i = start - (start > 0 and text[start - 1].isspace())
    j = i
    while j and text[j - 1].isascii() and text[j - 1].isalpha():
        j -= 1
    left = text[j:i] or (text[i - 1] if i and not text[i - 1].isspace() else "")
    b = RIGHT.match(text, end)
    norm = lambda w: "0" if w and w.isdigit() else (w or "").lower()
    return norm(left) + text[i:start], b[1] + norm(b[2])


def repair(text: str, src: Source) -> tuple[str, str, float] | None:
    """``(restored text, pairs, gain)`` if some stretch was read wrongly."""
    sure = BAD.search(text) is not None
    units, any_gain = [], False
    for m in UNIT.finditer(text):
        u = m[0]
        if len(u) > 2 and CJK.match(u) and src.clean(u):
            units.append((m.start(), m.end(), u, 0.0, {}))
            continue
        own, alts = src.readings(u)
        cand = {}
        if u == LOST:
            near = src.beside.get(context(text, m.start(), m.end())[0])
            if near:
                cand["lost"] = (6.0, max(sorted(near), key=near.get))
        if alts and (alts[0][2] > own - 5 or LOST in u) and not cand:
            for h, alt, s in alts:
                g = src.gain(text, m.start(), m.end(), u, own, alt, s)
                if h not in cand or cand[h][0] < g:
                    cand[h] = (g, alt)
        if cand:
            any_gain = any_gain or max(g for g, _ in cand.values()) >= 1
        units.append((m.start(), m.end(), u, own, cand))
    if not any_gain:
        return (text, "", 0.0) if sure else None
    states = [""] + sorted({h for *_, c in units for h, (g, _) in c.items() if g > 0})
    score, back = {s: (0.0 if not s else -2.0) for s in states}, []
    for *_, c in units:
        best = max(score, key=lambda s: (score[s], s == ""))
        nxt, came = {}, {}
        for s in states:
            stay, move = score[s], score[best] - 2.0
            came[s] = s if stay >= move else best
            nxt[s] = max(stay, move) + (0.0 if not s else c[s][0] if s in c else -0.5)
        back.append(came)
        score = nxt
    s = max(score, key=lambda x: (score[x], x == ""))
    total, path = score[s], []
    for came in reversed(back):
        path.append(s)
        s = came[s]
    path.reverse()
    out, at, used, got = [], 0, Counter(), 0.0  # got: the best single unit; weak ones alone don't tell
    for (a, b, _, _, c), h in zip(units, path):
        if h and h in c and c[h][0] > -3:
            out += [text[at:a], c[h][1]]
            at = b
            used[h] += 1
            got = max(got, c[h][0])
    if not used or ((total < 2.5 or got <= 1.0) and not sure):
        return (text, "", 0.0) if sure else None
    return "".join(out) + text[at:], ",".join(h for h, _ in used.most_common()), total


def count_units(texts) -> Counter:
    n: Counter = Counter()
    for t in texts:
        for m in UNIT.finditer(t):
            u = m[0]
            if len(u) > 2 and CJK.search(u):
                n.update(("c", ch) for ch in u)
            elif len(u) <= WORD:
                n["u", u] += 1
                if len(u) <= 2:
                    a, b = context(t, m.start(), m.end())
                    n["l", f"{a}\t{u}"] += 1
                    n["r", f"{u}\t{b}"] += 1
                for p in PIECE.findall(u):
                    if not p.isascii() and p != u:
                        n["u", p] += 1
                    if len(p) == 1 and not p.isascii():
                        n["c", p] += 1
    return n


def source(texts: DataFrame) -> tuple[list[tuple[str, str, int]], float]:
    """Counts of a one-column frame of non-ASCII texts, kept above the relative frequency ``PHI``."""

    def run(batches):
        n: Counter = Counter()
        flush = lambda: pa.RecordBatch.from_arrays([pa.array([k for k, _ in n]), pa.array([k for _, k in n]), pa.array(list(n.values()), pa.int64())], names=["kind", "key", "n"])
        for b in batches:
            n.update(count_units(b.column(0).to_pylist()))
            if len(n) > 300_000:
                yield flush()
                n.clear()
        if n:
            yield flush()

    counts = texts.mapInArrow(run, "kind string, key string, n bigint").groupBy("kind", "key").agg(F.sum("n").alias("n"))
    from skerry.tables import cut

    counts = cut(counts)
    total = counts.filter("kind = 'u'").agg(F.sum("n")).first()[0] or 0
    floor = max(2, math.ceil(total * PHI))
    # Kinds l and r count at most the units, c at most a few per unit: each keeps at most 1 / PHI entries or so.
    return [tuple(r) for r in counts.filter(F.col("n") >= floor).collect()], floor


def suspects(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return df.select(F.col(id_col).cast("string").alias(id_col), F.col(text_col).alias("text")).filter(F.col(text_col).rlike(r"[^\x00-\x7F]"))


def repaired(df: DataFrame, id_col: str = "passage_id", text_col: str = "text", src: tuple | None = None) -> DataFrame:
    """``id_col, text, pairs, gain`` of every text with a wrongly decoded stretch; ``text`` as restored,
    ``pairs`` the encodings undone (``written>read``), empty where nothing could be restored."""
    rows = suspects(df, id_col, text_col)
    given = df.sparkSession.sparkContext.broadcast(src or source(rows.select("text")))

    def run(batches):
        s = Source(*given.value)
        for b in batches:
            got = [(i, r) for i, t in enumerate(b.column(1).to_pylist()) if (r := repair(t, s))]
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array([i for i, _ in got], pa.int32())), pa.array([r[0] for _, r in got], pa.string()), pa.array([r[1] for _, r in got], pa.string()), pa.array([r[2] for _, r in got], pa.float64())],
                names=[id_col, "text", "pairs", "gain"],
            )

    return rows.mapInArrow(run, f"`{id_col}` string, text string, pairs string, gain double")


def p4_repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repaired(table(spark, sf_dir, "passages")).withColumn("gain", F.round("gain", 4)).distinct()


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repaired(table(spark, sf_dir, "passages")).select("passage_id").distinct()
