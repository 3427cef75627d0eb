"""Noise in text from scanned pages (problem 1).

The corpus gives a lexicon of words by frequency, counts of neighbouring words and the ways sentences
begin. A symmetric-delete index over the lexicon finds candidates for a token, and so does undoing the
listed confusions and stray signs in it, once and twice, which reaches all that the limit on the distance
allows at any length; a weighted edit distance, cheap for characters that readers confuse and for stray
signs, ranks them; the neighbours decide between a rare word and a misread common one. Words parted at line ends are joined when the
whole is a word and the parts aren't. A line at the top or bottom of a page is a running header or
footer if the same letters stand there on another page of the file; page numbers are told by form.

Headers, footers and misread words may be of any length.

The lexicon covers all texts and keeps the words above the relative frequency ``PHI``, so at most
``1 / PHI`` of them; the same goes for pairs. Headers are matched by joins on keys of their letters,
never by collecting a file.

Cases: null, empty and blank texts give no rows, a null page is kept apart from numbered ones in
``pages`` and is no case in ``found``; repeated rows count once; texts are repaired whole.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter, defaultdict
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skerry.tables import cut, distinct_rows, small, table

PHI, PAIR_PHI = 1 / 400_000, 1 / 1_000_000
HYPHENS = "-‐‑¬=­"
STRAY = "§~^¦*•|°_\\<>#"
EDGE = "\"'“”‘’„«»‹›()[]{},;:!?.…—–/"
CJK = re.compile(r"[㐀-鿿]")
SPLIT = re.compile(rf"([^\W\d_]+)([{re.escape(HYPHENS)}])(\s*\n\s*|\s)([^\W\d_]+)")
PARTED = re.compile(rf"[{re.escape(HYPHENS)}]\s")
INNER = re.compile(rf"(?<=[^\W_])[{re.escape(STRAY)}](?=[^\W_])")
SPACED = re.compile(r"(?<![\w'’])(?:[^\W\d_] ){2,}[^\W\d_](?![\w'’])")
NUM = r"(?:[0-9lIOoSB]{1,4}|[ivxlc]{1,7})"
PAGE_NO = re.compile(
    rf"(?:(?:p|pp|pag|pág|page|seite|pagina|página|blatt|стр|с|s)\.? ?)?[-–—\[(|]* ?{NUM}(?: ?(?:/|of|von|de|di|van|из|sur) ?{NUM})? ?[-–—\])|]*", re.I
)
#: As PAGE_NO, but with something about the number that tells it from any number.
MARKED_NO = re.compile(rf"(?:(?:p|pag|pág|page|seite|pagina|página|стр)\.? [0-9lIOo]{{1,4}}(?: (?:of|von|de|di|van|из|sur) [0-9lIOo]{{1,4}})?|[-–—] {NUM} [-–—]|\[{NUM}\]|[0-9lIO]{{1,4}}/[0-9lIO]{{1,4}}|{NUM} \|)(?= |$)", re.I)

HEADING = re.compile(r"\d+\.(?:\d+\.?)* ")

#: Characters and groups that readers take for each other: (read, meant).
CONFUSED = [
    ("c", "e"), ("0", "o"), ("1", "l"), ("l", "1"), ("1", "i"), ("5", "s"), ("8", "b"), ("9", "g"), ("6", "b"), ("b", "h"), ("h", "b"), ("f", "t"), ("t", "f"), ("ſ", "s"), ("í", "i"), ("á", "a"),
    ("rn", "m"), ("m", "rn"), ("vv", "w"), ("w", "vv"), ("ii", "u"), ("u", "ii"), ("cl", "d"), ("d", "cl"), ("ri", "n"), ("n", "ri"), ("iii", "m"), ("ﬁ", "fi"), ("ﬂ", "fl"), ("fi", "ﬁ"), ("li", "h"), ("h", "li"), ("nn", "m"), ("l", "i"), ("i", "l"), ("e", "c"),
    ("n", "н"), ("a", "а"), ("o", "о"), ("e", "е"), ("c", "с"), ("p", "р"), ("x", "х"), ("y", "у"), ("п", "н"), ("н", "п"), ("щ", "ш"), ("ш", "щ"), ("б", "6"), ("6", "б"), ("0", "о"), ("3", "з"), ("и", "н"), ("н", "и"), ("ь", "ъ"), ("l", "t"), ("g", "9"), ("u", "n"), ("n", "u"), ("v", "y"), ("ó", "o"), ("é", "e"), ("ú", "u"),
]
COST = {x: 0.4 for x in CONFUSED}
BY_READ: dict[str, list[str]] = defaultdict(list)
for _r, _m in CONFUSED:
    BY_READ[_r].append(_m)
_PLAIN = str.maketrans("íáàâãéèêóòôõúùûüöäçñſ01589", "iaaaaeeeoooouuuuoacnsolsbg")


def skeleton(s: str) -> str:
    """Letters of a line, with what readers confuse made equal and numbers left out."""
    s = re.sub(r"(?<![^\W_])\d[\d.,/]*(?![^\W\d_])", "", s.lower()).translate(_PLAIN)
    s = "".join(ch for ch in s if ch.isalpha())
    for a, b in (("rn", "m"), ("vv", "w"), ("ii", "u"), ("cl", "d"), ("c", "e"), ("t", "f"), ("b", "h"), ("l", "i")):
        s = s.replace(a, b)
    return s


class Deletes:
    """Symmetric-delete index as two sorted arrays: hashes of all words, whole and with one character left out, and the
    words they come from. Hashes are polynomials of the characters, so those of all words of a length are made at once."""

    B = np.uint64(0x9E3779B97F4A7C15)

    def __init__(self, words: list[str]):
        self.words, self.longest = words, max(map(len, words), default=0)
        keys, ids = [], []
        by_len: dict[int, list[int]] = defaultdict(list)
        for i, w in enumerate(words):
            by_len[len(w)].append(i)
        for n, group in by_len.items():
            x = np.array([list(map(ord, words[i])) for i in group], np.uint64).reshape(len(group), n)
            own = np.array(group, np.int32)
            for drop in (None, *range(n)):
                keys.append(self.hashed(x if drop is None else np.delete(x, drop, 1)))
                ids.append(own)
        k, i = (np.concatenate(v) if v else np.zeros(0, t) for v, t in ((keys, np.uint64), (ids, np.int32)))
        order = np.argsort(k, kind="stable")
        self.keys, self.ids = k[order], i[order]

    def hashed(self, x: np.ndarray) -> np.ndarray:
        h = np.full(len(x), x.shape[1] + 1, np.uint64)
        for j in range(x.shape[1]):
            h = h * self.B + x[:, j]
        return h

    def near(self, w: str) -> list[str]:
        """Words that ``w`` gives, or one of them with a character left out, when up to two characters of ``w`` are left out."""
        n = len(w)
        if n > self.longest + 2:
            return []  # what is left is longer than any word
        pre, pw = [0], [1]
        for ch in w:
            pre.append((pre[-1] * int(self.B) + ord(ch)) & 0xFFFFFFFFFFFFFFFF)
            pw.append(pw[-1] * int(self.B) & 0xFFFFFFFFFFFFFFFF)
        pre, pw = np.array(pre, np.uint64), np.array(pw, np.uint64)
        # A polynomial without some of its terms is put together from those of the stretches between them.
        h = [np.uint64(n + 1) * pw[n : n + 1] + pre[n:]]
        if n > 1:
            i = np.arange(n)
            h.append(np.uint64(n) * pw[n - 1 : n] + pre[i] * pw[n - 1 - i] + pre[n:] - pre[i + 1] * pw[n - 1 - i])
        if n > 2:
            i, j = _two(n)
            h.append(np.uint64(n - 1) * pw[n - 2 : n - 1] + pre[i] * pw[n - 2 - i] + (pre[j] - pre[i + 1] * pw[j - i - 1]) * pw[n - 1 - j] + pre[n:] - pre[j + 1] * pw[n - 1 - j])
        h = np.concatenate(h)
        lo = np.searchsorted(self.keys, h, "left")
        hit = lo < len(self.keys)
        hit[hit] = self.keys[lo[hit]] == h[hit]
        if not hit.any():
            return []
        out: set[int] = set()
        for a, k in zip(lo[hit].tolist(), h[hit]):
            b = a + 1
            while b < len(self.keys) and self.keys[b] == k:
                b += 1
            out.update(self.ids[a:b].tolist())
        return [self.words[i] for i in sorted(out)]


@lru_cache(32)
def _two(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of two characters of a word of ``n``."""
    return np.triu_indices(n, 1)


def undone(w: str, most: int, longest: int) -> dict[str, float]:
    """What ``w`` may have been misread from, with its cost as in ``distance``: one or, if ``most`` is 2, two
    confusions or stray signs undone that don't overlap. None has over ``longest`` characters to match."""
    if len(w) > longest + 2 * most:  # one undone takes two characters away at most
        return {}
    at = [(i, i + 1, "") for i, ch in enumerate(w) if ch in STRAY or ch == "."]
    at += [(i, i + k, b) for i in range(len(w)) for k in (1, 2, 3) if i + k <= len(w) for b in BY_READ.get(w[i : i + k], ())]
    at.sort()
    out: dict[str, float] = {}
    for i, (a, b, x) in enumerate(at if most > 1 else ()):
        head = w[:a] + x
        for c, d, y in at[i + 1 :]:
            if c >= b:
                out[head + w[b:c] + y + w[d:]] = 0.8
    for a, b, x in at:
        out[w[:a] + x + w[b:]] = 0.4
    return out


def distance(read: str, meant: str, limit: float = 1.0) -> float:
    """Least cost of getting from what was meant to what was read by confusions and stray signs; other edits cost 2."""
    n, m = len(read), len(meant)
    inf = 9.0
    d = [[inf] * (m + 1) for _ in range(n + 1)]
    d[0][0] = 0.0
    for i in range(n + 1):
        for j in range(m + 1):
            here = d[i][j]
            if here > limit:
                continue
            if i < n and j < m:
                c = 0.0 if read[i] == meant[j] else 2.0
                if here + c < d[i + 1][j + 1]:
                    d[i + 1][j + 1] = here + c
            if i < n:
                c = 0.4 if read[i] in STRAY or read[i] == "." else 2.0
                if here + c < d[i + 1][j]:
                    d[i + 1][j] = here + c
                for k in (1, 2, 3):
                    for b in BY_READ.get(read[i : i + k], ()) if i + k <= n else ():
                        if meant.startswith(b, j) and here + 0.4 < d[i + k][j + len(b)]:
                            d[i + k][j + len(b)] = here + 0.4
            if j < m and here + 2.0 < d[i][j + 1]:
                d[i][j + 1] = here + 2.0
    return d[n][m]


class Lexicon:
    def __init__(self, words: list[tuple[str, int]], pairs: tuple[np.ndarray, np.ndarray], starts: list[str], seldom: np.ndarray | None = None):
        self.n = dict(words)
        self.ids = {w: i for i, (w, _) in enumerate(words)}
        self.base = len(words) + 1
        self.keys, self.counts = pairs
        self.starts = set(starts)
        self.seldom = np.zeros(0, np.int64) if seldom is None else seldom
        self.meant = {w for w, _ in words if len(w) >= 2 and w.replace("'", "").replace("’", "").isalpha() and not CJK.search(w)}
        self.index = Deletes(sorted(self.meant))
        self.longest = max(map(len, self.meant), default=0)
        self.found: dict[str, list[tuple[str, float]]] = {}
        self.fine: dict[str, bool] = {}

    def pair(self, a: str, b: str) -> int:
        i, j = self.ids.get(a, -1), self.ids.get(b, -1)
        if i < 0 or j < 0 or not len(self.keys):
            return 0
        k = i * self.base + j
        p = int(np.searchsorted(self.keys, k))
        return int(self.counts[p]) if p < len(self.keys) and self.keys[p] == k else 0

    def begins(self, a: str, b: str) -> bool:
        """Whether a sentence of the corpus begins with these words."""
        i, j = self.ids.get(a, -1), self.ids.get(b, -1)
        if i < 0 or j < 0:
            return False
        k = i * self.base + j
        p = int(np.searchsorted(self.seldom, k))
        return p < len(self.seldom) and self.seldom[p] == k

    def candidates(self, w: str) -> list[tuple[str, float]]:
        """Lexicon words that may have been misread as ``w``, by cost; far commoner than ``w``."""
        if w not in self.found:
            if len(self.found) > 200_000:
                self.found.clear()
            mine = self.n.get(w, 0)
            lim = 0.45 if len(w) <= 3 else 0.85
            best = {v: c for v, c in undone(w, 1 if lim < 0.8 else 2, self.longest).items() if v in self.meant and v != w and self.n[v] > 20 * mine}
            for v in self.index.near(w):
                if v != w and v not in best and self.n[v] > 20 * mine:
                    best[v] = distance(w, v)
            self.found[w] = sorted(((v, c) for v, c in best.items() if c <= lim), key=lambda x: (x[1], -self.n[x[0]]))
        return self.found[w]

    def fix(self, w: str, prev: str, nxt: str) -> str | None:
        """What ``w`` (in small letters) was meant to be, if something else."""
        cands = self.candidates(w)
        if not cands:
            return None
        mine = self.n.get(w, 0)
        ctx = lambda v: self.pair(prev, v) + self.pair(v, nxt)
        v, cost = min(cands, key=lambda x: (x[1] > 0.5, -ctx(x[0]), x[1], -self.n[x[0]]))
        if mine == 0 and (len(w) > 3 or ctx(v) > 0):
            return v
        its = ctx(v)
        return v if its >= 20 * max(1, ctx(w)) and self.n[v] >= 50 * mine else None


#: A capital in the middle of small letters: a wrong encoding rather than a misread sign.
MIXED = re.compile(r"[a-zß-öø-ÿ][À-ÖØ-Þ]")
CONTROL = re.compile(r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]")


def bare(tok: str) -> str:
    return tok.strip(EDGE).lower()


def split_word(a: str, sign: str, b: str, lex: Lexicon) -> bool:
    """Whether ``a`` and ``b`` are one word parted by a hyphen, not a compound or an omission (``pre- and``)."""
    la, lb = a.lower(), b.lower()
    whole = lex.n.get(la + lb, 0)
    if CJK.search(a + b):
        return False
    if sign in "¬\u00ad":  # signs with no other meaning
        return True
    if whole and whole >= 3 * lex.n.get(f"{la}-{lb}", 0):
        return True
    if not b[0].islower() and not a.isupper():
        return False
    if lex.n.get(f"{la}-{lb}", 0) or lex.n.get(lb, 0) and (lex.n.get(la + "-", 0) or lex.n.get(la, 0)):
        return False
    return lb not in lex.n or bool(lex.candidates(la + lb)) or la not in lex.n and lex.n.get(lb, 0) < 1000


def _single(w: str) -> bool:
    """Whether a word begins with a letter that stands alone."""
    return w[:1].isalpha() and not (w[1:2].isalnum() or w[1:2] in tuple("_'’"))


def repair_text(text: str, lex: Lexicon) -> tuple[str, set[str]]:
    """The text with words joined and misread ones put right, and the kinds of noise met."""
    kinds: set[str] = set()

    def join(m: re.Match) -> str:
        if split_word(m[1], m[2], m[4], lex):
            kinds.add("split")
            return m[1] + m[4]
        return m[0]

    if PARTED.search(text):
        text = SPLIT.sub(join, text)

    def close(m: re.Match) -> str:
        w = m[0].replace(" ", "")
        if w.lower() in lex.n or lex.candidates(w.lower()):
            kinds.add("spaced")
            return w
        return m[0]

    toks = re.split(r"(\s+)", text)
    words = toks[::2]
    if any(w.isalpha() and _single(words[i - 1][::-1]) and _single(words[i + 1]) for i, w in enumerate(words[1:-1], 1) if len(w) == 1):
        text = SPACED.sub(close, text)
        toks = re.split(r"(\s+)", text)
        words = toks[::2]
    fine = lex.fine
    odd = [i for i, w in enumerate(words) if not fine.get(w, False)]
    if not odd:
        return text, kinds
    skip = -1
    for i in odd:
        w = words[i]
        if i == skip or not w:
            continue
        b = bare(w)
        n = lex.n.get(b, 0)
        if n and not lex.candidates(b):
            if len(fine) > 400_000:
                fine.clear()
            fine[w] = True
            continue
        if CJK.search(b):
            new = re.sub(rf"(?<=[㐀-鿿])[{re.escape(STRAY)}](?=[㐀-鿿])", "", w)
            if new != w:
                kinds.add("stray")
                words[i] = new
            continue
        if not b or not any(ch.isalpha() for ch in b):
            continue
        prev, nxt = bare(words[i - 1]) if i else "", bare(words[i + 1]) if i + 1 < len(words) else ""
        core = w.strip(EDGE)
        if not n:
            # A stray sign within a word.
            new = INNER.sub("", b)
            if new != b and (new in lex.n or "." not in b and new.isalpha() and core[0].isupper() and new.isascii()):
                kinds.add("stray")
                words[i] = w.replace(core, _case(core, INNER.sub("", core)), 1)
                b = new
                core = words[i].strip(EDGE)
                if b in lex.n:
                    continue
            # A blank within a word.
            if i + 1 < len(words) and nxt and b.isalpha() and nxt.isalpha() and not w.endswith(tuple(EDGE)) and words[i + 1][:1].islower() and lex.n.get(b + nxt, 0) > 20 * max(lex.n.get(b, 0) and lex.pair(b, nxt), 0):
                kinds.add("blank")
                words[i], words[i + 1] = w + words[i + 1], ""
                skip = i + 1
                continue
            if i and words[i - 1] and prev.isalpha() and b.isalpha() and w[0].islower() and not words[i - 1].endswith(tuple(EDGE)) and lex.n.get(prev + b, 0) > 20 * lex.pair(prev, b):
                kinds.add("blank")
                words[i - 1], words[i] = words[i - 1] + w, ""
                continue
        elif len(b) <= 3 and i + 1 < len(words) and b.isalpha() and nxt.isalpha() and nxt not in lex.n and words[i + 1][:1].islower() and not w.endswith(tuple(EDGE)) and lex.n.get(b + nxt, 0):
            kinds.add("blank")
            words[i], words[i + 1] = w + words[i + 1], ""
            skip = i + 1
            continue
        if MIXED.search(core) or b.isdigit():
            continue
        if any(ch.isdigit() for ch in b):
            # Digits among letters; codes with a dash and short ones such as B12 are left.
            if "-" in b or sum(ch.isdigit() for ch in b) * 2 >= len(b):
                continue
        new = lex.fix(b, prev, nxt)
        if new:
            kinds.add("misread")
            words[i] = w.replace(core, _case(core, new), 1)
        elif not n and len(b) > 4 and (any(ch.isdigit() for ch in b[1:-1]) and b[0].isalpha() and b[-1].isalpha() and b.count(".") == 0 or "ſ" in b):
            kinds.add("misread")
            words[i] = w.replace("ſ", "s").replace("0", "o") if "ſ" in b or "0" in b else w
    out, gap = [], toks[1::2]
    for i, w in enumerate(words):
        out.append(w)
        if i < len(gap) and not (i + 1 < len(words) and words[i + 1] == ""):
            out.append(gap[i])
    return "".join(out), kinds


def _case(old: str, new: str) -> str:
    if old.isupper() and len(old) > 1:
        return new.upper()
    return new[:1].upper() + new[1:] if old[:1].isupper() else new


ROMAN = {"i": 1, "v": 5, "x": 10, "l": 50, "c": 100}


def number(s: str) -> int | None:
    if s.isdecimal():
        return int(s)
    v = [ROMAN.get(ch) for ch in s.lower()]
    return None if None in v or not v else sum(-a if a < b else a for a, b in zip(v, [*v[1:], 0]))


def edges(text: str, passage: bool, lex: Lexicon, page: int) -> list[tuple[str, int, int]]:
    """``(key, start, end)`` of what may be a running header or footer, and page numbers: key ``#`` if they are told
    by their form, else ``?`` with their distance from the page, to be told by the same distance on another page."""
    out = []
    if not passage:
        spans, at = [], 0
        for line in text.split("\n"):
            if line.strip():
                spans.append((at, at + len(line), line.strip()))
            at += len(line) + 1
        if len(spans) < 2:
            return out
        for k in {0, 1, len(spans) - 2, len(spans) - 1}:
            a, b, line = spans[k]
            if PAGE_NO.fullmatch(line):
                out.append(("#", a, b))
            elif line[-1] not in ".。,;:!?" and not HEADING.match(line):
                s = skeleton(line)
                if len(s) >= 4:
                    out.append(("=" + s, a, b))
                    if len(s) >= 12:
                        out.append((f"~{s[:6]} {s[-6:]}", a, b))
        return out
    m = MARKED_NO.match(text)
    if m:
        out.append(("#", 0, m.end()))
    # Words up to the end of the first sentence: what stands before its beginning may be a header of any length.
    words, at = [], []
    for w in re.finditer(r"\S+", text) if not HEADING.match(text) else ():
        words.append((w.start(), w.end(), w[0]))
        if len(words) > 2 and words[-3][2][-1] in ".。!?" and not re.fullmatch(r"p\.|[A-Z]\.", words[-3][2]):
            break
        if len(words) > 2 and not words[-2][2][0].islower():
            at.append(len(words) - 2)
    two = [(bare(words[k][2]), bare(words[k + 1][2])) for k in at]
    # The first common beginning; without one, all places of seldom ones, of which another page tells the right one.
    common = [k for k, (a, b) in zip(at, two) if f"{a} {b}" in lex.starts][:1]
    for k in common or [k for k, (a, b) in zip(at, two) if lex.begins(a, b)]:
        head = text[: words[k][0]].strip()
        n = re.search(rf"(?:^|(?<= ))(?:{MARKED_NO.pattern}|{NUM})$", head)
        if n:
            if MARKED_NO.fullmatch(n[0]) or not n[0].isalnum():
                out.append(("#", n.start(), n.end()))
            elif (v := number(n[0])) is not None:
                out.append((f"?{v - page}", n.start(), n.end()))
        s = skeleton(PAGE_NO.sub("", head) if PAGE_NO.fullmatch(head) else head)
        if len(s) >= 4:
            out += [("=" + s, 0, len(head)), *([(f"~{s[:6]} {s[-6:]}", 0, len(head))] if len(s) >= 12 else [])]
    for start in footers(text):
        frag, end = text[start:].rstrip(), len(text.rstrip())
        if PAGE_NO.fullmatch(frag):
            out.append(("#", start, end))
            continue
        n = re.search(rf"{MARKED_NO.pattern}$| [0-9lIO]{{1,4}}$", frag)
        s = skeleton(frag[: n.start()] if n else frag)
        if len(s) >= 4 and frag[-1] not in ",;:":
            out += [("=" + s, start, end), *([(f"~{s[:6]} {s[-6:]}", start, end)] if len(s) >= 12 else [])]
        if n and MARKED_NO.fullmatch(n[0].strip()):
            out.append(("#", start + n.start(), end))
    return out


#: The end of a sentence, or of an abbreviation, and what follows it to the next.
STOP = re.compile(r"[.!?。][\"”»)]? ?(?=[^.!?。\s])")


def footers(text: str) -> list[int]:
    """Where a footer may begin: after the last stop; and if but a word or a figure follows that, which may have been the stop
    of an abbreviation, after the one before it, and so on. None if the text ends with a stop."""
    end = len(text.rstrip())
    if not end or text[end - 1] in ".。!?":
        return []
    out, before = [], end
    for at in reversed([m.span() for m in STOP.finditer(text, 0, end)]):
        part = text[at[1] : before]
        if "\n" in part:
            break
        out.append(at[1])
        before = at[0]
        if len(part.split()) > 1 or text[at[0]] in "!?。":
            break
    return out


def strip(text: str, cuts: list[tuple[int, int]]) -> str:
    for a, b in sorted(set(cuts), reverse=True):
        text = text[:a] + text[b:]
    return text.strip()


def paragraphs(text: str, lex: Lexicon) -> str:
    """Line ends within a paragraph become blanks; blank lines stay."""
    if "\n" not in text:
        return text.strip()
    return "\n\n".join(re.sub(r"\s*\n\s*", " ", p).strip() for p in re.split(r"\n[ \t]*\n\s*", text) if p.strip())


def corpus(texts: DataFrame) -> tuple:
    """Words, pairs of neighbouring words and beginnings of sentences of a one-column frame of texts."""

    def count_words(batches):
        n: Counter = Counter()
        out = lambda: pa.RecordBatch.from_arrays([pa.array(list(n)), pa.array(list(n.values()), pa.int64())], names=["w", "n"])
        for b in batches:
            raw: Counter = Counter()
            for t in b.column(0).to_pylist():
                raw.update(t.split())
            for w, k in raw.items():
                if w := bare(w):
                    n[w] += k
            if len(n) > 400_000:
                yield out()
                n.clear()
        if n:
            yield out()

    counts = cut(texts.mapInArrow(count_words, "w string, n bigint").groupBy("w").agg(F.sum("n").alias("n")))
    total = counts.agg(F.sum("n")).first()[0] or 0
    kept = counts.filter(F.col("n") >= max(3, int(np.ceil(total * PHI)))).toPandas().sort_values("w")
    words = list(zip(kept.w.tolist(), kept.n.tolist()))
    given = texts.sparkSession.sparkContext.broadcast([w for w, _ in words])

    def count_pairs(batches):
        ids = {w: i for i, w in enumerate(given.value)}
        base, cache = len(ids) + 1, {}

        def num(tok: str) -> int:
            # The sign is set for a token that ends a sentence.
            if len(cache) > 400_000:
                cache.clear()
            i = ids.get(bare(tok), -1)
            cache[tok] = i = i * 2 + (tok[-1] in ".!?")
            return i

        for b in batches:
            keys, starts = [], []
            for t in b.column(0).to_pylist():
                x = np.fromiter((num(w) if (i := cache.get(w)) is None else i for w in t.split()), np.int64)
                if len(x) < 3:
                    continue
                end, x = (x & 1).astype(bool), x >> 1
                ok = (x[:-1] >= 0) & (x[1:] >= 0)
                keys.append((x[:-1] * base + x[1:])[ok])
                after = np.append(False, end[:-2]) & ok
                starts.append((x[:-1] * base + x[1:])[after])
            for kind, part in ((0, keys), (1, starts)):
                k, n = np.unique(np.concatenate([*part, np.zeros(0, np.int64)]), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), kind, np.int32)), pa.array(k), pa.array(n.astype(np.int64))], names=["kind", "k", "n"])

    pairs = cut(texts.mapInArrow(count_pairs, "kind int, k bigint, n bigint").groupBy("kind", "k").agg(F.sum("n").alias("n")))
    got = pairs.filter((F.col("kind") == 0) & (F.col("n") >= max(2, int(np.ceil(total * PAIR_PHI))))).toPandas().sort_values("k")
    floor = max(4, int(np.ceil(total * 2e-5)))
    base = len(words) + 1
    first = pairs.filter("kind = 1").select("k", (F.col("n") >= floor).alias("common")).toPandas().sort_values("k")
    starts = [f"{words[k // base][0]} {words[k % base][0]}" for k in first.k[first.common]]
    return words, (got.k.to_numpy(np.int64), got.n.to_numpy(np.int64)), starts, first.k.to_numpy(np.int64)


_LEX: dict[str, Lexicon] = {}


def _give(rows: DataFrame):
    """The lexicon of the texts, for all tasks, under a name of its own."""
    return rows.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, *corpus(rows.select("text"))))


def _lex(given) -> Lexicon:
    """Set up once a worker."""
    key, words, pairs, starts, seldom = given.value
    if key not in _LEX:
        _LEX.clear()
        _LEX[key] = Lexicon(words, pairs, starts, seldom)
    return _LEX[key]


def sources(pages: DataFrame, passages: DataFrame) -> DataFrame:
    """``path, page, passage_id, text`` of both tables, as they are; ``passage_id`` null for pages."""
    a = pages.select(F.col("path").cast("string"), F.col("page").cast("int"), F.lit(None).cast("string").alias("passage_id"), "text")
    b = passages.select(F.col("path").cast("string"), F.col("page").cast("int"), F.col("passage_id").cast("string"), "text")
    return a.unionByName(b).filter("text IS NOT NULL AND trim(text) <> ''")


def _edge_keys(rows: DataFrame, given) -> DataFrame:
    def run(batches):
        lex = _lex(given)
        for b in batches:
            at, keys = [], []
            for i, (page, pid, t) in enumerate(zip(*(b.column(j).to_pylist() for j in (1, 2, 3)))):
                for k in {k for k, _, _ in edges(CONTROL.sub("", t), pid is not None, lex, page)}:
                    at.append(i)
                    keys.append(k)
            take = pa.array(at, pa.int32())
            yield pa.RecordBatch.from_arrays([b.column(0).take(take), b.column(1).take(take), pa.array(keys, pa.string())], names=["path", "page", "key"])

    return rows.filter("page IS NOT NULL").mapInArrow(run, "path string, page int, key string")


def running(keys: DataFrame) -> DataFrame:
    """``path, key`` of edges that stand on two pages of a file or more."""
    return keys.filter("key <> '#'").groupBy("path", "key").agg(F.min("page").alias("a"), F.max("page").alias("b")).filter("a < b").select("path", "key")


def repaired(pages: DataFrame, passages: DataFrame) -> DataFrame:
    """``path, page, passage_id, text, kinds`` of every text of both tables: continuous paragraphs without
    running lines and page numbers, and the kinds of noise taken out (``split``, ``misread``, ``stray``,
    ``blank``, ``spaced``, ``header``, ``number``)."""
    rows = sources(pages, passages)
    given = _give(rows)
    keys = cut(_edge_keys(rows, given).distinct())
    # The running keys of a page: at most those its own edges have.
    own = keys.join(running(keys), ["path", "key"]).groupBy("path", "page").agg(F.collect_set("key").alias("keys"))
    cols = ["path", "page", "passage_id", "text", "keys"]
    paged, unpaged = rows.filter("page IS NOT NULL"), rows.filter("page IS NULL").withColumn("keys", F.lit(None).cast("array<string>"))
    # Texts without a page have no running lines, so they stay out of the join: a file may have very many of them.
    full = paged.join(small(own), ["path", "page"], "left").select(*cols).unionByName(unpaged.select(*cols))

    def run(batches):
        lex = _lex(given)
        for b in batches:
            texts, kinds = [], []
            for page, pid, t, ks in zip(*(c.to_pylist() for c in b.columns[1:5])):
                t, ks, found, cuts = CONTROL.sub("", t), set(ks or ()), set(), []
                for k, x, y in edges(t, pid is not None, lex, page) if page is not None else ():
                    if k == "#" or k in ks:
                        found.add("number" if k[0] in "#?" else "header")
                        cuts.append((x, y))
                merged = []
                for x, y in sorted(cuts):
                    if merged and x <= merged[-1][1]:
                        merged[-1] = (merged[-1][0], max(y, merged[-1][1]))
                    else:
                        merged.append((x, y))
                new, more = repair_text(strip(t, merged), lex)
                texts.append(paragraphs(new, lex))
                kinds.append(sorted(found | more))
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(texts, pa.string()), pa.array(kinds, pa.list_(pa.string()))], names=["path", "page", "passage_id", "text", "kinds"])

    return full.mapInArrow(run, "path string, page int, passage_id string, text string, kinds array<string>")


def found(pages: DataFrame, passages: DataFrame) -> DataFrame:
    """``path, page, kind`` of every numbered page with noise. Texts aren't shuffled: what a text shows by
    itself comes from a narrow pass, running lines from the keys of its edges."""
    rows = sources(pages, passages)
    given = _give(rows)

    def run(batches):
        lex = _lex(given)
        for b in batches:
            at, out = [], []
            for i, (page, pid, t) in enumerate(zip(*(b.column(j).to_pylist() for j in (1, 2, 3)))):
                t = CONTROL.sub("", t)
                ks = set(repair_text(t, lex)[1])
                ks |= {k for k, _, _ in edges(t, pid is not None, lex, page)}
                for k in ks:
                    at.append(i)
                    out.append(k)
            take = pa.array(at, pa.int32())
            yield pa.RecordBatch.from_arrays([b.column(0).take(take), b.column(1).take(take), pa.array(out, pa.string())], names=["path", "page", "key"])

    keys = cut(rows.filter("page IS NOT NULL AND path IS NOT NULL").mapInArrow(run, "path string, page int, key string").distinct())
    marks = F.substring("key", 1, 1).isin("=", "~", "?")
    own = keys.filter(~marks).select("path", "page", F.when(F.col("key") == "#", "number").otherwise(F.col("key")).alias("kind"))
    head = keys.join(running(keys), ["path", "key"]).select("path", "page", F.when(F.col("key").startswith("?"), "number").otherwise("header").alias("kind"))
    return own.unionByName(head).distinct()


def p1_repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    passages = table(spark, sf_dir, "passages").select("passage_id", "path", "page", "text")
    return repaired(table(spark, sf_dir, "extracted_pages").distinct(), distinct_rows(passages, "passage_id"))


def p1_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return found(table(spark, sf_dir, "extracted_pages"), table(spark, sf_dir, "passages"))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p1_kinds(spark, sf_dir).select("path", "page").distinct()
