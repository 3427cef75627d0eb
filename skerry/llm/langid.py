"""Languages of documents and of their segments (problem 6).

Error-correcting output codes: every language has a codeword of ``BITS`` bits, far from all others;
for each bit a binary classifier over hashed character n-grams says how likely it is set; decoding
takes the codeword of the least logistic loss, so weak bits weigh little, and the gap to the second
best tells ambiguous segments. Words are classified once and cached, a segment sums its words.

The classifiers are fitted on a sample of at most ``FIT_ROWS`` labelled passages, drawn by a hash of
the id, and once more without the rows whose label the first fit contradicts. Every passage is
classified, whole, sentence by sentence. Texts that read badly (weak decision, or characters that
right text seldom has) are restored from wrong encodings first.

Cases: null texts, names, codes and tables have no full sentence and give no rows; a text in several
languages gives one row for each language with a full sentence; a label counts as usable only if
``lang_codes`` has it; repeated rows count once; of several labels of a passage the latest counts.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skerry.tables import table

from . import mojibake

BITS, DIM, FIT_ROWS = 15, 1 << 16, 10_000
TOKEN = re.compile(r"[㐀-鿿]|[^\W\d_㐀-鿿]+|[.!?…]+(?=[\"”’»)\]]*(?:\s|$))|[。！？]+|\n+")
END, LINE = 1, 2  # kinds of breaks: sentence end, line end
#: Of a full sentence: words, of which in small letters (or all in capitals) and no single letters; Chinese characters.
#: A sentence of fewer words, from ``SHORT`` on, has but one that isn't in small letters: what has more is mostly names.
MIN_WORDS, MIN_SMALL, MIN_CJK, SHORT = 6, 4, 6, 4
#: A phrase in quotation marks without a sentence end: words named within a sentence, whatever their language.
QUOTED = re.compile(r"[\"“„«‹‘][^\"“”„«»‹›‘.!?。！？\n]+[\"”“»›’]")
SUSPECT = re.compile(r"[�\x80-\x84\x86-\x9f]|[ÃÂâÐÑ][^\sa-zA-Z,.]|[À-ÿ]{3,}|[─-╿]|[ЂЃЉЊЌЋЏђѓљњќћџЎў]|[a-z][А-я]|[А-я][a-z]|[а-я][А-Я]|[-]|[銆鐨涓鏄]")


def codewords(n: int, bits: int = BITS) -> np.ndarray:
    """``n x bits`` of -1 and 1: of many random codes the one whose rows are farthest apart and columns distinct."""
    rng, best, far = np.random.default_rng(11), None, -1
    for _ in range(4000):
        c = rng.choice([-1, 1], (n, bits))
        if n > 1 and (np.abs(c.sum(0)) == n).any():
            continue
        d = min((int((c[i] != c[j]).sum()) for i in range(n) for j in range(i)), default=bits)
        if d > far:
            best, far = c, d
    return best if best is not None else np.ones((n, bits), int)


def grams(word: str) -> list[int]:
    w = f"^{word}$"
    out = [zlib.crc32(w.encode()) & (DIM - 1)]
    for n in (1, 2, 3):
        out += [zlib.crc32(w[i : i + n].encode()) & (DIM - 1) for i in range(len(w) - n + 1)]
    return out


class Model:
    def __init__(self, langs: list[str], counts: np.ndarray):
        """``counts``: languages by hashed n-grams."""
        self.langs, self.code = langs, codewords(len(langs))
        p = (counts + 0.02) / (counts + 0.02).sum(1, keepdims=True)
        self.w = np.zeros((DIM, BITS), np.float32)
        for b in range(BITS):
            one, none = p[self.code[:, b] > 0], p[self.code[:, b] < 0]
            if len(one) and len(none):
                self.w[:, b] = np.log(one.mean(0) / none.mean(0))
        self.ids: dict[str, int] = {}
        self.vec = np.zeros((1 << 14, BITS), np.float32)
        self.info = np.zeros((1 << 14, 6), np.float32)  # n-grams, small, capital, Chinese, words, kind of break

    def add(self, tok: str) -> int:
        if len(self.ids) >= 400_000:
            self.ids.clear()
        i = len(self.ids)
        if i >= len(self.vec):
            self.vec = np.concatenate([self.vec, np.zeros_like(self.vec)])
            self.info = np.concatenate([self.info, np.zeros_like(self.info)])
        self.ids[tok] = i
        self.vec[i] = 0
        ch = tok[0]
        if ch.isalpha():
            g = grams(tok.lower())
            self.vec[i] = self.w[g].sum(0)
            cjk = "㐀" <= ch <= "鿿"
            self.info[i] = (len(g), len(tok) > 1 and not ch.isupper() and not cjk, len(tok) > 1 and tok.isupper(), cjk, not cjk, 0)
        else:
            self.info[i] = (0, 0, 0, 0, 0, LINE if ch == "\n" else END)
        return i

    def segments(self, texts: list[str]) -> tuple[np.ndarray, ...]:
        """For every sentence of every text: text number, first and last token, language, confidence, and whether it is a full one."""
        toks = [TOKEN.findall(t) for t in texts]
        lens = np.fromiter(map(len, toks), np.int64, len(toks))
        n = int(lens.sum())
        if not n:
            return tuple(np.zeros(0, np.int64) for _ in range(6))
        if len(self.ids) + n > 400_000 and len(self.ids) > 200_000:
            self.ids.clear()
        get, add = self.ids.get, self.add
        arr = np.fromiter((add(t) if (i := get(t)) is None else i for ts in toks for t in ts), np.int64, n)
        info = self.info[arr]
        doc = np.repeat(np.arange(len(texts)), lens)
        cut = np.zeros(n, bool)
        cut[0] = True
        cut[1:] = (info[:-1, 5] > 0) | (doc[1:] != doc[:-1])
        at = np.flatnonzero(cut)
        s = np.add.reduceat(info[:, :5], at)
        m = np.add.reduceat(self.vec[arr], at) / np.maximum(s[:, :1], 1)
        last = np.append(at[1:], n) - 1
        loss = np.logaddexp(0, -12 * m[:, None, :] * self.code[None]).sum(2)
        order = np.argsort(loss, 1)
        lang = order[:, 0]
        p = np.exp(loss.min(1, keepdims=True) - loss)
        conf = 1 / p.sum(1)
        full = (info[last, 5] == END) & ((s[:, 4] >= MIN_WORDS) & ((s[:, 1] >= MIN_SMALL) | (s[:, 2] >= MIN_WORDS)) | (s[:, 4] >= SHORT) & (s[:, 1] >= s[:, 4] - 1) | (s[:, 3] >= MIN_CJK))
        conf[s[:, 0] == 0] = 0
        return doc[at], at, last, lang, conf, full


def fit(texts: list[str], labels: list[str], langs: list[str]) -> Model:
    at = {x: i for i, x in enumerate(langs)}

    def counted(pick) -> np.ndarray:
        words: list[Counter] = [Counter() for _ in langs]
        for t, x, ok in zip(texts, labels, pick):
            if ok:
                words[at[x]].update(w.lower() for w in TOKEN.findall(t) if w[0].isalpha())
        out = np.zeros((len(langs), DIM), np.float32)
        for i, c in enumerate(words):
            g = [grams(w) for w in c]
            if g:
                np.add.at(out[i], np.concatenate(g), np.repeat(np.minimum(np.fromiter(c.values(), np.float32, len(c)), 1e6), [len(x) for x in g]))
        return out

    model = Model(langs, counted([True] * len(texts)))
    doc, _, _, lang, conf, full = model.segments(texts)
    ok = []
    votes = np.zeros((len(texts), len(langs)))
    np.add.at(votes, (doc[full], lang[full]), conf[full])
    for v, x in zip(votes, labels):
        ok.append(v.sum() > 0 and v.argmax() == at[x] and v.max() > 0.8 * v.sum())
    return Model(langs, counted(ok)) if any(ok) else model


def usable_labels(labels: DataFrame, codes: DataFrame, id_col: str = "passage_id") -> DataFrame:
    """``id, label_lang``: the language of the latest label of a passage, null if it isn't usable."""
    codes = F.broadcast(codes.select("label", F.col("lang").alias("label_lang")).dropDuplicates(["label"]))  # a fixed table
    got = labels.select(F.col(id_col).alias("id"), F.col("lang").alias("label"), "tagged_at").filter("id IS NOT NULL").join(codes, "label", "left")
    return got.groupBy("id").agg(F.max_by("label_lang", F.struct(F.col("tagged_at").isNotNull(), "tagged_at", F.col("label_lang").isNotNull())).alias("label_lang"))


def train(passages: DataFrame, labels: DataFrame, codes: DataFrame, id_col: str = "passage_id", text_col: str = "text") -> Model:
    langs = sorted(r.lang for r in codes.select("lang").distinct().collect())  # a fixed table
    good = labels.select(F.col(id_col).alias("id"), F.col("lang").alias("label")).join(F.broadcast(codes.select("label", "lang").dropDuplicates(["label"])), "label").select("id", "lang")
    n = max(1, good.count())
    share = min(1_000_000, int(1_000_000 * 0.9 * FIT_ROWS / n) + 1)
    pick = F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < share
    few = passages.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).filter(pick & F.col("text").isNotNull())
    rows = few.join(good.filter(pick), "id").select("text", "lang").limit(FIT_ROWS).toPandas()
    return fit(rows.text.tolist(), rows.lang.tolist(), langs)


def _read(model: Model, src: mojibake.Source, texts: list[str | None]):
    """Segments of the texts, restored where they look wrongly decoded."""
    clean = [t or "" for t in texts]
    sus = [i for i, t in enumerate(clean) if t and not t.isascii() and SUSPECT.search(t)]
    for i in sus:
        r = mojibake.repair(clean[i], src)
        if r:
            clean[i] = r[0]
    clean = [QUOTED.sub(lambda m: " " * len(m[0]), t) for t in clean]
    return clean, model.segments(clean)


_MODELS: dict[int, tuple] = {}


def _shared(given) -> tuple[Model, mojibake.Source]:
    """Model and counts, set up once a worker."""
    if given.value[0] not in _MODELS:
        _MODELS.clear()
        _, langs, w, rows, floor = given.value
        m = Model(langs, np.ones((len(langs), DIM), np.float32))
        m.w = w
        _MODELS[given.value[0]] = m, mojibake.Source(rows, floor)
    return _MODELS[given.value[0]]


def _give(spark: SparkSession, model: Model, src: tuple):
    return spark.sparkContext.broadcast((zlib.crc32(model.w.tobytes()), model.langs, model.w, *src))  # fixed size, and at most a few times 1 / PHI counts


def segments(passages: DataFrame, labels: DataFrame, codes: DataFrame, id_col: str = "passage_id", text_col: str = "text") -> DataFrame:
    """``id_col, segment, start, end, lang, confidence, ambiguous``: runs of sentences of one language, with
    their place in the text as restored; sentences too short to tell join their neighbour."""
    model = train(passages, labels, codes, id_col, text_col)
    given = _give(passages.sparkSession, model, mojibake.source(mojibake.suspects(passages, id_col, text_col).select("text")))

    def run(batches):
        m, src = _shared(given)
        for b in batches:
            out = []
            for lo in range(0, b.num_rows, 2000):
                part = b.slice(lo, 2000)
                texts, (doc, first, last, lang, conf, full) = _read(m, src, part.column(1).to_pylist())
                ids, bounds = part.column(0).to_pylist(), np.searchsorted(doc, np.arange(len(texts) + 1))
                base = 0
                for d, t in enumerate(texts):
                    spans = [x.span() for x in TOKEN.finditer(t)]
                    runs: list[list] = []
                    for k in range(bounds[d], bounds[d + 1]):
                        a, e = spans[first[k] - base][0], spans[last[k] - base][1]
                        if full[k] and (not runs or runs[-1][2] not in (None, lang[k])):
                            runs.append([a, e, lang[k], [conf[k]]])
                        elif runs:
                            runs[-1][1] = e
                            if full[k]:
                                runs[-1][2] = lang[k]
                                runs[-1][3].append(conf[k])
                        else:
                            runs.append([a, e, None, []])
                    base += len(spans)
                    out += [(ids[d], s, a, e, m.langs[x], float(np.mean(c)), bool(np.mean(c) < 0.8)) for s, (a, e, x, c) in enumerate(r for r in runs if r[2] is not None)]
            names = [id_col, "segment", "start", "end", "lang", "confidence", "ambiguous"]
            kinds = (pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.float64(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out) if out else [[]] * 7, kinds)], names=names)

    rows = passages.select(F.col(id_col).cast("string").alias(id_col), F.col(text_col).alias("text")).filter("text IS NOT NULL")
    return rows.mapInArrow(run, f"`{id_col}` string, segment int, start int, end int, lang string, confidence double, ambiguous boolean")


def languages(passages: DataFrame, labels: DataFrame, codes: DataFrame, id_col: str = "passage_id", text_col: str = "text") -> DataFrame:
    """``id_col, lang, confidence, sentences`` of every language in which a passage has a full sentence."""
    model = train(passages, labels, codes, id_col, text_col)
    given = _give(passages.sparkSession, model, mojibake.source(mojibake.suspects(passages, id_col, text_col).select("text")))

    def run(batches):
        m, src = _shared(given)
        k = len(m.langs)
        for b in batches:
            for lo in range(0, b.num_rows, 2000):
                part = b.slice(lo, 2000)
                texts, (doc, _, _, lang, conf, full) = _read(m, src, part.column(1).to_pylist())
                sure = full & (conf > 0.6)
                key = doc[sure] * k + lang[sure]
                n = np.bincount(key, minlength=len(texts) * k)
                c = np.bincount(key, conf[sure], minlength=len(texts) * k)
                at = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(at // k, pa.int32())), pa.array([m.langs[x] for x in at % k], pa.string()), pa.array(c[at] / n[at]), pa.array(n[at].astype(np.int32))], names=[id_col, "lang", "confidence", "sentences"]
                )

    rows = passages.select(F.col(id_col).cast("string").alias(id_col), F.col(text_col).alias("text")).filter("text IS NOT NULL")
    return rows.mapInArrow(run, f"`{id_col}` string, lang string, confidence double, sentences int")


def p6_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = languages(table(spark, sf_dir, "passages"), table(spark, sf_dir, "passage_langs"), table(spark, sf_dir, "lang_codes"))
    return got.withColumn("confidence", F.round("confidence", 4)).distinct()


def p6_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = segments(table(spark, sf_dir, "passages"), table(spark, sf_dir, "passage_langs"), table(spark, sf_dir, "lang_codes"))
    return got.withColumn("confidence", F.round("confidence", 4)).distinct()


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    passages, labels, codes = (table(spark, sf_dir, t) for t in ("passages", "passage_langs", "lang_codes"))
    got = languages(passages, labels, codes).groupBy("passage_id").agg(F.collect_set("lang").alias("langs"))  # at most one entry a language
    said = usable_labels(labels, codes)
    wrong = (F.size("langs") > 1) | F.col("label_lang").isNull() | (F.col("label_lang") != F.col("langs")[0])
    return got.join(said, got.passage_id == said.id, "left").filter(wrong).select("passage_id", F.explode("langs").alias("lang"))
