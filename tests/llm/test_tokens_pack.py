from __future__ import annotations

import os
import random
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from skerry.llm import pack, split, tokens

pytestmark = pytest.mark.skipif(not os.path.exists(tokens.DEFAULT_VOCAB), reason="no vocabulary files")
JSON = "/opt/tokenizers/byte_bpe_50k.json"


@pytest.fixture(scope="module")
def cache():
    return tokens.PieceCache(tokens.load_ranks(open(tokens.DEFAULT_VOCAB, "rb").read()))


def ids_of(texts, cache, most=2_000_000):
    out = []
    for ids, counts, _ in tokens.encode_texts(texts, cache, most):
        at = np.concatenate([[0], np.cumsum(counts)])
        out += [ids[a:b].tolist() for a, b in zip(at, at[1:])]
    return out


def reference(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(JSON)
    t.encode_special_tokens = True
    return [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


def test_same_ids_as_the_library(cache):
    rnd = random.Random(5)
    chars = "ab sS't'red'llve  \n\t  1²½٣é中文́!?.,—'''<|endoftext|>🙂\x00\x1c\x85 "
    texts = ["".join(rnd.choice(chars) for _ in range(rnd.randrange(80))) for _ in range(3000)]
    texts += ["<|endoftext|> it's we'll they'VE x's's", " ", "\n\n a", "a" * 5000, "don''t", "é" * 300]
    want = reference(texts)
    assert ids_of(texts, cache) == want
    assert ids_of(texts, cache, most=50) == want  # however the texts fall into runs


def test_same_ids_for_all_code_points(cache):
    texts = [f"a{c}a 1{c}1 {c}!  {c} x" for c in map(chr, [*range(0x3000), *range(0xF900, 0x11000), *range(0x1F000, 0x20000)])]
    assert ids_of(texts, cache) == reference(texts)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(), max_size=5))
def test_round_trip(texts):
    c = tokens.PieceCache(tokens.load_ranks(open(tokens.DEFAULT_VOCAB, "rb").read())) if not hasattr(test_round_trip, "c") else test_round_trip.c
    test_round_trip.c = c
    assert [tokens.decode(x, c.ranks) for x in ids_of(texts, c)] == texts


def test_rows(spark):
    rows = [(1, "hello world"), (2, ""), (3, None), (1, "hello world"), (None, "x"), (4, "it's")]
    df = spark.createDataFrame([(i, t, "extra") for i, t in rows], "doc_id bigint, text string, ids string")
    got = {r.doc_id: r.ids for r in tokens.encode(df).collect()}
    assert got == dict(zip((1, 4, None), reference(["hello world", "it's", "x"]))) | {2: [], 3: []}
    assert tokens.encode(df.limit(0)).count() == 0
    starts = {r.doc_id: r.starts for r in tokens.encode(df, offsets=True).collect()}
    assert starts[1] == [0, 5] and starts[4] == [0, 2]


def check(sizes, capacity, rows):
    used, pieces = defaultdict(list), defaultdict(int)
    for r in rows:
        assert 0 <= r.n_tokens <= capacity
        pieces[r.doc_id] += r.n_tokens
        if r.n_tokens:
            used[r.container_id].append((r.container_offset, r.n_tokens))
    for items in used.values():
        items.sort()
        assert items[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(items, items[1:])) and items[-1][0] + items[-1][1] <= capacity
    assert pieces == dict(sizes)
    assert sorted(used) == list(range(len(used)))
    return len(used)


def test_packing(spark):
    rnd = random.Random(1)
    sizes = [(i, min(900, int(rnd.lognormvariate(3, 1)))) for i in range(3000)] + [(5000, 0), (5001, 250), (5002, 1)]
    df = spark.createDataFrame(sizes + sizes[:50], "doc_id bigint, n_tokens int")
    got = pack.pack(df, 100, block=500).collect()
    n = check(sizes, 100, got)
    assert n <= 1.03 * -(-sum(s for _, s in sizes) // 100)
    cut = sorted((r.piece, r.start_token, r.n_tokens) for r in got if r.doc_id == 5001)
    assert cut == [(0, 0, 100), (1, 100, 100), (2, 200, 50)]
    assert all(r.n_tokens == 100 for r in got if r.piece == 0 and dict(sizes)[r.doc_id] > 100)


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 500), max_size=25))
def test_plan_places_every_item_once(hist):
    ranges, containers = pack.plan_containers(hist, 40)
    starts = defaultdict(list)
    for length, rank, first, off in ranges:
        starts[length].append((rank, first, off))
    room = defaultdict(int)
    for length, n in sorted(hist.items(), reverse=True):
        a = np.array(starts[length])
        assert a[0, 0] == 0
        for r in range(n):
            k = np.searchsorted(a[:, 0], r, side="right") - 1
            c = a[k, 1] + r - a[k, 0]
            assert room[c] == a[k, 2]
            room[c] += length
            assert room[c] <= 40
    assert len(room) == containers
    assert len(ranges) <= 40 * 7
    assert containers <= 1 + 2 * sum(k * n for k, n in hist.items()) / 40


def test_one_short_length_fills_containers():
    assert pack.plan_containers({10: 9}, 40)[1] == 3
    assert pack.plan_containers({7: 100, 3: 100}, 40)[1] <= 27


def test_empty_packing(spark):
    df = spark.createDataFrame([], "doc_id bigint, n_tokens int")
    assert pack.pack(df, 100).count() == 0
    none = spark.createDataFrame([(1, None), (None, 3)], "doc_id bigint, n_tokens int")
    assert sorted((r.doc_id or 0, r.n_tokens, r.container_id) for r in pack.pack(none, 10).collect()) == [(0, 3, 0), (1, 0, 0)]


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab .,!?\n字。́"), max_size=600), st.integers(20, 90), st.integers(0, 15))
def test_pieces_keep_all_limits(text, limit, overlap):
    got = split.cuts(text, limit, overlap)
    assert got[0][0] == 0 and got[-1][1] == len(text)
    assert all(e - s <= limit for s, e in got)
    assert all(b[0] == a[1] - overlap for a, b in zip(got, got[1:]))
    if len(text) > limit:
        assert len(got) <= 3 * -(-(len(text) - overlap) // (limit - overlap))


def test_cuts_fall_after_sentences():
    text = " ".join(f"Sentence number {i} has a few words in it." for i in range(100))
    for s, e in split.cuts(text, 1000, 100)[:-1]:
        assert text[:e].rstrip().endswith(".")
    para = ("word " * 150 + "\n\n") * 6
    assert all(para[e - 1] == "\n" for _, e in split.cuts(para, 2000, 0)[:-1])


def test_splitting(spark):
    rows = [("a", 3, 10, "x" * 2500), ("b", None, None, "y " * 1500), ("c", 1, 0, "short"), ("d", 1, 0, None), ("a", 3, 10, "x" * 2500)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "passage_id string, page int, offset int, text string, piece int")
    got = split.split(df, 2000, 200).collect()
    a = sorted((r.piece, r.page, r.offset, len(r.text)) for r in got if r.passage_id == "a")
    assert a == [(0, 3, 10, 1350), (1, 3, 1160, 1350)]
    assert {r.passage_id for r in got} == {"a", "b"} and all(r.page is None and r.offset is None for r in got if r.passage_id == "b")
    assert split.split(df.limit(0), 2000, 200).count() == 0
