from __future__ import annotations

import random

import numpy as np

from skerry.llm import knn, neardup


def texts(n=120, seed=3):
    rnd = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    base = [[rnd.choice(vocab) for _ in range(rnd.randrange(40, 90))] for _ in range(n)]
    rows = [(f"p{i:04d}", " ".join(w)) for i, w in enumerate(base)]
    for i in range(0, n, 3):
        w = list(base[i])
        for _ in range(rnd.randrange(1, 9)):
            k = rnd.randrange(len(w))
            w[k : k + rnd.randrange(2)] = [rnd.choice(vocab)]
        rows.append((f"q{i:04d}", " ".join(w)))
    rows += [(f"copy{i}", rows[0][1].upper() + "!") for i in range(5)] + [("short", "a b c"), ("none", None), rows[1]]
    return rows


def brute(rows, shingle=3, least=40, threshold=0.6):
    sets = {}
    for k, t in rows:
        w = neardup.WORD.findall(t.lower()) if t else []
        if len(w) >= least:
            sets[k] = set(zip(*(w[i:] for i in range(shingle))))
    keys = sorted(sets)
    return {(a, b) for i, a in enumerate(keys) for b in keys[i + 1 :] if len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b])}


def test_pairs_equal_brute_force(spark):
    rows = texts()
    df = spark.createDataFrame([(k, t, "x") for k, t in rows], "passage_id string, text string, id string")
    got = {(r.id_a, r.id_b): r.jaccard for r in neardup.pairs(df).collect()}
    want = brute(rows)
    assert len(want) > 40 and set(got) == want
    assert all(a < b and 0.6 <= j <= 1 for (a, b), j in got.items())


def test_groups(spark):
    rows = texts()
    df = spark.createDataFrame(rows, "passage_id string, text string")
    got = {r.id: (r.class_id, r.group_id, r.links) for r in neardup.groups(df).collect()}
    want = brute(rows)
    assert set(got) == {k for p in want for k in p}
    assert all(got[a][1] == got[b][1] for a, b in want)
    assert len({got[f"copy{i}"] for i in range(5)}) == 1 and got["copy0"][0] == "copy0"


def test_one_text_in_a_third_of_all_rows(spark):
    same = " ".join(f"s{i}" for i in range(50))
    df = spark.createDataFrame([(f"k{i}", same) for i in range(400)] + texts(30), "passage_id string, text string")
    got = neardup.groups(df).filter("id LIKE 'k%'").collect()
    assert len(got) == 400 and {r.class_id for r in got} == {"k0"} and {r.links for r in got} == {0}


def test_hot_bands_and_classes_are_cut_into_blocks(spark, monkeypatch):
    monkeypatch.setattr(neardup, "HOT", 3)
    monkeypatch.setattr(neardup, "SAMPLE", 1)
    rnd = random.Random(6)
    body = [f"t{i}" for i in range(60)]
    rows = [(f"m{i:03d}", " ".join([*body, *(f"x{rnd.randrange(10_000)}" for _ in range(rnd.randrange(2, 12)))])) for i in range(40)]
    rows += [(f"same{i}", rows[0][1]) for i in range(20)] + texts(20)
    df = spark.createDataFrame(rows, "passage_id string, text string")
    assert {(r.id_a, r.id_b) for r in neardup.pairs(df).collect()} == brute(rows)


def test_long_chains_are_one_group(spark):
    e = spark.createDataFrame([(f"n{i:03d}", f"n{i + 1:03d}") for i in range(150)], "a string, b string")
    got = {r.node: r.root for r in neardup.components(e, "a", "b").collect()}
    assert len(got) == 150 and set(got.values()) == {"n000"}


def test_no_rows(spark):
    df = spark.createDataFrame([("a", None), (None, "x y z")], "passage_id string, text string")
    assert neardup.pairs(df).count() == 0 and neardup.pairs(df.limit(0)).count() == 0 and neardup.groups(df).count() == 0


def test_sketches_estimate_similarity():
    rng = np.random.default_rng(0)
    a = rng.integers(0, 2**63, 300).astype(np.uint64)
    b = np.concatenate([a[:200], rng.integers(0, 2**63, 100).astype(np.uint64)])
    sk = neardup.sketch(np.concatenate([a, b]), np.repeat([0, 1], 300), 2)
    assert (sk != neardup._EMPTY).all()
    assert abs((sk[0] == sk[1]).mean() - 0.5) < 0.15
    one = neardup.sketch(a[:1], np.zeros(1, np.int64), 1)  # a single shingle fills every bin
    assert (one != neardup._EMPTY).all()


def vectors(n=400, d=16, seed=0):
    rng = np.random.default_rng(seed)
    c = rng.normal(size=(20, d))
    return (c[rng.integers(20, size=n)] + 0.3 * rng.normal(size=(n, d))).astype(np.float32)


def exact(keys, v, k):
    v = v / np.linalg.norm(v, axis=1, keepdims=True)
    s = v @ v.T
    np.fill_diagonal(s, -9)
    return {key: {keys[j] for j in np.argsort(-s[i], kind="stable")[:k]} for i, key in enumerate(keys)}, s


def test_neighbours(spark, monkeypatch):
    v = vectors()
    keys = [f"k{i:03d}" for i in range(len(v))]
    rows = [(k, "m", 16, x.tolist(), 0) for k, x in zip(keys, v)]
    bad = [("n1", "m", 16, None, 0), ("n2", "m", 16, [], 0), ("n3", "m", 16, [1.0] * 5, 0), ("n4", "m", 16, [0.0] * 16, 0), ("n5", "m", 16, [float("nan")] * 16, 0), ("n6", "m", 16, [float("inf")] + [1.0] * 15, 0), (None, "m", 16, [1.0] * 16, 0), ("n7", "m", 16, [None] + [1.0] * 15, 0)]
    df = spark.createDataFrame(rows + bad + rows[:9] + [("other", "m2", 2, [1.0, 0.0], 0)], "key string, model string, dim int, vec array<float>, id int")
    monkeypatch.setattr(knn, "CELL", 40)
    got: dict = {}
    for r in knn.knn(df, k=5, enough=150).collect():
        got.setdefault(r.key, set()).add(r.neighbour)
    want, s = exact(keys, v, 5)
    assert set(got) == set(keys)
    assert np.mean([len(got[k] & want[k]) / 5 for k in keys]) >= 0.9
    near = knn.knn(df, k=5, min_sim=0.95, enough=400)
    pairs = {(r.key_a, r.key_b) for r in knn.mutual(near, 0.95).collect()}
    assert pairs == {(a, b) for i, a in enumerate(keys) for j, b in enumerate(keys) if a < b and b in want[a] and a in want[b] and s[i, j] >= 0.95}


def test_equal_vectors_and_hot_cells(spark, monkeypatch):
    monkeypatch.setattr(knn, "BLOCK", 16)
    v = vectors(60, 8, 2)
    rows = [(f"k{i:03d}", "m", 8, v[0 if i < 30 else i].tolist()) for i in range(60)]
    df = spark.createDataFrame(rows, "key string, model string, dim int, vec array<float>")
    got: dict = {}
    for r in knn.knn(df, k=4).orderBy("key", "rank").collect():
        got.setdefault(r.key, []).append(r.neighbour)
    assert set(got) == {r[0] for r in rows} and all(len(x) == 4 for x in got.values())
    assert got["k000"] == ["k001", "k002", "k003", "k004"] and got["k029"] == ["k000", "k001", "k002", "k003"]
    assert knn.knn(df.limit(0)).count() == 0


def test_walk_goes_by_summed_distance():
    rng = np.random.default_rng(1)
    da, db = rng.random(9), rng.random(7)
    got = knn.walk(da, db, np.ones(63, np.int64), 63)
    sums = [da[c // 7] + db[c % 7] for c in got]
    assert sorted(got) == list(range(63)) and sums == sorted(sums)


def test_enough_is_measured_or_all(spark, monkeypatch):
    monkeypatch.setattr(knn, "CELL", 20)
    monkeypatch.setattr(knn, "TRIED", 60)
    rng = np.random.default_rng(5)
    x = rng.normal(size=(600, 12))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    df = spark.createDataFrame([(f"k{i:03d}", "m", 12, [float(v) for v in r]) for i, r in enumerate(x)], "key string, model string, dim int, vec array<float>")
    s = x @ x.T
    np.fill_diagonal(s, -2)
    want = {f"k{i:03d}": {f"k{j:03d}" for j in np.argsort(-s[i])[:5]} for i in range(600)}
    for exact, least in ((True, 1.0), (False, 0.9)):
        got: dict[str, set] = {}
        for r in knn.knn(df, k=5, exact=exact).collect():
            got.setdefault(r.key, set()).add(r.neighbour)
        assert np.mean([len(got[k] & want[k]) / 5 for k in want]) >= least
    a, b = rng.normal(size=(3, 6)).astype(np.float32), rng.normal(size=(4, 6)).astype(np.float32)
    sizes = np.arange(12)
    cells = np.array([5, 11])
    q = x[:2].astype(np.float32)
    for v, c, n in zip(q, cells, knn.needed(q, cells, a, b, sizes)):
        da, db = (((y * y).sum(1) - 2 * y @ h) for y, h in ((a, v[:6]), (b, v[6:])))
        w = knn.walk(da, db, np.maximum(sizes, 1), 10**9)
        assert n == sizes[w[: w.index(c) + 1]].sum()
