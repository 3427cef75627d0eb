from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from skerry import api
from skerry.config import Config
from skerry.engine import Engine


@pytest.fixture
def corpus(tmp_path):
    root = tmp_path / "in"
    (root / "Taxes" / "2024").mkdir(parents=True)
    (root / "notes.md").write_text("Reciprocal rank fusion joins lists. See [[readme]].")
    (root / "readme.md").write_text("Bananas are a source of potassium.")
    (root / "Taxes" / "2024" / "w2 form.txt").write_text("annual wage statement")
    (root / "data.bin").write_bytes(b"\x00\x01")
    return root


def engine(spark, root, tmp_path, **kw):
    return Engine(spark, str(root), str(tmp_path / "store"), Config(include=("**/*",)).merged(kw))


def test_index_and_search(spark, corpus, tmp_path):
    e = engine(spark, corpus, tmp_path, dense={"enabled": True})
    assert e.status() == {"indexed": False}
    with pytest.raises(FileNotFoundError):
        e.search_sparse("x")
    r = e.reindex()
    assert (r["added"], r["modified"], r["deleted"], r["unchanged"], r["n_files"], r["name_only"]) == (4, 0, 0, 0, 4, 1)
    assert api.search_sparse(e, "potassium")[0]["path"] == "readme.md"
    assert api.search_dense(e, "rank fusion")[0]["path"] == "notes.md"
    assert api.search_graph(e, "taxes")[0]["path"] == "Taxes/2024/w2 form.txt"
    assert [x["path"] for x in api.search_kb(e, "fusion")] == ["notes.md", "readme.md"]
    h = api.search_hybrid(e, "wage statement", retrievers=["sparse", "graph", "kb"])
    assert h["used"] == ["sparse", "graph"] and h["skipped"] == {"kb": "disabled in config"}
    top = h["results"][0]
    assert (top["path"], top["filename"], top["ext"], top["retriever"]) == ("Taxes/2024/w2 form.txt", "w2 form.txt", "txt", "hybrid") and top["size"] == 21
    with pytest.raises(ValueError):
        e.search("nope", "x")


def test_runs_equal_a_rebuild(spark, corpus, tmp_path):
    e = engine(spark, corpus, tmp_path)
    e.reindex()
    again = e.reindex()
    assert (again["unchanged"], again["added"], again["modified"]) == (4, 0, 0) and e.store.version == 2
    (corpus / "notes.md").write_text("Zebra crossing rules.")
    (corpus / "new.txt").write_text("wholly fresh words")
    (corpus / "readme.md").unlink()
    s = e.status()
    assert (s["pending"], s["pending_added"], s["pending_modified"], s["pending_deleted"]) == (3, 1, 1, 1)
    r = e.reindex()
    assert (r["added"], r["modified"], r["deleted"], r["unchanged"]) == (1, 1, 1, 2) and not e.status()["stale"]
    assert api.search_sparse(e, "potassium") == [] and api.search_sparse(e, "zebra")[0]["path"] == "notes.md"
    fresh = Engine(spark, str(corpus), str(tmp_path / "other"), e.conf)
    fresh.reindex()
    for query in ("zebra", "fresh words", "wage", "data"):
        pick = lambda rows: [(x["passage_id"], x["score"]) for x in rows]
        assert pick(api.search_sparse(e, query)) == pick(api.search_sparse(fresh, query))
    assert e.reindex(full=True)["modified"] == 4


def test_only_changed_files_are_opened(spark, corpus, tmp_path):
    from skerry.sources import files

    e = engine(spark, corpus, tmp_path)
    e.reindex()
    wanted = []
    keep = files.opened
    files.opened = lambda root, w, *a: wanted.append(sorted(r.path for r in w.collect())) or keep(root, w, *a)
    try:
        e.reindex()
        (corpus / "readme.md").write_text("Bananas are a source of potassium and magnesium.")
        e.reindex()
    finally:
        files.opened = keep
    assert wanted == [[], ["readme.md"]]
    assert api.search_sparse(e, "magnesium")[0]["path"] == "readme.md"


def test_walk(spark, tmp_path, monkeypatch):
    import os

    from skerry.sources import files

    root = tmp_path / "a b+c%20"
    for name in ("x.txt", "empty.txt", "d/e/f/y.txt", "d/node_modules/z.txt", ".git/config", "d/ü#1.txt"):
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text("" if name == "empty.txt" else "text")
    os.symlink(root / "d", root / "link")
    want = {"x.txt": 4, "empty.txt": 0, "d/e/f/y.txt": 4, "d/ü#1.txt": 4}
    for most in (1_000, 0):
        monkeypatch.setattr(files, "ENOUGH_FOLDERS", most)
        for r in (str(root), str(root) + "/"):
            assert {r.path: r.size for r in files.scan(spark, r).collect()} == want
    got = {r.path: (r.changed, r.error is None, [p.text for p in r.pages or []]) for r in files.opened(str(root), files.scan(spark, str(root)).withColumn("content_hash", F.lit(None).cast("string"))).collect()}
    assert got["x.txt"] == (True, True, ["text"]) and got["empty.txt"] == (True, True, [])
    assert files.scan(spark, str(tmp_path / "none")).count() == 0


def test_many_runs_merge_their_segments(spark, corpus, tmp_path, monkeypatch):
    from skerry.operators import sparse

    monkeypatch.setattr(sparse, "SEGMENTS", 3)

    e = engine(spark, corpus, tmp_path, dense={"enabled": True})
    e.reindex()
    seen = []
    for i in range(sparse.SEGMENTS):
        (corpus / "new.txt").write_text(f"version{i} of shared words")
        e.reindex()
        seen.append(e.store.segments("postings"))
        assert [x["path"] for x in api.search_sparse(e, f"version{i}")] == ["new.txt"]
        assert i == 0 or api.search_sparse(e, f"version{i - 1}") == []
    assert seen == [2, 1, 2]
    fresh = Engine(spark, str(corpus), str(tmp_path / "other"), e.conf)
    fresh.reindex()
    rows = lambda x: sorted((r.term, r.field, r.passage_id, r.tf, r.dl) for r in sparse.live(x.store).collect())
    assert rows(e) == rows(fresh) and e.store.meta()["field_stats"] == fresh.store.meta()["field_stats"]
    vec = lambda x: sorted((r.passage_id, r.vec) for r in x.store.table("vectors").collect())
    assert vec(e) == vec(fresh)
    e.store.tidy()
    assert rows(e) == rows(fresh) and len(e.store.versions()) == 2


def test_another_language_is_another_index(spark, corpus, tmp_path):
    e = engine(spark, corpus, tmp_path)
    e.reindex()
    assert api.search_sparse(e, "a of") != []
    e = engine(spark, corpus, tmp_path, sparse={"language": "en"})
    e.reindex()
    assert e.store.meta()["language"] == "en" and api.search_sparse(e, "a of") == [] and api.search_sparse(e, "source")[0]["path"] == "readme.md"


def test_a_commit_is_one_step(spark, tmp_path):
    from skerry.sources.store import Store

    s = Store(spark, str(tmp_path / "s"))
    rows = lambda *x: spark.createDataFrame([(a, b) for a, b in x], "path string, n int")
    s.commit(replace={"t": ("path", rows(("a", 1), ("b", 2)))}, note="first")
    broken = Store(spark, s.root)
    broken._publish = lambda *a: (_ for _ in ()).throw(OSError("lost"))
    with pytest.raises(OSError):
        broken.commit(replace={"t": ("path", rows(("c", 3)))})
    assert s.version == 1 and {r.path for r in s.table("t").collect()} == {"a", "b"}
    s.commit(upsert={"t": ("path", rows(("a", 0), ("z", 0)), rows(("a", 9)))})
    assert s.version == 2 and {(r.path, r.n) for r in s.table("t").collect()} == {("a", 9), ("b", 2)} and s.meta()["note"] == "first"
    with pytest.raises(OSError):
        s._publish(2, {})
    s.commit(upsert={"t": ("path", rows(("a", 0), ("b", 0)), rows().limit(0))})
    assert s.table("t").count() == 0
    with pytest.raises(FileNotFoundError):
        s.table("none")


def test_failing_retrievers_are_skipped(spark, corpus, tmp_path):
    e = engine(spark, corpus, tmp_path, dense={"enabled": True})
    e.reindex()
    e.retrievers["graph"] = lambda query, k=10: 1 / 0
    h = e.search_hybrid("potassium", retrievers=["sparse", "graph", "nope"])
    assert h.used == ["sparse"] and h.skipped["nope"] == "disabled in config" and h.skipped["graph"].startswith("error:") and h.results.count() == 1
    other = engine(spark, corpus, tmp_path, dense={"enabled": True, "dim": 64})
    h = other.search_hybrid("potassium")
    assert "dense" in h.skipped and "sparse" in h.used
    with pytest.raises(ValueError):
        other.search_dense("potassium")
    assert other.search_hybrid("x", retrievers=["kb"]).results.count() == 0
    r = engine(spark, corpus, tmp_path, dense={"enabled": True, "embedder": "no-such-model"}).reindex()
    assert r["n_files"] == 4 and any(x.startswith("dense:") for x in r["errors"])


def test_indexes_are_listed_and_forgotten(spark, corpus, tmp_path):
    from skerry import engine as E

    home = str(tmp_path / "home")
    assert E.indexes(spark, home) == [] and E.default_index(spark, home) is None
    where = E.index_folder(home, str(corpus))
    e = Engine(spark, str(corpus), where, Config(include=("**/*",)))
    e.reindex()
    assert [(i["source"], i["n_files"]) for i in E.indexes(spark, home)] == [(str(corpus), 4)]
    assert E.default_index(spark, home, str(corpus)) == where == E.default_index(spark, home, "/elsewhere")
    assert not E.forget(spark, home, "/elsewhere") and E.forget(spark, home, str(corpus)) and E.indexes(spark, home) == [] and corpus.exists()


def test_links_of_notes(spark):
    from skerry.operators import folders

    notes = spark.createDataFrame([("a.md",), ("sub/b.md",), ("sub/c.md",), ("other/c.md",)], "path string")
    lines = spark.createDataFrame([("a.md", "see [[b|the other]] and [[c#part]], [[sub/c]] or [[none]] [[#here]]")], "note string, line string")
    out = {(r.src, r.dst) for r in folders.links(lines, notes).collect()}
    assert out == {("a.md", x) for x in ("sub/b.md", "other/c.md", "sub/c.md")} | {(x, "a.md") for x in ("sub/b.md", "other/c.md", "sub/c.md")}
    said = spark.createDataFrame([('["x.md", "y.txt", "Z.MD"]',), ('"q.md"',), (" m.md \nn.md\n\nplain",), ("error: w.md",), ("No results.md",), ("",), (None,)], "text string")
    assert sorted(r.path for r in folders.listed(said).collect()) == ["Z.MD", "m.md", "n.md", "q.md", "x.md"]


def test_notes_are_searched_whole(spark, corpus, tmp_path):
    from skerry.operators import chunks

    body = [f"w{i}" for i in range(1400)]
    body[1200:1200] = ["see", "[[readme]]", "about", "zorbelin", "crefta"]
    (corpus / "long.md").write_text(" ".join(body))
    e = engine(spark, corpus, tmp_path)
    e.reindex()
    got = api.search_kb(e, "zorbelin")
    assert [x["path"] for x in got] == ["long.md", "readme.md"] and "zorbelin crefta" in got[0]["snippet"]
    p = e.store.table("passages")
    assert {r.path: r.text for r in chunks.whole(p).collect()}["long.md"] == " ".join(body)
    pages = spark.createDataFrame([("a", 1, " ".join(map(str, range(9)))), ("a", 2, "x y"), ("b", None, "z " * 7)], "doc_id string, page int, text string")
    for size, overlap in ((4, 2), (3, 0), (1, 5), (20, 3)):
        assert {r.path: r.text for r in chunks.whole(chunks.chunk(pages, size, overlap), size, overlap).collect()} == {"a": "0 1 2 3 4 5 6 7 8 x y", "b": "z z z z z z z"}


def test_stream(spark, tmp_path, corpus):
    from skerry.streaming.ingest import index_stream

    src, e = tmp_path / "pages", engine(spark, corpus, tmp_path)
    pages = lambda rows: spark.createDataFrame(rows, "doc_id string, page int, text string").coalesce(1).write.mode("append").parquet(str(src))
    pages([("a", 1, "one two"), ("b", 1, "three")])
    stream = lambda: spark.readStream.schema("doc_id string, page int, text string").parquet(str(src))
    for more in ([("a", 1, "four")], None):
        index_stream(stream(), e, str(tmp_path / "ck")).awaitTermination()
        if more:
            pages(more)
    got = {(r.doc_id, r.text) for r in e.store.table("passages").collect()}
    assert got == {("a", "four"), ("b", "three")}
    s = e.status()
    assert s["n_files"] == 2 and s["n_passages"] == 2 and s["index_version"] == 2
    assert [x["path"] for x in api.search_sparse(e, "four")] == ["a"] and api.search_sparse(e, "one") == []
