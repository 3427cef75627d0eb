from __future__ import annotations

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from skerry.config import Config, Graph, load
from skerry.functions import porter
from skerry.functions import text as T
from skerry.operators import chunks, dense, folders, fusion, manifest, sparse
from skerry.plans import globs
from skerry.sources import extract


def chunked(spark, pages, size, overlap):
    df = spark.createDataFrame(pages, "doc_id string, page int, text string")
    return [r.asDict() for r in chunks.chunk(df, size, overlap).orderBy("ordinal").collect()]


def test_chunks(spark):
    one = chunked(spark, [("doc.txt", None, "hello world foo bar")], 10, 2)
    assert [(r["passage_id"], r["offset"], r["page"]) for r in one] == [("doc.txt#0", 0, None)]
    text = " ".join(f"w{i}" for i in range(10))
    got = chunked(spark, [("d", 3, text)], 4, 1)
    assert [r["ordinal"] for r in got] == [0, 1, 2] and got[0]["text"] == "w0 w1 w2 w3"
    assert got[1]["text"].startswith("w3 ") and got[1]["offset"] == text.index("w3") and got[2]["text"].endswith("w9")
    two = chunked(spark, [("d", 1, "alpha beta"), ("d", 2, "gamma delta")], 50, 5)
    assert [(r["page"], r["ordinal"]) for r in two] == [(1, 0), (2, 1)]


def test_chunks_leave_out_what_is_no_text(spark):
    assert chunked(spark, [("d", None, "".join(map(chr, range(1, 9))) * 4000 + "›ﬁﬂ‡·‚„‰" * 200), ("e", None, None), ("f", None, "  ")], 50, 5) == []
    kept = chunked(spark, [("d", None, "The quick\x00 brown fox\x07 jumps over the lazy dog")], 50, 5)
    assert len(kept) == 1 and "\x00" not in kept[0]["text"]
    ok = spark.createDataFrame([("a" * 250,), ("a" * 150,), ("检" * 250,), ("%%%%a",)], "t string").select(T.textual(F.col("t"))).collect()
    assert [r[0] for r in ok] == [False, True, True, False]


def test_offsets_count_code_points(spark):
    got = chunked(spark, [("d", None, "🙂🙂 aa bb cc")], 2, 0)
    assert [r["offset"] for r in got] == [0, 6]


@pytest.mark.parametrize(("word", "stem"), [("caresses", "caress"), ("ponies", "poni"), ("cats", "cat"), ("agreed", "agre"), ("plastered", "plaster"), ("motoring", "motor"), ("hopping", "hop"), ("falling", "fall"), ("filing", "file"), ("happy", "happi"), ("sky", "sky"), ("relational", "relat"), ("conditional", "condit"), ("vietnamization", "vietnam"), ("electriciti", "electr"), ("hopefulness", "hope"), ("adoption", "adopt"), ("probate", "probat"), ("cease", "ceas"), ("controll", "control"), ("roll", "roll"), ("retrieving", "retriev"), ("documents", "document"), ("by", "by")])
def test_stems(spark, word, stem):
    assert porter.stems(spark.createDataFrame([(word,)], "term string")).first().stem == stem


def test_terms(spark):
    row = spark.createDataFrame([("intro.tex a.bc.d don't 3.14 1,000.5 unique-token 信息检索 字",)], "t string").select(T.terms(F.col("t"))).first()[0]
    assert row == ["intro.tex", "a.bc.d", "don't", "3.14", "1,000.5", "unique", "token", "信息", "息检", "检索", "字"]


CORPUS = [
    ("passport_form.pdf#0", "please complete sign and return the attached form", "passport_form.pdf"),
    ("visa.pdf#0", "a valid passport is required for the visa appointment", "travel/visa.pdf"),
    ("noise.txt#0", "passport " * 30 + "quantum blockchain thermodynamics", "data/noise.txt"),
]


def search(spark, docs, query, language=sparse.PLAIN, **kw):
    p = spark.createDataFrame(docs, "passage_id string, text string, path string")
    q = spark.createDataFrame([(1, query)], "query_id int, query string")
    return [(r.passage_id, r.score) for r in sparse.bm25(sparse.Index.of(p, language), sparse.query_terms(q, language), **kw).orderBy("rank").collect()]


def test_file_names_outrank_repetition(spark):
    got = search(spark, CORPUS, "passport")
    assert [p for p, _ in got] == ["passport_form.pdf#0", "noise.txt#0", "visa.pdf#0"]
    assert [round(s, 2) for _, s in got] == [1.5, 0.45, 0.27]
    assert search(spark, CORPUS, "") == [] and search(spark, CORPUS, "zzz") == []


def test_two_languages(spark):
    docs = [("e#0", "retrieving relevant legal documents", "english.txt"), ("c#0", "信息检索与结果多样性", "chinese.txt")]
    assert search(spark, docs, "retrieval", "en+zh")[0][0] == "e#0"
    assert search(spark, docs, "信息检索")[0][0] == "c#0"
    assert {p for p, _ in search(spark, docs, "legal 多样性")} == {"e#0", "c#0"}


def test_norms_keep_four_bits(spark):
    rows = spark.createDataFrame([(n,) for n in (39, 40, 41, 42, 100, 512)], "dl int").select(sparse.norm(F.col("dl"), True)).collect()
    assert [r[0] for r in rows] == [39, 40, 40, 42, 96, 504]


def test_feedback_keeps_the_query_in_front(spark):
    p = spark.createDataFrame(CORPUS, "passage_id string, text string, path string")
    q = spark.createDataFrame([(1, "passport")], "query_id int, query string")
    assert sparse.bm25_prf(sparse.Index.of(p), q).orderBy("rank").first().passage_id in {"passport_form.pdf#0", "visa.pdf#0"}


def test_fusion(spark):
    mk = lambda rows: spark.createDataFrame([(1, i + 1, d, "p0", s) for i, (d, s) in enumerate(rows)], "query_id int, rank int, doc_id string, passage_id string, score double")
    got = fusion.reciprocal_rank({"sparse": mk([("a", 5.0), ("b", 4.0)]), "dense": mk([("b", 0.9), ("c", 0.8)])}).orderBy("rank").collect()
    assert [r.doc_id for r in got] == ["b", "a", "c"]
    assert got[0].score == pytest.approx(1 / 61 + 1 / 60) and got[0].source == "sparse"


TREE = ["readme.txt", "Taxes/2024/w2.pdf", "Taxes/2024/receipts.csv", "Taxes/2023/w2.pdf", "Recipes/pasta.md"]


def graph(spark, query, hops):
    p = spark.createDataFrame([(x,) for x in TREE], "path string")
    q = spark.createDataFrame([(1, query)], "query_id int, query string")
    return [r.path for r in folders.search(p, q, 10, hops).orderBy("rank").collect()]


def test_folder_search(spark):
    assert set(graph(spark, "taxes", 0)) == {x for x in TREE if x.startswith("Taxes")}
    assert set(graph(spark, "2024", 0)) == {"Taxes/2024/w2.pdf", "Taxes/2024/receipts.csv"}
    near = graph(spark, "2024", 1)
    assert "Taxes/2023/w2.pdf" in near and len(near) == len(set(near))
    assert graph(spark, "nothing", 1) == []


def test_folder_expansion_equals_pairs_of_siblings(spark):
    p = spark.createDataFrame([(x,) for x in TREE], "path string")
    seeds = spark.createDataFrame([(1, "Taxes/2024", 2.0)], "query_id int, folder string, score double")
    got = {r.folder: r.score for r in folders.expand(folders.folders(p), seeds, 1).collect()}
    assert got == {"Taxes/2024": 2.0, "Taxes": 1.0, "Taxes/2023": 1.0}


def test_depth_first_order(spark):
    want = ["a.txt", "b.txt", "B/x.md", "a/a.txt", "a/z.txt", "a/b/c.txt", "a-b/q.txt"]
    got = [r.p for r in spark.createDataFrame([(x,) for x in sorted(want)], "p string").orderBy(T.depth_first_key(F.col("p"))).collect()]
    assert got == want


def test_notes_link_up_and_down(spark):
    p = spark.createDataFrame([(x,) for x in TREE], "path string")
    lines = {(r.note, r.line) for r in folders.notes(p).collect()}
    assert {("Taxes.md", "- [[_root]]"), ("Taxes.md", "- [[Taxes/2024]]"), ("Taxes/2024.md", "- w2.pdf")} <= lines


def test_hash_vectors(spark):
    df = spark.createDataFrame([("a", "hello hello"), ("b", ""), ("c", None)], "k string, t string")
    assert [(r.id, r.bucket, r.weight) for r in dense.hash_embed(df, "k", "t").collect()] == [("a", 93, 1.0)]


def test_changes(spark):
    cols = "path string, size bigint, mtime double, content_hash string"
    known = spark.createDataFrame([("same", 1, 1.0, "x"), ("touched", 1, 1.0, "y"), ("edited", 1, 1.0, "z"), ("gone", 1, 1.0, "g"), ("nulls", 1, None, None)], cols)
    scan = spark.createDataFrame([("same", 1, 1.0, None), ("touched", 1, 2.0, "y"), ("edited", 2, 2.0, "w"), ("new", 1, 1.0, "n"), ("nulls", 1, None, None)], cols)
    got = {r.path: r.change for r in manifest.changes(scan, known).collect()}
    assert got == {"same": "unchanged", "touched": "unchanged", "edited": "modified", "gone": "deleted", "new": "added", "nulls": "unchanged"}


def test_globs(spark):
    p = spark.createDataFrame([(x,) for x in ("a.txt", "sub/b.md", "sub/c.log", ".git/config", "node_modules/x/r.md", "x/~$a.docx")], "p string")
    keep = lambda inc, exc: {r.p for r in p.filter(globs.selected(F.col("p"), inc, exc)).collect()}
    assert keep(["**/*"], []) == {"a.txt", "sub/b.md", "sub/c.log", "node_modules/x/r.md", "x/~$a.docx"}
    assert keep(Config().include, Config().exclude) == {"a.txt", "sub/b.md"}
    assert keep(["*.txt", "*.md", "!sub/*.md"], []) == {"a.txt", "node_modules/x/r.md"}


def office(files):
    b = io.BytesIO()
    with zipfile.ZipFile(b, "w") as z:
        for n, t in files.items():
            z.writestr(n, t)
    return b.getvalue()


W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
RELS = 'xmlns="http://schemas.openxmlformats.org/package/2006/relationships"'
R = 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
S = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
P = 'xmlns:p="http://schemas.openxmlformats.org/presentationml/2006/main" xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main"'
DOCX = office({"word/document.xml": f"<w:document {W}><w:body><w:p><w:r><w:t>One</w:t></w:r></w:p><w:p/><w:p><w:r><w:t>Two</w:t></w:r></w:p></w:body></w:document>"})
XLSX = office({
    "xl/workbook.xml": f'<workbook {S} {R}><sheets><sheet name="Costs" sheetId="1" r:id="rId1"/></sheets></workbook>',
    "xl/_rels/workbook.xml.rels": f'<Relationships {RELS}><Relationship Id="rId1" Target="worksheets/sheet1.xml"/></Relationships>',
    "xl/sharedStrings.xml": f"<sst {S}><si><t>rent</t></si></sst>",
    "xl/worksheets/sheet1.xml": f'<worksheet {S}><sheetData><row><c t="s"><v>0</v></c><c><v>12</v></c></row><row/></sheetData></worksheet>',
})
PPTX = office({
    "ppt/presentation.xml": f'<p:presentation {P} {R}><p:sldIdLst><p:sldId id="1" r:id="rId2"/><p:sldId id="2" r:id="rId1"/></p:sldIdLst></p:presentation>',
    "ppt/_rels/presentation.xml.rels": f'<Relationships {RELS}><Relationship Id="rId1" Target="slides/slide1.xml"/><Relationship Id="rId2" Target="slides/slide2.xml"/></Relationships>',
    **{f"ppt/slides/slide{i}.xml": f"<p:sld {P}><p:cSld><p:spTree><p:sp><p:txBody><a:p><a:r><a:t>slide {i}</a:t></a:r></a:p></p:txBody></p:sp></p:spTree></p:cSld></p:sld>" for i in (1, 2)},
})


def test_office_files():
    assert extract.docx(DOCX) == [(None, "One\nTwo")]
    assert extract.xlsx(XLSX) == [(1, "Costs\nrent 12")]
    assert extract.pptx(PPTX) == [(1, "slide 2"), (2, "slide 1")]


def test_extraction_by_kind(spark):
    rows = [("a.txt", b"plain"), ("b.txt", b"\xff\xfe"), ("c.docx", DOCX), ("d.docx", b"broken"), ("e.bin", b"x"), ("f.txt", b"  ")]
    df = spark.createDataFrame([(p, bytearray(d)) for p, d in rows], "path string, content binary")
    assert {(r.path, r.text) for r in extract.pages(df).collect()} == {("a.txt", "plain"), ("c.docx", "One\nTwo")}


def test_snippets(spark):
    df = spark.createDataFrame([("---\ntags: x\n---\nAbout  the\nattention layer",)], "t string")
    assert df.select(T.match_snippet(T.without_front_matter(F.col("t")), F.lit("attention"))).first()[0] == "About the attention layer"
    row = spark.createDataFrame([("The cat (a+b) sat",)], "t string").select(T.highlight(F.col("t"), F.lit("the (a+b)"))).first()
    assert row[0] == "<mark>The</mark> cat <mark>(a+b)</mark> sat"


def test_config(tmp_path):
    f = tmp_path / "c.toml"
    f.write_text('include = ["*.md"]\n[chunk]\nsize = 9\n')
    c = load(str(tmp_path / "none.toml"), str(f))
    assert c.chunk.size == 9 and c.chunk.overlap == 64 and c.include == ("*.md",) and c.graph == Graph()
    f.write_text("[chunk]\nnope = 1\n")
    with pytest.raises(TypeError):
        load(str(f))
