"""Text of files by type. Kinds are told by extension; office formats are read with the standard library."""

from __future__ import annotations

import io
import os
import shutil
import subprocess
import zipfile
from collections.abc import Callable
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skerry.config import IMAGE_TYPES, Ingest
from skerry.functions import text as T

# Extensions read as plain text.
TEXT_TYPES = (
    "txt md markdown rst log csv tsv"
    " json jsonl yaml yml toml ini cfg"
    " html htm xml tex"
    " py js ts tsx jsx java c h cpp hpp"
    " cc go rs rb php sh bash zsh sql"
    " css scss swift kt scala r m pl"
).split()
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
_P = "{http://schemas.openxmlformats.org/presentationml/2006/main}"
_S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"


def kind(path: Column) -> Column:
    """text, pdf, docx, pptx, xlsx, or name only."""
    e = T.extension(path)
    out = F.when(e.isin(TEXT_TYPES), "text")
    for x in ("pdf", "docx", "pptx", "xlsx"):
        out = out.when(e == x, x)
    return out.otherwise("name only")


def docx(data: bytes) -> list[tuple[int | None, str]]:
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{_W}body")
    lines = ["".join(t.text or "" for t in p.iter(f"{_W}t")) for p in body.findall(f"{_W}p")]
    text = "\n".join(x for x in lines if x.strip())
    return [(None, text)] if text else []


def _rels(z: zipfile.ZipFile, part: str) -> dict[str, str]:
    folder, name = part.rsplit("/", 1)
    root = ElementTree.fromstring(z.read(f"{folder}/_rels/{name}.rels"))
    return {r.get("Id"): (r.get("Target").lstrip("/") if r.get("Target").startswith("/") else f"{folder}/{r.get('Target')}") for r in root}


def pptx(data: bytes) -> list[tuple[int | None, str]]:
    """A page a slide, in order of the presentation; text frames of shapes only."""
    out = []
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        rels = _rels(z, "ppt/presentation.xml")
        ids = ElementTree.fromstring(z.read("ppt/presentation.xml")).iter(f"{_P}sldId")
        for n, s in enumerate(ids, 1):
            tree = ElementTree.fromstring(z.read(rels[s.get(f"{_R}id")]))
            frames = []
            for shape in tree.iter(f"{_P}sp"):
                body = shape.find(f"{_P}txBody")
                if body is not None:
                    frames.append("\n".join("".join(t.text or "" for t in p.iter(f"{_A}t")) for p in body.findall(f"{_A}p")))
            text = "\n".join(x for x in frames if x.strip())
            if text:
                out.append((n, text))
    return out


def xlsx(data: bytes) -> list[tuple[int | None, str]]:
    """A page a sheet: its title, then a line a row with the filled cells."""
    out = []
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = set(z.namelist())
        shared = []
        if "xl/sharedStrings.xml" in names:
            shared = ["".join(t.text or "" for t in si.iter(f"{_S}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{_S}si")]
        rels = _rels(z, "xl/workbook.xml")
        for n, sheet in enumerate(ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{_S}sheet"), 1):
            lines = []
            for row in ElementTree.fromstring(z.read(rels[sheet.get(f"{_R}id")])).iter(f"{_S}row"):
                cells = []
                for c in row.findall(f"{_S}c"):
                    v = c.find(f"{_S}v")
                    if c.get("t") == "inlineStr":
                        cells.append("".join(t.text or "" for t in c.iter(f"{_S}t")))
                    elif v is not None and v.text:
                        cells.append(shared[int(v.text)] if c.get("t") == "s" else v.text)
                line = " ".join(x for x in cells if x.strip())
                if line:
                    lines.append(line)
            if lines:
                out.append((n, "\n".join([sheet.get("name") or "", *lines]).strip()))
    return out


def pdf(data: bytes, conf: Ingest = Ingest()) -> list[tuple[int | None, str]]:
    """With a PDF reader installed, a page a page; a page with little text is read from its picture, if that is asked
    for and a reader of pictures is registered. Without a PDF reader the file stays known by name."""
    try:
        import fitz
    except ImportError:
        return []
    out = []
    with fitz.open(stream=data, filetype="pdf") as doc:
        for n, page in enumerate(doc, 1):
            text = page.get_text()
            if conf.ocr and OCR and len(text.strip()) < conf.ocr_min_chars:
                text = OCR[0](page.get_pixmap(dpi=200).tobytes("png")) or text
            if text.strip():
                out.append((n, text))
    return out


def doc(data: bytes) -> list[tuple[int | None, str]]:
    """Old Word files, by a converter of the system if there is one; else they stay known by name."""
    for tool, args in (("textutil", ["-convert", "txt", "-stdout", "-stdin"]), ("antiword", ["-"]), ("catdoc", ["-"])):
        if shutil.which(tool):
            got = subprocess.run([tool, *args], input=data, capture_output=True, timeout=60)
            text = got.stdout.decode("utf-8", "replace") if got.returncode == 0 else ""
            return [(None, text)] if text.strip() else []
    return []


def text(data: bytes) -> list[tuple[int | None, str]]:
    """Strict UTF-8, else nothing."""
    try:
        t = data.decode("utf-8")
    except UnicodeDecodeError:
        return []
    return [(None, t)] if t.strip() else []


READERS: dict[str, Callable[[bytes], list[tuple[int | None, str]]]] = {"text": text, "docx": docx, "pptx": pptx, "xlsx": xlsx, "pdf": pdf, "doc": doc}
"""By kind; others may be registered."""
OCR: list[Callable[[bytes], str]] = []
"""At most one reader of pictures: from the bytes of a picture to its text."""


def reader(path: str, conf: Ingest = Ingest()) -> Callable | None:
    """What reads a file, by its extension in either case; pictures only where that is asked for and a reader is registered."""
    ext = os.path.splitext(path.rsplit("/", 1)[-1])[1][1:].lower()
    if ext in IMAGE_TYPES and ext not in READERS:
        return (lambda data: [(None, t)] if (t := OCR[0](data)).strip() else []) if conf.ocr and OCR else None
    if ext == "pdf":
        return lambda data: READERS["pdf"](data, conf) if READERS["pdf"] is pdf else READERS["pdf"](data)
    return READERS.get("text" if ext in TEXT_TYPES else ext)


def supported(path: str, conf: Ingest = Ingest()) -> bool:
    return reader(path, conf) is not None


def read(path: str, data: bytes, conf: Ingest = Ingest()) -> list[tuple[int | None, str]]:
    """Pages of a file; none for a kind without a reader."""
    f = reader(path, conf)
    return f(data) if f else []


def pages(files: DataFrame) -> DataFrame:
    """``path, page, text`` of ``path, content``. Plain text stays in the JVM (strict UTF-8, else nothing);
    other kinds go through their reader; a file that can't be read gives no row."""
    files = files.withColumn("kind", kind(F.col("path")))
    plain = files.filter("kind = 'text'").select("path", F.lit(None).cast("int").alias("page"), F.try_validate_utf8(F.col("content").cast("string")).alias("text"))
    plain = plain.filter("text IS NOT NULL AND trim(text) <> ''")

    def run(batches):
        for b in batches:
            rows = []
            for path, data, k in zip(*(c.to_pylist() for c in b.columns)):
                try:
                    rows += [(path, n, t) for n, t in read(path, data)]
                except Exception:  # noqa: BLE001 - a broken file is known by its name only
                    continue
            cols = list(zip(*rows)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.string())], names=["path", "page", "text"])

    other = files.filter(F.col("kind").isin([k for k in READERS if k != "text"])).select("path", "content", "kind").mapInArrow(run, "path string, page int, text string")
    return plain.unionByName(other)


