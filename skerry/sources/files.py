"""Walking a folder: a scan of files with their paths relative to the root."""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Callable

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skerry.config import Config
from skerry.plans import globs
from skerry.sources import extract
from skerry.tables import cut


#: Folders known from which a walk stops going level by level and lets tasks walk whole subtrees.
ENOUGH_FOLDERS = 1_000


def _place(root: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a folder, and the folder's name there."""
    if re.match(r"(?!file:)[a-z0-9]+:", root):
        fs, base = pafs.FileSystem.from_uri(root)
        return fs, base.rstrip("/")
    return pafs.LocalFileSystem(), os.path.abspath(re.sub("^file:/+", "/", root)).rstrip("/")


def _pruned(exclude: tuple) -> Callable[[str], bool]:
    """Whether a folder is left out with all that is in it. Patterns that take something back in are left to the filter."""
    out = [] if any(g.startswith("!") for g in exclude) else [re.compile(globs.regex(g), re.S) for g in exclude]
    return lambda folder: folder.rsplit("/", 1)[-1] == ".git" or any(p.match(f"{folder}/\0") for p in out)


def scan(spark: SparkSession, root: str, conf: Config = Config()) -> DataFrame:
    """``path, size, mtime`` of the files under ``root`` that the patterns keep, empty ones too. No file is opened. Folders
    that are left out aren't entered, links to folders aren't followed. The walk is spread over tasks: level by level, a
    folder a row, until there are many folders; then each task walks the folders under its own. The driver lists nothing."""
    excluded = tuple(conf.exclude)
    schema = "path string, size bigint, mtime double, folder boolean"

    def lister(whole: bool):
        def run(batches):
            (fs, base), pruned = _place(root), _pruned(excluded)
            local = isinstance(fs, pafs.LocalFileSystem)
            for b in batches:
                todo = b.column(0).to_pylist()
                while todo:
                    folder = todo.pop()
                    rows = []
                    for f in fs.get_file_info(pafs.FileSelector(f"{base}/{folder}" if folder else base or "/", allow_not_found=True)):
                        path = f"{folder}/{f.base_name}" if folder else f.base_name
                        if f.type == pafs.FileType.Directory:
                            if pruned(path) or local and os.path.islink(f.path):
                                continue
                            if whole:
                                todo.append(path)
                            else:
                                rows.append((path, None, None, True))
                        elif f.type == pafs.FileType.File:
                            rows.append((path, f.size, f.mtime_ns / 1e9 if f.mtime_ns else None, False))
                    if rows:
                        cols = list(zip(*rows))
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.float64(), pa.bool_()))], names=["path", "size", "mtime", "folder"])

        return run

    level, found = spark.createDataFrame([("",)], "path string"), None
    while True:
        known = level.count()
        whole = known > ENOUGH_FOLDERS
        got = cut(level.repartition(max(1, min(known, 10 * spark.sparkContext.defaultParallelism)), "path").mapInArrow(lister(whole), schema))
        files = got.filter("NOT folder").select("path", "size", "mtime")
        found = files if found is None else found.unionByName(files)
        level = got.filter("folder").select("path")
        if level.isEmpty():
            return found.filter(globs.selected(F.col("path"), conf.include, conf.exclude))


def opened(root: str, wanted: DataFrame, conf: Config = Config(), full: bool = False) -> DataFrame:
    """``path, content_hash, changed, error, pages`` of the files in ``wanted`` (``path, content_hash``: the hash known so
    far, or null). Each file named is opened once, and no other; it is hashed, and taken apart if its hash is new."""
    def run(batches):
        fs, base = _place(root)
        for b in batches:
            for path, known in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                digest, changed, error, pages = None, True, None, []
                try:
                    with fs.open_input_stream(f"{base}/{path}") as f:
                        data = f.read()
                    digest = hashlib.sha256(data).hexdigest()
                    changed = full or digest != known
                    pages = extract.read(path, data, conf.ingest) if changed else []
                except Exception as e:  # noqa: BLE001 - a broken file is known by its name only
                    error = f"{type(e).__name__}: {e}"
                rows = pa.array([[{"page": n, "text": t} for n, t in pages]], pa.list_(pa.struct([("page", pa.int32()), ("text", pa.string())])))
                yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([digest], pa.string()), pa.array([changed]), pa.array([error], pa.string()), rows], names=["path", "content_hash", "changed", "error", "pages"])

    n = max(1, int(wanted.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return wanted.select("path", "content_hash").repartition(n, "path").mapInArrow(run, "path string, content_hash string, changed boolean, error string, pages array<struct<page: int, text: string>>")


def write_texts(rows: DataFrame, root: str) -> None:
    """A UTF-8 file for each ``path, text``, under ``root``; paths are distinct."""
    def run(batches):
        fs, base = _place(root)
        for b in batches:
            for path, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                name = f"{base}/{path}"
                fs.create_dir(name.rsplit("/", 1)[0], recursive=True)
                with fs.open_output_stream(name) as f:
                    f.write(text.encode())
            yield b.select([0])

    rows.select("path", "text").mapInArrow(run, "path string").write.format("noop").mode("overwrite").save()
