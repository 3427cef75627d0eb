"""Settings of the engine, with their defaults, and reading them from TOML."""

from __future__ import annotations

import tomllib
from dataclasses import dataclass, field, fields, replace

# Document and image types included by default, and what is always left out.
DOC_TYPES = (
    "pdf doc docx ppt pptx xls xlsx rtf odt ods odp txt md markdown rst tex csv tsv json jsonl"
).split()
IMAGE_TYPES = "png jpg jpeg gif bmp tif tiff webp svg heic heif".split()
EXCLUDE = [
    "**/.git/**", "**/node_modules/**", "**/.venv/**", "**/venv/**", "**/site-packages/**", "**/__pycache__/**",
    "**/.cache/**", "**/.tox/**", "**/.mypy_cache/**", "**/.pytest_cache/**", "**/.Trash/**", "**/~$*", "**/.dropbox.cache/**",
]


@dataclass(frozen=True)
class Chunk:
    size: int = 512
    overlap: int = 64


@dataclass(frozen=True)
class Ingest:
    ocr: bool = False
    ocr_min_chars: int = 16


@dataclass(frozen=True)
class Sparse:
    enabled: bool = True
    prf: bool = False
    fb_docs: int = 10
    fb_terms: int = 10
    language: str = "en+zh"
    field_boosts: dict = field(default_factory=lambda: {"contents": 1.0, "filename": 2.0, "pathtext": 1.0})
    k1: float = 0.9
    b: float = 0.4
    quantize_norms: bool = True


@dataclass(frozen=True)
class Dense:
    enabled: bool = False
    embedder: str = "hash"
    model: str | None = None
    dim: int = 256


@dataclass(frozen=True)
class Kb:
    enabled: bool = False
    vault: str | None = None
    hops: int = 1
    search_limit: int = 10


@dataclass(frozen=True)
class Graph:
    enabled: bool = True
    hops: int = 1
    max_folders: int = 5


@dataclass(frozen=True)
class Config:
    chunk: Chunk = Chunk()
    ingest: Ingest = Ingest()
    sparse: Sparse = Sparse()
    dense: Dense = Dense()
    kb: Kb = Kb()
    graph: Graph = Graph()
    include: tuple = tuple(f"**/*.{e}" for e in DOC_TYPES + IMAGE_TYPES)
    exclude: tuple = tuple(EXCLUDE)

    def merged(self, data: dict) -> Config:
        """Sections merge key by key; lists and boosts are replaced whole; an unknown key is an error."""
        out = {}
        for f in fields(self):
            if f.name in data:
                now, new = getattr(self, f.name), data[f.name]
                out[f.name] = tuple(new) if isinstance(now, tuple) else replace(now, **new)
        return replace(self, **out)


def load(*paths: str) -> Config:
    """Defaults, then each TOML file that exists, in turn."""
    c = Config()
    for p in paths:
        try:
            with open(p, "rb") as f:
                c = c.merged(tomllib.load(f))
        except FileNotFoundError:
            pass
    return c
