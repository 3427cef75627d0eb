"""Search and index functions that take and give plain values, for servers and tools."""

from __future__ import annotations

from skerry.engine import Engine

K_MOST = 50


def _rows(df) -> list[dict]:
    return [r.asDict() for r in df.orderBy("rank").collect()]  # at most k rows


def _k(k: int) -> int:
    return min(K_MOST, max(1, k))


def search_sparse(engine: Engine, query: str, k: int = 10, prf: bool = False) -> list[dict]:
    return _rows(engine.search_sparse(query, _k(k), prf))


def search_dense(engine: Engine, query: str, k: int = 10) -> list[dict]:
    return _rows(engine.search_dense(query, _k(k)))


def search_kb(engine: Engine, query: str, k: int = 10) -> list[dict]:
    return _rows(engine.search_kb(query, _k(k)))


def search_graph(engine: Engine, query: str, k: int = 10) -> list[dict]:
    return _rows(engine.search_graph(query, _k(k)))


def search_hybrid(engine: Engine, query: str, k: int = 10, retrievers: list[str] | None = None, prf: bool = False) -> dict:
    h = engine.search_hybrid(query, _k(k), retrievers, prf)
    return {"results": _rows(h.results), "used": h.used, "skipped": h.skipped}


def index_status(engine: Engine, check_staleness: bool = True) -> dict:
    return engine.status(check_staleness)


def reindex(engine: Engine, full: bool = False) -> dict:
    return engine.reindex(full)
