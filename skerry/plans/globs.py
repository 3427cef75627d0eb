"""Gitignore-style patterns as regular expressions for the whole relative path."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def regex(glob: str) -> str:
    """A pattern without a slash (but at its end) matches at any depth; one that names a folder matches all in it."""
    g = glob.strip()
    anchored = "/" in g.rstrip("/")
    g = g.lstrip("/")
    folder = g.endswith("/")
    g = g.rstrip("/")
    out, i = "", 0
    while i < len(g):
        if g.startswith("**/", i):
            out += "(?:.*/)?"
            i += 3
        elif g.startswith("**", i):
            out += ".*"
            i += 2
        elif g[i] == "*":
            out += "[^/]*"
            i += 1
        elif g[i] == "?":
            out += "[^/]"
            i += 1
        elif g[i] == "[" and "]" in g[i + 2 :]:
            j = g.index("]", i + 2)
            out += "[" + ("^" + g[i + 2 : j] if g[i + 1] == "!" else g[i + 1 : j]) + "]"
            i = j + 1
        else:
            out += re.escape(g[i])
            i += 1
    return f"^{'' if anchored else '(?:.*/)?'}{out}{'/.*' if folder else '(?:/.*)?'}$"


def matches(path: Column, globs: list[str] | tuple[str, ...]) -> Column:
    """Whether the last pattern that matches isn't negated. One expression a run of patterns of the same sign."""
    hit: Column = F.lit(False)
    run: list[str] = []
    sign = True

    def close(hit: Column) -> Column:
        if not run:
            return hit
        return F.when(path.rlike("|".join(run)), F.lit(sign)).otherwise(hit)

    for g in globs:
        s = not g.startswith("!")
        if s != sign:
            hit, run, sign = close(hit), [], s
        run.append(regex(g.lstrip("!")))
    return close(hit)


def selected(path: Column, include, exclude) -> Column:
    """Included, and neither excluded nor in an excluded folder or ``.git``."""
    return matches(path, tuple(include)) & ~matches(path, tuple(exclude)) & ~path.rlike(r"(^|/)\.git(/|$)")
