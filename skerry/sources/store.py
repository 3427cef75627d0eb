"""A versioned store of the index tables as Parquet.

Every table is a set of parts, by a hash of its key; a commit writes the parts it touches into folders of
the new version and then one small file that names, for each table, the version of every part. That file
appears in one step under its own number and nothing is deleted before, so readers see one version or the
next, never a mixture; a run that breaks off leaves no trace but unused folders, and of two runs at once the
second fails. Tables and settings a commit doesn't name stay as they were.

A table is either replaced part by part (``upsert``), written whole (``replace``) or grows by segments (``append``).
"""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

PARTS = 8  #: parts of a table unless told otherwise; a large store wants thousands


class Store:
    def __init__(self, spark: SparkSession, root: str, parts: int = PARTS):
        self.spark, self.root, self._parts = spark, root.rstrip("/"), parts
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    # What there is

    def _names(self, folder: str) -> list[str]:
        p = self._path(f"{self.root}/{folder}")
        return [f.getPath().getName() for f in self._fs.listStatus(p)] if self._fs.exists(p) else []

    def versions(self) -> list[int]:
        return sorted(int(m[1]) for n in self._names("versions") if (m := re.fullmatch(r"(\d+)\.json", n)))

    def meta(self, version: int | None = None) -> dict:
        all_ = self.versions()
        if not all_:
            return {}
        stream = self._fs.open(self._path(f"{self.root}/versions/{version or all_[-1]}.json"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    @property
    def version(self) -> int:
        return max(self.versions(), default=0)

    @property
    def parts(self) -> int:
        return self.meta().get("parts", self._parts)

    def exists(self) -> bool:
        return self.version > 0

    def has(self, name: str) -> bool:
        return name in self.meta().get("tables", {})

    def part_of(self, key: str | Column) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.parts)).cast("int")

    def segments(self, name: str) -> int:
        return len({v for v, _ in self.meta().get("tables", {}).get(name, {}).get("at", ())})

    def table(self, name: str, parts: set[int] | None = None) -> DataFrame:
        """A table as last committed; of ``parts`` only, if named: other folders aren't listed or opened."""
        meta = self.meta()
        if not meta:
            raise FileNotFoundError(f"no index at {self.root}; build it first")
        if name not in meta["tables"]:
            raise FileNotFoundError(f"the index at {self.root} has no {name}; build it first")
        t = meta["tables"][name]
        schema = StructType.fromJson(t["schema"])
        paths = [f"{self.root}/{name}/v={v}/part={p}" for v, p in t["at"] if parts is None or p in parts]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    # Committing

    def commit(self, upsert: dict | None = None, replace: dict | None = None, append: dict | None = None, drop: tuple = (), **settings) -> int:
        """One new version. ``upsert``: name to (key column, frame of changed keys, new rows); ``replace`` and ``append``:
        name to (key column, rows). ``drop``: tables to leave out."""
        old = self.meta()
        v, parts = self.version + 1, self.parts
        tables = {n: t for n, t in old.get("tables", {}).items() if n not in drop}
        for name, (key, changed, rows) in (upsert or {}).items():
            if name in tables:
                touched = {r.p for r in changed.select(self.part_of(key).alias("p")).distinct().collect()}  # at most the parts
                kept = self.table(name, touched).join(changed.select(key).distinct(), key, "left_anti")
                rows = kept.unionByName(rows.select(*kept.columns))
                at = [x for x in tables[name]["at"] if x[1] not in touched]
            else:
                at = []
            tables[name] = self._write(name, key, rows, v, at)
        for name, (key, rows) in (replace or {}).items():
            tables[name] = self._write(name, key, rows, v, [])
        for name, (key, rows) in (append or {}).items():
            tables[name] = self._write(name, key, rows, v, tables.get(name, {}).get("at", []))
        kept = {k: x for k, x in old.items() if k not in ("tables", "version", "parts")}
        self._publish(v, {**kept, **settings, "version": v, "parts": parts, "tables": tables})
        return v

    def _write(self, name: str, key: str, rows: DataFrame, v: int, at: list) -> dict:
        folder = f"{self.root}/{name}/v={v}"
        # Rebalanced by part: a large part is several tasks and files, small ones are one.
        rows.withColumn("part", self.part_of(key)).hint("rebalance", "part").write.mode("overwrite").partitionBy("part").parquet(folder)
        new = sorted(int(m[1]) for n in self._names(f"{name}/v={v}") if (m := re.fullmatch(r"part=(\d+)", n)))
        return {"schema": json.loads(rows.schema.json()), "at": [*at, *([v, p] for p in new)]}

    def _publish(self, v: int, meta: dict) -> None:
        new, cur = self._path(f"{self.root}/versions/.{v}.tmp"), self._path(f"{self.root}/versions/{v}.json")
        out = self._fs.create(new, True)
        out.write(bytearray(json.dumps(meta).encode()))
        out.close()
        if self._fs.exists(cur) or not self._fs.rename(new, cur):
            raise OSError(f"version {v} of {self.root} was committed by another run")

    def tidy(self, keep: int = 2) -> None:
        """Deletes versions but the last ``keep``, and folders of parts that none of these names."""
        last = self.versions()[-keep:]
        if not last:
            return
        used: dict[str, set[int]] = {}
        for v in last:
            for name, t in self.meta(v)["tables"].items():
                used.setdefault(name, set()).update(x for x, _ in t["at"])
        for v in self.versions()[:-keep]:
            self._fs.delete(self._path(f"{self.root}/versions/{v}.json"), False)
        for name in self._names(""):
            if name == "versions":
                continue
            for n in self._names(name):
                if (m := re.fullmatch(r"v=(\d+)", n)) and int(m[1]) <= last[-1] and int(m[1]) not in used.get(name, ()):
                    self._fs.delete(self._path(f"{self.root}/{name}/{n}"), True)
