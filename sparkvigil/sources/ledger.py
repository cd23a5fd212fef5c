"""Several tables committed at once: rows become visible by one manifest, written last."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


class Ledger:
    """Tables under a folder that all executors share, written together or not at all.

    A commit writes each table's rows to a folder of their own, then a manifest that names those folders, under the commit's name (query and
    batch). Readers follow manifests only: what a failed or repeated commit left behind is never seen. The manifest takes
    its name by a rename that fails if the name is taken, so of two commits of one name one wins. That takes a file system
    whose rename does so (HDFS, local disks). Manifests are small: one a batch, with one folder a table.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _fs(self, path: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()), at

    def _manifest(self, query: str, batch: int) -> str:
        return f"{self.path}/_manifests/{query}-{batch:012d}.json"

    def holds(self, query: str, batch: int) -> bool:
        """Whether the batch has been committed."""
        fs, at = self._fs(self._manifest(query, batch))
        return fs.exists(at)

    def commit(self, query: str, batch: int, tables: dict[str, DataFrame], facts: dict | None = None) -> bool:
        """Commit ``tables`` (by name) and ``facts`` (small values, the batch's watermark say); False if this batch is in already."""
        if self.holds(query, batch):
            return False
        folders = {}
        for name, rows in tables.items():
            folder = f"{self.path}/{name}/{query}-{batch:012d}-{uuid.uuid4().hex}"
            rows.write.parquet(folder)
            folders[name] = {"folder": folder, "schema": rows.schema.json()}
        return self._publish(query, batch, json.dumps({"query": query, "batch": batch, "tables": folders, "facts": facts or {}}))

    def _publish(self, query: str, batch: int, text: str) -> bool:
        fs, taken = self._fs(self._manifest(query, batch))
        _, made = self._fs(f"{self.path}/_manifests/.{uuid.uuid4().hex}")
        out = fs.create(made, False)
        out.write(bytearray(text.encode()))
        out.close()
        # a local rename would replace the file of another commit
        if fs.exists(taken) or not fs.rename(made, taken):
            fs.delete(made, False)
            return False
        return True

    def manifests(self, query: str | None = None) -> list[dict]:
        """All commits, or those of one query, in the order of their names."""
        fs, at = self._fs(f"{self.path}/_manifests")
        if not fs.exists(at):
            return []
        names = sorted(s.getPath().toString() for s in fs.listStatus(at) if s.getPath().getName().endswith(".json"))
        if not names:
            return []
        found = [json.loads(r[0]) for r in self.spark.read.text(names, wholetext=True).collect()]
        return sorted((m for m in found if query in (None, m["query"])), key=lambda m: (m["query"], m["batch"]))

    def read(self, name: str, query: str | None = None) -> DataFrame | None:
        """The committed rows of a table; None before its first commit. Columns that only later commits have are null in earlier ones."""
        held = [m["tables"][name] for m in self.manifests(query) if name in m["tables"]]
        if not held:
            return None
        by_schema: dict[str, list[str]] = {}
        for t in held:
            by_schema.setdefault(t["schema"], []).append(t["folder"])
        parts = [self.spark.read.schema(StructType.fromJson(json.loads(s))).parquet(*folders) for s, folders in by_schema.items()]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p, allowMissingColumns=True)
        return out
