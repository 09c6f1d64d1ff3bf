"""Graphs that are kept in an SQLite file: to read as they are, and to copy into a store."""

from __future__ import annotations

import sqlite3
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekeep.lineage import shared_folder
from lorekeep.sources.store import TABLES, ReadSurfaceMissing, Store

# What the file calls these columns.
NAMES = {"run_id": "ingest_run_id"}
RENAMED_IN = ("nodes", "node_revisions")
#: Rows that the driver holds at once.
CHUNK = 50_000


class SqliteGraph(Store):
    """Read only.  A table that the file lacks is refused, never answered as empty; columns that it lacks are null."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        super().__init__(spark, path)
        self.exported: dict[str, str] = {}

    def _connect(self) -> sqlite3.Connection:
        return sqlite3.connect(f"file:{self.path}?mode=ro", uri=True)

    def manifest(self) -> dict:
        with self._connect() as db:
            found = {name for (name,) in db.execute("SELECT name FROM sqlite_master WHERE type = 'table'")}
        return {"version": 0, "tables": {}, "surface": sorted(found & set(TABLES)), "audit_head": None}

    def read(self, table: str, manifest: dict | None = None, scope: str | None = None, where: Column | None = None, low: list | None = None, high: list | None = None) -> DataFrame:
        if table not in (manifest or self.manifest())["surface"]:
            raise ReadSurfaceMissing(f"{self.path} keeps no {table}")
        if table not in self.exported:
            self.exported[table] = self._export(table)
        wanted = [x.split(" ", 1) for x in TABLES[table].split(", ")]
        raw = self.spark.read.schema(", ".join(f"{c} string" for c, _ in wanted)).parquet(self.exported[table])
        read_as = {"boolean": lambda c: F.col(c).cast("int").cast("boolean"), "date": lambda c: F.try_to_date(c)}
        rows = raw.select(*[read_as.get(kind, lambda c, kind=kind: F.col(c).cast(kind))(c).alias(c) for c, kind in wanted])
        if table == "contradictions":
            rows = rows.withColumn("scope", F.coalesce("scope", F.lit("*")))
        rows = rows if scope is None else rows.where(F.col("scope") == scope)
        return rows if where is None else rows.where(where)

    def _export(self, table: str) -> str:
        """The table's rows as text, chunk by chunk, in the shared folder."""
        where = f"{shared_folder(self.spark)}/sqlite-{uuid.uuid4().hex}"
        with self._connect() as db:
            there = {row[1] for row in db.execute(f"PRAGMA table_info({table})")}
            columns = [x.split()[0] for x in TABLES[table].split(", ")]
            stored = {c: NAMES.get(c, c) if table in RENAMED_IN else c for c in columns}
            chosen = [c for c in columns if stored[c] in there]
            rows = db.execute(f"SELECT {', '.join(f'CAST({stored[c]} AS TEXT)' for c in chosen)} FROM {table}")
            schema = ", ".join(f"{c} string" for c in chosen)
            self.spark.createDataFrame([], schema).write.parquet(where)
            while chunk := rows.fetchmany(CHUNK):
                self.spark.createDataFrame(chunk, schema).write.mode("append").parquet(where)
        return where

    def commit(self, base: dict, changed: dict[str, DataFrame], notes: dict | None = None, renewed: tuple[str, ...] = ()) -> dict:
        raise ReadSurfaceMissing("an SQLite graph is read only here; copy it into a parquet: store")


def copy_graph(source: Store, target: Store) -> dict:
    """Every table that ``source`` keeps, in one commit to an empty ``target``."""
    base = target.manifest()
    if base["version"]:
        raise ValueError("the target holds a graph already")
    return target.commit(base, {t: source.read(t) for t in source.manifest()["surface"]})
