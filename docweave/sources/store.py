"""The target: versioned tables under one root, published by manifests.

Every write goes to a folder of its own. A manifest names, for each table, the folders that make it up, together with the id maps and
checkpoints that belong to that state; renaming one manifest into place publishes all of it at once. A run that dies before the rename
leaves the old state, and its folders are never read. Files are handled through Hadoop's file systems, so a root may be on any store
that Spark writes to.
"""

from __future__ import annotations

import json
import uuid
from copy import deepcopy
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from docweave.operators.lookup import ID_MAP, empty_id_map
from docweave.plans.catalog import Catalog, TableDef


class PublishConflict(RuntimeError):
    """Another run published first."""


class Store:
    def __init__(self, spark: SparkSession, root: str, catalog: Catalog | None = None):
        self.spark, self.root, self.catalog = spark, root.rstrip("/"), catalog
        self._jvm = spark._jvm
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, p: str) -> Any:
        return self._jvm.org.apache.hadoop.fs.Path(p)

    def _manifests(self) -> list[int]:
        folder = self._path(f"{self.root}/_manifests")
        if not self._fs.exists(folder):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)]
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def manifest(self) -> dict[str, Any]:
        """The published state: version, tables, id_map, and checkpoints."""
        found = self._manifests()
        if not found:
            return {"version": 0, "tables": {}, "id_map": {}, "checkpoints": {}, "sequences": {}}
        stream = self._fs.open(self._path(f"{self.root}/_manifests/{found[-1]}.json"))
        try:
            return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def tables(self) -> list[str]:
        return sorted(self.manifest()["tables"])

    def read(self, table: str, manifest: dict[str, Any] | None = None) -> DataFrame:
        folders = (manifest or self.manifest())["tables"].get(table, [])
        schema = self.catalog[table].schema() if self.catalog else None
        if not folders:
            if schema is None:
                raise ValueError(f"{table} is empty, and no catalogue says what it looks like")
            return self.spark.createDataFrame([], schema)
        made = self.spark.read.parquet(*folders)
        return made if schema is None else made.select(*(made[c.name].cast(c.spark) if c.name in made.columns else _null(c) for c in self.catalog[table].columns.values()))

    def id_map(self, entities: list[str] | None = None, manifest: dict[str, Any] | None = None) -> DataFrame:
        """Ids of the named entities, or of all. Each entity's are in folders of their own, so others aren't read."""
        told = (manifest or self.manifest())["id_map"]
        folders = [f for e, fs in told.items() if entities is None or e in entities for f in fs]
        return self.spark.read.schema(ID_MAP).parquet(*folders) if folders else empty_id_map(self.spark)

    def begin(self) -> Staged:
        return Staged(self, self.manifest())


def _null(c: Any) -> Any:
    from pyspark.sql import functions as F

    return F.lit(c.default if c.default and c.default.replace(".", "").isdigit() else None).cast(c.spark).alias(c.name)


class Staged:
    """A state in the making: nothing of it shows until publish()."""

    def __init__(self, store: Store, manifest: dict[str, Any]):
        self.store, self.state = store, deepcopy(manifest)
        self.run = uuid.uuid4().hex[:12]
        self._n = 0

    def folder(self, what: str) -> str:
        self._n += 1
        return f"{self.store.root}/{what}/v={self.state['version'] + 1}-{self.run}-{self._n}"

    def write(self, df: DataFrame, what: str) -> str:
        df.write.parquet(to := self.folder(what))
        return to

    def keep(self, df: DataFrame) -> DataFrame:
        """df written to the run's work folder and read again: its rows, ids included, are then what they are."""
        return self.store.spark.read.schema(df.schema).parquet(self.write(df, f"_work/{self.run}"))

    def empty(self, tables: list[str]) -> None:
        for t in tables:
            self.state["tables"][t] = []

    def append(self, table: str, df: DataFrame) -> DataFrame:
        to = self.write(df, f"tables/{table}")
        self.state["tables"].setdefault(table, []).append(to)
        return self.store.spark.read.schema(df.schema).parquet(to)

    def replace(self, table: str, df: DataFrame) -> None:
        self.state["tables"][table] = [self.write(df, f"tables/{table}")]

    def read(self, table: str) -> DataFrame:
        return self.store.read(table, self.state)

    def id_map(self, entities: list[str] | None = None) -> DataFrame:
        return self.store.id_map(entities, self.state)

    def add_ids(self, entity: str, df: DataFrame, replace: bool = False) -> None:
        to = self.write(df, f"id_map/{entity}")
        self.state["id_map"][entity] = [to] if replace else [*self.state["id_map"].get(entity, []), to]

    def checkpoint(self, entity: str, last: Any, kind: str, rows: int, status: str = "running") -> None:
        self.state["checkpoints"][entity] = {"last": last, "type": kind, "rows_loaded": rows, "status": status}

    def publish(self) -> int:
        """Makes the state the published one, or fails if another run was faster."""
        version = self.state["version"] + 1
        self.state["version"] = version
        fs, path = self.store._fs, self.store._path
        fs.mkdirs(path(f"{self.store.root}/_manifests"))
        draft, final = path(f"{self.store.root}/_manifests/.{version}-{self.run}"), path(f"{self.store.root}/_manifests/{version}.json")
        stream = fs.create(draft, True)
        stream.write(bytearray(json.dumps(self.state, indent=1).encode()))
        stream.close()
        if fs.exists(final) or not fs.rename(draft, final):
            raise PublishConflict(f"version {version} was published by another run")
        fs.delete(path(f"{self.store.root}/_work/{self.run}"), True)
        return version


def table_columns(d: TableDef) -> list[str]:
    return list(d.columns)
