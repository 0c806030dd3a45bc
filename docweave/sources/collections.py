"""Where documents come from: parquet folders and tables (typed), JSON lines (variant), and frames in memory."""

from __future__ import annotations

import os
import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.operators.lookup import ID_MAP, empty_id_map


class Collections:
    """A registry of named collections. Each is given as a frame or a function that reads one."""

    def __init__(self, spark: SparkSession, given: dict[str, DataFrame | Callable[[], DataFrame]] | None = None):
        self.spark, self.given = spark, dict(given or {})

    def names(self) -> list[str]:
        return sorted(self.given)

    def read(self, name: str) -> DataFrame:
        if name not in self.given:
            raise KeyError(f"no collection {name!r}; there are {', '.join(self.names()) or 'none'}")
        found = self.given[name]
        return found() if callable(found) else found

    def __contains__(self, name: str) -> bool:
        return name in self.given


def json_documents(spark: SparkSession, path: str, id_field: str = "_id") -> DataFrame:
    """(_id, doc) from JSON lines: whole documents as variants, with ids apart so that filters on them reach the scan. {"$oid": x} is x."""
    lines = spark.read.text(path).filter(F.trim("value") != "")
    doc = lines.select(F.parse_json("value").alias("doc"))
    return doc.select(F.coalesce(F.try_variant_get("doc", f"$.{id_field}.$oid", "string"), F.try_variant_get("doc", f"$.{id_field}", "string")).alias("_id"), "doc")


def from_folder(spark: SparkSession, folder: str) -> Collections:
    """One collection for each <name>.parquet, <name>.json or <name>.jsonl that the folder holds."""
    fs_path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    found = {}
    for s in fs_path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(fs_path):
        name, end = os.path.splitext(s.getPath().getName())
        at = str(s.getPath())
        if end == ".parquet":
            found[name] = lambda at=at: spark.read.parquet(at)
        elif end in (".json", ".jsonl"):
            found[name] = lambda at=at: json_documents(spark, at)
    return Collections(spark, found)


def external_id_maps(spark: SparkSession, databases: dict[str, str]) -> DataFrame:
    """The ids of external entities, each from the store whose root an environment variable names; a store is opened once."""
    from docweave.sources.store import Store

    out = empty_id_map(spark)
    stores: dict[str, Store] = {}
    for entity, variable in databases.items():
        root = os.environ.get(variable)
        if not root:
            raise KeyError(f"{entity}: the environment variable {variable} isn't set")
        store = stores.setdefault(root, Store(spark, root))
        out = out.unionByName(store.id_map([entity]))
    return out


def id_map_from_ddl() -> str:
    return ID_MAP


def redacted(text: str) -> str:
    """Text with passwords in URLs and connection strings starred out."""
    text = re.sub(r"(\w[\w+.-]*://[^:/@\s]+):[^@\s]+@", r"\1:***@", text)
    return re.sub(r"(?i)\b(password|passwd|pwd)=('[^']*'|\S+)", r"\1=***", text)
