"""The load: entities in order of their dependencies, in bounded batches if asked for, resumable, published atomically.

A run reads a source once for each batch, writes the resolved rows, derives all tables from them, and publishes tables, ids and
checkpoint in one manifest. Killed at any point, it goes on from what was published last.
"""

from __future__ import annotations

import logging
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docweave.functions.keys import NAMESPACE, uuid5
from docweave.operators import merge
from docweave.operators.compile import Compiled, as_document, compile_entity, matches
from docweave.operators.lookup import require_loaded, upsert_id_map
from docweave.plans.catalog import Catalog
from docweave.plans.mapping import Entity, Mapping, MappingError, structure_issues
from docweave.sources.collections import Collections, external_id_maps
from docweave.sources.store import Staged, Store

log = logging.getLogger(__name__)
MODES = ("truncate", "append", "upsert")


class LoadError(RuntimeError):
    """A load that stopped; nothing of the batch at hand was published."""


@dataclass
class EntityResult:
    rows: dict[str, int] = field(default_factory=dict)
    nulled: dict[str, int] = field(default_factory=dict)
    skipped: dict[str, int] = field(default_factory=dict)
    status: str = "done"


@dataclass
class Summary:
    entities: dict[str, EntityResult] = field(default_factory=dict)

    def total(self, table: str) -> int:
        return sum(r.rows.get(table, 0) for r in self.entities.values())


class Progress:
    """Tells at most every so many seconds."""

    def __init__(self, tell: Callable[[str], None] | None = None, every: float = 5.0, clock: Callable[[], float] = time.monotonic):
        self.tell, self.every, self.clock, self.last = tell or log.info, every, clock, float("-inf")

    def __call__(self, message: str, now: bool = False) -> None:
        if now or self.clock() - self.last >= self.every:
            self.last = self.clock()
            self.tell(message)


def chosen(mapping: Mapping, only: list[str] | None) -> list[str]:
    """The entities to load, in the order of the whole mapping. Unknown names are an error before anything is touched."""
    if stray := set(only or ()) - set(mapping.entities):
        raise MappingError(f"unknown entities: {', '.join(sorted(stray))}; there are {', '.join(sorted(mapping.entities))}")
    return [e for e in mapping.load_order() if not only or e in only]


def load(mapping: Mapping, sources: Collections, store: Store, mode: str, only: list[str] | None = None, namespace: str = NAMESPACE, batch_size: int | None = None, progress: Progress | None = None) -> Summary:
    """Loads entities. truncate empties the chosen entities' tables, ids and checkpoints first; append and upsert go on from checkpoints."""
    if mode not in MODES:
        raise ValueError(f"mode is one of {', '.join(MODES)}, not {mode!r}")
    if broken := [i for i in structure_issues(mapping) if i.severity == "error"]:
        raise MappingError("; ".join(f"{i.where}: {i.message}" for i in broken))
    order = chosen(mapping, only)
    progress = progress or Progress()
    staged = store.begin()
    if mode == "truncate":
        staged.empty([t for e in order for t in mapping.entities[e].tables()])
        for e in order:
            staged.state["checkpoints"].pop(e, None)
            staged.state["id_map"].pop(e, None)
        staged.publish()
    out, external = Summary(), external_id_maps(store.spark, mapping.external_databases) if mapping.external_databases else None
    for name in order:
        out.entities[name] = load_entity(name, mapping.entities[name], sources.read(mapping.entities[name].source), store, mode, namespace, batch_size, progress, external)
    return out


def cursor(checkpoint: dict[str, Any] | None, kind: T.DataType) -> Any:
    """The last _id seen, in the type of the ids: as text, 10 would come before 9."""
    if not checkpoint or checkpoint["last"] is None:
        return None
    return F.lit(checkpoint["last"]).cast(kind)


def batches(docs: DataFrame, size: int | None) -> Iterator[tuple[DataFrame, Any]]:
    """Documents in slices by _id and the last _id of each. Borders come from one sorted pass that returns a row a slice."""
    if size is None:
        top = docs.agg(F.max("_oid").cast("string").alias("m")).first()["m"]
        if top is not None:
            yield docs, top
        return
    from docweave.functions.keys import with_sequence

    kind = docs.schema["_oid"].dataType
    placed = with_sequence(docs.select("_oid"), ["_oid"], "_n")
    ends = [r["m"] for r in placed.groupBy(F.floor((F.col("_n") - 1) / size).alias("b")).agg(F.max("_oid").alias("o")).orderBy("b").select(F.col("o").cast("string").alias("m")).collect()]
    last = None
    for end in ends:
        part = docs.filter(F.col("_oid") <= F.lit(end).cast(kind))
        yield part if last is None else part.filter(F.col("_oid") > F.lit(last).cast(kind)), end
        last = end


def load_entity(name: str, entity: Entity, source: DataFrame, store: Store, mode: str, namespace: str, batch_size: int | None, progress: Progress, external: DataFrame | None, mark: tuple[str, int] | None = None) -> EntityResult:
    staged = store.begin()
    before = staged.state["checkpoints"].get(name)
    kind = as_document(source).schema["_oid"].dataType
    check_namespace(name, entity, staged, before, source, namespace)
    result = EntityResult()
    docs = as_document(source)
    if entity.filter:
        docs = docs.filter(matches(F.col("_doc"), docs.schema["_doc"].dataType, entity.filter.field, entity.filter.equals))
    if (after := cursor(before, kind)) is not None:
        docs = docs.filter(F.col("_oid") > after)
    rows = (before or {}).get("rows_loaded", 0)
    id_col = "_id"
    seen = False
    for part, end in batches(docs, batch_size):
        seen = True
        staged = store.begin()
        ids = staged.id_map(sorted(entity.lookups()))
        if external is not None:
            ids = ids.unionByName(external)
        flat = part.select(F.col("_oid").alias(id_col), F.col("_doc").alias("doc")) if source.columns == [id_col, "doc"] else part.select("_doc.*")
        entity_once = Entity(**{**entity.__dict__, "filter": None})
        made = compile_entity(name, entity_once, flat, ids, store.catalog, namespace, sequences=staged.state["sequences"], keep=staged.keep)
        count_events(name, entity, made, ids, result)
        for table, n in write(entity, made, staged, mode, store.catalog).items():
            result.rows[table] = result.rows.get(table, 0) + n
        if entity.id_strategy.type != "serial":
            if mode == "upsert" and name in staged.state["id_map"]:
                staged.add_ids(name, upsert_id_map(staged.id_map([name]), made.id_map), replace=True)
            else:
                staged.add_ids(name, made.id_map)
        staged.checkpoint(name, end, kind.simpleString(), rows + result.rows.get(entity.target, 0))
        if mark:
            staged.state.setdefault("streams", {})[mark[0]] = mark[1]
        staged.publish()
        progress(f"{name}: up to {end}")
    staged = store.begin()
    state = staged.state["checkpoints"].setdefault(name, {"last": None, "type": kind.simpleString(), "rows_loaded": 0, "status": "running"})
    if not seen and state["status"] == "done":
        result.status = "already_done"
        return result
    state["status"] = "done"
    staged.publish()
    progress(f"{name}: done", now=True)
    return result


def check_namespace(name: str, entity: Entity, staged: Staged, before: dict[str, Any] | None, source: DataFrame, namespace: str) -> None:
    """A resumed load must derive the same uuids as before: the checkpoint's row tells."""
    if not before or before["last"] is None or entity.id_strategy.type != "objectid_to_uuid" or entity.id_strategy.source_field != "_id":
        return
    row = staged.id_map([name]).filter(F.col("source_id") == before["last"]).select("target_id", uuid5(F.col("source_id"), namespace).alias("now")).first()
    if row and row["target_id"] != row["now"]:
        raise LoadError(f"{name}: ids were made in another namespace before; going on would give the same documents other ids")


def count_events(name: str, entity: Entity, made: Compiled, ids: DataFrame, result: EntityResult) -> None:
    """Errors stop the load; skips and nulled references are counted by field."""
    by = made.events.groupBy("table", "field", "kind").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("source_id", "message")).alias("first")).collect()
    wrong = sorted((r["table"], r["field"], r["n"], r["first"]["source_id"], r["first"]["message"]) for r in by if r["kind"] == "E")
    if wrong:
        raise LoadError("; ".join(f"{t}.{f}: {m} (document {s}, {n} in all)" for t, f, n, s, m in wrong[:5]))
    for r in by:
        kept = result.skipped if r["kind"] == "S" else result.nulled
        kept[r["field"]] = kept.get(r["field"], 0) + r["n"]
    missed = {e for e in entity.lookups() if result.skipped or result.nulled}
    if missed:
        soft = made.events.filter(F.col("kind").isin("S", "N"))
        require_loaded(ids, {e: soft.filter(F.startswith("message", F.lit(f"{e} has no "))) for e in sorted(missed)})


def write(entity: Entity, made: Compiled, staged: Staged, mode: str, catalog: Catalog | None) -> dict[str, int]:
    """Parents before children, all into the staged state. Returns the rows of each table."""
    counts: dict[str, int] = {}
    uniques = {u.target: [u.parent_fk.target_field, u.code_column] for u in entity.unpivot.values()}
    pairs = {j.target: [j.parent_fk.target_field, j.child_fk.target_field] for j in entity.junction.values()}
    serials = {e.target: e.id_strategy.target_field for _, e in entity.all_explodes() if e.id_strategy.type in ("serial", "int_sequence")}
    if entity.id_strategy.type == "int_sequence":
        serials[entity.target] = entity.id_strategy.target_field
    for table, df in made.tables().items():
        key = list(catalog[table].primary_key) if catalog and catalog[table].primary_key else [entity.id_strategy.target_field] if table == entity.target else []
        fresh = staged.store.spark.read.parquet(staged.write(df, f"tables/{table}"))
        folder = fresh.inputFiles()
        counts[table] = fresh.count()
        where = staged.state["tables"]
        this = "/".join(folder[0].split("/")[:-1]) if folder else None
        had = bool(where.get(table))
        if mode == "upsert" and had and (table == entity.target or table in pairs or table in uniques):
            if table == entity.target:
                if not fresh.groupBy(*key).count().filter("count > 1").isEmpty():
                    raise LoadError(f"{table}: two rows of one batch have the same key")
                staged.replace(table, merge.upsert(staged.read(table), fresh, key, [c for c in fresh.columns if c not in key]))
            elif table in pairs:
                staged.replace(table, merge.insert_missing(staged.read(table), fresh, pairs[table]))
            else:
                staged.replace(table, merge.upsert(staged.read(table), fresh, uniques[table], [c for c in fresh.columns if c not in uniques[table]]))
        elif this:
            if had and table == entity.target and key and not merge.conflicts(staged.read(table), fresh, key).isEmpty():
                raise LoadError(f"{table}: rows with these keys are there already; load with mode upsert, or truncate first")
            if mode == "upsert" and table in pairs:
                staged.replace(table, fresh.dropDuplicates(pairs[table]))
            else:
                where.setdefault(table, []).append(this)
        if table in serials and serials[table] in fresh.columns:
            top = fresh.agg(F.max(F.col(serials[table]).cast("long")).alias("m")).first()["m"]
            if top is not None:
                staged.state["sequences"][table] = max(top + 1, staged.state["sequences"].get(table, 1))
    return counts


def stream_load(mapping: Mapping, name: str, stream: DataFrame, store: Store, checkpoint: str, mode: str = "upsert", namespace: str = NAMESPACE):
    """An entity fed by a file stream: all that is there now in micro-batches, each loaded as a batch of its own, and then it ends.

    A batch's number is published with its rows, so that one that is replayed, as its stream stopped before it could commit, changes nothing.
    """

    def one(batch: DataFrame, number: int) -> None:
        state = store.begin()
        if state.state.get("streams", {}).get(checkpoint, -1) >= number:
            return
        docs = batch.persist()
        try:
            state.state["checkpoints"].pop(name, None)  # files, not ids, say what is new
            state.publish()
            load_entity(name, mapping.entities[name], docs, store, mode, namespace, None, Progress(), None, (checkpoint, number))
        finally:
            docs.unpersist()

    return stream.writeStream.trigger(availableNow=True).option("checkpointLocation", checkpoint).foreachBatch(one).start()
