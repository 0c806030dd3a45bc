"""Dry runs: all that a load would stop at, without writing anything that stays.

Layer A compiles each entity with all its events and checks references against what the sources will provide. Layer B loads into a
scratch folder and checks the target's constraints there. The same Columns make the rows in a load, so the two can't drift.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweave.functions.keys import NAMESPACE
from docweave.operators.compile import as_document, compile_entity, matches
from docweave.operators.lookup import empty_id_map
from docweave.operators.merge import violations
from docweave.plans.catalog import Catalog, only
from docweave.plans.mapping import Entity, Mapping
from docweave.sources.collections import Collections
from docweave.sources.store import Store

#: Errors that a report lists at most.
CAP = 200


@dataclass(frozen=True)
class Violation:
    entity: str
    source_id: str | None
    field: str
    message: str
    severity: str = "error"


@dataclass
class Report:
    violations: list[Violation] = field(default_factory=list)
    truncated: bool = False
    layers: str = "A"

    @property
    def ok(self) -> bool:
        """Nothing that stops a load, as far as was looked: a list cut short doesn't count as clean."""
        return not self.truncated and not any(v.severity == "error" for v in self.violations)


def future_ids(mapping: Mapping, sources: Collections, external: DataFrame) -> DataFrame:
    """A map of the ids that loading all entities would leave, source ids standing in for new ones; entities that skip documents count all."""
    out = external
    for name, e in mapping.entities.items():
        docs = as_document(sources.read(e.source))
        if e.filter:
            docs = docs.filter(matches(F.col("_doc"), docs.schema["_doc"].dataType, e.filter.field, e.filter.equals))
        out = out.unionByName(docs.select(F.lit(name).alias("entity"), F.col("_sid").alias("source_id"), F.col("_sid").alias("target_id"), F.lit(None).cast("timestamp").alias("loaded_at")))
    return out


def entity_violations(name: str, entity: Entity, source: DataFrame, ids: DataFrame, catalog: Catalog | None, namespace: str = NAMESPACE, sample: int | None = None) -> DataFrame:
    """(entity, table, source_id, field, message, severity): every error of every row, and what a policy covers as information."""
    if sample is not None:
        source = source.orderBy("_id").limit(sample)
    # New ids stand for themselves here, so keys of integer columns aren't judged.
    made = compile_entity(name, entity, source, ids, catalog, namespace, every_error=True)
    return made.events.select(F.lit(name).alias("entity"), "table", "source_id", "field", "message", F.when(F.col("kind") == "E", "error").otherwise("info").alias("severity"))


def fast_pass(mapping: Mapping, sources: Collections, catalog: Catalog | None = None, external: DataFrame | None = None, namespace: str = NAMESPACE, sample: int | None = None, cap: int = CAP) -> Report:
    """Layer A. Errors are listed up to the cap; what policies cover is told in one line a field, however much it is."""
    spark = sources.spark
    ids = future_ids(mapping, sources, empty_id_map(spark) if external is None else external)
    loose = catalog and Catalog({n: _loose(t) for n, t in catalog.tables.items()}, catalog.name)
    report = Report()
    for name in mapping.load_order():
        found = entity_violations(name, mapping.entities[name], sources.read(mapping.entities[name].source), ids, loose, namespace, sample)
        errors = found.filter(F.col("severity") == "error").orderBy("source_id", "table", "field").limit(cap + 1).collect()
        report.truncated |= len(errors) > cap
        report.violations += [Violation(name, r["source_id"], r["field"], r["message"]) for r in errors[:cap]]
        for r in found.filter(F.col("severity") == "info").groupBy("field").agg(F.count(F.lit(1)).alias("n"), F.min("source_id").alias("first")).orderBy("field").collect():
            report.violations.append(Violation(name, r["first"], r["field"], f"{r['n']} rows are covered by a policy", "info"))
    return report


def _loose(table):
    """A table whose keys are text: source ids stand in for new ones in a dry run."""
    from dataclasses import replace

    keys = {*table.primary_key, *(k.column for k in table.foreign_keys)}
    return replace(table, columns={n: replace(c, type="text") if n in keys and not c.is_serial else c for n, c in table.columns.items()})


def realistic_pass(mapping: Mapping, sources: Collections, catalog: Catalog, scratch: str, external: DataFrame | None = None, namespace: str = NAMESPACE) -> Report:
    """Layer B: a load into a scratch store, which is deleted afterwards, and all constraints between the tables that it loads."""
    from docweave.streaming.load import LoadError, load

    spark = sources.spark
    tables = [t for e in mapping.entities.values() for t in e.tables()]
    scratch = f"{scratch}/dry-run-{uuid.uuid4().hex}"  # the folder itself may hold what isn't ours to delete
    store, report = Store(spark, scratch, only(catalog, tables)), Report(layers="B")
    try:
        if external is not None:
            state = store.begin()
            for e in mapping.external_entities:
                state.add_ids(e, external.filter(F.col("entity") == e))
            state.publish()
        local = Mapping(mapping.entities, mapping.external_entities, {}, mapping.excluded_collections)
        try:
            load(local, sources, store, "append", namespace=namespace)
        except (LoadError, RuntimeError) as e:
            report.violations.append(Violation("load", None, "", str(e)))
            return report
        broken = violations({t: store.read(t) for t in dict.fromkeys(tables) if store.manifest()["tables"].get(t)}, store.catalog)
        rows = broken.limit(CAP + 1).collect() if broken is not None else []
        report.truncated = len(rows) > CAP
        report.violations += [Violation(r["table"], r["value"], r["constraint"], f"{r['n']} rows") for r in rows[:CAP]]
        return report
    finally:
        store._fs.delete(store._path(scratch), True)


def dry_run(mapping: Mapping, sources: Collections, catalog: Catalog | None = None, scratch: str | None = None, external: DataFrame | None = None, namespace: str = NAMESPACE, sample: int | None = None, force: bool = False) -> Report:
    """Layer A, and B with a scratch folder if A is clean or if forced."""
    first = fast_pass(mapping, sources, catalog, external, namespace, sample)
    if scratch is None or catalog is None or not (first.ok or force):
        return first
    second = realistic_pass(mapping, sources, catalog, scratch, external, namespace)
    return Report(first.violations + second.violations, first.truncated or second.truncated, "AB")
