"""A first mapping, proposed from profiles and a catalogue by names and keys. What is not certain is listed for a reader."""

from __future__ import annotations

import difflib
import json
import re
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field, replace

from docweave.plans.catalog import Catalog, TableDef
from docweave.plans.mapping import Entity, Explode, FieldSpec, ForeignKeyRef, IdStrategy, Junction, Mapping, Unmapped

#: Likeness of names from which a match is taken, and from which it needs no word.
ACCEPT, SURE = 0.55, 0.85


@dataclass(frozen=True)
class Note:
    entity: str
    field: str
    message: str


@dataclass
class Proposal:
    mapping: Mapping
    notes: list[Note] = field(default_factory=list)


def normalized(name: str) -> str:
    """snake_case."""
    return re.sub(r"[^a-z0-9]+", "_", re.sub(r"(?<=[a-z0-9])(?=[A-Z])", "_", name).lower()).strip("_")


def singular(name: str) -> str:
    for end, to in (("ies", "y"), ("sses", "ss"), ("xes", "x")):
        if name.endswith(end):
            return name[: -len(end)] + to
    return name[:-1] if name.endswith("s") and not name.endswith("ss") else name


def likeness(a: str, b: str) -> float:
    return difflib.SequenceMatcher(None, normalized(a), normalized(b)).ratio()


def best(name: str, among: Iterable[str], least: float = ACCEPT) -> tuple[str, float] | None:
    """The likest of some names, the first by name if several are."""
    found = max(((likeness(name, a), a) for a in sorted(among, reverse=True)), default=None, key=lambda x: x[0])
    return (found[1], found[0]) if found and found[0] >= least else None


def match_table(collection: str, catalog: Catalog) -> tuple[str, float] | None:
    plain, one = best(collection, catalog.tables), best(singular(normalized(collection)), catalog.tables)
    return max((m for m in (plain, one) if m), key=lambda m: m[1], default=None)


def fk_column(table: TableDef, parent: str) -> str | None:
    return next((k.column for k in table.foreign_keys if k.table == parent), None)


def child_table(parent: str, name: str, catalog: Catalog) -> str | None:
    """parent_name, singular(parent)_name, or name, if they refer to the parent; else the likest that does."""
    for n in (f"{parent}_{normalized(name)}", f"{singular(parent)}_{normalized(name)}", normalized(name)):
        if n in catalog and fk_column(catalog[n], parent):
            return n
    found = best(name, [t for t, d in catalog.tables.items() if fk_column(d, parent) and t != parent])
    return found[0] if found else None


def junction_table(parent: str, name: str, catalog: Catalog) -> str | None:
    """A table with two references or more, one of them to the parent; of several the likest."""
    found = [t for t, d in catalog.tables.items() if len({k.table for k in d.foreign_keys}) >= 2 and fk_column(d, parent)]
    return max(sorted(found), key=lambda t: likeness(t, f"{singular(parent)}_{name}"), default=None)


def id_strategy(table: TableDef) -> tuple[IdStrategy, str | None]:
    """By the primary key's type, and what to say about it."""
    if len(table.primary_key) != 1:
        return IdStrategy("passthrough", "_id"), f"{table.name} has no single-column primary key"
    c = table.columns[table.primary_key[0]]
    kind = "objectid_to_uuid" if "uuid" in c.type else "int_sequence" if re.search("int|serial", c.type) else "passthrough"
    return IdStrategy(kind, "_id", c.name), None


def entity_for(stem: str, entities: Iterable[str]) -> str | None:
    """The entity that a reference's name speaks of (userId, user_ids)."""
    names = sorted(entities)
    scored = max(((max(likeness(stem, n), likeness(stem, singular(normalized(n)))), n) for n in reversed(names)), default=None, key=lambda x: x[0])
    return scored[1] if scored and scored[0] >= SURE else None


def reference_stem(name: str) -> str | None:
    m = re.match(r"(.+?)_?ids?$", normalized(name))
    return m[1] if m and m[1] else None


def propose_field(path: str, table: TableDef, entities: Iterable[str], notes: list[Note], entity: str, taken: set[str]) -> FieldSpec | None:
    leaf = path.split(".")[-1]
    found = best(leaf, set(table.columns) - taken)
    if not found:
        return None
    column, how = found
    if how < SURE:
        notes.append(Note(entity, path, f"taken for {column}, with a likeness of {how:.2f}"))
    stem = reference_stem(leaf)
    lookup = entity_for(stem, entities) if stem else None
    transform = "cast_timestamptz" if "timestamp" in table.columns[column].type and not lookup else None
    return FieldSpec(column, transform, lookup)


def propose_entity(name: str, fields: list[dict], catalog: Catalog, entities: Iterable[str], target: str) -> tuple[Entity, list[Note]]:
    table, notes = catalog[target], []
    strategy, said = id_strategy(table)
    if said:
        notes.append(Note(name, "_id", said))
    specs: dict[str, FieldSpec] = {}
    explodes: dict[str, Explode] = {}
    junctions: dict[str, Junction] = {}
    left: list[str] = []
    taken = {strategy.target_field}
    inside = lambda p, q: q.startswith(f"{p}.") and "[]" not in q
    for f in fields:
        path = f["path"]
        if path == "_id" or "[]" in path or f["types"] == ["object"]:
            continue
        if len(f["types"]) > 1:
            notes.append(Note(name, path, f"has several types: {', '.join(f['types'])}"))
        if f["is_array"] and "." not in path:
            to = child_table(target, path, catalog) if f["item_kind"] == "object" else junction_table(target, path, catalog)
            if to is None:
                left.append(path)
                notes.append(Note(name, path, "is an array for which no table was found"))
                continue
            child, parent = catalog[to], fk_column(catalog[to], target)
            up = ForeignKeyRef(parent, f"{target}.{next(k.target for k in child.foreign_keys if k.column == parent)}")
            if f["item_kind"] == "object":
                own: dict[str, FieldSpec] = {}
                rest: list[str] = []
                used = {parent, *child.primary_key}
                for g in fields:
                    if g["path"].startswith(f"{path}[].") and "[]" not in g["path"][len(path) + 3 :]:
                        leaf = g["path"][len(path) + 3 :]
                        spec = propose_field(leaf, child, entities, notes, name, used)
                        if spec:
                            own[leaf] = spec
                            used.add(spec.target)
                        elif "." not in leaf:
                            rest.append(leaf)
                explodes[path] = Explode(to, IdStrategy("serial", None, child.primary_key[0] if len(child.primary_key) == 1 else "id"), up, own, {}, residual(name, rest, child, notes, f"{path}[]."))
            else:
                k = next((k for k in child.foreign_keys if k.column != parent), None)
                stem = reference_stem(path) or path
                junctions[path] = Junction(to, up, ForeignKeyRef(k.column, f"{k.table}.{k.target}", entity_for(stem, entities) or next((e for e in sorted(entities) if e == k.table), None)))
            continue
        spec = propose_field(path, table, entities, notes, name, taken)
        if spec:
            specs[path] = spec
            taken.add(spec.target)
        elif "." not in path:
            left.append(path)
        elif not any(inside(p, path) for p in specs):
            notes.append(Note(name, path, "no column was found"))
    return Entity(name, target, strategy, specs, explodes, junctions, {}, residual(name, left, table, notes, "")), notes


def residual(entity: str, names: list[str], table: TableDef, notes: list[Note], prefix: str) -> Unmapped:
    """Packed into the table's JSON column, if it has one, else dropped; said either way."""
    if not names:
        return Unmapped()
    column = next((c.name for c in table.columns.values() if c.is_json), None)
    notes += [Note(entity, f"{prefix}{n}", f"no column was found: {'packed into ' + column if column else 'dropped'}") for n in names]
    return Unmapped((), tuple(names), column) if column else Unmapped(tuple(names))


def propose(profiles: Iterable, catalog: Catalog) -> Proposal:
    """A mapping of all profiled collections that have a table; the others are excluded, which is noted."""
    profiles = list(profiles)
    found = {p.name: match_table(p.name, catalog) for p in profiles}
    names = [p.name for p in profiles if found[p.name]]
    out, notes, excluded = {}, [], []
    for p in profiles:
        if not found[p.name]:
            excluded.append(p.name)
            notes.append(Note(p.name, "", "no table was found"))
            continue
        table, how = found[p.name]
        if how < SURE:
            notes.append(Note(p.name, "", f"taken for table {table}, with a likeness of {how:.2f}"))
        out[p.name], more = propose_entity(p.name, p.fields, catalog, names, table)
        notes += more
        if p.polymorphic:
            notes.append(Note(p.name, p.discriminator or "", "documents have several shapes" + (f"; {p.discriminator} tells them apart, so filtered entities may fit" if p.discriminator else "")))
    return Proposal(Mapping(out, (), {}, tuple(excluded)), notes)


# Suggestions by a language model: an interface, without a client. It sees names and types only.


@dataclass(frozen=True)
class Suggestion:
    field: str
    column: str
    transform: str | None = None


def payload(profile, table: TableDef, entity: Entity) -> str:
    """What a model is told: fields without a column, with their types, and columns without a field."""
    told = {f.target for f in entity.fields.values()} | {entity.id_strategy.target_field}
    return json.dumps(
        {
            "collection": profile.name,
            "fields": [{"path": f["path"], "types": f["types"]} for f in profile.fields if f["path"] in entity.unmapped.named],
            "table": table.name,
            "columns": [{"name": c.name, "type": c.type, "nullable": c.nullable} for c in table.columns.values() if c.name not in told],
        },
        sort_keys=True,
    )


def apply_suggestions(entity: Entity, table: TableDef, given: Iterable[Suggestion]) -> tuple[Entity, list[Note]]:
    """Suggestions that name an unmapped field and a free column of the table; others are refused and noted."""
    specs, notes, unmapped = dict(entity.fields), [], entity.unmapped
    taken = {f.target for f in specs.values()} | {entity.id_strategy.target_field}
    for s in given:
        if s.field not in unmapped.named:
            notes.append(Note(entity.source, s.field, "suggested, but not an unmapped field"))
        elif s.column not in table.columns or s.column in taken:
            notes.append(Note(entity.source, s.field, f"suggested column {s.column!r} doesn't exist or is taken"))
        else:
            specs[s.field] = FieldSpec(s.column, s.transform)
            taken.add(s.column)
            rest = tuple(n for n in unmapped.jsonb if n != s.field)
            unmapped = Unmapped(tuple(n for n in unmapped.drop if n != s.field), rest, unmapped.jsonb_column if rest else None)
            notes.append(Note(entity.source, s.field, f"suggested: {s.column}"))
    return replace(entity, fields=specs, unmapped=unmapped), notes


def enrich(proposal: Proposal, profiles: Iterable, catalog: Catalog, suggest: Callable[[str], Iterable[Suggestion]]) -> Proposal:
    entities, notes = dict(proposal.mapping.entities), list(proposal.notes)
    for p in profiles:
        if p.name in entities:
            e = entities[p.name]
            entities[p.name], more = apply_suggestions(e, catalog[e.target], suggest(payload(p, catalog[e.target], e)))
            notes += more
    return Proposal(replace(proposal.mapping, entities=entities), notes)
