"""From an entity of a mapping to DataFrames: its table's rows, the rows below them, the new ids, and what went wrong.

A document is one struct (or variant) column. All references of a level are joined, then every field is one Column whose
value and event are computed in the same projection. Documents' events are ordered as their fields are: of those that end a
row (error, skip) the first counts, and it hides the later ones.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docweave.functions.keys import NAMESPACE, new_id, with_sequence
from docweave.functions.paths import get_array, get_path, json_of, packed
from docweave.functions.transforms import Value, compile_transform, default_of, value, with_default
from docweave.operators.lookup import EVENT, event, lookup, missing_event
from docweave.plans.catalog import Catalog, ColumnDef, TableDef
from docweave.plans.mapping import Entity, Explode, FieldSpec, IdStrategy


@dataclass
class Compiled:
    """What one entity makes of its documents. `events` has (table, source_id, field, kind, message, place); place is the event's order in its row."""

    main: tuple[str, DataFrame]
    children: dict[str, DataFrame] = field(default_factory=dict)
    junctions: dict[str, DataFrame] = field(default_factory=dict)
    unpivots: dict[str, DataFrame] = field(default_factory=dict)
    id_map: DataFrame | None = None
    events: DataFrame | None = None
    documents: DataFrame | None = None
    #: How many arrays feed each table, and where the serial numbers of those that several feed go on.
    feeds: Counter[str] = field(default_factory=Counter)
    numbers: dict[str, int] = field(default_factory=dict)

    def tables(self) -> dict[str, DataFrame]:
        return {self.main[0]: self.main[1], **self.children, **self.junctions, **self.unpivots}


def as_document(df: DataFrame, id_col: str = "_id") -> DataFrame:
    """(_oid, _sid, _doc): the typed id, its text, and all columns as one struct; pruning reaches through it to the scan."""
    if df.columns == [id_col, "doc"]:
        return df.select(F.col(id_col).alias("_oid"), F.col(id_col).cast("string").alias("_sid"), F.col("doc").alias("_doc"))
    return df.select(F.col(id_col).alias("_oid"), F.col(id_col).cast("string").alias("_sid"), F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("_doc"))


def matches(root: Column, kind: T.DataType, path: str, equals: str | int | bool) -> Column:
    """Equality with a literal of the literal's own type: true is not 1."""
    v = get_path(root, kind, path)
    want = {bool: T.BooleanType(), int: T.LongType(), str: T.StringType()}[type(equals)]
    if isinstance(v.type, T.VariantType):
        from docweave.functions.transforms import variant_kind

        names = {bool: ["BOOLEAN"], int: ["BIGINT", "DOUBLE"], str: ["STRING"]}[type(equals)]
        return variant_kind(v.column).isin(*names) & (F.try_variant_get(v.column, "$", want.simpleString()) == F.lit(equals))
    same = {bool: T.BooleanType, int: T.NumericType, str: T.StringType}[type(equals)]
    return v.column == F.lit(equals) if isinstance(v.type, same) else F.lit(False)


def landed(v: Value, column: ColumnDef | None) -> Value:
    """A value in its column's type; JSON columns take any value as JSON text."""
    if column is None:
        # Without a column to say more, scalars of variants land as text and the rest as JSON.
        return v if not isinstance(v.type, T.VariantType) else Value(F.coalesce(F.try_variant_get(v.column, "$", "string"), json_of(v)), T.StringType(), v.error)
    if column.is_json:
        return Value(F.when(v.error.isNull(), json_of(v)), T.StringType(), v.error)
    kind = column.spark
    if v.type == kind:
        return v
    if isinstance(v.type, T.VariantType):
        made = F.try_variant_get(v.column, "$", kind.simpleString())
    elif isinstance(v.type, T.BooleanType) and isinstance(kind, T.StringType):
        made = F.when(v.column, "true").when(~v.column, "false")
    elif isinstance(v.type, (T.ArrayType, T.StructType)) != isinstance(kind, (T.ArrayType, T.StructType)):
        made = F.lit(None).cast(kind)
    else:
        made = v.column.try_cast(kind)
    wrong = v.error.isNull() & v.column.isNotNull() & made.isNull()
    return Value(F.when(v.error.isNull(), made), kind, F.coalesce(v.error, F.when(wrong, F.lit(f"{column.name}: doesn't fit {column.type}"))))


class Level:
    """One level of an entity: a frame with a document-like column, to which lookups and fields are added."""

    def __init__(self, df: DataFrame, root: str, id_map: DataFrame, table: TableDef | None, prefix: str = ""):
        self.df, self.root, self.id_map, self.table, self.prefix = df, root, id_map, table, prefix
        self.values: dict[str, Column] = {}
        self.events: list[Column] = []
        self._n = 0

    @property
    def kind(self) -> T.DataType:
        return self.df.schema[self.root].dataType

    def at(self, path: str) -> Value:
        return get_path(F.col(self.root), self.kind, path)

    def column(self, name: str) -> ColumnDef | None:
        return self.table.columns.get(name) if self.table else None

    def add(self, path: str, spec: FieldSpec) -> None:
        name, column = f"{self.prefix}{path}", self.column(spec.target)
        if spec.lookup:
            found = self.resolve(self.at(path), spec.lookup)
            v = value(F.col(found), T.StringType())
            self.events.append(missing_event(spec.on_missing, name, spec.lookup, F.col(f"{found}_missed"), F.col(f"{found}_of")))
            # Of a lookup's transform only a default has an effect, and it isn't looked up.
            if (literal := default_of(spec.transform)) is not None:
                v = with_default(v, literal)
        else:
            v = compile_transform(spec.transform, self.at(path), column.spark if column and not column.is_json else None)
        self.put(name, spec.target, landed(v, column))

    def put(self, name: str, target: str, v: Value) -> None:
        self.values[target] = v.column
        self.events.append(event("E", name, v.error, v.error.isNotNull()))
        column = self.column(target)
        if column and not column.nullable and column.default is None and not column.is_serial:
            self.events.append(event("E", name, f"{target} may not be null", v.column.isNull() & v.error.isNull()))

    def resolve(self, key: Value, entity: str) -> str:
        """The name of a column with what the map of ids has for a value of this level."""
        self._n += 1
        to = f"_ref{self.prefix.count('.')}_{self._n}"
        text = F.try_variant_get(key.column, "$", "string") if isinstance(key.type, T.VariantType) else key.column.cast("string")
        self.df = lookup(self.df, text, self.id_map, entity, to)
        return to

    def pack(self, names: tuple[str, ...], target: str | None) -> None:
        if names and target:
            self.values[target] = packed(F.col(self.root), self.kind, list(names))

    def identify(self, strategy: IdStrategy, namespace: str, row: int = 0) -> tuple[Column, Column]:
        """The new id, and an event where it can't be made."""
        source = self.at(strategy.source_field or "_id")
        text = F.try_variant_get(source.column, "$", "string") if isinstance(source.type, T.VariantType) else source.column
        made = F.lit(None).cast("string") if strategy.type in ("serial", "int_sequence") else new_id(strategy.type, text, namespace)
        return made, event("E", f"{self.prefix}{strategy.source_field}", "no identity", text.isNull() if strategy.type != "serial" else F.lit(False))


def ended(events: Column) -> Column:
    """Of a row's events in order, all up to the first that ends it."""
    last = F.array_position(F.transform(events, lambda e: e["kind"].isin("E", "S")), True)
    return F.when(last > 0, F.slice(events, 1, last.cast("int"))).otherwise(events)


def ordered(events: list[Column]) -> Column:
    return F.array_compact(F.array(*events)) if events else F.array().cast(f"array<{EVENT}>")


def verdict(events: Column) -> Column:
    """E or S for a row that ends, null for one that stays."""
    return F.get(F.filter(events, lambda e: e["kind"].isin("E", "S")), F.lit(0))["kind"]


def compile_entity(name: str, entity: Entity, source: DataFrame, id_map: DataFrame, catalog: Catalog | None = None, namespace: str = NAMESPACE, after=None, sequences: dict[str, int] | None = None, every_error: bool = False, keep: Callable[[DataFrame], DataFrame] = lambda df: df) -> Compiled:
    """The frames of an entity. `after` resumes behind that _id; `sequences` has the first number for each table that counts.

    `keep` is applied to each level's resolved rows, which several frames start from: a load writes and rereads them there, so that
    sources are read once and random ids are drawn once. With every_error all events of a row are kept, as a dry run reports them, and not only those up to the first that ends it.
    """
    sequences = sequences or {}
    docs = as_document(source)
    kind = docs.schema["_doc"].dataType
    if entity.filter:
        docs = docs.filter(matches(F.col("_doc"), kind, entity.filter.field, entity.filter.equals))
    if after is not None:
        docs = docs.filter(F.col("_oid") > F.lit(after))
    table = lambda t: catalog[t] if catalog else None
    level = Level(docs, "_doc", id_map, table(entity.target))
    made, lost = level.identify(entity.id_strategy, namespace)
    skippers = {path for path, f in entity.fields.items() if f.on_missing == "skip_row"}
    if entity.id_strategy.source_field in skippers:
        lost = event("S", entity.id_strategy.source_field, "no identity", lost.isNotNull())
    level.events.append(lost)
    for path, spec in entity.fields.items():
        level.add(path, spec)
    level.pack(entity.unmapped.jsonb, entity.unmapped.jsonb_column)
    arrays: dict[str, T.DataType] = {}
    for n in (*entity.explode, *entity.junction):
        items, arrays[n], wrong = get_array(F.col("_doc"), kind, n)
        level.values[f"_items_{n}"] = items
        level.events.append(event("E", n, wrong, wrong.isNotNull()))
    for u in entity.unpivot.values():
        for i in u.items:
            raw = level.at(i.source_field)
            v = landed(compile_transform(i.transform, raw), table(u.target).columns.get(u.value_column) if catalog else None)
            level.values[f"_unpivot_{u.target}_{i.code}"] = F.struct(raw.column.isNotNull().alias("told"), v.column.alias("value"))
            level.events.append(event("E", i.source_field, v.error, v.error.isNotNull()))
    events = ordered(level.events)
    rows = level.df.select("_oid", "_sid", made.alias("_new"), (events if every_error else ended(events)).alias("_events"), *(c.alias(n) for n, c in level.values.items()))
    rows = rows.withColumn("_end", verdict(F.col("_events")))
    if entity.id_strategy.type == "int_sequence":
        # Numbers are taken in the order of _id, by documents that end up skipped as well.
        rows = with_sequence(rows.drop("_new"), ["_oid"], "_new", sequences.get(entity.target, 1)).withColumn("_new", F.col("_new").cast("string"))
    rows = keep(rows)
    alive = rows.filter("_end is null")
    id_column = level.column(entity.id_strategy.target_field)
    own = cast_key(F.col("_new"), id_column).alias(entity.id_strategy.target_field)
    fields = [*(f.target for f in entity.fields.values()), *([entity.unmapped.jsonb_column] if entity.unmapped.jsonb_column else [])]
    out = Compiled((entity.target, alive.select(own, *dict.fromkeys(f for f in fields if f != entity.id_strategy.target_field))), documents=rows)
    all_events = [rows.select(F.lit(entity.target).alias("table"), F.col("_sid").alias("source_id"), F.posexplode("_events").alias("place", "_e")).select("table", "source_id", "_e.field", "_e.kind", "_e.message", "place")]
    out.feeds.update(array_targets(entity.explode))
    # A dry run looks below documents with errors too; what a policy skips is skipped with all below it.
    below = rows.filter(~F.exists("_events", lambda e: e["kind"] == "S")) if every_error else alive
    for n, spec in entity.explode.items():
        parents = below.select("_sid", F.col("_new").alias("_parent"), F.col(f"_items_{n}").alias("_items"))
        explode_level(spec, f"{n}.", parents, id_map, catalog, namespace, sequences, out, all_events, every_error, keep)
    for n, spec in entity.junction.items():
        pairs = below.select("_sid", F.col("_new").alias("_parent"), F.explode(f"_items_{n}").alias("_item"))
        item = value(F.col("_item"), arrays[n])
        at = Level(pairs.withColumn("_row", F.struct(F.col("_item").alias("item"))), "_row", id_map, table(spec.target), f"{n}.")
        key = at.at("item")
        text = F.try_variant_get(key.column, "$", "string") if isinstance(key.type, T.VariantType) else key.column.cast("string")
        at.events.append(event("E", n, "a null element refers to nothing", text.isNull()))
        if spec.child_fk.lookup:
            found = at.resolve(key, spec.child_fk.lookup)
            at.events.append(missing_event(spec.on_missing, n, spec.child_fk.lookup, F.col(f"{found}_missed"), F.col(f"{found}_of")))
            child = F.col(found)
        else:
            child = text
        done = at.df.select("_sid", "_parent", child.alias("_child"), ended(ordered(at.events)).alias("_events")).withColumn("_end", verdict(F.col("_events")))
        out.junctions[spec.target] = done.filter("_end is null").select(cast_key(F.col("_parent"), at.column(spec.parent_fk.target_field)).alias(spec.parent_fk.target_field), cast_key(F.col("_child"), at.column(spec.child_fk.target_field)).alias(spec.child_fk.target_field))
        all_events.append(events_of(done, spec.target))
        del item
    for u in entity.unpivot.values():
        out.unpivots[u.target] = unpivoted(alive, u, table(u.target))
    out.id_map = alive.select(F.lit(name).alias("entity"), F.col("_sid").alias("source_id"), F.col("_new").alias("target_id"), F.current_timestamp().alias("loaded_at"))
    union = all_events[0]
    for e in all_events[1:]:
        union = union.unionByName(e)
    out.events = union
    return out


def events_of(rows: DataFrame, table: str) -> DataFrame:
    return rows.select(F.lit(table).alias("table"), F.col("_sid").alias("source_id"), F.posexplode("_events").alias("place", "_e")).select("table", "source_id", "_e.field", "_e.kind", "_e.message", "place")


def cast_key(text: Column, column: ColumnDef | None) -> Column:
    """A key, which travels as text, in the type of its column."""
    return text if column is None or isinstance(column.spark, T.StringType) else text.try_cast(column.spark)


def array_targets(explode: dict[str, Explode]) -> Iterator[str]:
    for spec in explode.values():
        yield spec.target
        yield from array_targets(spec.explode)


def explode_level(spec: Explode, prefix: str, parents: DataFrame, id_map: DataFrame, catalog: Catalog | None, namespace: str, sequences: dict[str, int], out: Compiled, events: list[DataFrame], every_error: bool, keep: Callable[[DataFrame], DataFrame]) -> None:
    """Rows of one embedded array, and of those within it. A skipped item takes what is below it along."""
    table = catalog[spec.target] if catalog else None
    items = parents.select("_sid", "_parent", F.explode("_items").alias("_item"))
    level = Level(items, "_item", id_map, table, prefix)
    if not isinstance(level.kind, (T.StructType, T.VariantType)):
        level.df = items.withColumn("_item", F.struct(F.col("_item").alias("_value")))
    made, lost = F.lit(None).cast("string"), None
    if spec.explode or spec.id_strategy.type not in ("serial", "int_sequence"):
        made, lost = level.identify(spec.id_strategy, namespace)
        level.events.append(lost)
    for path, f in spec.fields.items():
        level.add(path, f)
    level.pack(spec.unmapped.jsonb, spec.unmapped.jsonb_column)
    for n in spec.explode:
        found, _, wrong = get_array(F.col("_item"), level.kind, n)
        level.values[f"_items_{n}"] = found
        level.events.append(event("E", f"{prefix}{n}", wrong, wrong.isNotNull()))
    marks = ordered(level.events)
    rows = level.df.select("_sid", "_parent", made.alias("_new"), (marks if every_error else ended(marks)).alias("_events"), *(c.alias(n) for n, c in level.values.items())).withColumn("_end", verdict(F.col("_events")))
    if spec.id_strategy.type in ("serial", "int_sequence"):
        start = out.numbers.get(spec.target, sequences.get(spec.target, 1))
        rows = with_sequence(rows.drop("_new"), ["_sid"], "_new", start).withColumn("_new", F.col("_new").cast("string"))
        if out.feeds[spec.target] > 1:  # the next array goes on where this one ends
            out.numbers[spec.target] = start + rows.count()
    rows = keep(rows)
    alive = rows.filter("_end is null")
    own = []
    if table is None or spec.id_strategy.target_field in table.columns:
        own = [cast_key(F.col("_new"), level.column(spec.id_strategy.target_field)).alias(spec.id_strategy.target_field)]
    fields = [*(f.target for f in spec.fields.values()), *([spec.unmapped.jsonb_column] if spec.unmapped.jsonb_column else [])]
    parent = cast_key(F.col("_parent"), level.column(spec.parent_fk.target_field)).alias(spec.parent_fk.target_field)
    made_rows = alive.select(*own, parent, *dict.fromkeys(f for f in fields if f not in (spec.id_strategy.target_field, spec.parent_fk.target_field)))
    out.children[spec.target] = out.children[spec.target].unionByName(made_rows) if spec.target in out.children else made_rows
    events.append(events_of(rows, spec.target))
    parents = rows.filter(~F.exists("_events", lambda e: e["kind"] == "S")) if every_error else alive
    for n, inner in spec.explode.items():
        explode_level(inner, f"{prefix}{n}.", parents.select("_sid", F.col("_new").cast("string").alias("_parent"), F.col(f"_items_{n}").alias("_items")), id_map, catalog, namespace, sequences, out, events, every_error, keep)


def unpivoted(alive: DataFrame, spec, table: TableDef | None) -> DataFrame:
    """A row for each named field of each document: parent, code and value, all values in the value column's type."""
    kinds = {alive.schema[f"_unpivot_{spec.target}_{i.code}"].dataType["value"].dataType for i in spec.items}
    kind = table.columns[spec.value_column].spark if table else next(iter(kinds)) if len(kinds) == 1 else T.DoubleType() if all(isinstance(k, T.NumericType) for k in kinds) else T.StringType()
    each = [F.struct(F.lit(i.code).alias("code"), F.col(f"_unpivot_{spec.target}_{i.code}.told").alias("told"), F.col(f"_unpivot_{spec.target}_{i.code}.value").cast(kind).alias("value")) for i in spec.items]
    rows = alive.select(F.col("_new").alias("_parent"), F.explode(F.array(*each)).alias("_u"))
    if spec.skip_null:  # of what the document says, before any default
        rows = rows.filter("_u.told")
    parent = cast_key(F.col("_parent"), table.columns.get(spec.parent_fk.target_field) if table else None)
    return rows.select(parent.alias(spec.parent_fk.target_field), F.col("_u.code").alias(spec.code_column), F.col("_u.value").alias(spec.value_column))
