"""The target's tables as Spark doesn't know them: columns with nullability, keys, uniqueness and references."""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import types as T


class CatalogError(ValueError):
    """A table or schema that isn't there, or DDL that can't be read."""


@dataclass(frozen=True)
class ColumnDef:
    name: str
    type: str
    nullable: bool = True
    default: str | None = None

    @property
    def max_chars(self) -> int | None:
        m = re.search(r"char(?:acter)?(?: varying)?\s*\((\d+)\)", self.type)
        return int(m[1]) if m else None

    @property
    def is_json(self) -> bool:
        return "json" in self.type

    @property
    def is_serial(self) -> bool:
        return "serial" in self.type

    @property
    def spark(self) -> T.DataType:
        t = self.type
        if t.endswith("[]"):
            return T.ArrayType(ColumnDef(self.name, t[:-2]).spark)
        if m := re.search(r"(?:numeric|decimal)\s*\((\d+)(?:\s*,\s*(\d+))?\)", t):
            return T.DecimalType(int(m[1]), int(m[2] or 0))
        for pattern, kind in (
            ("smallint|int2|smallserial", T.ShortType()),
            ("bigint|int8|bigserial", T.LongType()),
            ("int|serial", T.IntegerType()),
            ("numeric|decimal", T.DecimalType(38, 9)),
            ("double|float8", T.DoubleType()),
            ("real|float4|float", T.FloatType()),
            ("bool", T.BooleanType()),
            ("timestamp", T.TimestampType()),
            ("^date", T.DateType()),
            ("bytea", T.BinaryType()),
        ):
            if re.search(pattern, t):
                return kind
        return T.StringType()


@dataclass(frozen=True)
class ForeignKey:
    column: str
    table: str
    target: str
    deferrable: bool = False


@dataclass(frozen=True)
class TableDef:
    name: str
    columns: dict[str, ColumnDef]
    primary_key: tuple[str, ...] = ()
    unique: tuple[tuple[str, ...], ...] = ()
    foreign_keys: tuple[ForeignKey, ...] = ()

    def schema(self) -> T.StructType:
        return T.StructType([T.StructField(c.name, c.spark, c.nullable) for c in self.columns.values()])


@dataclass(frozen=True)
class Catalog:
    tables: dict[str, TableDef] = field(default_factory=dict)
    name: str = "public"

    def __getitem__(self, table: str) -> TableDef:
        if table not in self.tables:
            raise CatalogError(f"no table {table!r}; there are {', '.join(sorted(self.tables)) or 'none'}")
        return self.tables[table]

    def __contains__(self, table: str) -> bool:
        return table in self.tables

    def load_order(self) -> list[list[str]]:
        """Batches of tables, referenced ones first; a circle whose references can all be deferred is one batch, any other an error."""
        needs = {t: {k.table for k in d.foreign_keys if k.table != t and k.table in self.tables} for t, d in self.tables.items()}
        out: list[list[str]] = []
        while needs:
            ready = sorted(t for t, n in needs.items() if not n)
            if not ready:
                reach = {t: set(n) for t, n in needs.items()}
                for _ in needs:
                    reach = {t: n.union(*(reach[x] for x in n)) for t, n in reach.items()}
                ready = sorted(t for t, n in reach.items() if t in n and all(t in reach[x] for x in n))
                inside = [k for t in ready for k in self.tables[t].foreign_keys if k.table in ready and k.table != t]
                if not ready or not all(k.deferrable for k in inside):
                    raise CatalogError(f"tables refer to each other in a circle that can't be deferred: {', '.join(sorted(needs))}")
            out.append(ready)
            needs = {t: n - set(ready) for t, n in needs.items() if t not in ready}
        return out


def parse_ddl(ddl: str, name: str = "public") -> Catalog:
    """A catalogue from CREATE TABLE statements (columns, NOT NULL, DEFAULT, PRIMARY KEY, UNIQUE, REFERENCES, FOREIGN KEY)."""
    text = re.sub(r"--[^\n]*|/\*.*?\*/", " ", ddl, flags=re.S)
    tables = {}
    for m in re.finditer(r"create\s+table\s+(?:if\s+not\s+exists\s+)?([\w.\"]+)\s*\(", text, re.I):
        table = m[1].replace('"', "").split(".")[-1]
        parts, depth, start, at = [], 1, m.end(), m.end()
        while depth:
            if at >= len(text):
                raise CatalogError(f"{table}: no closing parenthesis")
            c = text[at]
            depth += (c == "(") - (c == ")")
            if depth == 1 and c == "," or depth == 0:
                parts.append(" ".join(text[start:at].split()))
                start = at + 1
            at += 1
        tables[table] = _table(table, [p for p in parts if p])
    return Catalog(tables, name)


def _names(s: str) -> tuple[str, ...]:
    return tuple(x.strip().strip('"') for x in s.split(","))


def _table(table: str, parts: list[str]) -> TableDef:
    columns: dict[str, ColumnDef] = {}
    key: tuple[str, ...] = ()
    unique: list[tuple[str, ...]] = []
    refs: list[ForeignKey] = []
    for p in parts:
        p = re.sub(r"^constraint\s+\S+\s+", "", p, flags=re.I)
        low = p.lower()
        if m := re.match(r"primary\s+key\s*\((.*?)\)", p, re.I):
            key = _names(m[1])
        elif m := re.match(r"unique\s*\((.*?)\)", p, re.I):
            unique.append(_names(m[1]))
        elif m := re.match(r"foreign\s+key\s*\((.*?)\)\s*references\s+([\w.\"]+)\s*\((.*?)\)", p, re.I):
            refs += [ForeignKey(a, m[2].replace('"', "").split(".")[-1], b, "deferrable" in low and "not deferrable" not in low) for a, b in zip(_names(m[1]), _names(m[3]), strict=True)]
        elif not re.match(r"(check|exclude)\b", low):
            name, _, rest = p.partition(" ")
            name = name.strip('"')
            kind = re.split(r"\s+(?:not\s+null|null|default|primary|unique|references|check|constraint|generated|collate)\b", f" {rest}", maxsplit=1, flags=re.I)[0].strip().lower()
            d = re.search(r"\bdefault\s+(.+?)(?=\s+(?:not\s+null|primary|unique|references|check)\b|$)", rest, re.I)
            if re.search(r"\bprimary\s+key\b", rest, re.I):
                key = (name,)
            if re.search(r"\bunique\b", rest, re.I):
                unique.append((name,))
            if r := re.search(r"\breferences\s+([\w.\"]+)\s*\((.*?)\)", rest, re.I):
                refs.append(ForeignKey(name, r[1].replace('"', "").split(".")[-1], r[2].strip(' "'), "deferrable" in low and "not deferrable" not in low))
            columns[name] = ColumnDef(name, kind, not re.search(r"\bnot\s+null\b|\bprimary\s+key\b", rest, re.I) and "serial" not in kind, d[1] if d else None)
    columns = {n: ColumnDef(c.name, c.type, c.nullable and n not in key, c.default) for n, c in columns.items()}
    return TableDef(table, columns, key, tuple(unique), tuple(refs))


def only(catalog: Catalog, tables: Iterable[str]) -> Catalog:
    keep = set(tables)
    return Catalog({n: t for n, t in catalog.tables.items() if n in keep}, catalog.name)
