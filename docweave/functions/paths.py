"""Paths into documents: dotted names through objects, never into arrays; what isn't there is null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docweave.functions.transforms import Value, value, variant_kind


def get_path(root: Column, kind: T.DataType, path: str) -> Value:
    """The value at a path, from a column of a typed or variant document. JSON's null and an absent field are both null."""
    for i, name in enumerate(parts := path.split(".")):
        if isinstance(kind, T.VariantType):
            found = F.try_variant_get(root, "$" + "".join(f"['{p}']" if not p.isidentifier() else f".{p}" for p in parts[i:]), "variant")
            return value(F.when(variant_kind(found).isNotNull(), found), T.VariantType())
        if not isinstance(kind, T.StructType) or name not in kind.fieldNames():
            return value(F.lit(None).cast("string"), T.StringType())
        root, kind = root.getField(name), kind[name].dataType
    return value(root, kind)


def get_array(root: Column, kind: T.DataType, name: str) -> tuple[Column, T.DataType, Column]:
    """Items of the array that a top-level name holds, their type, and an error where it holds something else. Null and absent are empty."""
    found = get_path(root, kind, name) if "." not in name else value(F.lit(None).cast("string"), T.StringType())
    if isinstance(found.type, T.ArrayType):
        return F.coalesce(found.column, F.array().cast(found.type)), found.type.elementType, F.lit(None).cast("string")
    if isinstance(found.type, T.VariantType):
        kind_of = variant_kind(found.column)
        items = F.try_variant_get(found.column, "$", "array<variant>")
        error = F.when(kind_of.isNotNull() & (kind_of != "ARRAY"), F.lit("not an array"))
        return F.coalesce(F.when(kind_of == "ARRAY", items), F.array().cast("array<variant>")), T.VariantType(), error
    if isinstance(found.type, T.NullType) or (isinstance(kind, T.StructType) and name not in kind.fieldNames()):
        return F.array().cast("array<string>"), T.StringType(), F.lit(None).cast("string")
    return F.array().cast("array<string>"), T.StringType(), F.when(found.column.isNotNull(), F.lit("not an array"))


def json_of(v: Value) -> Column:
    """A value as JSON text, keys sorted in variants; null of null. Timestamps are ISO text in UTC."""
    if isinstance(v.type, T.VariantType):
        return F.when(v.column.isNotNull(), F.to_json(v.column))
    if isinstance(v.type, (T.ArrayType, T.StructType, T.MapType)):
        return F.when(v.column.isNotNull(), F.to_json(v.column, JSON))
    inner = F.to_json(F.struct(v.column.alias("x")), JSON)  # {"x":...}
    return F.when(v.column.isNotNull(), F.substring(inner, F.lit(6), F.length(inner) - 6))


#: How JSON is written: nulls are kept, timestamps are ISO text.
JSON = {"ignoreNullFields": "false", "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]XXX"}


def packed(root: Column, kind: T.DataType, names: list[str]) -> Column:
    """Fields as one JSON object with sorted names, absent ones as null."""
    if isinstance(kind, T.VariantType):
        each = [F.concat(F.lit(f'"{n}":'), F.coalesce(json_of(get_path(root, kind, n)), F.lit("null"))) for n in sorted(names)]
        return F.concat(F.lit("{"), F.concat_ws(",", *each), F.lit("}"))
    return F.to_json(F.struct(*(get_path(root, kind, n).column.alias(n) for n in sorted(names))), JSON)
