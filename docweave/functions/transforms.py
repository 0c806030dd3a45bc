"""The transform language of mappings, compiled once into Column expressions.

A transform is one step or a pipeline `a|b`. Each compiles to a value and an error message that is null where all is well; no
expression throws, so that one pass can report every violation. Null goes through every step as null. The semantics of casts are those
of Python's int, float, str and bool on the document's value, which differ from SQL's at many points noted below.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Python's white space, stripped at both ends.
EDGES = r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$"
INT = r"^[+-]?[0-9]+(?:_[0-9]+)*$"
FLOAT = r"^[+-]?(?:[0-9]+(?:_[0-9]+)*\.?(?:[0-9]+(?:_[0-9]+)*)?|\.[0-9]+(?:_[0-9]+)*)(?:[eE][+-]?[0-9]+(?:_[0-9]+)*)?$"
ISO = r"^([0-9]{4}-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12][0-9]|3[01]))(?:[\s\S]([01][0-9]|2[0-3])(?::([0-5][0-9])(?::([0-5][0-9])(?:[.,]([0-9]+))?)?)?(Z|[+-][0-9]{2}(?::?[0-9]{2})?)?)?$"
STEPS = ("cast_int", "cast_float", "cast_text", "cast_bool", "cast_timestamptz", "trim")
INTEGERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


class TransformError(ValueError):
    """A transform that doesn't exist or can't be read."""


@dataclass(frozen=True)
class Value:
    """A column of a known type, and what went wrong on the way to it. A variant's type is told row by row."""

    column: Column
    type: T.DataType
    error: Column

    @property
    def is_text(self) -> bool:
        return isinstance(self.type, T.StringType)


def value(column: Column, kind: T.DataType) -> Value:
    return Value(column, kind, F.lit(None).cast("string"))


def split_pipeline(spec: str) -> list[str]:
    """The steps of a pipeline: bars in JSON (braces, brackets, quotes) separate nothing; steps are stripped and empty ones dropped."""
    steps, depth, quoted, start, i = [], 0, False, 0, 0
    while i < len(spec):
        c = spec[i]
        if quoted:
            i += c == "\\"
            quoted = c != '"'
        elif c == '"' and depth:
            quoted = True
        elif c in "{[":
            depth += 1
        elif c in "}]":
            depth = max(0, depth - 1)
        elif c == "|" and not depth:
            steps.append(spec[start:i])
            start = i + 1
        i += 1
    return [s for s in (x.strip() for x in [*steps, spec[start:]]) if s]


def compile_transform(spec: str | None, v: Value, into: T.DataType | None = None) -> Value:
    """v after a transform. `into` is the target column's type, which an enum's values and a default take."""
    if not spec:
        return v
    steps = split_pipeline(spec)
    steps = steps if len(steps) > 1 else [spec.strip()]  # a lone step may hold a bar, as in split:|
    out = reduce(lambda a, s: _step(s, a, into), [s for s in steps if not s.startswith("default:")], v)
    literal = default_of(spec)
    return out if literal is None else with_default(out, literal, into)


def default_of(spec: str | None) -> str | None:
    """The literal of a default step, wherever it stands; of several the first."""
    steps = split_pipeline(spec or "")
    steps = steps if len(steps) > 1 else [(spec or "").strip()]
    return next((s.removeprefix("default:") for s in steps if s.startswith("default:")), None)


def with_default(v: Value, literal: str, into: T.DataType | None = None) -> Value:
    """A default is always text, and is cast only by the column that it lands in."""
    kind = into or T.StringType()
    if v.type != kind:
        v = Value(v.column.cast(kind) if not isinstance(v.type, T.VariantType) else F.try_variant_get(v.column, "$", kind.simpleString()), kind, v.error)
    return Value(F.when(v.error.isNull(), F.coalesce(v.column, F.lit(literal).try_cast(kind))), kind, v.error)


def _step(step: str, v: Value, into: T.DataType | None) -> Value:
    name, colon, rest = step.partition(":")
    if name == "json_extract":
        return v  # the field's key is the path
    if isinstance(v.type, T.VariantType):
        return _by_type(step, v, into)
    if step in ("cast_int", "cast_float", "cast_text", "cast_bool"):
        if isinstance(v.type, (T.ArrayType, T.StructType, T.MapType)):
            return failed(v, F.lit(True), f"{step}: a list or an object isn't a scalar", RESULT[step])
        return {"cast_int": _int, "cast_float": _float, "cast_text": _text, "cast_bool": _bool}[step](v)
    if step == "cast_timestamptz":
        return _timestamp(v)
    if step == "trim":
        return Value(F.regexp_replace(v.column, EDGES, ""), v.type, v.error) if v.is_text else v
    if name == "enum" and colon:
        return _enum(rest, v, into)
    if name == "truncate" and colon:
        return _truncate(rest, v)
    if name == "split" and colon:
        return _split(rest, v)
    raise TransformError(f"unknown transform {step!r}")


RESULT = {"cast_int": T.LongType(), "cast_float": T.DoubleType(), "cast_text": T.StringType(), "cast_bool": T.BooleanType(), "cast_timestamptz": T.TimestampType()}


def failed(v: Value, when: Column, message: str, kind: T.DataType, column: Column | None = None) -> Value:
    """v as `column`, with an error where `when` holds of a value that isn't null."""
    wrong = v.error.isNull() & v.column.isNotNull() & F.coalesce(when, F.lit(True))
    made = F.lit(None).cast(kind) if column is None else column
    return Value(F.when(~wrong & v.error.isNull(), made), kind, F.coalesce(v.error, F.when(wrong, F.lit(message))))


def stripped(c: Column) -> Column:
    return F.regexp_replace(c, EDGES, "")


def _int(v: Value) -> Value:
    c = v.column
    if v.is_text:  # '4_2' is 42, '3.9' an error
        bare = stripped(c)
        made = F.when(bare.rlike(INT), F.replace(bare, F.lit("_"), F.lit(""))).try_cast("bigint")
        return failed(v, made.isNull(), "cast_int: not a whole number", T.LongType(), made)
    if isinstance(v.type, (T.DoubleType, T.FloatType)):  # towards zero; no infinities
        made = F.when(F.abs(c) < 9.2233720368547e18, F.when(~F.isnan(c), c)).try_cast("bigint")
        return failed(v, made.isNull(), "cast_int: not a finite number", T.LongType(), made)
    if isinstance(v.type, (T.BooleanType, T.DecimalType, *INTEGERS)):
        made = c.try_cast("bigint")
        return failed(v, made.isNull(), "cast_int: too large", T.LongType(), made)
    return failed(v, F.lit(True), "cast_int: not a number", T.LongType())


def _float(v: Value) -> Value:
    c = v.column
    if v.is_text:  # '1d' is an error, 'nan' and 'inf' aren't
        bare = stripped(c)
        low = F.regexp_replace(F.lower(bare), "^[+-]", "")
        minus = F.startswith(bare, F.lit("-"))
        made = (
            F.when(low == "nan", F.lit(float("nan")))
            .when(low.isin("inf", "infinity"), F.when(minus, F.lit(float("-inf"))).otherwise(F.lit(float("inf"))))
            .when(bare.rlike(FLOAT), F.replace(bare, F.lit("_"), F.lit("")).try_cast("double"))
        )
        return failed(v, made.isNull(), "cast_float: not a number", T.DoubleType(), made)
    if isinstance(v.type, T.BooleanType):
        return failed(v, F.lit(False), "", T.DoubleType(), c.cast("int").cast("double"))
    if isinstance(v.type, (T.NumericType,)):
        return failed(v, F.lit(False), "", T.DoubleType(), c.cast("double"))
    return failed(v, F.lit(True), "cast_float: not a number", T.DoubleType())


def bound(x: Column, f) -> Column:
    """f(x) with x evaluated once, for expressions that name it many times."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def double_text(c: Column) -> Column:
    """A double as Python writes it: plain from 1e-4 up to 1e16, else with a signed exponent of two digits at least."""

    def scaled(x: Column) -> Column:
        digits, exponent = x["digits"], x["exponent"]
        size, left = F.length(digits), lambda n: F.substring(digits, F.lit(1), n)
        right = lambda at: F.substring(digits, at, F.lit(400))
        # Java's mantissa has one digit before the point where it writes an exponent.
        up = F.when(size <= exponent + 1, F.concat(F.rpad(digits, exponent + 1, "0"), F.lit(".0"))).otherwise(F.concat(left(exponent + 1), F.lit("."), right(exponent + 2)))
        down = F.concat(F.lit("0."), F.repeat(F.lit("0"), -exponent - 1), digits)
        power = F.concat(F.when(exponent < 0, "e-").otherwise("e+"), F.lpad(F.abs(exponent).cast("string"), 2, "0"))
        short = F.concat(left(F.lit(1)), F.when(size > 1, F.concat(F.lit("."), right(F.lit(2)))).otherwise(""), power)
        return F.concat(x["sign"], F.when((exponent >= 0) & (exponent < 16), up).when((exponent < 0) & (exponent >= -4), down).otherwise(short))

    raw = c.cast("string")
    digits = F.regexp_replace(F.replace(F.regexp_extract(raw, r"^-?([0-9.]+)", 1), F.lit("."), F.lit("")), "(?<=.)0+$", "")
    parts = F.struct(F.when(F.startswith(raw, F.lit("-")), "-").otherwise("").alias("sign"), digits.alias("digits"), F.regexp_extract(raw, r"E(-?[0-9]+)$", 1).try_cast("int").alias("exponent"))
    whole = F.when(F.isnan(c), "nan").when(c == float("inf"), "inf").when(c == float("-inf"), "-inf")
    return F.coalesce(whole, F.when(F.contains(raw, F.lit("E")), bound(parts, scaled)), raw)


def text_of(c: Column, kind: T.DataType) -> Column:
    """A scalar as Python's str writes it."""
    if isinstance(kind, T.BooleanType):
        return F.when(c, "True").when(~c, "False")
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return F.when(c.isNotNull(), double_text(c.cast("double")))
    if isinstance(kind, T.TimestampType):
        fraction = F.date_format(c, ".SSSSSS")
        return F.concat(F.date_format(c, "yyyy-MM-dd HH:mm:ss"), F.when(fraction == ".000000", "").otherwise(fraction), F.lit("+00:00"))
    return c.cast("string")


def _text(v: Value) -> Value:
    return failed(v, F.lit(False), "", T.StringType(), text_of(v.column, v.type))


def _bool(v: Value) -> Value:
    """Truth as Python has it: of text whether there is any ('false' is true), of numbers whether they differ from 0."""
    c = v.column
    made = F.length(c) > 0 if v.is_text else c if isinstance(v.type, T.BooleanType) else c != 0 if isinstance(v.type, T.NumericType) else F.lit(True)
    return failed(v, F.lit(False), "", T.BooleanType(), made)


def iso_timestamp(c: Column) -> Column:
    """A timestamp from ISO text, UTC where it names no zone; null where it isn't ISO."""

    def read(x: Column) -> Column:
        part = lambda i, other: F.coalesce(F.nullif(F.get(x, F.lit(i)), F.lit("")), F.lit(other))
        zone = F.when(F.get(x, F.lit(5)).isin("", "Z"), "+00:00").otherwise(F.regexp_replace(F.rpad(F.replace(F.get(x, F.lit(5)), F.lit(":"), F.lit("")), 5, "0"), "(..)$", ":$1"))
        text = F.concat(F.get(x, F.lit(0)), F.lit(" "), part(1, "00"), F.lit(":"), part(2, "00"), F.lit(":"), part(3, "00"), F.lit("."), F.rpad(F.substring(F.get(x, F.lit(4)), 1, 6), 6, "0"), zone)
        return F.try_to_timestamp(text, F.lit("yyyy-MM-dd HH:mm:ss.SSSSSSxxx"))

    return F.when(c.rlike(ISO), bound(F.split(F.regexp_replace(c, ISO, "$1\x01$2\x01$3\x01$4\x01$5\x01$6"), "\x01", -1), read))


def _timestamp(v: Value) -> Value:
    if isinstance(v.type, T.TimestampType):
        return v
    if isinstance(v.type, (T.TimestampNTZType, T.DateType)):
        return failed(v, F.lit(False), "", T.TimestampType(), v.column.cast("timestamp"))
    made = iso_timestamp(v.column) if v.is_text else None
    return failed(v, F.lit(True) if made is None else made.isNull(), "cast_timestamptz: not an ISO timestamp", T.TimestampType(), made)


def _enum(given: str, v: Value, into: T.DataType | None) -> Value:
    try:
        table = json.loads(given)
    except ValueError as e:
        raise TransformError(f"enum: not JSON: {e}") from None
    if not isinstance(table, dict):
        raise TransformError("enum: not an object")
    kind = into or T.StringType()
    told = lambda x: F.lit(None).cast(kind) if x is None else F.lit(str(x) if isinstance(kind, T.StringType) and not isinstance(x, str) else x).try_cast(kind)
    key = text_of(v.column, v.type)
    made, known = F.lit(None).cast(kind), F.lit("*" in table)
    if "*" in table:
        made = told(table["*"])
    for k, x in table.items():
        if k != "*":
            made, known = F.when(key == k, told(x)).otherwise(made), known | (key == k)
    return failed(v, ~known, "enum: not a listed value", kind, made)


def _truncate(given: str, v: Value) -> Value:
    if not re.fullmatch(r"\s*\+?[0-9]+\s*", given) or int(given) <= 0:
        raise TransformError(f"truncate: needs a whole number over 0, not {given!r}")
    if not v.is_text:
        return failed(v, F.lit(True), "truncate: not text", T.StringType())
    return Value(F.substring(v.column, 1, int(given)), v.type, v.error)


def _split(delimiter: str, v: Value) -> Value:
    if not delimiter:
        raise TransformError("split: needs a delimiter")
    if not v.is_text:
        return failed(v, F.lit(True), "split: not text", T.ArrayType(T.StringType()))
    quoted = "\\Q" + delimiter.replace("\\E", "\\E\\\\E\\Q") + "\\E"
    return Value(F.split(v.column, quoted, -1), T.ArrayType(T.StringType()), v.error)


#: What a variant can be: its type's name, and the type that it is read as.
VARIANTS = (("BOOLEAN", T.BooleanType()), ("BIGINT", T.LongType()), ("DOUBLE", T.DoubleType()), ("STRING", T.StringType()))


def variant_kind(c: Column) -> Column:
    """BOOLEAN, BIGINT, DOUBLE (decimals too), STRING, TIMESTAMP, ARRAY or OBJECT; null of null."""
    raw = F.regexp_extract(F.schema_of_variant(c), "^([A-Z]+)", 1)
    return F.when(c.isNull() | (raw == "VOID"), F.lit(None).cast("string")).otherwise(F.when(raw.isin("DECIMAL", "FLOAT"), "DOUBLE").otherwise(raw))


def _by_type(step: str, v: Value, into: T.DataType | None) -> Value:
    """A step on a variant: each type that it may have by itself, brought together in the type the step makes."""
    kind = variant_kind(v.column)
    made = {n: _step(step, value(F.when(kind == n, F.try_variant_get(v.column, "$", t.simpleString())), t), into) for n, t in VARIANTS}
    result = into if step.startswith("enum:") and into else RESULT.get(step) or (T.ArrayType(T.StringType()) if step.startswith("split:") else T.StringType())
    if step == "trim":  # other types are left alone
        text = F.when(kind == "STRING", F.to_json(F.to_variant_object(F.struct(made["STRING"].column.alias("x")))))
        return Value(F.when(kind == "STRING", F.variant_get(F.parse_json(text), "$.x", "variant")).otherwise(v.column), v.type, v.error)
    column, error = F.lit(None).cast(result), F.lit(None).cast("string")
    for n, x in made.items():
        column = F.when(kind == n, x.column.cast(result) if x.type != result else x.column).otherwise(column)
        error = F.when(kind == n, x.error).otherwise(error)
    nested = kind.isNotNull() & ~kind.isin(*made)
    if step == "cast_bool":  # a list or object is a cast's error like any other
        nested = kind.isin("ARRAY", "OBJECT")
    error = F.when(nested, F.lit(f"{step.partition(':')[0]}: a list or an object isn't a scalar")).otherwise(error)
    error = F.coalesce(v.error, error)
    return Value(F.when(error.isNull(), column), result, error)
