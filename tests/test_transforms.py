import datetime

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docweave.functions.paths import get_array, get_path, packed
from docweave.functions.transforms import TransformError, compile_transform, double_text, split_pipeline, value

TEXTS = ["42", " 42 ", "+7", "4_2", "3.9", "", "abc", "1e3", "inf", "-Infinity", "nan", "1d", "\u30005\u3000", "0", "false", "1_0.5", ".5", "5.", " x ", "\x0bx\x1f"]
STAMPS = ["2026-01-04", "2026-01-04T10:00:00Z", "2026-01-04 10:00:00.123456789+0530", "2026", "2026-01-04T10", "2026-13-01", "2026-02-30", "12:30", "2026-01-04T10:00:00,5", " 2026-01-04", "2026-1-4", "epoch"]


def python(f, x):
    try:
        return f(x)
    except (ValueError, OverflowError):
        return "error"


def iso(x):
    d = datetime.datetime.fromisoformat(x)
    return (d if d.tzinfo else d.replace(tzinfo=datetime.timezone.utc)).timestamp()


@pytest.mark.parametrize("variant", [False, True])
@pytest.mark.parametrize(("step", "f"), [("cast_int", int), ("cast_float", float), ("cast_text", str), ("cast_bool", bool), ("trim", str.strip), ("cast_timestamptz", iso)])
def test_text_as_python_casts_it(spark, step, f, variant):
    given = STAMPS if step == "cast_timestamptz" else TEXTS
    df = spark.createDataFrame([(i, s) for i, s in enumerate(given)], "i int, s string")
    doc = F.parse_json(F.to_json(F.struct("s")))
    made = compile_transform(step, get_path(doc, T.VariantType(), "s") if variant else value(F.col("s"), T.StringType()))
    out = F.try_variant_get(made.column, "$", "string") if isinstance(made.type, T.VariantType) else F.unix_micros(made.column) / 1e6 if step == "cast_timestamptz" else made.column
    got = {r.i: "error" if r.e else r.v for r in df.select("i", out.alias("v"), made.error.alias("e")).collect()}
    for i, s in enumerate(given):
        want = python(f, s)
        assert repr(got[i]) == repr(want) or got[i] == want, (step, s)


def test_numbers_and_truth(spark):
    df = spark.createDataFrame([(3.9, True), (-3.9, False), (float("nan"), None), (float("inf"), True), (0.0, True)], "d double, b boolean")
    i = compile_transform("cast_int", value(F.col("d"), T.DoubleType()))
    assert [(r[0], r[1] is not None) for r in df.select(i.column, i.error).collect()] == [(3, False), (-3, False), (None, True), (None, True), (0, False)]
    b = compile_transform("cast_text", value(F.col("b"), T.BooleanType()))
    assert [r[0] for r in df.select(b.column).collect()] == ["True", "False", None, "True", "True"]
    t = compile_transform("cast_bool", value(F.col("d"), T.DoubleType()))
    assert [r[0] for r in df.select(t.column).collect()] == [True, True, True, True, False]


def test_doubles_as_python_writes_them(spark):
    given = [1.0, 1e20, 1.5e-5, 0.0001, 123456789.123, 1e16, -2.5e-10, float("nan"), float("-inf"), 0.0, -0.0, 1e15, 12345678.0, 0.5, 10.0, 100000000.0]
    df = spark.createDataFrame([(i, d) for i, d in enumerate(given)], "i int, d double")
    assert {r.i: r.s for r in df.select("i", double_text(F.col("d")).alias("s")).collect()} == {i: str(d) for i, d in enumerate(given)}


@pytest.mark.parametrize(
    ("spec", "given", "want"),
    [
        ('enum:{"a": "x", "*": null}', "a", "x"),
        ('enum:{"a": "x", "*": null}', "b", None),
        ('enum:{"a": "x"}', "b", "error"),
        ("split:|", "a|b|", ["a", "b", ""]),
        ("split:.", "a.b", ["a", "b"]),
        ("truncate:2", "\U0001f600ab", "\U0001f600a"),
        ("trim|truncate:3|default:zz", "  abcd", "abc"),
        ("default:5|cast_int", None, "5"),
        ("trim|default:none", None, "none"),
        ("json_extract:x", "same", "same"),
    ],
)
def test_steps(spark, spec, given, want):
    made = compile_transform(spec, value(F.col("s"), T.StringType()))
    row = spark.createDataFrame([(given,)], "s string").select(made.column, made.error).first()
    assert ("error" if row[1] else row[0]) == want


@pytest.mark.parametrize("spec", ["shout", "truncate:0", "truncate:x", "split:", "trim|split:|", "enum:[1]", "enum:{"])
def test_unreadable_steps(spec):
    with pytest.raises(TransformError):
        compile_transform(spec, value(F.lit("a"), T.StringType()))


def test_bars_inside_json_separate_nothing():
    assert split_pipeline('trim| enum:{"a|b": "c"} ||default:x') == ["trim", 'enum:{"a|b": "c"}', "default:x"]


def test_casts_refuse_lists_and_objects(spark):
    df = spark.sql("select array(1) a, parse_json('{\"x\": [1], \"y\": {}, \"z\": 1}') v")
    made = compile_transform("cast_text", value(F.col("a"), T.ArrayType(T.IntegerType())))
    assert df.select(made.error).first()[0]
    for name, wrong in (("x", True), ("y", True), ("z", False)):
        made = compile_transform("cast_int", get_path(F.col("v"), T.VariantType(), name))
        assert (df.select(made.error).first()[0] is not None) is wrong


def test_paths_go_through_objects_only(spark):
    df = spark.sql("""select named_struct('a', named_struct('b', 1), 'c', array(named_struct('d', 2))) s, parse_json('{"a": {"b": 1}, "c": [{"d": 2}], "n": null}') v""")
    kind = df.schema["s"].dataType
    assert df.select(get_path(F.col("s"), kind, "a.b").column, get_path(F.col("s"), kind, "c.d").column, get_path(F.col("s"), kind, "a.x").column).first() == (1, None, None)
    v = [get_path(F.col("v"), T.VariantType(), p).column.isNotNull() for p in ("a.b", "c.d", "n", "gone")]
    assert tuple(df.select(*v).first()) == (True, False, False, False)


def test_arrays_are_not_taken_from_scalars(spark):
    df = spark.sql("""select parse_json('{"a": [1], "s": "x", "n": null}') v""")
    found = [get_array(F.col("v"), T.VariantType(), n) for n in ("a", "s", "n", "gone")]
    row = df.select(*(F.size(i) for i, _, _ in found), *(e.isNotNull() for *_, e in found)).first()
    assert tuple(row) == (1, 0, 0, 0, False, True, False, False)


def test_packing_sorts_names_and_keeps_nulls(spark):
    df = spark.sql("""select named_struct('b', 1, 'a', cast(null as string)) s, parse_json('{"b": 1.5, "q": "x\\\\"y"}') v""")
    row = df.select(packed(F.col("s"), df.schema["s"].dataType, ["b", "a", "gone"]), packed(F.col("v"), T.VariantType(), ["q", "b", "gone"])).first()
    assert row[0] == '{"a":null,"b":1,"gone":null}'
    assert row[1] == '{"b":1.5,"gone":null,"q":"x\\"y"}'
