"""Profiles of schemaless collections: paths, types, presence, shapes and discriminators."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docweave.functions.keys import settled

#: How far an array is looked into.
HEAD = 20
#: A share of documents that makes a shape count; distinct values that a discriminator may have; the mean purity that it must have.
SHAPE_SHARE, VALUES, PURITY = 0.05, (2, 10), 0.8
#: Up to this many documents all are read, beyond it a share within bounds.
ALL, SHARE, LEAST, MOST = 5000, 0.02, 1000, 50_000


def sample_size(n: int) -> int:
    return n if n <= ALL else min(max(LEAST, int(n * SHARE)), MOST)


def sampled(df: DataFrame, n: int, total: int, seed: int = 0) -> DataFrame:
    """Exactly n random rows, or all."""
    return df if n >= total else df.orderBy(F.rand(seed)).limit(n)


def type_name(v: Column) -> Column:
    """The name of a variant's type: null, bool, objectid, date, int, double, string, object or array."""
    raw = F.schema_of_variant(v)
    short = F.regexp_extract(raw, "^([A-Z_]+)", 1)
    return (
        F.when(F.is_variant_null(v) | (short == "VOID"), "null")
        .when(short == "BOOLEAN", "bool")
        .when(raw.startswith("OBJECT<$oid:"), "objectid")
        .when(raw.startswith("OBJECT<$date:") | short.isin("TIMESTAMP", "TIMESTAMP_NTZ", "DATE"), "date")
        .when(short.isin("BIGINT", "INT", "SMALLINT", "TINYINT"), "int")
        .when(short.isin("DECIMAL", "DOUBLE", "FLOAT"), "double")
        .when(short == "STRING", "string")
        .when(short == "OBJECT", "object")
        .when(short == "ARRAY", "array")
        .when(short == "BINARY", "binary")
        .otherwise(F.lower(short))
    )


def _entries(frame: DataFrame, kind: str) -> DataFrame:
    """(path, _doc_no, v): the fields of objects, or the first items of arrays."""
    made = frame.lateralJoin(frame.sparkSession.tvf.variant_explode(F.col("v").outer()))
    return made.filter(F.col("pos") < HEAD) if kind == "array" else made


def walk(docs: DataFrame, doc: str = "doc") -> DataFrame:
    """(path, type, item): a row for each field of each document; item is the type of an item where the row stands for one of an array's.

    Objects are entered (a.b), objects in arrays too (a[].b), each level by one explode, until none is left. A level's plan holds the
    one before it twice, so what is still to be entered is checkpointed at each, in as many partitions as docs have.
    """
    frame = docs.select(F.lit("").alias("path"), F.col(doc).alias("v"))
    parts = docs.rdd.getNumPartitions()
    out: DataFrame | None = None
    while True:
        fields = _entries(frame, "object").select(F.when(F.col("path") == "", F.col("key")).otherwise(F.concat("path", F.lit("."), "key")).alias("path"), F.col("value").alias("v"))
        typed = fields.withColumn("type", type_name(F.col("v")))
        here = typed.select("path", "type", F.lit(None).cast("string").alias("item"))
        items = _entries(typed.filter(F.col("type") == "array").select("path", "v"), "array").select("path", F.col("value").alias("v")).withColumn("item", type_name(F.col("v")))
        here = here.unionByName(items.select("path", F.lit(None).cast("string").alias("type"), "item"))
        out = here if out is None else out.unionByName(here)
        frame = typed.filter(F.col("type") == "object").select("path", "v").unionByName(items.filter(F.col("item") == "object").select(F.concat("path", F.lit("[]")).alias("path"), "v"))
        frame = settled(frame.coalesce(parts))
        if frame.isEmpty():
            break
    return out


def field_stats(docs: DataFrame, doc: str = "doc") -> DataFrame:
    """(path, present_count, null_count, types, is_array, item_kind, item_types) of each path; types without null, sorted."""
    w = walk(docs, doc)
    names = lambda c: F.array_sort(F.array_remove(F.collect_set(c), "null"))
    return w.groupBy("path").agg(
        F.count("type").alias("present_count"),
        F.count_if(F.col("type") == "null").alias("null_count"),
        names("type").alias("types"),
        F.coalesce(F.bool_or(F.col("type") == "array"), F.lit(False)).alias("is_array"),
        F.when(F.bool_or(F.col("item") == "object"), "object").when(F.count("item") > 0, "scalar").alias("item_kind"),
        names("item").alias("item_types"),
    )


def type_variance(stats: DataFrame) -> DataFrame:
    """Paths with more than one type."""
    return stats.filter(F.size("types") > 1).select("path", "types")


def top_level(stats: DataFrame) -> DataFrame:
    return stats.filter(~F.contains("path", F.lit(".")) & ~F.contains("path", F.lit("[]"))).select("path")


def shape(doc: Column, kind: T.DataType) -> Column:
    """The sorted names of a document's top-level fields; of a typed document those that aren't null."""
    if isinstance(kind, T.VariantType):
        return F.array_sort(F.map_keys(F.from_json(F.to_json(doc), "map<string,variant>")))
    return F.array_sort(F.array_compact(F.array(*(F.when(doc.getField(n).isNotNull(), F.lit(n)) for n in kind.fieldNames()))))


def shapes(docs: DataFrame, doc: str = "doc") -> DataFrame:
    """(signature, n_docs)."""
    return docs.groupBy(shape(F.col(doc), docs.schema[doc].dataType).alias("signature")).agg(F.count(F.lit(1)).alias("n_docs"))


def is_polymorphic(counts: list[int]) -> bool:
    """More than one shape with its share of documents."""
    return sum(n >= SHAPE_SHARE * sum(counts) for n in counts) > 1


def discriminators(docs: DataFrame, doc: str = "doc") -> DataFrame:
    """(field, n_values, purity): text fields of few values, with the mean over values of the share that their commonest shape has."""
    kind = docs.schema[doc].dataType
    signed = docs.select(F.concat_ws(",", shape(F.col(doc), kind)).alias("signature"), F.col(doc).alias("d"))
    if isinstance(kind, T.VariantType):
        each = signed.lateralJoin(docs.sparkSession.tvf.variant_explode(F.col("d").outer())).filter(type_name(F.col("value")) == "string").select("signature", F.col("key").alias("field"), F.try_variant_get("value", "$", "string").alias("v"))
    else:
        texts = [f.name for f in kind.fields if isinstance(f.dataType, T.StringType)]
        each = signed.select("signature", F.explode(F.array(*(F.struct(F.lit(n).alias("field"), F.col("d").getField(n).alias("v")) for n in texts))).alias("x")).select("signature", "x.*").filter("v is not null")
    by = each.groupBy("field", "v", "signature").agg(F.count(F.lit(1)).alias("n"))
    value = by.groupBy("field", "v").agg((F.max("n") / F.sum("n")).alias("pure"))
    found = value.groupBy("field").agg(F.count(F.lit(1)).alias("n_values"), F.avg("pure").alias("purity"))
    return found.filter(F.col("n_values").between(*VALUES) & (F.col("purity") >= PURITY))


@dataclass(frozen=True)
class CollectionProfile:
    name: str
    doc_count: int
    sampled: int
    fields: list[dict]
    shapes: list[dict]
    polymorphic: bool
    discriminator: str | None

    def top_level(self) -> list[str]:
        return [f["path"] for f in self.fields if "." not in f["path"] and "[]" not in f["path"]]


def profile(name: str, docs: DataFrame, doc: str = "doc", size: int | None = None, seed: int = 0) -> CollectionProfile:
    """The profile of a collection of variant documents: its results have a row a path, a shape or a field, not a document."""
    total = docs.count()
    some = sampled(docs, size or sample_size(total), total, seed).persist()
    try:
        stats = [r.asDict() for r in field_stats(some, doc).orderBy("path").collect()]
        forms = [r.asDict() for r in shapes(some, doc).orderBy(F.desc("n_docs"), "signature").collect()]
        mixed = is_polymorphic([f["n_docs"] for f in forms])
        best = discriminators(some, doc).orderBy(F.desc("purity"), "field").first() if mixed else None
        return CollectionProfile(name, total, some.count(), stats, forms, mixed, best["field"] if best else None)
    finally:
        some.unpersist()
