"""Lookup joins: a reference to a document becomes the key of the row that the document became.

The map of ids has (entity, source_id, target_id), all text. A lookup is a left join on the source's id; Catalyst sees both sides' sizes
and picks a broadcast or a shuffle, and splits skewed keys. A map that repeats a key would multiply rows, so it is
deduplicated first, the last write winning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

ID_MAP = "entity string, source_id string, target_id string, loaded_at timestamp"
#: What happens to a row: an error, a skip, or (for information) a reference that became null.
EVENT = "struct<kind:string,field:string,message:string>"


class LookupError_(RuntimeError):
    """A lookup that cannot be meant: the entity looked up has never been loaded."""


def empty_id_map(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], ID_MAP)


def latest(id_map: DataFrame) -> DataFrame:
    """One row for each (entity, source_id): the last loaded, then the largest target_id."""
    return id_map.groupBy("entity", "source_id").agg(F.max(F.struct("loaded_at", "target_id")).alias("_last")).select("entity", "source_id", "_last.target_id", "_last.loaded_at")


def upsert_id_map(old: DataFrame, new: DataFrame) -> DataFrame:
    """old with the rows of new in place of those of the same key; of new rows with one key the last."""
    w = Window.partitionBy("entity", "source_id").orderBy(F.desc("loaded_at"), F.desc("target_id"))
    last = new.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")
    return old.join(last.select("entity", "source_id"), ["entity", "source_id"], "left_anti").unionByName(last.select(*old.columns))


def known_ids(id_map: DataFrame, entity: str) -> DataFrame:
    return latest(id_map.filter(F.col("entity") == entity)).select("source_id", "target_id")


def lookup(df: DataFrame, key: Column, id_map: DataFrame, entity: str, to: str) -> DataFrame:
    """df with `to` (the found target_id as text, or null) and `to`_missed (a key that isn't in the map)."""
    known = known_ids(id_map, entity).select(F.col("source_id").alias(f"{to}_key"), F.col("target_id").alias(to))
    return df.withColumn(f"{to}_of", key.cast("string")).join(known, F.col(f"{to}_of") == F.col(f"{to}_key"), "left").withColumn(f"{to}_missed", F.col(f"{to}_of").isNotNull() & F.col(f"{to}_key").isNull()).drop(f"{to}_key")


def event(kind: str, field: str, message: Column | str, when: Column) -> Column:
    text = F.lit(message) if isinstance(message, str) else message
    return F.when(when, F.struct(F.lit(kind).alias("kind"), F.lit(field).alias("field"), text.alias("message")))


def missing_event(policy: str, field: str, entity: str, missed: Column, key: Column) -> Column:
    """What a dangling reference does: E stops a load, S leaves the row out, N makes the reference null."""
    kind = {"error": "E", "skip_row": "S", "null": "N"}[policy]
    return event(kind, field, F.concat(F.lit(f"{entity} has no "), F.coalesce(key.cast("string"), F.lit("null"))), missed)


def require_loaded(id_map: DataFrame, entities: dict[str, DataFrame]) -> None:
    """For entities whose misses are to be skipped or nulled (entity -> rows that missed): an entity without a single key was never
    loaded, and its misses say nothing about single rows."""
    for entity, missed in entities.items():
        if id_map.filter(F.col("entity") == entity).isEmpty() and not missed.isEmpty():
            raise LookupError_(f"{entity} has never been loaded, so no reference to it can be resolved")


def dangling(df: DataFrame, key: Column, id_map: DataFrame, entity: str) -> DataFrame:
    """(source_id, n_rows): each distinct key that the map doesn't have, and how many rows carry it."""
    seen = df.select(key.cast("string").alias("source_id")).filter("source_id is not null").groupBy("source_id").agg(F.count(F.lit(1)).alias("n_rows"))
    return seen.join(id_map.filter(F.col("entity") == entity).select("source_id"), "source_id", "left_anti")
