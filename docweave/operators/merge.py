"""Write dispositions as plans: upserts on plain tables, conflicts, and the constraints that Spark doesn't keep."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweave.plans.catalog import Catalog, TableDef


def upsert(old: DataFrame, new: DataFrame, keys: list[str], update: list[str] | None = None) -> DataFrame:
    """old with the rows of new: of a known key the columns in `update` (all of new's, if None) take new's values, others stay; new keys are added.

    Columns that new lacks are null in added rows. With nothing to update a known key is left as it is.
    """
    update = [c for c in new.columns if c not in keys] if update is None else update
    right = new.select(*(F.col(f"`{k}`").alias(f"_k{i}") for i, k in enumerate(keys)), F.struct(*(F.col(f"`{c}`") for c in new.columns)).alias("_new"))
    left = old.select(F.struct(*(F.col(f"`{c}`") for c in old.columns)).alias("_old"), *(F.col(f"`{k}`").alias(f"_o{i}") for i, k in enumerate(keys)))
    on = [F.col(f"_o{i}") == F.col(f"_k{i}") for i in range(len(keys))]
    both = left.join(right, on, "full_outer")
    had, comes = F.col("_old").isNotNull(), F.col("_new").isNotNull()

    def pick(c: str):
        mine, theirs = F.col("_old").getField(c), F.col("_new").getField(c) if c in new.columns else F.lit(None)
        return (F.when(comes, theirs).otherwise(mine) if c in update else F.when(had, mine).otherwise(theirs)).alias(c)

    return both.select(*(pick(c) for c in old.columns))


def insert_missing(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """old and those rows of new whose key it doesn't have, one for each key."""
    return old.unionByName(new.dropDuplicates(keys).join(old.select(*keys), keys, "left_anti"), allowMissingColumns=True)


def conflicts(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Keys of new that old has: what an append would stop at."""
    return new.select(*keys).join(old.select(*keys), keys, "left_semi").distinct()


def replaced(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """old with whole rows of new in place of those of the same keys (nulls equal nulls)."""
    on = [old[k].eqNullSafe(new[k]) for k in keys]
    return old.join(new, on, "left_anti").unionByName(new, allowMissingColumns=True)


# Constraints. Each gives (table, constraint, value, n): what breaks it, and how often.


def _told(df: DataFrame, table: str, constraint: str) -> DataFrame:
    return df.select(F.lit(table).alias("table"), F.lit(constraint).alias("constraint"), "value", "n")


def _text(columns: list[str]):
    return F.concat_ws(",", *(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("null")) for c in columns))


def not_null(df: DataFrame, table: str, column: str) -> DataFrame:
    found = df.filter(F.col(f"`{column}`").isNull()).agg(F.count(F.lit(1)).alias("n")).filter("n > 0").select(F.lit("null").alias("value"), "n")
    return _told(found, table, f"not null {column}")


def unique(df: DataFrame, table: str, columns: list[str], what: str = "unique") -> DataFrame:
    """Repeated keys; keys with a null in them don't count, as in SQL."""
    whole = df.filter(F.lit(True) if not columns else sum((F.col(f"`{c}`").isNull().cast("int") for c in columns), F.lit(0)) == 0)
    found = whole.groupBy(*columns).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    return _told(found.select(_text(columns).alias("value"), "n"), table, f"{what} {', '.join(columns)}")


def references(df: DataFrame, table: str, column: str, parent: DataFrame, key: str, what: str) -> DataFrame:
    """Values that the parent's key doesn't have, with their rows."""
    seen = df.filter(F.col(f"`{column}`").isNotNull()).groupBy(F.col(f"`{column}`").cast("string").alias("value")).agg(F.count(F.lit(1)).alias("n"))
    return _told(seen.join(parent.select(F.col(f"`{key}`").cast("string").alias("value")), "value", "left_anti"), table, f"{column} references {what}")


def too_long(df: DataFrame, table: str, column: str, most: int) -> DataFrame:
    found = df.filter(F.char_length(f"`{column}`") > most).groupBy(F.col(f"`{column}`").alias("value")).agg(F.count(F.lit(1)).alias("n"))
    return _told(found, table, f"{column} of at most {most} characters")


def violations(tables: dict[str, DataFrame], catalog: Catalog) -> DataFrame | None:
    """All that breaks a constraint of the catalogue in the given tables; references to tables that aren't given are not checked."""
    found: list[DataFrame] = []
    for name, df in tables.items():
        d: TableDef = catalog[name]
        for c in d.columns.values():
            if c.name in df.columns:
                if not c.nullable and not c.is_serial:
                    found.append(not_null(df, name, c.name))
                if c.max_chars:
                    found.append(too_long(df, name, c.name, c.max_chars))
        for keys, what in ((d.primary_key, "primary key"), *((u, "unique") for u in d.unique)):
            if keys and set(keys) <= set(df.columns):
                found.append(unique(df, name, list(keys), what))
        for k in d.foreign_keys:
            if k.table in tables and k.column in df.columns and k.target in tables[k.table].columns:
                found.append(references(df, name, k.column, tables[k.table], k.target, f"{k.table}.{k.target}"))
    out = None
    for f in found:
        out = f if out is None else out.unionByName(f)
    return out
