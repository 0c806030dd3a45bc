"""Many documents to one row: the first of each group by an order, and where the result goes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docweave.operators.merge import replaced


def pick_one(df: DataFrame, by: list[str], order: str, latest: bool = True, where: Column | str | None = None, tie: str | None = None) -> DataFrame:
    """The latest or earliest row of each group, nulls of the order being the earliest; ties go to the largest or smallest `tie` (_id, if there is one).

    An aggregate of whole rows, so each task keeps one row a group before anything is shuffled, and a group may be of any size.
    """
    df = df if where is None else df.filter(where)
    tie = tie or ("_id" if "_id" in df.columns else None)
    rest = [F.col(f"`{c}`") for c in df.columns]
    key = F.struct(F.col(f"`{order}`").isNotNull().alias("told"), F.col(f"`{order}`").alias("at"), *([F.col(f"`{tie}`").alias("tie")] if tie else []))
    pick = F.max_by if latest else F.min_by
    return df.groupBy(*by).agg(pick(F.struct(*rest), key).alias("_row")).select("_row.*")


def reshape(source: DataFrame, pipeline: Callable[[DataFrame], DataFrame], target: DataFrame | None = None, mode: str = "out", on: list[str] | None = None) -> DataFrame:
    """What the destination holds afterwards: the pipeline's result, or with mode "merge" that in place of rows of the same key."""
    made = pipeline(source)
    if mode == "out" or target is None:
        return made
    if mode != "merge" or not on:
        raise ValueError("mode is out or merge, and merge needs the key to merge on")
    return replaced(target, made, on)
