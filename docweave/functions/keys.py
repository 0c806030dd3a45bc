"""Surrogate keys."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The namespace in which ids become uuids, unless a run names another.
NAMESPACE = "1f698f50-5e51-5fee-8985-c4ed74dd9d22"


def uuid5(text: Column, namespace: str = NAMESPACE) -> Column:
    """The name-based uuid (version 5) of a text: a SHA-1 hash with its version and variant digits set."""
    h = F.sha1(F.concat(F.unhex(F.lit(uuid.UUID(namespace).hex)), F.encode(text, "UTF-8")))
    piece = lambda start, n: F.substring(h, start, n)
    variant = F.substring(F.lit("89ab"), F.conv(piece(17, 1), 16, 10).cast("int") % 4 + 1, F.lit(1))
    return F.concat_ws("-", piece(1, 8), piece(9, 4), F.concat(F.lit("5"), piece(14, 3)), F.concat(variant, piece(18, 3)), piece(21, 12))


def new_id(strategy: str, source: Column, namespace: str = NAMESPACE) -> Column:
    """A key that needs nothing but the source's value; null of null, but for random ones."""
    text = source.cast("string")
    if strategy == "objectid_to_uuid":
        return F.when(text.isNotNull(), uuid5(text, namespace))
    if strategy == "passthrough":
        return text
    if strategy == "uuid_generate":
        return F.uuid()
    raise ValueError(f"{strategy} numbers rows: see with_sequence")


def shared_folder(spark: SparkSession) -> str:
    """The folder for checkpoints that the session names, or a new one where it names none (as in tests)."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="checkpoint-"))
    return sc.getCheckpointDir()


def settled(df: DataFrame) -> DataFrame:
    """df cut from its lineage by a checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def with_sequence(df: DataFrame, order: list[str | Column], to: str, start: int = 1) -> DataFrame:
    """df with dense numbers from `start` on, in order, without one partition that holds all.

    Rows are range-partitioned and sorted; each partition's offset is the number of rows before it, of which there is one row a
    partition. Rows and offsets must see the same partitions, so they are settled in between.
    """
    order = [F.col(o) if isinstance(o, str) else o for o in order]
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id()).withColumn("_place", F.monotonically_increasing_id())
    # monotonically_increasing_id counts from partition << 33 within each partition.
    placed = settled(placed.withColumn("_place", F.col("_place") - F.shiftleft(F.col("_part").cast("long"), 33)))
    counts = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = counts.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    return placed.join(F.broadcast(before), "_part").withColumn(to, F.col("_before") + F.col("_place") + start).drop("_part", "_place", "_before")
