"""What several operators of this subpackage share."""

from __future__ import annotations

import gc
import tempfile
from collections.abc import Iterator
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

if TYPE_CHECKING:
    import pyarrow as pa

#: The characters of [\x20\x09-\x0D].
BLANKS = "\t\n\x0b\x0c\r "
BLANK_RUN = "[\\x20\\x09-\\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, eager: bool = True) -> DataFrame:
    """df cut from its lineage by a checkpoint in the shared folder that the session names.

    A session without spark.checkpoint.dir (a test's local one) gets a folder of its own.
    """
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(df.sparkSession.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="checkpoint-"))
    return df.checkpoint(eager)


def released(spark: SparkSession) -> None:
    """Has the driver collect its garbage, upon which Spark removes the shuffle files (and, where it is set to, the checkpoints) that nothing refers to any more.

    Between the rounds of a long job they would stay until the driver's memory happened to run short.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def small_batches(spark: SparkSession) -> None:
    """Has the session hand rows to Python in batches of a few MB.

    By default a batch holds 10,000 rows; of whole texts, or of pairs of sets, that is tens of MB several times over, in Python and in the
    executor's memory outside its heap, which neither gives back.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))


def text_groups(texts: pa.Array, limit: int) -> Iterator[list[str]]:
    """An Arrow array of texts in lists of at most `limit` bytes, or of one longer text; a null is an empty text."""
    import numpy as np

    import pyarrow.compute as pc

    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + limit, side="right")))
        yield [t or "" for t in texts[at:to].to_pylist()]
        at = to


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def ascii_lower(s: Column) -> Column:
    """A-Z lower-cased and nothing else; lower() does just that where every character is one byte."""
    return F.when(F.octet_length(s) == F.char_length(s), F.lower(s)).otherwise(F.translate(s, UPPER, LOWER))


def blank_stripped(s: Column) -> Column:
    return F.btrim(s, F.lit(BLANKS))


def words_of(s: Column) -> Column:
    """The words [^\\x20\\x09-\\x0D]+ of a string, in order; an empty array where there are none."""
    bare = blank_stripped(s)
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, BLANK_RUN, -1))
