"""Line deduplication by range-partitioned hashes.

Lines become (hash of key, document, position) rows, range-partitioned on hash and document with a secondary sort, so that a
task streams a run of equal hashes in corpus order: it counts the documents of the run and sees its first occurrence, and
runs cut by a partition's border are added up afterwards. As the document is part of the range key, the lines of one very
common key spread over as many partitions as their number asks for. What comes back is a bitmap for each document that
loses lines, sparse and in words of 64 lines; texts take no part in the shuffle on hashes.

Defined results: a null text is an empty one, which is a single empty line; keys shorter than min_key_chars are never
dropped; rows with the same id and text count as one document and lose the same lines; rows with the same id and other
texts are documents of their own; null ids are ids; an empty table gives an empty result. Keys are compared by 64-bit hash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docweave.llm.common import ascii_lower, blank_stripped, stored, text_or_empty

WORD = 64


def line_keys(lines: Column) -> Column:
    return F.transform(lines, lambda x: ascii_lower(blank_stripped(x)))


def dropped_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = 10, min_key_chars: int = 1, keep_first: bool = False) -> DataFrame:
    """(_doc, _hash, drop_words, n_dropped) for each document that loses lines.

    _doc is the id and _hash that of the text; drop_words maps a word's number to 64 bits, line i being bit i % 64 of word
    i div 64; a bit that is set says drop, and a missing word that all its lines stay. With keep_first the first line in
    order of document and position stays.
    """
    text = text_or_empty(text_col)
    rows = docs.select(F.col(id_col).alias("_doc"), F.xxhash64(text).alias("_hash"), F.posexplode(line_keys(F.split(text, "\n", -1))).alias("_at", "_key"))
    rows = rows.filter(F.char_length("_key") >= max(min_key_chars, 1)).select(F.xxhash64("_key").alias("_line"), "_doc", "_hash", "_at")
    ranged = rows.repartitionByRange("_line", "_doc", "_hash").sortWithinPartitions("_line", "_doc", "_hash", "_at")
    runs = stored(ranged.groupBy("_line", "_doc", "_hash").agg(F.sort_array(F.collect_set("_at")).alias("_ats")))
    first = F.min(F.struct("_doc", "_hash", F.get("_ats", F.lit(0)).alias("at"))).alias("_first")
    common = runs.groupBy("_line").agg(F.count(F.lit(1)).alias("_docs"), first).filter(F.col("_docs") >= min_docs)
    if keep_first:
        spared = F.col("_first._doc").eqNullSafe(F.col("_doc")) & (F.col("_first._hash") == F.col("_hash"))
        lost = runs.join(common, "_line").withColumn("_ats", F.when(spared, F.slice("_ats", 2, F.size("_ats"))).otherwise(F.col("_ats")))
    else:
        lost = runs.join(common, "_line", "left_semi")
    bits = lost.select("_doc", "_hash", F.explode("_ats").alias("_at")).repartition("_doc", "_hash")
    bits = bits.groupBy("_doc", "_hash", F.floor(F.col("_at") / WORD).cast("int").alias("_word")).agg(F.bit_or(F.expr(f"shiftleft(1L, _at % {WORD})")).alias("_bits"))
    return bits.groupBy("_doc", "_hash").agg(F.map_from_entries(F.collect_list(F.struct("_word", "_bits"))).alias("drop_words"), F.sum(F.bit_count("_bits")).alias("n_dropped"))


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row, n_lines, n_dropped, kept) for each row of docs: all its columns as a struct, and the text without dropped lines."""
    text = text_or_empty(text_col)
    left = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col(id_col).alias("_id"), F.xxhash64(text).alias("_text"))
    both = left.join(bitmaps, F.col("_id").eqNullSafe(F.col("_doc")) & (F.col("_text") == F.col("_hash")), "left")
    lines = F.split(F.coalesce(F.col("row").getField(text_col), F.lit("")), "\n", -1)
    stays = lambda x, i: (F.getbit(F.coalesce(F.try_element_at(F.col("drop_words"), F.floor(i / WORD).cast("int")), F.lit(0).cast("long")), i % WORD) == 0)
    kept = F.when(F.col("drop_words").isNull(), F.coalesce(F.col("row").getField(text_col), F.lit(""))).otherwise(F.array_join(F.filter(lines, stays), "\n"))
    return both.select("row", F.size(lines).cast("long").alias("n_lines"), F.coalesce("n_dropped", F.lit(0)).cast("long").alias("n_dropped"), kept.alias("kept"))
