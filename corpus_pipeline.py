"""The corpus pipeline: quality classifier, line dedup, near-duplicate removal, mixing and encoding, over all documents.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept. All but the last return the columns of
documents. Documents are told apart by id and text, so rows that share an id are separate ones, unless their texts are equal too.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.llm import bpe, line_dedup, mixing, near_duplicates, quality_cnn
from docweave.llm.common import small_batches, stored, table, words_of
from docweave.llm.queries import MARGINS, tokenizer

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
MIN_SCORE = 0.3
#: One tree of results isn't SQL: the classifier is a network and the tokenizer a library.
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a network trained on the labelled ones doesn't reject."""
    small_batches(spark)
    net = quality_cnn.fit(docs, table(spark, sf_dir, "labels"))
    return quality_cnn.score(docs.select(*COLUMNS), net, keep_text=True).filter(F.col("score") >= MIN_SCORE).select(*COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that stand in ten of them or more; n_chars follows the text."""
    docs = docs.select(*COLUMNS)
    out = line_dedup.apply_bitmaps(docs, line_dedup.dropped_lines(docs, min_docs=10, min_key_chars=1))
    text = F.when(F.col("n_dropped") > 0, F.col("kept")).otherwise(F.col("row.text"))
    return out.select("row.doc_id", text.alias("text"), "row.lang", "row.source", F.when(F.col("n_dropped") > 0, F.char_length("kept").cast("bigint")).otherwise(F.col("row.n_chars")).alias("n_chars"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked by five-word shingles (a Jaccard similarity of 0.8 or more) the one with the smallest id.

    Documents without words belong to no group and all stay.
    """
    small_batches(spark)
    key = F.xxhash64(F.coalesce("text", F.lit("")))
    # Null ids come last, so that one is kept only where a group has no other.
    own = docs.select(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", key.alias("text_key")).alias("_own"), "text")
    groups = near_duplicates.link(own, id_col="_own", words=5, percent=80)
    first = groups.filter(F.col("component_id") == F.col("_doc")).select(F.col("_doc.doc_id").alias("_id"), F.col("_doc.text_key").alias("_key")).distinct()
    kept = docs.select(*COLUMNS, key.alias("_text_key")).join(first, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_text_key") == F.col("_key")), "left_semi")
    worded = F.size(words_of(F.coalesce("text", F.lit("")))) > 0
    # Rows that agree in id and text are one document; only they can meet here.
    return kept.filter(worded).dropDuplicates(["doc_id", "_text_key"]).unionByName(kept.filter(~worded)).select(*COLUMNS)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample of the documents whose sources, languages and topics have their target shares of tokens."""
    text = F.coalesce("text", F.lit(""))
    counted = docs.select(*COLUMNS, mixing.topic(text).alias("topic"), F.size(words_of(text)).cast("long").alias("_tokens"))
    return mixing.mix(counted, MARGINS, "_tokens").filter("_kept").select(*COLUMNS)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' token ids, with the hash of the text that they decode to."""
    small_batches(spark)
    return bpe.encode(docs.select("doc_id", "lang", "source", "text"), tokenizer("byte_bpe_50k.json"), ("n_tokens", "ids", "ids_sha256", "decoded_sha256"))


STAGES = [("quality", quality), ("lines", lines), ("near_copies", near_copies), ("mixture", mixture), ("encoding", encoding)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
