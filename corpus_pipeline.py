"""The corpus pipeline: five operators in a row, each over all that the one before kept.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes it as Parquet to the shared scratch folder and
reads it again as the next stage's docs. All but the last return the columns of ``documents``.

A document is a row: where doc_ids are null or repeated, a stage works on row ids and gives the doc_ids back.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import decontam, langid, minhash, packing, suffixes
from quire.llm.common import bounded, materialize, table


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a language (no text, no letter); the others' lang is the predicted one where it was null."""
    bounded(spark)
    found = langid.identify(docs, langid.fit(docs), label="__lang", score="__score").where("`__lang` != 'und'")
    return found.withColumn("lang", F.coalesce("lang", "__lang")).select(*docs.columns)


def by_row(docs: DataFrame, stage: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``stage`` of docs, with ids of the rows' own, in the order of doc_id, if doc_ids are null or repeated."""
    if docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 or doc_id is null").isEmpty():
        return stage(docs)
    order = ["doc_id", F.xxhash64("text")]
    rows = docs.repartitionByRange(*order).sortWithinPartitions(*order)
    rows = materialize(rows.withColumn("__given", F.col("doc_id")).withColumn("doc_id", F.monotonically_increasing_id()), "rows")
    return stage(rows).withColumn("doc_id", F.col("__given")).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the first document (least doc_id) of each group of near duplicates; a document without a doc_id is its own group.

    Rows equal in doc_id and text are one document; rows that share a doc_id but not the text are two.
    """

    def first(rows: DataFrame) -> DataFrame:
        gone = minhash.near_duplicates(rows).where("not kept").select(F.col("doc_id").alias("__id")).distinct()
        return rows.join(gone, rows["doc_id"] == F.col("__id"), "left_anti")

    named = docs.where("doc_id is not null")
    if named.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").isEmpty():
        return first(docs)
    return by_row(named.dropDuplicates(["doc_id", "text"]), first).unionByName(docs.where("doc_id is null"))


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts repeated strings of 100 bytes out of the texts; a document of which nothing is left goes."""

    def cut(rows: DataFrame) -> DataFrame:
        found = suffixes.remove_repeats(rows).where("n_removed > 0").select(F.col("doc_id").alias("__id"), "kept")
        changed = rows.join(found, rows["doc_id"] == F.col("__id"), "left")
        # a cut can part a character's bytes: what is left of such a character is dropped
        text = F.when(F.col("kept").isNull(), F.col("text")).otherwise(suffixes.as_text(F.col("kept")))
        changed = changed.withColumn("text", text).where("length(text) > 0")
        return changed.withColumn("n_chars", F.length("text").cast("long")).select(*rows.columns)

    return by_row(docs, cut)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item."""

    def clean(rows: DataFrame) -> DataFrame:
        gone = decontam.contaminated(rows, table(spark, sf_dir, "benchmark")).select(F.col("doc_id").alias("__id"))
        return rows.join(gone, rows["doc_id"] == F.col("__id"), "left_anti")

    return by_row(docs, clean)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the documents into sequences of 1024 tokens: pieces with their ids (little-endian uint32) and places."""
    return packing.pack_documents(docs)


STAGES = [
    ("language ID", identify_language),
    ("MinHash near-dedup", drop_near_duplicates),
    ("suffix-array dedup", cut_repeats),
    ("benchmark decontamination", drop_contaminated),
    ("best-fit packing", pack_sequences),
]

#: Language prediction and tokenization are not SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
