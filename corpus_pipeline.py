"""The training-data pipeline: five stages, each written as Parquet and read again by the next.

All but the last return the columns of `documents`; the last returns the packed pieces. run() writes between stages
into the shared checkpoint folder of the session. Every decision is about a row: rows that share a doc_id, or have none,
but differ in their text are told apart by a hash of all their columns.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from corpusloom.llm import decontamination, packing, simhash, suffix_dedup, toxicity
from corpusloom.llm._shared import cut, ensure_checkpoint_dir, pick, table
from corpusloom.llm.queries import BPE
from corpusloom.llm.tokens import public_path

#: documents' columns and their types.
DOCUMENTS = {"doc_id": "long", "text": "string", "lang": "string", "source": "string", "n_chars": "long"}


def documents(df: DataFrame) -> DataFrame:
    return pick(df, **DOCUMENTS)


#: Passages of more than 50 words that stand elsewhere too go, found by strings of so many bytes.
PASSAGE_WORDS, PASSAGE_BYTES = 51, 256


def row_key() -> Column:
    """A hash of all columns of a row; nulls count."""
    return F.xxhash64(*[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in DOCUMENTS], *[F.col(c).isNull() for c in DOCUMENTS])


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier predicts as toxic go. It learns from the labels of the documents here."""
    docs = documents(docs)
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return documents(toxicity.score(docs, model, keep=tuple(DOCUMENTS)).where("predicted = 0"))


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near-duplicates one row stays: the one with the smallest id, rows without an id last.

    Among rows of the smallest id the one with the least hash stays; of rows equal in all columns one stays.
    """
    docs = documents(docs).withColumn("row_key", row_key())
    labels = cut(simhash.near_duplicates(docs, keep=("row_key",)))
    is_first = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("row_key") == F.col("first.row_key"))
    gone = labels.where(~is_first).select("doc_id", "row_key").distinct()
    twice = cut(labels.where(is_first).groupBy("doc_id", "row_key").count().where("count > 1").select("doc_id", "row_key"))

    def same(other: DataFrame, how: str) -> DataFrame:
        own = other.select(F.col("doc_id").alias("d"), F.col("row_key").alias("k"))
        return left.join(own, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("row_key") == F.col("k")), how)

    left = docs
    left = same(gone, "left_anti")
    if not twice.isEmpty():
        left = same(twice, "left_anti").unionByName(same(twice, "left_semi").dropDuplicates(["doc_id", "row_key"]))
    return left.drop("row_key")


def suffix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of more than 50 words that stand elsewhere too go; every document stays, with what is left of its text.

    The rule is the operator's with strings of PASSAGE_BYTES bytes, as 51 words of average length have about 300, and
    runs of such bytes with fewer than PASSAGE_WORDS words are left alone: shared headers, licence lines and the like.
    """
    left = suffix_dedup.remove_repeats(documents(docs), keep=("doc_id", "lang", "source"), length=PASSAGE_BYTES, least_words=PASSAGE_WORDS)
    return left.select("doc_id", F.col("kept_text").alias("text"), "lang", "source", F.length("kept_text").cast("long").alias("n_chars"))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with an occurrence of a benchmark window go. Whether one has depends on its text alone, whose hash the
    search carries instead of an id.
    """
    docs = documents(docs).withColumn("text_key", F.xxhash64(F.coalesce("text", F.lit(""))))
    searched = decontamination.decontaminate(docs.select(F.col("text_key").alias("doc_id"), "text"), table(spark, sf_dir, "benchmark"))
    hit = searched.where("n_hit > 0").select(F.col("doc_id").alias("text_key")).distinct()
    return docs.join(hit, "text_key", "left_anti").drop("text_key")


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed documents."""
    return packing.pack(documents(docs), public_path(BPE), with_ids=False).drop("ids")


STAGES = [
    ("toxicity", toxicity_stage),
    ("simhash near-dedup", simhash_stage),
    ("suffix-array dedup", suffix_stage),
    ("benchmark decontamination", decontamination_stage),
    ("packing", packing_stage),
]

#: SQL cannot express the classifier, XXH64 or the tokenizer; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir."""
    folder = f"{ensure_checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs
