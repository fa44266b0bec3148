"""Bounded samples of labelled documents, and the folds that labels may be learnt from."""

from __future__ import annotations

import zlib

from pyspark.sql import Column, DataFrame, functions as F

from ._shared import pick


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id's decimal text, mod folds."""
    return F.crc32(doc_id.cast("string").cast("binary")) % folds


def held_out(doc_id: int | None, folds: int, held: int) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % folds == held


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, folds: int, held: int, most: int, most_bytes: int) -> DataFrame:
    """doc_id, text, label of at most `most` documents outside the held fold, each once, none over `most_bytes`.

    Half are of label 1 if there are as many, the rest of label 0, in the order of a hash of their ids; a document
    labelled twice has its largest label. At most 1.5 times `most` ids pass through the driver. Texts are found by a
    broadcast of those ids, so that no other text is shuffled; of equal ids the least text is taken.
    """
    own = pick(labels, doc_id="long", **{label: "int"}).where(f"doc_id is not null and {label} in (0, 1)")
    own = own.where(fold(F.col("doc_id"), folds) != held).groupBy("doc_id").agg(F.max(label).alias("label"))
    order = F.xxhash64("doc_id")
    ones = [r.doc_id for r in own.where("label = 1").orderBy(order, "doc_id").limit(most // 2).collect()]
    zeros = [r.doc_id for r in own.where("label = 0").orderBy(order, "doc_id").limit(most - len(ones)).collect()]
    chosen = docs.sparkSession.createDataFrame([(i, 1) for i in ones] + [(i, 0) for i in zeros], "doc_id long, label int")
    texts = pick(docs, doc_id="long", text="string").where(F.octet_length(F.coalesce("text", F.lit(""))) <= most_bytes)
    return texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"), F.max("label").alias("label"))
