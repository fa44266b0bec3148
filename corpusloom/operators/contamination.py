"""Contamination of documents by benchmark texts: shared runs of 13 lower-cased words."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.text import shingles, words
from ..session import cut

NGRAM = 13
#: Benchmark runs up to this many are broadcast; beyond it the join is shuffled.
BROADCAST_ROWS = 2_000_000


def runs(df: DataFrame, key: str, n: int = NGRAM) -> DataFrame:
    return df.select(key, words(F.lower("text")).alias("w")).where("text is not null").select(key, F.explode(shingles(F.col("w"), n)).alias("run"))


def hits(docs: DataFrame, benchmark: DataFrame, n: int = NGRAM, key: str = "doc_id", item: str = "item_id") -> DataFrame:
    """Each document with each item it shares a run with, and how many; only documents of n words or more."""
    theirs = benchmark.where("text is not null").select(item, F.explode(shingles(words(F.lower("text")), n)).alias("run")).distinct()
    theirs = cut(theirs)  # counted, then joined
    long_enough = docs.where("text is not null").select(key, words(F.lower("text")).alias("w")).where(F.size("w") >= n)
    ours = long_enough.select(key, F.explode(shingles(F.col("w"), n)).alias("run"))
    small = theirs.count() <= BROADCAST_ROWS
    joined = ours.join(F.broadcast(theirs) if small else theirs, "run")
    return joined.groupBy(key, item).agg(F.count("*").alias("shared"))


def rates(docs: DataFrame, found: DataFrame, n: int = NGRAM, key: str = "doc_id") -> DataFrame:
    """One row: documents, those long enough, contaminated ones, their rate."""
    total = docs.agg(F.count("*").alias("documents"), F.count_if(F.size(words(F.col("text"))) >= n).alias("eligible"))
    bad = found.agg(F.count_distinct(key).alias("contaminated"))
    return total.join(F.broadcast(bad)).withColumn("rate", F.round(F.col("contaminated") / F.greatest("eligible", F.lit(1)), 6))
