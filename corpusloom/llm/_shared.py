"""Helpers that every operator of this subpackage uses."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import cut, ensure_checkpoint_dir  # noqa: F401


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables, read by Spark so that any store it knows will do."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(df: DataFrame, **types: str) -> DataFrame:
    """The named columns cast to the given types and nothing else.

    Columns are found by exact name and position (the first of equal names), so that extra columns, even ones
    whose names differ in case only or equal an operator's own output, never make a reference ambiguous.
    """
    own = df.toDF(*[f"_c{i}" for i in range(len(df.columns))])
    return own.select(*[F.col(f"_c{df.columns.index(n)}").cast(t).alias(n) for n, t in types.items()])


def slices(batches: Iterator, rows: int = 512) -> Iterator:
    """The batches in pieces of few rows, so that a worker holds few texts as Python strings at a time.

    At the end freed memory goes back to the system: workers live on, and their share of an executor is bounded.
    """
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
    release()


def release() -> None:
    """Gives freed memory back where the C library can."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)
