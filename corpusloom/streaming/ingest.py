"""Streams: restartable acquisition, duplicates within a watermark, windows over events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.filters import passes_web
from ..functions.text import quality_score, strip, words


def acquire(spark: SparkSession, source_dir: str, schema: str, out: str, checkpoint: str, source: str, lang: str) -> StreamingQuery:
    """New files of a folder, filtered and scored, as canonical shards; what is done is known from the checkpoint.

    Takes what is there and stops; started again it takes only what came since, each file once.
    """
    raw = spark.readStream.schema(schema).parquet(source_dir)
    kept = raw.where(passes_web(F.col("text"))).withColumn("w", words(F.col("text")))
    docs = kept.select(strip(F.col("text")).alias("text"), F.lit(source).alias("source"), F.col("doc_id").cast("string").alias("id"), F.lit(lang).alias("lang"), quality_score(F.col("text"), F.col("w")).cast("float").alias("score"))
    return docs.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def first_texts(stream: DataFrame, time: str, delay: str = "1 hour") -> DataFrame:
    """The first row of each text within the watermark; what is kept as state is a digest."""
    return stream.withColumn("digest", F.sha2("text", 256)).withWatermark(time, delay).dropDuplicatesWithinWatermark(["digest"])


def windowed_counts(events: DataFrame, time: str, width: str, delay: str, *keys: str) -> DataFrame:
    """Events and sums of their values in tumbling windows; late rows within the delay still count."""
    return events.withWatermark(time, delay).groupBy(F.window(time, width), *keys).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("window.start").alias("start"), *keys, "n", "total")
