"""Sinks: document shards, JSON lines, plain samples, manifests and reports."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.statistics import numbered

SHARD_ROWS = 50_000


def write_shards(df: DataFrame, path: str, rows: int = SHARD_ROWS) -> None:
    """Canonical documents as zstd Parquet with at most `rows` rows in a file; Spark's commit makes the job atomic."""
    own = df.select("text", "source", F.col("id").cast("string"), "lang", F.col("score").cast("float"))
    own.write.option("maxRecordsPerFile", rows).option("compression", "zstd").parquet(path)


def write_exact_shards(df: DataFrame, path: str, order: list[str], rows: int = SHARD_ROWS) -> None:
    """Canonical documents in the given order, exactly `rows` of them in each file but the last, in folders shard=0, 1, ...

    One file is one task's work, as its rows follow one another in one sort.
    """
    own = numbered(df.select("text", "source", F.col("id").cast("string"), "lang", F.col("score").cast("float"), *[F.col(c).alias(f"_{c}") for c in order]), *[f"_{c}" for c in order])
    own = own.withColumn("shard", F.floor(F.col("ordinal") / rows))
    own = own.repartition("shard").sortWithinPartitions("shard", "ordinal").drop("ordinal", *[f"_{c}" for c in order])
    own.write.option("compression", "zstd").partitionBy("shard").parquet(path)


def shard_metadata(spark: SparkSession, path: str) -> DataFrame:
    """file, bytes and a digest of the first MiB of each shard."""
    df = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(path)
    return df.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("file"), F.col("length").alias("bytes"), F.sha2(F.substring("content", 1, 1 << 20), 256).alias("sha256_head"), "modificationTime")


def json_text(df: DataFrame, most: int = 1_000_000, order: list[str] | None = None) -> DataFrame:
    """Non-empty texts, cut to `most` characters, as {"text": ...} lines in column value, in an order where one is named."""
    df = df.orderBy(*order) if order else df
    return df.where("text is not null and text <> ''").select(F.to_json(F.struct(F.left("text", F.lit(most)).alias("text"))).alias("value"))


def write_lines(df: DataFrame, path: str) -> None:
    df.select("value").write.text(path)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file, written beside its name and then renamed over it in one step, in any store Spark knows: whoever reads
    the name finds the old file or the new one."""
    jvm = spark.sparkContext._jvm
    hadoop = jvm.org.apache.hadoop.fs
    target, beside = hadoop.Path(path), hadoop.Path(path + ".tmp")
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    fs = target.getFileSystem(conf)
    out = fs.create(beside, True)
    out.write(bytearray(text.encode()))
    out.close()
    renames = getattr(hadoop, "Options$Rename")
    how = spark.sparkContext._gateway.new_array(renames, 1)
    how[0] = renames.OVERWRITE
    hadoop.FileContext.getFileContext(fs.getUri(), conf).rename(fs.makeQualified(beside), fs.makeQualified(target), how)


def write_manifest(spark: SparkSession, path: str, manifest: dict) -> None:
    """A small JSON document that replaces the one before as a whole."""
    write_text(spark, path, json.dumps(manifest, ensure_ascii=False, indent=2, sort_keys=True, default=str))


def small_rows(df: DataFrame, most: int = 1000) -> list[dict]:
    """The rows of an aggregated table; an error if there are more than `most`, none is left out."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows; aggregate them first")
    return [r.asDict(recursive=True) for r in rows]


def markdown_table(df: DataFrame, most: int = 1000) -> str:
    """A small aggregated table as Markdown."""
    head = "| " + " | ".join(df.columns) + " |\n|" + "---|" * len(df.columns) + "\n"
    return head + "".join("| " + " | ".join("" if v is None else str(v) for v in r.values()) + " |\n" for r in small_rows(df, most))


def plain_table(df: DataFrame, most: int = 1000) -> str:
    """A small aggregated table in columns of equal width."""
    rows = [df.columns] + [["" if v is None else str(v) for v in r.values()] for r in small_rows(df, most)]
    widths = [max(map(len, column)) for column in zip(*rows, strict=True)]
    return "".join("  ".join(v.ljust(w) for v, w in zip(r, widths, strict=True)).rstrip() + "\n" for r in rows)


def write_reports(spark: SparkSession, path: str, title: str, tables: dict[str, DataFrame], most: int = 1000) -> None:
    """path.json, path.md and path.txt with the same aggregated tables under their names."""
    write_manifest(spark, f"{path}.json", {"title": title, **{k: small_rows(t, most) for k, t in tables.items()}})
    write_text(spark, f"{path}.md", f"# {title}\n\n" + "\n".join(f"## {k}\n\n{markdown_table(t, most)}" for k, t in tables.items()))
    write_text(spark, f"{path}.txt", f"{title}\n\n" + "\n".join(f"{k}\n{plain_table(t, most)}" for k, t in tables.items()))


def write_distribution(spark: SparkSession, path: str, counts: DataFrame, key: str, n: str = "n", most: int = 100_000) -> None:
    """A side-file of counts by key: {"total": ..., "counts": {key: n}}, most frequent first; empty keys are left out."""
    rows = [r for r in small_rows(counts.where(F.col(key).cast("string") != "").orderBy(F.desc(n), key), most)]
    write_text(spark, path, json.dumps({"total": sum(r[n] for r in rows), "counts": {str(r[key]): r[n] for r in rows}}, ensure_ascii=False, indent=2))
