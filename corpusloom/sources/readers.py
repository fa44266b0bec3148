"""Readers: document shards, text and JSON trees, JSONL, evaluation results, logs, pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from ..functions.clean import first_match
from ..operators.statistics import proportional_sample

#: The canonical document: what every sink writes and every stage may rely on.
DOCUMENT = "text string, source string, id string, lang string, score float"

# Candidate names of a text and of an id, the first present one is taken (fixed values).
TEXT_NAMES, ID_NAMES = ["text", "content", "body", "passage"], ["id", "doc_id", "url"]
# Fields of legal JSON files and lines that can hold the text (fixed values).
LEGAL_FIELDS, LEGAL_LINE_FIELDS = ["texto", "text", "conteudo", "content", "body"], ["texto", "text", "conteudo", "content", "body", "corpo"]


def shards(spark: SparkSession, paths: dict[str, str], columns: list[str] | None = None, skip_corrupt: bool = True) -> DataFrame:
    """Union of the Parquet shards under each source's folder, defaults for what is missing, empty texts dropped.

    Only the wanted columns are read; a column that a folder lacks is null. Unreadable files are skipped if asked.
    """
    parts = []
    for rank, (source, path) in enumerate(paths.items()):
        df = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").option("ignoreCorruptFiles", str(skip_corrupt).lower()).option("mergeSchema", "true").parquet(path)
        wanted = columns or ["text", "source", "id", "lang", "score"]
        own = df.select(*[F.col(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in wanted])
        if "source" in wanted:
            own = own.withColumn("source", F.coalesce(F.nullif("source", F.lit("")), F.lit(source)))
        if "lang" in wanted:
            own = own.withColumn("lang", F.coalesce(F.nullif("lang", F.lit("")), F.lit("por_Latn_BR")))
        if "score" in wanted:
            own = own.withColumn("score", F.coalesce(F.col("score").cast("float"), F.lit(0.0).cast("float")))
        parts.append(own.withColumn("source_rank", F.lit(rank)))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.where("text is not null and text <> ''") if "text" in out.columns else out


def bind(df: DataFrame, texts: list[str] | None = None, ids: list[str] | None = None) -> DataFrame:
    """A raw table with its text and id under their own names, found among candidates when the plan is made."""
    text = next((c for c in texts or TEXT_NAMES if c in df.columns), df.columns[0])
    key = next((c for c in ids or ID_NAMES if c in df.columns), None)
    rest = [c for c in df.columns if c not in (text, key, "text", "id")]
    return df.select(F.col(text).cast("string").alias("text"), (F.col(key).cast("string") if key else F.lit(None).cast("string")).alias("id"), *rest)


def shard_report(spark: SparkSession, path: str, required: list[str]) -> DataFrame:
    """Rows of each readable file, and whether the required columns are there. Row counts come from the footers."""
    df = spark.read.option("recursiveFileLookup", "true").option("ignoreCorruptFiles", "true").option("mergeSchema", "true").parquet(path)
    return df.groupBy(F.col("_metadata.file_path").alias("file")).agg(F.count("*").alias("rows")).withColumn("schema_ok", F.lit(all(c in df.columns for c in required)))


def integrity(files: DataFrame, report: DataFrame) -> DataFrame:
    """One row: files, readable, empty, rate; files: `file` of everything found, report: shard_report()."""
    both = files.join(report, "file", "left")
    out = both.agg(F.count("*").alias("files"), F.count_if(F.col("rows") > 0).alias("readable"), F.count_if(F.col("rows").isNull()).alias("unreadable"))
    return out.withColumn("integrity_rate", F.round(F.col("readable") / F.greatest("files", F.lit(1)), 6))


def listing(spark: SparkSession, path: str, suffixes: list[str] | None = None, without: list[str] | None = None) -> DataFrame:
    """path, length, extension and folder-relative name of every accepted file; contents are not read."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length")
    df = df.withColumn("extension", F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1)))
    if suffixes:
        df = df.where(F.col("extension").isin([s.lower() for s in suffixes]))
    for w in without or []:
        df = df.where(~F.contains("path", F.lit(f"/{w}/")) & ~F.endswith("path", F.lit(f"/{w}")))
    return df


def extension_survey(files: DataFrame, k: int = 15) -> DataFrame:
    return files.groupBy("extension").agg(F.count("*").alias("files"), F.sum("length").alias("bytes")).orderBy(F.desc("files"), "extension").limit(k)


def decoded(content: Column) -> Column:
    """Bytes as UTF-8 (a leading mark is dropped), else as Latin-1, which takes any bytes."""
    plain = F.try_validate_utf8(content.cast("string"))
    return F.regexp_replace(F.coalesce(plain, F.decode(content, "iso-8859-1")), "^\ufeff", "")


def json_text(raw: Column, fields: list[str] | None = None) -> Column:
    """The first field that holds text; without one, all strings of more than 20 characters."""
    found = [F.nullif(F.get_json_object(raw, f"$.{f}"), F.lit("")) for f in fields or LEGAL_FIELDS]
    values = F.map_values(F.from_json(raw, "map<string,string>"))
    return F.coalesce(*found, F.array_join(F.filter(values, lambda v: F.length(v) > 20), " "))


def text_tree(spark: SparkSession, path: str) -> DataFrame:
    """path and text of all .txt and .json files below a folder."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    text = decoded(F.col("content"))
    ext = F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1))
    return df.where(ext.isin(".txt", ".json")).select("path", F.when(ext == ".json", json_text(text)).otherwise(text).alias("text"))


def plain_path(uri: Column) -> Column:
    """The path of a file's address, without scheme and host and with its characters unescaped."""
    return F.url_decode(F.replace(F.regexp_replace(uri, "^[a-z][a-z0-9+.-]*:(//[^/]*)?/*", "/"), F.lit("+"), F.lit("%2B")))


def numbered_lines(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """file (relative to `path`), at (from 0) and line of all text files below a folder, compressed ones too.

    Files are split where their format allows. A line's number is its place within its split, from the order in which the
    split is read, and the lines of the file's splits before; only a row per split is aggregated.
    """
    reader = spark.read.option("recursiveFileLookup", "true")
    df = (reader.option("pathGlobFilter", glob) if glob else reader).text(path)
    df = df.select(F.col("_metadata.file_path").alias("uri"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("u"), F.col("value").alias("line"))
    blocks = df.groupBy("uri", "block").agg(F.min("u").alias("first"), F.count("*").alias("k"))
    before = F.sum("k").over(W.partitionBy("uri").orderBy("block")) - F.col("k")
    placed = df.join(blocks.select("uri", "block", "first", before.alias("before")), ["uri", "block"])
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    top = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(root).toUri().getPath().rstrip("/") + "/"
    full = plain_path(F.col("uri"))
    file = F.when(F.startswith(full, F.lit(top)), F.substring(full, len(top) + 1, 1 << 20)).otherwise(F.regexp_extract(full, r"([^/]+)$", 1))
    return placed.select(file.alias("file"), (F.col("before") + F.col("u") - F.col("first")).alias("at"), "line")


def json_lines(spark: SparkSession, path: str, fields: list[str] | None = None) -> DataFrame:
    """id (relative path:line, from 0) and text of each line that has one of the fields; other lines are skipped."""
    parsed = F.try_parse_json("line")
    found = [F.nullif(F.try_variant_get(parsed, f"$.{f}", "string"), F.lit("")) for f in fields or LEGAL_LINE_FIELDS]
    return numbered_lines(spark, path).select(F.concat_ws(":", "file", F.col("at").cast("string")).alias("id"), F.coalesce(*found).alias("text")).where("text is not null")


def shard_files(spark: SparkSession, path: str, first: int | None = None, seed: int | None = None) -> list[str]:
    """Parquet files below a folder: those named shard_* if there are any, else all; in the order of their names, or of a
    seeded hash of them; the first ones if asked. A listing, which is the driver's."""
    df = listing(spark, path, [".parquet"])
    named = df.where(F.col("path").rlike(r"/shard_[^/]*$"))
    df = df if named.isEmpty() else named
    order = F.md5(F.concat_ws(":", F.regexp_extract("path", r"([^/]+)$", 1), F.lit(str(seed)))) if seed is not None else F.col("path")
    df = df.orderBy(order, "path")
    return [r.path for r in (df.limit(first) if first is not None else df).select("path").collect()]


def sampled_texts(spark: SparkSession, path: str, columns: list[str], most: int | None = None, seed: int = 42) -> DataFrame:
    """The columns that the shards of a folder have, all rows or, of each shard, its share of `most` rows by seeded hash."""
    df = spark.read.option("mergeSchema", "true").parquet(*shard_files(spark, path))
    own = df.select(*[c for c in columns if c in df.columns], F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row"))
    if most is not None:
        own = proportional_sample(own.withColumn("_key", F.concat_ws("#", "_file", "_row")), "_file", most, "_key", seed).drop("_key")
    return own.drop("_file", "_row")


def cloze_items(df: DataFrame) -> DataFrame:
    """context and last_word of cloze rows, under any of their names; a target at the end of its context is cut off."""
    pick = lambda names: F.coalesce(*[F.nullif(F.col(n).cast("string"), F.lit("")) for n in names if n in df.columns], F.lit(None).cast("string"))
    s = F.regexp_replace(pick(["sentence", "text", "context"]), r"\s+$", "")
    w = F.regexp_replace(pick(["last_word", "target", "word"]), r"^\s+|\s+$", "")
    own = df.select("*", s.alias("_s"), w.alias("_w")).where("_s <> '' and _w <> ''")
    cut = F.regexp_replace(F.expr("left(_s, length(_s) - length(_w))"), r"\s+$", "")
    return own.select(*[c for c in df.columns], F.when(F.endswith("_s", F.col("_w")), cut).otherwise(F.col("_s")).alias("context_only"), F.col("_w").alias("answer"))


#: Fields of a result file; results: task -> "metric,filter" -> value.
RESULT = "results map<string,map<string,string>>, model_name string, date string, config struct<model_args:string>"


def evaluation_results(spark: SparkSession, path: str) -> DataFrame:
    """model, task, metric, value, date of every result file below a folder; others are skipped."""
    raw = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").text(path, wholetext=True).withColumn("file", F.col("_metadata.file_path"))
    r = raw.select("file", F.from_json("value", RESULT).alias("r")).where("r.results is not null")
    model = F.coalesce(F.nullif("r.model_name", F.lit("")), F.nullif(F.regexp_extract("r.config.model_args", "pretrained=([^,]+)", 1), F.lit("")), F.regexp_extract("file", "([^/]+)/[^/]+$", 1))
    tasks = r.select(model.alias("model"), F.col("r.date").alias("date"), F.explode("r.results").alias("task", "metrics"))
    return tasks.select("model", "date", "task", F.explode("metrics").alias("metric", "raw")).select("model", "date", "task", F.substring_index("metric", ",", 1).alias("metric"), F.expr("try_cast(raw as double)").alias("value")).where("value is not null")


def preferred_metric(df: DataFrame, preferences: list[str]) -> DataFrame:
    """The first of the preferred metrics that a (model, task, date) has, as a percentage."""
    order = F.array(*[F.lit(p) for p in preferences])
    ranked = df.withColumn("at", F.array_position(order, F.col("metric"))).where("at > 0")
    first = ranked.groupBy("model", "task", "date").agg(F.min_by("metric", "at").alias("metric"), F.min_by("value", "at").alias("value"))
    return first.withColumn("value", F.when(F.col("value") <= 1, F.col("value") * 100).otherwise(F.col("value")))


def named_models(df: DataFrame, table: list[tuple[str, str]]) -> DataFrame:
    return df.withColumn("name", first_match(F.col("model"), table, F.col("model")))


def sample_lines(spark: SparkSession, path: str) -> DataFrame:
    """label, task, doc_id, correct from the newest samples file of each (label, task); later lines win."""
    raw = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "samples_*.jsonl").text(path, wholetext=True)
    files = raw.select(F.col("_metadata.file_path").alias("file"), "value").select(F.regexp_extract("file", r"([^/]+)/[^/]+$", 1).alias("label"), F.regexp_extract("file", r"samples_(.+?)_\d{4}-", 1).alias("task"), "file", "value")
    newest = files.withColumn("rank", F.row_number().over(W.partitionBy("label", "task").orderBy(F.desc("file")))).where("rank = 1")
    rows = newest.select("label", "task", F.posexplode(F.split("value", "\n")).alias("at", "line")).withColumn("j", F.from_json("line", "map<string,string>")).where("j is not null")
    value = F.coalesce(*[F.col("j")[m].try_cast("double") for m in ("acc_norm", "acc_norm,none", "acc", "acc,none")])
    rows = rows.select("label", "task", "at", F.col("j")["doc_id"].try_cast("long").alias("doc_id"), value.alias("value")).where("doc_id is not null and value is not null")
    return rows.groupBy("label", "task", "doc_id").agg(F.max_by("value", "at").cast("tinyint").alias("correct"))


def training_log(lines: DataFrame) -> DataFrame:
    """iteration, rate, loss, grad_norm, skipped, failed from log lines in column value; other lines are skipped."""
    take = lambda p: F.regexp_extract("value", p, 1)
    real = lambda p: F.expr(f"try_cast(nullif({p}, '') as double)")
    raw = lines.select(
        take(r"iteration\s+(\d+)/").alias("i"), take(r"learning rate:\s*([0-9.E+-]+)").alias("r"), take(r"lm loss:\s*([0-9.E+-]+)").alias("l"),
        take(r"grad norm:\s*([0-9.E+naN-]+)").alias("g"), take(r"number of skipped iterations:\s*(\d+)").alias("s"), take(r"number of nan iterations:\s*(\d+)").alias("f"),
    ).where("i <> '' and l <> ''")
    return raw.select(F.col("i").cast("bigint").alias("iteration"), real("r").alias("rate"), real("l").alias("loss"), F.coalesce(real("g"), F.lit(float("nan"))).alias("grad_norm"), F.coalesce(F.expr("try_cast(s as bigint)"), F.lit(0)).alias("skipped"), F.coalesce(F.expr("try_cast(f as bigint)"), F.lit(0)).alias("failed"))


def markdown(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.md").text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("text"))
