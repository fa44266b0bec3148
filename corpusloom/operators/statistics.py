"""Grouped statistics of corpora: volumes, shares, funnels, percentiles, histograms, samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..session import cut


def share(value: Column) -> Column:
    """A value's part of the total over all rows of an aggregated table, in percent."""
    return F.round(value * 100.0 / F.sum(value).over(W.partitionBy()), 4)


def ranked_percentiles(df: DataFrame, groups: list[str], value: str, ps: list[int]) -> DataFrame:
    """Nearest-rank percentiles of each group: the value at place floor(n p / 100), the last one at most.

    Equal values are counted before anything is shuffled and a window runs over distinct values only: rounded
    measurements have few, however many rows a group has.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*groups, value).agg(F.count("*").alias("k"))
    w = W.partitionBy(*groups)
    placed = counts.withColumn("upto", F.sum("k").over(w.orderBy(value))).withColumn("n", F.sum("k").over(w))
    spot = lambda p: F.least(F.floor(F.col("n") * F.lit(p) / 100), F.col("n") - 1)
    picks = [F.min(F.when(F.col("upto") > spot(p), F.col(value))).alias(f"p{p}") for p in ps]
    return placed.groupBy(*groups).agg(F.sum("k").alias("n"), F.round(F.sum(F.col(value) * F.col("k")) / F.sum("k"), 4).alias("mean"), *picks)


def histogram(df: DataFrame, value: str, bins: int = 20) -> DataFrame:
    """Equal-width bins from the least to the greatest value, the last one closed."""
    edge = df.agg(F.min(value).cast("double").alias("lo"), F.max(value).cast("double").alias("hi"))
    edge = edge.select(F.when(F.col("lo") == F.col("hi"), F.col("lo") - 0.5).otherwise(F.col("lo")).alias("lo"), F.when(F.col("lo") == F.col("hi"), F.col("hi") + 0.5).otherwise(F.col("hi")).alias("hi"))
    placed = df.where(F.col(value).isNotNull()).join(F.broadcast(edge))  # one row of edges
    at = F.least(F.floor((F.col(value) - F.col("lo")) / ((F.col("hi") - F.col("lo")) / float(bins))), F.lit(bins - 1))
    return placed.select(at.cast("int").alias("bin")).groupBy("bin").agg(F.count("*").alias("n"))


def numbered(df: DataFrame, *order: str, name: str = "ordinal") -> DataFrame:
    """df with gapless numbers from 0 in the order of the columns; rows equal in all of them are numbered in any order.

    Rows are range-partitioned, numbered within their partitions and shifted by the counts of the partitions before, so
    that no task numbers more than its own part.
    """
    ranged = cut(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)))
    counts = ranged.groupBy("_part").count()
    firsts = counts.select("_part", (F.sum("count").over(W.orderBy("_part")) - F.col("count")).alias("_first"))  # a row per partition
    return ranged.join(F.broadcast(firsts), "_part").withColumn(name, F.col("_first") + F.col("_at")).drop("_part", "_first", "_at")


def systematic_sample(df: DataFrame, every: int, *order: str) -> DataFrame:
    """Each `every`-th row in a total order of distinct keys: only the keys are ordered and numbered, then they select."""
    keys = numbered(df.select(*order), *order, name="_n").where((F.col("_n") + 1) % every == 0).select(*order)
    return df.join(keys, list(order), "left_semi")


def budget_prefix(df: DataFrame, group: str, size: Column, budget: int, order: str, *ties: str, budgets: DataFrame | None = None) -> DataFrame:
    """Rows of each group, in the order of a hexadecimal hash, while the sizes before them are under the budget.

    Sizes are summed by the hash's first three digits; what lies wholly under the budget is kept as it is, and only the
    one part of each group that crosses it is numbered row by row. budgets: `group` and `budget`, where groups differ.
    """
    sized = df.withColumn("bucket", F.substring(order, 1, 3)).withColumn("_size", size)
    sums = sized.groupBy(group, "bucket").agg(F.sum("_size").alias("s"))
    upto = F.sum("s").over(W.partitionBy(group).orderBy("bucket"))  # 4096 rows for a group at most
    parts = sums.withColumn("upto", upto).withColumn("base", F.col("upto") - F.col("s"))
    parts = parts.join(budgets, group) if budgets is not None else parts.withColumn("budget", F.lit(budget))
    parts = cut(parts.where("base < budget").select(group, "bucket", "base", "upto", "budget"))
    near = sized.join(parts, [group, "bucket"])
    w = W.partitionBy(group, "bucket").orderBy(order, *ties).rowsBetween(W.unboundedPreceding, -1)
    crossing = near.where("upto >= budget").withColumn("before", F.col("base") + F.coalesce(F.sum("_size").over(w), F.lit(0))).where("before < budget")
    return near.where("upto < budget").select(*df.columns).unionByName(crossing.select(*df.columns))


def seeded(key: Column, seed: int) -> Column:
    """A hexadecimal hash of a key and a seed, whose order is a shuffle."""
    return F.md5(F.concat_ws(":", key.cast("string"), F.lit(str(seed))).cast("binary"))


def proportional_sample(df: DataFrame, group: str, most: int, key: str, seed: int = 42) -> DataFrame:
    """Of each group max(1, round(most n / total)) rows in the order of a seeded hash; everything if `most` covers it.

    Only counts by group and hash prefix are gathered; a group's rows are numbered in the part that crosses its share.
    """
    counts = cut(df.groupBy(group).agg(F.count("*").alias("n")))
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    if total <= most:
        return df
    wanted = F.greatest(F.lit(1), F.round(F.lit(most) * F.col("n") / F.lit(total))).cast("long")
    return budget_prefix(df.withColumn("_order", seeded(F.col(key), seed)), group, F.lit(1), 0, "_order", key, budgets=counts.select(group, wanted.alias("budget"))).drop("_order")


def random_rows(df: DataFrame, k: int, key: str, seed: int = 42) -> DataFrame:
    """k rows in the order of a seeded hash: each task sends its k least, no row is shuffled otherwise."""
    return df.withColumn("_order", seeded(F.col(key), seed)).orderBy("_order", key).limit(k).drop("_order")


def linear_percentiles(df: DataFrame, groups: list[str], value: str, ps: list[float], digits: int = 4) -> DataFrame:
    """Percentiles between neighbouring ranks of values rounded to `digits`, counted before anything is ordered."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*groups, F.round(value, digits).alias("v")).agg(F.count("*").alias("k"))
    w = W.partitionBy(*groups)
    placed = counts.withColumn("upto", F.sum("k").over(w.orderBy("v"))).withColumn("n", F.sum("k").over(w))
    at = lambda rank: F.min(F.when(F.col("upto") > rank, F.col("v")))
    out = []
    for p in ps:
        rank = (F.col("n") - 1) * F.lit(p)
        low = F.floor(rank)
        out += [at(low).alias(f"lo{p}"), at(F.least(low + 1, F.col("n") - 1)).alias(f"hi{p}"), F.first(rank - low).alias(f"of{p}")]
    found = placed.groupBy(*groups).agg(F.sum("k").alias("n"), *out)
    return found.select(*groups, "n", *[F.round(F.col(f"`lo{p}`") + (F.col(f"`hi{p}`") - F.col(f"`lo{p}`")) * F.col(f"`of{p}`"), digits).alias(f"p{round(100 * p)}") for p in ps])


def top(df: DataFrame, key: str, k: int) -> DataFrame:
    """The k most frequent values; of equal counts the smaller value."""
    return df.groupBy(key).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.asc(key)).limit(k)


def funnel(df: DataFrame, *stages: tuple[str, Column]) -> DataFrame:
    """One row: rows seen, rows dropped by each stage that is the first to refuse them, rows kept, the rate."""
    stage = F.lit("kept")
    for name, accepts in reversed(stages):
        stage = F.when(~accepts, F.lit(name)).otherwise(stage)
    counts = [F.count_if(F.col("stage") == n).alias(f"skip_{n}") for n, _ in stages]
    out = df.select(stage.alias("stage")).agg(F.count("*").alias("seen"), *counts, F.count_if(F.col("stage") == "kept").alias("kept"))
    return out.withColumn("retention", F.round(F.col("kept") / F.greatest("seen", F.lit(1)), 6))


def described(report: DataFrame, key: str, facts: dict[str, tuple[str, str]], unknown: str = "—") -> DataFrame:
    """The report with licence and domain of each key from a small dimension; `unknown` where it has none."""
    rows = [(k, *v) for k, v in facts.items()]
    dimension = report.sparkSession.createDataFrame(rows, f"{key} string, license string, domain string")
    joined = report.join(F.broadcast(dimension), key, "left")
    return joined.withColumns({c: F.coalesce(c, F.lit(unknown)) for c in ("license", "domain")})
