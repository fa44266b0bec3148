"""Sharding by sampled splitters: near-equal bytes, equal texts together.

Records are ordered by the hash of their text, then by doc_id and the record itself. A size-weighted sample of the
hashes gives splitters; a hash that the sample meets more than once is overfull and its range is subdivided by
doc_id and a number stored with each record. Ranges are then measured exactly.

Groups of equal texts stay whole. Those larger than `LARGE` of a shard, of which there cannot be more than shards / LARGE,
are dealt first, the largest to the shard with the least bytes so far. A group that would lift even that shard over its
equal part of all bytes by more than LARGE cannot stay whole under the law; its records are dealt like single ones. All
others fill the shards up to one level: they are cut at quantiles of their cumulative bytes, and a group at a cut goes
where its middle is. So a shard has about LARGE more or less than its part, or a record where one is larger. Slots number a shard's records in order.

Only splitters, one per `ROWS_PER_RANGE` records, the large groups and a few rows of totals per range reach the driver;
texts are never shuffled. The law is `bytes`.

Defined cases: a null text has size 1, and null texts form one group, with no empty text in it; a null doc_id sorts
first; repeated rows are records of their own; a very long text is one record, however large; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Window as W, functions as F

from ._shared import cut, pick

#: Records that a range should hold, the least number of ranges, and the sample for each of them.
ROWS_PER_RANGE, LEAST_RANGES, SAMPLE_PER_RANGE = 500_000, 64, 20
#: The part of a shard's bytes over which a group of equal texts is dealt on its own.
LARGE = 0.01


def splitters(rows: DataFrame, n_ranges: int, total: int) -> tuple[list[int], list[tuple[int, int, int]]]:
    """Boundary hashes, and boundary (hash, doc_id, number) keys inside overfull ones, from a size-weighted sample.

    A record is drawn with a chance in proportion to its size; the rows are stored, so a seed draws the same ones each
    time. About SAMPLE_PER_RANGE keys for each range reach the driver.
    """
    share = SAMPLE_PER_RANGE * n_ranges / max(total, 1)
    drawn = rows.where(F.rand(42) < F.col("size") * share).select("h", F.coalesce("doc_id", F.lit(-(1 << 63))).alias("d"), "u").collect()
    drawn = sorted((r.h, r.d, r.u) for r in drawn)
    if not drawn:
        return [], []
    picked = [drawn[i * len(drawn) // n_ranges] for i in range(1, n_ranges)]
    often = {a[0] for a, b in zip(picked, picked[1:], strict=False) if a[0] == b[0]}
    bounds = sorted({p[0] for p in picked} | {h + 1 for h in often if h < (1 << 63) - 1})
    return bounds, sorted({p for p in picked if p[0] in often})


def placed_in_ranges(rows: DataFrame, bounds: list[int], inner: list[tuple[int, int, int]]) -> DataFrame:
    """The rows with r, their range, and split, whether their hash is overfull and subdivided.

    Ranges are found by binary search in the broadcast splitters, whose number the caller bounds.
    """
    hot: dict[int, list[tuple[int, int]]] = {}
    for h, d, u in inner:
        hot.setdefault(h, []).append((d, u))
    shared = rows.sparkSession.sparkContext.broadcast((bounds, hot))

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        edges, parts = shared.value
        edges, keys = np.array(edges, np.int64), np.array(sorted(parts), np.int64)
        for batch in batches:
            h = batch.column("h").to_numpy(zero_copy_only=False)
            d = batch.column("doc_id").fill_null(-(1 << 63)).to_numpy(zero_copy_only=False)
            r = np.searchsorted(edges, h, "right").astype(np.int64) << 20
            split = np.isin(h, keys)
            for k in np.unique(h[split]).tolist():
                mine = h == k
                own = np.rec.fromarrays([d[mine], batch.column("u").to_numpy()[mine]], dtype=[("d", np.int64), ("u", np.int64)])
                r[mine] += np.searchsorted(np.array(parts[k], own.dtype), own, "right")
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(r), pa.array(split)], [*batch.schema.names, "r", "split"])

    return rows.mapInArrow(run, "doc_id long, size long, text_crc32 long, h long, u long, r long, split boolean")


def deal_large(groups: list[tuple[int, int]], total: int, shards: int) -> tuple[dict[int, int], list[int]]:
    """The shard of each large group (hash, bytes) that can stay whole, and the bytes so dealt to each shard."""
    loads, out = [0] * shards, {}
    for size, h in sorted(((s, h) for h, s in groups), reverse=True):
        k = loads.index(min(loads))
        if loads[k] + size <= (1 + LARGE) * total / shards:
            out[h] = k
            loads[k] += size
    return out, loads


def quantiles(loads: list[int], total: int) -> list[int]:
    """Where the bytes of all other records are cut, so that they fill the shards up to one level.

    Twice the byte counts, so that a middle is whole.
    """
    rest, low = total - sum(loads), sorted(loads)
    level = next(x for k in range(len(low), 0, -1) if (x := (rest + sum(low[:k])) / k) >= low[k - 1])
    out, at = [], 0.0
    for x in loads[:-1]:
        at += 2 * max(0.0, level - x)
        out.append(round(at))
    return out


def shard(docs: DataFrame, shards: int = 8) -> DataFrame:
    """A shard and a slot for every record of `docs` (doc_id, text)."""
    spark = docs.sparkSession
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = cut(
        pick(docs, doc_id="long", text="string").select(
            "doc_id",
            (F.octet_length(text) + 1).cast("long").alias("size"),
            F.crc32(text.cast("binary")).cast("long").alias("text_crc32"),
            F.xxhash64(text, F.col("text").isNull()).alias("h"),
            F.monotonically_increasing_id().alias("u"),  # stored with the row, so it stays
        )
    )
    n, total = rows.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    n_ranges = max(LEAST_RANGES, -(-n // ROWS_PER_RANGE))
    bounds, inner = splitters(rows, n_ranges, total)
    least = int(LARGE * total / shards)
    large = [tuple(x) for x in rows.groupBy("h").agg(F.sum("size").alias("s"), F.count("*").alias("k")).where((F.col("s") > least) & (F.col("k") > 1)).select("h", "s").collect()]
    whole, loads = deal_large(large, total, shards)
    kinds = spark.createDataFrame([(h, whole.get(h)) for h, _ in large], "h long, own int")

    own = W.partitionBy("r").orderBy("h", "doc_id", "u")
    weight = F.when(F.col("own").isNull(), F.col("size")).otherwise(0)
    placed = cut(
        placed_in_ranges(rows, bounds, inner)
        .join(F.broadcast(kinds.withColumn("single", F.col("own").isNull())), "h", "left")
        .withColumn("before", F.sum(weight).over(own.rowsBetween(W.unboundedPreceding, W.currentRow)) - weight)
        .withColumn("group_size", F.sum(weight).over(W.partitionBy("r", "h")))
        .withColumn("group_before", F.min("before").over(W.partitionBy("r", "h")))
    )
    starts, at = [], 0
    for r, s in sorted(tuple(x) for x in placed.groupBy("r").agg(F.sum(weight)).collect()):
        starts.append((r, at))
        at += s
    offsets = spark.createDataFrame(starts, "r long, bytes_before long")
    alone = F.col("split") | F.coalesce("single", F.lit(False))
    begin = F.col("bytes_before") + F.when(alone, F.col("before")).otherwise(F.col("group_before"))
    middle = begin * 2 + F.when(alone, F.col("size")).otherwise(F.col("group_size"))
    by_middle = sum([(middle >= F.lit(c)).cast("int") for c in quantiles(loads, total)], F.lit(0))
    dealt = cut(placed.join(F.broadcast(offsets), "r").select("doc_id", "size", "text_crc32", "h", "u", "r", F.coalesce("own", by_middle).alias("shard")))
    firsts, seen = [], [0] * shards
    for r, k, n_rows in sorted(tuple(x) for x in dealt.groupBy("r", "shard").count().collect()):
        firsts.append((r, k, seen[k]))
        seen[k] += n_rows
    slot = F.row_number().over(W.partitionBy("r", "shard").orderBy("h", "doc_id", "u")) - 1 + F.col("first")
    numbered = dealt.join(F.broadcast(spark.createDataFrame(firsts, "r long, shard int, first long")), ["r", "shard"])
    return numbered.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", slot.cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
