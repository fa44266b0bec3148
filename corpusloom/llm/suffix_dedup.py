"""Removal of repeated byte strings with suffix arrays built by induced sorting.

Every byte covered by a string of `length` bytes (400 unless the caller says otherwise) that also starts anywhere else
is removed; with `least_words`, runs of such bytes with fewer words stay. A suffix array over the whole corpus is not
needed to know this for all of it; it is built over shards that hold, together, every place where a repeat is possible:

1. Each text is cut into segments: runs of window starts whose least 64-byte hash is the same one. Equal windows
   have equal least hashes, so a window repeats only within the segments of one hash.
2. A segment's stretch of text (its windows together) that occurs twice or more repeats as a whole. Of each different
   stretch one representative stays; a hash with a single one needs no more unless its own text has the hash twice.
3. The representatives of the other hashes are put into shards by hash. In each shard suffixes are classified, the
   leftmost smaller ones sorted recursively, the array induced from them, and permuted common prefixes computed:
   a start repeats exactly if its common prefix with a neighbour in the array has `length` bytes. Every level of the
   recursion induces; a level of few letters places a bucket at a time, one of many letters or of long runs a suffix.
4. No array may hold more than `GROUP_BYTES` of one hash, so what one task holds is bounded whatever the texts. The
   windows of a hash with more go to the shuffle one by one under a 128-bit hash and are counted there, salted.

Texts are compressed and numbered once into the shared checkpoint folder; later joins are by that number, which is
never skewed. Joins on a stretch's hash can be skewed and are left to skew-splitting sort-merge joins.

Defined cases: a null text is an empty one; texts shorter than `length` lose nothing; repeated rows repeat each other, so
all of a text of `length` bytes or more that stands twice goes, in every copy; a cut inside a code point leaves bytes,
which kept_text drops; an empty table gives an empty result; a null doc_id is carried along; columns to keep are named
by the caller.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

from pyspark.sql import DataFrame, Window as W, functions as F

from ._shared import cut, pick, release, slices

LENGTH, SEED = 400, 64
#: Bytes that a shard should hold, and bytes of one hash's representatives that may share a shard.
SHARD_BYTES, GROUP_BYTES = 1_000_000, 2_000_000
#: A letter's bucket is placed at once if letters have this many suffixes on average and no run is longer than that.
BUCKET, RUN = 256, 256
BASE = 0x5851F42D4C957F2D  # an odd multiplier
STRETCH = 1 << 20  # window starts handled at a time
SALTS = 64  # parts that the rows of one window are dealt to


# -- suffix arrays -----------------------------------------------------------------------------------------------


def suffix_types(s):
    """Whether each suffix is smaller than the next one (S-type); the last one, the sentinel, is."""
    import numpy as np

    n = len(s)
    step = np.sign(np.diff(s.astype(np.int32))).astype(np.int8)
    at = np.where(step != 0, np.arange(n - 1, dtype=np.int32), np.int32(n))
    at = np.minimum.accumulate(at[::-1])[::-1]  # the next place where neighbours differ
    out = np.ones(n, bool)
    out[:-1] = step[np.minimum(at, n - 2)] > 0
    return out


def induce_buckets(s, small, seeds, counts):
    """All suffixes in order, given the leftmost S-type ones in `seeds` in the order they shall have.

    Buckets are passed upwards to place L-types and downwards to place S-types. What a bucket induces into itself
    (runs of its own letter) comes in waves.
    """
    import numpy as np

    k = len(counts)
    heads: list[list] = [[] for _ in range(k)]
    seeds = seeds.astype(np.int32)
    first = s[seeds]
    edges = np.searchsorted(first[(order := np.argsort(first, kind="stable"))], np.arange(k + 1))
    seeded = [seeds[order[edges[c] : edges[c + 1]]] for c in range(k)]

    def spread(spots, into, wanted) -> None:
        """Puts the suffixes before `spots` into the lists of their letters, if their type is the wanted one."""
        before = spots[spots > 0] - 1
        before = before[small[before] == wanted]
        if not len(before):
            return
        letters = s[before]
        by = np.argsort(letters, kind="stable")
        before, letters = before[by], letters[by]
        starts = np.flatnonzero(np.concatenate([[True], letters[1:] != letters[:-1]]))
        ends = np.append(starts[1:], len(letters))
        for a, b in zip(starts.tolist(), ends.tolist(), strict=True):
            into[int(letters[a])].append(before[a:b])

    def waves(own, into, wanted) -> None:
        """What the bucket holds, then what that puts into the bucket itself, and so on."""
        done = 0
        while done < len(own):
            wave, done = np.concatenate(own[done:]), len(own)
            spread(wave, into, wanted)

    for c in range(k):
        waves(heads[c], heads, False)
        if len(seeded[c]):
            spread(seeded[c], heads, False)
    large = [np.concatenate(h) if h else np.empty(0, np.int32) for h in heads]
    del heads
    tails: list[list] = [[] for _ in range(k)]
    for c in range(k - 1, -1, -1):
        waves(tails[c], tails, True)
        if len(large[c]):
            spread(large[c][::-1], tails, True)
    out = []
    for c in range(k):
        out.append(large[c])
        out += [x[::-1] for x in reversed(tails[c])]
    out[0] = np.array([len(s) - 1], np.int32)  # the sentinel
    return np.concatenate(out)


def longest_run(s) -> int:
    import numpy as np

    edges = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1], [True]]))
    return int(np.diff(edges).max())


def induce_suffixes(s, small, seeds, counts):
    """All suffixes in order like induce_buckets(), one suffix at a time.

    A suffix's place is free at the head (L-type) or tail (S-type) of its letter's bucket when the one behind it in the
    string is met, upwards for L-types, then downwards for S-types.
    """
    import numpy as np

    n, ends = len(s), np.cumsum(counts)
    larger, smaller = np.full(n + 1, -1, np.int64), np.full(n + 1, -1, np.int64)  # the letter before, by its type
    larger[1:n] = np.where(small[:-1], -1, s[:-1])
    smaller[1:n] = np.where(small[:-1], s[:-1], -1)
    order = np.full(n, -1, np.int64)  # -1, a place still free, finds the last entry, where nothing is before
    first = s[seeds]
    by = np.argsort(first, kind="stable")
    first = first[by]
    order[ends[first] - np.bincount(first, minlength=len(counts))[first] + np.arange(len(by)) - np.searchsorted(first, first)] = seeds[by]
    order, larger, smaller = order.tolist(), larger.tolist(), smaller.tolist()
    heads, tails = (ends - counts).tolist(), (ends - 1).tolist()
    for at in order:
        c = larger[at]
        if c >= 0:
            order[heads[c]] = at - 1
            heads[c] += 1
    for i in range(n - 1, -1, -1):
        c = smaller[order[i]]
        if c >= 0:
            order[tails[c]] = order[i] - 1
            tails[c] -= 1
    return np.array(order, np.int32)


def induce(s, small, seeds, counts):
    by_bucket = len(s) >= BUCKET * len(counts) and longest_run(s) <= RUN
    return (induce_buckets if by_bucket else induce_suffixes)(s, small, seeds, counts)


def suffix_array(s, k: int):
    """Suffix array of s, letters 0 to k - 1, where only the last letter is 0, by induced sorting at every level."""
    import numpy as np

    n = len(s)
    if n == 1:
        return np.zeros(1, np.int64)
    small = suffix_types(s)
    left = np.flatnonzero(small[1:] & ~small[:-1]) + 1  # leftmost S-types
    counts = np.bincount(s, minlength=k)
    rough = induce(s, small, left, counts)
    is_left = np.zeros(n, bool)
    is_left[left] = True
    order = rough[is_left[rough]]
    # names of the substrings from one leftmost S-type to the next, equal ones alike
    ends = np.empty(n, np.int64)
    ends[left] = np.append(left[1:], n - 1)
    size = ends[order] - order + 1
    same = np.zeros(len(order), bool)
    if len(order) > 1:
        pair = np.flatnonzero(size[1:] == size[:-1])
        if len(pair):
            length = size[pair]
            base = np.cumsum(length) - length
            inner = np.arange(int(length.sum())) - np.repeat(base, length)
            differs = s[np.repeat(order[pair], length) + inner] != s[np.repeat(order[pair + 1], length) + inner]
            same[pair + 1] = ~np.logical_or.reduceat(differs, base)
    names = np.empty(n, np.int64)
    names[order] = np.cumsum(~same) - 1
    reduced = names[left]
    if reduced.max() + 1 == len(left):
        sorted_left = order
    else:
        sorted_left = left[suffix_array(reduced, int(reduced.max()) + 1)]
    return induce(s, small, sorted_left, counts)


def permuted_common_prefixes(data: bytes, order):
    """For each start the suffix before it in the array, and the bytes they have in common.

    Only irreducible ones are compared, those whose preceding bytes differ; each next start has one byte less.
    """
    import numpy as np

    n = len(data)
    phi = np.full(n, -1, np.int32)
    phi[order[1:]] = order[:-1]
    b = np.frombuffer(data + bytes(16), np.uint8)
    words = np.lib.stride_tricks.sliding_window_view(b, 8)[: n + 8].copy().view(np.uint64).ravel()
    i = np.arange(n, dtype=np.int32)
    has = phi >= 0
    new = has & ((i == 0) | (phi == 0) | (b[i - 1] != b[phi - 1]))
    new |= ~has
    new[1:] |= phi[1:] != phi[:-1] + 1
    new[0] = True
    spots = np.flatnonzero(new)
    value = np.zeros(len(spots), np.int64)
    live = np.flatnonzero(phi[spots] >= 0)
    x, y = spots[live], phi[spots[live]]
    done = 0
    while len(live):
        differs = words[np.minimum(x + done, n + 7)] ^ words[np.minimum(y + done, n + 7)]
        over = (np.maximum(x, y) + done + 8) > n
        stop = (differs != 0) | over
        if stop.any():
            d = differs[stop]
            low = np.where(d != 0, np.bitwise_count((d & (~d + np.uint64(1))) - np.uint64(1)).astype(np.int64) >> 3, 8)
            most = n - np.maximum(x[stop], y[stop])
            value[live[stop]] = np.minimum(done + low, most)
            keep = ~stop
            live, x, y = live[keep], x[keep], y[keep]
        done += 8
    last = np.cumsum(new) - 1
    return phi, np.maximum(value[last] - (i - spots[last]), 0)


def repeated_starts(stretches: list[bytes], length: int = LENGTH):
    """For each stretch the starts whose `length` bytes also start elsewhere among the stretches, as an array."""
    import numpy as np

    data = b"\xff".join(stretches) + b"\xff"  # no UTF-8 text has this byte
    letters = np.frombuffer(data, np.uint8)
    present = np.unique(letters)
    dense = np.zeros(256, np.int16)  # sorted by radix
    dense[present] = np.arange(1, len(present) + 1)
    order = suffix_array(np.append(dense[letters], np.int16(0)), len(present) + 1)[1:]
    phi, common = permuted_common_prefixes(data, order)
    again = np.zeros(len(data), bool)
    hit = np.flatnonzero(common >= length)
    again[hit] = True
    again[phi[hit]] = True
    out, at = [], 0
    for s in stretches:
        own = max(0, len(s) - length + 1)
        out.append(np.flatnonzero(again[at : at + own]))
        at += len(s) + 1
    return out


# -- segments ----------------------------------------------------------------------------------------------------


@lru_cache(maxsize=4)
def powers(base: int, n: int):
    import numpy as np

    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out)


def seed_hashes(b, length: int):
    """A hash of the SEED bytes at each place of up to STRETCH + length bytes."""
    import numpy as np

    n = len(b)
    up, down = powers(BASE, STRETCH + length + 1), powers(pow(BASE, -1, 1 << 64), STRETCH + length + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum((b.astype(np.uint64) + np.uint64(1)) * up[:n], out=total[1:])
    h = (total[SEED:] - total[:-SEED]) * down[: n - SEED + 1]
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


def least_in_windows(h, width: int):
    """The least of each `width` neighbouring values, from running minima to both sides of blocks."""
    import numpy as np

    n = len(h) - width + 1
    x = np.full(-(-len(h) // width) * width, np.iinfo(np.uint64).max, np.uint64)
    x[: len(h)] = h
    x = x.reshape(-1, width)
    after = np.minimum.accumulate(x, axis=1).ravel()
    before = np.minimum.accumulate(x[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(before[:n], after[width - 1 : width - 1 + n])


def segments(data: bytes, length: int = LENGTH):
    """Each segment's least hash, first window start, number of starts, and whether its text has the hash twice.

    Only in the last case can a segment repeat itself. Starts are handled STRETCH at a time; a cut there only makes two
    segments of one, each of which still has all windows of its starts.
    """
    import numpy as np

    values, starts, sizes, twice = [], [], [], []
    b = np.frombuffer(data, np.uint8)
    n = len(b) - length + 1
    for at in range(0, max(n, 0), STRETCH):
        own = b[at : min(len(b), at + STRETCH + length - 1)]
        h = seed_hashes(own, length)
        m = least_in_windows(h, length - SEED + 1)
        heads = np.flatnonzero(np.concatenate([[True], m[1:] != m[:-1]]))
        values.append(m[heads])
        known = np.zeros(1 << 16, bool)
        known[m[heads] & np.uint64(0xFFFF)] = True
        found, times = np.unique(h[known[h & np.uint64(0xFFFF)]], return_counts=True)
        twice.append(times[np.searchsorted(found, m[heads])] > 1)
        starts.append(heads + at)
        sizes.append(np.diff(np.append(heads, len(m))))
    if not values:
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool)
    return np.concatenate(values), np.concatenate(starts), np.concatenate(sizes), np.concatenate(twice)


def numbered(docs: DataFrame, keep: tuple[str, ...]) -> DataFrame:
    """r, a number for each row, its compressed text, and the columns to keep; stored."""
    types = dict(docs.dtypes)
    own = pick(docs, text="string", **{c: types[c] for c in keep if c != "text"})
    names = ["r", "z", *own.columns[1:]]

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import zstandard
        from pyspark import TaskContext

        pack, n = zstandard.ZstdCompressor(level=3), TaskContext.get().partitionId() << 33
        for part in slices(batches):
            z = [pack.compress((t or "").encode()) for t in part.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(range(n, n + len(z)), pa.int64()), pa.array(z, pa.binary()), *part.columns[1:]], names)
            n += len(z)

    schema = ", ".join(f"`{c}` {t}" for c, t in own.dtypes[1:])
    return cut(own.mapInArrow(run, f"r long, z binary, {schema}" if schema else "r long, z binary"))


def segment_rows(texts: DataFrame, length: int) -> DataFrame:
    """h, c, r, start, size, own: each segment's least hash, the hash of its stretch, where it is, if it may repeat itself."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        import xxhash
        import zstandard

        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part, out = batch.slice(at, 1024), []
                for r, z in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    data = unpack.decompress(z)
                    h, starts, sizes, own = segments(data, length)
                    if len(h):
                        view = memoryview(data)
                        c = [xxhash.xxh3_64_intdigest(view[a : a + n + length - 1]) for a, n in zip(starts.tolist(), sizes.tolist(), strict=True)]
                        out.append((h.view(np.int64), np.array(c, np.uint64).view(np.int64), np.full(len(h), r), starts, sizes, own))
                if out:
                    cols = [np.concatenate(x) for x in zip(*out, strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_()), strict=True)], ["h", "c", "r", "start", "size", "own"])

    return texts.select("r", "z").mapInArrow(run, "h long, c long, r long, start int, size int, own boolean")


def runs_of(starts) -> list[tuple[int, int]]:
    """Neighbouring starts as (first, last)."""
    import numpy as np

    if not len(starts):
        return []
    edge = np.flatnonzero(np.diff(starts) > 1)
    return list(zip(starts[np.append(0, edge + 1)].tolist(), starts[np.append(edge, len(starts) - 1)].tolist(), strict=True))


def shard_spans(length: int):
    """Spans repeated in one shard, for its representatives that occur once (the others are known to repeat)."""

    def run(key, table):
        import pyarrow as pa

        table = table.sort_by([("h", "ascending"), ("c", "ascending"), ("r", "ascending")])
        found = repeated_starts(table.column("stretch").to_pylist(), length)
        release()
        out = []
        for own, r, start, n in zip(found, *(table.column(c).to_pylist() for c in ("r", "start", "n")), strict=True):
            if n == 1:
                out += [(r, start + a, start + b + length) for a, b in runs_of(own)]
        cols = list(zip(*out, strict=True)) or [[], [], []]
        return pa.table({"r": pa.array(cols[0], pa.int64()), "start": pa.array(cols[1], pa.int64()), "stop": pa.array(cols[2], pa.int64())})

    return run


def stretches(texts: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """The rows of `wanted` (h, c, n, volume, r, start, size), each with its stretch of text."""
    lists = wanted.groupBy("r").agg(F.collect_list(F.struct("h", "c", "n", "volume", "start", "size")).alias("own"))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import zstandard

        unpack = zstandard.ZstdDecompressor()
        names = ["h", "c", "n", "volume", "r", "start", "size", "stretch"]
        kinds = [pa.int64()] * 5 + [pa.int32()] * 2 + [pa.binary()]
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                out = []
                for row in batch.slice(at, 64).to_pylist():
                    data = unpack.decompress(row["z"])
                    out += [(x["h"], x["c"], x["n"], x["volume"], row["r"], x["start"], x["size"], data[x["start"] : x["start"] + x["size"] + length - 1]) for x in row["own"]]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names)

    return texts.select("r", "z").join(lists, "r").select("r", "z", "own").mapInArrow(run, "h long, c long, n long, volume long, r long, start int, size int, stretch binary")


def window_spans(hot: DataFrame, length: int) -> DataFrame:
    """Spans repeated among the representatives of hashes with too many bytes for an array, by counting their windows."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        import xxhash

        names = ["w1", "w2", "r", "start", "n"]
        for batch in slices(batches, 16):
            for row in batch.to_pylist():
                view = memoryview(row["stretch"])
                for at in range(0, row["size"], 1 << 16):
                    k = min(1 << 16, row["size"] - at)
                    w = np.frombuffer(b"".join(xxhash.xxh3_128_digest(view[i : i + length]) for i in range(at, at + k)), np.int64).reshape(-1, 2)
                    yield pa.RecordBatch.from_arrays([pa.array(w[:, 0]), pa.array(w[:, 1]), pa.array(np.full(k, row["r"])), pa.array(np.arange(at, at + k) + row["start"]), pa.array(np.full(k, row["n"]))], names)

    windows = hot.select("r", "start", "size", "n", "stretch").mapInArrow(run, "w1 long, w2 long, r long, start long, n long")
    windows = cut(windows.withColumn("salt", F.pmod(F.xxhash64("r"), F.lit(SALTS)).cast("int")))  # one window may be in a third of all rows
    parts = windows.groupBy("w1", "w2", "salt").agg(F.count("*").alias("k"))
    twice = parts.withColumn("k", F.sum("k").over(W.partitionBy("w1", "w2"))).where("k > 1").select("w1", "w2", "salt")
    return windows.where("n = 1").join(twice, ["w1", "w2", "salt"]).select("r", "start", (F.col("start") + length).alias("stop"))


def repeated_spans(texts: DataFrame, length: int) -> DataFrame:
    """r, start, stop of repeated bytes; spans may overlap."""
    rows = cut(segment_rows(texts, length))
    often = cut(rows.groupBy("h").agg(F.count("*").alias("k"), F.max("own").alias("any")).where("k > 1 or any").select("h"))
    rows = cut(rows.join(often, "h"))  # from here on only hashes with a repeat to look for
    kinds = cut(rows.groupBy("h", "c").agg(F.count("*").alias("n"), F.min(F.struct("r", "start", "size")).alias("at"), F.max("own").alias("own")).select("h", "c", "n", "at.*", "own"))
    whole = rows.join(kinds.where("n > 1").select("h", "c"), ["h", "c"]).select("r", F.col("start").cast("long"), (F.col("start").cast("long") + F.col("size") + length - 1).alias("stop"))
    many = kinds.groupBy("h").agg(F.count("*").alias("m"), F.sum(F.col("size") + F.lit(length)).alias("volume"), F.max(F.col("own") & (F.col("n") == 1)).alias("any"))
    many = many.where("m > 1 or any").select("h", "volume")
    wanted = cut(stretches(texts, kinds.drop("own").join(many, "h"), length))
    total = wanted.agg(F.coalesce(F.sum(F.col("size") + F.lit(length)), F.lit(0))).first()[0]
    shards = max(1, -(-total // SHARD_BYTES))
    in_arrays, hot = wanted.where(F.col("volume") <= GROUP_BYTES), wanted.where(F.col("volume") > GROUP_BYTES)
    sharded = in_arrays.withColumn("shard", F.pmod(F.xxhash64("h"), F.lit(shards)))
    spans = whole.union(sharded.groupBy("shard").applyInArrow(shard_spans(length), "r long, start long, stop long"))
    return spans if hot.isEmpty() else spans.union(window_spans(hot, length))


def merged_spans(found, data: bytes, least_words: int = 0) -> list[list[int]]:
    """Overlapping and touching spans as one; those with fewer than `least_words` words, in part or whole, are left out."""
    out: list[list[int]] = []
    for a, b in sorted((x["start"], x["stop"]) for x in found or ()):
        if out and a <= out[-1][1]:
            out[-1][1] = max(b, out[-1][1])
        else:
            out.append([a, b])
    return [x for x in out if len(data[x[0] : x[1]].split()) >= least_words] if least_words else out


def remove_repeats(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), length: int = LENGTH, least_words: int = 0) -> DataFrame:
    """The columns to keep, and n_bytes, n_removed, n_spans, kept_sha256 and kept_text for every row of `docs`.

    `length` is at least SEED.
    """
    if length < SEED:
        raise ValueError(f"length is {length}; it has to be {SEED} or more")
    texts = numbered(docs, keep)
    spans = repeated_spans(texts, length).groupBy("r").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))
    joined = texts.join(spans, "r", "left").select(*keep, "z", "spans")

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import zstandard

        unpack = zstandard.ZstdDecompressor()
        k = len(keep)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part, out = batch.slice(at, 512), []
                for z, found in zip(part.column(k).to_pylist(), part.column(k + 1).to_pylist(), strict=True):
                    data = unpack.decompress(z)
                    merged = merged_spans(found, data, least_words)
                    kept, last = [], 0
                    for a, b in merged:
                        kept.append(data[last:a])
                        last = b
                    left = b"".join([*kept, data[last:]])
                    out.append((len(data), len(data) - len(left), len(merged), hashlib.sha256(left).hexdigest(), left.decode("utf-8", "ignore")))
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
                yield pa.RecordBatch.from_arrays([*part.columns[:k], *(pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True))], [*keep, "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text"])

    types = dict(joined.dtypes)
    schema = ", ".join(f"`{c}` {types[c]}" for c in keep)
    return joined.mapInArrow(run, f"{schema}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept_text string")
