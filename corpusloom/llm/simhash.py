"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints at most `RADIUS` = 3 bits apart have a fingerprint between them: at most one step from one, two from
the other. Every distinct fingerprint emits the variants within half the radius that such a meeting needs. As one
step changes the parity of the number of set bits, it is enough to meet at odd parity: a fingerprint of even parity
emits its 64 variants one bit away, one of odd parity itself and its 2016 variants two bits away. Distances 1 and 3
join unlike parities and distance 2 like ones, so each linked pair meets, whatever the data.

The variants are dealt by parities: the 64 bits are dealt round to b groups, and bit j of a part's number is the parity
of group j. A variant one bit away differs from its fingerprint in one bit of the part, one two bits away in none or two.
So a fingerprint of even parity is sent to b parts, one of odd parity to 1 + b (b - 1) / 2, each once, and the part makes
those variants itself; that is the shuffle on variants with each map side's variants of one fingerprint combined. With b
growing as the logarithm of the corpus, that is 15 rows a fingerprint at b = 7 and 163 at b = 25. In a part, variants are sorted, and each set of colliding fingerprints is linked to its
member closest to the variant, every link verified by its distance: a member one step away or none is linked by at most
3 steps with all others. Members that are all two steps away meet again, where they are linked, in the ball of one of
them, so nothing is lost and no set emits all its pairs. Each part keeps a spanning forest of its links.

Links between distinct fingerprints become components by alternating large-star and small-star steps, with each
round's links in the shared checkpoint folder.

Defined cases: a null or empty text, or one without words, has fingerprint zero and is linked like any other; fewer
than three words are one shingle; equal texts and repeated rows share a fingerprint, so a component; null doc_ids are
carried along and never name a component unless it has no other; an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, functions as F

from ._shared import cut, pick, slices

RADIUS, BITS, SHINGLE = 3, 64, 3
#: Variants that a part should hold, and the least number of groups of bits. All variants have odd parity, as have their
#: parts, so half of the numbers are in use.
VARIANTS_PER_PART, LEAST_PART_BITS = 1 << 22, 7
#: A-Z to a-z (ASCII only).
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def fingerprint(text: str | None) -> int:
    import numpy as np
    import xxhash

    words = (text or "").encode().translate(LOWER).split()
    if not words:
        return 0
    join, digest = b" ".join, xxhash.xxh64_intdigest
    if len(words) < SHINGLE:
        hashes = [digest(join(words), 42)]
    else:
        hashes = [digest(a + b" " + b + b" " + c, 42) for a, b, c in zip(words, words[1:], words[2:], strict=False)]
    data = np.array(hashes, np.uint64)
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(data), 1 << 16):  # bounded however long the text
        ones += np.unpackbits(data[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(data), bitorder="little").view(np.uint64)[0])


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprints(docs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the columns in `keep`, and f, the fingerprint as a signed long."""
    types = dict(docs.dtypes)
    own = pick(docs, doc_id="long", text="string", **{c: types[c] for c in keep})
    names = ["doc_id", *keep, "f"]

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in slices(batches):
            prints = [signed(fingerprint(t)) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *batch.columns[2:], pa.array(prints, pa.int64())], names)

    return own.mapInArrow(run, ", ".join(["doc_id long", *(f"`{c}` {types[c]}" for c in keep), "f long"]))


def part_masks(bits: int):
    """The part of each single bit: group i mod `bits` of its position i."""
    import numpy as np

    return np.uint64(1) << (np.arange(BITS, dtype=np.uint64) % np.uint64(bits))


def rows_per_print(bits: int) -> tuple[int, int]:
    """To how many parts a fingerprint of even and one of odd parity goes."""
    import numpy as np

    columns = part_masks(bits)
    even, odd = (len(np.unique(part_of(m, columns))) for m in variant_masks())
    return even, odd


def part_bits(n: int) -> int:
    """Groups of bits for n distinct fingerprints of 1040 variants on average."""
    return min(BITS, max(LEAST_PART_BITS, (n * 1040 // VARIANTS_PER_PART).bit_length() + 1))


def part_of(values, columns):
    """XOR of the columns of the bits set in each value."""
    import numpy as np

    out = np.zeros(len(values), np.uint64)
    for i in range(BITS):
        out ^= columns[i] * ((values >> np.uint64(i)) & np.uint64(1))
    return out


def parity(values):
    import numpy as np

    return np.bitwise_count(values) & 1


def variant_masks():
    """For even and for odd fingerprints: the bits to change for each variant they emit."""
    import numpy as np

    one = np.uint64(1) << np.arange(BITS, dtype=np.uint64)
    i, j = np.triu_indices(BITS, 1)
    return one, np.concatenate([np.zeros(1, np.uint64), one[i] | one[j]])


def meetings(prints: DataFrame, n: int) -> DataFrame:
    """Verified links a, b (a < b as signed longs) between the distinct fingerprints in column f."""
    bits = part_bits(n)

    def emit(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        columns, masks = part_masks(bits), variant_masks()
        reached = [np.unique(part_of(m, columns)) for m in masks]
        for batch in batches:
            f = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for which in (0, 1):
                for at in range(0, len(own := f[parity(f) == which]), 1024):
                    some = own[at : at + 1024]
                    parts = (part_of(some, columns)[:, None] ^ reached[which][None, :]).ravel()
                    yield pa.RecordBatch.from_arrays([pa.array(parts.view(np.int64)), pa.array(np.repeat(some, len(reached[which])).view(np.int64))], ["part", "f"])

    def meet(key, table):
        import numpy as np
        import pyarrow as pa

        columns, masks = part_masks(bits), variant_masks()
        part = np.uint64(key[0].as_py())
        f = np.unique(table.column("f").to_numpy().view(np.uint64))
        variants, owners, steps = [], [], []
        for which in (0, 1):
            own = np.flatnonzero(parity(f) == which)
            targets, of = part_of(f[own], columns) ^ part, part_of(masks[which], columns)
            order = np.argsort(of, kind="stable")
            for t in np.unique(targets):
                mine = own[targets == t]
                lo, hi = np.searchsorted(of[order], t, "left"), np.searchsorted(of[order], t, "right")
                chosen = masks[which][order[lo:hi]]
                variants.append((f[mine][:, None] ^ chosen[None, :]).ravel())
                owners.append(np.repeat(mine, len(chosen)).astype(np.int32))
                steps.append(np.tile(np.bitwise_count(chosen), len(mine)).astype(np.int8))
        empty = pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
        if not variants:
            return empty
        v, o, s = np.concatenate(variants), np.concatenate(owners), np.concatenate(steps)
        order = np.argsort(v, kind="stable")
        v = v[order]
        same = v[1:] == v[:-1]
        twice = np.concatenate([same, [False]]) | np.concatenate([[False], same])
        v, order = v[twice], order[twice]
        o, s = o[order], s[order]
        if not len(v):
            return empty
        by = np.lexsort((o, s, v))  # in each set, the member closest to the variant first
        v, o, s = v[by], o[by], s[by]
        head = np.concatenate([[True], v[1:] != v[:-1]])
        hub = o[np.flatnonzero(head)[np.cumsum(head) - 1]]
        near = (np.bitwise_count(f[hub] ^ f[o]) <= RADIUS) & (hub != o)
        pairs = np.unique(np.stack([np.minimum(hub, o)[near], np.maximum(hub, o)[near]], 1), axis=0)
        links = forest(pairs.tolist())
        a, b = f[[x for x, _ in links]].view(np.int64), f[[y for _, y in links]].view(np.int64)
        return pa.table({"a": pa.array(np.minimum(a, b)), "b": pa.array(np.maximum(a, b))})

    return prints.select("f").mapInArrow(emit, "part long, f long").groupBy("part").applyInArrow(meet, "a long, b long")


def forest(pairs: list) -> list[tuple[int, int]]:
    """The links that join something new: a spanning forest."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := root.get(x, x)) != x:
            root[x] = root.get(up, up)
            x = up
        return x

    out = []
    for a, b in pairs:
        x, y = find(a), find(b)
        if x != y:
            root[max(x, y)] = min(x, y)
            out.append((a, b))
    return out


def components(links: DataFrame) -> DataFrame:
    """node, root: the smallest node that each node of the links a, b can reach.

    Large-star links every larger neighbour to a node's smallest neighbour, small-star every smaller one; repeated
    until no link changes, each link is (node, root). Neighbours are only reduced to their minimum, never gathered.
    """
    links = cut(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    if links.isEmpty():
        return links.selectExpr("b as node", "a as root")
    before = None
    while True:
        both = links.select(F.col("a").alias("u"), F.col("b").alias("v")).union(links.select("b", "a"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        down = large.distinct()  # u > v
        small = down.groupBy("u").agg(F.min("v").alias("m"))
        star = F.array(F.struct(F.col("m").alias("a"), F.col("u").alias("b")), F.struct(F.col("m").alias("a"), F.col("v").alias("b")))
        links = down.join(small, "u").select(F.explode(star).alias("x")).select("x.a", "x.b").where("a <> b").distinct()
        links = cut(links)
        n, s, t = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.sum(F.col("a").cast("decimal(38,0)"))).first()
        if (n, s, t) == before:
            return links.selectExpr("b as node", "a as root")
        before = (n, s, t)


def near_duplicates(docs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id for every document of `docs` (doc_id, text).

    With `keep`, columns that tell rows of one doc_id apart, these too and `first`, the least (doc_id is null, doc_id,
    *keep) of the component.
    """
    rows = cut(fingerprints(docs, keep))
    least = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", *keep)).alias("least")
    groups = cut(rows.groupBy("f").agg(least))
    roots = components(meetings(groups, groups.count()))
    named = groups.join(roots, F.col("f") == F.col("node"), "left").select("f", "least", F.coalesce("root", "f").alias("root"))
    merged = cut(named.where("root <> f").select("f", "root", "least").union(groups.join(roots.select(F.col("root").alias("f")).distinct(), "f").select("f", F.col("f").alias("root"), "least")))
    firsts = merged.groupBy("root").agg(F.min("least").alias("first"))
    linked = merged.join(firsts, "root").select("f", "first")
    labels = groups.join(linked, "f", "left").select("f", F.coalesce("first", "least").alias("first"))
    out = rows.join(labels, "f").select("doc_id", *keep, F.lower(F.lpad(F.hex("f"), 16, "0")).alias("fingerprint"), F.col("first.doc_id").alias("component_id"), "first")
    return out if keep else out.drop("first")


def duplicates(docs: DataFrame) -> DataFrame:
    """The doc_ids that are not the smallest of their component."""
    return near_duplicates(docs).where("component_id is not null and doc_id <> component_id").select("doc_id").distinct()
