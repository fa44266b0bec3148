"""Benchmark decontamination over a positional inverted index of the training tokens.

`build_index` turns documents into segments, each a row with its own sorted terms and, term by term, the positions
in the segment where the term stands (delta-coded). Positions leave a gap after each document, so no phrase runs from
one into the next. Segments are bounded by their number of tokens, are written where the caller says (cut() puts them
into the shared checkpoint folder) and are never regrouped.

`search` sends test phrases, a bounded number at a time, to every segment as numbers of terms. A segment looks up the
phrases' key terms (of each phrase the term that the fewest phrases have) and goes on with the phrases whose key it has;
of these it takes the rarest term's posting list, shifted to the phrase's start, and intersects it with the next rarer
ones, shifted by their own offsets, until it is empty or all terms agree. All phrases go through these steps together,
as arrays. `proximity` finds places where all terms of a set stand within a distance in one document, by the same lists.

Defined cases: a null or empty text has no words and no hits; an item without words never occurs; an item without an id
counts for words hit and contamination, but not among the items; items of equal id are one; repeated rows are
documents of their own; an empty table gives an empty result, and without items nothing is hit; a null doc_id is
carried along; a very long text is a segment of its own; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame, functions as F

from ._shared import cut, pick, slices

WINDOW = 10
#: Tokens after which a segment is closed.
SEGMENT_TOKENS = 500_000
#: Windows of test items that are sent to the tasks at a time; more take more passes over the index.
WINDOWS_PER_PASS = 500_000
#: Places of rarest terms that are intersected at a time.
PLACES = 1 << 21
#: A-Z to a-z; every other ASCII byte but digits and letters to a space.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))

SEGMENTS = "segment long, doc_ids array<long>, doc_lengths array<int>, terms binary, postings array<int>, positions binary"


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(FOLD).split()


def build_index(docs: DataFrame, gap: int = WINDOW) -> DataFrame:
    """One row per segment: documents and lengths, terms (space-joined), how many postings each has, the postings."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        task, made = TaskContext.get().partitionId(), 0

        def close(ids: list, lengths: list, own: list[list[bytes]]):
            nonlocal made
            known: dict[bytes, int] = {}
            codes = np.fromiter((known.setdefault(w, len(known)) for ws in own for w in ws), np.int64, sum(lengths))
            starts = np.cumsum([0, *(n + gap for n in lengths)])[:-1]
            spots = np.arange(len(codes)) + np.repeat(starts - np.cumsum([0, *lengths])[:-1], lengths)
            terms = sorted(known)
            place = np.empty(len(terms), np.int64)
            place[[known[t] for t in terms]] = np.arange(len(terms))
            codes = place[codes]
            order = np.argsort(codes, kind="stable")
            counts = np.bincount(codes, minlength=len(terms))
            spots = spots[order]
            deltas = np.diff(spots, prepend=0)
            heads = np.cumsum(counts)[:-1] if len(counts) else counts
            deltas[heads] = spots[heads]  # each list begins anew
            made += 1
            row = ((task << 33) + made, ids, lengths, zlib.compress(b" ".join(terms), 1), counts.astype("int32"), zlib.compress(deltas.astype("<u4").view("u1").reshape(-1, 4).T.tobytes(), 1))
            return pa.RecordBatch.from_arrays(
                [pa.array([v], t) for v, t in zip(row, (pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary(), pa.list_(pa.int32()), pa.binary()), strict=True)], [c.split()[0] for c in SEGMENTS.split(", ")]
            )

        ids, lengths, own, n = [], [], [], 0
        for part in slices(batches, 256):
            for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                ws = words_of(text)
                ids.append(doc_id)
                lengths.append(len(ws))
                own.append(ws)
                n += len(ws) + 1
                if n >= SEGMENT_TOKENS:
                    yield close(ids, lengths, own)
                    ids, lengths, own, n = [], [], [], 0
        if ids:
            yield close(ids, lengths, own)

    return pick(docs, doc_id="long", text="string").mapInArrow(run, SEGMENTS)


class Segment:
    """A segment's terms and posting lists, opened for searching."""

    def __init__(self, lengths: list[int], terms: bytes, postings: list[int], positions: bytes, gap: int):
        import numpy as np

        self.lengths = np.asarray(lengths, np.int64)
        self.starts = np.cumsum(np.concatenate([[0], self.lengths + gap]))[:-1]
        self.counts = np.asarray(postings, np.int64)
        self.ends = np.cumsum(self.counts)
        raw = np.frombuffer(zlib.decompress(positions), "u1").reshape(4, -1).T.copy().view("<u4").ravel().astype(np.int64)
        total = np.cumsum(raw)
        before = np.concatenate([[0], total[self.ends[:-1] - 1]]) if len(self.counts) else self.counts
        self.spots = total - np.repeat(before, self.counts)
        self.terms = zlib.decompress(terms).split(b" ") if len(self.counts) else []
        self.place = {t: i for i, t in enumerate(self.terms)}

    def list(self, term: bytes):
        i = self.place.get(term)
        if i is None:
            return None
        return self.spots[self.ends[i] - self.counts[i] : self.ends[i]]

    def term_at(self):
        """The term at each place, -1 in gaps: which list a place is in."""
        import numpy as np

        out = np.full(int((self.starts[-1] + self.lengths[-1]) if len(self.starts) else 0) + 1, -1, np.int32)
        out[self.spots] = np.repeat(np.arange(len(self.counts), dtype=np.int32), self.counts)
        return out

    def phrases(self, phrases: Phrases):
        """(numbers of phrases, places where they begin): offset-adjusted lists intersected from the rarest term's up."""
        import numpy as np

        own = phrases.present(self.place)
        terms = phrases.terms[own]
        here = np.where(terms >= 0, phrases.local(self.place)[terms], -2)  # -2: the phrase has ended
        whole = np.flatnonzero((here != -1).all(1))
        own, here = own[whole], here[whole]
        if not len(own):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        counts = np.where(here >= 0, self.counts[np.maximum(here, 0)], np.iinfo(np.int64).max)
        order = np.argsort(counts, axis=1, kind="stable")  # offsets by how rare their terms are
        most, at, term_at = counts.min(1), 0, self.term_at()
        cuts = np.flatnonzero(np.diff(np.cumsum(most) // PLACES)) + 1
        found = []
        for some in np.split(np.arange(len(own)), cuts):
            first = here[some, order[some, 0]]
            n = self.counts[first]
            which = np.repeat(some, n)
            inner = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            starts = self.spots[np.repeat(self.ends[first] - n, n) + inner] - np.repeat(order[some, 0], n)
            which, starts = which[starts >= 0], starts[starts >= 0]
            for k in range(1, here.shape[1]):
                offset = order[which, k]
                want = here[which, offset]
                at = starts + offset
                good = (want == -2) | ((at < len(term_at)) & (term_at[np.minimum(at, len(term_at) - 1)] == want))
                which, starts = which[good], starts[good]
                if not len(which):
                    break
            found.append((own[which], starts))
        return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])

    def near(self, terms: set[bytes], distance: int):
        """Places of the first term (in order) that have all other terms within `distance` words in their document."""
        import numpy as np

        if not terms or any(t not in self.place for t in terms):
            return np.empty(0, np.int64)
        anchor, *others = sorted(terms)
        spots = self.list(anchor)
        for own in sorted(map(self.list, others), key=len):  # from the rarest up
            doc = np.searchsorted(self.starts, spots, "right") - 1
            low = np.maximum(spots - distance, self.starts[doc])
            high = np.minimum(spots + distance, self.starts[doc] + self.lengths[doc] - 1)
            at = np.searchsorted(own, low)
            spots = spots[(at < len(own)) & (own[np.minimum(at, len(own) - 1)] <= high)]
        return spots


class Phrases:
    """Phrases as rows of numbers of terms (-1 after the end), found by their key terms."""

    def __init__(self, phrases: list[tuple[bytes, ...]]):
        import numpy as np

        known: dict[bytes, int] = {}
        width = max(map(len, phrases), default=1)
        self.terms = np.full((len(phrases), width), -1, np.int32)
        for i, p in enumerate(phrases):
            self.terms[i, : len(p)] = [known.setdefault(w, len(known)) for w in p]
        self.vocabulary = list(known)
        often = np.bincount(self.terms[self.terms >= 0], minlength=len(known) + 1)
        often[-1] = np.iinfo(often.dtype).max
        self.key = np.take_along_axis(self.terms, often[self.terms].argmin(1)[:, None], 1).ravel()
        self.by_key = np.argsort(self.key, kind="stable")
        self.edges = np.searchsorted(self.key[self.by_key], np.arange(len(known) + 1))

    def local(self, place: dict[bytes, int]):
        """The number that each of the phrases' terms has in a segment, or -1."""
        import numpy as np

        return np.fromiter((place.get(t, -1) for t in self.vocabulary), np.int64, len(self.vocabulary))

    def present(self, place: dict[bytes, int]):
        """The phrases whose key term a segment has."""
        import numpy as np

        has = np.flatnonzero(self.local(place) >= 0)
        chosen = np.zeros(len(self.key) + 1, np.int32)
        np.add.at(chosen, self.edges[has], 1)
        np.add.at(chosen, self.edges[has + 1], -1)
        return self.by_key[np.cumsum(chosen)[:-1] > 0]


def window_passes(items: Iterable[tuple], width: int = WINDOW, most: int = WINDOWS_PER_PASS) -> Iterator[dict[bytes, list[str]]]:
    """The items' windows (words joined by spaces) with the ids of the items that have them, `most` at a time.

    Windows of an item without an id have no id.
    """
    out: dict[bytes, list[str]] = {}
    for name, text in items:
        ws = words_of(text)
        for i in range(max(1, len(ws) - width + 1) if ws else 0):
            own = out.setdefault(b" ".join(ws[i : i + width]), [])
            if name is not None and name not in own[-1:]:
                own.append(name)
            if len(out) >= most:
                yield out
                out = {}
    yield out


MATCHES = "segment long, at int, doc_id long, n_words long, n_hit long, item_ids array<string>, spans array<struct<start:int,stop:int>>"
COLUMNS = [c.split()[0] for c in MATCHES.split(", ")]


def matches_batch(out: list[tuple]):
    import pyarrow as pa

    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], COLUMNS)


def search(index: DataFrame, windows: dict[bytes, list[str]], width: int = WINDOW) -> DataFrame:
    """Every document of the index with the words inside occurrences of the windows, and the items they are of.

    Spans are maximal runs of hit words, in words from the document's start.
    """
    shared = index.sparkSession.sparkContext.broadcast((Phrases([tuple(w.split(b" ")) for w in windows]), list(windows.values())))

    def run(batches: Iterator) -> Iterator:
        import numpy as np

        phrases, names = shared.value
        sizes = (phrases.terms >= 0).sum(1)
        for row in segments_of(batches):
            own = Segment(row["doc_lengths"], row["terms"], row["postings"], row["positions"], width)
            marks = np.zeros(int((own.lengths + width).sum()) + 1, np.int32)
            which, starts = own.phrases(phrases)
            np.add.at(marks, starts, 1)
            np.add.at(marks, starts + sizes[which], -1)
            hit = np.cumsum(marks) > 0
            found: dict[int, set[str]] = {}
            docs = np.searchsorted(own.starts, starts, "right") - 1
            for doc, phrase in np.unique(np.stack([docs, which], 1), axis=0).tolist() if len(docs) else ():
                found.setdefault(doc, set()).update(names[phrase])
            out = []
            for doc, (doc_id, n) in enumerate(zip(row["doc_ids"], row["doc_lengths"], strict=True)):
                if doc in found:
                    mine = hit[own.starts[doc] : own.starts[doc] + n]
                    edges = np.flatnonzero(np.diff(mine.astype(np.int8), prepend=0, append=0)).reshape(-1, 2)
                    out.append((row["segment"], doc, doc_id, n, int(mine.sum()), sorted(found[doc]), [{"start": int(a), "stop": int(b)} for a, b in edges]))
                else:
                    out.append((row["segment"], doc, doc_id, n, 0, [], []))
            yield matches_batch(out)

    return index.mapInArrow(run, MATCHES)


def segments_of(batches: Iterator) -> Iterator[dict]:
    """The index's rows one at a time."""
    for batch in batches:
        for at in range(batch.num_rows):
            yield from batch.slice(at, 1).to_pylist()


def proximity(index: DataFrame, sets: dict[str, set[str]], distance: int, gap: int = WINDOW) -> DataFrame:
    """item_id, doc_id, at: words, counted from the document's start, that are a set's first term (in the order of its
    bytes) and have every other term of the set within `distance` words on either side in the same document.

    Terms are folded like texts; a set without terms is found nowhere, one of a single term wherever that stands.
    """
    own = {k: {w for t in terms for w in words_of(t)} for k, terms in sets.items()}
    shared = index.sparkSession.sparkContext.broadcast(own)

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for row in segments_of(batches):
            segment = Segment(row["doc_lengths"], row["terms"], row["postings"], row["positions"], gap)
            ids = pa.array(row["doc_ids"], pa.int64())
            for name, terms in shared.value.items():
                spots = segment.near(terms, distance)
                if len(spots):
                    doc = np.searchsorted(segment.starts, spots, "right") - 1
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(spots)), ids.take(pa.array(doc)), pa.array(spots - segment.starts[doc])], ["item_id", "doc_id", "at"])

    return index.mapInArrow(run, "item_id string, doc_id long, at long")


def merged(passes: list[DataFrame]) -> DataFrame:
    """One row per document from the rows that several passes over the same index have for it."""

    def run(batches: Iterator) -> Iterator:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                spans: list[dict] = []
                for x in sorted((x for own in row["spans"] for x in own), key=lambda x: (x["start"], x["stop"])):
                    if spans and x["start"] <= spans[-1]["stop"]:
                        spans[-1]["stop"] = max(x["stop"], spans[-1]["stop"])
                    else:
                        spans.append(dict(x))
                out.append((row["segment"], row["at"], row["doc_id"], row["n_words"], sum(x["stop"] - x["start"] for x in spans), sorted({i for own in row["item_ids"] for i in own}), spans))
            if out:
                yield matches_batch(out)

    every = passes[0]
    for p in passes[1:]:
        every = every.union(p)
    return every.groupBy("segment", "at", "doc_id", "n_words").agg(F.collect_list("item_ids").alias("item_ids"), F.collect_list("spans").alias("spans")).mapInArrow(run, MATCHES)


def decontaminate(docs: DataFrame, benchmark: DataFrame, width: int = WINDOW, windows_per_pass: int = WINDOWS_PER_PASS) -> DataFrame:
    """Builds and stores the index of `docs` (doc_id, text), then searches it for `benchmark` (item_id, text).

    The items stream through the driver; what is sent to the tasks at a time is bounded by `windows_per_pass`.
    """
    own = pick(benchmark, item_id="string", text="string")
    index = cut(build_index(docs, width))
    passes = [search(index, w, width) for w in window_passes(((r.item_id, r.text) for r in own.toLocalIterator()), width, windows_per_pass)]
    return passes[0] if len(passes) == 1 else merged(passes)


def digest(matches: DataFrame) -> DataFrame:
    return matches.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))
