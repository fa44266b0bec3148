"""Quality rules: counted base rules, then the log-likelihood ratio of hashed n-grams.

Words and pairs of neighbouring words are hashed into `buckets`. One pass counts the buckets over all documents (the
raw corpus) and over the trusted ones (the target), summed in each task before anything is shuffled. With add-one
smoothing both become multinomials; a document's score is the sum of ln(target / raw) over its n-grams, divided by
their number. Every document whose score is at least `threshold` passes; no draw is involved.

The driver and each task hold two arrays of `buckets` numbers, whatever the corpus, and at most `IDS_SENT` ids.

Defined cases: a null text has no words; a very long text is counted whole, in memory that grows with it alone; a text without words scores 0 (and fails the base rules); repeated rows get
a row each; an empty table gives an empty result; a null doc_id is carried along and trusts nothing; labels given
twice count once; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

from pyspark.sql import DataFrame, functions as F

from ._shared import cut, pick, slices

BUCKETS = 1 << 14
#: A pair's bucket is (MIX * left + right) mod buckets of the words' hashes, a word's is its hash mod buckets.
MIX = 1_000_003
#: Scores below this, in nats for each n-gram, are not kept. Of the labelled documents of the 0.1 tables that pass the
#: base rules, label 1 scores -0.032 at least and 95 in 100 of label 0 under -0.083; where half of the labelled documents
#: are trusted, the other half scores -0.027 at least and under -0.092. The cut lies between.
THRESHOLD = -0.06
#: Trusted ids that are sent to every task, 8 bytes each; more are joined.
IDS_SENT = 4_000_000
SYMBOLS = "#*$%&|<>"
CACHE_WORDS = 800_000


class Hashes(dict):
    """A word's hash: the first 32 bits of its MD5."""

    def __missing__(self, word: bytes) -> int:
        own = self[word] = int.from_bytes(hashlib.md5(word, usedforsecurity=False).digest()[:4], "big")
        return own


@lru_cache(maxsize=1)
def hashes() -> Hashes:
    return Hashes()


def word_hashes(words: list[bytes]):
    import numpy as np

    known = hashes()
    if len(known) > CACHE_WORDS:
        known.clear()
    return np.fromiter(map(known.__getitem__, words), np.int64, len(words))


def buckets_of(h, buckets: int):
    import numpy as np

    return np.concatenate([h % buckets, (h[:-1] * MIX + h[1:]) % buckets]) if len(h) else h


def repeated_window_words(words: list[bytes], h, width: int = 8) -> int:
    """Words inside windows of `width` words that the text has twice or more, the first one included."""
    import numpy as np

    n = len(h) - width + 1
    if n < 2:
        return 0
    mixed = np.zeros(n, np.uint64)
    for k in range(width):
        mixed = mixed * np.uint64(0x9E3779B97F4A7C15) + h[k : k + n].astype(np.uint64)
    order = np.argsort(mixed, kind="stable")
    same = np.zeros(n, bool)
    equal = mixed[order[1:]] == mixed[order[:-1]]
    if not equal.any():
        return 0
    same[order[1:][equal]] = same[order[:-1][equal]] = True
    seen: dict[tuple, int] = {}  # the words themselves decide
    spots = np.flatnonzero(same).tolist()
    keys = [tuple(words[i : i + width]) for i in spots]
    for key in keys:
        seen[key] = seen.get(key, 0) + 1
    marks = np.zeros(len(h) + 1, np.int64)
    for i, key in zip(spots, keys, strict=True):
        if seen[key] > 1:
            marks[i] += 1
            marks[i + width] -= 1
    return int(np.count_nonzero(np.cumsum(marks)[:-1]))


def base_counts(text: str, words: list[bytes], h) -> tuple[int, int, int, int]:
    """word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    lines = [x for x in text.encode().split(b"\n") if x.strip()]
    return (
        len(text) - sum(map(text.count, " \t\n\x0b\x0c\r")),
        sum(map(text.count, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated_window_words(words, h),
    )


def bucket_counts(docs: DataFrame, trusted: DataFrame, buckets: int = BUCKETS, most_sent: int = IDS_SENT) -> DataFrame:
    """bucket, raw, target: how often each bucket occurs in all documents and in the trusted ones.

    `trusted` holds doc_ids. Up to `most_sent` of them are sent to all tasks as a sorted array, and one pass counts both.
    More are joined by a sort-merge join: raw counts come from a pass without it, so that only the texts that it keeps
    are counted again as the target. Either way each task counts its documents and only (task, bucket) sums are shuffled.
    """
    own = pick(docs, doc_id="long", text="string")
    ids = pick(trusted, doc_id="long").where("doc_id is not null").distinct()
    ids = cut(ids)
    n = ids.count()

    def counting(which: str, shared=None):
        def run(batches: Iterator) -> Iterator:
            import numpy as np
            import pyarrow as pa

            raw, target = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
            known = shared.value if shared else None
            for batch in slices(batches, 1024):
                good = np.full(batch.num_rows, which == "target")
                if known is not None and len(known):
                    i = batch.column(0).fill_null(known[0]).to_numpy(zero_copy_only=False)
                    good = (known[np.minimum(np.searchsorted(known, i), len(known) - 1)] == i) & batch.column(0).is_valid().to_numpy(zero_copy_only=False)
                for text, is_good in zip(batch.column(1).to_pylist(), good.tolist(), strict=True):
                    if text:
                        found = np.bincount(buckets_of(word_hashes(text.encode().split()), buckets), minlength=buckets)
                        if which != "target":
                            raw += found
                        if is_good:
                            target += found
            got = np.flatnonzero(raw + target)
            yield pa.RecordBatch.from_arrays([pa.array(got), pa.array(raw[got]), pa.array(target[got])], ["bucket", "raw", "target"])

        return run

    schema = "bucket long, raw long, target long"
    if n <= most_sent:
        shared = docs.sparkSession.sparkContext.broadcast(ids.orderBy("doc_id").toArrow().column(0).to_numpy())
        parts = own.mapInArrow(counting("both", shared), schema)
    else:
        kept = own.join(ids.hint("merge"), "doc_id", "left_semi").select("doc_id", "text")
        parts = own.mapInArrow(counting("raw"), schema).union(kept.mapInArrow(counting("target"), schema))
    return parts.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))


def log_ratios(counts: DataFrame, buckets: int = BUCKETS):
    """ln(target / raw) of each bucket, add-one smoothed; an array of fixed size."""
    import numpy as np

    raw, target = np.zeros(buckets), np.zeros(buckets)
    for bucket, r, t in counts.toArrow().to_pandas()[["bucket", "raw", "target"]].itertuples(index=False):
        raw[bucket], target[bucket] = r, t
    return np.log((target + 1) / (target.sum() + buckets)) - np.log((raw + 1) / (raw.sum() + buckets))


COLUMNS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, log_ratio double, kept boolean"


def quality_rules(docs: DataFrame, trusted: DataFrame, threshold: float = THRESHOLD, buckets: int = BUCKETS) -> DataFrame:
    """The base counts, the ratio and the verdict for every document of `docs` (doc_id, text)."""
    ratios = log_ratios(bucket_counts(docs, trusted, buckets), buckets)
    shared = docs.sparkSession.sparkContext.broadcast(ratios)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        ratio = shared.value
        for part in slices(batches, 1024):
            out = []
            for text in part.column(1).to_pylist():
                words = (text or "").encode().split()
                h = word_hashes(words)
                base = base_counts(text or "", words, h)
                failed = len(words) < 20 or 100 * base[3] > 30 * len(words)
                spots = buckets_of(h, buckets)
                score = float(ratio[spots].sum() / len(spots)) if len(spots) else 0.0
                out.append((len(words), *base, failed, score, not failed and score >= threshold))
            kinds = [pa.int64()] * 5 + [pa.bool_(), pa.float64(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True))], ["doc_id", *(c.split()[0] for c in COLUMNS.split(", "))])

    return pick(docs, doc_id="long", text="string").mapInArrow(run, f"doc_id long, {COLUMNS}")
