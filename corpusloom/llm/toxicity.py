"""Toxicity by a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

A text's distinct lower-case words, each between two spaces, are cut into n-grams of `SIZES` characters, which are
hashed into `features` buckets; a bucket's value is how often the distinct words have it. From the labelled sample
come the log-count ratios r of all buckets between toxic and other documents, smoothed; a logistic regression is then
fitted to the values times r, with an L2 penalty, classes weighted by the square root of their odds. No bucket is left
out. A document's score is the fitted probability over the n-grams of its whole text; as it is a sum over words, a
word's part is computed once and kept.

Fitting uses at most `SAMPLE` labelled documents, half of each class where there are enough, taken by the hash of
their ids, and none longer than `SAMPLE_BYTES`. What reaches the driver is, for each of them, the hashes of its words
and, for each word of the sample, its buckets. Scoring goes over all documents in one pass without a shuffle.

Defined cases: a null text counts as empty, an empty text gets the score of no n-gram at all; without labels of both
classes every score is the share of toxic labels or 0; equal and repeated rows get equal scores; a document labelled
twice counts as toxic if any label says so; an empty table gives an empty result; a null doc_id is carried along and is
not held out; a very long text is read in stretches cut at white space, so that only its distinct words are held;
columns to keep are named by the caller and come first.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, functions as F

from ._shared import cut, pick, release, slices
from .labelled import held_out, labelled_sample

SIZES = (3, 4, 5, 6)
FEATURES = 1 << 20
SAMPLE, SAMPLE_BYTES = 4000, 65_536
FOLDS, HELD_FOLD = 5, 0
THRESHOLD = 0.5
#: Characters of a text that are split at a time, words kept in a worker and the longest of them.
STRETCH, CACHE_WORDS, KEPT_CHARS = 1 << 20, 150_000, 48
SPACE = re.compile(r"\s")


def word_set(text: str | None) -> set[str]:
    """The distinct lower-case words of a text."""
    out: set[str] = set()
    text, at = text or "", 0
    while at < len(text):
        end = SPACE.search(text, min(at + STRETCH, len(text)))
        stop = end.end() if end else len(text)
        out.update(text[at:stop].lower().split())
        at = stop
    return out


def buckets(words: list[str], features: int = FEATURES, sizes: tuple[int, ...] = SIZES):
    """The buckets of the n-grams of each word between two spaces: numbers of words, and buckets, as often as they occur."""
    import numpy as np

    codes = np.frombuffer((" " + "  ".join(words) + " ").encode("utf-32-le", "surrogatepass"), "<u4")
    of = np.repeat(np.arange(len(words), dtype=np.int32), np.fromiter(map(len, words), np.int64, len(words)) + 2) if words else np.zeros(len(codes), np.int32)
    h, shift, numbers, found = codes, np.uint32(32 - (features - 1).bit_length()), [], []
    for n in range(2, max(sizes) + 1):
        h = h[:-1] * np.uint32(0x01000193) ^ codes[n - 1 :]
        if n in sizes:
            own = of[: len(h)]
            inside = own == of[n - 1 :]
            numbers.append(own[inside])
            found.append((h[inside] * np.uint32(0x9E3779B1) >> shift).view(np.int32))
    return np.concatenate(numbers), np.concatenate(found)


def log_count_ratios(ones, zeros, n_ones: int, n_zeros: int):
    """ln of the smoothed counts of each bucket for each document, of label 1 over label 0."""
    import numpy as np

    return np.log((ones + 1.0) / (n_ones + 2)) - np.log((zeros + 1.0) / (n_zeros + 2))


class Sample:
    """The sample's documents as numbers of words and its words as buckets, to multiply by from either side.

    `used` are the buckets that occur, in order; weights and sums are theirs.
    """

    def __init__(self, docs: list, sizes, flat):
        """docs: arrays of numbers of words; sizes, flat: how many buckets each word has, and these word by word."""
        import numpy as np

        self.n_docs, self.n_words = len(docs), len(sizes)
        self.doc_of = np.repeat(np.arange(len(docs), dtype=np.int32), [len(d) for d in docs])
        self.word = np.concatenate([np.empty(0, np.int32), *docs]).astype(np.int32)
        by = np.argsort(flat, kind="stable").astype(np.int32)
        self.used, self.bucket_starts = np.unique(flat[by], return_index=True)
        self.bucket = np.searchsorted(self.used, flat).astype(np.int32)  # word by word
        self.word_starts = np.cumsum(sizes) - sizes
        self.word_of = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)[by]  # bucket by bucket

    def of_documents(self, weights):
        """The sum of weights over each document's words' buckets."""
        import numpy as np

        by_word = sums(weights, self.bucket, self.word_starts)  # a word between two spaces has a bucket
        return np.bincount(self.doc_of, weights=by_word[self.word], minlength=self.n_docs)

    def of_buckets(self, values):
        """The sum of the documents' values over the words that have each bucket."""
        import numpy as np

        return sums(np.bincount(self.word, weights=values[self.doc_of], minlength=self.n_words), self.word_of, self.bucket_starts)


def sums(values, picked, starts, block: int = 50_000):
    """The sum of the picked values of each stretch that begins at a start, some stretches at a time."""
    import numpy as np

    out, edges = np.zeros(len(starts)), np.append(starts, len(picked))
    for a in range(0, len(starts), block):
        own = edges[a : a + block + 1]
        out[a : a + block] = np.add.reduceat(values[picked[own[0] : own[-1]]], own[:-1] - own[0])
    return out


def fit(sample: Sample, labels: list[int], features: int = FEATURES, rounds: int = 80, penalty: float = 0.03, step: float = 0.02):
    """Weights for each bucket (ratio and regression together) and the intercept.

    The weighted logistic loss is minimised by gradient steps with running moments.
    """
    import numpy as np

    y = np.asarray(labels, np.float64)
    if not len(y) or y.min() == y.max():
        share = float(y.mean()) if len(y) else 0.0
        return np.zeros(features, np.float32), float(np.log((share + 1e-9) / (1 - share + 1e-9)))
    n_ones, n_zeros = y.sum(), (1 - y).sum()
    ratio = log_count_ratios(sample.of_buckets(y), sample.of_buckets(1 - y), n_ones, n_zeros)
    of_class = np.where(y == 1, math.sqrt(n_zeros / n_ones), 1.0)
    of_class /= of_class.sum()
    w, b = np.zeros(len(sample.used)), 0.0
    m1, m2, c1, c2 = np.zeros(len(w)), np.zeros(len(w)), 0.0, 0.0
    for t in range(1, rounds + 1):
        z = sample.of_documents(w * ratio) + b
        error = (1 / (1 + np.exp(-np.clip(z, -35, 35))) - y) * of_class
        g = sample.of_buckets(error) * ratio + penalty * w
        gb = error.sum()
        m1, m2, c1, c2 = 0.9 * m1 + 0.1 * g, 0.99 * m2 + 0.01 * g * g, 0.9 * c1 + 0.1 * gb, 0.99 * c2 + 0.01 * gb * gb
        w -= step * (m1 / (1 - 0.9**t)) / (np.sqrt(m2 / (1 - 0.99**t)) + 1e-8)
        b -= step * (c1 / (1 - 0.9**t)) / (np.sqrt(c2 / (1 - 0.99**t)) + 1e-8)
    out = np.zeros(features, np.float32)
    out[sample.used] = w * ratio
    return out, float(b)


def train(docs: DataFrame, labels: DataFrame, features: int = FEATURES):
    """Fits to the labelled documents outside the held fold; labels: doc_id and the 0/1 column toxic."""
    import numpy as np

    sample = cut(labelled_sample(docs, labels, "toxic", FOLDS, HELD_FOLD, SAMPLE, SAMPLE_BYTES))

    def hashed(word: str) -> int:
        import xxhash

        h = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))
        return h - (1 << 64) if h >> 63 else h

    def of_documents(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in slices(batches):
            found = [sorted(map(hashed, word_set(t))) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int64())), batch.column(2)], ["doc_id", "words", "label"])

    def distinct(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays([pa.array(sorted(set().union(*map(word_set, batch.column(1).to_pylist()))), pa.string())], ["word"])

    def of_words(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in slices(batches, 4096):
            words = batch.column(0).to_pylist()
            of, found = buckets(words, features)
            by = np.argsort(of, kind="stable")
            of, found = of[by], found[by]
            ends = np.searchsorted(of, np.arange(len(words) + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(map(hashed, words), pa.int64()), pa.ListArray.from_arrays(pa.array(ends), pa.array(found))], ["word", "buckets"])

    words = sample.mapInArrow(distinct, "word string").distinct().mapInArrow(of_words, "word long, buckets array<int>").toArrow().sort_by("word")
    got = sample.mapInArrow(of_documents, "doc_id long, words array<long>, label int").toArrow().sort_by("doc_id")
    known = words.column("word").to_numpy()
    numbers = [np.searchsorted(known, x.values.to_numpy()).astype(np.int32) for x in got.column("words")]
    lists = words.column("buckets").combine_chunks()
    own = Sample(numbers, np.diff(lists.offsets.to_numpy()), lists.flatten().to_numpy())
    truth = got.column("label").to_pylist()
    del words, got, lists, known, numbers
    model = fit(own, truth, features)
    del own
    release()
    return model


class Scorer:
    """Adds up the parts of texts' words."""

    def __init__(self, model):
        self.weights, self.bias = model
        self.known: dict[str, float] = {}

    def learn(self, words: list[str]) -> None:
        import numpy as np

        of, found = buckets(words, len(self.weights))
        self.known.update(zip(words, np.bincount(of, weights=self.weights[found], minlength=len(words)).tolist(), strict=True))

    def __call__(self, texts: list[str | None]) -> list[float]:
        if len(self.known) > CACHE_WORDS:
            self.known.clear()
        sets = list(map(word_set, texts))
        new = sorted(set().union(*sets).difference(self.known))
        for at in range(0, len(new), 1 << 16):
            self.learn(new[at : at + (1 << 16)])
        z = [math.fsum(map(self.known.__getitem__, own)) + self.bias for own in sets]
        for word in new:
            if len(word) > KEPT_CHARS:
                del self.known[word]
        return [1 / (1 + math.exp(-max(-500.0, min(500.0, x)))) for x in z]


COLUMNS = "held_out boolean, score double, predicted int"


def score(docs: DataFrame, model, keep: tuple[str, ...] = (), threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, the columns in `keep`, held_out, score and predicted for every document of `docs` (doc_id, text)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        own = Scorer(shared.value)
        for batch in slices(batches):
            p = np.array(own(batch.column(1).to_pylist()))
            out = [pa.array([held_out(i, FOLDS, HELD_FOLD) for i in batch.column(0).to_pylist()], pa.bool_()), pa.array(p), pa.array((p >= threshold).astype(np.int32))]
            kept = [batch.column(0), *batch.columns[2:]]
            yield pa.RecordBatch.from_arrays(kept + out, [*names, "held_out", "score", "predicted"])

    types = dict(docs.dtypes)
    own = pick(docs, doc_id="long", text="string", **{f"{c}": types[c] for c in keep if c not in ("doc_id", "text")})
    names = ["doc_id", *own.columns[2:]]
    if "text" in keep:
        own, names = own.withColumn("kept_text", F.col("text")), [*names, "kept_text"]
    schema = ", ".join(f"`{c}` {dict(own.dtypes)[c]}" for c in names)
    out = own.mapInArrow(run, f"{schema}, {COLUMNS}")
    return out.withColumnRenamed("kept_text", "text") if "text" in keep else out
