"""Quality by attention-based multiple-instance learning.

A document is a bag of passages of `PASSAGE_WORDS` words, all of its text. Each passage is encoded: measurements of
its words and how they repeat, and its words hashed into a short count vector, go through a learnt layer of `HIDDEN`
units. Gated attention, tanh(V h) times sigmoid(U h), weighs the passages; the weighted sum of their encodings is the
document's representation, which a logistic unit scores. Encoder, attention and unit are learnt together from labels
of documents only; passages have none.

Fitting uses at most `SAMPLE` labelled documents, half of each class where there are enough, taken by the hash of
their ids, and none longer than `SAMPLE_BYTES`. Scoring goes over all documents in one pass without a shuffle, in
running sums over blocks of passages, so that a very long text needs no more memory than a block.

Defined cases: a null text counts as empty; a text without words is one empty passage; without labels of both classes
every score is the share of label 1 or 0; equal and repeated rows get equal scores; a document labelled twice counts as
1 if any label says so; a text of more than a block of words is encoded block by block, where repeats are looked for
within a block, and its rest shorter than a passage is a passage; an empty table gives an empty result; a null doc_id is carried along and is not held out; other
columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

from pyspark.sql import DataFrame

from ._shared import pick, slices
from .labelled import held_out, labelled_sample

PASSAGE_WORDS, HASHED, HIDDEN, GATE = 48, 48, 32, 16
SAMPLE, SAMPLE_BYTES = 6000, 65_536
FOLDS, HELD_FOLD = 4, 2
THRESHOLD = 0.7
#: Words encoded at a time, a multiple of the passage.
BLOCK_WORDS = PASSAGE_WORDS * 4096
CACHE_WORDS = 400_000
#: Measurements of a word (fixed order) and of a passage.
OF_WORD, OF_PASSAGE = 8, 5
SYMBOLS, STOPS = set("#*$%&|<>{}[]=+@^~_\\/"), set(".,;:!?\"'()")


class WordTable:
    """Numbers words and keeps their measurements in an array."""

    def __init__(self):
        self.clear()

    def clear(self) -> None:
        import numpy as np

        self.ids: dict[str, int] = {}
        self.data = np.zeros((1 << 14, OF_WORD), np.float32)
        self.bucket = np.zeros(1 << 14, np.int64)

    def add(self, word: str) -> int:
        import numpy as np

        at = self.ids[word] = len(self.ids)
        if at >= len(self.data):
            self.data = np.concatenate([self.data, np.zeros_like(self.data)])
            self.bucket = np.concatenate([self.bucket, np.zeros_like(self.bucket)])
        n = len(word)
        letters = sum(map(str.isalpha, word))
        symbols = len([c for c in word if c in SYMBOLS])
        self.data[at] = (
            min(n, 60) / 10, letters / n, sum(map(str.isdigit, word)) / n, symbols > 0, len([c for c in word if c in STOPS]) / n,
            letters > 1 and word.isupper(), word[-1] in ".!?", word[:1].isupper(),
        )
        self.bucket[at] = zlib.crc32(word.lower().encode("utf-8", "surrogatepass")) % HASHED
        return at

    def __call__(self, words: list[str]):
        import numpy as np

        if len(self.ids) > CACHE_WORDS:
            self.clear()
        get, add = self.ids.get, self.add
        return np.array([i if (i := get(w)) is not None else add(w) for w in words], np.int64)


@lru_cache(maxsize=1)
def word_table() -> WordTable:
    return WordTable()


def passages(words: list[str], of_text: int | None = None):
    """A row of features for each passage of the words (one row of zeros if there is none).

    of_text: how many words the whole text has, if these are a block of them.
    """
    import numpy as np

    if not words:
        return np.zeros((1, OF_WORD + OF_PASSAGE + HASHED), np.float32)
    table = word_table()
    ids = table(words)
    n = len(ids)
    k = max(1, n // PASSAGE_WORDS)  # a shorter rest belongs to the last passage
    of = np.minimum(np.arange(n) // PASSAGE_WORDS, k - 1)
    sizes = np.bincount(of, minlength=k).astype(np.float32)
    starts = np.arange(k) * PASSAGE_WORDS
    out = np.zeros((k, OF_WORD + OF_PASSAGE + HASHED), np.float32)
    out[:, :OF_WORD] = np.add.reduceat(table.data[ids], starts, axis=0) / sizes[:, None]
    distinct = np.unique(of * (1 << 32) + ids) >> 32
    out[:, OF_WORD] = np.bincount(distinct, minlength=k) / sizes
    same = np.zeros(n, np.float32)
    same[1:] = ids[1:] == ids[:-1]
    out[:, OF_WORD + 1] = np.add.reduceat(same, starts) / sizes
    if n >= 4:
        windows = ids[:-3] * 1_000_003 + ids[1:-2] * 10_007 + ids[2:-1] * 101 + ids[3:]
        _, back, times = np.unique(windows, return_inverse=True, return_counts=True)
        again = np.zeros(n, np.float32)
        again[: n - 3] = times[back] > 1
        out[:, OF_WORD + 2] = np.add.reduceat(again, starts) / sizes
    out[:, OF_WORD + 3] = np.minimum(sizes, PASSAGE_WORDS) / PASSAGE_WORDS
    out[:, OF_WORD + 4] = min(of_text or n, 2000) / 2000
    hashed = np.bincount(of * HASHED + table.bucket[ids], minlength=k * HASHED).reshape(k, HASHED)
    out[:, OF_WORD + OF_PASSAGE :] = np.sqrt(hashed / sizes[:, None])
    return out


WIDTH = OF_WORD + OF_PASSAGE + HASHED


class Model:
    """Encoder, gated attention and scoring unit."""

    def __init__(self, seed: int = 7):
        import numpy as np

        draw = np.random.default_rng(seed)
        self.mean, self.scale = np.zeros(WIDTH), np.ones(WIDTH)
        self.p = {
            "W": draw.normal(0, WIDTH**-0.5, (WIDTH, HIDDEN)), "b": np.zeros(HIDDEN),
            "V": draw.normal(0, HIDDEN**-0.5, (HIDDEN, GATE)), "U": draw.normal(0, HIDDEN**-0.5, (HIDDEN, GATE)), "w": draw.normal(0, GATE**-0.5, GATE),
            "c": draw.normal(0, HIDDEN**-0.5, HIDDEN), "d": np.zeros(1),
        }

    def encode(self, x):
        """Encodings and attention scores (before the softmax) of passages."""
        import numpy as np

        p = self.p
        h = np.tanh(((x - self.mean) / self.scale) @ p["W"] + p["b"])
        return h, (np.tanh(h @ p["V"]) / (1 + np.exp(-(h @ p["U"])))) @ p["w"]

    def bag(self, blocks) -> tuple[float, list]:
        """A document's probability, from blocks of passages in running sums, and the unscaled attention of each block."""
        import numpy as np

        top, total, summed, seen = -np.inf, 0.0, np.zeros(HIDDEN), []
        for x in blocks:
            h, a = self.encode(x)
            new = max(top, float(a.max()))
            shrink, e = np.exp(top - new), np.exp(a - new)
            total, summed, top = total * shrink + e.sum(), summed * shrink + e @ h, new
            seen.append(a)
        z = float(summed / total @ self.p["c"] + self.p["d"][0])
        return float(1 / (1 + np.exp(-np.clip(z, -500, 500)))), seen

    def fit(self, bags: list, labels: list[int], epochs: int = 30, batch: int = 64, seed: int = 11) -> Model:
        import numpy as np

        y = np.asarray(labels, np.float64)
        p = self.p
        if not len(y) or y.min() == y.max():
            share = float(y.mean()) if len(y) else 0.0
            p["c"][:], p["d"][0] = 0, np.log((share + 1e-9) / (1 - share + 1e-9))
            return self
        every = np.concatenate(bags)
        self.mean, self.scale = every.mean(0), every.std(0) + 1e-3
        draw = np.random.default_rng(seed)
        m1, m2 = ({k: np.zeros_like(v) for k, v in p.items()} for _ in range(2))
        t = 0
        for epoch in range(epochs):
            order = draw.permutation(len(bags))
            for at in range(0, len(order), batch):
                some = order[at : at + batch]
                x = (np.concatenate([bags[i] for i in some]) - self.mean) / self.scale
                sizes = np.array([len(bags[i]) for i in some])
                starts, of = np.cumsum([0, *sizes[:-1]]), np.repeat(np.arange(len(some)), sizes)
                h = np.tanh(x @ p["W"] + p["b"])
                v, u = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-(h @ p["U"])))
                a = (v * u) @ p["w"]
                e = np.exp(a - np.maximum.reduceat(a, starts)[of])
                alpha = e / np.add.reduceat(e, starts)[of]
                z = np.add.reduceat(alpha[:, None] * h, starts)
                s = 1 / (1 + np.exp(-np.clip(z @ p["c"] + p["d"][0], -30, 30)))
                ds = (s - y[some]) / len(some)
                g = {"c": z.T @ ds, "d": np.array([ds.sum()])}
                dz = ds[:, None] * p["c"]
                dalpha = (dz[of] * h).sum(1)
                da = alpha * (dalpha - np.add.reduceat(alpha * dalpha, starts)[of])
                dvu = da[:, None] * p["w"]
                dv, du = dvu * u * (1 - v * v), dvu * v * u * (1 - u)
                g |= {"w": (v * u).T @ da, "V": h.T @ dv, "U": h.T @ du}
                dh = (alpha[:, None] * dz[of] + dv @ p["V"].T + du @ p["U"].T) * (1 - h * h)
                g |= {"W": x.T @ dh + 1e-5 * p["W"], "b": dh.sum(0)}
                t += 1
                rate = 0.01 * (1 - epoch / epochs) + 0.0005
                for k in p:
                    m1[k] = 0.9 * m1[k] + 0.1 * g[k]
                    m2[k] = 0.999 * m2[k] + 0.001 * g[k] ** 2
                    p[k] -= rate * (m1[k] / (1 - 0.9**t)) / (np.sqrt(m2[k] / (1 - 0.999**t)) + 1e-8)
        return self


def blocks_of(text: str | None) -> Iterator:
    """Feature rows of a text's passages, block by block."""
    words = (text or "").split()
    for at in range(0, max(1, len(words)), BLOCK_WORDS):
        yield passages(words[at : at + BLOCK_WORDS], len(words))


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """Fits to the labelled documents outside the held fold; labels: doc_id and the 0/1 column quality."""

    def features(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in slices(batches):
            found = [np.concatenate(list(blocks_of(t))).ravel() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.float32())), batch.column(2)], ["doc_id", "bag", "label"])

    sample = labelled_sample(docs, labels, "quality", FOLDS, HELD_FOLD, SAMPLE, SAMPLE_BYTES)
    got = sample.mapInArrow(features, "doc_id long, bag array<float>, label int").toArrow().sort_by("doc_id")
    return Model().fit([x.values.to_numpy().reshape(-1, WIDTH) for x in got.column("bag")], got.column("label").to_pylist())


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD, with_attention: bool = True) -> DataFrame:
    """held_out, score, predicted for every document of `docs` (doc_id, text), and its passages' attention weights."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        own = shared.value
        for batch in slices(batches):
            scores, weights = [], []
            for text in batch.column(1).to_pylist():
                p, seen = own.bag(blocks_of(text))
                scores.append(p)
                a = np.concatenate(seen)
                e = np.exp(a - a.max())
                weights.append(e / e.sum() if with_attention else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([held_out(i, FOLDS, HELD_FOLD) for i in batch.column(0).to_pylist()], pa.bool_()), pa.array(scores, pa.float64()), pa.array([int(p >= threshold) for p in scores], pa.int32()), pa.array(weights, pa.list_(pa.float64()))],
                ["doc_id", "held_out", "score", "predicted", "attention"],
            )

    return pick(docs, doc_id="long", text="string").mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int, attention array<double>")
