"""Model slots: anything that scores batches of texts, and an n-gram surrogate that can be trained here."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, functions as F

from ..functions.text import words
from ..session import cut
from .statistics import linear_percentiles


def score_with(df: DataFrame, make: Callable[[], Callable[[list], list]], column: str, kind: str = "double", text: str = "text", head: int | None = None) -> DataFrame:
    """df with `column`, the scores of its texts; `make` builds the scorer once in each task."""
    own = df.withColumn("_head", F.left(text, F.lit(head)) if head else F.col(text))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        score = make()
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(score(b.column(b.num_columns - 1).to_pylist()))], [*b.schema.names[:-1], column])

    return own.mapInArrow(run, f"{fields}, {column} {kind}")


def train_bigrams(docs: DataFrame) -> DataFrame:
    """first, second, n: counts of neighbouring lower-cased words, the model of the surrogate; a table of any size."""
    w = docs.select(words(F.lower(F.col("text"))).alias("w")).where(F.size("w") > 1)
    pairs = w.select(F.explode(F.zip_with(F.slice("w", F.lit(1), F.size("w") - 1), F.slice("w", F.lit(2), F.size("w") - 1), lambda a, b: F.struct(a.alias("first"), b.alias("second")))).alias("p"))
    return pairs.groupBy("p.first", "p.second").agg(F.count("*").alias("n"))


def perplexity(docs: DataFrame, model: DataFrame, key: str = "doc_id") -> DataFrame:
    """Add-one perplexity of each document under the bigram counts, by joins only.

    The model's rows carry their first word's total, so that a pair which the model has needs one join on both words.
    Only pairs that it lacks look for that total by the first word; the others have a key of their own there, no word's,
    so that common words gather no rows.
    """
    sizes = cut(model.groupBy("first").agg(F.sum("n").alias("total")))
    vocabulary = model.select("second").distinct().count()
    full = model.join(sizes, "first")
    w = docs.select(key, words(F.lower(F.col("text"))).alias("w")).where(F.size("w") > 1)
    pairs = w.select(key, F.explode(F.zip_with(F.slice("w", F.lit(1), F.size("w") - 1), F.slice("w", F.lit(2), F.size("w") - 1), lambda a, b: F.struct(a.alias("first"), b.alias("second")))).alias("p")).groupBy(key, "p.first", "p.second").agg(F.count("*").alias("k"))
    known = pairs.join(full, ["first", "second"], "left").withColumn("look", F.when(F.col("n").isNull(), F.col("first")).otherwise(F.concat(F.lit(" "), F.col("second"))))
    scored = known.join(sizes.select(F.col("first").alias("look"), F.col("total").alias("all")), "look", "left")
    log_p = F.log((F.coalesce("n", F.lit(0)) + 1.0) / (F.coalesce("total", "all", F.lit(0)) + float(vocabulary)))
    return scored.groupBy(key).agg(F.round(F.exp(-F.sum(log_p * F.col("k")) / F.sum("k")), 4).alias("perplexity"))


def language_gate(df: DataFrame, make: Callable[[], Callable[[list], list]], labels: list[str], least: float = 0.65, head: int = 1000) -> DataFrame:
    """Rows whose first characters, on one line, the scorer gives one of the labels with at least this probability.

    The scorer gives (label, probability) for each text, or None, which accepts nothing, as does an empty text.
    """
    fields = df.columns
    own = df.withColumn("_line", F.replace(F.left("text", F.lit(head)), F.lit("\n"), F.lit(" ")))

    def split() -> Callable[[list], list]:
        score = make()
        return lambda texts: [float(p[1]) if t and t.strip() and p is not None and p[0] in labels else 0.0 for t, p in zip(texts, score(texts), strict=True)]

    return score_with(own, split, "_sure", text="_line").where(F.col("_sure") >= least).select(*fields)


def stop_word_language(lists: dict[str, list[str]]) -> Callable[[], Callable[[list], list]]:
    """A small language guesser for the slot: the language with most stop words among a text's words."""

    def make() -> Callable[[list], list]:
        sets = {k: set(v) for k, v in sorted(lists.items())}

        def score(texts: list) -> list:
            out = []
            for t in texts:
                ws = (t or "").lower().split()
                best = max(sets, key=lambda k: sum(w in sets[k] for w in ws))
                out.append(best if any(w in sets[best] for w in ws) else "unknown")
            return out

        return score

    return make


def tokenizer_rates(docs: DataFrame, path: str, key: str = "doc_id", least: int = 10) -> DataFrame:
    """tokens, fertility (tokens per word) of the first 8192 characters; share of the first 200 words in the first 2000
    characters that are one token, by the tokenizer file at `path`; documents of enough characters."""

    def run(batches: Iterator) -> Iterator:
        import os

        import pyarrow as pa

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        lib = Tokenizer.from_file(path)
        count = lambda ts: [len(e.ids) for e in lib.encode_batch_fast(ts, add_special_tokens=False)]
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                texts = part.column(1).to_pylist()
                heads = [t[:8192] for t in texts]
                ws = [t[:2000].split()[:200] for t in texts]
                tokens = count(heads)
                single = [sum(n == 1 for n in count(w)) / len(w) if w else 0.0 for w in ws]
                fertility = [n / max(len(h.split()), 1) for n, h in zip(tokens, heads, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(tokens, pa.int64()), pa.array(fertility), pa.array(single)], [key, "tokens", "fertility", "single_token_share"])

    own = docs.where(F.length("text") >= least).select(key, "text")
    return own.mapInArrow(run, f"`{key}` {dict(own.dtypes)[key]}, tokens bigint, fertility double, single_token_share double")


def extrapolated(rates: DataFrame, docs: DataFrame) -> DataFrame:
    """One row: documents measured, mean tokens, tokens of all documents at that mean, bytes per token, means of the rates."""
    total = docs.agg(F.count("*").alias("n"), F.sum(F.octet_length("text").cast("bigint")).alias("bytes"))
    rates = cut(rates)
    means = rates.agg(F.count("*").alias("sample_size"), F.avg("tokens").alias("mean_tokens"), F.round(F.avg("fertility"), 4).alias("fertility_mean"), F.round(F.avg("single_token_share"), 4).alias("strr_mean"))
    spread = linear_percentiles(rates, [], "fertility", [0.5, 0.95]).select(F.col("p50").alias("fertility_p50"), F.col("p95").alias("fertility_p95"))
    both = means.join(spread).join(total)  # single rows
    estimate = F.floor(F.col("mean_tokens") * F.col("n")).cast("bigint")
    return both.select(
        "sample_size", F.round("mean_tokens", 2).alias("mean_tokens_per_doc"), estimate.alias("total_tokens_est"), "fertility_mean", "fertility_p50", "fertility_p95",
        F.round(F.col("bytes") / F.greatest(estimate, F.lit(1)), 4).alias("bytes_per_token"), "strr_mean",
    )
