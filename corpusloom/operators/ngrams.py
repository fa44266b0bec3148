"""The most frequent and the repeated runs of words of each document, in Arrow batches: a counter per document, no shuffle.

Sorting a document's runs within an expression costs some thirty times as much as counting them in a dictionary.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

from pyspark.sql import DataFrame


def top_chars(words: list[str], n: int) -> int:
    """Word lengths of the most frequent run of n words times its count; of equal counts the first seen."""
    counts = Counter(zip(*(words[i:] for i in range(n)), strict=False))
    if not counts:
        return 0
    run = max(counts, key=counts.__getitem__)
    return counts[run] * sum(map(len, run))


def repeated_chars(words: list[str], n: int) -> int:
    """Word lengths of the runs of n words that stood before, from left to right; a counted run's words are not counted again."""
    seen: set[tuple[str, ...]] = set()
    total, i = 0, 0
    while i <= len(words) - n:
        run = tuple(words[i : i + n])
        if run in seen:
            total += sum(map(len, run))
            i += n
        else:
            seen.add(run)
            i += 1
    return total


def with_top_ngrams(df: DataFrame, ns: tuple[int, ...] = (2, 3, 4), text: str = "text", repeated: tuple[int, ...] = ()) -> DataFrame:
    """df with top_2gram_chars and so on for each n, and dup_5gram_chars and so on for each of `repeated`; null and empty texts have 0."""
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields]
    at, names = df.columns.index(text), [*(f"top_{n}gram_chars" for n in ns), *(f"dup_{n}gram_chars" for n in repeated)]

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            found = [[*(top_chars(w, n) for n in ns), *(repeated_chars(w, n) for n in repeated)] for w in ((t or "").split() for t in batch.column(at).to_pylist())]
            cols = [pa.array([f[k] for f in found], pa.int64()) for k in range(len(names))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *cols], [*batch.schema.names, *names])

    return df.mapInArrow(run, ", ".join([*fields, *(f"{n} bigint" for n in names)]))
