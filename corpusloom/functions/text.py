"""Column to Column: words, lines, shingles, ratios, scores. All of it stays in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

SPACE = r"(?U)\s+"


def strip(text: Column) -> Column:
    """Without white space at either end (trim() takes spaces only)."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def words(text: Column) -> Column:
    """Runs between white space."""
    return F.filter(F.split(text, SPACE), lambda w: w != "")


def lines(text: Column) -> Column:
    """Lines without their ends; a last empty one does not count."""
    ends = r"(?:\r\n|[\n\r\x0B\f\x1c-\x1e\x85\u2028\u2029])"
    return F.split(F.regexp_replace(text, ends + r"\z", ""), ends)


def letters(text: Column) -> Column:
    return F.length(F.regexp_replace(text, r"\P{L}", ""))


def alpha_ratio(text: Column) -> Column:
    return F.when(F.length(text) > 0, letters(text) / F.length(text)).otherwise(F.lit(0.0))


def type_token_ratio(tokens: Column) -> Column:
    """Distinct lower-cased words over words."""
    return F.when(F.size(tokens) > 0, F.size(F.array_distinct(F.transform(tokens, F.lower))) / F.size(tokens)).otherwise(F.lit(0.0))


def quality_score(text: Column, tokens: Column) -> Column:
    """0.4 letters + 0.3 distinct words + 0.3 log length up to ln 14, to four digits."""
    length = F.least(F.log1p(F.length(text)) / F.lit(14.0), F.lit(1.0))
    score = F.lit(0.4) * alpha_ratio(text) + F.lit(0.3) * type_token_ratio(tokens) + F.lit(0.3) * length
    return F.when(F.coalesce(F.length(text), F.lit(0)) == 0, F.lit(0.0)).otherwise(F.round(score, 4))


def estimated_tokens(text: Column) -> Column:
    """One for every four characters, one at least."""
    return F.greatest(F.lit(1), F.floor(F.length(text) / 4)).cast("long")


def share_of_list(tokens: Column, listed: list[str], stripped: str = "") -> Column:
    """Share of words that are in a list, lower-cased and, if asked, without the characters `stripped` at their ends."""
    own = F.array(*[F.lit(w) for w in sorted(listed)])

    def plain(w: Column) -> Column:
        low = F.lower(w)
        if stripped:
            cls = "[" + "".join("\\" + c for c in stripped) + "]+"
            low = F.regexp_replace(low, f"^{cls}|{cls}$", "")
        return low

    hits = F.size(F.filter(tokens, lambda w: F.array_contains(own, plain(w))))
    return hits / F.greatest(F.size(tokens), F.lit(1))


def shingles(tokens: Column, n: int, short_whole: bool = True) -> Column:
    """Distinct runs of n words, joined by spaces; a shorter text is one run, or none."""
    runs = F.array_distinct(F.transform(F.sequence(F.lit(0), F.size(tokens) - n), lambda i: F.array_join(F.slice(tokens, i + 1, n), " ")))
    rest = F.array(F.array_join(tokens, " ")) if short_whole else F.array().cast("array<string>")
    return F.when(F.size(tokens) >= n, runs).otherwise(rest)


def neighbours_equal(ordered: Column) -> Column:
    """For a sorted array, whether each value but the first equals the one before it."""
    n = F.size(ordered)
    return F.when(n > 1, F.zip_with(F.slice(ordered, F.lit(1), F.greatest(n - 1, F.lit(0))), F.slice(ordered, F.lit(2), F.greatest(n - 1, F.lit(0))), lambda a, b: a == b)).otherwise(F.array().cast("array<boolean>"))


def in_groups(ordered: Column) -> Column:
    """How many values of a sorted array have an equal one."""
    e = neighbours_equal(ordered)
    no = F.array(F.lit(False))
    return F.size(F.filter(F.zip_with(F.concat(no, e), F.concat(e, no), lambda a, b: a | b), lambda x: x))


def repeated_chars(ordered: Column) -> Column:
    """Characters of all values of a sorted array that repeat the one before them."""
    n = F.size(ordered)
    later = F.slice(ordered, F.lit(2), F.greatest(n - 1, F.lit(0)))
    own = F.zip_with(neighbours_equal(ordered), later, lambda q, s: F.when(q, F.length(s)).otherwise(0))
    return F.when(n > 1, F.aggregate(own, F.lit(0), lambda a, x: a + x)).otherwise(F.lit(0))


def keyed_words(listed: list[str], text: Column) -> Column:
    """How many of the listed strings the text contains."""
    total = F.lit(0)
    for w in sorted(listed):
        total = total + F.contains(text, F.lit(w)).cast("int")
    return total
