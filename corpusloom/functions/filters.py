"""Column to boolean Column: acceptance rules."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .lists import BRAZILIAN_MARKERS, EUROPEAN_MARKERS
from .text import keyed_words, letters, lines, repeated_chars, strip


def passes_web(text: Column) -> Column:
    """50 characters and half of them letters, without white space at the ends."""
    t = strip(text)
    return F.coalesce((F.length(t) >= 50) & (letters(t) / F.length(t) >= 0.5), F.lit(False))


def passes_encyclopedia(text: Column) -> Column:
    """100 characters, three fifths letters, three sentence marks."""
    t = strip(text)
    return F.coalesce((F.length(t) >= 100) & (letters(t) / F.length(t) >= 0.6) & (F.length(F.regexp_replace(t, "[^.!?]", "")) >= 3), F.lit(False))


def passes_legal(text: Column) -> Column:
    """100 characters and two fifths letters."""
    t = strip(text)
    return F.coalesce((F.length(t) >= 100) & (letters(t) / F.length(t) >= 0.4), F.lit(False))


def variant(text: Column, first: list[str] | None = None, second: list[str] | None = None) -> Column:
    """PT if the first 2000 characters contain more than twice as many markers of the second list, else BR."""
    head = F.lower(F.left(text, F.lit(2000)))
    own, other = keyed_words(first or BRAZILIAN_MARKERS, head), keyed_words(second or EUROPEAN_MARKERS, head)
    return F.when(other > own * 2, F.lit("PT")).otherwise(F.lit("BR"))


def not_empty(text: Column) -> Column:
    return F.coalesce(text != "", F.lit(False))


def valid_year(date: Column) -> Column:
    """The first four characters as a year between 1990 and 2030, else null."""
    year = F.substring(date, 1, 4)
    return F.when(year.rlike("^[0-9]{4}$") & F.try_to_number(year, F.lit("9999")).between(1990, 2030), year.cast("int"))


def gopher_quality(tokens: Column, text: Column) -> dict[str, Column]:
    """Each rule of the word-count filter, true where it passes."""
    n, ls = F.size(tokens), lines(text)
    mean = F.aggregate(tokens, F.lit(0), lambda a, w: a + F.length(w)) / F.greatest(n, F.lit(1))
    hashes = F.length(text) - F.length(F.replace(text, F.lit("#"), F.lit("")))
    dots = F.regexp_count(text, F.lit(r"\.\.\.|…"))
    share = lambda pattern: F.size(F.filter(ls, lambda x: x.rlike(pattern))) / F.size(ls)
    return {
        "words": n.between(50, 100_000),
        "word_length": mean.between(3, 10),
        "symbols": (hashes + dots) / F.greatest(n, F.lit(1)) <= 0.1,
        "bullets": share(r"^\s*[-*•‣●]") <= 0.9,
        "ellipses": share(r"(\.\.\.|…)\s*$") <= 0.3,
        "letters": F.size(F.filter(tokens, lambda w: w.rlike(r"\p{L}"))) / F.greatest(n, F.lit(1)) >= 0.8,
    }


def c4_kept(text: Column, least_sentences: int = 3) -> Column:
    """An array of the text of its lines that end in punctuation and do not ask for scripts; empty if the document is
    dropped. Exploded, it filters and gives the text in one evaluation; a condition on c4_lines() would make it twice."""
    kept = F.filter(lines(text), lambda x: x.rlike(r"[.!?\"']\s*$") & ~F.contains(F.lower(x), F.lit("javascript")))
    bad = F.contains(text, F.lit("{")) | F.contains(F.lower(text), F.lit("lorem ipsum"))
    return F.filter(F.array(F.array_join(kept, "\n")), lambda out: ~bad & (F.regexp_count(out, F.lit(r"[.!?]+(\s|$)")) >= least_sentences))


def c4_lines(text: Column, least_sentences: int = 3) -> Column:
    """The text of c4_kept(), null if the document is dropped."""
    return F.get(c4_kept(text, least_sentences), F.lit(0))


#: Highest shares of characters for repeated runs of words: most frequent 2 to 4 words (published values).
TOP_NGRAM_SHARES = {2: 0.20, 3: 0.18, 4: 0.16}
#: Highest shares of characters for runs of 5 to 10 words that stood before (published values).
REPEATED_NGRAM_SHARES = {5: 0.15, 6: 0.14, 7: 0.13, 8: 0.12, 9: 0.11, 10: 0.10}


def fineweb_lines(ordered: Column, text: Column) -> Column:
    """Of the sorted stripped lines that are not empty over 0.12 end in punctuation and under 0.67 have under 30 characters;
    lines that repeat have under 0.1 of the text's characters. A text without lines does not pass."""
    n = F.greatest(F.size(ordered), F.lit(1))
    ends, short = F.size(F.filter(ordered, lambda x: x.rlike(r"[.!?\"']$"))) / n, F.size(F.filter(ordered, lambda x: F.length(x) < 30)) / n
    return (ends > 0.12) & (short < 0.67) & (repeated_chars(ordered) / F.greatest(F.length(text), F.lit(1)) < 0.1)
