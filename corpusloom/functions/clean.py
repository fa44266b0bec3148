"""Column to Column: cleaning and normalisation of texts and names."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, functions as F

from .text import strip

#: Marks around a matched header while the characters at its ends are dropped.
OPEN, CLOSE = "\u0001", "\u0002"


def clean_encyclopedia(text: Column) -> Column:
    """Header lines keep their words only; templates without inner braces and [numbers] go; at most two newlines."""
    t = F.regexp_replace(text, r"(?md)^={1,6}.+={1,6}\s*$", f"{OPEN}$0{CLOSE}")
    t = F.regexp_replace(t, f"{OPEN}[= \\n]*|[= \\n]*{CLOSE}", "")
    t = F.regexp_replace(t, r"\{\{[^}]*\}\}", "")
    t = F.regexp_replace(t, r"\[\d+\]", "")
    return strip(F.regexp_replace(t, r"\n{3,}", "\n\n"))


def clean_legal(text: Column) -> Column:
    """Lines with a page number only go, runs of blanks become one, at most two newlines."""
    t = F.regexp_replace(text, r"(?md)^\s*-?\s*\d+\s*-?\s*$", "")
    t = F.regexp_replace(t, r"[ \t]{2,}", " ")
    return strip(F.regexp_replace(t, r"\n{3,}", "\n\n"))


def accented() -> dict[str, str]:
    """Base letter to the Latin lower-case letters that decompose into it and one combining mark, up to U+024F."""
    out: dict[str, str] = {}
    for c in map(chr, range(0xC0, 0x250)):
        parts = unicodedata.normalize("NFD", c)
        if len(parts) == 2 and parts[0].isascii() and c == c.lower():
            out[parts[0]] = out.get(parts[0], "") + c
    return out


def normalize_for_dedup(text: Column) -> Column:
    """Lower-case letters, digits and underscores; an accented letter becomes its base letter and a gap."""
    t = F.lower(text)
    for base, group in sorted(accented().items()):
        t = F.regexp_replace(t, f"[{group}]", f"{base} ")
    t = F.regexp_replace(t, r"[^\p{L}\p{N}_\s]", " ")
    return strip(F.regexp_replace(t, r"\s+", " "))


def normalize_python(text: str) -> str:
    """The same for any script: decomposed, lower-cased, what is no word character blanked."""
    import re

    t = re.sub(r"[^\w\s]", " ", unicodedata.normalize("NFD", text).lower())
    return re.sub(r"\s+", " ", t).strip()


def titled(title: Column, text: Column) -> Column:
    return F.when(F.coalesce(title, F.lit("")) != "", F.concat(title, F.lit("\n\n"), text)).otherwise(text)


def one_line(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def truncated(text: Column, most: int = 1_000_000) -> Column:
    return F.left(text, F.lit(most))


def row_id(own: Column, source: Column, ordinal: Column) -> Column:
    """The id, or source_ordinal where it is missing."""
    return F.coalesce(F.nullif(own.cast("string"), F.lit("")), F.concat_ws("_", source, ordinal.cast("string")))


def path_id(path: Column) -> Column:
    return F.substring(F.md5(path.cast("binary")), 1, 16)


def first_folder(path: Column) -> Column:
    return F.lower(F.split(path, "/")[0])


def base_source(source: Column) -> Column:
    return F.split(source, "_")[0]


def model_lines(text: Column) -> Column:
    """Stripped lines of more than 20 characters."""
    return F.filter(F.transform(F.split(text, "\n"), strip), lambda x: F.length(x) > 20)


def host(url: Column) -> Column:
    """Lower-cased network location, with port and user as written."""
    return F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.\-]*://([^/?#]*)", 1)


#: Domains that count as national (fixed values).
NATIONAL_DOMAINS = ["br", "com.br", "gov.br", "edu.br", "org.br", "net.br"]


def top_domain(url: Column) -> Column:
    """The last label, or the last two below a country with second-level domains; unknown without a host."""
    labels = F.split(host(url), r"\.")
    last = F.element_at(labels, -1)
    two = F.array_join(F.slice(labels, -2, 2), ".")
    # countries whose second level is part of the name (fixed values)
    country = last.isin("br", "uk", "au", "jp", "de", "fr", "pt")
    return F.when(host(url) == "", F.lit("unknown")).when((F.size(labels) >= 3) & country, two).otherwise(last)


def markdown_urls(text: Column) -> Column:
    """Link targets, then bare addresses, each once, in order."""
    targets = F.regexp_extract_all(text, F.lit(r"\[[^\n]*?\]\((https?://[^)]+)\)"), 1)
    bare = F.regexp_extract_all(text, F.lit(r"(?<!\()(https?://[^\s)\]]+)"), 1)
    return F.array_distinct(F.concat(targets, bare))


def skipped_url(url: Column, parts: list[str]) -> Column:
    """Whether the address contains one of the listed parts."""
    out = F.lit(False)
    for p in parts:
        out = out | F.contains(url, F.lit(p))
    return out


def answer(text: Column) -> Column:
    """The first word, lower-cased, without punctuation at its ends."""
    cls = r"[.,;:!?\"'()\[\]]+"
    return F.regexp_replace(F.lower(F.split(strip(text), r"\s+")[0]), f"^{cls}|{cls}$", "")


def first_match(value: Column, table: list[tuple[str, str]], otherwise: Column) -> Column:
    """The name of the first key, in order, that the lower-cased value contains."""
    out = None
    for key, name in table:
        hit = F.contains(F.lower(value), F.lit(key))
        out = F.when(hit, F.lit(name)) if out is None else out.when(hit, F.lit(name))
    return otherwise if out is None else out.otherwise(otherwise)
