"""Counts of personal data in the first characters of a text."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Patterns of the four kinds (fixed values).
EMAIL = r"[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}"
TAX_NUMBER = r"\b\d{3}[.\-]?\d{3}[.\-]?\d{3}[.\-]?\d{2}\b"
PHONE = r"\(?\b([1-9][1-9])\)?\s*[\s\-]?\b(9\d{4}|\d{4})[\s\-]?\d{4}\b"
IP_ADDRESS = r"\b(?:[0-9]{1,3}\.){3}[0-9]{1,3}\b"
HEAD = 5000


def valid_tax_number(number: Column) -> Column:
    """Eleven digits, not all alike, of which the last two are the right check digits."""
    d = F.regexp_replace(number, r"\D", "")

    def check(n: int) -> Column:
        total = F.lit(0)
        for j in range(n):
            total = total + F.substring(d, j + 1, 1).try_cast("int") * (n + 1 - j)
        return total * 10 % 11 % 10

    right = (check(9) == F.substring(d, 10, 1).try_cast("int")) & (check(10) == F.substring(d, 11, 1).try_cast("int"))
    return F.coalesce((F.length(d) == 11) & ~d.rlike(r"^(.)\1{10}$") & right, F.lit(False))


def personal_data(text: Column, head: int = HEAD) -> dict[str, Column]:
    t = F.left(text, F.lit(head))
    return {
        "emails": F.regexp_count(t, F.lit(EMAIL)).cast("long"),
        "tax_numbers": F.size(F.filter(F.regexp_extract_all(t, F.lit(TAX_NUMBER), 0), valid_tax_number)).cast("long"),
        "phones": F.regexp_count(t, F.lit(PHONE)).cast("long"),
        "ip_addresses": F.regexp_count(t, F.lit(IP_ADDRESS)).cast("long"),
    }
