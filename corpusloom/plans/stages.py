"""Whole stages as plans: acquisition, crawl filtering, near-duplicate removal, validation, characterization."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import clean, filters, lists, personal, text as tx
from ..operators import dedup, statistics
from ..operators.ngrams import with_top_ngrams
from ..session import cut


@dataclass
class Acquisition:
    """One source: how it is cleaned, accepted, scored and named."""

    source: str
    lang: str
    kind: str = "web"  # web, encyclopedia or legal
    variants: bool = False
    #: Columns in whose order ids are numbered without gaps; without them numbers are unique and rise within a task.
    order: list[str] = field(default_factory=list)

    def cleaned(self, text: Column) -> Column:
        return {"web": tx.strip, "encyclopedia": clean.clean_encyclopedia, "legal": clean.clean_legal}[self.kind](text)

    def accepts(self, text: Column) -> Column:
        return {"web": filters.passes_web, "encyclopedia": filters.passes_encyclopedia, "legal": filters.passes_legal}[self.kind](text)

    def variant_counts(self, raw: DataFrame) -> DataFrame:
        """Accepted documents by variant, before run() drops those of the other one."""
        df = raw.withColumn("text", self.cleaned(F.col("text"))).where(self.accepts(F.col("text")))
        return df.groupBy(filters.variant(F.col("text")).alias("variant")).agg(F.count("*").alias("n"))

    def run(self, raw: DataFrame) -> DataFrame:
        """Canonical documents from text, id and, if there is one, title. The score is of the text without its title."""
        df = raw.withColumn("text", self.cleaned(F.col("text"))).where(self.accepts(F.col("text")))
        lang = F.lit(self.lang)
        if self.variants:
            df = df.withColumn("variant", filters.variant(F.col("text"))).where("variant = 'BR'")
        df = df.withColumn("w", tx.words(F.col("text"))).withColumn("score", tx.quality_score(F.col("text"), F.col("w")).cast("float"))
        out = clean.titled(F.col("title"), F.col("text")) if "title" in raw.columns else F.col("text")
        df = statistics.numbered(df, *self.order) if self.order else df.withColumn("ordinal", F.monotonically_increasing_id())
        ordinal = F.col("ordinal")
        return df.select(out.alias("text"), F.lit(self.source).alias("source"), clean.row_id(F.col("id"), F.lit(self.source), ordinal).alias("id"), lang.alias("lang"), "score")


@dataclass
class CrawlFilter:
    """The chain of the crawl: language, word rules, repetition, lines, stop words; one stage, no shuffle.

    `strict` adds the repetition rules of paragraphs and of runs of 5 to 10 words, and the line rules of fineweb_lines.
    """

    lang: str | None = None
    stop_words: list[str] = field(default_factory=lambda: lists.SIGNAL_STOP_WORDS)
    least_stop_words: int = 2
    strict: bool = False

    def flags(self, df: DataFrame, *only: str) -> DataFrame:
        """df with a flag for each rule, or for those named. Counting runs of words takes a pass in Python, which only
        the repetition rules ask for."""
        wanted = set(only) or {"gopher_quality", "repetition", "c4", "stop_words", *["fineweb"] * self.strict}
        own = df.where("text is not null")
        if "repetition" in wanted:
            own = with_top_ngrams(own, repeated=tuple(filters.REPEATED_NGRAM_SHARES) if self.strict else ())
        stripped = lambda parts: F.array_sort(F.filter(F.transform(parts, tx.strip), lambda x: x != ""))
        own = own.withColumn("w", tx.words(F.col("text"))).withColumn("ls", stripped(tx.lines(F.col("text"))))
        n, out = F.greatest(F.length("text"), F.lit(1)), {}
        if "gopher_quality" in wanted:
            out["gopher_quality"] = reduce(and_, filters.gopher_quality(F.col("w"), F.col("text")).values())
        if "repetition" in wanted:
            calm = (tx.in_groups(F.col("ls")) / F.greatest(F.size("ls"), F.lit(1)) <= 0.3) & (tx.repeated_chars(F.col("ls")) / n <= 0.2)
            for k, most in filters.TOP_NGRAM_SHARES.items():
                calm = calm & (F.col(f"top_{k}gram_chars") / n <= most)
            if self.strict:
                own = own.withColumn("ps", stripped(F.split("text", "\n\n")))
                calm = calm & (tx.in_groups(F.col("ps")) / F.greatest(F.size("ps"), F.lit(1)) <= 0.3) & (tx.repeated_chars(F.col("ps")) / n <= 0.2)
                for k, most in filters.REPEATED_NGRAM_SHARES.items():
                    calm = calm & (F.col(f"dup_{k}gram_chars") / n <= most)
            out["repetition"] = calm
        if "c4" in wanted:
            out["c4"] = F.size(filters.c4_kept(F.col("text"))) > 0
        if "stop_words" in wanted:
            stops = F.array(*[F.lit(s) for s in self.stop_words])
            out["stop_words"] = F.size(F.filter("w", lambda x: F.array_contains(stops, F.lower(x)))) >= self.least_stop_words
        if "fineweb" in wanted:
            out["fineweb"] = filters.fineweb_lines(F.col("ls"), F.col("text"))
        return own.select(*df.columns, *[c.alias(name) for name, c in out.items()])

    def run(self, df: DataFrame) -> DataFrame:
        own = df.where(F.col("lang") == self.lang) if self.lang else df
        rules = ["gopher_quality", "repetition", "stop_words", *["fineweb"] * self.strict]
        passed = self.flags(own, *rules).where(" and ".join(rules))
        return passed.select(*df.columns, F.explode(filters.c4_kept(F.col("text"))).alias("_kept")).withColumn("text", F.col("_kept")).select(*df.columns)


@dataclass
class Deduplication:
    """Signatures, bands, the best of each bucket. `strict` keeps documents too short to be indexed."""

    key: str = "id"
    priority: list[str] = field(default_factory=lambda: lists.SOURCE_PRIORITY)
    strict: bool = False

    def run(self, docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
        """The documents kept, the keys removed, the report."""
        ranked = docs.withColumn("source_rank", dedup.source_rank(F.col("source"), self.priority))
        signed = dedup.signatures(ranked, self.key, "score", "source_rank")
        bands = cut(dedup.buckets(signed, self.key, "score", "source_rank"))  # signatures are made once
        gone = dedup.removed(bands, self.key, -F.col("score"), F.col("source_rank"))
        indexed = docs if self.strict else docs.join(bands.where("band = 0").select(self.key), self.key, "left_semi")
        return dedup.keep_best(indexed, self.key, gone), gone, dedup.report(bands, gone, docs, self.key)


def document_metrics(df: DataFrame, *keep: str, stop_words: list[str] | None = None) -> DataFrame:
    """The validation report's measurements of every document, from one array of words."""
    own = df.where("text is not null and text <> ''").withColumn("w", tx.words(F.col("text")))
    share = tx.share_of_list(F.col("w"), stop_words or lists.VALIDATION_STOP_WORDS, ".,!?;:()[]\"'")
    return own.select(
        *keep, F.length("text").cast("long").alias("n_chars"), F.greatest(F.size("w"), F.lit(1)).cast("long").alias("n_words"), F.size(F.array_distinct(F.transform("w", F.lower))).cast("long").alias("n_unique_words"),
        F.round(tx.alpha_ratio(F.col("text")), 4).alias("alpha_ratio"), F.round(tx.type_token_ratio(F.col("w")), 4).alias("ttr"), F.round(share, 4).alias("stopword_ratio"), tx.estimated_tokens(F.col("text")).alias("n_tokens"),
    )


def validation(df: DataFrame, target_tokens: float = 1e12) -> DataFrame:
    """Volume and shares by source with the grand total in one pass; the total's source is null."""
    own = df.where("text is not null and text <> ''").select(clean.base_source(F.col("source")).alias("source"), F.length("text").cast("long").alias("c"), tx.estimated_tokens(F.col("text")).alias("t"))
    agg = own.rollup("source").agg(F.count("*").alias("docs"), F.sum("t").alias("tokens"), F.sum("c").alias("chars"))
    total = F.max("tokens").over(Window.partitionBy())  # the rollup has a row per source
    return agg.withColumn("share", F.round(F.col("tokens") * 100.0 / total, 4)).withColumn("progress", F.round(F.col("tokens") * 100.0 / target_tokens, 8)).withColumn("avg_chars", F.round(F.col("chars") / F.col("docs"), 2))


def characterization(df: DataFrame) -> DataFrame:
    """One wide row of measurements per document: signals, personal data, lengths; later aggregates share this scan."""
    own = df.where("text is not null and text <> ''").withColumn("w", tx.words(F.col("text"))).withColumn("l", tx.lines(F.col("text")))
    data = personal.personal_data(F.col("text"))
    return own.select("*", F.octet_length("text").cast("long").alias("n_bytes"), F.size("w").cast("long").alias("n_words"), *[c.alias(k) for k, c in data.items()]).drop("w", "l")


def signals(df: DataFrame, key: str = "doc_id", stop_words: list[str] | None = None, least_chars: int = 50) -> DataFrame:
    """Ten signals of quality of every document of enough characters, within the row; top_ngrams() has the other three."""
    own = df.where(F.length("text") >= least_chars).select(key, "text", tx.words(F.col("text")).alias("w"), tx.lines(F.col("text")).alias("l"))
    own = own.withColumn("sl", F.array_sort(F.filter(F.transform("l", tx.strip), lambda x: x != ""))).withColumn("sp", F.array_sort(F.filter(F.transform(F.split("text", "\n\n"), tx.strip), lambda x: x != "")))
    n_word, n_line, n_char = F.greatest(F.size("w"), F.lit(1)), F.greatest(F.size("l"), F.lit(1)), F.length("text")
    symbols = F.length(F.regexp_replace("text", r"[\p{L}\p{N}]|(?U)\s", ""))
    r = lambda c, n: F.round(c, 4).alias(n)
    return own.select(
        key, r(tx.alpha_ratio(F.col("text")), "alpha_ratio"), r(F.aggregate("w", F.lit(0), lambda a, x: a + F.length(x)) / n_word, "mean_word_length"), r(symbols / n_word, "symbol_word_ratio"),
        r(F.size(F.filter("l", lambda x: x.rlike(r"[.!?;:]\s*$"))) / n_line, "frac_lines_end_punct"), r(F.size(F.filter("l", lambda x: ~x.rlike(r"\p{L}"))) / n_line, "frac_no_alpha_lines"),
        r(tx.in_groups(F.col("sl")) / n_line, "dup_line_frac"), r(tx.in_groups(F.col("sp")) / F.greatest(F.size("sp"), F.lit(1)), "dup_para_frac"),
        r(tx.repeated_chars(F.col("sl")) / n_char, "dup_line_char_frac"), r(tx.repeated_chars(F.col("sp")) / n_char, "dup_para_char_frac"),
        r(tx.share_of_list(F.col("w"), stop_words or lists.SIGNAL_STOP_WORDS), "stop_word_ratio"),
    )


def top_ngrams(df: DataFrame, key: str = "doc_id", least_chars: int = 50) -> DataFrame:
    """Shares of a document's characters in its most frequent run of two, three and four words."""
    own = with_top_ngrams(df.where(F.length("text") >= least_chars).select(key, "text"))
    return own.select(key, *[F.round(F.col(f"top_{n}gram_chars") / F.length("text"), 4).alias(f"top_{n}gram_char_frac") for n in (2, 3, 4)])


def sampled_quality(df: DataFrame, every: int = 100) -> DataFrame:
    """Nearest-rank percentiles of the measurements of each `every`-th document."""
    m = document_metrics(statistics.systematic_sample(df.where("text is not null and text <> ''"), every, "source", "doc_id"), "source", "doc_id")
    return m
