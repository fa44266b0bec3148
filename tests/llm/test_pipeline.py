"""The queries over the smallest tables, their SQL, and the pipeline's decisions."""

import os
from collections import Counter

import duckdb
import pytest

import __spark_entry__ as entry
import corpus_pipeline as pipeline
from corpusloom.llm import chat_format, decontamination, packing, quality_mil, quality_rules, sharding, simhash, suffix_dedup, token_counts, toxicity
from corpusloom.llm.queries import BPE, QUERIES
from corpusloom.llm.sql import ORACLE_SQL
from corpusloom.llm.tokens import public_path

from .conftest import PASSAGE, ROWS, prose
from .test_matching import removed

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test tables")


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_queries(spark, name):
    got = entry.queries()[name](spark, DATA)
    rows = [tuple(r) for r in got.collect()]
    con = duckdb.connect()
    for t in ("documents", "labels", "benchmark", "conversations"):
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    if name not in ORACLE_SQL:
        docs = con.execute("select doc_id from documents").fetchall()
        assert {r[got.columns.index("doc_id")] for r in rows} == {d[0] for d in docs}
        return
    want = con.execute(ORACLE_SQL[name])
    names = [c[0] for c in want.description]
    assert Counter(rows) == Counter(tuple(r[names.index(c)] for c in got.columns) for r in want.fetchall())


def test_operators_take_clashing_names(spark, wide, corpus):
    labels = corpus[1].selectExpr("doc_id", "quality", "toxic", "1 as QUALITY", "'x' as text", "0 as label")
    items = spark.createDataFrame([("a", PASSAGE, 1, "x")], "item_id string, text string, doc_id int, Text string")
    out = [
        quality_rules.quality_rules(wide, labels), packing.pack(wide, public_path(BPE)), decontamination.decontaminate(wide, items),
        token_counts.token_counts(wide, public_path(BPE)), simhash.near_duplicates(wide), suffix_dedup.remove_repeats(wide), sharding.shard(wide),
        quality_mil.score(wide, quality_mil.train(wide, labels)), toxicity.score(wide, toxicity.train(wide, labels)),
    ]
    assert all({r[0] for r in x.select(x.columns[x.columns.index("doc_id")]).collect()} == {i for i, _ in ROWS} for x in out)
    turns = spark.createDataFrame([(1, 0, "user", "hi", "x", 2)], "conv_id long, turn long, role string, text string, Role string, TURN int")
    assert chat_format.digests(chat_format.format_turns(turns)).count() == 1


def test_stages_and_names(spark):
    assert [n for n, _ in pipeline.STAGES][0] == "toxicity" and len(pipeline.STAGES) == 5
    assert {"pipeline", *QUERIES} <= set(entry.queries()) and len(QUERIES) == 10
    out = entry.queries()["pipeline"](spark, DATA)
    assert "sequence_id" in out.columns and out.count() > 0


def test_decisions(spark, documents):
    clean = prose(321, 100)
    benchmark = spark.read.parquet(f"{DATA}/benchmark.parquet").first().text
    rows = [(1, clean), (2, clean), (3, clean), (3, clean), (4, prose(11, 50) + " " + benchmark + " " + prose(12, 50)), (5, prose(13, 60) + " " + PASSAGE), (6, prose(14, 60) + " " + PASSAGE), (None, prose(15, 40)), (7, None), (8, "")]
    rows += [(2, prose(16, 80)), (2, prose(17, 80)), (None, clean), (None, prose(18, 30)), (None, prose(18, 30))]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], documents.select("doc_id", "text", "lang", "source", "n_chars").schema)
    for _, stage in pipeline.STAGES[:-1]:
        assert stage(spark, docs.where("false"), DATA).columns == docs.columns
    left = pipeline.simhash_stage(spark, docs, DATA)
    assert left.columns == docs.columns
    want = [(1, clean), (4, rows[4][1]), (5, rows[5][1]), (6, rows[6][1]), (None, prose(15, 40)), (7, None), (2, prose(16, 80)), (2, prose(17, 80)), (None, prose(18, 30))]
    assert Counter((r.doc_id, r.text) for r in left.collect()) == Counter(want)
    cut = {r.doc_id: r.text for r in pipeline.suffix_stage(spark, left, DATA).collect()}
    assert len(PASSAGE) > 400 and all(PASSAGE not in (t or "") for t in cut.values()) and cut[1] == clean
    assert Counter(r.doc_id for r in pipeline.decontamination_stage(spark, left, DATA).collect()) == Counter([1, 2, 2, 5, 6, 7, None, None])
    marked = spark.createDataFrame([(None, benchmark, "en", "s", 9), (9, benchmark, "en", "s", 9), (9, clean, "en", "s", 9)], docs.schema)
    assert [(r.doc_id, r.text) for r in pipeline.decontamination_stage(spark, marked, DATA).collect()] == [(9, clean)]


def test_passages_of_over_fifty_words_go(spark, documents):
    """The suffix stage against every 256-byte window, with passages on both sides of the limits."""
    short, few, long = "ab cd " * 60, prose(600, 49), prose(601, 52)
    texts = [f"{prose(610 + i, 70)} {p} {prose(640 + i, 70)}" for i, p in enumerate([short, few, few, long, long, long + "x"])] + [few, "", None, "é" * 300, prose(650, 10) + "é" * 300]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], documents.select("doc_id", "text", "lang", "source", "n_chars").schema)
    want = [x[4] for x in removed([(t or "").encode() for t in texts], 256, 51)]
    assert 256 < len(few.encode()) and 256 < len(long.encode()) and want[3] != texts[3] and want[1] == texts[1]
    assert {r.doc_id: (r.text, r.n_chars) for r in pipeline.suffix_stage(spark, docs, DATA).collect()} == {i: (t, len(t)) for i, t in enumerate(want)}


def test_stages_take_extra_columns_with_clashing_names(spark, documents):
    wide = documents.selectExpr("doc_id", "text", "lang", "source", "n_chars", "n_words", "'x' as TEXT", "1 as Doc_Id", "'k' as row_key", "'h' as text_key", "0 as f", "'z' as z", "1.5 as score", "0 as first")
    for _, stage in pipeline.STAGES:
        assert stage(spark, wide, DATA).count() > 0
