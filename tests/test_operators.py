"""Properties, goldens, plans, readers, writers and streams."""

import json
import math

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import contamination, dedup, evaluation, lexical, statistics
from corpusloom.plans import stages
from corpusloom.sources import readers, writers
from corpusloom.streaming import ingest

BASE = " ".join(f"word{i}" for i in range(40))
DOCS = [(1, BASE, "a_x", 0.5), (2, BASE, "b", 0.5), (3, BASE + " tail", "a", 0.9), (4, "four words only here", "a", 0.1), (5, " ".join(f"other{i}" for i in range(30)), "c", 0.2), (6, None, "c", 0.0), (7, "", "c", 0.0)]


@pytest.fixture()
def docs(spark):
    return spark.createDataFrame(DOCS, "id long, text string, source string, score double")


def test_best_of_each_bucket_stays(docs):
    kept, gone, report = stages.Deduplication(priority=["a", "b"]).run(docs)
    assert {r.id for r in gone.collect()} == {1, 2} and {r.id for r in kept.collect()} == {3, 5}
    strict, _, _ = stages.Deduplication(priority=["a", "b"], strict=True).run(docs)
    assert {r.id for r in strict.collect()} == {3, 4, 5, 6, 7}
    again, gone_again, _ = stages.Deduplication(priority=["a", "b"], strict=True).run(strict)
    assert gone_again.count() == 0 and again.count() == strict.count()
    r = report.first()
    assert (r.seen, r.indexed, r.removed) == (7, 4, 2)


def test_source_rank(spark):
    df = spark.createDataFrame([("wikipedia_ptbr",), ("gigaverbo",), ("hplt2_x",)], "s string")
    assert [r[0] for r in df.select(dedup.source_rank(F.col("s"))).collect()] == [99, 0, 5]


def test_clusters(spark):
    pairs = spark.createDataFrame([(i, i + 1) for i in range(20)] + [(100, 101)], "a long, b long")
    got = {r.a: r.cluster for r in dedup.clusters(pairs, "a", "b").collect()}
    assert got == {i: 0 for i in range(21)} | {100: 100, 101: 100}


def test_verified_pairs_connect_what_any_two_of_a_bucket_link(spark):
    import random

    random.seed(7)
    sets = {1: set(range(900, 940))} | {2 + i: set(range(3 * i, 3 * i + 40)) for i in range(24)}  # far best, drifting chain
    sets |= {30 + i: set(range(500, 540)) for i in range(6)} | {40 + i: {*range(600, 630), *random.sample(range(630, 660), 8)} for i in range(12)}  # equal sets, loose group
    buckets = {"a": sorted(sets), "b": [1, 2, 9, 30, 40, 45], "c": [1, 31, 41], "d": random.sample(sorted(sets), 15)}
    bucketed = spark.createDataFrame([(0, k, d, 1.0 / d) for k, ds in buckets.items() for d in ds], "band int, key string, doc_id long, score double")
    grams = spark.createDataFrame([(d, [str(g) for g in s]) for d, s in sets.items()], "doc_id long, grams array<string>")
    got = {(r.doc_id, r.best): r.jaccard for r in dedup.verified_pairs(bucketed, lambda keys: grams.join(keys, "doc_id", "left_semi"), "doc_id", 0.8, -F.col("score")).collect()}
    jaccard = lambda a, b: round(len(sets[a] & sets[b]) / len(sets[a] | sets[b]), 6)
    want = {(a, b) for ds in buckets.values() for a in ds for b in ds if a < b and jaccard(a, b) >= 0.8}

    def parts(pairs):
        label = {d: d for d in sets}
        for _ in sets:
            for a, b in pairs:
                label[a] = label[b] = min(label[a], label[b])
        return label

    assert {(min(p), max(p)) for p in got} <= want and all(v == jaccard(*p) for p, v in got.items())
    assert parts(got) == parts(want) and len(set(parts(want).values())) < len(sets)


def drifting_documents(spark, folder, loose=0):
    """Copies, chains of texts that drift apart, loose groups, and texts without a copy, as the table documents of the folder."""
    import random

    random.seed(11)
    texts = {}
    for c in range(12):
        ws = [f"w{c}x{i}" for i in range(120)]
        for k in range(14):
            texts[100 * c + k] = " ".join(ws) + (" and a tail" if k % 5 == 4 else "")
            ws[random.randrange(len(ws))] = f"new{c}x{k}"
    texts |= {5000 + i: texts[100 * (i % 3)].upper() for i in range(9)} | {6000 + i: " ".join(f"alone{i}x{j}" for j in range(30)) for i in range(5)}
    texts |= {7000: "four words are few", 7001: "four words are few", 7002: "", 7003: None, 7004: "only twice here it is", 7005: "only twice here it is"}
    for c in range(loose):
        for k, changes in enumerate((2, 2, 2, 1, 1)):  # only the last two are similar; the first, of equal score, are the best
            ws = [f"l{c}x{i}" for i in range(120)]
            for at in random.sample(range(10, 110), changes):
                ws[at] = f"other{c}x{k}"
            texts[10_000 + 5 * c + k] = " ".join(ws)
    rows = [(d, t, "en", "web", len(t or "")) for d, t in texts.items()]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    return texts


def rows_of_sql(folder, name):
    import duckdb

    from corpusloom.plans.queries import ORACLE_SQL

    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{folder}/documents.parquet/*.parquet'")
    found = con.execute(ORACLE_SQL[name])
    return sorted(sorted(zip([c[0] for c in found.description], r, strict=True)) for r in found.fetchall())


def test_clusters_of_drifting_documents_in_few_jobs(spark, tmp_path, monkeypatch):
    from corpusloom.plans.queries import QUERIES

    drifting_documents(spark, tmp_path)
    want = rows_of_sql(tmp_path, "verified_neardup_clusters")
    spark.sparkContext.setJobGroup("clusters", "clusters")
    got = QUERIES["verified_neardup_clusters"](spark, str(tmp_path)).collect()
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("clusters"))
    spark.sparkContext._jsc.clearJobGroup()
    assert sorted(sorted(r.asDict().items()) for r in got) == want and len(want) > 150
    assert jobs <= 75  # the driver keeps plans and code of all jobs; 63, and 89 with rounds of hubs for all
    monkeypatch.setattr(dedup, "CLASS_WORK", 2000)  # classes too large for a task
    again = QUERIES["verified_neardup_clusters"](spark, str(tmp_path)).collect()
    assert sorted(sorted(r.asDict().items()) for r in again) == want


def test_pairs_of_drifting_documents_as_in_sql(spark, tmp_path):
    from corpusloom.plans.queries import QUERIES

    drifting_documents(spark, tmp_path, loose=200)
    want = rows_of_sql(tmp_path, "verified_neardup_pairs")
    got = QUERIES["verified_neardup_pairs"](spark, str(tmp_path)).collect()
    assert sorted(sorted(r.asDict().items()) for r in got) == want and len(want) > 50


def test_joined_sets_against_all_pairs():
    import random

    import numpy as np

    random.seed(5)
    sets = [set(range(s, s + 30)) - {random.randrange(s, s + 30)} for s in (random.randrange(0, 90) for _ in range(80))]
    places = [random.sample(range(4), 2) for _ in sets]
    label = list(range(len(sets)))
    for _ in sets:
        for i, a in enumerate(sets):
            for j, b in enumerate(sets):
                if set(places[i]) & set(places[j]) and round(len(a & b) / len(a | b), 6) >= 0.8:
                    label[i] = label[j] = min(label[i], label[j])
    grams = [np.array(sorted(x)) for x in sets]
    assert dedup.joined_sets(grams, places, 0.8) == label and 1 < len(set(label)) < len(sets)


def test_signature_similarity():
    a, b = dedup.signature(BASE), dedup.signature(" ".join(f"q{i}" for i in range(40)))
    assert (a == a).mean() == 1 and (a == b).mean() < 0.1 and dedup.signature("one two three four") is None


def test_wide_signatures_match_their_definition():
    import hashlib

    runs = {" ".join(BASE.split()[i : i + 13]) for i in range(28)}
    want = [min(((int(hashlib.sha256(r.encode()).hexdigest(), 16) % 2**64 * (i + 1)) ^ (i * 2654435761)) % 2**64 for r in runs) for i in (0, 1, 127)]
    got = dedup.wide_signature(BASE)
    assert [int(got[i]) + 2**63 for i in (0, 1, 127)] == want


def test_goldens_of_the_paired_test():
    for b10, b01, p in ((212, 190, 0.2949), (227, 195, 0.1313), (173, 168, 0.8285), (231, 126, 0.0), (145, 199, 0.0043)):
        assert round(evaluation.mcnemar(b10, b01), 4) == p
    assert evaluation.mcnemar(0, 0) == 1.0


def test_bootstrap_interval(spark):
    df = spark.createDataFrame([(int(i % 4 == 0),) for i in range(400)], "v int")
    r = evaluation.bootstrap(df, "v").first()
    assert r.mean == 0.25 and r.low < 0.25 < r.high and 0.06 < r.high - r.low < 0.11
    pairs = spark.createDataFrame([("a", 1, 1), ("a", 1, 0), ("a", 0, 0), ("a", 1, 1)] * 30 + [("b", 1, 1)] * 5, "g string, x int, y int")
    got = {r.g: r for r in evaluation.paired_bootstrap(pairs, "x", "y", 500, groups=["g"]).collect()}
    assert got["a"].value == 0.25 and 0 < got["a"].low < 0.25 < got["a"].high < 0.5 and (got["b"].low, got["b"].value, got["b"].high) == (0, 0, 0)
    ratios = spark.createDataFrame([(float(i % 7), 2.0 + i % 3) for i in range(600)], "a double, b double").repartition(5)
    r = evaluation.ratio_bootstrap(ratios, "a", "b", rounds=400).first()
    assert r.n == 600 and r.value == pytest.approx(sum(i % 7 for i in range(600)) / sum(2 + i % 3 for i in range(600))) and r.low < r.value < r.high < r.low + 0.2


def test_p_values_are_those_of_erfc(spark):
    xs = [0.0, 1e-9, 0.01, 0.5, 1.0, 1.5, 2.2, 3.0, 4.0, 5.5, 6.4, 7.0, 40.0]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in xs], "x double").select(evaluation.erfc(F.col("x"))).collect()]
    assert got == pytest.approx([math.erfc(x) for x in xs], abs=1e-12)


def test_pairs_by_item_and_by_place(spark):
    a, b = spark.createDataFrame([(1, 1), (2, 0)], "k int, v int"), spark.createDataFrame([(2, 1), (3, 0)], "k int, v int")
    assert [tuple(r) for r in evaluation.paired(a, b, ["k"], "v").collect()] == [(2, 0, 1)]
    vectors = spark.createDataFrame([("m", [1, 0], [0, 0])], "m string, x array<int>, y array<int>")
    assert [tuple(r) for r in evaluation.by_position(vectors, "x", "y", "m").orderBy("at").collect()] == [("m", 0, 1, 0), ("m", 1, 0, 0)]
    with pytest.raises(Exception, match="different lengths"):
        evaluation.by_position(spark.createDataFrame([([1], [0, 0])], "x array<int>, y array<int>"), "x", "y").collect()


def test_windows_cover_all_targets(spark):
    for n in (0, 1, 1024, 2048, 2049, 5000):
        rows = spark.range(1).select(F.explode(evaluation.window_targets(F.lit(n), 2048, 1024)).alias("x")).select("x.*").collect()
        assert sum(r.targets for r in rows) == n and all(r.end - r.begin <= 2048 for r in rows)


def test_lexical_measures(spark):
    def mattr(ts, w):
        w = min(w, len(ts))
        rs = [len(set(ts[i : i + w])) / w for i in range(len(ts) - w + 1)]
        return sum(rs) / len(rs)

    import random

    random.seed(4)
    text = " ".join(random.choice("um dois tres quatro cinco seis sete oito nove dez".split()) for _ in range(150))
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert lexical.moving_ratio(df, 20).first().moving_ttr == pytest.approx(mattr(text.split(), 20), abs=1e-5)
    counts = [text.split().count(w) for w in set(text.split())]
    r = lexical.diversity(df).first()
    assert r.yule_k == pytest.approx(1e4 * (sum(c * c for c in counts) - 150) / 150**2, abs=1e-4)
    assert lexical.sequential(df).first().mtld == pytest.approx(lexical.sequential_diversity(text.split()), abs=1e-5)


def test_factors_against_all_slices():
    """A factor ends where the share of different words of its slice first falls to the threshold."""
    import random

    random.seed(9)
    for n, v in ((0, 5), (9, 3), (10, 1), (40, 6), (400, 50), (900, 400), (700, 5000)):
        words = [str(random.randrange(v)) for _ in range(n)]
        values = []
        for ws in (words, words[::-1]):
            begin, factors = 0, 0.0
            while end := next((k for k in range(begin + 1, n + 1) if len(set(ws[begin:k])) <= 0.72 * (k - begin)), None):
                begin, factors = end, factors + 1
            values.append(n / max(1.0, factors + (n - begin) / n) if n >= 10 else 0.0)
        assert lexical.sequential_diversity(words) == pytest.approx(sum(values) / 2)
        before = lexical.previous_places(words)
        assert lexical.factor_ends(before, 0.72, 7) == lexical.factor_ends(before, 0.72)


def test_samples(spark):
    df = spark.range(1000).withColumn("g", F.col("id") % 3)
    assert sorted(r.id for r in statistics.systematic_sample(df, 100, "id").collect()) == list(range(99, 1000, 100))
    got = statistics.proportional_sample(df, "g", 90, "id").groupBy("g").count().collect()
    assert {r["count"] for r in got} == {30}
    uneven = df.withColumn("g", F.when(F.col("id") < 3, "few").otherwise("many"))
    by = {g: sorted((r.h, r.id) for r in uneven.withColumn("h", statistics.seeded(F.col("id"), 42)).where(F.col("g") == g).collect()) for g in ("few", "many")}
    want = {i for _, i in by["few"][:1]} | {i for _, i in by["many"][:40]}
    assert {r.id for r in statistics.proportional_sample(uneven, "g", 40, "id").collect()} == want
    assert statistics.proportional_sample(df, "g", 1000, "id").count() == 1000
    some = sorted((r.h, r.id) for r in df.withColumn("h", statistics.seeded(F.col("id"), 1)).collect())[:7]
    assert [r.id for r in statistics.random_rows(df, 7, "id", 1).collect()] == [i for _, i in some]
    hashed = df.withColumn("h", F.md5(F.col("id").cast("string").cast("binary")))
    rows = sorted((r.g, r.h, r.id) for r in hashed.collect())
    want = [i for g in range(3) for n, (_, _, i) in enumerate(x for x in rows if x[0] == g) if n * 10 < 1235]
    assert sorted(r.id for r in statistics.budget_prefix(hashed, "g", F.lit(10), 1235, "h").collect()) == sorted(want)


def test_percentiles_by_rank(spark):
    df = spark.createDataFrame([("a", float(i)) for i in range(10)] + [("b", 1.0)], "g string, v double")
    got = {r.g: (r.p10, r.p50, r.p99) for r in statistics.ranked_percentiles(df, ["g"], "v", [10, 50, 99]).collect()}
    assert got == {"a": (1.0, 5.0, 9.0), "b": (1.0, 1.0, 1.0)}


def test_percentiles_between_ranks(spark):
    import numpy as np

    vs = [float(i * i % 101) for i in range(57)]
    df = spark.createDataFrame([("a", v) for v in vs] + [("b", 2.0)], "g string, v double")
    got = {r.g: r for r in statistics.linear_percentiles(df, ["g"], "v", [0.5, 0.95]).collect()}
    assert (got["a"].p50, got["a"].p95) == pytest.approx(tuple(np.percentile(vs, [50, 95])), abs=1e-4) and got["b"].p95 == 2.0


def test_surrogate_against_the_counts(spark):
    from collections import Counter

    from corpusloom.operators import scorers

    texts = ["a b a c a b", "a b b z", "q", "the the x y"]
    train, pairs, firsts = texts[:1] + texts[3:], Counter(), Counter()
    for t in train:
        ws = t.split()
        pairs.update(zip(ws, ws[1:], strict=False))
        firsts.update(ws[:-1])
    v = len({b for _, b in pairs})
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    model = scorers.train_bigrams(docs.where("doc_id in (0, 3)"))
    for r in scorers.perplexity(docs, model).collect():
        ws = texts[r.doc_id].split()
        logs = [math.log((pairs[p] + 1) / (firsts[p[0]] + v)) for p in zip(ws, ws[1:], strict=False)]
        assert r.perplexity == pytest.approx(math.exp(-sum(logs) / len(logs)), abs=1e-4)


def test_checkpoint_folder_is_shared_on_a_cluster(spark, monkeypatch):
    from types import SimpleNamespace

    from corpusloom import session

    none = SimpleNamespace(isDefined=lambda: False)
    there = []
    sc = SimpleNamespace(master="spark://x:7077", setCheckpointDir=there.append, _jsc=SimpleNamespace(sc=lambda: SimpleNamespace(getCheckpointDir=lambda: none)))
    fake = SimpleNamespace(sparkContext=sc, conf=SimpleNamespace(get=lambda k, d: d))
    for master in ("spark://x:7077", "yarn", "local-cluster[3,2,1000]"):
        sc.master = master
        with pytest.raises(ValueError):
            session.ensure_checkpoint_dir(fake)
    sc.master = "local[4]"
    assert session.ensure_checkpoint_dir(fake) == there[0]


def test_facts_of_sources(spark):
    from corpusloom.functions.lists import SOURCE_FACTS

    df = spark.createDataFrame([("hplt2", 1), ("other", 2)], "source string, docs int")
    got = {r.source: (r.license, r.domain) for r in statistics.described(df, "source", SOURCE_FACTS).collect()}
    assert got == {"hplt2": ("CC0", "geral/web"), "other": ("—", "—")}


def test_funnel_adds_up(spark):
    r = statistics.funnel(spark.range(100), ("odd", F.col("id") % 2 == 0), ("big", F.col("id") < 50)).first()
    assert (r.seen, r.skip_odd, r.skip_big, r.kept) == (100, 50, 25, 25)


def test_benchmark_runs_are_broadcast(spark):
    d = spark.createDataFrame([(1, BASE), (2, "short"), (3, "x " + BASE.upper())], "doc_id long, text string")
    b = spark.createDataFrame([(7, " ".join(BASE.split()[5:20]))], "item_id long, text string")
    found = contamination.hits(d, b)
    assert {(r.doc_id, r.item_id, r.shared) for r in found.collect()} == {(1, 7, 3), (3, 7, 3)}
    assert "BroadcastHashJoin" in found._jdf.queryExecution().toString()


def test_no_python_in_native_plans(spark, docs):
    plan = stages.signals(docs.withColumnRenamed("id", "doc_id"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


def test_crawl_chain_is_one_stage(spark):
    good = "The quick brown fox jumps over the lazy dog and runs to the river. " * 1
    text = "\n".join(f"{good}This is sentence number {i} of the story that we tell." for i in range(8))
    df = spark.createDataFrame([(1, text, "en"), (2, "too short", "en"), (3, "same line here.\n" * 60, "en")], "doc_id long, text string, lang string")
    out = stages.CrawlFilter("en", stop_words=["the", "of", "and"]).run(df)
    assert [r.doc_id for r in out.collect()] == [1]
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
    plan = stages.CrawlFilter().flags(df, "gopher_quality", "stop_words")._jdf.queryExecution().executedPlan().toString()
    assert "Arrow" not in plan and "Python" not in plan


def test_strict_repetition_matches_brute_force(spark):
    import random
    from collections import Counter

    random.seed(3)
    prose = lambda n: " ".join(f"w{random.randrange(5000)}" for _ in range(n))
    loop, para = prose(30), prose(20)
    texts = [prose(300), "\n".join(f"{loop} {prose(20)}" for _ in range(6)), "\n\n".join([para, prose(60), para, prose(60), para, "x\ny"]), "\n\n".join([prose(40)] * 2 + [prose(400)]), "", " "]
    texts += [" ".join([prose(100), *(loop[: 60 + 9 * k], prose(15)) * 3]) for k in range(10)]

    def chars(ws, n):
        seen, total, free = set(), 0, 0
        for i in range(len(ws) - n + 1):
            if i >= free and tuple(ws[i : i + n]) in seen:
                total, free = total + len("".join(ws[i : i + n])), i + n
            elif i >= free:
                seen.add(tuple(ws[i : i + n]))
        return total

    def calm(t):
        ws, size = t.split(), max(1, len(t))
        for own in ([x.strip() for x in t.split("\n") if x.strip()], [x.strip() for x in t.split("\n\n") if x.strip()]):
            c = Counter(own)
            if sum(k for k in c.values() if k > 1) > 0.3 * max(1, len(own)) or sum(len(x) * (k - 1) for x, k in c.items()) > 0.2 * size:
                return False
        for n, most in ((2, 0.2), (3, 0.18), (4, 0.16)):
            c = Counter(tuple(ws[i : i + n]) for i in range(len(ws) - n + 1)).most_common(1)
            if c and c[0][1] * len("".join(c[0][0])) > most * size:
                return False
        return all(chars(ws, n) <= most * size for n, most in ((5, 0.15), (6, 0.14), (7, 0.13), (8, 0.12), (9, 0.11), (10, 0.10)))

    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.repetition for r in stages.CrawlFilter(strict=True).flags(df).collect()}
    assert got == {i: calm(t) for i, t in enumerate(texts)} and got[0] and not got[1] and not got[2]
    assert {r.doc_id: r.repetition for r in stages.CrawlFilter().flags(df).collect()}[1]  # the default has no rule for it


def test_acquisition(spark):
    raw = spark.createDataFrame([(None, "A" * 60, ""), ("7", "é" * 99 + " ok. ok! ok?", "T")], "id string, text string, title string")
    rows = stages.Acquisition("wiki", "por", "encyclopedia").run(raw).collect()
    assert len(rows) == 1 and rows[0].text.startswith("T\n\n") and rows[0].id == "7" and rows[0].source == "wiki"


def test_shards_round_trip(spark, docs, tmp_path):
    out = str(tmp_path / "raw" / "src")
    full = docs.where("text is not null").select("text", "source", "id", F.lit("pt").alias("lang"), "score")
    writers.write_shards(full, out, rows=2)
    back = readers.shards(spark, {"src": out})
    assert back.count() == 5 and dict(back.dtypes)["score"] == "float"
    (tmp_path / "raw" / "src" / "bad.parquet").write_bytes(b"not parquet")
    assert readers.shards(spark, {"src": out}).count() == 5
    meta = writers.shard_metadata(spark, out)
    assert meta.where(F.length("sha256_head") == 64).count() == meta.count() > 1
    report = readers.shard_report(spark, out, ["text", "source"])
    assert report.agg(F.sum("rows")).first()[0] == 6 and report.where("not schema_ok").count() == 0
    files = readers.listing(spark, out, [".parquet"]).select(F.col("path").alias("file"))
    assert readers.integrity(files, report.withColumn("file", F.regexp_replace("file", "^file:/+", "file:/"))).first().unreadable == 1
    writers.write_manifest(spark, str(tmp_path / "manifest.json"), {"src": {"docs": 5}})
    assert json.loads((tmp_path / "manifest.json").read_text())["src"]["docs"] == 5
    writers.write_manifest(spark, str(tmp_path / "manifest.json"), {"src": {"docs": 6}})
    assert json.loads((tmp_path / "manifest.json").read_text())["src"]["docs"] == 6 and not (tmp_path / "manifest.json.tmp").exists()
    counts = docs.groupBy("source").count().orderBy("source")
    assert writers.markdown_table(counts).count("\n") == 6
    with pytest.raises(ValueError):
        writers.markdown_table(docs, 3)
    writers.write_reports(spark, str(tmp_path / "report"), "Sources", {"counts": counts})
    assert json.loads((tmp_path / "report.json").read_text())["counts"][0] == {"source": "a", "count": 2}
    assert "| a_x | 1 |" in (tmp_path / "report.md").read_text() and "a_x     1\n" in (tmp_path / "report.txt").read_text()
    writers.write_distribution(spark, str(tmp_path / "sources.json"), counts, "source", "count")
    assert json.loads((tmp_path / "sources.json").read_text()) == {"total": 7, "counts": {"c": 3, "a": 2, "a_x": 1, "b": 1}}


def test_numbers_gates_and_exact_shards(spark, tmp_path):
    df = spark.range(250).selectExpr("cast(id as string) as text", "'s' as source", "250 - id as id", "'x' as lang", "0.5D as score").repartition(7)
    got = sorted((r.ordinal, r.id) for r in statistics.numbered(df, "id").collect())
    assert got == [(k, k + 1) for k in range(250)]
    writers.write_exact_shards(df, str(tmp_path / "e"), ["id"], 60)
    for k, n in enumerate([60, 60, 60, 60, 10]):
        files = list((tmp_path / "e" / f"shard={k}").glob("*.parquet"))
        rows = spark.read.parquet(str(files[0])).collect()
        assert len(files) == 1 and [int(r.id) for r in rows] == list(range(60 * k + 1, 60 * k + n + 1))
    lines = [r.value for r in writers.json_text(df, 2, ["id"]).collect()]
    assert lines[0] == '{"text":"24"}' and len(lines) == 250
    raw = spark.createDataFrame([(None, c * 60) for c in "cab"], "id string, text string")
    assert [r.id for r in stages.Acquisition("web", "en", order=["text"]).run(raw).orderBy("text").collect()] == ["web_0", "web_1", "web_2"]

    from corpusloom.operators import scorers

    def make():
        seen = {"um": ("pt", 0.7), "two": ("en", 0.9), "tr s": ("pt", 0.65), "low": ("pt", 0.6)}
        return lambda texts: [seen.get(t) for t in texts]

    texts = spark.createDataFrame([(t,) for t in ["um", "two", "tr\ns", "low", "", None, "else"]], "text string")
    assert {r.text for r in scorers.language_gate(texts, make, ["pt", "por_Latn"]).collect()} == {"um", "tr\ns"}


def test_order_and_number_of_shards(spark, tmp_path):
    import hashlib

    for k in range(4):
        for name in (f"shard_{k:06d}", f"part-{k}"):
            spark.range(10 * (k + 1)).selectExpr("cast(id as string) as text", "'x' as lang").coalesce(1).write.parquet(str(tmp_path / "w"), mode="overwrite")
            next((tmp_path / "w").glob("part-*.parquet")).rename(tmp_path / f"{name}.parquet")
    import shutil

    shutil.rmtree(tmp_path / "w")
    names = [f"shard_{k:06d}.parquet" for k in range(4)]
    base = lambda ps: [p.rsplit("/", 1)[1] for p in ps]
    assert base(readers.shard_files(spark, str(tmp_path))) == names and base(readers.shard_files(spark, str(tmp_path), 2)) == names[:2]
    assert base(readers.shard_files(spark, str(tmp_path), 3, 42)) == sorted(names, key=lambda n: hashlib.md5(f"{n}:42".encode()).hexdigest())[:3]
    got = readers.sampled_texts(spark, str(tmp_path), ["text", "date"], most=20)
    assert got.columns == ["text"] and got.count() == 2 + 4 + 6 + 8 and readers.sampled_texts(spark, str(tmp_path), ["text"]).count() == 100


def test_text_trees_and_lines(spark, tmp_path):
    (tmp_path / "gov").mkdir()
    (tmp_path / "gov/a.txt").write_bytes("ação".encode("latin-1"))
    (tmp_path / "gov/b.json").write_text(json.dumps({"conteudo": "lei"}))
    (tmp_path / "gov/c.json").write_text(json.dumps({"x": "a" * 30, "y": "short"}))
    (tmp_path / "gov/d.txt").write_bytes("﻿olá".encode())
    got = {r.path.rsplit("/", 1)[1]: r.text for r in readers.text_tree(spark, str(tmp_path / "gov")).collect()}
    assert got == {"a.txt": "ação", "b.json": "lei", "c.json": "a" * 30, "d.txt": "olá"}
    assert {r.extension: r.files for r in readers.extension_survey(readers.listing(spark, str(tmp_path / "gov"))).collect()} == {".txt": 2, ".json": 2}
    (tmp_path / "l").mkdir()
    import gzip

    (tmp_path / "l/x.jsonl").write_text('{"texto": "um"}\nbad\n\n{"corpo": "dois"}\n{"z": 1}\n')
    for d in ("a", "b c+d"):
        (tmp_path / "l" / d).mkdir()
        (tmp_path / "l" / d / "x.jsonl").write_text("".join(json.dumps({"text": f"{d} {k}"}) + "\n" for k in range(3000)))
    (tmp_path / "l/y.jsonl.gz").write_bytes(gzip.compress(b'{"text": "packed"}\n'))
    want = {("x.jsonl:0", "um"), ("x.jsonl:3", "dois"), ("y.jsonl.gz:0", "packed")} | {(f"{d}/x.jsonl:{k}", f"{d} {k}") for d in ("a", "b c+d") for k in range(3000)}
    for size in ("128m", "5k"):  # whole files, and many splits of each
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        rows = readers.json_lines(spark, str(tmp_path / "l")).collect()
        assert len(rows) == len(want) and {(r.id, r.text) for r in rows} == want
    spark.conf.set("spark.sql.files.maxPartitionBytes", "128m")


def test_binding_by_name(spark):
    df = readers.bind(spark.createDataFrame([("t", "u", 1)], "content string, url string, n int"))
    assert df.columns == ["text", "id", "n"] and tuple(df.first()) == ("t", "u", 1)


def test_evaluation_files(spark, tmp_path):
    d = tmp_path / "m1"
    d.mkdir()
    (d / "r.json").write_text(json.dumps({"results": {"lambada_pt": {"acc,none": 0.5, "alias": "x", "acc_norm,none": 0.6}}, "model_name": "", "config": {"model_args": "pretrained=org/small-1b1,dtype=x"}, "date": "1"}))
    (d / "bad.json").write_text("{")
    got = readers.preferred_metric(readers.evaluation_results(spark, str(tmp_path)), ["acc_norm", "acc"])
    got = readers.named_models(got, [("small-1b1", "Small"), ("small", "other")])
    assert [(r.name, r.task, r.value) for r in got.collect()] == [("Small", "lambada_pt", 60.0)]
    (d / "samples_arc_2026-01-01T.jsonl").write_text('{"doc_id": 1, "acc": 0}\n')
    (d / "samples_arc_2026-02-01T.jsonl").write_text('{"doc_id": 1, "acc,none": 0}\noops\n{"doc_id": 1, "acc,none": 1}\n{"doc_id": 2, "acc_norm": 1}\n')
    assert {(r.doc_id, r.correct) for r in readers.sample_lines(spark, str(tmp_path)).collect()} == {(1, 1), (2, 1)}


def test_training_log(spark):
    lines = [" iteration   10/ 20000 | learning rate: 1.0E-04 | lm loss: 3.5E+00 | grad norm: 2.5 | number of skipped iterations: 1 | number of nan iterations: 0 |", "noise", " iteration   20/ 20000 | learning rate: 1.0E-04 | lm loss: 2.0E+00 | grad norm: nan | number of skipped iterations: 0 | number of nan iterations: 1 |"]
    log = readers.training_log(spark.createDataFrame([(x,) for x in lines], "value string"))
    r = evaluation.training_summary(log).first()
    assert (r.logged, r.skipped, r.failed, r.max_grad, r.max_grad_at, r.last_loss) == (2, 1, 1, 2.5, 10, 2.0) and abs(r.perplexity - math.exp(2)) < 1e-3


def test_acquired_once(spark, tmp_path):
    src = str(tmp_path / "in")
    spark.createDataFrame([(1, "a " * 40 + "b" * 40), (2, "short")], "doc_id long, text string").write.parquet(src)

    def pull():
        ingest.acquire(spark, src, "doc_id long, text string", str(tmp_path / "out"), str(tmp_path / "cp"), "s", "pt").awaitTermination()
        return sorted(r.id for r in spark.read.parquet(str(tmp_path / "out")).collect())

    assert pull() == ["1"] and pull() == ["1"]
    spark.createDataFrame([(3, "c " * 60 + "d" * 40)], "doc_id long, text string").write.mode("append").parquet(src)
    assert pull() == ["1", "3"]


def test_streamed_windows(spark, tmp_path):
    src = str(tmp_path / "ev")
    spark.sql("select timestamp'2026-01-01 00:00:00' + make_interval(0,0,0,0,0,id) as ts, 'k' as event_type, 1.5D as value from range(180)").write.parquet(src)
    stream = spark.readStream.schema("ts timestamp, event_type string, value double").parquet(src)
    q = ingest.windowed_counts(stream, "ts", "1 hour", "10 minutes", "event_type").writeStream.format("memory").queryName("win").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted((r.n, r.total) for r in spark.table("win").collect()) == [(60, 90.0)] * 3
    texts = spark.readStream.schema("ts timestamp, event_type string").parquet(src).withColumnRenamed("event_type", "text")
    q = ingest.first_texts(texts, "ts").writeStream.format("memory").queryName("first").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("first").count() == 1
