"""Decontamination, SimHash, suffix arrays and classifiers against brute force and held-out labels."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash

from corpusloom.llm import decontamination, quality_mil, simhash, suffix_dedup, toxicity
from corpusloom.llm.labelled import held_out

from .conftest import PASSAGE, ROWS, prose

ITEMS = [("a", " ".join(PASSAGE.split()[20:45])), ("b", "One"), ("b2", "un, DOS"), ("c", None), ("d", "..."), ("e", prose(77, 30)), ("a", " ".join(PASSAGE.split()[20:45])), ("f", " ".join(prose(9, 6000).split()[5000:5011])), (None, " ".join(prose(9, 6000).split()[300:312])), (None, " ".join(PASSAGE.split()[40:60])), (None, None)]


def words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return "".join(c if ord(c) >= 128 or c.isascii() and c.isalnum() else " " for c in low).split(" ")


def hits(text):
    ws = [w for w in words(text) if w]
    hit, items = set(), set()
    for name, item in ITEMS:
        own = [w for w in words(item) if w]
        for i in range(max(1, len(own) - 9) if own else 0):
            win = own[i : i + 10]
            for at in range(len(ws) - len(win) + 1):
                if ws[at : at + len(win)] == win:
                    hit |= set(range(at, at + len(win)))
                    items |= {name} - {None}
    return len(ws), len(hit), len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest(), bool(hit)


def test_decontamination(spark, documents, nothing):
    items = spark.createDataFrame([(i, t, 1) for i, t in ITEMS], "item_id string, text string, doc_id int")
    rows = decontamination.digest(decontamination.decontaminate(documents, items)).collect()
    assert Counter(tuple(r) for r in rows) == Counter((i, *hits(t)) for i, t in ROWS)
    few = decontamination.digest(decontamination.decontaminate(documents, items, windows_per_pass=7)).collect()
    assert Counter(tuple(r) for r in few) == Counter(tuple(r) for r in rows)
    assert decontamination.decontaminate(nothing, items).count() == 0
    assert decontamination.decontaminate(documents, items.where("false")).where("n_hit > 0").count() == 0


def test_items_without_an_id_are_hit(spark):
    docs = spark.createDataFrame([(1, PASSAGE), (2, prose(3, 30))], "doc_id long, text string")
    rows = decontamination.decontaminate(docs, spark.createDataFrame([(None, PASSAGE)], "item_id string, text string")).collect()
    assert {r.doc_id: (r.n_hit, r.item_ids) for r in rows} == {1: (90, []), 2: (0, [])}


def test_phrases_and_proximity(spark, monkeypatch):
    """All phrases and sets against the words themselves, in many small segments and few places at a time."""
    draw = random.Random(6)
    texts = [" ".join(draw.choice("abcdefgh") for _ in range(draw.randint(0, 60))) for _ in range(40)] + ["a", "", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    items = [(f"i{k}", " ".join(draw.choice("abcdefghi") for _ in range(draw.randint(1, 4)))) for k in range(50)]
    monkeypatch.setattr(decontamination, "SEGMENT_TOKENS", 100)
    monkeypatch.setattr(decontamination, "PLACES", 7)
    index = decontamination.build_index(docs, 10)
    assert index.count() > 5
    windows = next(decontamination.window_passes(items))
    for r in decontamination.search(index, windows).collect():
        ws, hit, names = (texts[r.doc_id] or "").split(), set(), set()
        for name, item in items:
            own = item.split()
            for at in range(len(ws) - len(own) + 1):
                if ws[at : at + len(own)] == own:
                    hit |= set(range(at, at + len(own)))
                    names.add(name)
        assert {i for s in r.spans for i in range(s["start"], s["stop"])} == hit and r.n_hit == len(hit) and r.item_ids == sorted(names)
    sets = {"ab": {"a", "B"}, "abc": {"c", "b", "a"}, "x": {"x", "a"}, "none": set(), "g": {"g"}, "all": set("abcdefgh")}
    for distance in (0, 1, 3, 25):
        want = set()
        for k, terms in sets.items():
            terms = sorted(t.lower() for t in terms)
            for i, t in enumerate(texts):
                ws = (t or "").split()
                want |= {(k, i, at) for at, w in enumerate(ws) if terms and w == terms[0] and set(terms) <= set(ws[max(0, at - distance) : at + distance + 1])}
        assert {tuple(r) for r in decontamination.proximity(index, sets, distance).collect()} == want


def fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    ws = low.encode().split()
    runs = [b" ".join(ws[i : i + 3]) for i in range(len(ws) - 2)] if len(ws) >= 3 else [b" ".join(ws)] if ws else []
    hs = [xxhash.xxh64_intdigest(r, 42) for r in runs]
    return sum((2 * sum(h >> b & 1 for h in hs) > len(hs)) << b for b in range(64))


def reach(values):
    """The smallest index reachable from each, by brute force."""
    root = list(range(len(values)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(values)):
        for j in range(i):
            if (values[i] ^ values[j]).bit_count() <= 3:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(values))]


def test_near_duplicates(documents, nothing):
    rows = simhash.near_duplicates(documents).collect()
    prints = [fingerprint(t) for _, t in ROWS]
    roots = reach(prints)
    least = {}
    for (i, _), r in zip(ROWS, roots, strict=True):
        if i is not None:
            least[r] = min(i, least.get(r, i))
    assert Counter(tuple(r) for r in rows) == Counter((i, f"{p:016x}", least.get(r)) for (i, _), p, r in zip(ROWS, prints, roots, strict=True))
    assert simhash.near_duplicates(nothing).count() == 0


def test_all_links_are_found(spark):
    draw, found = random.Random(3), set()
    while len(found) < 250:
        b = draw.getrandbits(64)
        found.add(b)
        for _ in range(draw.randint(0, 6)):
            x = b
            for _ in range(draw.randint(1, 6)):
                x ^= 1 << draw.randrange(64)
            found.add(x)
            b = draw.choice([b, x])
    values = sorted(found)
    links = simhash.meetings(spark.createDataFrame([(simhash.signed(x),) for x in values], "f long"), len(values))
    pairs = links.collect()
    assert all(((r.a ^ r.b) % (1 << 64)).bit_count() <= 3 for r in pairs)
    got = {frozenset(v) for v in _groups((r.root, r.node) for r in simhash.components(links).collect())}
    want = {}
    for x, r in zip(values, reach(values), strict=True):
        want.setdefault(r, set()).add(simhash.signed(x))
    assert got == {frozenset(v) for v in want.values() if len(v) > 1}


def test_links_in_many_parts(spark, monkeypatch):
    """The same links however the variants are dealt."""
    draw, values = random.Random(5), set()
    for _ in range(60):
        b = draw.getrandbits(64)
        values |= {b, b ^ 1 << draw.randrange(64), b ^ 7 << draw.randrange(60)}
    values = sorted(values)
    prints = spark.createDataFrame([(simhash.signed(x),) for x in values], "f long")
    want = reach(values)
    for bits in (2, 11, 24):
        monkeypatch.setattr(simhash, "part_bits", lambda n, bits=bits: bits)
        roots = {r.node: r.root for r in simhash.components(simhash.meetings(prints, len(values))).collect()}
        got = [roots.get(s, s) for s in map(simhash.signed, values)]
        assert len(set(got)) == len(set(want)) == len(set(zip(got, want, strict=True)))


def test_rows_sent_for_a_fingerprint():
    for bits in (6, 7, 12, 20, 25):
        assert simhash.rows_per_print(bits) == (bits, 1 + bits * (bits - 1) // 2)


def _groups(pairs):
    out = {}
    for root, node in pairs:
        out.setdefault(root, {root}).add(node)
    return out.values()


def test_suffix_arrays_and_common_prefixes(monkeypatch):
    draw = random.Random(1)
    for _ in range(60):
        s = [draw.randint(1, draw.choice([2, 4, 20])) for _ in range(draw.randint(1, 40))]
        s = np.array((s * draw.choice([1, 1, 5])) + [0])
        want = sorted(range(len(s)), key=lambda i: s[i:].tolist())
        for bucket in (0, 1, 1 << 30):
            monkeypatch.setattr(suffix_dedup, "BUCKET", bucket)
            assert suffix_dedup.suffix_array(s, int(s.max()) + 1).tolist() == want
    for _ in range(30):
        d = bytes(draw.choice(b"ab") for _ in range(draw.randint(1, 50))) * draw.randint(1, 3)
        phi, common = suffix_dedup.permuted_common_prefixes(d, np.array(sorted(range(len(d)), key=lambda i: d[i:])))
        for i, p in enumerate(phi.tolist()):
            n = 0
            while p >= 0 and max(i, p) + n < len(d) and d[i + n] == d[p + n]:
                n += 1
            assert common[i] == n


def test_one_array_of_runs_and_prose(monkeypatch):
    data = prose(70, 4000).encode() + b"a" * 5000 + prose(70, 500).encode() + b"ab" * 3000 + b"a" * 700
    s = np.append(np.frombuffer(data, np.uint8).astype(np.int16), np.int16(0))
    order = suffix_dedup.suffix_array(s, 256)
    assert sorted(order.tolist()) == list(range(len(s))) and suffix_dedup.longest_run(s) >= 5000
    places = order[1:].tolist()
    assert all(data[a:] < data[b:] for a, b in zip(places, places[1:], strict=False))


def removed(rows, length=400, least_words=0):
    counts = Counter(b[i : i + length] for b in rows for i in range(len(b) - length + 1))
    for b in rows:
        mark = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if counts[b[i : i + length]] > 1:
                mark[i : i + length] = b"\1" * length
        for m in re.finditer(b"\1+", bytes(mark)) if least_words else ():
            if len(b[m.start() : m.end()].split()) < least_words:
                mark[m.start() : m.end()] = bytes(m.end() - m.start())
        kept = bytes(x for x, m in zip(b, mark, strict=True) if not m)
        yield len(b), sum(mark), sum(m and (i == 0 or not mark[i - 1]) for i, m in enumerate(mark)), hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "ignore")


@pytest.mark.parametrize(("group", "length", "least_words"), [(1 << 30, 400, 0), (1, 400, 0), (1 << 30, 256, 51), (1, 100, 20)])
def test_repeats_go(documents, nothing, monkeypatch, group, length, least_words):
    monkeypatch.setattr(suffix_dedup, "GROUP_BYTES", group)
    rows = suffix_dedup.remove_repeats(documents, length=length, least_words=least_words).collect()
    want = Counter((i, *x) for (i, _), x in zip(ROWS, removed([(t or "").encode() for _, t in ROWS], length, least_words), strict=True))
    assert Counter(tuple(r) for r in rows) == want and any(r.n_removed for r in rows)
    assert suffix_dedup.remove_repeats(nothing).count() == 0


def test_hashes_with_many_bytes_leave_the_arrays(spark, monkeypatch):
    """Long runs of one byte in different texts share a hash: none of them may meet in one array."""
    monkeypatch.setattr(suffix_dedup, "GROUP_BYTES", 20_000)
    seen = []
    monkeypatch.setattr(suffix_dedup, "window_spans", lambda hot, length, f=suffix_dedup.window_spans: seen.append(hot.count()) or f(hot, length))
    texts = [prose(i, 20) + "a" * (1200 + 7 * i) + prose(100 + i, 20) for i in range(30)]
    rows = suffix_dedup.remove_repeats(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert Counter(tuple(r) for r in rows) == Counter((i, *x) for i, x in enumerate(removed([t.encode() for t in texts]))) and seen[0] >= 30
    with pytest.raises(ValueError):
        suffix_dedup.remove_repeats(spark.createDataFrame([], "doc_id long, text string"), length=10)


def test_stretches_of_very_long_texts(monkeypatch):
    data = prose(50, 3000).encode()
    whole = suffix_dedup.segments(data)
    monkeypatch.setattr(suffix_dedup, "STRETCH", 1000)
    parts = suffix_dedup.segments(data)
    for values, starts, sizes, _ in (whole, parts):
        assert sizes.sum() == len(data) - 399 and (np.diff(starts) == sizes[:-1]).all()
    assert np.array_equal(np.repeat(whole[0], whole[2]), np.repeat(parts[0], parts[2]))


def test_toxicity(corpus, documents, nothing):
    docs, labels = corpus
    model = toxicity.train(docs, labels.union(labels))
    rows = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    held = [i for i in truth if held_out(i, 5, 0)]
    assert sum(rows[i].predicted == truth[i] for i in held) / len(held) > 0.9
    assert all(rows[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i in truth)
    odd = toxicity.score(documents, model, keep=("doc_id", "text", "lang", "source", "n_chars")).collect()
    assert len(odd) == len(ROWS) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in odd)
    assert Counter((r.doc_id, r.text) for r in odd) == Counter(ROWS)
    assert toxicity.score(nothing, model).count() == 0 and toxicity.score(documents, toxicity.train(docs, labels.where("false"))).count() == len(ROWS)


def gram_counts(text):
    """How often the distinct words of a text have each n-gram, by the letters themselves."""
    out = Counter()
    for w in set((text or "").lower().split()):
        w = f" {w} "
        out.update(w[i : i + n] for n in toxicity.SIZES for i in range(len(w) - n + 1))
    return out


def test_toxicity_ratios_gradient_and_score():
    texts = ["You IDIOT, you", "a kind word", "kind idiot", "", "wörds and words", "idiotic idiot"]
    labels = [1, 0, 1, 0, 0, 1]
    bucket = {}
    for g in {g for t in texts for g in gram_counts(t)}:
        n = len(g)
        h = ord(g[0])
        for c in g[1:]:
            h = (h * 0x01000193 % (1 << 32)) ^ ord(c)
        bucket[g] = (h * 0x9E3779B1 % (1 << 32)) >> 12
        assert n in toxicity.SIZES
    values = np.zeros((len(texts), toxicity.FEATURES))
    for k, t in enumerate(texts):
        for w in set(t.lower().split()):
            for g, n in gram_counts(w).items():
                values[k, bucket[g]] += n
    words = sorted({w for t in texts for w in toxicity.word_set(t)})
    of, found = toxicity.buckets(words)
    by = np.argsort(of, kind="stable")
    of, found = of[by], found[by]
    sample = toxicity.Sample([np.array(sorted(words.index(w) for w in toxicity.word_set(t)), np.int64) for t in texts], np.bincount(of), found)
    y = np.array(labels, float)
    some = np.arange(toxicity.FEATURES) % 7
    assert sample.used.tolist() == np.flatnonzero(values.any(0)).tolist()
    assert np.allclose(sample.of_buckets(y), (values.T @ y)[sample.used]) and np.allclose(sample.of_documents(some[sample.used]), values @ some)
    weights, bias = toxicity.fit(sample, labels, rounds=300)
    ratio = np.log((values.T @ y + 1) / (3 + 2)) - np.log((values.T @ (1 - y) + 1) / (3 + 2))
    used = np.flatnonzero(ratio)
    assert not weights[np.setdiff1d(np.arange(toxicity.FEATURES), used)].any() and np.count_nonzero(weights[used]) == len(used)
    z = values @ weights + bias
    own = toxicity.Scorer((weights, bias))
    assert np.allclose(own(texts), 1 / (1 + np.exp(-z))) and [int(p >= 0.5) for p in own(texts)] == labels
    # at the minimum the penalised gradient vanishes
    gradient = (values.T @ ((1 / (1 + np.exp(-z)) - y) / 6))[used] * ratio[used] + 0.03 * weights[used] / ratio[used]
    assert np.abs(gradient).max() < 0.01


def test_long_texts_have_the_same_words(monkeypatch):
    text = " Ab\tcd\n\n" + prose(3, 500).upper() + " x" * 40 + "y" * 90
    whole = toxicity.word_set(text)
    monkeypatch.setattr(toxicity, "STRETCH", 16)
    assert toxicity.word_set(text) == whole == set(text.lower().split()) and toxicity.word_set(None) == set()


def test_quality(corpus, documents, nothing):
    docs, labels = corpus
    model = quality_mil.train(docs, labels)
    rows = {r.doc_id: r for r in quality_mil.score(docs, model).collect()}
    truth = {r.doc_id: r.quality for r in labels.collect()}
    held = [i for i in truth if held_out(i, 4, 2)]
    assert sum(rows[i].predicted == truth[i] for i in held) / len(held) > 0.9
    odd = quality_mil.score(documents, model).collect()
    assert len(odd) == len(ROWS) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) and abs(sum(r.attention) - 1) < 1e-9 for r in odd)
    assert quality_mil.score(nothing, model).count() == 0
    one_class = quality_mil.train(docs, labels.where("quality = 1"))
    assert all(r.predicted == 1 for r in quality_mil.score(documents, one_class).collect())


def test_bag_is_gated_attention_over_all_passages():
    """A document's score from the formulas, one passage at a time."""
    model = quality_mil.Model(seed=3)
    x = np.random.default_rng(2).normal(size=(9, quality_mil.WIDTH))
    p, h, a = model.p, [], []
    for row in x:
        own = np.tanh([sum(row[i] * p["W"][i, j] for i in range(len(row))) + p["b"][j] for j in range(quality_mil.HIDDEN)])
        gates = [np.tanh(own @ p["V"][:, g]) / (1 + np.exp(-(own @ p["U"][:, g]))) for g in range(quality_mil.GATE)]
        h.append(own)
        a.append(np.exp(sum(g * w for g, w in zip(gates, p["w"], strict=True))))
    z = sum(e / sum(a) * own for e, own in zip(a, h, strict=True)) @ p["c"] + p["d"][0]
    assert model.bag([x])[0] == pytest.approx(1 / (1 + np.exp(-z)))


def test_blocks_of_a_long_text_are_its_passages(monkeypatch):
    """Where a text is longer than a block, its features are those of one block with the text's own length."""
    text = prose(88, 48 * 9 + 20)
    whole = np.concatenate(list(quality_mil.blocks_of(text)))
    monkeypatch.setattr(quality_mil, "BLOCK_WORDS", 48 * 3)
    parts = np.concatenate(list(quality_mil.blocks_of(text)))
    again = quality_mil.OF_WORD + 2  # windows that stand twice are looked for within a block
    assert len(whole) == 9 and len(parts) == 10
    others = [c for c in range(quality_mil.WIDTH) if c != again]
    assert np.allclose(whole[:8, others], parts[:8, others]) and set(parts[:, quality_mil.OF_WORD + 4]) == set(whole[:, quality_mil.OF_WORD + 4])


def test_attention_in_blocks_is_the_same():
    model = quality_mil.Model()
    x = np.random.default_rng(1).normal(size=(50, quality_mil.WIDTH))
    assert model.bag([x])[0] == pytest.approx(model.bag([x[:7], x[7:31], x[31:]])[0])
