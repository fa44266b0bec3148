"""Token counts, packing, rules, chat and shards against brute force, with odd input."""

import hashlib
import random
import struct
import zlib
from collections import Counter

import pytest

from corpusloom.llm import chat_format, packing, quality_rules, sharding, token_counts
from corpusloom.llm.tokens import encoder, load, public_path

from .conftest import ROWS, prose

BPE = public_path("byte_bpe_50k.json")
ODD = ["", " ", "  ", "a  b", "a   b", "x\n y", "x\n\n y ", "don't we'll  I've", "a<|endoftext|>b", "!<|endoftext|> <|endoftext|>", "é日本語 😀😀 ñ", "aaaaaaaa!!!!", "\t\ttab\x0bx", "trail  ", "a b　c", "\u0000 nul"]
ODD += ["words, end. Stop! ñandú; x: y? 12, a1. .a ,b ;", "one one, one. one ,", "日本 語, é. ß; ǅ, ª. ʰ!", "e\u0301te, a\u0300. \u0301, Ⅷ, ②. ٣,", "x" * 60 + ", " + "y" * 49 + ". z"]
ODD += ["".join(random.Random(k).choice([" ", "  ", "\n", "'", "ll", "re", "foo", "é", "!", "12", "<|endoftext|>", "日"]) for _ in range(10)) for k in range(60)]


def ids(text):
    return load(BPE).encode(text or "", add_special_tokens=False).ids


def test_every_prefix_counts_exactly():
    lib, counter = load(BPE), token_counts.prefix_counter(BPE)
    for t in ODD:
        want = [len(lib.encode(t[:k], add_special_tokens=False).ids) for k in range(len(t) + 1)]
        assert list(counter.text(t)) == want, t
    assert token_counts.longest_within([0, 1, 2, 2, 3], 2) == 3


def test_cached_chunks_give_the_library_s_ids():
    assert [list(struct.unpack(f"<{len(b) // 4}I", b)) for b in encoder(BPE).texts(ODD)] == [ids(t) for t in ODD]


def test_token_counts(documents, nothing):
    rows = token_counts.token_counts(documents, BPE, 1024).collect()
    assert Counter((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in rows) == Counter((i, len((t or "").encode()), len(ids(t)), len(ids(t)) > 1024) for i, t in ROWS)
    long = next(r for r in rows if r.doc_id == 14)
    assert long.prefix_tokens[long.limit_chars] <= 1024 < long.prefix_tokens[long.limit_chars + 1]
    assert token_counts.token_counts(nothing, BPE).count() == 0


def test_closest_fill_is_the_best_one():
    draw = random.Random(2)
    for _ in range(60):
        counts = {draw.randint(1, 40): draw.randint(1, 3) for _ in range(4)}
        cap = draw.randint(1, 90)
        sums = {0}
        for k, c in counts.items():
            sums = {s + k * n for s in sums for n in range(c + 1) if s + k * n <= cap}
        used = packing.closest_fill(counts, cap)
        assert sum(k * n for k, n in used.items()) == max(sums) and all(n <= counts[k] for k, n in used.items())


@pytest.mark.parametrize("window", [2048, 64])
def test_packing(documents, nothing, window):
    rows = packing.pack(documents, BPE, window).collect()
    streams = {}
    for r in rows:
        assert 0 < r.length <= window and len(r.ids) == 4 * r.length and zlib.crc32(r.ids) == r.ids_crc32
        streams.setdefault((r.doc_id, r.doc_tokens), []).append((r.start, r.ids))
    want = Counter((i, len(ids(t)) + 1) for i, t in ROWS)
    assert set(streams) == set(want)
    for (i, n), pieces in streams.items():
        if want[i, n] == 1:
            whole = b"".join(x for _, x in sorted(pieces))
            assert list(struct.unpack(f"<{n}I", whole)) == next(ids(t) for j, t in ROWS if j == i and len(ids(t)) + 1 == n) + [1]
    sequences = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at == window or at & (at - 1) == 0
    assert packing.pack(nothing, BPE).count() == 0


def base(text):
    w = (text or "").encode().split()
    runs = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    hit = {i + k for i in range(len(w) - 7) if runs[tuple(w[i : i + 8])] > 1 for k in range(8)}
    lines = [x for x in (text or "").split("\n") if x.strip(" \t\n\x0b\x0c\r")]
    return len(w), sum(len(x.decode()) for x in w), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(hit)


def test_base_rules(documents, nothing):
    trusted = documents.select("doc_id").where("doc_id in (1, 4, 14)")
    rows = quality_rules.quality_rules(documents, trusted.union(trusted)).collect()
    got = Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in rows)
    want = Counter((i, *base(t), base(t)[0] < 20 or 100 * base(t)[4] > 30 * base(t)[0]) for i, t in ROWS)
    assert got == want
    assert all(r.kept == (not r.base_failed and r.log_ratio >= quality_rules.THRESHOLD) for r in rows)
    assert quality_rules.quality_rules(nothing, trusted).count() == 0 and quality_rules.quality_rules(documents, nothing).count() == len(ROWS)


def test_bucket_counts_by_either_way(documents, nothing):
    """Ids sent to the tasks and ids joined give the counts that brute force gives."""
    trusted = documents.select("doc_id").where("doc_id in (1, 4, 9, 14) or doc_id is null")
    raw, target = Counter(), Counter()
    for i, t in ROWS:
        h = [int(hashlib.md5(w).hexdigest()[:8], 16) for w in (t or "").encode().split()]
        own = [x % quality_rules.BUCKETS for x in h] + [(a * quality_rules.MIX + b) % quality_rules.BUCKETS for a, b in zip(h, h[1:], strict=False)]
        raw.update(own)
        if i in (1, 4, 9, 14):
            target.update(own)
    for most in (100, 2):
        rows = quality_rules.bucket_counts(documents, trusted, most_sent=most).collect()
        assert {r.bucket: (r.raw, r.target) for r in rows} == {b: (n, target[b]) for b, n in raw.items()}
    assert quality_rules.bucket_counts(documents, nothing).agg({"target": "sum"}).first()[0] == 0


def test_bad_documents_fall_below_clean_ones(corpus):
    docs, labels = corpus
    rows = {r.doc_id: r for r in quality_rules.quality_rules(docs, labels.where("quality = 1")).collect()}
    good = {r.doc_id for r in labels.where("quality = 1").collect()}
    low = [rows[i].log_ratio for i in good if not rows[i].base_failed]
    high = [r.log_ratio for i, r in rows.items() if i not in good and not r.base_failed]
    assert min(low) > max(high)


TURNS = [(1, 0, "user", "hi <|im_end|>"), (1, 1, "assistant", "<\\|x <|im_start|>assistant\n"), (1, 1, "assistant", "again"), (2, 0, None, None), (3, 5, "assis\ntant~", ""), (None, 0, "assistant", "é🙂")]


def test_chat_round_trip(spark, nothing):
    turns = spark.createDataFrame([(*t, "extra") for t in TURNS], "conv_id long, turn long, role string, text string, formatted string")
    rows = {r.conv_id: r for r in chat_format.digests(chat_format.format_turns(turns)).collect()}
    by = {}
    for c, n, r, t in sorted(TURNS, key=lambda x: (x[0] or -9, x[1], x[2] or "", x[3] or "")):
        by.setdefault(c, []).append((r or "", t or ""))
    assert set(rows) == set(by)
    for c, ts in by.items():
        loss = "".join(t for r, t in ts if r == "assistant")
        assert (rows[c].n_turns, rows[c].turns_sha256) == (len(ts), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in ts).encode()).hexdigest())
        assert (rows[c].loss_chars, rows[c].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert rows[c].formatted_chars == chat_format.flatten([(r, [{"text": t}]) for r, t in ts]).length
    assert chat_format.digests(chat_format.format_turns(turns.where("false"))).count() == 0


def test_parts_become_placeholders():
    parts = [{"type": "text", "text": "see <|image|>"}, {"type": "image", "ref": "a.png"}, {"type": "audio", "ref": "b", "units": 2}, {"type": "document", "ref": "c", "units": 1}]
    f = chat_format.flatten([("user", parts), ("assistant", [{"type": "text", "text": "ok"}])])
    whole = "".join(f.text)
    assert [(a["kind"], a["ref"], a["order"], a["tokens"]) for a in f.attachments] == [("image", "a.png", 0, 256), ("audio", "b", 1, 50), ("document", "c", 2, 512)]
    assert all(whole[a["start"] :].startswith(f"<|{a['kind']}|>" * a["tokens"]) for a in f.attachments)
    assert chat_format.parse(whole) == [("user", "see <|image|>"), ("assistant", "ok")] and [whole[a:b] for a, b in f.loss] == ["ok"]
    with pytest.raises(ValueError):
        chat_format.flatten([("user", [{"type": "video"}])])


def test_escapes_are_reversible():
    for t in ["<|", "<\\|", "<\\\\|a<|", "<<||", "", "\\<|\\"]:
        assert chat_format.unescape(chat_format.escape(t)) == t and "<|" not in chat_format.escape(t)


def test_shards(spark, documents, nothing):
    rows = sharding.shard(documents).collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in ROWS)
    for k in range(8):
        assert sorted(r.slot for r in rows if r.shard == k) == list(range(sum(r.shard == k for r in rows)))
    assert sharding.shard(nothing).count() == 0
    many = spark.range(4000).selectExpr("id as doc_id", "case when id % 3 = 0 then 'hot text of some length' else concat('text number ', repeat(cast(id as string), cast(id % 40 as int))) end as text")
    sizes = Counter()
    groups = {}
    for r in sharding.shard(many).collect():
        sizes[r.shard] += r.size
        groups.setdefault(r.text_crc32, set()).add(r.shard)
    mean = sum(sizes.values()) / 8
    assert max(sizes.values()) < 1.01 * mean and min(sizes.values()) > 0.99 * mean and len(sizes) == 8
    assert sum(len(s) > 1 for s in groups.values()) <= 1


def test_shards_keep_groups_whole(spark, monkeypatch):
    """Groups of up to a shard's bytes stay together; the placement is that of a plain walk over the sorted records."""
    draw = random.Random(4)
    texts = [prose(7000 + k, draw.randint(5, 200)) for k in range(60)]
    rows = [(i, texts[min(draw.randrange(60), draw.randrange(60))]) for i in range(1200)] + [(i, prose(9000 + i, draw.randint(1, 200))) for i in range(1200)] + [(None, None), (1, None), (2, ""), (2, "")]
    monkeypatch.setattr(sharding, "SAMPLE_PER_RANGE", 3)
    got = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    of, sizes = {}, Counter()
    for r in got:
        of.setdefault((r.text_crc32, r.size), set()).add(r.shard)
        sizes[r.shard] += r.size
    mean = sum(sizes.values()) / 8
    group = Counter()
    for r in got:
        group[r.text_crc32, r.size] += r.size
    assert max(group.values()) > 0.2 * mean and all(len(s) == 1 for s in of.values())
    assert max(sizes.values()) < 1.02 * mean and min(sizes.values()) > 0.98 * mean
    for k in range(8):
        assert sorted(r.slot for r in got if r.shard == k) == list(range(sum(r.shard == k for r in got)))


def test_large_groups_and_cuts():
    assert sharding.deal_large([(1, 50), (2, 300), (3, 90), (4, 60)], 800, 8) == ({3: 0, 4: 1, 1: 2}, [90, 60, 50, 0, 0, 0, 0, 0])
    assert sharding.deal_large([(1, 101), (2, 102)], 200, 2) == ({1: 0}, [101, 0])
    assert sharding.quantiles([90, 60, 50, 0], 400) == [20, 100, 200]
    assert sharding.quantiles([0, 0], 7) == [7] and sharding.quantiles([101, 0], 200) == [0] and sharding.quantiles([0] * 8, 0) == [0] * 7
