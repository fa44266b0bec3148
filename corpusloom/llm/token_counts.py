"""Exact token counts at every prefix, by dynamic programming over byte-pair merges.

For each pre-token, position by position, the programme keeps the last token of the only valid encoding of the
prefix: a token t that ends at i follows the encoding of the prefix before it exactly when the pair of tokens is
itself a valid encoding, so count[i] = count[i - len(t)] + 1. Pre-tokens' counts are joined into one array for a
text, count[k] being the tokens of its first k code points. Truncation and budget questions are then look-ups.

Where a cut changes how the text before it is pre-tokenised, the counts follow: white space at the end of a prefix is
one piece, a contraction that is cut is an apostrophe and a letter, a special string that is cut is ordinary text.

Defined cases: a null text counts as empty (one prefix of 0 tokens); equal and repeated rows give a row each; an
empty table gives an empty result; a null doc_id is carried along; other columns are ignored.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache

from pyspark.sql import DataFrame

from ._shared import pick

SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean, limit_chars long, prefix_tokens array<int>"
#: Chunks, pieces and pairs of tokens kept in a worker.
CACHE_CHUNKS, CACHE_PIECES, CACHE_PAIRS = 600_000, 200_000, 400_000
#: Longer chunks and pieces are not kept.
KEPT_CHARS = 48
#: A space after other white space.
DOUBLE_SPACE = re.compile(r"\s ")
#: White space that a piece need not end with, and contractions that fall apart when cut (fixed values).
RUN, CUT_APART = r"\s\s+", ("'re", "'ve", "'ll")


class PrefixCounter:
    def __init__(self, path: str):
        import ahocorasick
        import regex

        from .tokens import PIECES, byte_letters, load

        self.lib = load(path)
        self.special = [t.content for t in self.lib.get_added_tokens_decoder().values()]
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        letters = {c: b for b, c in enumerate(byte_letters())}
        raw = lambda s: bytes(letters[c] for c in s)
        self.ids = {raw(k): v for k, v in model["vocab"].items() if all(c in letters for c in k)}
        self.tokens = ahocorasick.Automaton()
        for token, at in self.ids.items():
            self.tokens.add_word(token.decode("latin-1"), (at, len(token)))
        self.tokens.make_automaton()
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.rank = {}  # of the merge that makes a pair of tokens one
        self.made = {}  # token -> (left, right, rank of its merge)
        for at, (a, b) in enumerate(pairs):
            left, right, whole = self.ids[raw(a)], self.ids[raw(b)], self.ids[raw(a + b)]
            self.rank[left, right] = at
            self.made.setdefault(whole, (left, right, at))
        self.split = regex.compile(PIECES).findall
        self.runs = regex.compile(RUN).finditer
        self.valid: dict[int, bool] = {}
        self.pieces: dict[str, list[int]] = {}
        self.chunks: dict[str, bytes] = {}

    def pair(self, a: int, b: int) -> bool:
        """Whether two tokens stand side by side in an encoding: no merge across their border comes before theirs.

        Both tokens are taken apart again, the later merge first; a merge over the border that was possible before
        the parts were made would have come first.
        """
        bound = len(self.rank)
        while True:
            if self.rank.get((a, b), bound) < bound:
                return False
            left, right = self.made.get(a), self.made.get(b)
            if left is None and right is None:
                return True
            if right is None or left is not None and left[2] > right[2]:
                a, bound = left[1], left[2]
            elif left is None or right[2] > left[2]:
                b, bound = right[0], right[2] + 1
            else:  # the same token twice: of equal merges the left one is made first
                b, bound = right[0], right[2] + 1

    def piece(self, text: str) -> list[int]:
        """Token counts of the piece's prefixes of 1, 2, ... code points."""
        data = text.encode()
        n, valid = len(data), self.valid
        count, last = [0] * (n + 1), [0] * (n + 1)
        for end, (token, length) in self.tokens.iter(data.decode("latin-1")):  # of one end: longest first
            i = end + 1
            if count[i]:
                continue
            j = i - length
            if j:
                key = last[j] << 20 | token
                ok = valid.get(key)
                if ok is None:
                    ok = valid[key] = self.pair(last[j], token)
                if not ok:
                    continue
            last[i], count[i] = token, count[j] + 1
        return count[1:] if n == len(text) else [c for c, b in zip(count[1:], data[1:] + b"\0", strict=True) if b & 0xC0 != 0x80]

    def known(self, p: str) -> list[int]:
        """piece() of p, kept if it is short."""
        own = self.pieces.get(p)
        if own is None:
            own = self.piece(p)
            if p in CUT_APART:
                own[1] = 2
            if len(p) <= KEPT_CHARS:
                self.pieces[p] = own
        return own

    def plain(self, text: str) -> list[int]:
        """Counts of the prefixes of 1, 2, ... code points of a text without special strings."""
        counts, base = [], 0
        for p in self.split(text):
            own = self.known(p)
            counts += [base + c for c in own] if base else own
            base += own[-1]
        for run in self.runs(text):
            at = run.start()
            before = counts[at - 1] if at else 0
            counts[at : run.end()] = [before + c for c in self.piece(run[0])]
        return counts

    def chunk(self, text: str) -> bytes:
        """The counts as unsigned 32-bit integers."""
        import numpy as np

        return np.array(self.plain(text), "<u4").tobytes()

    def text(self, text: str):
        """An array with the token count of every prefix, from 0 code points to all of them.

        Texts without white space before a space are counted by chunks, a space and what follows up to the next one.
        """
        import numpy as np

        if any(s in text for s in self.special):
            return np.array(self.by_special(text), np.int64)
        if DOUBLE_SPACE.search(text):
            return np.array([0, *self.plain(text)], np.int64)
        first, *rest = text.split(" ")
        chunks = self.chunks
        own = [self.chunk(first)] if first else []
        for p in rest:
            got = chunks.get(p)
            if got is None:
                got = self.chunk(" " + p)
                if len(p) <= KEPT_CHARS:
                    chunks[p] = got
            own.append(got)
        flat = np.frombuffer(b"".join(own), "<u4").astype(np.int64)
        lengths = np.fromiter(map(len, own), np.int64, len(own)) >> 2
        ends = np.cumsum(lengths)
        bases = np.cumsum(flat[ends - 1]) if len(own) else ends
        out = np.zeros(len(flat) + 1, np.int64)
        if len(own) > 1:
            flat[ends[0] :] += np.repeat(bases[:-1], lengths[1:])
        out[1:] = flat
        return out

    def by_special(self, text: str) -> list[int]:
        """Special strings stand alone, so each stretch between them counts by itself; cuts inside one are encoded."""
        cut = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True))))
        counts, base, at = [0], 0, 0
        for m in cut.finditer(text):
            counts += [base + int(c) for c in self.text(text[at : m.start()])[1:]]
            tail = text[at : m.start()]
            back = max(0, tail.rfind(" "))
            while back and tail[back - 1].isspace():
                back -= 1
            before = counts[at + back] - base
            for k in range(1, len(m[0])):
                counts.append(base + before + len(self.lib.encode(tail[back:] + m[0][:k], add_special_tokens=False).ids))
            base = counts[m.start()] + 1
            counts.append(base)
            at = m.end()
        return counts + [base + int(c) for c in self.text(text[at:])[1:]]

    def trim(self) -> None:
        for kept, most in ((self.chunks, CACHE_CHUNKS), (self.pieces, CACHE_PIECES), (self.valid, CACHE_PAIRS)):
            if len(kept) > most:
                kept.clear()


@lru_cache(maxsize=1)
def prefix_counter(path: str) -> PrefixCounter:
    """One for each worker process, whose tasks share its caches."""
    return PrefixCounter(path)


def longest_within(prefix_tokens, limit: int) -> int:
    """Code points of the longest prefix that has at most `limit` tokens."""
    import numpy as np

    within = np.flatnonzero(np.asarray(prefix_tokens) <= limit)
    return int(within[-1]) if len(within) else 0


def token_counts(docs: DataFrame, tokenizer_path: str, limit: int = 1024, with_prefixes: bool = True) -> DataFrame:
    """Token counts of every text of `docs` (doc_id, text), each from the table of all its prefixes.

    limit_chars is the longest prefix of at most `limit` tokens; prefix_tokens is the table itself, null unless
    `with_prefixes`.
    """

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        counter = prefix_counter(tokenizer_path)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                n_bytes, n_tokens, fits, kept = [], [], [], []
                counter.trim()
                for text in part.column(1).to_pylist():
                    prefix = counter.text(text or "")
                    n_bytes.append(len((text or "").encode()))
                    n_tokens.append(int(prefix[-1]))
                    fits.append(len(prefix) - 1 if prefix[-1] <= limit else longest_within(prefix, limit))
                    kept.append(prefix.astype("int32") if with_prefixes else None)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(n_bytes, pa.int64()), pa.array(n_tokens, pa.int64()), pa.array([n > limit for n in n_tokens], pa.bool_()), pa.array(fits, pa.int64()), pa.array(kept, pa.list_(pa.int32()))],
                    ["doc_id", "n_bytes", "n_tokens", "over_limit", "limit_chars", "prefix_tokens"],
                )

    return pick(docs, doc_id="long", text="string").mapInArrow(run, SCHEMA)
