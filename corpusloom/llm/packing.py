"""Packing into fixed windows by minimum bin slack.

Every document is cut into full windows and one remainder shorter than a window. The remainders of a task form a
multiset of lengths; a subset-sum dynamic programme over it, held as the bits of one integer, finds the sum closest
to a window's capacity, and walking back through its layers gives how often each length is used. A pattern that fills
a window exactly is used as often as its lengths allow. What fits nothing at the end of a task is cut at window
ends, and the last window at powers of two, which need no padding.

Tasks pack on their own: no shuffle, nothing on the driver, and at most `HELD` remainders in memory. A sequence's id
is the task's number times 2**33 plus a running number, so ids stay unique at any width.

Defined cases: a null text is an empty one (its only id is the end id); a very long text is encoded whole and fills as
many windows as it takes; equal and repeated rows are packed one by
one; an empty table gives an empty result; a null doc_id is carried along; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import defaultdict, deque
from collections.abc import Iterator

from pyspark.sql import DataFrame

from ._shared import pick, slices

#: Remainders a task holds while it packs.
HELD = 1024
SCHEMA = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long,"
    " sequence_length long, padded_length long, ids binary"
)


def closest_fill(counts: dict[int, int], capacity: int) -> dict[int, int]:
    """How often to use each length so that the sum is the largest one up to `capacity`.

    Bit s of `reach` says that s is a sum of the lengths seen so far. Lengths come largest first, counts in binary
    parts; the layers kept on the way are walked back for the counts. It stops early once `capacity` itself is met.
    """
    reach, layers, mask = 1, [], (1 << (capacity + 1)) - 1
    for length in sorted(counts, reverse=True):
        left, part = min(counts[length], capacity // length), 1
        while left > 0:
            part = min(part, left)
            layers.append((length, part, reach))
            reach |= (reach << (length * part)) & mask
            left -= part
            part *= 2
        if reach >> capacity & 1:
            break
    best = reach.bit_length() - 1
    used: dict[int, int] = defaultdict(int)
    for length, part, before in reversed(layers):
        if not before >> best & 1:
            used[length] += part
            best -= length * part
    return dict(used)


def is_power_of_two(n: int) -> bool:
    return n & (n - 1) == 0


class Packer:
    """Takes documents' ids one after another and gives rows of SCHEMA (without ids unless `with_ids`)."""

    def __init__(self, window: int, task: int, with_ids: bool):
        self.window, self.base, self.next, self.with_ids = window, task << 33, 0, with_ids
        self.held: dict[int, deque] = defaultdict(deque)
        self.n_held = 0
        self.rows: list[tuple] = []

    def sequence(self, pieces: list[tuple]) -> None:
        """pieces: (doc_id, start, ids as bytes, doc_tokens)."""
        total = sum(len(p[2]) for p in pieces) // 4
        padded = total if is_power_of_two(total) else self.window
        offset = 0
        for doc_id, start, ids, doc_tokens in pieces:
            n = len(ids) // 4
            crc = zlib.crc32(ids)
            self.rows.append((doc_id, start, n, crc, doc_tokens, self.base + self.next, offset, total, padded, ids if self.with_ids else None))
            offset += n
        self.next += 1

    def add(self, doc_id: int | None, ids: bytes) -> None:
        total, step = len(ids) // 4, 4 * self.window
        full = total // self.window
        for i in range(full):
            self.sequence([(doc_id, i * self.window, ids[i * step : (i + 1) * step], total)])
        if rest := ids[full * step :]:
            self.held[len(rest) // 4].append((doc_id, full * self.window, rest, total))
            self.n_held += 1
            if self.n_held >= HELD:
                self.pack(HELD // 4)

    def take(self, length: int) -> tuple:
        pieces = self.held[length]
        piece = pieces.popleft()
        if not pieces:
            del self.held[length]
        self.n_held -= 1
        return piece

    def pack(self, keep: int) -> None:
        """Fills windows, the largest remainder first, until no more than `keep` remainders are held."""
        while self.n_held > keep:
            largest = max(self.held)
            others = {k: len(v) for k, v in self.held.items()}
            others[largest] -= 1
            used = closest_fill({k: c for k, c in others.items() if c}, self.window - largest)
            used[largest] = used.get(largest, 0) + 1
            slack = self.window - sum(k * c for k, c in used.items())
            if slack:
                self.fill([self.take(k) for k, c in used.items() for _ in range(c)], slack)
            else:
                for _ in range(min(len(self.held[k]) // c for k, c in used.items())):
                    self.sequence([self.take(k) for k, c in used.items() for _ in range(c)])

    def fill(self, pieces: list[tuple], slack: int) -> None:
        """Closes a window that no multiset fills: the rest comes from the front of other remainders."""
        while slack and self.held:
            doc_id, start, ids, total = self.take(max(self.held))
            n = min(slack, len(ids) // 4)
            pieces.append((doc_id, start, ids[: 4 * n], total))
            slack -= n
            if rest := ids[4 * n :]:
                self.held[len(rest) // 4].append((doc_id, start + n, rest, total))
                self.n_held += 1
        if not slack:
            self.sequence(pieces)
            return
        while pieces:  # the task's last window: cut so that each sequence's length is a power of two
            left = sum(len(p[2]) for p in pieces) // 4
            room, own = 1 << (left.bit_length() - 1), []
            while room:
                doc_id, start, ids, total = pieces.pop(0)
                n = min(room, len(ids) // 4)
                own.append((doc_id, start, ids[: 4 * n], total))
                room -= n
                if rest := ids[4 * n :]:
                    pieces.insert(0, (doc_id, start + n, rest, total))
            self.sequence(own)

    def drain(self) -> list[tuple]:
        rows, self.rows = self.rows, []
        return rows


def pack(docs: DataFrame, tokenizer_path: str, window: int = 2048, end_id: int = 1, with_ids: bool = True) -> DataFrame:
    """Packs every document of `docs` (doc_id, text); one row per piece, with its ids where `with_ids`."""
    tail = end_id.to_bytes(4, "little")

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        from .tokens import encoder

        schema, encode = None, encoder(tokenizer_path)
        packer = Packer(window, TaskContext.get().partitionId(), with_ids)

        def out(rows: list[tuple]):
            nonlocal schema
            schema = schema or ARROW()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)

        for part in slices(batches, 256):
            ids = encode.texts([t or "" for t in part.column(1).to_pylist()])
            for doc_id, own in zip(part.column(0).to_pylist(), ids, strict=True):
                packer.add(doc_id, own + tail)
            if len(packer.rows) >= 4096:
                yield out(packer.drain())
        packer.pack(0)
        if packer.rows:
            yield out(packer.drain())

    return pick(docs, doc_id="long", text="string").mapInArrow(run, SCHEMA)


def ARROW():  # noqa: N802
    import pyarrow as pa

    return pa.schema([(f.split()[0], pa.binary() if f.split()[1] == "binary" else pa.int64()) for f in SCHEMA.split(", ") for f in [f.strip()]])
