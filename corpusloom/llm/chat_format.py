"""Chat formatting: typed content parts flattened by a visitor, with a loss mask.

A conversation's parts (text, image, audio, document) become one string. Each turn is
`<|im_start|>role` newline `text<|im_end|>` newline; an attachment becomes a run of placeholders, one for each of
its expanded tokens, and a reference with its order and place. Control strings inside texts are escaped
reversibly: `<`, any number of backslashes, `|` gets one backslash more, so no escaped text holds `<|`.

Formatting is row by row. A conversation's turns are brought together by its id and sorted on disk by
(turn, role, text); they pass through a running state, so that even one conversation with a third of all rows needs
no more memory than its longest turn for its digest. One conversation's digest is one hash over its turns in order,
which has to pass through one task; its rows were formatted before, in many.

Defined cases: null text, role and attachment reference count as empty; a null conv_id is a conversation of its own;
turns with equal numbers follow in the order of role and text; repeated rows are turns of their own; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, functions as F

from ._shared import pick

START, END = "<|im_start|>", "<|im_end|>"
ESCAPE, UNESCAPE = re.compile(r"<(\\*)\|"), re.compile(r"<\\(\\*)\|")


def escape(text: str) -> str:
    return ESCAPE.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return UNESCAPE.sub(r"<\1|", text)


def escape_role(role: str) -> str:
    return escape(role.replace("~", "~0").replace("\n", "~1"))


def unescape_role(role: str) -> str:
    return unescape(role).replace("~1", "\n").replace("~0", "~")


@dataclass
class Flat:
    """What the visitor gathers: the string, its spans under the loss mask, the attachments in order."""

    text: list[str] = field(default_factory=list)
    length: int = 0
    loss: list[tuple[int, int]] = field(default_factory=list)
    attachments: list[dict] = field(default_factory=list)

    def put(self, piece: str) -> None:
        self.text.append(piece)
        self.length += len(piece)


class PartVisitor:
    """Flattens parts by their type; `tokens` says how many placeholders an attachment expands to."""

    #: Tokens of an image tile, of a second of audio, of a document page.
    rates = {"image": 256, "audio": 25, "document": 512}

    def visit(self, part: dict, out: Flat) -> None:
        getattr(self, f"visit_{part.get('type') or 'text'}", self.visit_unknown)(part, out)

    def visit_text(self, part: dict, out: Flat) -> None:
        out.put(escape(part.get("text") or ""))

    def attach(self, part: dict, out: Flat) -> None:
        kind = part["type"]
        n = max(1, -(-int(part.get("units") or 1) * self.rates[kind]))
        out.attachments.append({"kind": kind, "ref": part.get("ref") or "", "order": len(out.attachments), "start": out.length, "tokens": n})
        out.put(f"<|{kind}|>" * n)

    visit_image = visit_audio = visit_document = attach

    def visit_unknown(self, part: dict, out: Flat) -> None:
        raise ValueError(f"unknown part type {part.get('type')!r}")


def flatten(turns: list[tuple[str, list[dict]]], visitor: PartVisitor | None = None, trained: str = "assistant") -> Flat:
    """One conversation; text parts of `trained` turns are under the loss mask, their attachments are not."""
    visitor, out = visitor or PartVisitor(), Flat()
    for role, parts in turns:
        out.put(f"{START}{escape_role(role or '')}\n")
        for part in parts:
            begin = out.length
            visitor.visit(part, out)
            if role == trained and (part.get("type") or "text") == "text" and out.length > begin:
                out.loss.append((begin, out.length))
        out.put(f"{END}\n")
    return out


TURN = re.compile(r"<\|im_start\|>([^\n]*)\n(.*?)<\|im_end\|>\n", re.S)
PLACEHOLDER = re.compile(r"(?:<\|(?:image|audio|document)\|>)+")


def parse(formatted: str) -> list[tuple[str, str]]:
    """Role and text of each turn, read back from the string; placeholders are not text."""
    return [(unescape_role(m[1]), unescape(PLACEHOLDER.sub("", m[2]))) for m in TURN.finditer(formatted)]


FORMATTED = "conv_id long, turn long, role string, text string, formatted string, loss_start int, loss_length int, attachments array<struct<kind:string,ref:string,order:int,start:int,tokens:int>>"


def format_turns(turns: DataFrame, parts: str | None = None) -> DataFrame:
    """Each row of `turns` (conv_id, turn, role, text and, if named, an array of parts) as its stretch of the output.

    Row by row and without a shuffle. loss_start and loss_length give the span under the loss mask in the row's own
    stretch, attachments the references recorded.
    """

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        kinds = pa.list_(pa.struct([("kind", pa.string()), ("ref", pa.string()), ("order", pa.int32()), ("start", pa.int32()), ("tokens", pa.int32())]))
        for batch in batches:
            cols = [c.to_pylist() for c in batch.columns]
            flats = [flatten([(r or "", p if p is not None else [{"type": "text", "text": t}])]) for r, t, p in zip(cols[2], cols[3], cols[4], strict=True)]
            spans = [(f.loss[0][0], f.loss[-1][1] - f.loss[0][0]) if f.loss else (0, 0) for f in flats]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(2), batch.column(3), pa.array(["".join(f.text) for f in flats], pa.string()), pa.array([s[0] for s in spans], pa.int32()), pa.array([s[1] for s in spans], pa.int32()), pa.array([f.attachments for f in flats], kinds)],
                ["conv_id", "turn", "role", "text", "formatted", "loss_start", "loss_length", "attachments"],
            )

    kind = "array<struct<type:string,text:string,ref:string,units:int>>"
    own = pick(turns, conv_id="long", turn="long", role="string", text="string", **({parts: kind} if parts else {}))
    own = own.select("conv_id", "turn", "role", "text", (F.col(parts) if parts else F.lit(None).cast(kind)).alias("parts"))
    return own.mapInArrow(run, FORMATTED)


def conversations(formatted: DataFrame) -> DataFrame:
    """The rows of format_turns() by conversation and in order within each task, each conversation in one task."""
    return formatted.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")


def digests(formatted: DataFrame) -> DataFrame:
    """One row per conversation, read back from its formatted string while it streams by."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        rows: list[tuple] = []
        now, state = None, None

        def close() -> None:
            if state:
                n, all_turns, loss_chars, loss, chars = state
                rows.append((now, n, all_turns.hexdigest(), loss_chars, loss.hexdigest(), chars))

        for batch in batches:
            for conv_id, text, start, length in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if state is None or conv_id != now:
                    close()
                    now, state = conv_id, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, own in parse(text):
                    state[0] += 1
                    state[1].update(f"{role}\n{own}\n".encode())
                if length:
                    under = unescape(PLACEHOLDER.sub("", text[start : start + length]))
                    state[2] += len(under)
                    state[3].update(under.encode())
                state[4] += len(text)
            if len(rows) >= 4096:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)
                rows = []
        close()
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    ordered = conversations(formatted.select("conv_id", "formatted", "loss_start", "loss_length", "turn", "role", "text"))
    return ordered.select("conv_id", "formatted", "loss_start", "loss_length").mapInArrow(
        run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    )
