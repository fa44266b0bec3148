"""Byte-level BPE ids of whole texts, by the tokenizers library, with a bounded cache of chunks.

A chunk is a space and the run up to the next space. The pre-tokenizer of the vocabulary always cuts before such a
space unless white space stands on both of its sides, so a text's ids are its chunks' ids joined. Texts where that
does not hold, and texts with a special string in them, go to the library whole.
"""

from __future__ import annotations

import re
from array import array
from functools import lru_cache

#: A space with white space before it and white space or the end after it.
UNSAFE = re.compile(r"\s (?:\s|\Z)")
#: Chunks and pieces kept in a worker, about 220 MB.
CACHE_CHUNKS, CACHE_PIECES = 800_000, 400_000
#: Marks that often stand behind a word.
MARKS = tuple(".,;:!?")
#: Longer chunks and pieces are not kept.
KEPT_CHARS = 48
#: The pattern of the byte-level pre-tokenizer (fixed value).
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_letters() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies: printable Latin-1 is itself, the rest follows from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = (chr(256 + i) for i in range(256))
    return [chr(b) if b in plain else next(rest) for b in range(256)]


def public_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def load(path: str):
    """The library's tokenizer without truncation, padding or threads of its own."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(path)
    own.no_truncation()
    own.no_padding()
    return own


class Chunks(dict):
    """Ids of chunks by the part after their space, made where they are missing."""

    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, part: str) -> bytes:
        ids = self.make(part)
        if len(part) <= KEPT_CHARS:
            self[part] = ids
        return ids


class Letters(dict):
    """The printable stand-ins of each character's bytes."""

    def __init__(self):
        super().__init__()
        self.of_byte = byte_letters()

    def __missing__(self, char: str) -> str:
        own = self[char] = "".join(self.of_byte[b] for b in char.encode())
        return own


class Encoder:
    """Gives each text's ids as bytes of little-endian unsigned 32-bit integers."""

    def __init__(self, path: str):
        import regex

        self.lib = load(path)
        self.model = self.lib.model
        self.special = [t.content for t in self.lib.get_added_tokens_decoder().values()]
        self.split = regex.compile(PIECES).findall
        self.letters = Letters()
        self.space = self.letters[" "]
        self.pieces: dict[str, bytes] = {}
        self.inner = Chunks(self.after_space)

    def whole(self, text: str) -> bytes:
        return array("I", self.lib.encode(text, add_special_tokens=False).ids).tobytes()

    def piece(self, text: str) -> bytes:
        return self.word("".join(map(self.letters.__getitem__, text)))

    def word(self, letters: str) -> bytes:
        return array("I", [t.id for t in self.model.tokenize(letters)]).tobytes()

    def chunk(self, text: str) -> bytes:
        own = []
        for p in self.split(text):
            ids = self.pieces.get(p)
            if ids is None:
                ids = self.piece(p)
                if len(p) <= KEPT_CHARS:
                    self.pieces[p] = ids
            own.append(ids)
        return b"".join(own)

    def after_space(self, part: str) -> bytes:
        """The ids of a space and the part: letters alone are one piece, and a mark behind them is the next."""
        if part.isalpha():
            return self.word(self.space + (part if part.isascii() else "".join(map(self.letters.__getitem__, part))))
        if part[-1:] in MARKS and part[:-1].isalpha():
            return self.inner[part[:-1]] + self.chunk(part[-1])
        return self.chunk(" " + part)

    def text(self, text: str) -> bytes:
        if UNSAFE.search(text) or any(s in text for s in self.special):
            return self.whole(text)
        first, *rest = text.split(" ")
        return b"".join([self.chunk(first), *map(self.inner.__getitem__, rest)])

    def texts(self, texts: list[str]) -> list[bytes]:
        if len(self.inner) > CACHE_CHUNKS:
            self.inner.clear()
        if len(self.pieces) > CACHE_PIECES:
            self.pieces.clear()
        return [self.text(t) for t in texts]


@lru_cache(maxsize=1)
def encoder(path: str) -> Encoder:
    """One for each worker process, whose tasks share its cache."""
    return Encoder(path)
