"""Token ids of whole texts with a public tokenizer file, one cache per worker.

White space always separates tokens of the word tokenizer, so a text's ids are
the ids of its blank-free chunks in order. Chunks are encoded once per worker;
a cache is emptied when it is full, which bounds memory and changes no id.
"""

from __future__ import annotations

import re
import sys
from array import array

from fieldtally.llm.common import claim

CACHE_CHUNKS, CACHE_WORDS = 700_000, 400_000
#: Letters of the Latin alphabet and end marks: such a chunk is one word, which
#: may be lower-cased first, and its marks. All else goes to the tokenizer as it is.
_PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,;:!?]*)")


def _byte_letters() -> dict[int, str]:
    """The letters by which a byte-level vocabulary names bytes: printable ones name
    themselves, the others follow from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(rest)}


class _Encoder:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.letters = _byte_letters()
        self.chunks: dict[str, bytes] = {"": b""}
        self.words: dict[str, bytes] = {"": b""}

    def word(self, w: str) -> bytes:
        """A lower-case word of Latin letters: the merges alone decide its ids."""
        if (ids := self.words.get(w)) is None:
            if len(self.words) > CACHE_WORDS:
                self.words = {"": b""}
            seen = w if w.isascii() else w.encode().decode("latin-1").translate(self.letters)
            self.words[w] = ids = _packed([t.id for t in self.model.tokenize(seen)])
        return ids

    def learn(self, chunks: list[str]) -> None:
        other = []
        for c in chunks:
            if (m := _PLAIN.fullmatch(c)) and (not m[2] or m[2] in self.chunks):
                self.chunks[c] = self.word(m[1].lower()) + self.chunks[m[2]]
            else:
                other.append(c)
        self.ask(other)

    def ask(self, chunks: list[str]) -> None:
        if chunks:
            for c, e in zip(chunks, self.tokenizer.encode_batch(chunks, add_special_tokens=False), strict=True):
                self.chunks[c] = _packed(e.ids)

    def encode(self, text: str) -> bytes:
        parts = text.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")
        have = self.chunks
        try:
            return b"".join([have[c] for c in parts])
        except KeyError:
            if len(have) > CACHE_CHUNKS:
                self.chunks = have = {"": b""}
            unseen = [c for c in set(parts) if c not in have]
            marks = {m[2] for m in map(_PLAIN.fullmatch, unseen) if m and m[2] not in have}
            self.ask(list(marks))
            self.learn([c for c in unseen if c not in marks])
            return b"".join([have[c] for c in parts])


def _packed(ids: list[int]) -> bytes:
    out = array("I", ids)
    if sys.byteorder == "big":
        out.byteswap()
    return out.tobytes()


_ENCODERS: dict[str, _Encoder] = {}


def encode_texts(path: str, texts: list[str]) -> list[bytes]:
    """The ids of each text as little-endian unsigned 32-bit numbers."""
    encoders = claim(_ENCODERS)
    if path not in encoders:
        encoders[path] = _Encoder(path)
    return [encoders[path].encode(t) for t in texts]
