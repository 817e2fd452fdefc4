"""SentencePiece encoding and decoding with a unigram model.

Encoding finds, per text, the pieces with the largest sum of log scores (Viterbi
over a double-array trie of the pieces' bytes). Characters that no piece holds
become byte pieces. Blanks are written as the marker U+2581, with one before the
text; decoding turns markers into blanks, joins byte pieces and drops that first
blank.

The given model file is a merge list: its "scores" are minus the merge ranks, not
log probabilities. Log scores are then Zipf's law over the ranks,
``-log(rank + 1) - log(sum of 1 / rank)``. Files of the unigram kind keep theirs.

No piece holds a marker after another character or a newline at all (checked when
the file is loaded), so the best path of a text is made of the best paths of its
chunks, which are found once per worker; a cache is emptied when full.

Defined results: a null text gives null ids and null when decoded; an empty text
gives no ids; every input row gives one row, repeated or null ids included. A text
that holds the marker itself decodes to a blank there. Other columns are ignored,
whatever their names.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldtally.llm.common import claim

MARK = "▁"
UNKNOWN_PENALTY = 10.0
CACHE_CHUNKS = 600_000
LOCKSTEP_BYTES = 64  # longer chunks are segmented one by one
_RUNS = re.compile(" *[^ ]+| +")


@dataclass
class Pieces:
    """The trie as flat arrays: state t follows s on byte c if t = base[s] + c and
    check[t] = s; ``value`` is a state's piece or -1."""

    base: np.ndarray
    check: np.ndarray
    value: np.ndarray
    scores: np.ndarray  # float32 per piece id
    unknown: np.float32
    byte_ids: list[int]  # piece id of each byte value
    text: list[bytes]  # what a piece decodes to, its marker as a blank
    longest: int


def build_trie(keys: list[tuple[bytes, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    keys = sorted(keys)
    size = 1 << 12
    base, check, value = [0] * size, [-1] * size, [-1] * size
    check[0] = 0
    floor, branch = 257, 1  # a place from 257 on has a base of 1 or more for any byte

    def room(at: int) -> None:
        if at + 600 > len(check):
            base.extend([0] * len(base))
            value.extend([-1] * len(value))
            check.extend([-1] * len(check))

    stack = [(0, 0, len(keys), 0)]
    while stack:
        state, lo, hi, depth = stack.pop()
        if lo < hi and len(keys[lo][0]) == depth:
            value[state] = keys[lo][1]
            lo += 1
        if lo == hi:
            continue
        groups, at = [], lo
        while at < hi:
            c, to = keys[at][0][depth], at
            while to < hi and keys[to][0][depth] == c:
                to += 1
            groups.append((c, at, to))
            at = to
        if len(groups) == 1:  # fills the next free place
            while check[floor] != -1:
                floor += 1
                room(floor)
            b = floor - groups[0][0]
        else:  # a branch looks no further back than the last one had to
            b, tries = branch, 0
            while not all(check[b + c] == -1 for c, _, _ in groups):
                b, tries = b + 1, tries + 1
                room(b)
            if tries > 32:
                branch = b
        base[state] = b
        for c, at, to in groups:
            check[b + c] = state
            stack.append((b + c, at, to, depth + 1))
    return tuple(np.array(x, np.int32) for x in (base, check, value))


def load_pieces(path: str) -> Pieces:
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    n = model.get_piece_size()
    names = [model.id_to_piece(i) for i in range(n)]
    plain = [i for i in range(n) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
    if any(MARK in names[i].lstrip(MARK) or "\n" in names[i] for i in plain):
        raise ValueError("pieces must hold markers in front only, and no newline")
    scores = np.array([model.get_score(i) for i in range(n)], np.float64)
    if (scores[plain] == np.round(scores[plain])).all():  # a merge list
        order = sorted(plain, key=lambda i: (-scores[i], i))
        rank = np.arange(1, len(order) + 1)
        scores[order] = -np.log(rank) - np.log((1 / rank).sum())
    scores = scores.astype(np.float32)
    by_byte = {names[i]: i for i in range(n) if model.is_byte(i)}
    text = [b"" if model.is_control(i) else name.replace(MARK, " ").encode() for i, name in enumerate(names)]
    for b in range(256):
        text[by_byte[f"<0x{b:02X}>"]] = bytes([b])
    base, check, value = build_trie([(names[i].encode(), i) for i in plain])
    return Pieces(
        base, check, value, scores, np.float32(scores[plain].min() - np.float32(UNKNOWN_PENALTY)),
        [by_byte[f"<0x{b:02X}>"] for b in range(256)], text, max(len(names[i].encode()) for i in plain),
    )


def _char_bytes(lead: np.ndarray) -> np.ndarray:
    return np.where(lead < 0x80, 1, np.where(lead < 0xE0, 2, np.where(lead < 0xF0, 3, 4)))


def _segment_equal(p: Pieces, chunks: list[bytes]) -> list[list[int]]:
    """Viterbi over many chunks at once, one start position after the other."""
    lens = np.array([len(c) for c in chunks])
    n, width = len(chunks), int(lens.max())
    data = np.zeros((n, width), np.int64)
    data[np.arange(width) < lens[:, None]] = np.frombuffer(b"".join(chunks), np.uint8)
    score = np.full((n, width + 1), -np.inf, np.float32)
    score[:, 0] = 0
    begin, piece = np.zeros((n, width + 1), np.int32), np.full((n, width + 1), -1, np.int32)
    for s in range(width):
        live = np.flatnonzero((lens > s) & (score[:, s] > -np.inf))
        if not len(live):
            continue
        char = _char_bytes(data[live, s])
        single = np.zeros(n, bool)
        rows, state = live, np.zeros(len(live), np.int64)
        for at in range(s, min(width, s + p.longest)):
            ok = lens[rows] > at
            rows, state = rows[ok], state[ok]
            to = p.base[state] + data[rows, at]
            ok = p.check[to] == state
            rows, state = rows[ok], to[ok]
            if not len(rows):
                break
            got = p.value[state]
            hit = got >= 0
            r, v = rows[hit], got[hit]
            new = score[r, s] + p.scores[v]
            better = new > score[r, at + 1]
            r2 = r[better]
            score[r2, at + 1], begin[r2, at + 1], piece[r2, at + 1] = new[better], s, v[better]
            single[r[_char_bytes(data[r, s]) == at + 1 - s]] = True
        lone = ~single[live]
        r, end = live[lone], np.minimum(s + char[lone], lens[live[lone]])
        new = score[r, s] + p.unknown
        better = new > score[r, end]
        r, end = r[better], end[better]
        score[r, end], begin[r, end], piece[r, end] = new[better], s, -1
    out = []
    for i, c in enumerate(chunks):
        at, ids = len(c), []
        b, q = begin[i], piece[i]
        while at:
            s = int(b[at])
            if q[at] >= 0:
                ids.append(int(q[at]))
            else:
                ids += [p.byte_ids[x] for x in reversed(c[s:at])]
            at = s
        out.append(ids[::-1])
    return out


def _segment_long(p: Pieces, c: bytes) -> list[int]:
    """The same for one chunk of any length."""
    n = len(c)
    score, begin, piece = np.full(n + 1, -np.inf, np.float32), [0] * (n + 1), [-1] * (n + 1)
    score[0] = 0
    for s in range(n):
        if score[s] == -np.inf:
            continue
        char, state, single, at = int(_char_bytes(np.array(c[s]))), 0, False, s
        while at < n:
            to = int(p.base[state]) + c[at]
            if p.check[to] != state:
                break
            state, at = to, at + 1
            if (v := int(p.value[state])) >= 0:
                single |= at == s + char
                if (new := score[s] + p.scores[v]) > score[at]:
                    score[at], begin[at], piece[at] = new, s, v
        end = min(n, s + char)
        if not single and (new := score[s] + p.unknown) > score[end]:
            score[end], begin[end], piece[end] = new, s, -1
    at, ids = n, []
    while at:
        ids += [piece[at]] if piece[at] >= 0 else [p.byte_ids[x] for x in reversed(c[begin[at] : at])]
        at = begin[at]
    return ids[::-1]


def segment(p: Pieces, chunks: list[bytes]) -> list[list[int]]:
    out: list[list[int]] = [[] for _ in chunks]
    short = sorted((i for i, c in enumerate(chunks) if len(c) <= LOCKSTEP_BYTES), key=lambda i: len(chunks[i]))
    for at in range(0, len(short), 8192):
        part = short[at : at + 8192]
        for i, ids in zip(part, _segment_equal(p, [chunks[i] for i in part])):
            out[i] = ids
    for i, c in enumerate(chunks):
        if len(c) > LOCKSTEP_BYTES:
            out[i] = _segment_long(p, c)
    return out


def split_chunks(text: str) -> list[str]:
    """Chunks whose concatenation is the marked text; a blank stands for a marker."""
    lines = (" " + text).split("\n")
    out: list[str] = []
    for k, line in enumerate(lines):
        if k:
            out.append("\n")
        if "  " in line or line.endswith(" ") or not line:
            out += _RUNS.findall(line)
        else:
            first, *rest = line.split(" ")
            if first:
                out.append(first)
            out += [" " + w for w in rest]
    return out


class Encoder:
    """Encodes with a cache of chunks; ids are packed as 32-bit numbers."""

    def __init__(self, pieces: Pieces):
        self.pieces, self.cache = pieces, {}

    def encode(self, texts: list[str]) -> list[bytes]:
        parts = [split_chunks(t) if t else [] for t in texts]
        unseen = list({c for p in parts for c in p if c not in self.cache})
        if unseen and len(self.cache) + len(unseen) > CACHE_CHUNKS:
            self.cache = {}
            unseen = list({c for p in parts for c in p})
        raw = [c.replace(" ", MARK).encode() for c in unseen]
        for c, ids in zip(unseen, segment(self.pieces, raw)):
            self.cache[c] = array("I", ids).tobytes()
        have = self.cache
        return [b"".join([have[c] for c in p]) for p in parts]


def decode(pieces: Pieces, ids: list[int]) -> str:
    text = b"".join([pieces.text[i] for i in ids])
    return (text[1:] if text[:1] == b" " else text).decode(errors="replace")


_ENCODERS: dict[int, Encoder] = {}
TEXTS_AT_ONCE = 500


def encode_pieces(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col`` and ``ids`` (array of int) per row."""
    shared = docs.sparkSession.sparkContext.broadcast(load_pieces(model_path))  # as large as the model file

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = _encoder(shared)
        for b in batches:
            for at in range(0, len(b), TEXTS_AT_ONCE):
                part = b[at : at + TEXTS_AT_ONCE]
                ids = encoder.encode(part["text"].fillna("").tolist())
                none = part["text"].isna()
                yield pd.DataFrame({"id": part["id"].to_numpy(), "ids": [None if z else np.frombuffer(x, np.uint32).astype(np.int32) for x, z in zip(ids, none)]})

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInPandas(run, f"id {kind}, ids array<int>").withColumnRenamed("id", id_col)


def _encoder(shared) -> Encoder:
    """One encoder, with its cache, per worker and broadcast."""
    key = id(shared.value)
    claim(_ENCODERS)
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = Encoder(shared.value)
    return _ENCODERS[key]


def decode_pieces(ids: DataFrame, model_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``id_col`` and ``text`` per row."""
    shared = ids.sparkSession.sparkContext.broadcast(load_pieces(model_path))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"id": b["id"], "text": [None if x is None else decode(shared.value, list(x)) for x in b["ids"]]})

    kind = ids.schema[id_col].dataType.simpleString()
    rows = ids.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids"))
    return rows.mapInPandas(run, f"id {kind}, text string").withColumnRenamed("id", id_col)


def encode_round_trip(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes and decodes each text: ``id_col``, n_pieces, n_byte_pieces, ids_sha256
    (little-endian 32-bit ids) and whether the decoded text equals the text."""
    import hashlib

    shared = docs.sparkSession.sparkContext.broadcast(load_pieces(model_path))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = _encoder(shared)
        p = shared.value
        is_byte = np.zeros(len(p.text), bool)
        is_byte[p.byte_ids] = True
        for b in batches:
            for at in range(0, len(b), TEXTS_AT_ONCE):
                part = b[at : at + TEXTS_AT_ONCE]
                texts = part["text"].fillna("").tolist()
                packed = encoder.encode(texts)
                ids = [np.frombuffer(x, np.uint32) for x in packed]
                yield pd.DataFrame(
                    {
                        "id": part["id"].to_numpy(),
                        "n_pieces": [len(x) for x in ids],
                        "n_byte_pieces": [int(is_byte[x].sum()) for x in ids],
                        "ids_sha256": [hashlib.sha256(x).hexdigest() for x in packed],
                        "round_trip": [decode(p, x.tolist()) == t for x, t in zip(ids, texts)],
                    }
                )

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    schema = f"id {kind}, n_pieces long, n_byte_pieces long, ids_sha256 string, round_trip boolean"
    return rows.mapInPandas(run, schema).withColumnRenamed("id", id_col)
