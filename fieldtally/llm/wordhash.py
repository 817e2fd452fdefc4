"""Words of texts as numbers, without a Python object per word.

A word is whatever stands between ASCII white space (space, tab to carriage return). Its
number is a hash of ``WORD_BITS`` bits, made from prefix sums of a polynomial over its bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

WORD_BITS = 36
SLICE = 1 << 19  # bytes of text that are worked on at a time
_BASE = 0x9E3779B97F4A7C15
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_VALUE = np.random.default_rng(1).integers(1, 1 << 63, 256).astype(np.uint64)


def _powers(n: int, base: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_POWERS = [_powers(SLICE + 1, _BASE), _powers(SLICE + 1, pow(_BASE, -1, 1 << 64))]


def hash_words(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Numbers from 5 on of the words ``data[begin:end]``, in order within ``data``."""
    if len(data) >= len(_POWERS[0]):
        up, down = _powers(len(data) + 1, _BASE), _powers(len(data) + 1, pow(_BASE, -1, 1 << 64))
    else:
        up, down = _POWERS
    sums = np.cumsum(_VALUE[data] * up[: len(data)])
    h = sums[end - 1] - np.where(begin > 0, sums[begin - 1], 0)
    h *= down[begin]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0x9E3779B97F4A7C15)
    return np.maximum((h >> np.uint64(64 - WORD_BITS)).astype(np.int64), 5)


def word_keys(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first, last + 1, keys, document) of some texts after the other (no nulls): the
    numbers of their words in order, and the place of each word's text."""
    wide = pa.types.is_large_string(texts.type)
    offsets = np.frombuffer(texts.buffers()[1], np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    buffer = texts.buffers()[2]
    data = np.frombuffer(buffer, np.uint8) if buffer is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(texts):
        # Whole texts, up to a slice or one long text.
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + SLICE, "right")) - 1)
        keys, docs = [], []
        at, stop = int(offsets[lo]), int(offsets[hi])
        while at < stop:
            to = min(at + SLICE, stop)
            if to < stop:  # a long text is cut at white space
                gap = np.flatnonzero(_SPACE[data[at:to]])
                while not len(gap) and to < stop:
                    to = min(to + SLICE, stop)
                    gap = np.flatnonzero(_SPACE[data[at:to]])
                if to < stop:
                    to = at + int(gap[-1]) + 1
            part = data[at:to]
            word = ~_SPACE[part]
            start = offsets[lo:hi] - at
            fresh = np.zeros(len(part) + 1, bool)
            fresh[start[(start >= 0) & (start < len(part))]] = True
            fresh[-1] = True
            before = np.append(False, word[:-1])
            after = np.append(word[1:], False)
            begin = np.flatnonzero(word & (~before | fresh[:-1]))
            end = np.flatnonzero(word & (~after | fresh[1:])) + 1
            keys.append(hash_words(part, begin, end))
            docs.append(np.searchsorted(offsets[: hi + 1], begin + at, "right") - 1)
            at = to
        none = np.zeros(0, np.int64)
        yield lo, hi, np.concatenate(keys) if keys else none, np.concatenate(docs) if docs else none
        lo = hi
