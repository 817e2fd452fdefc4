"""Periodic runs of words, by Kruskal's rule on descending common prefixes.

A run is a longest stretch of consecutive words with smallest period ``q`` (words ``q``
apart are identical) and at least ``max(SHORTEST, 3 * q)`` words. Per text:

1. Words become numbers and their suffixes are sorted by doubling; neighbours in that
   order get the length of their longest common prefix (LCP). A text without a repeated
   stretch of ``SEED`` words has no run and stops here.
2. Neighbours unite in descending order of LCP: classes of suffixes, each an ordered set
   of its positions, the smaller poured into the larger.
3. Positions ``i < j`` that a union makes neighbours in a set have exactly that LCP. If
   their distance is at most the LCP, words from ``i`` on repeat with period ``j - i``,
   which seeds a run. Every run is seeded by its first word and the one a period on: a
   position between would have a smaller period.

A text is the work of one row: nothing is shuffled, memory grows with the longest text.

Defined results: a null text counts as empty; words are split at ASCII white space; a
text without run keeps all its words; repeated rows each give a row; an empty table gives
no rows. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from bisect import bisect, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SHORTEST, TIMES = 24, 3
#: The least common prefix of a run's first word and the word a period on.
SEED = SHORTEST - SHORTEST // TIMES


def repeats(words: list[bytes]) -> bool:
    """False only if no stretch of ``SEED`` words comes twice."""
    if len(words) <= SEED:
        return False
    h = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    width = 1
    while width < SEED:
        h = h[:-width] * np.uint64(0x9E3779B97F4A7C15) + (h[width:] ^ h[width:] >> np.uint64(29))
        width *= 2
    h.sort()
    return bool((h[1:] == h[:-1]).any())


def sorted_suffixes(word: np.ndarray) -> np.ndarray:
    """First words of the suffixes, in order, by doubling the words compared."""
    n, width = len(word), 1
    rank = word.astype(np.int64)
    order = np.argsort(rank, kind="stable")
    while True:
        second = np.zeros(n, np.int64)
        second[:-width] = rank[width:] + 1
        key = rank * (n + 1) + second
        order = np.argsort(key, kind="stable")
        new = np.cumsum(np.append(0, key[order][1:] != key[order][:-1]))
        rank[order] = new
        if new[-1] == n - 1:
            return order
        width = min(2 * width, n - 1)


def common_prefixes(word: list[int], order: np.ndarray) -> np.ndarray:
    """Words that each suffix shares with the one before it in order."""
    n = len(word)
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    out, shared = [0] * n, 0
    for i, j in enumerate(before.tolist()):
        if j < 0:
            shared = 0
            continue
        most = n - max(i, j)
        while shared < most and word[i + shared] == word[j + shared]:
            shared += 1
        out[i] = shared
        if shared:
            shared -= 1
    return np.array(out, np.int64)[order]


def seeds(order: np.ndarray, shared: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """``i, j, LCP`` of all positions that a union makes neighbours, for LCPs of ``SEED``
    words and more."""
    unions = np.flatnonzero(shared >= SEED)
    unions = unions[np.argsort(-shared[unions], kind="stable")]
    class_of: dict[int, list[int]] = {}  # by position; a class is its ordered positions
    firsts, seconds = order[unions - 1].tolist(), order[unions].tolist()
    for a, b, lcp in zip(firsts, seconds, shared[unions].tolist()):
        big, small = class_of.get(a) or [a], class_of.get(b) or [b]
        if len(big) < len(small):
            big, small = small, big
        if len(small) * 16 > len(big):
            big = sorted(big + small)
            for p in big:
                class_of[p] = big
        else:
            if len(big) == 1:
                class_of[big[0]] = big
            for p in small:
                insort(big, p)
                class_of[p] = big
        # Only neighbours from different sides are new.
        came = set(small)
        for p in small:
            at = bisect(big, p) - 1
            if at and big[at - 1] not in came:
                yield big[at - 1], p, lcp
            if at + 1 < len(big) and big[at + 1] not in came:
                yield p, big[at + 1], lcp


def find_runs(words: list) -> list[tuple[int, int, int]]:
    """``(start, length, period)`` of every run, by start, then period."""
    if len(words) < SHORTEST or not repeats(words):
        return []
    numbers: dict = {}
    word = [numbers.setdefault(w, len(numbers)) for w in words]
    order = sorted_suffixes(np.array(word))
    out = []
    for i, j, lcp in seeds(order, common_prefixes(word, order)):
        period = j - i
        if period <= lcp and period + lcp >= max(SHORTEST, TIMES * period) and (i == 0 or word[i - 1] != word[j - 1]):
            out.append((i, period + lcp, period))
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapse(words: list, runs: list[tuple[int, int, int]]) -> list:
    """``words`` without those that any run holds after its first period."""
    if not runs:
        return words
    edge = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        edge[start + period] += 1
        edge[start + length] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(edge[:-1]) == 0)]


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str | Column = "text", texts: bool = False) -> DataFrame:
    """``id_col``, n_runs, start, length, period, exponent_milli of the run with the
    greatest length / period (ties: smallest start, then period), runs_sha256 and
    collapsed_sha256; with ``texts``, also runs (start, length, period) and the collapsed
    text (null stays null)."""

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for text in b["text"]:
                words = (text or "").encode().split()
                runs = find_runs(words)
                kept = b" ".join(collapse(words, runs))
                start = length = period = None
                for s, l, p in runs:  # by start, then period: the first of equals stays
                    if length is None or l * period > length * p:
                        start, length, period = s, l, p
                row = [
                    len(runs), start, length, period, 1000 * length // period if runs else None,
                    hashlib.sha256("".join("%d,%d,%d\n" % r for r in runs).encode()).hexdigest(), hashlib.sha256(kept).hexdigest(),
                ]
                rows.append(row + ([runs, None if text is None else kept.decode()] if texts else []))
            out = pd.DataFrame(rows, columns=names)
            for c in names[:5]:
                out[c] = out[c].astype("Int64")
            out.insert(0, "id", b["id"])
            yield out

    names = ["n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    schema = "id string, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"
    if texts:
        names += ["runs", "collapsed"]
        schema += ", runs array<struct<start: long, length: long, period: long>>, collapsed string"
    text = F.col(text_col) if isinstance(text_col, str) else text_col
    out = docs.select(F.col(id_col).cast("string").alias("id"), text.alias("text")).mapInPandas(scan, schema)
    return out.withColumn("id", F.col("id").cast(docs.schema[id_col].dataType)).withColumnRenamed("id", id_col)


def with_planted_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", out: str = "text") -> DataFrame:
    """``docs`` where each tenth text ends in a repeated stretch, by a hash of its id.

    Let h = crc32(id as text), g = floor(h / 10). If h % 10 = 0 and the text has n > 0
    words, each word i >= a becomes word a + (i - a) % p, where a = g % n and
    p = 1 + floor((n - a) / (3 + g % 8)). A row without id keeps its text."""
    h = F.crc32(F.col(id_col).cast("string").cast("binary"))
    chosen = h % 10 == 0
    words = F.filter(F.split(F.col(text_col), "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    # Each step is a column of its own, so that none is evaluated twice.
    step = docs.withColumn("__w", F.when(chosen, words)).withColumn("__n", F.size("__w").cast("long")).withColumn("__g", F.floor(h / 10))
    step = step.withColumn("__a", F.when(F.col("__n") > 0, F.col("__g") % F.col("__n")).cast("int"))
    step = step.withColumn("__p", (1 + F.floor((F.col("__n") - F.col("__a")) / (3 + F.col("__g") % 8))).cast("int"))
    rest = F.col("__n") - F.col("__a")
    many = F.ceil(rest / F.col("__p")).cast("int")
    again = F.slice(F.flatten(F.array_repeat(F.slice("__w", F.col("__a") + 1, F.col("__p")), many)), F.lit(1), rest.cast("int"))
    planted = F.array_join(F.concat(F.slice("__w", F.lit(1), F.col("__a")), again), " ")
    step = step.withColumn("__text", F.when(F.col("__n") > 0, planted).otherwise(F.col(text_col)))
    keep = [F.col(c) for c in docs.columns if c != out]
    return step.select(*keep, F.col("__text").alias(out))
