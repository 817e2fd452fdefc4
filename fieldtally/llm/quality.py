"""Quality by the perplexity of an interpolated modified Kneser-Ney bigram model.

The model counts real words (whatever stands between ASCII white space) and pairs of
words of trusted documents, one model per language, however many there are. A text is
read as a ring: a mark, its words, and the mark again. With ``n`` the count of a pair,
``c`` that of its first word, ``N`` the number of different words before a word, ``T``
that of all pairs and ``V`` that of all words,

    p(w | h) = (n(h, w) - D(n)) / c(h) + spare(h) * p(w)
    p(w)     = (N(w) - D'(N)) / T + spare' / (V + 1)

with discounts from the counts of counts of each level; words that trusted text does
not hold share one place. A second word that equals the first becomes one
of three "repeats", by how many words before it are the same.

The logarithm splits into a price of each word, log spare(w) + log p(w) (each word is
once a first and once a second word, but for repeats, whose price is put right), and a
bonus of each pair that trusted text holds.
So a document's cost is a sum over its pairs, and comes from sharded joins of counts:

1. ``pair_rows`` turns blocks of texts into sorted pairs with their documents, cut into
   shards by language and first word, and says which documents are learnt from.
2. ``_continuations`` counts the learnt pairs of a shard and sends each second word's
   number of first words to that word's own shard, which adds up and answers.
3. ``_priced`` makes prices and bonuses of a shard, and sums of costs per document.
4. ``_collected`` adds up the shards' sums of each block.

Texts are not sent to the driver, and no table is held as a whole. The ids of trusted
documents are broadcast up to ``BROADCAST_IDS``; beyond, trusted texts are found by a
join that shuffles them, and go through step 1 once more. A word is known by 36 bits of
hash, so of a million words one in 70,000 shares its number with another. All pairs of
one first word meet in one task, which holds each learnt one once and meets blocks one
by one.

A fifth of the trusted documents (``HELD_OUT``, by a hash of the id) is left out of the
counts; a language's threshold is the ``QUANTILE`` of their perplexities. Short texts
are drawn towards the held-out mean by ``PRIOR_WORDS`` words of it.

Defined results: a null text counts as empty, and an empty text scores nearly the
mean; a null language is a language of its own (''); documents of a language without
held-out trusted text are kept, with null perplexity; null ids and repeated rows are
scored row by row and null ids are never trusted; an empty table gives no rows. Other
columns are carried along by ``judge`` and ignored by the rest, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldtally.llm.common import anti_join, cut, hint_few, semi_join
from fieldtally.llm.wordhash import WORD_BITS, word_keys

QUANTILE = 0.999
HELD_OUT = 5  # one in so many trusted documents
PRIOR_WORDS = 10
RING = 1  # the code of the mark
REPEATS = (2, 3, 4)  # codes of a second word that equals the one, two, three or more before it
BLOCK_PAIRS, BLOCK_DOCS = 3_000_000, 1 << 14
SHARD_BYTES = 48 << 20  # of text
BROADCAST_IDS = 2_000_000
WORD_MASK = (1 << WORD_BITS) - 1

LEARNT, ASKED, DOCS = 0, 1, 2


def _language(col: str) -> Column:
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def content(id_col: str, text_col: str, lang_col: str) -> Column:
    """What a row's score depends on, as a hash."""
    return F.xxhash64(F.col(id_col), _language(lang_col), F.coalesce(text_col, F.lit("")))


def held_out(id_col: str = "id") -> Column:
    return F.pmod(F.xxhash64(F.lit("held out"), F.col(id_col).cast("string")), F.lit(HELD_OUT)) == 0


def discounts(n: list[float]) -> np.ndarray:
    """D(0), D1, D2, D3+ from the numbers of what was seen once to four times."""
    n1, n2, n3, n4 = (max(float(x), 1.0) for x in n)
    y = n1 / (n1 + 2 * n2)
    d = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3]
    return np.array([0.0] + [min(max(x, 0.1), k) for k, x in zip((0.9, 1.8, 2.7), d)])


# ------------------------------------------------------------- numbers as bytes


def squeeze(x: np.ndarray) -> bytes:
    """Whole numbers, or floats of four bytes, byte by byte: leading bytes that are
    alike take little room."""
    x = np.ascontiguousarray(x)
    planes = x.view(np.uint8).reshape(-1, x.itemsize).T
    return bytes([x.itemsize]) + zstandard.compress(np.ascontiguousarray(planes).tobytes(), 1)


def swell(z: bytes, kind: type = np.int64) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(z[1:]), np.uint8).reshape(z[0], -1)
    out = np.ascontiguousarray(planes.T)
    if z[0] == np.dtype(kind).itemsize:
        return out.view(kind).ravel()
    return out.view(f"u{z[0]}").ravel().astype(kind)


def _steps(x: np.ndarray) -> np.ndarray:
    return np.diff(x, prepend=x.dtype.type(0))


# ------------------------------------------------------------------- texts


def ring(keys: np.ndarray, doc: np.ndarray, n_docs: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word, second word and document of each pair of some texts, given the words
    in order and the number of each word's document."""
    size = len(keys) + n_docs
    first, second = np.full(size, RING, np.int64), np.full(size, RING, np.int64)
    at = np.arange(len(keys)) + doc
    second[at] = keys
    again = np.append(False, (keys[1:] == keys[:-1]) & (doc[1:] == doc[:-1]))[: len(keys)]
    for code in REPEATS:
        second[at[again]] = code
        again = again & np.append(False, again[:-1])[: len(keys)]
    first[at + 1] = keys
    owner = np.repeat(np.arange(n_docs, dtype=np.int32), np.bincount(doc, minlength=n_docs) + 1)
    return first, second, owner


def shard_of(first: np.ndarray, shards: int) -> np.ndarray:
    return (first * shards) >> WORD_BITS


def _parts(first: np.ndarray, shards: int) -> list[tuple[int, int, int]]:
    """(shard, begin, end) of sorted words."""
    s = shard_of(first, shards)
    begin = np.flatnonzero(np.append(True, s[1:] != s[:-1])) if len(s) else np.zeros(0, int)
    return [(int(s[a]), int(a), int(b)) for a, b in zip(begin, np.append(begin[1:], len(s)))]


def _numbered(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    code, found = pd.factorize(x)
    order = np.argsort(found)
    rank = np.empty(len(found), np.int64)
    rank[order] = np.arange(len(found))
    return found[order], rank[code]


def _blobs(first: np.ndarray, second: np.ndarray, doc: np.ndarray, shards: int) -> Iterator[tuple]:
    """shard, and of its pairs in order: first words; places of first words with second
    words; numbers of documents (repeated as often as they hold the pair); documents."""
    words, key = _numbered(first)
    key <<= WORD_BITS
    key |= second
    order = np.argsort(key, kind="stable")
    key, doc = key[order], doc[order].astype(np.int32)
    del order
    new = np.append(True, key[1:] != key[:-1])
    start = np.flatnonzero(new)
    many = np.diff(np.append(start, len(key)))
    doc[1:] -= np.where(new[1:], 0, doc[:-1])
    key = key[start]
    begin = np.searchsorted(key >> WORD_BITS, np.arange(len(words) + 1))
    start = np.append(start, len(doc))
    for s, a, b in _parts(words, shards):
        i, j = begin[a], begin[b]
        yield (
            s, squeeze(_steps(words[a:b])), squeeze(_steps(key[i:j] - (a << WORD_BITS))),
            squeeze(many[i:j].astype(np.uint32)), squeeze(doc[start[i] : start[j]].astype(np.uint16)),
        )


def _pairs_of(x) -> tuple[np.ndarray, ...]:
    """First words, places of first words, second words, numbers and documents."""
    first, key, many, doc = np.cumsum(swell(x.a)), np.cumsum(swell(x.b)), swell(x.c), np.cumsum(swell(x.d))
    start = np.cumsum(many) - many
    if len(many):
        before = np.append(0, doc)[start]
        doc = doc - np.repeat(before, many)
    return first, key >> WORD_BITS, key & WORD_MASK, many, doc


COLUMNS = "lang string, shard int, kind int, block long, n_docs int, a binary, b binary, c binary, d binary, learnt binary"


def pair_rows(docs: DataFrame, scored: bool, shards: int) -> DataFrame:
    """Blobs of the pairs of texts, and (if ``scored``) as rows of kind ``DOCS`` the
    documents. ``docs``: id (text), lang, content, text, learnt."""
    names = [x.split()[0] for x in COLUMNS.split(", ")] + ["ids"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), *[pa.binary()] * 5, pa.list_(pa.string())]
        block = TaskContext.get().partitionId() << 32
        held: dict[str, list[tuple[np.ndarray, ...]]] = {}
        known: dict[str, list[tuple]] = {}  # of the documents of this block
        pairs = 0

        def out(rows: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*rows))
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal pairs, block
            for lang in list(held):
                learnt = np.array([x[3] for x in known[lang]])
                first, second, doc = ring(*(np.concatenate(x) for x in zip(*held.pop(lang))), len(learnt))
                flags = squeeze(np.packbits(learnt)) if learnt.any() else None
                for i in range(0, len(first), 2 * BLOCK_PAIRS):  # one long text may hold more than a block
                    part = slice(i, i + 2 * BLOCK_PAIRS)
                    rows = [(lang, s, ASKED if scored else LEARNT, block, len(learnt), *blob, flags, None) for s, *blob in _blobs(first[part], second[part], doc[part], shards)]
                    for at in range(0, len(rows), 16):
                        yield out(rows[at : at + 16])
            for lang, rows in known.items() if scored else ():
                ids, contents, sizes, _ = zip(*rows)
                yield out([(lang, -1 - block % 65521, DOCS, block, len(ids), squeeze(np.array(contents, np.int64)), squeeze(np.array(sizes, np.int64)), None, None, None, list(ids))])
            known.clear()
            pairs, block = 0, block + 1

        for b in batches:
            text = b.column("text")
            langs, contents = b.column("lang").to_pylist(), b.column("content").to_pylist()
            ids, learnt = b.column("id").to_pylist(), b.column("learnt").to_pylist()
            for lo, hi, keys, doc in word_keys(text):  # documents lo .. hi - 1, in order
                base = 0
                begin = np.searchsorted(doc, np.arange(lo, hi + 1))
                while lo + base < hi:
                    # As many documents as the block still takes, one at least.
                    room = BLOCK_DOCS - sum(map(len, known.values()))
                    stop = int(np.searchsorted(begin, begin[base] + max(BLOCK_PAIRS - pairs, 0), "right")) - 1
                    to = max(base + 1, min(hi - lo, base + room, stop))
                    by_lang: dict[str, list[int]] = {}
                    for i in range(lo + base, lo + to):
                        by_lang.setdefault(langs[i], []).append(i)
                    for lang, which in by_lang.items():
                        rows = known.setdefault(lang, [])
                        at = len(rows)
                        size = np.array([begin[i - lo + 1] - begin[i - lo] for i in which])
                        take = np.concatenate([np.arange(begin[i - lo], begin[i - lo + 1]) for i in which])
                        held.setdefault(lang, []).append((keys[take], np.repeat(np.arange(at, at + len(which), dtype=np.int32), size)))
                        rows += [(ids[i], contents[i], int(m), learnt[i]) for i, m in zip(which, size)]
                        pairs += len(take) + len(which)
                    base = to
                    if sum(map(len, known.values())) >= BLOCK_DOCS or pairs >= BLOCK_PAIRS:
                        yield from flush()
        if known:
            yield from flush()

    return docs.select("id", "lang", "content", "text", "learnt").mapInArrow(run, COLUMNS + ", ids array<string>")


# ------------------------------------------------------------------- counts


def _shard_counts(rows: pd.DataFrame) -> tuple[np.ndarray, ...]:
    """Different first words of a shard's learnt pairs, and of each different pair the
    place of its first word among them, its second word and its count."""
    parts = [(np.zeros(0, np.int64),) * 3]
    for x in rows[rows["learnt"].notna()].itertuples():
        first, place, second, many, doc = _pairs_of(x)
        flags = np.unpackbits(swell(x.learnt, np.uint8), count=x.n_docs).astype(np.int64)
        n = np.add.reduceat(flags[doc], np.cumsum(many) - many)
        use = n > 0
        parts.append((first[place[use]], second[use], n[use]))
    first, second, n = (np.concatenate(x) for x in zip(*parts))
    words, key = _numbered(first)
    key = (key << WORD_BITS) | second
    order = np.argsort(key)
    key, n = key[order], n[order]
    start = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, int)
    key = key[start]
    return words, key >> WORD_BITS, key & WORD_MASK, np.add.reduceat(n, start) if len(start) else n


STATS = ["n1", "n2", "n3", "n4", "m1", "m2", "m3", "m4", "types", "words", *[f"r{j}" for j in REPEATS]]


def _continuations(pairs: DataFrame, shards: int) -> DataFrame:
    """lang, shard, source, a, b: what each shard needs of the second words' numbers of
    first words (``source`` says from which shard, -1 for its own words as first words),
    and as source -2 the sums that ``STATS`` names."""

    def partial(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        words, place, second, n = _shard_counts(rows)
        out = []
        seen, many = np.unique(second, return_counts=True)
        for s, a, b in _parts(seen, shards):
            out.append((key[0], s, key[1], squeeze(_steps(seen[a:b])), squeeze(many[a:b].astype(np.uint32)), *[0] * 4))
        if out:
            out[0] = (*out[0][:5], *[int((n == j).sum()) for j in (1, 2, 3, 4)])
        return pd.DataFrame(out, columns=["lang", "shard", "source", "a", "b", "n1", "n2", "n3", "n4"])

    def total(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("source")
        seen = [np.cumsum(swell(a)) for a in rows["a"]]
        words, place = _numbered(np.concatenate(seen))
        n = np.bincount(place, np.concatenate([swell(b) for b in rows["b"]]), len(words)).astype(np.int64)
        ends = np.cumsum([len(x) for x in seen])
        out = [(key[0], int(s), int(key[1]), squeeze(n[place[e - len(x) : e]].astype(np.uint32)), None) for s, x, e in zip(rows["source"], seen, ends)]
        out.append((key[0], int(key[1]), -1, squeeze(n.astype(np.uint32)), squeeze(_steps(words))))
        got = pd.DataFrame(out, columns=["lang", "shard", "source", "a", "b"])
        sums = {f"n{j}": int(rows[f"n{j}"].sum()) for j in (1, 2, 3, 4)} | {f"m{j}": int((n == j).sum()) for j in (1, 2, 3, 4)}
        sums |= {"types": int(n.sum()), "words": len(words)}
        sums |= {f"r{j}": int(n[words == j].sum()) for j in REPEATS}
        for k, v in sums.items():
            got[k] = [v] + [0] * (len(got) - 1)
        return got

    sums_of = ", ".join(f"{k} long" for k in STATS)
    asked = pairs.groupBy("lang", "shard").applyInPandas(partial, "lang string, shard int, source int, a binary, b binary, n1 long, n2 long, n3 long, n4 long")
    told = asked.groupBy("lang", "shard").applyInPandas(total, f"lang string, shard int, source int, a binary, b binary, {sums_of}")
    sums = told.groupBy("lang").agg(*[F.sum(k).alias(k) for k in STATS])
    every = F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard")
    return told.drop(*STATS).unionByName(sums.select("*", every).withColumn("source", F.lit(-2)), allowMissingColumns=True)


def level_discounts(stats: dict) -> tuple[np.ndarray, np.ndarray, float, float]:
    """Discounts of pairs and of words, T, and the share of each of V + 1 places."""
    d, e = discounts([stats[f"n{j}"] for j in (1, 2, 3, 4)]), discounts([stats[f"m{j}"] for j in (1, 2, 3, 4)])
    many = stats["words"] - stats["m1"] - stats["m2"]
    types = max(float(stats["types"]), 1.0)
    spare = (e[1] * stats["m1"] + e[2] * stats["m2"] + e[3] * many) / types
    return d, e, types, spare / (stats["words"] + 1)


def _priced(pairs: DataFrame, told: DataFrame) -> DataFrame:
    """lang, block, n_docs, ids, content, sizes, costs: documents of a block, and the
    shards' sums of costs of its documents; costs are null in a language without model."""
    names = ["lang", "block", "n_docs", "ids", "content", "sizes", "costs"]

    def run(key: tuple, rows: pd.DataFrame, told_: pd.DataFrame) -> pd.DataFrame:
        out = []
        known = rows[rows["kind"] == DOCS]
        for x in known.itertuples():
            out.append((x.lang, x.block, x.n_docs, x.ids, x.a, x.b, None))
        asked = rows[rows["kind"] == ASKED]
        words, place, second, n = _shard_counts(rows)
        if len(asked) and len(told_):
            stats = told_[told_["source"] == -2].iloc[0].to_dict()
            d, e, types, place_share = level_discounts(stats)
            lower = lambda m: (m - e[np.minimum(m, 3)]) / types + place_share
            # Second words' numbers of first words, in the order in which they were sent.
            seen, at = np.unique(second, return_inverse=True)
            sent = told_[told_["source"] >= 0].sort_values("source")
            m = np.concatenate([swell(x) for x in sent["a"]]) if len(sent) else np.zeros(0, np.int64)
            assert len(m) == len(seen)
            p_second = lower(m)[at]
            # Every word that follows another here, and every first word here.
            own = told_[told_["source"] == -1]
            own_words = np.cumsum(swell(own["b"].iloc[0])) if len(own) else np.zeros(0, np.int64)
            own_m = swell(own["a"].iloc[0]) if len(own) else np.zeros(0, np.int64)
            c = np.bincount(place, n, len(words))
            spare = np.bincount(place, d[np.minimum(n, 3)], len(words)) / np.maximum(c, 1)
            everything = np.union1d(words, own_words)
            unknown = np.log(place_share)
            alone = np.full(len(everything), unknown)
            alone[np.searchsorted(everything, own_words)] = np.log(lower(own_m))
            price = alone.copy()
            price[np.searchsorted(everything, words)] += np.log(spare)
            repeat = np.log(lower(np.array([int(stats[f"r{j}"]) for j in REPEATS])))
            bonus = np.log1p((n - d[np.minimum(n, 3)]) / c[place] / (spare[place] * p_second)) if len(n) else np.zeros(0)
            pair = (place << WORD_BITS) | second
            for x in asked.itertuples():
                first, of, follower, many, doc = _pairs_of(x)
                i = np.minimum(np.searchsorted(everything, first), max(len(everything) - 1, 0))
                same = everything[i] == first if len(everything) else np.zeros(len(first), bool)
                base = np.full(len(first), unknown)
                base[same] = price[i[same]]
                j = np.minimum(np.searchsorted(words, first), max(len(words) - 1, 0))
                there = (words[j] == first) if len(words) else np.zeros(len(first), bool)
                value = base[of]
                again = np.flatnonzero((follower >= REPEATS[0]) & (follower <= REPEATS[-1]))
                value[again] += repeat[follower[again] - REPEATS[0]] - np.where(same, alone[i] if len(alone) else unknown, unknown)[of[again]]
                ask = np.flatnonzero(there[of])
                want = (j[of[ask]] << WORD_BITS) | follower[ask]
                k = np.minimum(np.searchsorted(pair, want), max(len(pair) - 1, 0))
                hit = pair[k] == want if len(pair) else np.zeros(len(want), bool)
                value[ask[hit]] += bonus[k[hit]]
                cost = np.bincount(doc, -np.repeat(value, many), x.n_docs)
                out.append((x.lang, x.block, x.n_docs, None, None, None, squeeze(cost.astype(np.float32))))
        return pd.DataFrame(out, columns=names)

    schema = "lang string, block long, n_docs int, ids array<string>, content binary, sizes binary, costs binary"
    return pairs.groupBy("lang", "shard").cogroup(told.groupBy("lang", "shard")).applyInPandas(run, schema)


def _collected(priced: DataFrame) -> DataFrame:
    """id (text), lang, content, n_words, cost (null without a model)."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        n = int(rows["n_docs"].max())
        cost, found = np.zeros(n), False
        known = rows[rows["ids"].notna()].iloc[0]
        for z in rows["costs"].dropna():
            part, found = swell(z, np.float32), True
            cost[: len(part)] += part
        return pd.DataFrame({
            "id": pd.Series(list(known["ids"]), dtype=object), "lang": key[1], "content": swell(known["content"]), "n_words": swell(known["sizes"]),
            "cost": cost if found else pd.Series([None] * n, dtype="float64"),
        })

    return priced.groupBy("block", "lang").applyInPandas(run, "id string, lang string, content long, n_words long, cost double")


# ------------------------------------------------------------------ scores


def costs(docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """id, lang, content, n_words, cost (nats of the whole text and its end) of every
    row. ``trusted``: column ``id``, all of them are learnt from."""
    rows = docs.select(
        F.col(id_col).cast("string").alias("id"), _language(lang_col).alias("lang"), content(id_col, text_col, lang_col).alias("content"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    )
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(4, -(-size // SHARD_BYTES))
    trusted = trusted.where("id IS NOT NULL").select(F.col("id").cast("string")).distinct()
    if trusted.count() <= BROADCAST_IDS:
        rows = rows.join(F.broadcast(trusted.withColumn("learnt", F.lit(True))), "id", "left")
        pairs = pair_rows(rows.withColumn("learnt", F.coalesce("learnt", F.lit(False))), True, shards)
    else:
        learnt = semi_join(rows, trusted, "id").withColumn("learnt", F.lit(True))
        pairs = pair_rows(rows.withColumn("learnt", F.lit(False)), True, shards).unionByName(pair_rows(learnt, False, shards))
    found = _collected(_priced(pairs, _continuations(pairs, shards)))
    return found.withColumn("id", F.col("id").cast(docs.schema[id_col].dataType))


def score(docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """id, lang, content, n_words, nats (of a word) and threshold (of the language) of
    every row; both are null in a language without held-out trusted text."""
    ids = trusted.where("id IS NOT NULL").select("id").distinct()
    every = cut(costs(docs, ids.where(~held_out()), id_col, text_col, lang_col))
    mean_of = (F.sum("cost") / F.sum(F.col("n_words") + 1)).alias("mean")
    apart = every.join(ids.where(held_out()), "id", "left_semi").where("cost IS NOT NULL")
    # A language may hold most of the rows.
    mean = hint_few(cut(apart.groupBy("lang").agg(mean_of)))
    nats = (F.col("cost") + PRIOR_WORDS * F.col("mean")) / (F.col("n_words") + 1 + PRIOR_WORDS)
    limits = apart.join(mean, "lang").groupBy("lang").agg(F.first("mean").alias("mean"), F.percentile_approx(nats, QUANTILE, 10_000).alias("threshold"))
    limits = hint_few(cut(limits))
    return every.join(limits, "lang", "left").select("id", "lang", "content", "n_words", nats.alias("nats"), "threshold")


def judge(docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``docs`` without the rejected ones. ``trusted``: column ``id``.

    Rows are rejected by their ``content`` hash; texts that surely are not rejected are
    not shuffled."""
    bad = score(docs, trusted, id_col, text_col, lang_col).where("nats > threshold")
    rows = docs.withColumn("__content", content(id_col, text_col, lang_col))
    return anti_join(rows, cut(bad.select(F.col("content").alias("__content")).distinct()), "__content").select(*[F.col(f"`{c}`") for c in docs.columns])
