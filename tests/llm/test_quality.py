import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from fieldtally.llm import quality
from fieldtally.llm.queries import op6_quality, trusted_ids
from fieldtally.llm.wordhash import SLICE, word_keys

DOC = "doc_id long, text string, lang string"


def plain_words(text):
    return [w for w in re.split(r"[ \t\n\v\f\r]+", text or "") if w]


def plain_pairs(text):
    """First and second words of the ring, repeats told apart by the run before them."""
    words, out, run = ["<>", *plain_words(text), "<>"], [], 0
    for a, b in zip(words, words[1:]):
        run = run + 1 if a == b != "<>" else 0
        out.append((a, ("again", min(run, 3)) if run else b))
    return out


def plain_costs(texts, learnt):
    """Interpolated modified Kneser-Ney as in the textbook, without hashes or shards."""
    n = Counter(p for t in learnt for p in plain_pairs(t))
    if not n:
        return [None] * len(texts)
    before = Counter(w for _, w in n)
    first = Counter()
    for (h, _), k in n.items():
        first[h] += k
    of = lambda c: quality.discounts([sum(k == j for k in c.values()) for j in (1, 2, 3, 4)])
    d, e = of(n), of(before)
    types = sum(before.values())
    rest = sum(e[min(k, 3)] for k in before.values()) / types
    spare = Counter()
    for (h, _), k in n.items():
        spare[h] += d[min(k, 3)]

    def prob(h, w):
        low = (before[w] - e[min(before[w], 3)]) / types + rest / (len(before) + 1)
        return (n[h, w] - d[min(n[h, w], 3)]) / first[h] + spare[h] / first[h] * low if first[h] else low

    assert sum(prob("<>", w) for w in before) + prob("<>", "none") == pytest.approx(1.0)
    return [-sum(math.log(prob(h, w)) for h, w in plain_pairs(t)) for t in texts]


def check_costs(spark, rows, ids):
    trusted = spark.createDataFrame([(i,) for i in ids], "id long")
    got = quality.costs(spark.createDataFrame(rows, DOC).repartition(3), trusted).collect()
    assert len(got) == len(rows)
    want = {}
    for lang in {r[2] or "" for r in rows}:
        own = [r for r in rows if (r[2] or "") == lang]
        for r, c in zip(own, plain_costs([r[1] for r in own], [r[1] for r in own if r[0] in ids])):
            want[r[0], len(plain_words(r[1])), lang] = c
    for r in got:
        c = want[r["id"], r["n_words"], r["lang"]]
        assert r["cost"] == (c if c is None else pytest.approx(c, rel=1e-5)), r


def test_costs_equal_the_textbook(spark):
    texts = ["the cat sat on the mat .", "the dog sat on the mat .", "a dog and a cat and a mat !", "the the end", "no no no no no way", ""]
    rows = [(i, t, "en") for i, t in enumerate(texts)]
    rows += [(9, "the cat sat upon a mat mat mat mat mat", "en"), (9, "the cat sat upon a mat mat mat mat mat", "en"), (10, None, "en"), (11, "x", "zz"), (None, "the end", "en"), (12, "der Hund the", None), (13, "der Hund", None)]
    check_costs(spark, rows, {0, 1, 2, 3, 4, 5, 12})


def test_costs_do_not_depend_on_blocks_and_shards(spark, monkeypatch):
    """Blocks, shards and long texts cut into several blobs, on drawn texts."""
    rng = random.Random(3)
    draw = lambda k: " ".join(rng.choice("abcdefghij") * rng.choice((1, 1, 2)) for _ in range(k))
    rows = [(i, draw(rng.choice((0, 1, 5, 40, 700))), rng.choice(("en", "de", None))) for i in range(90)]
    for name, value in (("BLOCK_PAIRS", 300), ("BLOCK_DOCS", 7), ("SHARD_BYTES", 2000)):
        monkeypatch.setattr(quality, name, value)
    check_costs(spark, rows, set(range(0, 90, 2)))
    monkeypatch.setattr(quality, "BROADCAST_IDS", 0)  # ids of trusted texts go another way
    check_costs(spark, rows, set(range(0, 90, 2)))


def test_word_keys_equal_plain_words():
    rng = random.Random(5)
    long = " ".join("w" * rng.randrange(1, 30) + str(rng.randrange(500)) for _ in range(SLICE // 12))
    texts = ["a b  a", "", "a", "\n", "é\u00a0x é\u00a0x", "x" * (SLICE + 50) + " y " + "x" * (SLICE + 50), long, "b", long + " a", ""]
    known, seen = {}, 0
    for array in (pa.array(texts), pa.array(["skipped", *texts], pa.large_string())[1:]):
        for lo, hi, keys, doc in word_keys(array):
            for i in range(lo, hi):
                mine, words = keys[doc == i].tolist(), plain_words(texts[i])
                assert len(mine) == len(words)
                for w, k in zip(words, mine):
                    assert known.setdefault(w, k) == k and k >= 5
                seen += 1
    assert seen == 2 * len(texts) and len(set(known.values())) == len(known)


def test_squeeze_round_trip():
    for x in (np.array([0, 1, -5, 1 << 60]), np.zeros(0, np.int64), np.arange(300, dtype=np.uint16), np.array([3, 1 << 31], np.uint32)):
        assert (quality.swell(quality.squeeze(x)) == x).all()
    f = np.array([0.5, -1e9], np.float32)
    assert (quality.swell(quality.squeeze(f), np.float32) == f).all()


def test_thresholds_and_keep_equal_the_textbook(spark, data):
    """The whole query, with thresholds, on the given table."""
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text", "lang").collect()
    good = trusted_ids(spark, data).withColumn("apart", quality.held_out()).collect()
    apart = {r["id"]: r["apart"] for r in good}
    cost, size = {}, {r["doc_id"]: len(plain_words(r["text"])) + 1 for r in docs}
    for lang in {r["lang"] for r in docs}:
        own = [r for r in docs if r["lang"] == lang]
        cost |= dict(zip([r["doc_id"] for r in own], plain_costs([r["text"] for r in own], [r["text"] for r in own if apart.get(r["doc_id"]) is False])))
    got = {r["doc_id"]: r for r in op6_quality(spark, data).collect()}
    assert len(got) == len(docs)
    for lang in {r["lang"] for r in docs}:
        ids = [r["doc_id"] for r in docs if r["lang"] == lang]
        out = [i for i in ids if apart.get(i)]
        mean = sum(cost[i] for i in out) / sum(size[i] for i in out)
        nats = {i: (cost[i] + quality.PRIOR_WORDS * mean) / (size[i] + quality.PRIOR_WORDS) for i in ids}
        limit = sorted(nats[i] for i in out)[math.ceil(quality.QUANTILE * len(out)) - 1]
        for i in ids:
            assert math.log(got[i]["perplexity"]) == pytest.approx(nats[i], rel=1e-5)
            assert math.log(got[i]["threshold"]) == pytest.approx(limit, rel=1e-5)
            if abs(nats[i] - limit) > 1e-4 * limit:
                assert got[i]["keep"] == int(nats[i] <= limit)


def test_judge_odd_rows(spark, odd_docs, no_docs):
    kept = quality.judge(odd_docs, spark.createDataFrame([(i,) for i in (*range(9), None)], "id long"))
    assert kept.columns == odd_docs.columns and kept.count() >= 5
    assert quality.judge(no_docs, spark.createDataFrame([], "id long")).count() == 0
    untrained = quality.judge(odd_docs, spark.createDataFrame([], "id long"))
    assert untrained.count() == odd_docs.count()


def test_words_keep_their_identity(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text", "lang")
    trusted = spark.read.parquet(f"{data}/labels.parquet").where("quality = 1").select(F.col("doc_id").alias("id")).distinct()
    rng = random.Random(1)
    junk = [(-1 - i, " ".join("".join(rng.choice("bcdfghjklmnpqrstvwxz") for _ in range(rng.randrange(2, 9))) for _ in range(200)), "en") for i in range(20)]
    kept = quality.judge(docs.union(spark.createDataFrame(junk, DOC)), trusted)
    assert kept.where("doc_id < 0").count() == 0
    assert kept.join(trusted, kept["doc_id"] == trusted["id"], "left_semi").count() == trusted.count()
