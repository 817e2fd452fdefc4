import hashlib
import random
import zlib

import pytest

from fieldtally.llm import periodic


def brute(w):
    """Every run by its definition, a period at a time."""
    out = []
    for q in range(1, len(w) // 3 + 1):
        i = 0
        while i + q < len(w):
            if w[i] != w[i + q]:
                i += 1
                continue
            s = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            n = i - s + q
            if n >= max(24, 3 * q) and not any(all(w[k] == w[k + r] for k in range(s, s + n - r)) for r in range(1, q)):
                out.append((s, n, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def some_words(rng, most=150):
    letters, n, w = "abcdefgh"[: rng.choice([1, 2, 3, 5])], rng.randint(0, most), []
    while len(w) < n:
        block = [rng.choice(letters) for _ in range(rng.randint(1, 14))]
        w += (block * 30)[: rng.randint(10, 80)] if w and rng.random() < 0.3 else block[:1]
    return w


def test_runs_equal_brute_force():
    rng, found = random.Random(1), 0
    for _ in range(1500):
        w = some_words(rng)
        runs = periodic.find_runs([x.encode() for x in w])
        assert runs == brute(w)
        found += len(runs)
    assert found > 500


@pytest.mark.parametrize("words", [["x"] * 60_000, [f"w{i % 37}" for i in range(60_000)], [f"w{i % 30_000}" for i in range(60_000)]])
def test_long_texts(words):
    period = len(set(words))
    want = [(0, 60_000, period)] if 3 * period <= 60_000 else []
    assert periodic.find_runs([w.encode() for w in words]) == want


def expected(doc_id, text):
    w = (text or "").encode().split()
    if doc_id is not None and w:
        h = zlib.crc32(str(doc_id).encode())
        if h % 10 == 0:
            g, n = h // 10, len(w)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs, gone = brute(w), set()
    for s, n, q in runs:
        gone |= set(range(s + q, s + n))
    best = max(runs, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=(None, None, None))
    listed = "".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()
    kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
    return (len(runs), *best, 1000 * best[1] // best[2] if runs else None, hashlib.sha256(listed).hexdigest(), hashlib.sha256(kept).hexdigest())


def test_planted_runs_of_documents(spark, odd_docs, no_docs):
    rng = random.Random(9)
    rows = [(i, rng.choice([" ", "\n", " \t"]).join(some_words(rng)), "en", "a", 0) for i in range(300)]
    rows += [(400 + i, t, None, None, None) for i, t in enumerate([None, "", " \n", "one", "a\x1cb a\x85b", "ñ " * 40])]
    rows += [((1 << 60) + 1, "z " * 30, "en", "a", 1), (None, "y " * 30, "en", "a", 1)]
    df = spark.createDataFrame(rows, no_docs.schema)
    got = {r[0]: tuple(r[1:]) for r in periodic.periodic_runs(periodic.with_planted_runs(df)).collect()}
    assert got == {r[0]: expected(r[0], r[1]) for r in rows}
    assert sum(r[0] > 0 for r in got.values()) > 40
    odd = periodic.periodic_runs(periodic.with_planted_runs(odd_docs), texts=True).toPandas()
    assert len(odd) == odd_docs.count() and odd.loc[odd["doc_id"] == 3, "collapsed"].tolist() == [None]
    assert periodic.periodic_runs(periodic.with_planted_runs(no_docs)).count() == 0


def test_texts_and_spans(spark):
    df = spark.createDataFrame([(1, "start " + "a b c " * 10 + "end")], "doc_id long, text string")
    r = periodic.periodic_runs(df, texts=True).first()
    assert [tuple(x) for x in r["runs"]] == [(1, 30, 3)] and r["collapsed"] == "start a b c end"


def test_given_documents(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").where("length(text) < 3000")
    got = {r[0]: tuple(r[1:]) for r in periodic.periodic_runs(periodic.with_planted_runs(docs)).collect()}
    assert got == {r["doc_id"]: expected(r["doc_id"], r["text"]) for r in docs.collect()}
