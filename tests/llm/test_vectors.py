import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldtally.llm import ann, exact_topk

SCHEMA = "vec_id long, embedding array<float>, label int, id string, block string, vec string"


def vectors(spark, n=600, dim=16, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, dim)).astype(np.float32)
    x[n // 2 : n // 2 + 40] = x[0]  # a group of copies
    rows = [(i, v.tolist(), 0, "c", "c", "c") for i, v in enumerate(x)]
    bad = [(1000, None), (1001, [0.0] * dim), (1002, [float("nan")] * dim), (1003, [None] + [1.0] * (dim - 1)), (1004, [float("inf")] * dim), (None, [1.0] * dim), (1005, [])]
    rows += [(i, v, 0, "c", "c", "c") for i, v in bad] + [rows[3]]
    return spark.createDataFrame(rows, SCHEMA), x


def brute(ids, scores, own, k):
    ok = ids != own
    order = np.lexsort((ids[ok], -scores[ok]))[:k]
    return list(zip(ids[ok][order].tolist(), scores[ok][order].tolist()))


def test_exact_topk_equals_brute_force(spark):
    df, x = vectors(spark)
    got = exact_topk.exact_topk(df, F.col("id") % 30 == 0, k=7, scale=1024.0).collect()
    q = np.floor(1024 * x.astype(float))
    q = np.vstack([q, np.zeros((1, 16))])  # the zero vector takes part here
    ids = np.append(np.arange(600), 1001)
    by = {}
    for r in sorted(got, key=lambda r: (r["query_id"], r["rank"])):
        by.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    assert by == {i: brute(ids, q @ q[i], i, 7) for i in range(0, 600, 30)}


def test_exact_topk_small_and_empty(spark):
    df, _ = vectors(spark)
    few = df.where("vec_id < 3")
    assert exact_topk.exact_topk(few, F.col("id") == 0, k=10).count() == 2
    assert exact_topk.exact_topk(df.limit(0), F.col("id") == 0, k=10).count() == 0


def test_bounds_hold():
    rng = np.random.default_rng(0)
    x, q = rng.standard_normal((200, 8)), rng.standard_normal(8)
    p = exact_topk.choose_pivots(x[:50], 16)
    bound = np.abs(exact_topk.distances(x, p) - exact_topk.distances(q[None], p)).max(1)
    assert (bound <= np.linalg.norm(x - q, axis=1) + 1e-9).all()


def test_graph_recall_and_copies(spark):
    df, x = vectors(spark, 3000, 24)
    found = ann.search_index(ann.build_index(df, k=5), df, F.col("id") % 50 == 0, k=5).collect()
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1)[:, None]
    by = {}
    for r in sorted(found, key=lambda r: (r["query_id"], r["rank"])):
        by.setdefault(r["query_id"], []).append(r["vec_id"])
        assert r["score"] == pytest.approx(float(unit[r["vec_id"]] @ unit[r["query_id"]]), abs=1e-9)
    hits = sum(len(set(v) & {i for i, _ in brute(np.arange(3000), unit @ unit[q], q, 5)}) for q, v in by.items())
    assert len(by) == 60 and hits / 300 >= 0.9
    assert by[0] == [1500, 1501, 1502, 1503, 1504]  # copies, ties to smaller ids
    assert by[1500] == [0, 1501, 1502, 1503, 1504]


def test_graph_is_the_same_when_built_again():
    x = np.random.default_rng(2).standard_normal((500, 12)).astype(np.float32)
    a, b = (ann.build_graph(x, np.arange(500))[0] for _ in range(2))
    assert all((p == q).all() for p, q in zip(a.layers, b.layers))


def test_graph_empty(spark):
    df, _ = vectors(spark)
    assert ann.search_index(ann.build_index(df.limit(0), 5), df.limit(0), F.col("id") == 0, 5).count() == 0


def test_one_id_with_several_vectors(spark):
    rows = [(0, [3.0, 4.0]), (0, [1.0, 0.0]), (1, [2.0, 0.0]), (1, [0.0, 9.0]), (1, [2.0, 0.0]), (2, [1.0, 1.0]), (3, [0.5, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = exact_topk.exact_topk(df, F.col("id") == 0, k=3).collect()  # the least vector, (1, 0), asks
    assert [(r["vec_id"], r["score"]) for r in sorted(got, key=lambda r: r["rank"])] == [(1, 2.0), (2, 1.0), (3, 0.5)]
    near = ann.search_index(ann.build_index(df, 3), df, F.col("id") == 0, 3).collect()
    assert [r["vec_id"] for r in sorted(near, key=lambda r: r["rank"])] == [1, 3, 2]


def test_huge_and_tiny_components(spark):
    rows = [(0, [1e200, 0.0]), (1, [1e200, 1e200]), (2, [1e-200, 0.0]), (3, [-1e300, 1e300])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    near = ann.search_index(ann.build_index(df, 3), df, F.col("id") == 0, 3).collect()
    assert [(r["vec_id"], r["score"]) for r in sorted(near, key=lambda r: r["rank"])] == [(2, 1.0), (1, pytest.approx(0.5**0.5)), (3, pytest.approx(-(0.5**0.5)))]
    big = [(0, [2.0**31, 3.0]), (1, [2.0**30, 1.0]), (2, [2.0**30, 2.0]), (3, [1e200, 0.0]), (4, [-1.0, 0.0])]
    got = exact_topk.exact_topk(spark.createDataFrame(big, df.schema), F.col("id") == 0, k=4, scale=1.0).collect()
    assert [(r["vec_id"], r["score"]) for r in sorted(got, key=lambda r: r["rank"])] == [(3, None), (2, 2**61 + 6), (1, 2**61 + 3), (4, -(2**31))]


def test_very_long_vectors(spark):
    """Vectors of 50,000 components, whole and exact, beside short ones."""
    n = 50_000
    rows = [(0, [1.0] * n), (1, [1.0] * (n - 1) + [3.0]), (2, [-1.0] * n), (3, [1.0] * (n // 2) + [0.0] * (n // 2)), (4, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = exact_topk.exact_topk(df, F.col("id") == 0, k=5, scale=2.0).collect()
    assert [(r["vec_id"], r["score"]) for r in sorted(got, key=lambda r: r["rank"])] == [(1, 4 * n + 8), (3, 2 * n), (2, -4 * n)]
    near = ann.search_index(ann.build_index(df, 5), df, F.col("id") == 0, 5).collect()
    assert [r["vec_id"] for r in sorted(near, key=lambda r: r["rank"])] == [1, 3, 2]
