import numpy as np
import pandas as pd
import pytest

from fieldtally.llm import permutations

SCHEMA = "vec_id long, embedding array<float>, label int, id string, node string, vec string, ball string, dim string, lab string"
EXTRA = ("c",) * 6


def near(x, cosine, rng):
    """Unit vectors at ``cosine`` from the unit vectors ``x``."""
    z = rng.standard_normal(x.shape)
    z -= (z * x).sum(1)[:, None] * x
    return cosine * x + np.sqrt(1 - cosine**2) * z / np.linalg.norm(z, axis=1)[:, None]


def sample(n=900, dim=32, seed=3):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, dim))
    x /= np.linalg.norm(x, axis=1)[:, None]
    border = near(x[:200], 0.9305, rng)
    chain = near(border[:80], 0.95, rng)
    tight = near(np.repeat(x[5:6], 300, 0), 0.995, rng)  # one ball
    wide = near(np.repeat(x[6:7], 120, 0), 0.966, rng)  # some linked, some not
    copies = np.repeat(x[7:8], 150, 0)
    all_ = np.vstack([x, border, chain, tight, wide, copies]).astype(np.float32)
    label = np.concatenate([rng.integers(0, 2, n), np.zeros(len(all_) - n, int)])
    label[:200] = 0
    return all_, label


def brute(x, label):
    u = x.astype(float)
    u /= np.linalg.norm(u, axis=1)[:, None]
    linked = (u @ u.T >= 0.93) & (label[:, None] == label)
    np.fill_diagonal(linked, False)
    root = np.arange(len(x))
    while True:
        new = np.array([min(root[i], root[np.flatnonzero(row)].min(initial=len(x))) for i, row in enumerate(linked)])
        if (new == root).all():
            return linked, root
        root = new


@pytest.mark.parametrize("block", [64, 1024])
def test_links_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(permutations, "BLOCK", block)
    x, label = sample()
    rows = [(i, v.tolist(), int(l), *EXTRA) for i, (v, l) in enumerate(zip(x, label))]
    got = permutations.similar_links(spark.createDataFrame(rows, SCHEMA), pivots=64).toPandas().set_index("vec_id").sort_index()
    linked, root = brute(x, label)
    assert (got["n_links"].to_numpy() == linked.sum(1)).all()
    assert (got["component_id"].to_numpy() == root).all()
    assert (got["kept"] == (got["component_id"] == got.index)).all()


@pytest.mark.parametrize("count", [256, 1024, 2048])
def test_recall_of_shared_pivots_at_the_threshold(count):
    rng = np.random.default_rng(count)
    for dim in (16, 64, 256):
        x = permutations.unit(rng.standard_normal((4096, dim)))
        pivots = permutations.choose_pivots(x, count, 0.98)
        a = permutations.nearest(x[:1500], pivots)[0]
        b = permutations.nearest(near(x[:1500], 0.93, rng), pivots)[0]
        shared = [len(np.intersect1d(p, q)) for p, q in zip(a, b)]
        assert np.mean(np.array(shared) >= permutations.SHARED) >= 0.99


def test_balls_hold_only_linked_vectors():
    rng = np.random.default_rng(4)
    pivot = permutations.unit(rng.standard_normal((1, 24)))
    half = np.cos(np.arccos(0.93) / 2)
    ball = permutations.unit(near(np.repeat(pivot, 800, 0), half + 2e-6, rng))
    assert (ball @ ball.T).min() >= 0.93


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, [1.0, 0.0], 0), (2, [2.0, 0.0], 0), (2, [2.0, 0.0], 0), (3, [1.0, 0.0], 1), (4, [1.0, 0.0], None), (5, None, 0), (6, [], 0), (7, [0.0, 0.0], 0),
        (8, [nan, 1.0], 0), (9, [inf, 1.0], 0), (10, [None, 1.0], 0), (None, [1.0, 0.0], 0), (None, [1.0, 0.0], 7), (11, [1.0, 0.0, 0.0], 0), (12, [0.0, -1.0], 0),
        ((1 << 60) + 1, [1e-30, 3.0], 2), ((1 << 60) + 3, [1e30, 3e38], 2), (13, [1.0] * 70_000, 3), (14, [2.0] * 70_000, 3),
    ]
    df = spark.createDataFrame([(*r, *EXTRA) for r in rows], SCHEMA)
    got = sorted(((r[0] if r[0] is not None else -1, r[1], r[2] if r[2] is not None else -1, r[3]) for r in permutations.similar_links(df).collect()))
    alone = [(i, 0, i, True) for i in (3, 4, 5, 6, 7, 8, 9, 10, 11, 12)]
    want = [(1, 3, 1, True), (2, 3, 1, False), (2, 3, 1, False), (-1, 3, 1, False), (-1, 0, -1, True), *alone, (13, 1, 13, True), (14, 1, 13, False)]
    want += [((1 << 60) + 1, 1, (1 << 60) + 1, True), ((1 << 60) + 3, 1, (1 << 60) + 1, False)]
    assert got == sorted(want)
    assert permutations.similar_links(df.limit(0)).count() == 0


def test_given_vectors(spark, data):
    """Recall of links on the given table, with few pivots so that lists are short."""
    df = spark.read.parquet(f"{data}/embeddings.parquet")
    pdf = df.toPandas()
    x = np.stack(pdf["embedding"].to_list())
    linked, _ = brute(x, pdf["label"].to_numpy())
    got = permutations.similar_links(df, pivots=64).toPandas()
    assert pd.Series(linked.sum(1), pdf["vec_id"]).sort_index().tolist() == got.set_index("vec_id")["n_links"].sort_index().tolist()
