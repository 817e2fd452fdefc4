"""A bidirectional gated recurrent network with attention pooling, in numpy.

A word's input is its own vector (by hash of the word) beside the mean of the
vectors of its character 3- and 4-grams, word ends included (by hash as well).
Both directions read a window; attention weighs their states; a logistic unit
gives the window's score.
"""

from __future__ import annotations

import re
import zlib

import numpy as np

WORD_BUCKETS, CHAR_BUCKETS = 8192, 16384
WORD_DIM, CHAR_DIM, HIDDEN, ATTEND = 8, 16, 8, 8
WINDOW, STRIDE = 48, 24
DROP_WORDS, DROP_GRAMS, MIN_DOCS = 0.5, 0.3, 4
FIRST_WINDOWS, EPOCH_WINDOWS = 6000, 1500
_WORD = re.compile(r"\w+")


def words_of(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def windows_of(n: int) -> list[int]:
    """Where the windows of ``n`` words begin: each overlaps the next, the last
    ends with the text."""
    if n <= WINDOW:
        return [0]
    return [*range(0, n - WINDOW, STRIDE), n - WINDOW]


def char_grams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(owner, bucket) of all character 3- and 4-grams of ``<word>``."""
    flat = np.frombuffer("".join(f"<{w}>" for w in words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    size = np.fromiter((len(w) + 2 for w in words), np.int64, len(words))
    owner = np.repeat(np.arange(len(words)), size)
    owners, buckets = [], []
    for k in (3, 4):
        if len(flat) < k:
            continue
        h = np.full(len(flat) - k + 1, k, np.uint64)
        for j in range(k):
            h = (h * np.uint64(0x9E3779B1) + flat[j : len(flat) - k + 1 + j]) & np.uint64(0xFFFFFFFF)
        h ^= h >> np.uint64(15)
        inside = owner[: len(h)] == owner[k - 1 :]
        owners.append(owner[: len(h)][inside])
        buckets.append((h[inside] % np.uint64(CHAR_BUCKETS)).astype(np.int64))
    if not owners:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(owners), np.concatenate(buckets)


def word_buckets(words: list[str]) -> np.ndarray:
    return np.fromiter((zlib.crc32(w.encode("utf-8", "surrogatepass")) % WORD_BUCKETS for w in words), np.int64, len(words))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return np.float32(0.5) * np.tanh(np.float32(0.5) * x) + np.float32(0.5)


def new_params(seed: int) -> dict[str, np.ndarray]:
    r = np.random.default_rng(seed)
    d, h = WORD_DIM + CHAR_DIM, HIDDEN
    make = lambda scale, *shape: (r.standard_normal(shape) * scale).astype(np.float32)
    return {
        "word": make(0.1, WORD_BUCKETS, WORD_DIM), "char": make(0.3, CHAR_BUCKETS, CHAR_DIM),
        "wx": make(d**-0.5, 2, d, 3 * h), "bx": np.zeros((2, 1, 3 * h), np.float32), "u": make(h**-0.5, 2, h, 3 * h),
        "att": make((2 * h) ** -0.5, 2 * h, ATTEND), "att_b": np.zeros(ATTEND, np.float32), "att_v": make(ATTEND**-0.5, ATTEND),
        "out": make((2 * h) ** -0.5, 2 * h), "out_b": np.zeros(1, np.float32),
    }


def word_inputs(p: dict, words: list[str]) -> np.ndarray:
    owner, bucket = char_grams(words)
    count = np.bincount(owner, minlength=len(words))
    start = np.cumsum(count) - count
    order = np.argsort(owner, kind="stable")
    char = np.add.reduceat(p["char"][bucket[order]], start, axis=0) / count[:, None]
    return np.hstack([p["word"][word_buckets(words)], char]).astype(np.float32)


def project(p: dict, x: np.ndarray) -> np.ndarray:
    """Inputs of both directions' gates, (2, words, 3 * HIDDEN)."""
    return x @ p["wx"] + p["bx"]


def forward(p: dict, gates: np.ndarray, index: np.ndarray, length: np.ndarray, keep: bool = False):
    """Scores of windows (rows of ``index`` into ``gates``); row 0 of gates is padding.
    ``keep`` returns what ``backward`` needs as well."""
    n, w, h = len(index), index.shape[1], HIDDEN
    padded = bool((length < w).any())
    state = np.zeros((2, n, h), np.float32)
    states = np.zeros((w, 2, n, h), np.float32)
    trace = []
    for t in range(w):
        x = np.stack([gates[0, index[:, t]], gates[1, index[:, w - 1 - t]]])
        rec = state @ p["u"]
        zr = _sigmoid(x[:, :, : 2 * h] + rec[:, :, : 2 * h])
        z, r = zr[:, :, :h], zr[:, :, h:]
        cand = np.tanh(x[:, :, 2 * h :] + r * rec[:, :, 2 * h :])
        new = cand + z * (state - cand)
        live = None
        if padded:
            live = np.stack([t < length, w - 1 - t < length])[:, :, None].astype(np.float32)
            new = new * live
        if keep:
            trace.append((state, z, r, cand, rec[:, :, 2 * h :], live))
        state = new
        states[t] = new
    both = np.concatenate([states[:, 0], states[::-1, 1]], axis=2)  # (w, n, 2h)
    u = np.tanh(both @ p["att"] + p["att_b"])
    e = u @ p["att_v"]
    if padded:
        e = np.where(np.arange(w)[:, None] < np.maximum(length, 1), e, np.float32(-1e9))
    e = np.exp(e - e.max(0))
    alpha = e / e.sum(0)
    pooled = np.einsum("wn,wnh->nh", alpha, both)
    score = _sigmoid(pooled @ p["out"] + p["out_b"])
    return (score, (trace, both, u, alpha, pooled)) if keep else score


def backward(p: dict, index: np.ndarray, kept, d_logit: np.ndarray) -> tuple[dict, np.ndarray]:
    """Gradients of the parameters, and of the gates of each place (2, n, w, 3h)."""
    trace, both, u, alpha, pooled = kept
    w, n, _ = both.shape
    h = HIDDEN
    g = {"out": pooled.T @ d_logit, "out_b": np.array([d_logit.sum()], np.float32)}
    d_pooled = d_logit[:, None] * p["out"]
    d_both = alpha[:, :, None] * d_pooled
    d_alpha = np.einsum("wnh,nh->wn", both, d_pooled)
    d_e = alpha * (d_alpha - (alpha * d_alpha).sum(0))
    g["att_v"] = np.einsum("wn,wnk->k", d_e, u)
    d_u = d_e[:, :, None] * p["att_v"] * (1 - u**2)
    g["att"], g["att_b"] = np.einsum("wnh,wnk->hk", both, d_u), d_u.sum((0, 1))
    d_both = d_both + d_u @ p["att"].T
    d_states = np.stack([d_both[:, :, :h], d_both[::-1, :, h:]], axis=1)  # (t, 2, n, h) in reading order
    d_gates = np.zeros((2, n, w, 3 * h), np.float32)
    g["u"] = np.zeros_like(p["u"])
    carry = np.zeros((2, n, h), np.float32)
    ut = p["u"].transpose(0, 2, 1)
    for t in range(w - 1, -1, -1):
        state, z, r, cand, rec_c, live = trace[t]
        d = carry + d_states[t]
        if live is not None:
            d = d * live
        d_cand = d * (1 - z) * (1 - cand**2)
        d_z = d * (state - cand) * z * (1 - z)
        d_r = d_cand * rec_c * r * (1 - r)
        d_rec = np.concatenate([d_z, d_r, d_cand * r], axis=2)
        d_in = np.concatenate([d_z, d_r, d_cand], axis=2)
        g["u"] += state.transpose(0, 2, 1) @ d_rec
        carry = d * z + d_rec @ ut
        d_gates[0, :, t], d_gates[1, :, w - 1 - t] = d_in[0], d_in[1]
    return g, d_gates


class Adam:
    def __init__(self, p: dict, rate: float):
        self.rate, self.t = rate, 0
        self.m = {k: np.zeros_like(v) for k, v in p.items()}
        self.v = {k: np.zeros_like(v) for k, v in p.items()}

    def step(self, p: dict, g: dict) -> None:
        self.t += 1
        rate = self.rate * np.sqrt(1 - 0.999**self.t) / (1 - 0.9**self.t)
        for k, d in g.items():
            rows = slice(None)
            if isinstance(d, tuple):  # only these rows have gradients
                rows, d = d
            m, v = self.m[k], self.v[k]
            m[rows] = 0.9 * m[rows] + 0.1 * d
            v[rows] = 0.999 * v[rows] + 0.001 * d * d
            p[k][rows] -= (rate * m[rows] / (np.sqrt(v[rows]) + 1e-8)).astype(np.float32)


def _sum_rows(rows: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(rows, kind="stable")
    rows = rows[order]
    start = np.flatnonzero(np.append(True, rows[1:] != rows[:-1]))
    return rows[start], np.add.reduceat(values[order], start, axis=0)


def windows(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Document, and first word in it, of all windows of documents of ``sizes`` words."""
    begins = [windows_of(int(n)) for n in sizes]
    return np.repeat(np.arange(len(sizes)), [len(b) for b in begins]), np.array([x for b in begins for x in b], np.int64)


def train(vocabulary: list[str], texts: list[np.ndarray], labels: np.ndarray, seed: int = 7, epochs: int = 8, batch: int = 128, rate: float = 0.01) -> dict:
    """Parameters from documents (words as places in ``vocabulary``) and their labels.

    A document is toxic if one of its windows is. The first epoch takes windows of
    short documents under their document's label; later ones score all windows, and take
    the most toxic one of each toxic document and, of the others, the highest-scored
    windows and as many more.
    """
    p, rng = new_params(seed), np.random.default_rng(seed)
    size = np.array([len(t) for t in texts])
    docs, begin = windows(size)
    length = np.minimum(size[docs], WINDOW)
    flat = np.append(np.concatenate(texts), np.zeros(WINDOW, np.int64)).astype(np.int32)
    index = np.zeros((len(docs), WINDOW), np.int32)  # row 0 is padding
    base = (np.cumsum(size) - size)[docs] + begin
    for i in range(WINDOW):
        index[:, i] = np.where(i < length, flat[base + i] + 1, 0)
    n_words = len(vocabulary)
    owner, bucket = char_grams(vocabulary)
    order = np.argsort(owner, kind="stable")
    bucket = bucket[order]
    count = np.bincount(owner, minlength=n_words)
    start = np.cumsum(count) - count
    w_bucket = word_buckets(vocabulary)

    def grams_of(v: np.ndarray) -> np.ndarray:
        c = count[v]
        return bucket[np.repeat(start[v], c) + np.arange(c.sum()) - np.repeat(np.cumsum(c) - c, c)]

    # What fewer than MIN_DOCS documents hold is left out: it could only be learnt by heart.
    docs_of_word, docs_of_gram = np.zeros(WORD_BUCKETS, np.int64), np.zeros(CHAR_BUCKETS, np.int64)
    for t in texts:
        v = np.unique(t)
        docs_of_word[np.unique(w_bucket[v])] += 1
        docs_of_gram[np.unique(grams_of(v))] += 1
    word_ok, gram_ok = docs_of_word >= MIN_DOCS, docs_of_gram >= MIN_DOCS
    p["word"][~word_ok] = 0
    p["char"][~gram_ok] = 0
    adam = Adam(p, rate)
    many = np.bincount(docs)

    def inputs(v: np.ndarray, drop: bool = False):
        """Input vectors of vocabulary rows ``v``, their grams, the grams' owners, and
        what of the words and grams was kept: dropping some keeps the network from
        learning single rare words by heart."""
        c = count[v]
        own = np.repeat(np.arange(len(v)), c)
        grams = grams_of(v)
        keep_w = (rng.random((len(v), 1)) >= (DROP_WORDS if drop else 0)).astype(np.float32)
        keep_g = (rng.random((len(grams), 1)) >= (DROP_GRAMS if drop else 0)).astype(np.float32)
        keep_w *= word_ok[w_bucket[v], None]
        keep_g *= gram_ok[grams, None]
        scale = np.float32(1 if drop else 1 - DROP_WORDS), np.float32(1 if drop else 1 - DROP_GRAMS)
        char = np.add.reduceat(p["char"][grams] * keep_g, np.cumsum(c) - c, axis=0) / c[:, None]
        return np.hstack([p["word"][w_bucket[v]] * keep_w * scale[0], char * scale[1]]).astype(np.float32), grams, own, keep_w, keep_g

    def scores() -> np.ndarray:
        gates = np.zeros((2, n_words + 1, 3 * HIDDEN), np.float32)
        gates[:, 0] = p["bx"][:, 0]
        for i in range(0, n_words, 50_000):
            v = np.arange(i, min(i + 50_000, n_words))
            gates[:, i + 1 : i + 1 + len(v)] = project(p, inputs(v)[0])
        return np.concatenate([forward(p, gates, index[i : i + 2048], length[i : i + 2048]) for i in range(0, len(index), 2048)])

    for epoch in range(epochs):
        adam.rate = rate * (1 if epoch < epochs - 3 else 0.3)
        if epoch < 1:
            short = np.flatnonzero(many[docs] <= 4)
            use = rng.permutation(short if len(short) else len(docs))[:FIRST_WINDOWS]
            use = np.tile(use, -(-EPOCH_WINDOWS // max(1, len(use))))[: max(len(use), EPOCH_WINDOWS)]
            y = labels[docs[use]].astype(np.float32)
        else:
            s = scores()
            best = np.lexsort((-s, docs))
            first = best[np.flatnonzero(np.append(True, docs[best][1:] != docs[best][:-1]))]
            positive = first[labels[docs[first]] == 1]
            clean = np.flatnonzero(labels[docs] == 0)
            positive = np.tile(positive, -(-EPOCH_WINDOWS // max(1, len(positive))))[: max(EPOCH_WINDOWS, len(positive))]
            hard = clean[np.argsort(-s[clean], kind="stable")[: len(positive)]]
            other = rng.choice(clean, min(len(clean), len(positive)), replace=False)
            negative = np.union1d(hard, other)
            use = np.concatenate([positive, negative])
            y = np.concatenate([np.ones(len(positive)), np.zeros(len(negative))]).astype(np.float32)
        mix = rng.permutation(len(use))
        for i in range(0, len(use), batch):
            k = use[mix[i : i + batch]]
            target = y[mix[i : i + batch]]
            rows, local = np.unique(index[k], return_inverse=True)
            local = local.reshape(len(k), WINDOW)
            pad = rows[0] == 0
            if not pad:
                rows, local = np.append(0, rows), local + 1
            v = rows[1:] - 1
            if not len(v):
                continue
            x, grams, own, keep_w, keep_g = inputs(v, drop=True)
            x0 = np.vstack([np.zeros((1, x.shape[1]), np.float32), x])
            score, kept = forward(p, project(p, x0), local, length[k], keep=True)
            g, d_gates = backward(p, local, kept, ((score - target) / len(k)).astype(np.float32))
            flat = local.ravel()
            summed = [np.zeros((len(rows), 3 * HIDDEN), np.float32) for _ in range(2)]
            for d in range(2):
                r, total = _sum_rows(flat, d_gates[d].reshape(-1, 3 * HIDDEN))
                summed[d][r] = total
            g["wx"] = np.stack([x0.T @ s for s in summed])
            g["bx"] = np.stack([s.sum(0, keepdims=True) for s in summed])
            d_x = (summed[0] @ p["wx"][0].T + summed[1] @ p["wx"][1].T)[1:]
            g["word"] = _sum_rows(w_bucket[v], d_x[:, :WORD_DIM] * keep_w)
            g["char"] = _sum_rows(grams, (d_x[:, WORD_DIM:] / count[v][:, None])[own] * keep_g)
            norm = np.sqrt(sum(float((d[1] if isinstance(d, tuple) else d).astype(np.float64).ravel() @ (d[1] if isinstance(d, tuple) else d).ravel()) for d in g.values()))
            if norm > 1:
                g = {a: (d[0], d[1] / norm) if isinstance(d, tuple) else d / norm for a, d in g.items()}
            adam.step(p, g)
    p["word"] *= np.float32(1 - DROP_WORDS)
    p["char"] *= np.float32(1 - DROP_GRAMS)
    return p


class Scorer:
    """Scores whole texts; the gates' inputs of a word are computed once per worker."""

    CACHE_WORDS = 250_000

    def __init__(self, p: dict):
        self.p = p
        self._clear()

    def _clear(self) -> None:
        self.rows: dict[str, int] = {}
        self.gates = np.zeros((2, 1 << 16, 3 * HIDDEN), np.float32)
        self.gates[:, 0] = project(self.p, np.zeros((1, WORD_DIM + CHAR_DIM), np.float32))[:, 0]

    def _learn(self, words: list[str]) -> None:
        for at in range(0, len(words), 50_000):
            part = words[at : at + 50_000]
            first = len(self.rows) + 1
            while first + len(part) > self.gates.shape[1]:
                self.gates = np.concatenate([self.gates, np.zeros_like(self.gates)], axis=1)
            self.gates[:, first : first + len(part)] = project(self.p, word_inputs(self.p, part))
            self.rows.update(zip(part, range(first, first + len(part))))

    def score(self, texts: list[str | None]) -> np.ndarray:
        """The largest score over all windows of each text."""
        parts = [words_of(t) for t in texts]
        seen = self.rows
        unseen = list({w for p in parts for w in p if w not in seen})
        if unseen and len(seen) + len(unseen) > self.CACHE_WORDS:
            self._clear()
            seen = self.rows
            unseen = list({w for p in parts for w in p})
        self._learn(unseen)
        ids = np.fromiter((seen[w] for p in parts for w in p), np.int64)
        size = np.fromiter(map(len, parts), np.int64, len(parts))
        base = np.cumsum(size) - size
        owner, begin = windows(size)
        length = np.minimum(size[owner], WINDOW)
        out = np.zeros(len(parts), np.float32)
        order = np.argsort(length, kind="stable")  # short texts together: only they need padding
        ids = np.append(ids, np.zeros(WINDOW, np.int64))
        for at in range(0, len(order), 4096):
            k = order[at : at + 4096]
            place = (base[owner[k]] + begin[k])[:, None] + np.arange(WINDOW)
            index = np.where(np.arange(WINDOW) < length[k][:, None], ids[np.minimum(place, len(ids) - 1)], 0)
            np.maximum.at(out, owner[k], forward(self.p, self.gates, index, length[k]))
        return out
