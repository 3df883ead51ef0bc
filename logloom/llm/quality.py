"""Quality classifier: attention-based multiple-instance learning.

A document is a bag of passages. Each passage is encoded from its words; a gated attention
network, learned from document labels alone, weighs the passages, and a logistic layer
scores the weighted passage representation.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom.llm.scan import crc_mod, map_docs, sampled
from logloom.llm.textkit import U64, Chunk, mix

#: Labelled documents that the network learns from, in expectation, and passages of each: those of longer ones are
#: drawn at even steps from first to last. So the driver gets SAMPLE * BAG * DIM numbers at most. Scoring takes all passages.
SAMPLE, BAG = 6000, 256
#: Words of a passage, buckets of hashed words, units of the encoder and of the attention.
PASSAGE, BUCKETS, HIDDEN, ATTENTION = 50, 32, 24, 12
ROUNDS, BATCH, RATE, DECAY = 12, 128, 0.01, 1e-4
#: Passages the scoring of a chunk holds in hidden layers at once.
STEP = 1 << 14
CUT = 0.3

_CLASSES = np.zeros((6, 256), bool)
_CLASSES[0, 65:91] = True
_CLASSES[1, 48:58] = True
_CLASSES[2, list(b"#*$%&|<>@=^~_+")] = True
_CLASSES[3, list(b"!?")] = True
_CLASSES[4, list(b".,;:\"'()-/")] = True
_CLASSES[5, 128:] = True
DIM = 6 + 8 + BUCKETS


def passages(c: Chunk) -> tuple[np.ndarray, np.ndarray]:
    """Encoded passages in order, and each document's first passage (n + 1 entries). A document without words has one passage of zeros."""
    w = c.words()
    nth = np.arange(w.n) - w.first[w.doc]
    sizes = np.maximum(1, -(-w.count // PASSAGE))
    first = np.concatenate(([0], np.cumsum(sizes)))
    n = int(first[-1])
    x = np.zeros((n, DIM), np.float32)
    if not w.n:
        return x, first
    own = first[w.doc] + nth // PASSAGE
    words = np.bincount(own, minlength=n).astype(np.float64)
    some = np.maximum(words, 1)
    size = w.ends - w.starts
    letters = np.bincount(own, size, minlength=n)
    add = lambda v: np.bincount(own, v, minlength=n)
    for k in range(6):
        seen = np.concatenate(([0], np.cumsum(_CLASSES[k][c.buf])))
        x[:, k] = np.sqrt(add(seen[w.ends] - seen[w.starts]) / np.maximum(letters, 1))
    h = w.hashes()
    last = np.concatenate(([False], (h[1:] == h[:-1]) & (own[1:] == own[:-1])))
    before = np.concatenate(([False, False], (h[2:] == h[:-2]) & (own[2:] == own[:-2]))) if w.n > 2 else np.zeros(w.n, bool)
    _, at = np.unique(mix(h + own.astype(U64) * U64(0x9E3779B97F4A7C15)), return_index=True)
    lead, end = c.buf[w.starts], c.buf[w.ends - 1]
    x[:, 6] = letters / some / 10
    x[:, 7] = np.sqrt(np.maximum(add(size.astype(float) ** 2) / some - (letters / some) ** 2, 0)) / 10
    x[:, 8] = add(last) / some
    x[:, 9] = add(before) / some
    x[:, 10] = np.bincount(own[at], minlength=n) / some
    x[:, 11] = add((lead >= 65) & (lead <= 90)) / some
    x[:, 12] = add(_CLASSES[4][end]) / some
    x[:, 13] = words / PASSAGE
    bucket = np.bincount(own * BUCKETS + (h >> U64(40)).astype(np.int64) % BUCKETS, np.where(h >> U64(63), 1.0, -1.0), minlength=n * BUCKETS)
    x[:, 14:] = bucket.reshape(n, BUCKETS) / some[:, None]
    x[words == 0] = 0
    return x, first


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    p: dict[str, np.ndarray]

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        h = np.tanh((x - self.mean) / self.scale @ self.p["W"] + self.p["b"])
        v, u = np.tanh(h @ self.p["V"]), _sigmoid(h @ self.p["U"])
        return h, v, u, (v * u) @ self.p["w"]

    def score(self, x: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Of bags x[first[i]:first[i + 1]], none of them empty."""
        parts = [self.encode(x[i : i + STEP]) for i in range(0, len(x), STEP)]
        if not parts:
            return np.zeros(0)
        h, e = np.concatenate([q[0] for q in parts]), np.concatenate([q[3] for q in parts])
        z, _ = pooled(h, e, first)
        return _sigmoid(z @ self.p["c"] + self.p["d"][0])


def pooled(h: np.ndarray, e: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each bag's representation under softmax weights of e, and the weights."""
    n = np.diff(first)
    a = np.exp(e - np.repeat(np.maximum.reduceat(e, first[:-1]), n))
    a /= np.repeat(np.add.reduceat(a, first[:-1]), n)
    return np.add.reduceat(h * a[:, None], first[:-1]), a


def learn(x: np.ndarray, first: np.ndarray, y: np.ndarray, seed: int = 5) -> Model | None:
    """A network from bags and their labels; None without both labels."""
    y = np.asarray(y, float)
    if not len(y) or y.min() == y.max():
        return None
    rng = np.random.default_rng(seed)
    init = lambda *s: rng.normal(0, 1 / np.sqrt(s[0]), s)
    p = {"W": init(DIM, HIDDEN), "b": np.zeros(HIDDEN), "V": init(HIDDEN, ATTENTION), "U": init(HIDDEN, ATTENTION), "w": init(ATTENTION), "c": init(HIDDEN), "d": np.zeros(1)}
    m = Model(x.mean(0).astype(float), x.std(0).astype(float) + 1e-3, p)
    mom = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in p.items()}
    step = 0
    for r in range(ROUNDS):
        order = rng.permutation(len(y))
        for i in range(0, len(order), BATCH):
            bags = order[i : i + BATCH]
            n = np.diff(first)[bags]
            at = np.concatenate([np.arange(first[k], first[k + 1]) for k in bags])
            edge = np.concatenate(([0], np.cumsum(n)))
            xs = (x[at] - m.mean) / m.scale
            h, v, u, e = m.encode(x[at])
            z, a = pooled(h, e, edge)
            gs = (_sigmoid(z @ p["c"] + p["d"][0]) - y[bags]) / len(bags)
            gz = gs[:, None] * p["c"]
            each = np.repeat(gz, n, 0)
            ga = (each * h).sum(1)
            ge = a * (ga - np.repeat(np.add.reduceat(a * ga, edge[:-1]), n))
            gvu = ge[:, None] * p["w"]
            gv, gu = gvu * u * (1 - v * v), gvu * v * u * (1 - u)
            gh = (a[:, None] * each + gv @ p["V"].T + gu @ p["U"].T) * (1 - h * h)
            g = {"W": xs.T @ gh, "b": gh.sum(0), "V": h.T @ gv, "U": h.T @ gu, "w": (v * u).T @ ge, "c": z.T @ gs, "d": np.array([gs.sum()])}
            step += 1
            rate = RATE * (1 - r / ROUNDS)
            for k in p:
                d = g[k] + DECAY * p[k]
                a1, a2 = mom[k]
                a1[:] = 0.9 * a1 + 0.1 * d
                a2[:] = 0.999 * a2 + 0.001 * d * d
                p[k] -= rate * (a1 / (1 - 0.9**step)) / (np.sqrt(a2 / (1 - 0.999**step)) + 1e-8)
    return m


def fitted(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model | None:
    """learn() on about `sample` labelled documents, up to BAG passages of each; null labels, ids and texts are left out."""
    known = sampled(labels.where("doc_id is not null and quality is not null").select("doc_id", "quality"), sample)

    def encode(c: Chunk) -> dict:
        x, first = passages(c)
        drawn = [first[i] + np.unique(np.linspace(0, n - 1, min(n, BAG)).astype(np.int64)) for i, n in enumerate(np.diff(first).tolist())]
        return {"x": [x[at].astype(np.float32).tobytes() for at in drawn]}

    rows = map_docs(docs.where("text is not null").select("doc_id", "text").join(F.broadcast(known), "doc_id"), ["doc_id", "quality"], "x binary", encode)
    found = sorted((r["doc_id"], r["quality"], bytes(r["x"])) for r in rows.collect())
    if not found:
        return None
    bags = [np.frombuffer(r[2], np.float32).reshape(-1, DIM) for r in found]
    return learn(np.concatenate(bags), np.concatenate(([0], np.cumsum([len(b) for b in bags]))), np.array([r[1] for r in found]) > 0)


def predict(docs: DataFrame, model: Model | None, keep: list[str], cut: float = CUT, names: tuple[str, str] = ("score", "predicted")) -> DataFrame:
    """keep's columns, score (double, 0 to 1) and predicted (int: 1 if score >= cut) of every document.

    names: what the two are called; columns of keep that are called so are replaced.

    Null and empty texts and texts without a word count as one passage of zeros, so all of
    them get one score. Without a model every score is 1. Equal texts get equal scores.
    """

    def judge(c: Chunk) -> dict:
        s = np.round(model.score(*passages(c)), 6) if model else np.ones(c.n)
        return {names[0]: s, names[1]: (s >= cut).astype(np.int32)}

    return map_docs(docs, keep, f"{names[0]} double, {names[1]} int", judge)


def held_out(column: str = "doc_id", mod: int = 5, rest: int = 0) -> Column:
    return F.coalesce(crc_mod(column, mod) == rest, F.lit(False))
