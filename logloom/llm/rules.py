"""Quality rules: fixed rules, and an isolation forest on the rules' statistics.

The forest isolates documents by random splits of their statistics; documents that are
isolated early are anomalous. Averages, ranges and the threshold come from all labelled documents; each tree holds
LEAF of all good ones, as the method has it. Every document is then scored on its whole text.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logloom.llm.scan import map_docs, per_doc
from logloom.llm.tables import checkpointed
from logloom.llm.textkit import IS_SPACE, U64, Chunk, gram_hashes, mix, word_hashes

#: Trees, and good documents in each.
TREES, LEAF = 200, 1024
#: Share of documents labelled good that the forest may reject.
LOSS = 0.001

SYMBOL = np.zeros(256, bool)
SYMBOL[list(b"#*$%&|<>")] = True
UPPER = np.zeros(256, bool)
UPPER[65:91] = True
DIGIT = np.zeros(256, bool)
DIGIT[48:58] = True
MARK = np.zeros(256, bool)
MARK[[c for c in range(33, 127) if not chr(c).isalnum()]] = True

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
OUT = "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint"
SHAPES = ("n_upper", "n_digits", "n_marks", "n_lines", "n_types")
SHAPE_OUT = "n_upper bigint, n_digits bigint, n_marks bigint, n_lines bigint, n_types bigint"


def _own(h: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Hashes that are equal only within a document."""
    return mix(h + doc.astype(U64) * U64(0x9E3779B97F4A7C15))


def _distinct(h: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    _, at = np.unique(_own(h, doc), return_index=True)
    return np.bincount(doc[at], minlength=n)


def statistics(c: Chunk, window: int = 5) -> dict[str, np.ndarray]:
    """The counts of each document of a chunk."""
    buf, w = c.buf, c.words()
    space = IS_SPACE[buf]
    out = {"n_words": w.count.astype(np.int64)}
    out["word_chars"] = per_doc(~space & ((buf & 0xC0) != 0x80), c.bounds)
    for name, kind in (("n_symbols", SYMBOL), ("n_upper", UPPER), ("n_digits", DIGIT), ("n_marks", MARK)):
        out[name] = per_doc(kind[buf], c.bounds)
    # lines with a word
    stop = np.zeros(len(buf) + 1, bool)
    stop[c.bounds] = True
    breaks = buf == 0x0A
    starts = np.unique(np.concatenate((c.bounds[:-1], np.flatnonzero(breaks) + 1)))
    ends = np.concatenate((starts[1:], [len(buf)])) if len(starts) else starts
    ends = np.where((ends > starts) & (ends > 0) & np.concatenate((breaks, [False]))[np.maximum(ends - 1, 0)], ends - 1, ends)
    words_before = np.zeros(len(buf) + 1, np.int64)
    np.cumsum(~space, out=words_before[1:])
    full = words_before[ends] > words_before[starts]
    starts, ends = starts[full], ends[full]
    doc = np.searchsorted(c.bounds, starts, "right") - 1
    out["n_lines"] = np.bincount(doc, minlength=c.n).astype(np.int64)
    out["n_dup_lines"] = (out["n_lines"] - _distinct(word_hashes(buf, starts, ends), doc, c.n)).astype(np.int64)
    # words
    h = w.hashes()
    out["n_types"] = _distinct(h, w.doc, c.n).astype(np.int64)
    at = w.ngram_starts(window)
    _, which, times = np.unique(_own(gram_hashes(h, window)[at], w.doc[at]), return_inverse=True, return_counts=True)
    twice = at[times[which] > 1]
    step = np.zeros(w.n + 1, np.int64)
    np.add.at(step, twice, 1)
    np.add.at(step, twice + window, -1)
    out["n_repeat_words"] = per_doc(np.cumsum(step[:-1]) > 0, w.first)
    return out


#: Words of the sample's average that each document's shares are shrunk by, so that short texts aren't extreme by chance.
PRIOR = 10.0


def _shares(s: dict[str, np.ndarray]) -> tuple[list, list, list]:
    f = {k: np.asarray(v, float) for k, v in s.items()}
    w, c = f["n_words"], f["word_chars"]
    over = [f["n_symbols"], f["n_repeat_words"], f["n_upper"], f["n_digits"], f["n_marks"], f["n_dup_lines"], c, f["n_types"]]
    return over, [w, w, c, c, c, f["n_lines"], w, w], [PRIOR, PRIOR, 6 * PRIOR, 6 * PRIOR, 6 * PRIOR, PRIOR / 4, PRIOR, PRIOR]


def averages(s: dict[str, np.ndarray]) -> np.ndarray:
    return np.array([a.sum() / max(b.sum(), 1) for a, b in zip(*_shares(s)[:2], strict=True)])


def features(s: dict[str, np.ndarray], mean: np.ndarray) -> np.ndarray:
    """What the forest splits on: square roots of the statistics' shares, shrunk towards the averages."""
    return np.sqrt(np.stack([(a + m * k) / (b + k) for a, b, k, m in zip(*_shares(s), mean, strict=True)], 1))


def base_failed(s: dict[str, np.ndarray]) -> np.ndarray:
    return (s["n_words"] < 10) | (100 * s["n_repeat_words"] > 20 * s["n_words"])


class Forest:
    """Isolation forest in arrays: column, cut and children of each node of each tree.

    Splits are drawn over the range of all labelled documents, while only the good ones are
    held: where no good document is, a path ends after few splits. x: rows that trees draw from, or what each tree drew.
    """

    def __init__(self, x: np.ndarray | list[np.ndarray], low: np.ndarray, high: np.ndarray, mean: np.ndarray, trees: int = TREES, leaf: int = LEAF, seed: int = 7):
        rng = np.random.default_rng(seed)
        m = max(map(len, x)) if isinstance(x, list) else min(leaf, len(x))
        self.depth = max(1, math.ceil(math.log2(max(m, 2)))) + 4
        self.norm, self.mean, self.cut = _mean_path(m), mean, np.inf
        drawn = x if isinstance(x, list) else (x[rng.choice(len(x), m, replace=False)] for _ in range(trees))
        self.trees = [self._grow(d, low, high, rng) for d in drawn]

    def _grow(self, x: np.ndarray, low: np.ndarray, high: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, ...]:
        column, cut, left, length = [], [], [], []

        def node() -> int:
            for values, v in ((column, 0), (cut, 0.0), (left, -1), (length, 0.0)):
                values.append(v)
            return len(column) - 1

        work = [(node(), np.arange(len(x)), 0, low, high)]
        while work:
            i, rows, depth, lo, hi = work.pop()
            if depth >= self.depth or len(rows) <= 1:
                length[i] = depth + _mean_path(len(rows))
                continue
            k = int(rng.integers(x.shape[1]))
            column[i], cut[i] = k, float(rng.uniform(lo[k], hi[k]))
            a, b = node(), node()
            left[i] = a
            below = x[rows, k] < cut[i]
            edge = np.eye(x.shape[1], dtype=bool)[k]
            work += [(a, rows[below], depth + 1, lo, np.where(edge, cut[i], hi)), (b, rows[~below], depth + 1, np.where(edge, cut[i], lo), hi)]
        return np.array(column), np.array(cut), np.array(left), np.array(length)

    def score(self, s: dict[str, np.ndarray]) -> np.ndarray:
        """0 to 1; higher is more anomalous."""
        x = features(s, self.mean)
        total, rows = np.zeros(len(x)), np.arange(len(x))
        for column, cut, left, length in self.trees:
            at = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                at = np.where(left[at] < 0, at, left[at] + (x[rows, column[at]] >= cut[at]))
            total += length[at]
        return np.round(2.0 ** (-total / (len(self.trees) * max(self.norm, 1e-9))), 6)


def _mean_path(n: int) -> float:
    return 0.0 if n <= 1 else 2 * (math.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n if n > 2 else 1.0


def fit(s: dict[str, np.ndarray], good: np.ndarray, loss: float = LOSS) -> Forest | None:
    """A forest on the documents that pass the base rules, cut so that at most a share loss of the good ones is rejected.

    Among the cuts that allow that, the one in the widest gap above the last good document
    kept is taken. None if no document is left to fit on.
    """
    use = ~base_failed(s)
    s, good = {k: np.asarray(v)[use] for k, v in s.items()}, np.asarray(good)[use] > 0
    if not good.any():
        return None
    mean = averages(s)
    x = features(s, mean)
    forest = Forest(x[good], x.min(0), x.max(0), mean)
    score = forest.score(s)
    top = np.sort(score[good])[::-1]
    limit = top[min(int(loss * len(top)), len(top) - 1)]
    above = np.sort(score[~good & (score > limit)])
    forest.cut = float((limit + above[0]) / 2) if len(above) else float(limit + 1e-6)
    return forest


def _draws(mean: np.ndarray, n_good: int):
    """Of rows (key, good, statistics): the features' least and greatest values, and what the trees draw, as a row of bytes for some rows each.

    A tree draws the good rows whose key, mixed with its number, comes first; only those that can be among its LEAF first are passed on.
    """
    share = min(1.0, (LEAF + 8 * math.sqrt(LEAF)) / n_good)
    cut = U64(min(int(share * 2.0**64), 2**64 - 1))
    salt = mix(np.arange(1, TREES + 1, dtype=U64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 4096):
                b = whole.slice(lo, 4096)
                x = features({k: b.column(i + 2).to_numpy() for i, k in enumerate(COUNTS + SHAPES)}, mean)
                good = np.flatnonzero(b.column(1).to_numpy(zero_copy_only=False))
                rank = mix(b.column(0).to_numpy().view(U64)[good, None] ^ salt)
                row, tree = np.nonzero(rank <= cut)
                made = {"low": x.min(0), "high": x.max(0), "tree": tree.astype(np.int32), "rank": rank[row, tree], "x": x[good[row]]}
                yield pa.RecordBatch.from_arrays([pa.array([v.tobytes()], pa.binary()) for v in made.values()], names=list(made))

    return run


def _scores(forest: Forest):
    """good, score of rows (key, good, statistics)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            score = forest.score({k: b.column(i + 2).to_numpy() for i, k in enumerate(COUNTS + SHAPES)})
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array(score)], names=["good", "score"])

    return run


def fitted(docs: DataFrame, labels: DataFrame, loss: float = LOSS) -> Forest | None:
    """fit() on all labelled documents; null labels and ids are left out, and a repeated document counts each time.

    What reaches the driver are sums, ranges, the trees' draws (TREES times LEAF and some more) and the threshold.
    """
    known = labels.where("doc_id is not null and quality is not null").select("doc_id", "quality")
    all_rows = map_docs(docs.select("doc_id", "text"), ["doc_id"], f"{OUT}, {SHAPE_OUT}", statistics).join(known, "doc_id")
    kept = all_rows.where("n_words >= 10 and 100 * n_repeat_words <= 20 * n_words")
    rows = checkpointed(kept.select(F.xxhash64("doc_id", "quality", *COUNTS, *SHAPES).alias("key"), (F.col("quality") > 0).alias("good"), *COUNTS, *SHAPES))
    sums = rows.agg(F.count_if("good").alias("n_good"), *(F.sum(k).alias(k) for k in COUNTS + SHAPES)).first()
    if not sums["n_good"]:
        return None
    mean = averages({k: np.array([sums[k]], float) for k in COUNTS + SHAPES})
    parts = rows.mapInArrow(_draws(mean, sums["n_good"]), "low binary, high binary, tree binary, rank binary, x binary").collect()
    low, high = (f([np.frombuffer(r[k]) for r in parts], 0) for f, k in ((np.min, "low"), (np.max, "high")))
    tree, rank = (np.concatenate([np.frombuffer(r[k], t) for r in parts]) for k, t in (("tree", np.int32), ("rank", U64)))
    x = np.concatenate([np.frombuffer(r["x"]) for r in parts]).reshape(-1, len(mean))
    order = np.lexsort((*x.T, rank, tree))
    edge = np.searchsorted(tree[order], np.arange(TREES + 1))
    forest = Forest([x[order[a:b][:LEAF]] for a, b in zip(edge[:-1], edge[1:], strict=True)], low, high, mean)
    scored = checkpointed(rows.mapInArrow(_scores(forest), "good boolean, score double"))
    limit = scored.where("good").orderBy(F.desc("score")).limit(int(loss * sums["n_good"]) + 1).agg(F.min("score")).first()[0]
    above = scored.where(~F.col("good") & (F.col("score") > limit)).agg(F.min("score")).first()[0]
    forest.cut = float(limit + 1e-6 if above is None else (limit + above) / 2)
    return forest


def apply_rules(docs: DataFrame, forest: Forest | None) -> DataFrame:
    """doc_id, the five counts, base_failed, kept and anomaly (double) of every document.

    Null and empty texts have no words, hence fail the base rules. Equal texts get equal
    results; a null doc_id is kept as it is; other columns are not read. Without a forest the
    base rules alone decide and anomaly is 0.
    """

    def judge(c: Chunk) -> dict:
        s = statistics(c)
        failed = base_failed(s)
        score = forest.score(s) if forest else np.zeros(c.n)
        return {k: s[k] for k in COUNTS} | {"base_failed": failed, "kept": ~failed & (score < forest.cut if forest else True), "anomaly": score}

    return map_docs(docs, ["doc_id"], f"{OUT}, base_failed boolean, kept boolean, anomaly double", judge)
