"""SimHash near-duplicates with a Gray-order hierarchical index.

All different fingerprints are sorted by Gray rank and cut into parts of consecutive ranks.
A node of the index holds the bits that all fingerprints below it share; its children hold
only what they share beyond that. The upper nodes, one for each part and those above, are
broadcast: going down from the root, a fingerprint adds up the bits in which it differs and
drops a whole node once they exceed the radius. It is sent to the parts that are left, where
the search goes on through the part's own nodes down to single fingerprints. Only spanning
links leave a part, so a large group never becomes all its pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logloom.llm.components import components
from logloom.llm.scan import freeing, grouped, map_docs
from logloom.llm.tables import checkpointed
from logloom.llm.textkit import U64, Chunk, chunks, mix, xxh64

SHINGLE, RADIUS, SEED = 3, 2, 42
#: Children of an index node.
FAN = 8
#: Fingerprints of a part, and how many parts there are at least and at most (their nodes are broadcast: 1 MB). A fingerprint
#: visits about as many parts as log2(parts) has pairs, so this number is kept the same until parts would become too large.
PART, LEAST_PARTS, MOST_PARTS = 50_000, 64, 1 << 16


def shingle_hashes(c: Chunk, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """XXH64 of every k-word shingle of a chunk, A-Z in lower case, and its document's row; a text of fewer words is one shingle."""
    w = c.lowered().words()
    buf, starts, ends = w.normalized()
    n = np.where(w.count > 0, np.maximum(w.count - k + 1, 1), 0)
    doc = np.repeat(np.arange(c.n), n)
    at = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n) + w.first[doc]
    last = np.minimum(at + k - 1, w.first[doc + 1] - 1)
    return xxh64(buf, starts[at], ends[last], SEED), doc


#: For each byte, its bits from the highest in the eight bytes of a number.
_LANES = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).view(U64).ravel()


def bit_counts(h: np.ndarray, edge: np.ndarray) -> np.ndarray:
    """How many numbers of each run h[edge[i]:edge[i + 1]] (none empty) have each bit, the highest first.

    Eight bits are counted at once in the bytes of one number, over at most 255 numbers.
    """
    n = np.diff(edge)
    parts = -(-n // 255)
    first = np.cumsum(parts) - parts
    run = np.repeat(np.arange(len(n)), parts)
    cut = edge[run] - edge[0] + 255 * (np.arange(len(run)) - first[run])
    lanes = _LANES[np.ascontiguousarray(h[edge[0] : edge[-1]].astype(">u8").view(np.uint8).reshape(-1, 8).T)]
    sums = np.ascontiguousarray(np.add.reduceat(lanes, cut, axis=1).T)
    return np.add.reduceat(sums.view(np.uint8).reshape(-1, 64), first, axis=0, dtype=np.int32)


def fingerprints(c: Chunk, k: int = SHINGLE) -> np.ndarray:
    """Each text's 64 majority bits; 0 without a word."""
    h, doc = shingle_hashes(c, k)
    n = np.bincount(doc, minlength=c.n)
    out = np.zeros(c.n, U64)
    some = np.flatnonzero(n)
    if len(some):
        ones = bit_counts(h, np.append((np.cumsum(n) - n)[some], len(h)))
        out[some] = np.packbits(2 * ones > n[some, None], axis=1).view(">u8").ravel().astype(U64)
    return out


def gray_rank(x: np.ndarray) -> np.ndarray:
    """Position of each number in the Gray code sequence."""
    x = x.copy()
    for s in (1, 2, 4, 8, 16, 32):
        x ^= x >> U64(s)
    return x


class Index:
    """Hierarchy over nodes in Gray order, by default single fingerprints; levels[0] are the lowest."""

    def __init__(self, pattern: np.ndarray, mask: np.ndarray | None = None):
        mask = np.full(len(pattern), ~U64(0)) if mask is None else mask
        self.size, self.visits, levels = len(pattern), 0, []
        while True:
            levels.append((mask, pattern))
            if len(mask) == 1:
                break
            edge = np.arange(0, len(mask), FAN)
            shared = np.bitwise_and.reduceat(mask, edge)
            shared &= ~(np.bitwise_or.reduceat(pattern & np.repeat(shared, FAN)[: len(mask)], edge) ^ np.bitwise_and.reduceat(pattern, edge))
            pattern = np.bitwise_and.reduceat(pattern, edge) & shared
            mask = shared
        # residual masks: what a node shares beyond its parent
        self.levels = []
        for i, (m, p) in enumerate(levels):
            own = m if i == len(levels) - 1 else m & ~np.repeat(levels[i + 1][0], FAN)[: len(m)]
            self.levels.append((own, p & own))

    def search(self, q: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """Positions in q, and of the lowest nodes from which it differs in at most radius of their shared bits."""
        found_q, found_x = [], []
        for lo in range(0, len(q), 4096):
            which = np.arange(lo, min(lo + 4096, len(q)))
            work = [(len(self.levels) - 1, which, np.zeros(len(which), np.int64), np.zeros(len(which), np.uint8))]
            while work:
                level, qi, node, spent = work.pop()
                if len(qi) > 1 << 18:
                    half = len(qi) // 2
                    work += [(level, qi[:half], node[:half], spent[:half]), (level, qi[half:], node[half:], spent[half:])]
                    continue
                mask, pattern = self.levels[level]
                self.visits += len(qi)
                spent = spent + np.bitwise_count((q[qi] ^ pattern[node]) & mask[node])
                ok = np.flatnonzero(spent <= radius)
                qi, node, spent = qi[ok], node[ok], spent[ok]
                if not len(qi):
                    continue
                if level == 0:
                    found_q.append(qi)
                    found_x.append(node)
                    continue
                child = (node[:, None] * FAN + np.arange(FAN)).ravel()
                real = np.flatnonzero(child < len(self.levels[level - 1][0]))
                work.append((level - 1, np.repeat(qi, FAN)[real], child[real], np.repeat(spent, FAN)[real]))
        cat = lambda v: np.concatenate(v) if v else np.zeros(0, np.int64)
        return cat(found_q), cat(found_x)


def joined(up: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Each member's smallest connected member, given what up says (flat, smallest first) and the links a - b."""
    while True:
        lo, hi = np.minimum(up[a], up[b]), np.maximum(up[a], up[b])
        new = lo < hi
        if not new.any():
            return up
        a, b, up = a[new], b[new], up.copy()
        np.minimum.at(up, hi[new], lo[new])
        while (up[up] != up).any():
            up = up[up]


def _rank(fp: Column) -> Column:
    """Gray rank of a 64-bit fingerprint as a number that sorts by it."""
    for s in (1, 2, 4, 8, 16, 32):
        fp = fp.bitwiseXOR(F.shiftrightunsigned(fp, s))
    return fp.bitwiseXOR(F.lit(-(1 << 63)))


def _send(index: Index, radius: int):
    """Of (node, fp, part): a row for its own part and, as a visitor, for each later part that the upper nodes don't rule out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node, fp, part = (batch.column(i).to_numpy() for i in range(3))
            q, to = index.search(fp.view(U64), radius)
            later = to > part[q]
            q, to = np.concatenate((np.arange(len(fp)), q[later])), np.concatenate((part, to[later]))
            visits = np.arange(len(q)) >= len(fp)
            for lo in range(0, len(q), 1 << 16):
                i = q[lo : lo + (1 << 16)]
                yield pa.RecordBatch.from_arrays([pa.array(to[lo : lo + (1 << 16)].astype(np.int32)), pa.array(visits[lo : lo + (1 << 16)]), pa.array(node[i]), pa.array(fp[i])], names=["part", "visits", "node", "fp"])

    return run


def _meet(radius: int):
    """Links of rows sorted by part and visits: a part's own fingerprints are indexed, visitors stream through."""

    def pairs(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    def settle(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[Index, np.ndarray, np.ndarray, pa.RecordBatch]:
        node, x = (np.concatenate(v) for v in zip(*held, strict=True))
        order = np.argsort(gray_rank(x), kind="stable")
        node, x = node[order], x[order]
        index, up = Index(x), np.arange(len(x))
        for lo in range(0, len(x), 1 << 14):
            q, at = index.search(x[lo : lo + (1 << 14)], radius)
            q = q + lo
            up = joined(up, q[q < at], at[q < at])
        under = np.flatnonzero(up != np.arange(len(up)))
        return index, node, up, pairs(node[under], node[up[under]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, built = None, [], None
        for batch in batches:
            part, visits, node, fp = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(4))
            fp = fp.view(U64)
            edge = np.flatnonzero(np.concatenate(([True], (part[1:] != part[:-1]) | (visits[1:] != visits[:-1]), [True]))) if len(part) else []
            for lo, hi in zip(edge[:-1], edge[1:], strict=True):
                if part[lo] != now:
                    if held and built is None:
                        yield settle(held)[3]
                    now, held, built = part[lo], [], None
                if not visits[lo]:
                    held.append((node[lo:hi], fp[lo:hi]))
                    continue
                if built is None:
                    built = settle(held)
                    yield built[3]
                index, own, up, _ = built
                q, at = index.search(fp[lo:hi], radius)
                once = np.unique(np.stack((q, up[at]), 1), axis=0) if len(q) else np.zeros((0, 2), np.int64)
                yield pairs(node[lo:hi][once[:, 0]], own[once[:, 1]])
        if held and built is None:
            yield settle(held)[3]

    return run


def links(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """a, b (bigint): links between the nodes of prints (node bigint, fp bigint, all fp different) that connect what is connected by fingerprints within radius.

    Not every such pair is a row, and the two of a row may be further apart than radius. What
    reaches the driver is a cut between each two parts and what the parts' fingerprints share.
    """
    prints = prints.select("node", "fp", _rank(F.col("fp")).alias("rank"))
    n = prints.count()
    parts = min(MOST_PARTS, max(LEAST_PARTS, -(-n // PART)))
    cuts = sorted(set(prints.agg(F.percentile_approx("rank", [i / parts for i in range(1, parts)], 10 * parts)).first()[0] or []))
    edges = np.array(cuts, np.int64)

    @F.arrow_udf("int")
    def part_of(rank: pa.Array) -> pa.Array:
        return pa.array(np.searchsorted(edges, rank.to_numpy(), "left").astype(np.int32))

    dealt = checkpointed(prints.select("node", "fp", part_of("rank").alias("part")))
    shared = dealt.groupBy("part").agg(F.bit_and("fp").alias("all"), F.bit_or("fp").alias("any")).orderBy("part").collect()
    number = {r["part"]: i for i, r in enumerate(shared)}
    every, some = (np.array([r[k] for r in shared], np.int64).view(U64) for k in ("all", "any"))
    upper = Index(every, ~(every ^ some)) if len(shared) else None
    if upper is None:
        return dealt.select(F.col("node").alias("a"), F.col("node").alias("b"))
    packed = np.array([number.get(i, -1) for i in range(len(cuts) + 1)])

    def sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        again = (b.set_column(2, "part", pa.array(packed[b.column(2).to_numpy()])) for b in batches)
        return _send(upper, radius)(again)

    met = dealt.select("node", "fp", "part").mapInArrow(sent, "part int, visits boolean, node bigint, fp bigint")
    return met.repartition("part").sortWithinPartitions("part", "visits").mapInArrow(_meet(radius), "a bigint, b bigint")


#: Words of a wide fingerprint.
WIDE = 8
#: Where a shingle is in the prefixes of FEW texts or fewer, all of these are compared at once. Where it is more, each is compared with
#: one first, and then with all texts of other groups, ALIKE in a task and each two parts of so many in one.
FEW, ALIKE = 32, 2000
#: One of so many documents tells which shingles are common: those of COMMON of them or more, MOST_COMMON at most. This decides about order and cost, never about the result.
COMMON_RATE, COMMON, MOST_COMMON = 16, 3, 1 << 18
#: Bins in which shingles are counted, a power of two.
BINS = 256
#: Texts, or what is made of them, in a part of a checkpoint.
PART_TEXTS = 4096
#: Keeps bounds on the safe side of rounding.
EPS = 1e-9


def majority(h: np.ndarray, edge: np.ndarray, words: int = 1) -> np.ndarray:
    """Majority bits of each run h[edge[i]:edge[i + 1]] (none empty), as that many 64-bit words."""
    out = np.zeros((len(edge) - 1, words), U64)
    n = np.diff(edge)[:, None]
    for k in range(words):
        ones = bit_counts(mix(h[edge[0] : edge[-1]] + U64(k + 1)), edge - edge[0])
        out[:, k] = np.packbits(2 * ones > n, axis=1).view(">u8").ravel()
    return out


def shingle_sets(c: Chunk, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Different shingles of each text of a chunk, sorted by text and hash: hashes, the texts' rows, and each text's number of them."""
    h, doc = shingle_hashes(c, k)
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    once = np.concatenate(([True], (h[1:] != h[:-1]) | (doc[1:] != doc[:-1]))) if len(h) else np.zeros(0, bool)
    h, doc = h[once], doc[once]
    return h, doc, np.bincount(doc, minlength=c.n)


def set_hashes(h: np.ndarray, n: np.ndarray) -> np.ndarray:
    """A number for each set of n[i] shingles, equal for equal sets; 0 for none."""
    some, sig = np.flatnonzero(n), np.zeros(len(n), U64)
    if len(some):
        sig[some] = mix(np.add.reduceat(mix(h), (np.cumsum(n) - n)[some]) + n[some].astype(U64))
    return sig.view(np.int64)


def spanning(x: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """The links of a minimum spanning forest of rows of x (wide fingerprints), as far as they differ in at most limit bits.

    The tree grows by the row that is nearest to it, so no pairs are held; where none is near enough, another one begins.
    """
    n = len(x)
    best, by = np.full(n, 1 << 30), np.zeros(n, np.int64)
    left = np.arange(n)
    now, a, b = 0, [], []
    left = left[1:]
    while len(left):
        far = np.bitwise_count(x[left] ^ x[now]).sum(1, dtype=np.int64)
        nearer = far < best[left]
        best[left[nearer]], by[left[nearer]] = far[nearer], now
        k = int(best[left].argmin())
        now = int(left[k])
        if best[now] <= limit:
            a.append(now)
            b.append(by[now])
        left = np.delete(left, k)
    return np.array(a, np.int64), np.array(b, np.int64)


def jaccard(one: Chunk, other: Chunk, k: int) -> np.ndarray:
    """Similarity of the sets of k-word shingles of each text and the other's; 1 where neither has any."""
    sets = []
    for c in (one, other):
        h, doc = shingle_hashes(c, k)
        own, at = np.unique(mix(h ^ mix(doc.astype(U64) + U64(1))), return_index=True)
        sets.append((own, doc[at], np.bincount(doc[at], minlength=c.n)))
    both, at, _ = np.intersect1d(sets[0][0], sets[1][0], assume_unique=True, return_indices=True)
    common = np.bincount(sets[0][1][at], minlength=one.n)
    union = sets[0][2] + sets[1][2] - common
    return np.where(union > 0, common / np.maximum(union, 1), 1.0)


def _similar(similarity: float, k: int):
    """a, b of rows (a, b, text of a, text of b) that are similar."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c in chunks(batch.column(2)):
                other = next(chunks(batch.column(3).slice(c.first, c.n), 1 << 62))
                at = c.first + np.flatnonzero(jaccard(c, other, k) >= similarity)
                if len(at):
                    yield pa.RecordBatch.from_arrays([batch.column(i).take(pa.array(at)) for i in (0, 1)], names=["a", "b"])

    return run


def bins(h: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """How many shingles of each of n texts fall into each of BINS bins, modulo 256."""
    return np.bincount(doc * BINS + (mix(h ^ U64(0x5851F42D4C957F2D)) >> U64(64 - BINS.bit_length() + 1)).astype(np.int64), minlength=n * BINS).astype(np.uint8).reshape(n, BINS)


def apart(one: np.ndarray, other: np.ndarray) -> np.ndarray:
    """By how much each two rows of bins differ in all: never more than their sets have shingles apart."""
    return np.minimum(one - other, other - one).sum(1, dtype=np.int64)


def _most_apart(size: np.ndarray, similarity: float) -> np.ndarray:
    """How many shingles two similar sets of that size together have apart at most."""
    return size * (1 - similarity) / (1 + similarity) + EPS


def _bins(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, BINS)


def _near(similarity: float):
    """a, b of rows (a, b, sizes, bins) that can be similar: counts of bins differ by no more in all than such sets have shingles apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = batch.column(2).to_numpy() + batch.column(3).to_numpy()
            at = np.flatnonzero(apart(_bins(batch.column(4)), _bins(batch.column(5))) <= _most_apart(size, similarity))
            yield pa.RecordBatch.from_arrays([batch.column(i).take(pa.array(at)) for i in (0, 1)], names=["a", "b"])

    return run


def _told(pairs: DataFrame, source: DataFrame, thin: DataFrame, similarity: float, shingle: int) -> tuple[DataFrame, int]:
    """a, b of those pairs (a, b: nodes) whose texts are similar, and how many are compared; texts are only read of those whose bins don't rule it out."""
    n = pairs.count()
    ids = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    sets = checkpointed(thin.select("node", "size", "bins", "doc_id").join(ids, "node", "left_semi").groupBy("node").agg(F.first("size").alias("size"), F.first("bins").alias("bins"), F.min("doc_id").alias("doc_id")), 2 * n)
    one, other = (sets.select(F.col("node").alias(x), F.col("size").alias(f"size_{x}"), F.col("bins").alias(f"bins_{x}")) for x in "ab")
    near = checkpointed(pairs.join(one, "a").join(other, "b").select("a", "b", "size_a", "size_b", "bins_a", "bins_b").mapInArrow(freeing(_near(similarity)), "a bigint, b bigint"), n)
    n = near.count()
    ids = checkpointed(near.select(F.explode(F.array("a", "b")).alias("node")).distinct(), 2 * n)
    wanted = checkpointed(sets.select("node", "doc_id").join(ids, "node").select("doc_id").distinct(), 2 * n)
    rows = source.select("doc_id", "text").join(F.broadcast(wanted) if wanted.count() <= 1 << 18 else wanted, "doc_id")

    def own(c: Chunk) -> dict:
        h, _, n = shingle_sets(c, shingle)
        return {"node": set_hashes(h, n)}

    texts = checkpointed(map_docs(rows.select("text"), ["text"], "node bigint", own).join(ids, "node").groupBy("node").agg(F.min("text").alias("text")), 2 * n, PART_TEXTS)
    told = near.join(texts.withColumnsRenamed({"node": "a", "text": "one"}), "a").join(texts.withColumnsRenamed({"node": "b", "text": "other"}), "b")
    return told.select("a", "b", "one", "other").mapInArrow(freeing(_similar(similarity, shingle)), "a bigint, b bigint"), n


def _common(source: DataFrame, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of common shingles, ascending, and how many of the sampled documents have them."""
    some = source.where(F.pmod(F.xxhash64("doc_id"), F.lit(COMMON_RATE)) == 0).select("text")

    def sets(c: Chunk) -> dict:
        h, _, n = shingle_sets(c, shingle)
        return {"node": set_hashes(h, n), "h": pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(n)).astype(np.int32)), pa.array(h.view(np.int64)))}

    counts = map_docs(some, [], "node bigint, h array<bigint>", sets).select("node", F.explode("h").alias("h")).groupBy("h").agg(F.count("*").alias("n"), F.min("node").alias("lo"), F.max("node").alias("hi"))
    found = counts.where((F.col("n") >= COMMON) & (F.col("lo") != F.col("hi"))).orderBy(F.desc("n"), "h").limit(MOST_COMMON).select("h", "n").toPandas()
    h, n = found["h"].to_numpy(np.int64).view(U64), found["n"].to_numpy(np.int64)
    order = np.argsort(h)
    return h[order], n[order]


def prefixes(c: Chunk, k: int, similarity: float, common: tuple[np.ndarray, np.ndarray]) -> dict:
    """For each text of a chunk: node (a number), size and bins of its set of shingles, and prefix, the first shingles in an order that is the same for all texts.

    Common shingles come last, the least common of them first; else hashes order them. Two sets of that similarity
    have more shingles in common than either has outside its prefix, so the first that they share is in both.
    """
    h, doc, n = shingle_sets(c, k)
    level = np.zeros(len(h), np.int64)
    if len(common[0]):
        at = np.minimum(np.searchsorted(common[0], h), len(common[0]) - 1)
        level = np.where(common[0][at] == h, common[1][at], 0)
    ordered = h[np.lexsort((level, doc))]  # stable: hashes ascend within a level
    place = np.arange(len(h)) - np.repeat(np.cumsum(n) - n, n)
    long = np.where(n > 0, n - np.ceil(similarity * n - EPS).astype(np.int64) + 1, 0)
    edges = np.append(0, np.cumsum(long)).astype(np.int32)
    return {"node": set_hashes(h, n), "size": n.astype(np.int64), "bins": [x.tobytes() for x in bins(h, doc, c.n)], "prefix": pa.ListArray.from_arrays(pa.array(edges), pa.array(ordered[place < long[doc]].view(np.int64)))}


def close(key: np.ndarray, size: np.ndarray, place: np.ndarray, similarity: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Every two rows i, j of a key, of rows sorted by key and size, that can be similar if key is the first shingle in common of sets of that size, at that place in each."""
    i, d = np.arange(len(key)), 0
    while len(i):
        # each row with the one d rows further on, until that has another key or is too large: so are all after it
        d += 1
        i = i[i + d < len(key)]
        i = i[key[i] == key[i + d]]
        least = np.ceil(similarity / (1 + similarity) * (size[i] + size[i + d]) - EPS)
        on = (size[i] >= similarity * size[i + d] - EPS) & (place[i] <= size[i] - least)
        i, least = i[on], least[on]
        ok = place[i + d] <= size[i + d] - least
        yield i[ok], i[ok] + d


def _rows(**columns: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v) for v in columns.values()], names=list(columns))


def _sharing(similarity: float, few: int):
    """Of rows (token, node, size, place) sorted by token, size and node: candidates a, b (n = 0) where few nodes have a token, else the token's rows with how many (n) there are, the node (a) and one that is the same for all of them (b)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in grouped(batches, "token", 1 << 14):
            token, node, size, place = (t[x].to_numpy() for x in ("token", "node", "size", "place"))
            once = np.concatenate(([True], (token[1:] != token[:-1]) | (node[1:] != node[:-1])))
            token, node, size, place = token[once], node[once], size[once], place[once]
            edge = np.flatnonzero(np.concatenate(([True], token[1:] != token[:-1], [True])))
            times = np.diff(edge)
            # each token has a centre of its own, so that a node is compared with several
            rank = mix(node.view(U64) ^ mix(token.view(U64)))
            n, centre = np.repeat(times, times), np.repeat(node[rank == np.repeat(np.minimum.reduceat(rank, edge[:-1]), times)], times)
            at = np.flatnonzero((n > 1) & (n <= few))
            pairs = [(node[at[i]], node[at[j]]) for i, j in close(token[at], size[at], place[at], similarity)]
            if pairs:
                a, b = np.unique(np.stack([np.concatenate(v) for v in zip(*((np.maximum(*p), np.minimum(*p)) for p in pairs), strict=True)]), axis=1)
                none = np.zeros(len(a), np.int64)
                yield _rows(n=none, token=none, a=a, b=b, size=none, place=none)
            at = np.flatnonzero(n > few)
            for lo in range(0, len(at), 1 << 16):
                k = at[lo : lo + (1 << 16)]
                yield _rows(n=n[k], token=token[k], a=node[k], b=centre[k], size=size[k], place=place[k])

    return run


def _crossing(similarity: float):
    """a, b: candidates in different components whose bins don't rule it out, of rows sorted by key and size; where key is of two parts (cross), one of each (own)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in grouped(batches, "key", 1 << 14):
            key, node, component, size, place, own, cross = (t[x].to_numpy() for x in ("key", "node", "component", "size", "place", "own", "cross"))
            held = _bins(t["bins"])
            for i, j in close(key, size, place, similarity):
                ok = (component[i] != component[j]) & (~cross[i] | (own[i] != own[j]))
                i, j = i[ok], j[ok]
                ok = apart(held[i], held[j]) <= _most_apart(size[i] + size[j], similarity)
                if ok.any():
                    a, b = node[i[ok]], node[j[ok]]
                    yield _rows(a=np.maximum(a, b), b=np.minimum(a, b))

    return run


def _between(crowded: DataFrame, groups: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """a, b: all candidates in different groups (node, component) among rows (token, n, node, size, place), as far as their sets' bins (node, bins) don't rule them out."""
    rows = crowded.join(groups, "node", "left").withColumn("component", F.coalesce("component", "node"))
    mixed = rows.groupBy("token").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("token")
    rows = rows.join(mixed, "token")
    # bins go along, so that pairs that they rule out are never rows
    sets = sets.select("node", "bins").join(rows.select("node").distinct(), "node", "left_semi").groupBy("node").agg(F.first("bins").alias("bins"))
    parts = F.ceil(F.col("n") / ALIKE)
    dealt = rows.join(sets, "node").withColumn("own", F.pmod(F.xxhash64("node"), parts)).withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), parts - 1)))
    tiles = dealt.select(F.xxhash64("token", F.least("own", "other"), F.greatest("own", "other")).alias("key"), "node", "component", "size", "place", "own", (F.col("own") != F.col("other")).alias("cross"), "bins")
    return tiles.repartition("key").sortWithinPartitions("key", "size", "node").mapInArrow(freeing(_crossing(similarity)), "a bigint, b bigint").distinct()


def similar_groups(docs: DataFrame, similarity: float = 0.8, shingle: int = 5) -> DataFrame:
    """doc_id, component_id of every different doc_id that isn't null: groups of similar sets of shingles.

    Documents with equal sets are one node from the start, null and blank texts among them, and two nodes are linked if the
    Jaccard similarity of their sets is at least `similarity`. No such link between groups is lost: candidates come from a
    prefix join, where sets meet in each of the first shingles of an order that puts common ones last, and pairs are only
    left out for what no similar two can have (their sizes, the places of their first common shingle, how many shingles
    fall into each bin of their hashes). All others are compared. Where many sets meet, each is first compared with one of them, so that large groups
    are known, and then all pairs of different groups are. component_id is the smallest doc_id of a group. Where rows
    repeat an id with different texts, all of these are in one group.
    """
    source = docs.where("doc_id is not null")
    common = _common(source, shingle)
    thin = checkpointed(map_docs(source.select("doc_id", "text"), ["doc_id"], "node bigint, size bigint, bins binary, prefix array<bigint>", lambda c: prefixes(c, shingle, similarity, common)), source.count(), PART_TEXTS)
    posts = thin.select("node", "size", F.posexplode("prefix").alias("place", "token")).select("token", "node", "size", F.col("place").cast("bigint").alias("place"))
    n = thin.agg(F.sum(F.size("prefix"))).first()[0] or 0
    met = checkpointed(posts.repartition("token").sortWithinPartitions("token", "size", "node").mapInArrow(freeing(_sharing(similarity, FEW)), "n bigint, token bigint, a bigint, b bigint, size bigint, place bigint"), n)
    first = thin.groupBy("doc_id").agg(F.min("node").alias("b"), F.max("node").alias("last")).where("b <> last").select("doc_id", "b")
    same = thin.select("doc_id", F.col("node").alias("a")).join(first, "doc_id").select("a", "b")
    pairs = checkpointed(met.where("a <> b").select("a", "b").distinct(), met.count())
    told, n = _told(pairs, source, thin, similarity, shingle)
    groups = components(told.unionByName(same), n + same.count())
    crowded = met.where("n > 0").select("token", "n", F.col("a").alias("node"), "size", "place")
    if not crowded.isEmpty():
        rest = checkpointed(_between(crowded, groups, thin, similarity))
        told, n = _told(rest, source, thin, similarity, shingle)
        found = checkpointed(told, n, PART_TEXTS)
        if not found.isEmpty():
            groups = components(groups.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(found), groups.count() + n)
    label = thin.groupBy("node").agg(F.min("doc_id").alias("doc_id")).join(groups, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = label.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    return thin.select("doc_id", "node").join(label.join(least, "component").select("node", "component_id"), "node").select("doc_id", "component_id").distinct()


def keep_one(docs: DataFrame, similarity: float = 0.8, shingle: int = 5) -> DataFrame:
    """The rows of docs whose doc_id is the smallest of its group, one for each such id.

    Rows with a null doc_id all stay. Where rows repeat an id, the smallest text stays.
    """
    first = similar_groups(docs, similarity, shingle).where("doc_id = component_id").select("doc_id")
    known = docs.where("doc_id is not null").join(first, "doc_id", "left_semi")
    ranked = known.withColumn("__nth", F.row_number().over(Window.partitionBy("doc_id").orderBy("text"))).where("__nth = 1").drop("__nth")
    return ranked.unionByName(docs.where("doc_id is null"))


def near_groups(docs: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id of every document, a row for each.

    Documents whose fingerprints differ in at most radius bits are linked; component_id is the
    smallest doc_id that links reach. Null, empty and blank texts have fingerprint zero and are
    linked like any other. A row with a null doc_id gets its fingerprint's component, which is
    null if no row of it has an id; repeated rows each keep their row.
    """
    prints = checkpointed(map_docs(docs, ["doc_id"], "fp bigint", lambda c: {"fp": fingerprints(c, shingle).view(np.int64)}))
    nodes = checkpointed(prints.groupBy("fp").agg(F.min("doc_id").alias("node")))
    found = components(links(nodes.where("node is not null"), radius))
    label = nodes.join(found, "node", "left").select("fp", F.coalesce("component", "node").alias("component_id"))
    return prints.join(label, "fp", "left").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
