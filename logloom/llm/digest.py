"""Document fingerprints: a quartile bucket digest.

Byte triplets (spread over eight bytes, so that they reach across words) are hashed into
buckets; the digest holds, for each bucket, the quartile of its count among all buckets of
the same text, and the text's length on a logarithmic scale. Two digests are compared by the
sum of their quartile steps and length steps, bounded and turned into a likeness.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logloom.llm.textkit import U64, Chunk, chunks, mix

BUCKETS = 1024
#: Offsets of a triplet's bytes.
TRIPLET = (0, 3, 7)
#: Mean steps a bucket at which digests count as unlike; a length step counts as this many bucket steps.
LIMIT, LENGTH_STEP, MOST_LENGTH_STEPS = 1.4, BUCKETS // 64, 24
_STEP = np.array([0, 1, 2, 6])


def codes(c: Chunk) -> tuple[np.ndarray, np.ndarray]:
    """Quartile (0 to 3) of each bucket and the length step of each text; every text counts as followed by zero bytes."""
    size, pad = np.diff(c.bounds), TRIPLET[-1]
    at = np.arange(c.bounds[-1]) + np.repeat(np.arange(c.n) * pad, size)
    b = np.zeros(int(c.bounds[-1]) + c.n * pad, np.uint64)
    b[at] = c.buf
    h = b[at + TRIPLET[0]] | b[at + TRIPLET[1]] << U64(8) | b[at + TRIPLET[2]] << U64(16)
    bucket = (mix(h + U64(1)) >> U64(20)).astype(np.int64) % BUCKETS
    counts = np.bincount(np.repeat(np.arange(c.n) * BUCKETS, size) + bucket, minlength=c.n * BUCKETS).reshape(c.n, BUCKETS).astype(np.int32)
    cuts = [BUCKETS // 4 - 1, BUCKETS // 2 - 1, 3 * BUCKETS // 4 - 1]
    q = np.partition(counts, cuts, 1)[:, cuts]
    return sum((counts > q[:, k : k + 1]).astype(np.int8) for k in range(3)), np.round(8 * np.log1p(size)).astype(np.int64)


def written(code: np.ndarray, steps: np.ndarray) -> list[str]:
    """Hex: three digits of length, then two bits for each bucket."""
    four = (code.reshape(len(code), BUCKETS // 4, 4) * np.array([64, 16, 4, 1])).sum(2).astype(np.uint8)
    return [f"{s:03x}{row.tobytes().hex()}" for s, row in zip(steps, four, strict=True)]


def likeness(a: np.ndarray, a_steps: np.ndarray, b: np.ndarray, b_steps: np.ndarray) -> np.ndarray:
    """1 for equal digests, 0 from the limit on."""
    d = _STEP[np.abs(a - b)].sum(1) + LENGTH_STEP * np.minimum(np.abs(a_steps - b_steps), MOST_LENGTH_STEPS)
    return np.round(np.maximum(0.0, 1 - d / (LIMIT * BUCKETS)), 6)


def digest(text: str | None) -> str:
    return written(*codes(Chunk.of([text or ""])))[0]


def compare(a: str, b: str) -> float:
    """Likeness of two written digests."""
    four = [np.frombuffer(bytes.fromhex(x[3:]), np.uint8) for x in (a, b)]
    code = [np.stack([x >> 6, x >> 4 & 3, x >> 2 & 3, x & 3], 1).reshape(1, -1).astype(np.int8) for x in four]
    steps = [np.array([int(x[:3], 16)]) for x in (a, b)]
    return float(likeness(code[0], steps[0], code[1], steps[1])[0])


def spliced(text: str, following: str) -> str:
    k = len(text) // 3
    return text[: len(text) - k] + following[:k]


_OUT = "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _judge(ids: list, texts: list[str]) -> pa.RecordBatch:
    """Rows for all but the last text, each with the text after it."""
    n = len(texts) - 1
    edited = [spliced(a, b) for a, b in zip(texts, texts[1:], strict=False)]
    own, after = [], []
    for batch, into in ((texts, own), (edited, after)):
        for c in chunks(pa.array(batch, pa.large_string())):
            into.append(codes(c))
    (a, la), (e, le) = ((np.concatenate([p[0] for p in x]), np.concatenate([p[1] for p in x])) for x in (own, after))
    return pa.RecordBatch.from_arrays(
        [pa.array(ids[:n], pa.int64()), pa.array([len(t) for t in texts[:n]], pa.int64()), pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited]), pa.array(written(a[:n], la[:n])), pa.array(written(e, le)), pa.array(likeness(a[:n], la[:n], e, le)), pa.array(likeness(a[:n], la[:n], a[1:], la[1:]))],
        names=[x.split()[0] for x in _OUT.split(", ")],
    )


def _stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows by range, each range with its own documents in order and then the first of the next range."""
    ids, texts, size, bucket, closed = [], [], 0, None, False
    for batch in batches:
        for b, extra, i, t in zip(*(x.to_pylist() for x in batch.columns), strict=True):
            if b != bucket:
                if len(texts) > 1:
                    yield _judge(ids, texts)
                ids, texts, size, bucket = [], [], 0, b
                closed = False
            if closed:
                continue
            closed = extra
            ids.append(i)
            texts.append(t or "")
            size += len(texts[-1])
            if size > 1 << 21 and len(texts) > 1:
                yield _judge(ids, texts)
                ids, texts, size = ids[-1:], texts[-1:], len(texts[-1])
    if len(texts) > 1:
        yield _judge(ids, texts)


#: Documents drawn, in expectation, for each range to find the ranges' bounds.
DRAWN = 20


class _Ranges:
    """Ranges of (id, hash of the text), both descending, null ids last, by the pairs that they end with."""

    def __init__(self, ends: list[tuple[int | None, int]]):
        ends = sorted(set(ends), key=self.order)
        known = [c for c in ends if c[0] is not None]
        # complements sort the other way round
        self.ids, self.marks = (~np.array([c[k] for c in known], np.int64) for k in (0, 1))
        self.nulls = ~np.array([c[1] for c in ends[len(known) :]], np.int64)

    @staticmethod
    def order(c: tuple[int | None, int]) -> tuple:
        return (c[0] is None, ~(c[0] or 0), ~c[1])

    def of(self, ids: pa.Array, marks: pa.Array) -> pa.Array:
        none = ids.is_null().to_numpy(zero_copy_only=False)
        i, m = ~ids.fill_null(0).to_numpy(), ~marks.to_numpy()
        lo, hi = np.searchsorted(self.ids, i, "left"), np.searchsorted(self.ids, i, "right")
        out = lo.copy()
        for k in np.flatnonzero((lo < hi) & ~none).tolist():
            out[k] += np.searchsorted(self.marks[lo[k] : hi[k]], m[k], "left")
        out[none] = len(self.ids) + np.searchsorted(self.nulls, m[none], "left")
        return pa.array(out.astype(np.int32))


def neighbours(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every document.

    The next document is the one with the next smaller doc_id (null last, equal ids by a hash of
    the text, the larger first), and after the last the first; a lone document follows itself.
    Null texts count as empty; an empty text has the digest of no triplets. Documents are dealt
    into ranges of that order, whose bounds are drawn by a hash; each range also gets the first document of
    the next, so nothing is sorted in one task. Rows equal in id and text share a range. What
    reaches the driver is DRAWN rows of two numbers for each range, and one more.
    """
    spark = docs.sparkSession
    ranges = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    source = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", F.xxhash64("text").alias("mark"))
    total = source.count()
    if not total:
        return spark.createDataFrame([], _OUT)
    every = max(1, total // (DRAWN * ranges))
    drawn = source.where(F.pmod(F.xxhash64("doc_id", "mark", F.lit(1)), F.lit(every)) == 0).select("doc_id", "mark").distinct()
    found = sorted(((r[0], r[1]) for r in drawn.collect()), key=_Ranges.order)
    bounds = _Ranges([found[k * len(found) // ranges] for k in range(1, ranges)] if found else [])

    @F.arrow_udf("int")
    def range_of(ids: pa.Array, marks: pa.Array) -> pa.Array:
        return bounds.of(ids, marks)

    keyed = source.withColumn("b", range_of("doc_id", "mark"))
    # the first of each range, in that order: the largest id, or else the largest hash
    top = F.max(F.struct(F.col("doc_id").isNotNull().alias("known"), F.col("doc_id"), F.col("mark")))
    tops = [(r[0], r[1]["doc_id"], r[1]["mark"]) for r in keyed.groupBy("b").agg(top).orderBy("b").collect()]
    # the range before each one reads on with its first document; before the first comes the last
    readers = [(i, m, tops[k - 1][0]) for k, (_, i, m) in enumerate(tops)]
    table = spark.createDataFrame(readers, "doc_id bigint, mark bigint, reader int")
    same = keyed["doc_id"].eqNullSafe(table["doc_id"]) & (keyed["mark"] == table["mark"])
    both = keyed.join(F.broadcast(table), same, "left").select(keyed["doc_id"], "text", keyed["mark"], "b", "reader")
    places = F.filter(F.array(F.struct(F.col("b"), F.lit(False).alias("extra")), F.struct(F.col("reader").alias("b"), F.lit(True).alias("extra"))), lambda x: x["b"].isNotNull())
    dealt = both.select(F.explode(places).alias("p"), "doc_id", "text", "mark").select("p.b", "p.extra", "doc_id", "text", "mark").repartition("b")
    ordered = dealt.sortWithinPartitions("b", "extra", F.desc_nulls_last("doc_id"), F.desc("mark"))
    return ordered.select("b", "extra", "doc_id", "text").mapInArrow(_stream, _OUT)
