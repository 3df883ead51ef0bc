"""Best-fit packing of token sequences by large-item matching.

Only the number of pieces of each length matters for a packing, and there are no more
lengths than tokens in a sequence. So the packing is made on that histogram: pieces above a
third of the capacity are matched greedily, at most two in a sequence, the largest with the
largest that fits; smaller ones, the longest first, go where the least room is left. The
result says where the pieces of each length go by their rank among equals, and every piece
finds its place by its length and rank.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logloom.llm.scan import map_docs
from logloom.llm.tables import checkpointed
from logloom.llm.textkit import Chunk
from logloom.llm.tokens import shared

CAPACITY = 4096
#: Pieces of one length that are ranked together, on average; as many parts are made as that takes.
RANKED = 100_000
#: Rows that a plan has at most for each token of the capacity, whatever the number of pieces (so it can be broadcast): large
#: pieces make two rows for each length at most and as many runs of gaps; a small length either ends in a row or uses up
#: a run, and what is left of a run's gap is less than half of it, so a run is used twelve times at most at 4096.
MOST_ROWS = 72

#: length, first rank, end rank, first sequence, pieces to a sequence, offset of the first of them
Slot = tuple[int, int, int, int, int, int]


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[Slot]:
    """Where the pieces go, given how many there are of each length."""
    left = [0] * (capacity + 1)
    for length, n in counts.items():
        left[length] += n
    used, bins, out = [0] * (capacity + 1), 0, []
    gaps: dict[int, list[tuple[int, int]]] = {}
    open_gaps: list[int] = []

    def release(gap: int, lo: int, hi: int) -> None:
        if hi > lo and gap > 0:
            if not gaps.get(gap):
                gaps[gap] = []
                insort(open_gaps, gap)
            gaps[gap].append((lo, hi))

    def put(length: int, n: int, first: int, each: int, offset: int) -> None:
        out.append((length, used[length], used[length] + n, first, each, offset))
        used[length] += n
        left[length] -= n

    third = capacity // 3
    for large in range(capacity, third, -1):
        while left[large]:
            partner = min(capacity - large, large)
            while partner > third and left[partner] < (2 if partner == large else 1):
                partner -= 1
            if partner <= third:
                n = left[large]
                put(large, n, bins, 1, 0)
                release(capacity - large, bins, bins + n)
            elif partner == large:
                n = left[large] // 2
                put(large, 2 * n, bins, 2, 0)
                release(capacity - 2 * large, bins, bins + n)
            else:
                n = min(left[large], left[partner])
                put(large, n, bins, 1, 0)
                put(partner, n, bins, 1, large)
                release(capacity - large - partner, bins, bins + n)
            bins += n
    for small in range(third, 0, -1):
        while left[small]:
            k = bisect_left(open_gaps, small)
            if k == len(open_gaps):
                n = -(-left[small] // (capacity // small))
                release(capacity, bins, bins + n)
                bins += n
                continue
            gap = open_gaps[k]
            lo, hi = gaps[gap].pop()
            if not gaps[gap]:
                open_gaps.pop(k)
            each, n = gap // small, left[small]
            full = min(n // each, hi - lo)
            if full:
                put(small, full * each, lo, each, capacity - gap)
                release(gap - each * small, lo, lo + full)
                lo += full
            rest = min(left[small], each - 1) if lo < hi and left[small] < each else 0
            if rest:
                put(small, rest, lo, rest, capacity - gap)
                release(gap - rest * small, lo, lo + 1)
                lo += 1
            release(gap, lo, hi)
    return out


def pieces(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str | None = None, end: int = 1, keep_ids: bool = False) -> DataFrame:
    """doc_id, piece (int), start, length, ids_crc32 (long) of every piece, and ids (array<int>) if asked for.

    A text's ids are followed by end; what is longer than capacity is cut into pieces of
    capacity and a rest. Null counts as empty, so each document has one piece at least;
    a null doc_id and repeated rows are kept.
    """
    made = "starts array<bigint>, lengths array<bigint>, crcs array<bigint>" + (", parts array<array<int>>" if keep_ids else "")

    def cut(c: Chunk) -> dict:
        ids, begin = shared(tokenizer, end).encode(c)
        raw = memoryview(ids.astype("<u4").tobytes())
        size = np.diff(begin)
        n = -(-size // capacity)
        doc = np.repeat(np.arange(c.n), n)
        nth = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
        lo = begin[doc] + nth * capacity
        hi = np.minimum(lo + capacity, begin[doc + 1])
        crc = np.array([zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(lo.tolist(), hi.tolist(), strict=True)], np.int64)
        edge = pa.array(np.concatenate(([0], np.cumsum(n))).astype(np.int32))
        listed = lambda v: pa.ListArray.from_arrays(edge, pa.array(v))
        out = {"starts": listed(nth * capacity), "lengths": listed(hi - lo), "crcs": listed(crc)}
        if keep_ids:
            inner = pa.ListArray.from_arrays(pa.array(np.concatenate((lo, hi[-1:])).astype(np.int32)), pa.array(ids.astype(np.int32)))
            out["parts"] = pa.ListArray.from_arrays(edge, inner)
        return out

    lists = map_docs(docs, ["doc_id"], made, cut)
    columns = ["starts", "lengths", "crcs"] + ["parts"] * keep_ids
    each = lists.select("doc_id", F.posexplode(F.arrays_zip(*columns)).alias("piece", "p"))
    return each.select("doc_id", "piece", F.col("p.starts").alias("start"), F.col("p.lengths").alias("length"), F.col("p.crcs").alias("ids_crc32"), *([F.col("p.parts").alias("ids")] if keep_ids else []))


def assign(parts: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """parts (doc_id, piece, length of 1 to capacity, ids_crc32, more) with sequence_id and offset (long).

    Pieces of equal length are ranked by id, piece and checksum, in parts by a hash of them, so
    a length that a third of all pieces have is not ranked in one task; rows that are equal in
    all of these may be in any order. Only the count of each length reaches the driver, and the
    plan that it makes of these is broadcast: its size depends on the capacity alone. Names that begin with two
    underscores are ours.
    """
    parts = checkpointed(parts.drop("sequence_id", "offset"))
    counts = {r[0]: r[1] for r in parts.groupBy("length").count().collect()}
    spread = -(-max(counts.values(), default=1) // RANKED)
    keyed = parts.withColumn("__part", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(spread)))
    sizes = keyed.groupBy("length", "__part").agg(F.count("*").alias("__n"))
    slots = plan(counts, capacity)
    if len(slots) > MOST_ROWS * capacity:
        raise ValueError(f"a plan of {len(slots)} rows")
    before = Window.partitionBy("length").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("length", "__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    ranked = keyed.withColumn("__rank", F.row_number().over(Window.partitionBy("length", "__part").orderBy("doc_id", "piece", "ids_crc32")) - 1)
    ranked = ranked.join(sizes, ["length", "__part"]).withColumn("__rank", F.col("__rank") + F.col("__before"))
    columns = list(zip(*slots, strict=True)) or [()] * 6
    names = ["__length", "__lo", "__hi", "__first", "__each", "__at"]
    table = F.broadcast(parts.sparkSession.createDataFrame(pa.table({n: pa.array(v, pa.int64()) for n, v in zip(names, columns, strict=True)})))
    placed = ranked.join(table, (F.col("length") == F.col("__length")) & (F.col("__rank") >= F.col("__lo")) & (F.col("__rank") < F.col("__hi")))
    nth = F.col("__rank") - F.col("__lo")
    return placed.select(*parts.columns, (F.col("__first") + F.floor(nth / F.col("__each"))).cast("bigint").alias("sequence_id"), (F.col("__at") + nth % F.col("__each") * F.col("length")).cast("bigint").alias("offset"))


def sequences(placed: DataFrame) -> DataFrame:
    """sequence_id and ids (array<int>) of each packed sequence, from placed pieces that hold their ids."""
    held = placed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("p"))
    return held.select("sequence_id", F.flatten(F.transform("p", lambda x: x["ids"])).alias("ids"))
