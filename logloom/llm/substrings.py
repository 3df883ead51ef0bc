"""Substring dedup with FM-indexes over content-routed shards.

Every window of WINDOW words has a smallest k-gram hash; neighbouring windows that share it
form a segment, and equal windows, wherever they are, lie in segments with the same k-gram.
Segments are routed by it, so each shard sees all occurrences of its windows and the work
grows in proportion to the text. A segment whose k-gram occurs nowhere else has no copy.
Of all others, one of each kind (the earliest) is fetched as text; compressed FM-indexes over
wavelet trees are built on these, and each kind is streamed through them by backward search,
which reports the windows whose whole length matches, and where. A later copy of a kind has
that kind's report, moved to its place.

A k-gram that is common in a sample of the corpus routes its windows one by one, by their
own hashes, and copies that a task sees itself are dealt out by chance; so no key gathers
rows without bound. The sample decides about the routing only, never about the result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logloom.llm.fmindex import FMIndex
from logloom.llm.scan import grouped
from logloom.llm.tables import checkpointed
from logloom.llm.textkit import U64, Words, chunks, gram_hashes, mix, run_hashes

WINDOW, GRAM = 20, 8
#: One document in SAMPLE is looked at for common k-grams; COMMON or more occurrences there make one, and the MOST frequent
#: (8 MB) are kept. So a k-gram that isn't routed window by window has no more than about SAMPLE * COMMON segments, or,
#: in a corpus with more than MOST common ones, a share of all segments of less than one in MOST.
SAMPLE, COMMON, MOST = 128, 16, 1 << 20
#: Segments that one FM-index holds; where more of them share a k-gram, each is searched for in several indexes.
SHARD = 1 << 15
#: place: start << 32 | windows << 2 | state
_ROWS = "rk bigint, sh bigint, key bigint, th bigint, place bigint"
_KEYS = ["rk", "sh", "key", "th"]
#: LOOPS: a segment that repeats itself or has copies, so that all its windows are looked up; COPY: an earlier one is equal;
#: OPEN: any other, of which the windows that occur elsewhere are looked up.
OPEN, LOOPS, COPY = 0, 1, 2


def _least(g: np.ndarray, k: int) -> np.ndarray:
    """Minimum of each k consecutive entries."""
    m, width = g, 1
    while 2 * width <= k:
        m = np.minimum(m[:-width], m[width:])
        width *= 2
    return np.minimum(m[: len(m) - (k - width)], m[k - width :]) if width < k else m


def _repeated(values: np.ndarray, group: np.ndarray, groups: int) -> np.ndarray:
    """Which groups hold a value twice."""
    own = mix(values ^ (group.astype(U64) * U64(0x9E3779B97F4A7C15)))
    slot = (own >> U64(43)).astype(np.int64)
    last = np.empty(1 << 21, np.int32)
    last[slot] = np.arange(len(slot), dtype=np.int32)
    shared = np.zeros(1 << 21, bool)
    shared[slot[last[slot] != np.arange(len(slot))]] = True
    few = np.flatnonzero(shared[slot])  # all others are alone in their slot
    few = few[np.argsort(own[few], kind="stable")]
    out = np.zeros(groups, bool)
    out[group[few[1:]][own[few[1:]] == own[few[:-1]]]] = True
    return out


def segments(w: Words, common: np.ndarray) -> dict[str, np.ndarray]:
    """rk, sh (uint64), doc, start (word in its document), wins (windows) and loops (a window occurs twice in it) of a chunk's segments.

    common: sorted k-gram hashes whose windows are segments of their own.
    """
    at = w.ngram_starts(WINDOW)
    none = np.zeros(0, np.int64)
    if not len(at):
        return {"rk": none.astype(U64), "sh": none.astype(U64), "doc": none, "start": none, "wins": none, "loops": none.astype(bool)}
    h = w.hashes()
    rk = _least(gram_hashes(h, GRAM), WINDOW - GRAM + 1)[at]
    whole = gram_hashes(h, WINDOW)[at]
    alone = common[np.minimum(np.searchsorted(common, rk), len(common) - 1)] == rk if len(common) else np.zeros(len(rk), bool)
    doc = w.doc[at]
    new = np.concatenate(([True], (rk[1:] != rk[:-1]) | (doc[1:] != doc[:-1]))) | alone
    first = np.flatnonzero(new)
    wins = np.diff(np.append(first, len(at)))
    loops = _repeated(whole, np.cumsum(new) - 1, len(first))
    return {"rk": np.where(alone[first], whole[first], rk[first]), "sh": run_hashes(whole, first, wins), "doc": doc[first], "start": at[first] - w.first[doc[first]], "wins": wins, "loops": loops}


def _batch(names: str, *columns: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c.view(np.int64) if c.dtype == U64 else c) for c in columns], names=names.split())


def _split(common: np.ndarray):
    """Segments of (key, th, text) batches; of equal ones in a batch, all but the earliest are copies."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, marks = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            found = []
            for c in chunks(batch.column(2)):
                s = segments(c.words(), common)
                doc = c.first + s.pop("doc")
                found.append(s | {"key": ids[doc], "th": marks[doc]})
            s = {k: np.concatenate([x[k] for x in found]) for k in found[0]} if found else None
            if s is None or not len(s["rk"]):
                continue
            state = np.where(s["loops"], LOOPS, OPEN)
            both = mix(s["rk"]) ^ s["sh"]
            order = np.argsort(both, kind="stable")
            twice = np.concatenate(([False], both[order[1:]] == both[order[:-1]]))
            some = order[twice | np.append(twice[1:], False)]
            some = some[np.lexsort((s["start"][some], s["th"][some], s["key"][some], both[some]))]
            head = np.concatenate(([True], both[some[1:]] != both[some[:-1]]))[: len(some)]
            lead = some[np.flatnonzero(head)[np.cumsum(head) - 1]] if len(some) else some
            later = some[(s["key"][some] != s["key"][lead]) | (s["th"][some] != s["th"][lead]) | (s["start"][some] != s["start"][lead])]
            state[lead] = LOOPS
            state[later] = COPY
            yield _batch("rk sh key th place", s["rk"], s["sh"], s["key"], s["th"], s["start"] << 32 | s["wins"] << 2 | state)

    return run


def _parts(place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """start, windows and state of packed places."""
    return place >> 32, (place & 0xFFFFFFFF) >> 2, place & 3


def _settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by all columns: segments that need an index, and later copies of them; the others go."""
    for t in grouped(batches, "rk"):
        rk, sh, key, th, place = (t[c].to_numpy() for c in (*_KEYS, "place"))
        start, wins, state = _parts(place)
        free = np.flatnonzero(state != COPY)
        new_rk = np.concatenate(([True], rk[free][1:] != rk[free][:-1]))[: len(free)]
        new = new_rk | np.concatenate(([True], sh[free][1:] != sh[free][:-1]))[: len(free)]
        kind, group = np.cumsum(new) - 1, np.cumsum(new_rk) - 1
        lead = free[np.flatnonzero(new)[kind]] if len(free) else free
        later = (key[free] != key[lead]) | (th[free] != th[lead]) | (start[free] != start[lead])
        kinds = np.bincount(group, new) if len(group) else np.zeros(0)
        # a kind is looked up if its k-gram has another kind, if it repeats itself, or if it has copies
        wanted = np.bincount(kind, later | (state[free] == LOOPS)) > 0 if len(kind) else np.zeros(0, bool)
        need = new & ((kinds[group] > 1) | wanted[kind])
        now = state.copy()
        now[free] = np.where(later, COPY, np.where(need, np.where(wanted[kind], LOOPS, OPEN), -1))
        keep = np.flatnonzero(now >= 0)
        if len(keep):
            yield _batch("rk sh key th place", rk[keep], sh[keep], key[keep], th[keep], start[keep] << 32 | wins[keep] << 2 | now[keep])


def _run_hashes(w: Words, first: np.ndarray, wins: np.ndarray) -> np.ndarray:
    """Hashes of runs of windows that begin at words."""
    return run_hashes(gram_hashes(w.hashes(), WINDOW), first, wins)


def _present(w: Words, doc: np.ndarray, start: np.ndarray, wins: np.ndarray, sh: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First words in the chunk of the runs of windows that their documents really have there, and which these are."""
    start, wins = start.astype(np.int64), wins.astype(np.int64)
    ok = np.flatnonzero(start + wins + WINDOW - 1 <= w.count[doc]) if len(doc) else np.zeros(0, np.int64)
    lo = w.first[doc[ok]] + start[ok]
    same = _run_hashes(w, lo, wins[ok]).view(np.int64) == sh[ok] if len(ok) else np.zeros(0, bool)
    return lo[same], ok[same]


def _fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of (key, th, text, list of segments): rk, sh, key, th, start, whole (all windows are wanted) and the segment's text, for the segments that are in the text."""
    for batch in batches:
        lists = batch.column(3)
        for c in chunks(batch.column(2)):
            w = c.words()
            own = lists.slice(c.first, c.n)
            flat = own.flatten()
            doc = np.repeat(np.arange(c.n), np.diff(own.offsets.to_numpy()))
            rk, sh, place = (flat.field(i).to_numpy(zero_copy_only=False) for i in range(3))
            start, wins, state = _parts(place)
            lo, ok = _present(w, doc, start, wins, sh)
            hi = lo + wins[ok] + WINDOW - 1
            texts = [c.buf[a:b].tobytes().decode() for a, b in zip(w.starts[lo].tolist(), w.ends[hi - 1].tolist(), strict=True)]
            at = c.first + doc[ok]
            yield _batch("rk sh key th start whole words", rk[ok], sh[ok], batch.column(0).to_numpy()[at], batch.column(1).to_numpy()[at], start[ok], state[ok] == LOOPS, pa.array(texts, pa.string()))


class _Shard:
    """An FM-index over some segments, and the places of their windows."""

    def __init__(self, h: np.ndarray, size: np.ndarray, key: np.ndarray, th: np.ndarray, start: np.ndarray):
        self.symbols, symbol = np.unique(h, return_inverse=True)
        seg = np.repeat(np.arange(len(size)), size)
        at = np.arange(len(h)) + seg + 1  # number 0 before each segment
        text = np.zeros(len(h) + len(size) + 1, np.int64)
        text[at] = symbol + 1
        self.index = FMIndex(text, WINDOW)
        self.begin = np.cumsum(size + 1) - size
        self.key, self.th, self.start = key, th, start

    def find(self, h: np.ndarray, first: np.ndarray, others: int) -> tuple[np.ndarray, tuple[np.ndarray, ...]]:
        """Which of the windows of h that begin at first occur here more than `others` times, and the earliest places (key, th, start) of these."""
        at = np.minimum(np.searchsorted(self.symbols, h), len(self.symbols) - 1)
        full, lo = self.index.whole(np.where(self.symbols[at] == h, at + 1, 0), first + WINDOW, others)
        place = self.index.earliest(lo)
        seg = np.searchsorted(self.begin, place, "right") - 1
        return full, (self.key[seg], self.th[seg], self.start[seg] + place - self.begin[seg])


def _search(t: pa.Table) -> Iterator[pa.RecordBatch]:
    """Windows of segments' texts that occur in one of the indexes on them: from (a run's first window in its segment), wins, sh of the run, and own (it occurs at an earlier place; else it is for the copies)."""
    key, th, start = (t[c].to_numpy() for c in ("key", "th", "start"))
    t = t.take(pa.array(np.lexsort((start, th, key))))
    shards: list[_Shard] = []
    for block in (t.slice(i, SHARD) for i in range(0, t.num_rows, SHARD)):
        rk, sh, key, th, start, every = (block[c].to_numpy() for c in ("rk", "sh", "key", "th", "start", "whole"))
        parts = [c.words() for c in chunks(block["words"].combine_chunks())]
        h, size = np.concatenate([w.hashes() for w in parts]), np.concatenate([w.count for w in parts])
        shards.append(_Shard(h, size, key, th, start))
        seg = np.repeat(np.arange(len(size)), size)
        nth = np.arange(len(h)) - np.repeat(np.cumsum(size) - size, size)
        first = np.flatnonzero(nth + WINDOW <= size[seg])
        k, m, p = key[seg[first]], th[seg[first]], start[seg[first]] + nth[first]
        before, found = np.zeros(len(first), bool), np.zeros(len(first), bool)
        for shard in shards:
            # in its own index a window is known to occur once
            for which, others in ((np.flatnonzero(every[seg[first]]), 0), (np.flatnonzero(~every[seg[first]]), int(shard is shards[-1]))):
                full, (k2, m2, p2) = shard.find(h, first[which], others)
                full = which[full]
                k1, m1, p1 = k[full], m[full], p[full]
                found[full] = True
                before[full] |= (k2 < k1) | (k2 == k1) & ((m2 < m1) | (m2 == m1) & (p2 < p1))
        found &= every[seg[first]]  # who has no copies needs no report for them
        whole = gram_hashes(h, WINDOW)
        for which, own in ((before, True), (found, False)):
            at = first[which]
            if not len(at):
                continue
            new = np.concatenate(([True], (at[1:] != at[:-1] + 1) | (seg[at[1:]] != seg[at[:-1]])))
            run, wins = at[new], np.diff(np.append(np.flatnonzero(new), len(at)))
            s = seg[run]
            yield _batch("rk sh key th start from wins run own", rk[s], sh[s], key[s], th[s], start[s], nth[run], wins, run_hashes(whole, run, wins), np.full(len(run), own))


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for t in grouped(batches, "rk", SHARD // 2):
        yield from _search(t)


def covered(w: Words, doc: np.ndarray, start: np.ndarray, wins: np.ndarray, sh: np.ndarray) -> np.ndarray:
    """Which words of a chunk lie in a reported window."""
    lo, ok = _present(w, doc, start, wins, sh)
    step = np.zeros(w.n + 1, np.int64)
    np.add.at(step, lo, 1)
    np.add.at(step, lo + wins[ok].astype(np.int64) + WINDOW - 1, -1)
    return np.cumsum(step[:-1]) > 0


def _apply(with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            for c in chunks(batch.column(1)):
                w = c.words()
                own = lists.slice(c.first, c.n)
                count = np.nan_to_num(own.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
                flat = own.flatten()
                doc = np.repeat(np.arange(c.n), count)
                sh, start, wins = (flat.field(i).to_numpy(zero_copy_only=False) for i in range(3))
                gone = covered(w, doc, start, wins, sh) if len(doc) else np.zeros(w.n, bool)
                kept = kept_texts(w, ~gone)
                out = [batch.column(0).slice(c.first, c.n), pa.array(w.count.astype(np.int64)), pa.array(np.bincount(w.doc[gone], minlength=c.n).astype(np.int64)), pa.array([hashlib.sha256(x).hexdigest() for x in kept])]
                names = ["doc_id", "n_words", "n_removed", "kept_sha256"]
                if with_text:
                    out.append(pa.array([x.decode() for x in kept], pa.string()))
                    names.append("kept_text")
                yield pa.RecordBatch.from_arrays(out, names=names)

    return run


def kept_texts(w: Words, keep: np.ndarray) -> list[bytes]:
    """Each document's kept words, joined by one space."""
    buf, starts, ends = w.normalized()
    raw = buf[np.repeat(keep, ends - starts + 1)].tobytes()
    length = np.concatenate(([0], np.cumsum(np.where(keep, ends - starts + 1, 0))))[w.first]
    return [raw[a : b - 1] if b > a else b"" for a, b in zip(length[:-1].tolist(), length[1:].tolist(), strict=True)]


def dedup(docs: DataFrame, with_text: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 (and kept_text if asked for) of every document.

    A word goes if a window over it also starts earlier: in a smaller doc_id, or before in the
    same document. Null texts have no words; texts of fewer than WINDOW words stay whole. A
    null doc_id counts as the largest, and among these the hash of the text decides; rows that
    repeat another doc_id are compared by their starts like one document, and rows equal in
    all get equal results. Other columns are not read.
    """
    none = (1 << 63) - 1
    doc_id = F.col("doc_id").cast("bigint")
    # th keeps rows without an id apart, so that they share no key
    source = docs.select(F.coalesce(doc_id, F.lit(none)).alias("key"), F.when(doc_id.isNull(), F.xxhash64("text")).otherwise(0).alias("th"), doc_id.alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    texts = source.select("key", "th", "text")
    common = np.sort(np.array(_often(texts), np.int64).view(U64))
    copy = F.col("place").bitwiseAND(3) == COPY
    routed = texts.mapInArrow(_split(common), _ROWS).repartition(F.when(copy, F.xxhash64("key", "place")).otherwise(F.col("rk"))).sortWithinPartitions(*_KEYS, "place")
    settled = checkpointed(routed.mapInArrow(_settle, _ROWS))
    wanted = settled.where(~copy).groupBy("key", "th").agg(F.collect_list(F.struct("rk", "sh", "place")).alias("segs"))
    fetched = texts.join(wanted, ["key", "th"]).select("key", "th", "text", "segs").mapInArrow(_fetch, "rk bigint, sh bigint, key bigint, th bigint, start bigint, whole boolean, words string")
    reported = checkpointed(fetched.repartition("rk").sortWithinPartitions("rk").mapInArrow(_index, "rk bigint, sh bigint, key bigint, th bigint, start bigint, from bigint, wins bigint, run bigint, own boolean"))
    mine = reported.where("own").select("key", "th", F.col("run").alias("sh"), (F.col("start") + F.col("from")).alias("start"), "wins")
    kinds = reported.where("not own").select("rk", "sh", "from", "wins", "run").distinct()
    copies = settled.where(copy).select("rk", "sh", "key", "th", F.shiftright("place", 32).alias("start"))
    theirs = copies.join(kinds, ["rk", "sh"]).select("key", "th", F.col("run").alias("sh"), (F.col("start") + F.col("from")).alias("start"), "wins")
    lists = mine.unionByName(theirs).groupBy("key", "th").agg(F.collect_list(F.struct("sh", "start", "wins")).alias("spans"))
    joined = source.join(lists, ["key", "th"], "left").select("doc_id", "text", "spans")
    return joined.mapInArrow(_apply(with_text), "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string" + ", kept_text string" * with_text)


def _often(texts: DataFrame) -> list[int]:
    """k-grams that lead COMMON or more segments in the sampled documents; MOST of them at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c in chunks(batch.column(0)):
                rk, n = np.unique(segments(c.words(), np.zeros(0, U64))["rk"], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(rk.view(np.int64)), pa.array(n)], names=["rk", "n"])

    drawn = texts.where(F.pmod(F.xxhash64("key", "th"), F.lit(SAMPLE)) == 0).select("text")
    counted = drawn.mapInArrow(run, "rk bigint, n bigint").groupBy("rk").agg(F.sum("n").alias("n")).where(F.col("n") >= COMMON)
    return [r[0] for r in counted.orderBy(F.desc("n"), "rk").limit(MOST).select("rk").collect()]
