"""Vectorised text primitives shared by the document operators.

A chunk of documents is held as one UTF-8 byte buffer; words, n-grams and lines are
index ranges into it, and all are hashed at once, so no step loops over words in Python.
White space is the byte set 0x20, 0x09-0x0D.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

U64 = np.uint64
_BASE = U64(0x9E3779B97F4A7C15)
_WORD_BASE = U64(0xD6E8FEB86659FD93)
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def mix(h: np.ndarray) -> np.ndarray:
    """SplitMix64 finaliser."""
    h = h ^ (h >> U64(30))
    h = h * U64(0xBF58476D1CE4E5B9)
    h ^= h >> U64(27)
    h = h * U64(0x94D049BB133111EB)
    h ^= h >> U64(31)
    return h


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of the bytes of each range (none empty).

    Up to eight bytes are one number, which is mixed without loss; up to sixteen are two; XXH64 takes the rest.
    """
    size = ends - starts
    pad = np.concatenate((buf, np.zeros(8, np.uint8)))
    at8 = np.ndarray((len(pad) - 7,), "<u8", pad, 0, (1,))
    short = np.minimum(size, 8).astype(U64)
    head = at8[starts] & (~U64(0) >> (U64(64) - (short << U64(3))))
    h = mix(head + size.astype(U64) * _BASE)
    long = np.flatnonzero(size > 8)
    if len(long):
        h[long] = mix(h[long] * _WORD_BASE + mix(at8[ends[long] - 8] + _BASE))
        far = np.flatnonzero(size > 16)
        h[far] = xxh64(buf, starts[far], ends[far], 0)
    return h


def gram_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """64-bit hash of each k consecutive entries, made pairwise from those of half the length."""
    if len(h) < k:
        return np.zeros(0, U64)
    width, whole, done, part = 1, h, 0, None
    while True:
        if k & width:  # the next `width` entries after the `done` ones
            piece = whole[done : done + len(h) - k + 1]
            part = piece if part is None else mix(part * _BASE + _rotl(piece, 31) + U64(width))
            done += width
        width *= 2
        if width > k:
            return part
        whole = mix(whole[: -(width // 2)] * _WORD_BASE + _rotl(whole[width // 2 :], 27) + U64(width))


def run_hashes(h: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """64-bit hash of each run h[s:s + n] (n > 0): every entry is mixed with its place in the run, so none cancels another."""
    if not len(starts):
        return np.zeros(0, U64)
    edge = np.cumsum(counts) - counts
    place = np.arange(int(edge[-1] + counts[-1])) - np.repeat(edge, counts)
    each = mix(h[place + np.repeat(starts, counts)] + (place + 1).astype(U64) * _BASE)
    return mix(np.add.reduceat(each, edge) + counts.astype(U64))


class Chunk:
    """Some consecutive documents of a batch: bytes and where each document begins and ends."""

    def __init__(self, buf: np.ndarray, bounds: np.ndarray, first: int):
        self.buf, self.bounds, self.first, self.n = buf, bounds, first, len(bounds) - 1

    @classmethod
    def of(cls, texts: list[str | None]) -> Chunk:
        return next(chunks(pa.array(texts, pa.string()), 1 << 40)) if texts else cls(np.zeros(0, np.uint8), np.zeros(1, np.int64), 0)

    def words(self) -> Words:
        space = IS_SPACE[self.buf]
        edge = np.zeros(len(self.buf) + 1, bool)
        edge[self.bounds] = True
        inside = ~space
        starts = np.flatnonzero(inside & (np.concatenate(([True], space[:-1])) | edge[:-1])) if len(space) else np.zeros(0, np.int64)
        ends = np.flatnonzero(inside & (np.concatenate((space[1:], [True])) | edge[1:])) + 1 if len(space) else np.zeros(0, np.int64)
        return Words(self, starts, ends)

    def lowered(self) -> Chunk:
        """A-Z in lower case; other bytes as they are."""
        return Chunk(np.frombuffer(self.buf.tobytes().lower(), np.uint8), self.bounds, self.first)

    def text(self, i: int) -> bytes:
        return self.buf[self.bounds[i] : self.bounds[i + 1]].tobytes()


class Words:
    """starts, ends: byte ranges; doc: each word's document; first: each document's first word (n + 1 entries)."""

    def __init__(self, chunk: Chunk, starts: np.ndarray, ends: np.ndarray):
        self.chunk, self.starts, self.ends = chunk, starts, ends
        self.first = np.searchsorted(starts, chunk.bounds)
        self.count = np.diff(self.first)
        self.doc = np.repeat(np.arange(chunk.n), self.count)
        self.n = len(starts)

    def hashes(self) -> np.ndarray:
        return word_hashes(self.chunk.buf, self.starts, self.ends)

    def ngram_starts(self, k: int) -> np.ndarray:
        """Words that begin k consecutive words of one document."""
        if self.n < k:
            return np.zeros(0, np.int64)
        return np.flatnonzero(self.doc[: self.n - k + 1] == self.doc[k - 1 :])

    def normalized(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Bytes with one space after each word, and the words' new starts and ends."""
        size = self.ends - self.starts
        new = np.zeros(self.n + 1, np.int64)
        np.cumsum(size + 1, out=new[1:])
        out = np.full(int(new[-1]), 0x20, np.uint8)
        if self.n:
            shift = np.repeat(self.starts - new[:-1], size + 1)
            at = np.arange(len(out))
            keep = np.ones(len(out), bool)
            keep[new[1:] - 1] = False
            out[keep] = self.chunk.buf[(at + shift)[keep]]
        return out, new[:-1], new[:-1] + size


def chunks(column: pa.Array, limit: int = 1 << 20) -> Iterator[Chunk]:
    """Whole documents of a string column, about limit bytes at a time; null counts as empty."""
    if pa.types.is_large_string(column.type):
        width = np.int64
    else:
        column, width = column.cast(pa.string()), np.int32
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if n == 0:
        return
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, width)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = min(n, max(i + 1, int(np.searchsorted(at, at[i] + limit, "right")) - 1))
        j = min(j, i + 4096)
        yield Chunk(raw[at[i] : at[j]], at[i : j + 1] - at[i], i)
        i = j


P1, P2, P3, P4, P5 = (U64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


#: Ranges of more bytes are hashed one by one by the library.
FAR = 1024


def _rotl(x: np.ndarray, r: int) -> np.ndarray:
    return (x << U64(r)) | (x >> U64(64 - r))


def _lane(acc: np.ndarray, v: np.ndarray) -> np.ndarray:
    return _rotl(acc + v * P2, 31) * P1


def xxh64(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int) -> np.ndarray:
    """XXH64 of buf[s:e] for each range, all ranges at once."""
    n = len(starts)
    if n == 0:
        return np.zeros(0, U64)
    pad = np.concatenate((buf, np.zeros(8, np.uint8)))
    u64 = np.ndarray((len(pad) - 7,), "<u8", pad, 0, (1,))
    u32 = np.ndarray((len(pad) - 3,), "<u4", pad, 0, (1,))
    s, size, at = U64(seed), (ends - starts).astype(U64), starts.astype(np.int64)
    with np.errstate(over="ignore"):
        h = np.full(n, s + P5, U64)
        far = np.flatnonzero(size > U64(FAR))
        long = np.flatnonzero((size >= U64(32)) & (size <= U64(FAR)))
        if len(long):
            lanes = [np.full(len(long), x, U64) for x in (s + P1 + P2, s + P2, s, s - P1)]
            stripes = (size[long] >> U64(5)).astype(np.int64)
            order = np.argsort(-stripes, kind="stable")
            long, stripes = long[order], stripes[order]
            for k in range(int(stripes[0])):
                live = int(np.searchsorted(-stripes, -k, "left"))
                base = starts[long[:live]] + 32 * k
                for i in range(4):
                    lanes[i][:live] = _lane(lanes[i][:live], u64[base + 8 * i])
            x = _rotl(lanes[0], 1) + _rotl(lanes[1], 7) + _rotl(lanes[2], 12) + _rotl(lanes[3], 18)
            for v in lanes:
                x = (x ^ _lane(np.zeros_like(v), v)) * P1 + P4
            h[long] = x
            at[long] += 32 * stripes
        h += size
        left = (ends - at).astype(np.int64)
        for _ in range(3):
            i = np.flatnonzero(left >= 8)
            if not len(i):
                break
            h[i] = _rotl(h[i] ^ _lane(np.zeros(len(i), U64), u64[at[i]]), 27) * P1 + P4
            at[i] += 8
            left[i] -= 8
        i = np.flatnonzero(left >= 4)
        h[i] = _rotl(h[i] ^ (u32[at[i]].astype(U64) * P1), 23) * P2 + P3
        at[i] += 4
        left[i] -= 4
        for _ in range(3):
            i = np.flatnonzero(left > 0)
            if not len(i):
                break
            h[i] = _rotl(h[i] ^ (pad[at[i]].astype(U64) * P5), 11) * P1
            at[i] += 1
            left[i] -= 1
        h ^= h >> U64(33)
        h *= P2
        h ^= h >> U64(29)
        h *= P3
        h ^= h >> U64(32)
    if len(far):
        raw = memoryview(np.ascontiguousarray(buf))
        h[far] = [xxhash.xxh64_intdigest(raw[a:b], seed) for a, b in zip(starts[far].tolist(), ends[far].tolist(), strict=True)]
    return h


def chars(column: pa.Array) -> np.ndarray:
    """Code points of each text; null counts as empty."""
    import pyarrow.compute as pc

    return pc.utf8_length(column.fill_null("")).to_numpy(zero_copy_only=False).astype(np.int64)
