"""Language identification with language-bitmask n-gram filters.

One Bloom filter serves all languages: each position holds a bit mask with one bit per
language, so ANDing the masks at an n-gram's positions gives every language that contains
it. A document's score for a language is the share of its n-grams that the language holds,
corrected for the false positives expected from how full that language's bits are.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logloom.llm.scan import crc_mod, map_docs
from logloom.llm.textkit import U64, Chunk, chunks, mix

#: Labelled documents the filters are built from for each language, in expectation.
SAMPLE = 3000
#: Bytes of the n-grams, positions of the filter (a power of two) and hash functions.
SIZES, SLOTS, HASHES = (3, 4), 1 << 20, 2
#: An n-gram belongs to a language if it has at least this count there, and at least this share of its greatest relative frequency in any language.
LEAST, SHARE = 3, 0.2
#: Languages of which a table is broadcast; any number can be learned, and the driver holds SLOTS / 8 bytes for each.
MOST_BROADCAST = 10_000

LETTER = np.zeros(256, bool)
LETTER[65:91] = LETTER[97:123] = LETTER[128:] = True


#: For each mask byte, its bits.
BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


@dataclass
class Model:
    """masks: a row of SLOTS bytes for each eight languages, a column for each position of the filter."""

    names: list[str]
    masks: np.ndarray = field(repr=False)
    false_rate: np.ndarray = field(repr=False)


def lowered(column: pa.Array) -> pa.Array:
    import pyarrow.compute as pc

    return pc.utf8_lower(column.fill_null(""))


def grams(c: Chunk) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each size, hashes of all n-grams of a chunk and their documents; what is no letter counts as one edge."""
    n = len(c.buf)
    if not n:
        return
    letter = LETTER[c.buf]
    doc = np.repeat(np.arange(c.n), np.diff(c.bounds))
    # a run of other bytes shrinks to its first, which is one edge
    starts = np.zeros(n, bool)
    starts[c.bounds[:-1][np.diff(c.bounds) > 0]] = True
    keep = letter | starts | np.concatenate(([True], letter[:-1]))
    b, d = np.where(letter, c.buf, 0x5F)[keep].astype(U64), doc[keep]
    for k in SIZES:
        if len(b) < k:
            continue
        code = np.zeros(len(b) - k + 1, U64)
        for i in range(k):
            code = (code << U64(8)) | b[i : len(b) - k + 1 + i]
        same = d[: len(b) - k + 1] == d[k - 1 :]
        yield mix(code[same] + U64(k << 56)), d[: len(b) - k + 1][same]


def slots(h: np.ndarray) -> list[np.ndarray]:
    return [((h >> U64(20 * i)) & U64(SLOTS - 1)).astype(np.int64) for i in range(HASHES)]


def build(counts: dict[str, tuple[np.ndarray, np.ndarray]]) -> Model:
    """counts: by language, n-gram hashes and how often each occurs."""
    names = sorted(counts)
    masks = np.zeros((max(1, -(-len(names) // 8)), SLOTS), np.uint8)
    if not names:
        return Model(names, masks, np.zeros(0))
    every = np.unique(np.concatenate([counts[x][0] for x in names]))
    best = np.zeros(len(every))
    rates = []
    for x in names:
        h, n = counts[x]
        rate, at = n / max(n.sum(), 1), np.searchsorted(every, h)
        np.maximum.at(best, at, rate)
        rates.append((at, rate))
    for i, x in enumerate(names):
        (at, rate), (h, n) = rates[i], counts[x]
        for s in slots(h[(n >= min(LEAST, n.max())) & (rate >= SHARE * best[at])]):
            np.bitwise_or.at(masks[i // 8], s, np.uint8(1 << i % 8))
    full = np.array([np.count_nonzero(masks[i // 8] & np.uint8(1 << i % 8)) / SLOTS for i in range(len(names))])
    return Model(names, masks, full**HASHES)


def fitted(docs: DataFrame, sample: int = SAMPLE) -> Model:
    """A model from about `sample` documents of each language; a null language teaches nothing."""
    known = docs.where("lang is not null and text is not null").select("doc_id", "text", "lang")
    sizes = known.groupBy("lang").count()
    cut = F.floor(F.least(F.lit(1.0), F.lit(float(sample)) / F.col("count")) * (1 << 20))
    cuts = sizes.select("lang", cut.alias("cut"))
    names = sorted(r[0] for r in cuts.select("lang").collect())
    drawn = known.join(F.broadcast(cuts) if len(names) <= MOST_BROADCAST else cuts, "lang").where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < F.col("cut"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}
        for batch in batches:
            langs = np.array(batch.column(1).to_pylist(), object)
            for c in chunks(lowered(batch.column(0))):
                own = langs[c.first : c.first + c.n]
                for h, d in grams(c):
                    for x in set(own):
                        held.setdefault(x, []).append(np.unique(h[own[d] == x], return_counts=True))
                for x, parts in held.items():
                    if len(parts) > 64:
                        held[x] = [_sum(parts)]
        for x, parts in held.items():
            h, n = _sum(parts)
            yield pa.RecordBatch.from_arrays([pa.array([x] * len(h)), pa.array(h.view(np.int64)), pa.array(n)], names=["lang", "h", "n"])

    rows = drawn.select("text", "lang").mapInArrow(count, "lang string, h bigint, n bigint").groupBy("lang", "h").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST).toPandas()
    rows = rows.sort_values(["lang", "h"])
    found = {x: (g["h"].to_numpy().view(U64), g["n"].to_numpy().astype(np.int64)) for x, g in rows.groupby("lang")}
    return build({x: found.get(x, (np.zeros(0, U64), np.zeros(0, np.int64))) for x in names if x in found})


def _sum(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    h, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    return h, np.bincount(at, np.concatenate([p[1] for p in parts]), minlength=len(h)).astype(np.int64)


def scores(c: Chunk, model: Model) -> np.ndarray:
    """Corrected shares of n-grams, a row for each document and a column for each language."""
    n = len(model.names)
    hits, total = np.zeros((n, c.n)), np.zeros(c.n)
    for h, d in grams(c):
        at = slots(h)
        found = model.masks[:, at[0]]
        for s in at[1:]:
            found &= model.masks[:, s]
        total += np.bincount(d, minlength=c.n)
        for k, part in enumerate(found):  # how often each document has each mask of eight languages
            seen = np.bincount((d << 8) | part, minlength=c.n << 8).reshape(c.n, 256)
            hits[8 * k : 8 * k + 8] += (seen @ BITS).T[: n - 8 * k]
    rate = model.false_rate[:, None]
    return np.clip((hits - rate * total) / np.maximum((1 - rate) * total, 1e-9), 0, 1).T


def predict(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep's columns, lang_pred and score of every document.

    `und` with score 0 if the text is null or has no letter, or if the model knows no
    language. Ties go to the first name. The score is the share of n-grams of the language
    found, relative to the sum over languages. Equal texts get equal results; a null doc_id
    and repeated rows are kept as they are.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def judge(c: Chunk) -> dict:
        m = shared.value
        if not m.names:
            return {"lang_pred": ["und"] * c.n, "score": np.zeros(c.n)}
        s = scores(c, m)
        best = s.argmax(1)
        ascii_letter = np.concatenate(([0], np.cumsum((LETTER & (np.arange(256) < 128))[c.buf])))
        has = ascii_letter[c.bounds[1:]] > ascii_letter[c.bounds[:-1]]
        for i in np.flatnonzero(~has):
            has[i] = any(ch.isalpha() for ch in c.text(i).decode())
        score = np.where(has, s[np.arange(c.n), best] / np.maximum(s.sum(1), 1e-9), 0.0)
        return {"lang_pred": [m.names[k] if ok else "und" for k, ok in zip(best, has, strict=True)], "score": np.round(score, 6)}

    return map_docs(docs.withColumn("__low", F.lower("text")), list(keep), "lang_pred string, score double", judge, "__low")


def held_out(column: str = "doc_id", mod: int = 4, rest: int = 2):
    return F.coalesce(crc_mod(column, mod) == rest, F.lit(False))
