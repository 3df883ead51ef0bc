"""Running a chunk function over a document table, and bounded labelled samples."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logloom.llm.textkit import Chunk, chunks


def give_back() -> None:
    """Returns memory to the system that allocators keep for later: a Python worker lives on, and each step would add its own to it."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass  # only glibc has it


def freeing(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, with unused memory given back when a task's batches end."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()

    return whole


def map_docs(df: DataFrame, keep: list[str], out: str, fn: Callable[[Chunk], dict], text: str = "text") -> DataFrame:
    """keep's columns and those that fn makes of each chunk of texts.

    out: DDL of the new columns; fn: returns one array of len(chunk) for each. A kept column with
    the name of a new one is left out. A few MB of text are held at a time, whatever the size
    of the Arrow batch; a single text is never cut.
    """
    names = [x.split()[0] for x in out.split(", ")]
    keep = [c for c in keep if c.lower() not in names]
    at = keep.index(text) if text in keep else len(keep)
    source = df.select(*keep, *([] if text in keep else [F.col(text).alias("__text")]))
    kinds = ", ".join(f"`{c}` {t}" for c, t in source.select(*keep).dtypes)
    target = f"{kinds}, {out}" if keep else out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(at)
            for c in chunks(column):
                made = fn(c)
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(c.first, c.n) for i in range(len(keep))), *(made[n] if isinstance(made[n], pa.Array) else pa.array(made[n]) for n in names)], names=[*keep, *names])

    return source.mapInArrow(freeing(run), target)


def crc_mod(column: str, mod: int):
    """crc32 of the column's text, modulo mod; null for null."""
    return F.crc32(F.col(column).cast("string")) % mod


def sampled(labels: DataFrame, bound: int) -> DataFrame:
    """The rows of labels whose hashed doc_id falls below a cut that leaves about bound of them.

    The cut depends on the row count alone, so every row is as likely as any other.
    """
    n = labels.count()
    cut = min(1.0, bound / max(n, 1))
    return labels if cut >= 1 else labels.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(cut * (1 << 20)))


def per_doc(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of values over [bounds[i], bounds[i + 1])."""
    sums = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=sums[1:])
    return sums[bounds[1:]] - sums[bounds[:-1]]


def grouped(batches: Iterator[pa.RecordBatch], column: str, least: int = 1) -> Iterator[pa.Table]:
    """Sorted batches cut anew so that equal values of column stay together, with at least `least` rows but for the last."""
    held: list[pa.Table] = []
    rows = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(pa.Table.from_batches([batch]))
        rows += batch.num_rows
        values = held[-1][column].to_numpy()
        if rows < least or values[0] == values[-1] and (len(held) == 1 or held[-2][column][-1].as_py() == values[0]):
            continue
        cut = int(np.searchsorted(values, values[-1]))
        rest = held[-1].slice(cut)
        held[-1] = held[-1].slice(0, cut)
        yield pa.concat_tables(held)
        held, rows = [rest], rest.num_rows
    if held:
        yield pa.concat_tables(held)
