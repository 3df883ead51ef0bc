"""Reading gateway logs as entries: a line, or a pretty-printed body joined to its line."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of an entry; lines beyond are left out of it, and an entry whose first line is longer is dropped.
LONGEST = 16 << 20


def opens_value(line: Column) -> Column:
    """Whether a line ends in an opening brace or bracket, and so goes on below."""
    return F.rlike(line, F.lit(r"[{\[][ \t\r]*\z"))


def entry_of(chunk: Column) -> Column:
    """The entry in a piece of text between two line starts with '['."""
    text = F.regexp_replace(F.when(F.startswith(chunk, F.lit("[")), chunk).otherwise(F.concat(F.lit("["), chunk)), "\r(?=\n|\\z)", "")
    text = F.regexp_replace(text, r"\n+\z", "")
    first = F.substring_index(text, "\n", 1)
    return F.when(opens_value(first), text).otherwise(first)


def read_entries(spark: SparkSession, path: str) -> DataFrame:
    """value, file, ord: the entries of all files, ord in order of file time, name and place."""
    rows = spark.read.option("lineSep", "\n[").text(path)
    return entries_of(_with_place(rows).withColumn("seq", F.monotonically_increasing_id()))


def stream_entries(spark: SparkSession, path: str, max_files: int = 1000, clean: str | None = None, archive: str | None = None) -> DataFrame:
    """read_entries() of a growing folder of closed log segments; clean: archive or delete what was read."""
    reader = spark.readStream.option("lineSep", "\n[").option("maxFilesPerTrigger", max_files)
    if clean:
        reader = reader.option("cleanSource", clean)
        if clean == "archive":
            reader = reader.option("sourceArchiveDir", archive)
    meta = _with_place(reader.text(path))
    return entries_of(meta.mapInArrow(_numbered, f"{', '.join(f'{n} {t}' for n, t in meta.dtypes)}, seq bigint"))


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a task with their number; streams have no built-in for it."""
    n = 0
    for b in batches:
        yield b.append_column("seq", pa.array(range(n, n + b.num_rows), pa.int64()))
        n += b.num_rows


def _with_place(rows: DataFrame) -> DataFrame:
    return rows.select("value", F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_modification_time").alias("mtime"), F.col("_metadata.file_block_start").alias("block"))


def within(text: Column, most: int = LONGEST) -> Column:
    """An entry cut back to its whole lines within so many bytes; null if the first alone is longer."""
    head = F.make_valid_utf8(F.substring(text.cast("binary"), 1, most).cast("string"))
    lines = F.left(head, F.length(head) - F.length(F.substring_index(head, "\n", -1)) - 1)
    return F.when(F.octet_length(text) <= most, text).when(F.contains(head, F.lit("\n")), lines)


def entries_of(meta: DataFrame) -> DataFrame:
    """value, file, ord of pieces of text (value) with file, mtime, block and seq."""
    kept = meta.withColumn("value", within(entry_of(F.col("value")))).where("value is not null")
    return kept.select("value", "file", F.struct("mtime", "file", "block", "seq").alias("ord"))
