"""The append-only store: Parquet by day, with a pool of large request parts.

Calls are only ever appended. A later append_seq supersedes an earlier one when read; narrow
reads prune columns, so bodies are not touched by lists and dashboards.
"""

from __future__ import annotations

import gzip
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.functions.providers import struct_of
from logloom.functions.scalars import record_size
from logloom.functions.udfs import cut_json
from logloom.operators.calls import VERSION, first_in_batch
from logloom.operators.lines import parsed_strictly

#: Request parts of at least so many bytes are kept once a day, by content.
LEAST_BLOB = 64
WHOLE, LISTED = ("system",), ("messages", "tools")
REFS = "array<struct<h:string,v:string>>"
#: Bytes of a batch as it is sent, and how many times as large its text may be.
MOST_WIRE, MOST_INFLATED = 64 << 20, 20
#: Records and bytes that one pushed batch holds at most.
BATCH_RECORDS, BATCH_BYTES = 64, 8 << 20
#: Bytes of requests that Python gets at a time, whatever the table's size.
CUT_BYTES = 4 << 20


def blob_hash(content: Column) -> Column:
    return F.substring(F.sha2(content, 256), 1, 32)


class Store:
    """Calls and blobs under one folder."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.calls_path, self.blobs_path = spark, f"{path}/calls", f"{path}/blobs"

    def _read(self, path: str, days: list[str] | None) -> DataFrame | None:
        """What is stored for some days (None: all), with the columns of all its files. Other days' folders aren't even listed."""
        from pyspark.errors import AnalysisException

        if days is not None and all(d and d.isalnum() for d in days):
            if not days:
                return None
            path, base = f"{path}/day={{{','.join(days)}}}", path
        else:
            base = path
        reader = self.spark.read.option("basePath", base).option("mergeSchema", "true")
        try:
            rows = reader.parquet(path).withColumn("day", F.col("day").cast("string"))
        except AnalysisException as e:
            if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                return None
            raise
        return rows if days is None else rows.where(F.col("day").isin(days))

    def calls(self, days: list[str] | None = None) -> DataFrame | None:
        """All versions as stored, of some days or of all, or None if nothing is."""
        return self._read(self.calls_path, days)

    def blobs(self, days: list[str] | None = None) -> DataFrame | None:
        return self._read(self.blobs_path, days)

    def append(self, calls: DataFrame) -> None:
        """Append versions; large request parts go to the pool first, those it lacks only.

        Blobs are written before the calls that point at them, so a call is never without its
        parts; blobs of an append that failed in between are found again by the next.
        """
        with settings(self.spark, {"spark.sql.execution.arrow.maxBytesPerBatch": str(CUT_BYTES)}):
            split, blobs = split_requests(calls)
            blobs = blobs.dropDuplicates(["day", "h"]).persist()
            try:
                pool = self.blobs(days_of(blobs))
                new = blobs if pool is None else blobs.join(pool.select("day", "h"), ["day", "h"], "left_anti")
                by_day(new).write.mode("append").partitionBy("day").parquet(self.blobs_path)
                by_day(split).write.mode("append").partitionBy("day").parquet(self.calls_path)
            finally:
                blobs.unpersist()

    def append_new(self, calls: DataFrame) -> None:
        """Append the first version of each request id that its day doesn't hold yet. Only the days of calls are read."""
        calls = calls.persist()
        try:
            self.append(fresh(calls, self.calls(days_of(calls))))
        finally:
            calls.unpersist()

    def inlined(self, calls: DataFrame) -> DataFrame:
        """calls with their requests whole again."""
        pool = self.blobs()
        return join_requests(calls, pool) if pool is not None else calls

    def replace_days(self, calls: DataFrame) -> None:
        """Rewrite the days that calls has, and no others."""
        calls.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(self.calls_path)


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]):
    """Settings that hold for what is begun meanwhile."""
    before = {k: spark.conf.get(k) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def by_day(rows: DataFrame) -> DataFrame:
    """rows dealt out for files by day: a file or a few of a day, not one for each task. A day of many bytes is split."""
    return rows.hint("rebalance", F.col("day"))


def days_of(rows: DataFrame) -> list[str]:
    """The days that rows have; they reach the driver."""
    return [r[0] for r in rows.select("day").distinct().collect()]


def fresh(rows: DataFrame, existing: DataFrame | None) -> DataFrame:
    """First versions of rows whose (day, request_id) isn't in existing."""
    first = first_in_batch(rows)
    return first if existing is None else first.join(existing.select(*VERSION), list(VERSION), "left_anti")


_cut = cut_json(WHOLE, LISTED)


def split_requests(calls: DataFrame) -> tuple[DataFrame, DataFrame]:
    """calls with request parts of LEAST_BLOB bytes or more replaced by pointers in refs, and the blobs (day, h, content).

    refs takes the place of request where something was lifted: pieces of its text in order,
    each with its text, or with the hash of a blob. So a request comes back byte for byte. One that is no
    object, or has nothing large, stays as it is.
    """
    if "refs" not in calls.columns:
        calls = calls.withColumn("refs", F.lit(None).cast(REFS))
    large = F.startswith(F.ltrim("request"), F.lit("{")) & (F.octet_length("request") >= LEAST_BLOB) & F.col("refs").isNull()
    cut = calls.withColumn("_cut", _cut(F.when(large, F.col("request"))))
    big = lambda p: p["part"] & (F.octet_length(p["v"]) >= LEAST_BLOB)
    refs = F.transform("_cut", lambda p: F.struct(F.when(big(p), blob_hash(p["v"])).alias("h"), F.when(~big(p), p["v"]).alias("v"))).cast(REFS)
    some = F.coalesce(F.exists("_cut", big), F.lit(False))
    blobs = cut.select("day", F.explode(F.filter("_cut", big)).alias("p")).select("day", blob_hash(F.col("p.v")).alias("h"), F.col("p.v").alias("content"))
    out = cut.withColumn("refs", F.when(some, refs).otherwise(F.col("refs"))).withColumn("request", F.when(~some, F.col("request")))
    return out.select(*calls.columns), blobs


def join_requests(calls: DataFrame, pool: DataFrame) -> DataFrame:
    """calls with requests made up again from refs; a request of which the pool lacks a blob is null."""
    key = [*VERSION, "append_seq"]
    refs = calls.where("refs is not null").select(*key, F.posexplode("refs").alias("i", "p")).select(*key, "i", "p.h", "p.v")
    plain, lifted = refs.where("h is null"), refs.where("h is not null").drop("v")
    found = lifted.join(pool.select("day", "h", F.col("content").alias("v")), ["day", "h"], "left")
    pieces = plain.select(*key, "i", "v").unionByName(found.select(*key, "i", "v"))
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("i", "v"))), lambda p: p["v"]), "")
    built = pieces.groupBy(*key).agg(F.when(F.bool_and(F.col("v").isNotNull()), text).alias("_request"))
    joined = calls.join(built, key, "left").withColumn("request", F.coalesce("request", "_request")).withColumn("refs", F.lit(None).cast(REFS))
    return joined.select(*calls.columns)


def read_batches(spark: SparkSession, path: str, schema: str, most_bytes: int = MOST_WIRE, most_inflated: int = MOST_INFLATED) -> DataFrame:
    """Pushed batches (JSON lines, gzip or plain) with file, and bad for what is refused.

    A file is taken up to its first line that isn't one JSON object with a request_id; that
    line and those after it are bad. So is all of a file of more than most_bytes, or whose
    text is more than most_inflated times as large.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("size"), F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("n")).alias("ord")).where(F.trim("value") != "")
    valid, row = parsed_strictly(F.col("value"), struct_of(schema))
    rows = lines.withColumns({"_valid": valid & F.startswith(F.ltrim("value"), F.lit("{")), "row": row})
    good = F.col("_valid") & F.coalesce(F.col("row.request_id") != "", F.lit(False))
    files = rows.groupBy("file").agg(F.min(F.when(~good, F.col("ord"))).alias("_end"), ((F.max("size") > most_bytes) | (F.sum(F.octet_length("value") + 1) > most_inflated * F.max("size"))).alias("_large"))
    bad = F.col("_large") | F.coalesce(F.col("ord") >= F.col("_end"), F.lit(False))
    return rows.withColumn("_good", good).join(files, "file").select(F.when(F.col("_good"), F.col("row")).alias("row"), "file", bad.alias("bad")).select("row.*", "file", "bad")


def push_batches(calls: DataFrame, records: int = BATCH_RECORDS, size: int = BATCH_BYTES) -> DataFrame:
    """calls with batch (string): oldest first, at most so many records and bytes in one; a larger record is alone.

    Ranges of time are cut side by side, so the last batch of a range may be small and no task
    sees the whole backlog. Only keys and sizes go through Python.
    """
    key = [*VERSION, "append_seq"]
    thin = calls.select(*key, "epoch", record_size(F.col("request"), F.col("response"), F.col("stream_content")).alias("size"))
    ordered = thin.repartitionByRange("epoch", "request_id").sortWithinPartitions("epoch", "request_id", "append_seq")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = held = total = 0
        for b in batches:
            numbers = []
            for n in b.column(len(key) + 1).to_pylist():
                if held and (held == records or total + n > size):
                    number, held, total = number + 1, 0, 0
                held, total = held + 1, total + n
                numbers.append(number)
            part = b.column(len(key)).to_pylist()
            yield pa.RecordBatch.from_arrays([*b.columns[: len(key)], pa.array([f"{p:06d}-{n:08d}" for p, n in zip(part, numbers, strict=True)], pa.string())], names=[*key, "batch"])

    return calls.join(ordered.select(*key, F.spark_partition_id().alias("part"), "size").mapInArrow(cut, "day string, request_id string, append_seq bigint, batch string"), key)


def send(batched: DataFrame, deliver: Callable[[str, bytes], tuple[int, int]]) -> DataFrame:
    """batch, sent, acked of push_batches() rows, each batch handed to deliver as gzipped JSON lines.

    deliver runs on the executors; it gets the batch's name and returns how many records were
    stored and how many were known. A batch is acknowledged only if these make up all it held; others are to be sent again.
    """
    lines = batched.select("batch", "epoch", "request_id", F.to_json(F.struct(*[c for c in batched.columns if c != "batch"])).alias("line"))

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, held = None, []

        def flush() -> pa.RecordBatch:
            stored, known = deliver(name, gzip.compress("".join(x + "\n" for x in held).encode(), 6))
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([len(held)], pa.int64()), pa.array([stored + known == len(held)])], names=["batch", "sent", "acked"])

        for b in batches:
            for batch, line in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if batch != name and held:
                    yield flush()
                    held = []
                name = batch
                held.append(line)
        if held:
            yield flush()

    ordered = lines.repartition("batch").sortWithinPartitions("batch", "epoch", "request_id").select("batch", "line")
    return ordered.mapInArrow(post, "batch string, sent bigint, acked boolean")
