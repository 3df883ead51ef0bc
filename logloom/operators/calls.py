"""Versions and filters of the calls table."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import datetime
from functools import reduce
from zoneinfo import ZoneInfo

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logloom.functions.scalars import outcome_of

VERSION = ("day", "request_id")
BODIES = ("preview", "request_id", "stream_content", "request", "response")


def latest(calls: DataFrame) -> DataFrame:
    """The last appended version of each request id within its day.

    One scan and one shuffle: each task drops the versions that it can see are superseded
    before the rows are dealt out. Filters have to come after.
    """
    nth = F.row_number().over(Window.partitionBy(*VERSION).orderBy(F.desc("append_seq")))
    return calls.withColumn("_nth", nth).where("_nth = 1").drop("_nth")


def latest_wide(calls: DataFrame) -> DataFrame:
    """latest() for tables with bodies: the winners are found on narrow columns and joined back."""
    top = calls.groupBy(*VERSION).agg(F.max("append_seq").alias("append_seq"))
    return calls.join(top, [*VERSION, "append_seq"], "left_semi")


def first_in_batch(rows: DataFrame) -> DataFrame:
    """The first version of each request id within its day."""
    nth = F.row_number().over(Window.partitionBy(*VERSION).orderBy("append_seq"))
    return rows.withColumn("_nth", nth).where("_nth = 1").drop("_nth")


@dataclass
class CallFilter:
    """What a list or dashboard request asks for; empty means no restriction."""

    model: str = ""
    token: str = ""
    status: str = ""
    stream: str = ""
    tools: str = ""
    errors: bool = False
    since: int = 0
    until: int = 0
    tool_name: str = ""
    search: str = ""
    tz: str = "UTC"
    days: tuple[str, str] | None = field(default=None, init=False)

    def conditions(self) -> list[Column]:
        out: list[Column] = []
        if self.model:
            out.append(F.col("model") == self.model)
        if self.token:
            out.append(F.col("token_name") == self.token)
        known = outcome_of(F.col("outcome"), F.col("status"))
        if self.status == "ok":
            out.append(known == "ok")
        elif self.status == "err":
            out.append(known == "error")
        if self.stream in ("0", "1"):
            out.append(F.col("is_stream") == F.lit(self.stream == "1"))
        if self.tools == "1":
            out.append(F.col("has_tools"))
        if self.errors:
            out.append(F.col("error_count") > 0)
        timeless = F.col("epoch") <= 0
        if self.since > 0:
            out.append(timeless | (F.col("epoch") >= self.since))
        if self.until > 0:
            out.append(timeless | (F.col("epoch") <= self.until))
        if self.tool_name:
            out.append(F.array_contains("tool_names", self.tool_name))
        if self.search:
            needle = F.lit(self.search.lower())
            out.append(reduce(lambda a, b: a | b, [F.coalesce(F.contains(F.lower(F.col(c)), needle), F.lit(False)) for c in BODIES]))
        return out

    def pruned(self, calls: DataFrame) -> DataFrame:
        """calls without days outside the range; this is a predicate on the partition column."""
        return prune_days(calls, self.since, self.until, self.tz)

    def apply(self, versions: DataFrame) -> DataFrame:
        return reduce(lambda df, c: df.where(c), self.conditions(), versions)


def prune_days(calls: DataFrame, since: int, until: int, tz: str = "UTC") -> DataFrame:
    """Rows whose day overlaps [since, until] in local time; 0 is open."""
    slice_ = lambda s: datetime.fromtimestamp(s, ZoneInfo(tz)).strftime("%Y%m%d")
    if since > 0:
        calls = calls.where(F.col("day") >= slice_(since))
    if until > 0:
        calls = calls.where(F.col("day") <= slice_(until))
    return calls


def matching(calls: DataFrame, f: CallFilter) -> DataFrame:
    """Latest versions that a filter accepts: the one source of lists and dashboards."""
    return f.apply(latest(f.pruned(calls)))


def worth_keeping(calls: DataFrame) -> DataFrame:
    """Calls with an error, a request, a bill or a failing status."""
    return calls.where((F.size("errors") > 0) | F.col("request").isNotNull() | F.col("billing").isNotNull() | F.coalesce(F.col("status") >= 400, F.lit(False)))


def allowed(rows: DataFrame, column: str, values: list[str]) -> DataFrame:
    """Rows whose column is among values; an empty list accepts all."""
    return rows.where(F.col(column).isin(values)) if values else rows
