"""Lists, pages, option sets and point lookups."""

from __future__ import annotations

import time
from datetime import datetime
from zoneinfo import ZoneInfo

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom.functions.scalars import html_escape
from logloom.operators.calls import CallFilter, latest, matching


def ordered(calls: DataFrame) -> DataFrame:
    """Newest first."""
    return calls.orderBy(F.desc("ts"), F.desc("request_id"))


def page(calls: DataFrame, number: int = 1, size: int = 20) -> DataFrame:
    """One page of an ordered list: numbers from 1, sizes from 1 to 200."""
    number, size = max(1, number), min(200, max(1, size))
    return ordered(calls).offset((number - 1) * size).limit(size)


def total(calls: DataFrame) -> DataFrame:
    return calls.agg(F.count("*").alias("total"))


def options(calls: DataFrame, tools: bool = False) -> DataFrame:
    """kind, value: the different models and tokens (and tools) of matched calls."""
    kinds = [("model", F.col("model")), ("token", F.col("token_name"))]
    each = F.array(*[F.struct(F.lit(k).alias("kind"), c.alias("value")) for k, c in kinds])
    if tools:
        each = F.concat(each, F.transform("tool_names", lambda t: F.struct(F.lit("tool").alias("kind"), t.alias("value"))))
    return calls.select(F.explode(each).alias("o")).select("o.kind", "o.value").where("coalesce(value, '') <> ''").distinct()


def search_since(since: int, search_days: int, now: float | None = None) -> int:
    """Lower bound of a search over bodies, which looks back search_days at most (0: any)."""
    return max(since, int(now or time.time()) - 86400 * search_days) if search_days > 0 else since


def listed(calls: DataFrame, f: CallFilter, number: int = 1, size: int = 20, search_days: int = 0) -> DataFrame:
    """A page of the calls that a filter accepts."""
    if (f.search or f.tool_name) and search_days:
        f.since = search_since(f.since, search_days)
    return page(matching(calls, f), number, size)


def channel_label(escape: bool = False) -> Column:
    """Name, else host, else #id, else nothing, of a row joined with channels."""
    label = F.coalesce(F.nullif(F.col("channel_name"), F.lit("")), F.nullif(F.col("upstream_host"), F.lit("")), F.concat(F.lit("#"), F.col("channel_id")))
    return html_escape(label) if escape else label


def with_channels(calls: DataFrame, channels: DataFrame) -> DataFrame:
    """calls with channel_name, resolved when read. Spark broadcasts channels if they are few, by its size limit."""
    names = channels.select(F.col("id").alias("channel_id"), F.col("name").alias("channel_name"))
    return calls.join(names, "channel_id", "left")


def get_call(calls: DataFrame, request_id: str) -> DataFrame:
    """The newest version of one call; the day its id begins with is tried first."""
    day = request_id[:8]
    mine = calls.where(F.col("request_id") == request_id)
    if day.isdigit() and "20200101" <= day <= "20991231":
        guess = mine.where(F.col("day") == day)
        if not guess.isEmpty():
            mine = guess
    return mine.orderBy(F.desc("day"), F.desc("append_seq")).limit(1)


def earliest_day(calls: DataFrame) -> DataFrame:
    return calls.agg(F.min("day").alias("earliest"))


def days(calls: DataFrame) -> DataFrame:
    return calls.select("day").distinct().orderBy(F.desc("day"))


def earliest_epoch(day: str | None, fallback: int, tz: str = "UTC") -> int:
    return int(datetime.strptime(day, "%Y%m%d").replace(tzinfo=ZoneInfo(tz)).timestamp()) if day else fallback


def push_order(calls: DataFrame) -> DataFrame:
    """Oldest first, as a backlog is sent."""
    return latest(calls).orderBy("epoch", "request_id")
