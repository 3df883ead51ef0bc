"""Maintenance: re-derive, copy, merge and repair stored calls."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logloom.functions import providers as P
from logloom.functions.scalars import frt_ms, host_of
from logloom.functions.udfs import trim_reread
from logloom.operators.calls import VERSION, allowed, latest_wide
from logloom.operators.lines import valid_json
from logloom.sources.store import fresh


def reindex(calls: DataFrame, frt_scale: float = 1000.0) -> DataFrame:
    """Every version with outcome, token, quota, channel and timing derived again from its stored bill."""
    b = F.from_json("billing", P.BILL)
    rows = calls.withColumn("_b", b)
    b = F.col("_b")
    said = P.outcome(F.col("status"), b, F.col("billed") | F.col("billing").isNotNull(), F.col("stalled"), F.col("errors"))
    keep = lambda v, c: F.coalesce(v, F.col(c))
    again = rows.withColumns({"_said": said, "token_name": keep(F.nullif(b["token_name"], F.lit("")), "token_name"), "quota": keep(b["quota"], "quota"), "channel_id": keep(b["channel_id"], "channel_id"), "frt_ms": keep(frt_ms(b["other"]["frt"], frt_scale), "frt_ms"), "error_count": F.size("errors")})
    return again.withColumns({"outcome": F.col("_said.outcome"), "outcome_reason": F.col("_said.reason")}).select(*calls.columns)


def reingest(source: DataFrame, seq: int, only: list[str] | None = None) -> DataFrame:
    """The newest versions of a source, to be appended as new versions from append_seq on."""
    return allowed(latest_wide(source), "request_id", only or []).withColumn("append_seq", F.col("append_seq") + seq)


def import_merge(source: DataFrame, existing: DataFrame | None, pod: str = "") -> DataFrame:
    """The newest version of each source call that the destination lacks, with a pod label if given."""
    rows = fresh(latest_wide(source), existing)
    return rows.withColumn("pod", F.lit(pod)) if pod else rows


def receive_counts(batch: DataFrame, existing: DataFrame | None) -> DataFrame:
    """pod, stored, duplicate, rejected of a received batch (request_id, day, append_seq, pod, bad)."""
    good = batch.where("not bad")
    stored = fresh(good, existing).groupBy("pod").agg(F.count("*").alias("stored"))
    all_ = batch.groupBy("pod").agg(F.count("*").alias("n"), F.count_if("bad").alias("rejected"))
    return all_.join(stored, "pod", "left").select("pod", F.coalesce("stored", F.lit(0)).alias("stored"), (F.col("n") - F.col("rejected") - F.coalesce("stored", F.lit(0))).alias("duplicate"), "rejected")


def repair(calls: DataFrame) -> DataFrame:
    """Corrected newest versions of the calls that need it, to be appended; a second run finds none.

    Fragmented tool calls are joined, arguments that were read twice are cut back, and counts
    and called tools are derived again.
    """
    rows = latest_wide(calls)
    args = rows.select(*VERSION, F.posexplode("stream_tool_calls").alias("i", "c"))
    broken = args.where("c.arguments <> ''").withColumn("bad", (F.col("c.name") == "") | ~valid_json(F.col("c.arguments"))).groupBy(*VERSION).agg(F.bool_or("bad").alias("_fragmented"))
    fragments = F.transform("stream_tool_calls", lambda c: F.struct(F.lit("f").alias("op"), F.lit(None).cast("int").alias("index"), c["id"].alias("id"), c["type"].alias("type"), c["name"].alias("name"), c["arguments"].alias("arguments")))
    indexed = F.transform("stream_tool_calls", lambda c: F.struct(F.lit("f").alias("op"), c["index"].alias("index"), c["id"].alias("id"), c["type"].alias("type"), c["name"].alias("name"), c["arguments"].alias("arguments")))
    flagged = rows.join(broken, list(VERSION), "left").withColumn("_joined", P.join_calls(F.when(F.exists("stream_tool_calls", lambda c: c["index"].isNull()), fragments).otherwise(indexed)))
    rejoin = F.coalesce(F.col("_fragmented"), F.lit(False)) & (F.size("stream_tool_calls") > 1) & (F.size("_joined") > 0) & (F.size("_joined") < F.size("stream_tool_calls"))
    marked = flagged.withColumn("_rejoin", rejoin)
    cut = marked.where("_rejoin").select(*VERSION, F.posexplode("_joined").alias("i", "c")).withColumn("c", F.col("c").withField("arguments", trim_reread("c.arguments")))
    cut = cut.groupBy(*VERSION).agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "c"))), lambda x: x["c"]).alias("_cut"))
    q = F.from_json("request", P.REQUEST)
    done = marked.join(cut, list(VERSION), "left").withColumn("_calls", F.coalesce("_cut", "stream_tool_calls")).withColumn("_q", q)
    messages = P.messages_of(F.col("_q"))
    known = F.col("request").isNotNull() & F.col("_q").isNotNull()
    new = {
        "msg_count": F.when(known, F.size(messages)).otherwise(F.col("msg_count")),
        "turns": F.when(known, F.size(F.filter(messages, lambda m: m["role"] == "assistant"))).otherwise(F.col("turns")),
        "tool_count": F.when(known, F.size(P.tool_names_of(F.col("_q")))).otherwise(F.col("tool_count")),
        "called_tools": F.when(F.col("is_stream"), P.distinct_names(F.transform("_calls", lambda c: c["name"]))).otherwise(F.col("called_tools")),
        "stream_tool_calls": F.col("_calls"),
    }
    changed = F.col("_rejoin")
    for c, v in new.items():
        if c != "stream_tool_calls":
            changed = changed | ~v.eqNullSafe(F.col(c))
    return done.withColumn("_changed", changed).where("_changed").withColumns(new).select(*calls.columns)


def hosts(calls: DataFrame, url: str = "url") -> DataFrame:
    return calls.withColumn("upstream_host", host_of(F.col(url)))
