"""Folding a request's events into one call."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom.functions import providers as P
from logloom.functions.scalars import clip_bytes, day_of, epoch_of, frt_ms, host_of
from logloom.operators.lines import SPACE, admitted, held_strictly

UNKNOWN_SAMPLES, UNKNOWN_BYTES = 20, 4000
_ACCESS = ("status", "latency", "ip", "method", "path", "access_kind")
#: What with_chunks() adds.
_SAID = ("c_text", "c_reasoning", "c_fragments", "c_usage", "c_unknown")


def with_chunks(events: DataFrame) -> DataFrame:
    """Events with what their stream chunk, if they are one, says: state is payload, empty, unknown or nothing."""
    # Each step is a column of its own: what stands in a condition is worked out again wherever it is used.
    data = F.when(F.startswith("body", F.lit("data:")), F.trim(F.substring("body", 6, (1 << 31) - 1), F.lit(SPACE)))
    rows = events.withColumn("_data", F.when(F.col("kind") == "chunk", data)).withColumn("_raw", F.when(~F.col("_data").isin("", "[DONE]"), F.col("_data"))).drop("_data")
    held, alone = held_strictly(F.col("_raw"), P.struct_of(P.CHUNK))
    rows = rows.select("*", held.alias("_held"), alone.alias("_alone"))
    rows = rows.select("*", F.coalesce(F.col("_alone") & F.col("_held.end").isNotNull(), F.lit(False)).alias("_valid"), F.col("_held.value").alias("_chunk")).drop("_held", "_alone")
    c = F.col("_chunk")
    good = F.col("_valid") & F.startswith("_raw", F.lit("{"))
    state = F.when(F.col("_raw").isNull(), F.lit(None)).when(~good, "unknown").when(P.has_payload(c), "payload").when(P.known_empty(c), "empty").otherwise("unknown")
    rows = rows.withColumn("state", state).withColumn("_delta", F.when(F.col("state") == "payload", P.delta_of(c)))
    d = F.col("_delta")
    use = lambda v: F.when(F.col("state") == "payload", v)
    return rows.select(
        "*", use(P.chunk_text(c, d)).alias("c_text"), use(P.chunk_reasoning(c, d)).alias("c_reasoning"), use(P.chunk_fragments(c, d)).alias("c_fragments"), use(P.chunk_usage(c)).alias("c_usage"),
        F.when(F.col("state") == "unknown", clip_bytes(F.col("_raw"), UNKNOWN_BYTES)).alias("c_unknown"),
    ).drop("_raw", "_valid", "_chunk", "_delta")


def gathered(events: DataFrame) -> DataFrame:
    """One row for each request with what its events say, in their order. Bodies are aggregated, never sorted."""
    o = F.col("ord")
    on = lambda kind, v: F.when(F.col("kind") == kind, v)
    last = lambda v, when: F.max_by(v, F.when(when, o))
    listed = lambda v: F.transform(F.sort_array(F.collect_list(F.when(v.isNotNull(), F.struct(o.alias("o"), v.alias("v"))))), lambda x: x["v"])
    usage = F.col("c_usage")
    merged = F.struct(
        F.max(usage["prompt"]).alias("prompt"),
        *[last(usage[n], usage[n].isNotNull()).alias(n) for n in ("completion", "total", "cached", "reasoning")],
    )
    # Only bodies that are kept go into the aggregation, and rows of chunks go without theirs.
    whole = F.col("kind").isin("request", "response", "billing")
    events = events.select("rid", "ord", "ts", "kind", *_ACCESS, "stream_end", "error", "state", *_SAID, F.when(whole, F.col("body")).alias("_whole"), on("url", F.col("body")).alias("url"))
    events = events.withColumns({"_body": admitted(F.col("_whole")), "_billed": on("billing", F.col("_whole").isNotNull())}).drop("_whole")
    body = F.col("_body")
    return events.groupBy("rid").agg(
        F.min_by("ts", o).alias("ts"),
        F.max_by("ts", o).alias("last_ts"),
        *[last(F.col(c), F.col("kind") == "access").alias(c) for c in _ACCESS],
        *[last(body, F.col("kind") == k).alias(k) for k in ("request", "response")],
        last(body, F.col("_billed")).alias("billing"),
        F.coalesce(F.bool_or("_billed"), F.lit(False)).alias("billed"),
        last(F.col("url"), F.col("kind") == "url").alias("url"),
        last(F.col("stream_end"), F.col("kind") == "end").alias("stream_end"),
        listed(F.when(F.col("error").isNotNull(), F.struct("ts", F.col("error").alias("msg")))).alias("errors"),
        F.count_if(F.col("state") == "payload").cast("int").alias("chunk_count"),
        F.min_by("ts", F.when(F.col("state") == "payload", o)).alias("first_chunk_ts"),
        F.array_join(listed(F.col("c_text")), "").alias("stream_content"),
        F.array_join(listed(F.col("c_reasoning")), "").alias("stream_reasoning"),
        F.flatten(listed(F.col("c_fragments"))).alias("fragments"),
        F.count("c_usage").alias("usage_count"),
        merged.alias("chunk_usage"),
        F.count("c_unknown").cast("int").alias("unknown_count"),
        F.slice(listed(F.col("c_unknown")), 1, UNKNOWN_SAMPLES).alias("unknown_chunks"),
        F.max("ord").alias("last_ord"),
    )


def derived(rows: DataFrame, stalled: Column | None = None, pod: str = "", frt_scale: float = 1000.0) -> DataFrame:
    """Calls from gathered rows."""
    parsed = rows.select("*", F.from_json("request", P.REQUEST).alias("q"), F.from_json("response", P.RESPONSE).alias("r"), F.from_json("billing", P.BILL).alias("b"))
    q, r, b, u = F.col("q"), F.col("r"), F.col("b"), F.col("chunk_usage")
    stalled = F.lit(False) if stalled is None else stalled
    text = lambda c: F.coalesce(c, F.lit(""))
    streamed = F.coalesce(q["stream"], F.lit(False)) | (F.col("chunk_count") > 0)
    both = u["prompt"] + u["completion"]
    from_chunks = F.when(F.col("usage_count") > 0, u.withField("total", F.coalesce(both, u["total"])))
    usage = F.when(F.col("chunk_count") > 0, from_chunks).otherwise(P.response_usage(r))
    from_bill = F.when(F.col("billing").isNotNull(), F.struct(b["prompt_tokens"].alias("prompt"), b["completion_tokens"].alias("completion"), *[F.lit(None).cast("bigint").alias(n) for n in ("total", "cached", "reasoning")]))
    calls = parsed.withColumn("usage", F.coalesce(usage, from_bill)).withColumn("stream_tool_calls", P.join_calls(F.col("fragments"))).withColumns({"tool_names": P.tool_names_of(q), "messages": P.messages_of(q)})
    calls = calls.withColumn("asked", P.last_asked(F.col("messages")))
    own = F.coalesce(F.nullif(q["model"], F.lit("")), b["model_name"], F.lit(""))
    model = F.when(P.is_rerank(q) & (text(b["model_name"]) != ""), b["model_name"]).otherwise(own)
    messages = F.col("messages")
    wait = (epoch_of(F.col("first_chunk_ts")) - epoch_of(F.col("ts"))) * 1000
    called = F.when(streamed, F.transform("stream_tool_calls", lambda c: c["name"])).otherwise(P.response_calls(r))
    said = P.outcome(F.col("status"), b, F.col("billed") | F.col("billing").isNotNull(), stalled, F.col("errors"))
    return calls.select(
        F.col("rid").alias("request_id"), day_of(F.col("ts")).alias("day"), "ts", "last_ts", epoch_of(F.col("ts")).alias("epoch"), model.alias("model"),
        "status", "latency", "ip", "method", "path", F.col("access_kind").alias("kind"), host_of(F.col("url")).alias("upstream_host"),
        "request", "response", "billing", "billed", "errors", F.size("errors").alias("error_count"), "stream_end", "chunk_count",
        F.when(wait >= 0, wait).otherwise(0).cast("int").alias("first_chunk_ms"), "unknown_count", "unknown_chunks", "stream_content", "stream_reasoning", "stream_tool_calls",
        streamed.alias("is_stream"), (F.coalesce(F.size(q["tools"]), F.lit(0)) > 0).alias("has_tools"),
        F.col("usage.prompt").alias("prompt_tokens"), F.col("usage.completion").alias("completion_tokens"), F.col("usage.total").alias("total_tokens"),
        F.col("usage.cached").alias("cached_tokens"), F.col("usage.reasoning").alias("reasoning_tokens"),
        b["quota"].alias("quota"), b["channel_id"].alias("channel_id"), text(b["token_name"]).alias("token_name"), b["other"]["model_ratio"].alias("model_ratio"),
        b["other"]["completion_ratio"].alias("completion_ratio"), b["other"]["frt"].alias("frt"), frt_ms(b["other"]["frt"], frt_scale).alias("frt_ms"),
        said["outcome"].alias("outcome"), said["reason"].alias("outcome_reason"), stalled.alias("stalled"),
        "tool_names", P.distinct_names(called).alias("called_tools"), F.size(messages).alias("msg_count"), F.size(F.filter(messages, lambda m: m["role"] == "assistant")).alias("turns"),
        F.size("tool_names").alias("tool_count"), P.shown(F.col("asked"), q).alias("preview"), F.col("request").isNull().alias("incomplete"), F.lit(pod).alias("pod"),
    )


def fold(events: DataFrame, pod: str = "", frt_scale: float = 1000.0) -> DataFrame:
    """One call for each request id of classified events."""
    return derived(gathered(with_chunks(events)), pod=pod, frt_scale=frt_scale)
