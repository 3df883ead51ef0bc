"""Queries that write files or a store in a folder of their own and read them back, and their reference SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.functions import providers as P
from logloom.operators import calls as C
from logloom.operators import listing, maintain
from logloom.operators.fold import fold
from logloom.operators.lines import admitted, classify
from logloom.plans import ranges
from logloom.plans.format_queries import K, entries, events, said
from logloom.plans.log_queries import FOLDED, conversation_log, folded_columns
from logloom.plans.sample_calls import CTE, calls
from logloom.sources.channels import read_channels
from logloom.sources.logs import read_entries, stream_entries
from logloom.sources.store import Store, push_batches, read_batches
from logloom.sources.tail import tail_entries
from logloom.streaming.fold import write_calls

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def _query(name: str, sql: str) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name], ORACLES[name] = f, sql
        return f

    return add


def _events(name: str, sql: str) -> Callable[[Query], Query]:
    return _query(name, f"WITH e AS (SELECT *, {K} AS k FROM events) {sql}")


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder that all executors share: beside the checkpoints, else in the warehouse."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{base.rstrip('/')}/logloom/{name}-{uuid.uuid4().hex}"


# --- log files


@_events("read_log_files", "SELECT event_id, 'request' AS kind, '{\"k\": ' || k || ',\"l\": [1]}' AS kept FROM e UNION ALL SELECT event_id, 'chunk', NULL FROM e UNION ALL SELECT event_id, 'error', NULL FROM e")
def read_log_files(spark, sf_dir):
    """Pretty-printed bodies, stray lines and both line ends, written as files and read back."""
    e, folder = events(spark, sf_dir), scratch(spark, "logs")
    lines = entries(e, 'requestBody: {\n  "k": <k>,\n  "l": [\n    1\n  ]\n}', "stream scanner data: x\nstray line\n  { stray", "ERROR <k>\r\nstray")
    background = e.select(said("[INFO] 2026/01/15 - 10:00:00 | SYSTEM | up <k>").alias("value"), F.struct("event_id", F.lit(9).alias("n")).alias("ord"))
    text = lines.select("value", "ord").unionByName(background).repartitionByRange("ord").sortWithinPartitions("ord")
    text.select("value").write.text(folder)
    got = classify(read_entries(spark, folder))
    return got.select(F.substring("rid", 5, 24).cast("bigint").alias("event_id"), "kind", admitted(F.col("body")).alias("kept"))


def in_segments(log: DataFrame) -> DataFrame:
    """Values of a conversation log to be written as files: all lines of a call in one of them, in their order.

    Files that tasks write side by side have no times in the order of their lines, so the order
    of a call that stands in two of them would be lost.
    """
    return log.repartitionByRange("ord.conv_id").sortWithinPartitions("ord").select("value")


@_query("fold_log_files", FOLDED)
def fold_log_files(spark, sf_dir):
    """The log of fold_log, by way of files: entries in order of file time, name and place."""
    folder = scratch(spark, "logs")
    in_segments(conversation_log(spark, sf_dir)).write.text(folder)
    return folded_columns(fold(classify(read_entries(spark, folder))))


@_query("stream_fold", FOLDED)
def stream_fold(spark, sf_dir):
    """The same log as a stream: read, folded with state and appended to a store, which is read back."""
    folder, at = scratch(spark, "logs"), scratch(spark, "stream")
    in_segments(conversation_log(spark, sf_dir)).write.text(folder)
    store = Store(spark, f"{at}/store")
    query = write_calls(classify(stream_entries(spark, folder)), store, f"{at}/checkpoint", availableNow=True)
    query.awaitTermination()
    return folded_columns(store.calls())


@_query("stream_tail", FOLDED)
def stream_tail(spark, sf_dir):
    """The same log from files that are followed by byte offsets."""
    folder, at = scratch(spark, "logs"), scratch(spark, "stream")
    in_segments(conversation_log(spark, sf_dir)).write.text(folder)
    store = Store(spark, f"{at}/store")
    write_calls(classify(tail_entries(spark, folder, quiet=0.0, suffix=".txt")), store, f"{at}/checkpoint", availableNow=True).awaitTermination()
    return folded_columns(store.calls())


@_query("stream_late_lines", FOLDED)
def stream_late_lines(spark, sf_dir):
    """Two runs over one checkpoint: lines of calls that were complete in the first change nothing in the second."""
    folder, at = scratch(spark, "logs"), scratch(spark, "stream")
    log = in_segments(conversation_log(spark, sf_dir))
    late = log.where(F.startswith("value", F.lit("[GIN]"))).select(F.regexp_replace("value", r"\| [0-9]{3} \|", "| 418 |"))
    store = Store(spark, f"{at}/store")
    for lines in (log, late):
        lines.write.mode("append").text(folder)
        write_calls(classify(stream_entries(spark, folder)), store, f"{at}/checkpoint", availableNow=True).awaitTermination()
    return folded_columns(store.calls())


@_query("pods_united", FOLDED)
def pods_united(spark, sf_dir):
    """Two pods' calls, each written to its own store, united in a third by imports; a second import adds nothing."""
    at = scratch(spark, "pods")
    calls_ = fold(classify(conversation_log(spark, sf_dir))).withColumn("append_seq", F.lit(1).cast("bigint"))
    whole, part = Store(spark, f"{at}/all"), F.substring("request_id", -1, 1).cast("int") % 3
    for pod, rows in (("a", calls_.where(part < 2)), ("b", calls_.where(part > 0)), ("b", calls_.where(part > 0))):
        own = Store(spark, f"{at}/{pod}")
        own.append_new(rows)
        whole.append(maintain.import_merge(own.inlined(own.calls()), whole.calls(), pod))
    return folded_columns(whole.inlined(whole.calls()))


# --- the store


def _stored(rows: DataFrame, folder: str) -> Store:
    store = Store(rows.sparkSession, folder)
    first, later = rows.where("append_seq % 2 = 1"), rows.where("append_seq % 2 = 0")
    store.append_new(first.withColumn("request", F.lit(None).cast("string")))
    store.append_new(first.withColumn("request", F.lit(None).cast("string")))  # adds nothing
    store.append(later.withColumn("request", F.lit(None).cast("string")))
    return store


@_query("store_calls", f"WITH {CTE} SELECT day_key, request_id, append_seq, model, quota, frt_ms FROM versions")
def store_calls(spark, sf_dir):
    """Every version, appended (first versions twice) and read back."""
    store = _stored(calls(spark, sf_dir), scratch(spark, "store"))
    return store.calls().select(F.col("day").alias("day_key"), "request_id", "append_seq", "model", "quota", "frt_ms")


@_query("store_range", f"WITH {CTE} SELECT request_id, append_seq, model, status FROM latest WHERE day_key BETWEEN '20240103' AND '20240124' AND model = 'm3' AND (epoch_s <= 0 OR epoch_s BETWEEN 1704240000 AND 1706140799)")
def store_range(spark, sf_dir):
    """The latest versions of a range of days, of one model, from a store: days outside aren't read."""
    store = _stored(calls(spark, sf_dir), scratch(spark, "store"))
    return C.matching(store.calls(), C.CallFilter(model="m3", since=1704240000, until=1706140799)).select("request_id", "append_seq", "model", "status")


def _quoted(text: Column) -> Column:
    """JSON text of a string, written the same way in SQL."""
    for a, b in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\t", "\\t"), ("\r", "\\r")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return F.concat(F.lit('"'), text, F.lit('"'))


def _quoted_sql(text: str) -> str:
    for a, b in (("'\\'", "'\\\\'"), ("'\"'", "'\\\"'"), ("chr(10)", "'\\n'"), ("chr(9)", "'\\t'"), ("chr(13)", "'\\r'")):
        text = f"replace({text}, {a}, {b})"
    return f"'\"' || {text} || '\"'"


def _requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests with a system text, messages and tools, and values that look like other JSON."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("text is not null")
    odd = F.concat(F.lit(' "user" : "12'), F.col("doc_id").cast("string"), F.lit('", "flag":"true","stop":"{x}" ,"n":1.50, "none":null,"e":1E3,"tools":[ {"name":"a"} , "7",'), F.concat(F.lit('{"t":'), _quoted(F.col("text")), F.lit("}")), F.lit(" ]}"))
    body = F.concat(F.lit('{ "system":'), _quoted(F.col("text")), F.lit(',"messages":[{"role":"user","content":'), _quoted(F.col("text")), F.lit('}, "[1,2]"],'), odd)
    return docs.select(F.coalesce("lang", F.lit("none")).alias("day"), F.col("doc_id").cast("string").alias("request_id"), F.lit(1).cast("bigint").alias("append_seq"), body.alias("request"))


_TEXT = _quoted_sql("text")
_REQUEST_SQL = f"""'{{ "system":' || {_TEXT} || ',"messages":[{{"role":"user","content":' || {_TEXT} || '}}, "[1,2]"], "user" : "12' || doc_id || '", "flag":"true","stop":"{{x}}" ,"n":1.50, "none":null,"e":1E3,"tools":[ {{"name":"a"}} , "7",{{"t":' || {_TEXT} || '}} ]}}'"""


@_query("store_rebuild", f"SELECT doc_id::VARCHAR AS request_id, {_REQUEST_SQL} AS request, TRUE AS lifted FROM documents WHERE text IS NOT NULL AND length(text) >= 64")
def store_rebuild(spark, sf_dir):
    """Requests whose parts went to the pool, put together again: the same text, byte for byte."""
    rows, store = _requests(spark, sf_dir), Store(spark, scratch(spark, "store"))
    store.append_new(rows)
    kept = store.calls()
    lifted = kept.select("request_id", F.col("refs").isNotNull().alias("lifted"))
    long = spark.read.parquet(f"{sf_dir}/documents.parquet").where(F.length("text") >= 64).select(F.col("doc_id").cast("string").alias("request_id"))
    return store.inlined(kept).select("request_id", "request").join(lifted, "request_id").join(long, "request_id", "left_semi")


@_query("store_pool", f"""WITH p AS (SELECT COALESCE(lang, 'none') AS day_key, unnest([{_TEXT}, '{{"role":"user","content":' || {_TEXT} || '}}', '{{"t":' || {_TEXT} || '}}']) AS content FROM documents WHERE text IS NOT NULL)
    SELECT DISTINCT day_key, substr(sha256(content), 1, 32) AS h, octet_length(encode(content)) AS bytes FROM p WHERE octet_length(encode(content)) >= 64""")
def store_pool(spark, sf_dir):
    """Each part of 64 bytes or more once a day, however often it was appended."""
    rows, store = _requests(spark, sf_dir), Store(spark, scratch(spark, "store"))
    store.append(rows)
    store.append(rows.withColumn("append_seq", F.lit(2).cast("bigint")))
    return store.blobs().select(F.col("day").alias("day_key"), "h", F.octet_length("content").cast("bigint").alias("bytes"))


@_events("point_lookups", "SELECT 'Call' || lpad('77', 24, '0') AS request_id, 2::BIGINT AS append_seq, k FROM e WHERE event_id = 77")
def point_lookups(spark, sf_dir):
    """The newest version of one call in a store."""
    store, e = Store(spark, scratch(spark, "store")), events(spark, sf_dir)
    for seq in (1, 2):
        store.append(e.select(F.date_format("ts", "yyyyMMdd").alias("day"), F.col("rid").alias("request_id"), F.lit(seq).cast("bigint").alias("append_seq"), "k", F.lit(None).cast("string").alias("request")))
    return listing.get_call(store.calls(), f"Call{77:024d}").select("request_id", "append_seq", "k")


# --- pushed batches


@_events("receive_batches", """, b AS (SELECT user_id % 5 AS f, min(event_id) AS broken FROM e WHERE k % 50 = 7 GROUP BY 1)
    SELECT user_id % 5 AS batch, count(*) FILTER (broken IS NULL OR event_id < broken) AS taken, count(*) FILTER (event_id >= broken) AS refused FROM e LEFT JOIN b ON f = user_id % 5 GROUP BY 1""")
def receive_batches(spark, sf_dir):
    """Gzipped JSON lines: what stands before a file's first malformed line is taken."""
    folder = scratch(spark, "push")
    line = F.when(F.col("k") % 50 == 7, said('{"request_id":"<rid>"')).otherwise(said('{"request_id":"<rid>","quota":<k>}'))
    rows = events(spark, sf_dir).select((F.col("user_id") % 5).alias("batch"), line.alias("line"), "event_id")
    rows.repartition("batch").sortWithinPartitions("batch", "event_id").select("line", "batch").write.option("compression", "gzip").partitionBy("batch").text(folder)
    got = read_batches(spark, f"{folder}/*", "request_id string, quota bigint")
    batch = F.regexp_extract("file", "batch=([0-9]+)", 1).cast("bigint").alias("batch")
    return got.groupBy(batch).agg(F.count_if(~F.col("bad")).alias("taken"), F.count_if("bad").alias("refused"))


@_query("push_sizes", f"WITH {CTE} SELECT count(*) AS n, TRUE AS small FROM latest")
def push_sizes(spark, sf_dir):
    """A backlog in batches, none of more than 64 records."""
    rows = C.latest(calls(spark, sf_dir)).select("day", "request_id", "append_seq", "epoch", *[F.lit(None).cast("string").alias(c) for c in ("request", "response", "stream_content")])
    sizes = push_batches(rows).groupBy("batch").agg(F.count("*").alias("n"))
    return sizes.agg(F.sum("n").alias("n"), (F.max("n") <= 64).alias("small"))


@_query("channel_pages", "SELECT n_nationkey::INT AS id, CASE WHEN n_nationkey % 2 = 0 THEN 'host' || n_nationkey || '.example:8443' ELSE n_name END AS name FROM nation")
def channel_pages(spark, sf_dir):
    """The channel dimension from pages of either shape; a blank name becomes the host."""
    folder = scratch(spark, "channels")
    name = F.when(F.col("n_nationkey") % 2 == 0, F.lit(" ")).otherwise(F.col("n_name"))
    items = F.to_json(F.collect_list(F.struct(F.col("n_nationkey").alias("id"), name.alias("name"), F.concat(F.lit("https://host"), "n_nationkey", F.lit(".example:8443/v1")).alias("base_url"))))
    pages = spark.read.parquet(f"{sf_dir}/nation.parquet").groupBy(F.col("n_regionkey").alias("page")).agg(items.alias("items"))
    body = F.when(F.col("page") % 2 == 0, F.concat(F.lit('{"success":true,"data":{"items":'), "items", F.lit("}}"))).otherwise(F.concat(F.lit('{"success":true,"data":'), "items", F.lit("}")))
    pages.select(body, "page").repartition("page").write.partitionBy("page").text(folder)
    return read_channels(spark, f"{folder}/*").select("id", "name")


# --- maintenance


@_events("reindexed", """SELECT event_id, ver::BIGINT AS append_seq, CASE WHEN k % 4 = 0 THEN 'error' WHEN k % 4 = 1 THEN 'ok' ELSE '' END AS outcome, CASE WHEN k % 4 = 0 THEN 'cut' WHEN k % 4 = 1 THEN 'billed' ELSE '' END AS outcome_reason,
    CASE WHEN k % 4 < 2 THEN 't' || k ELSE 'kept' END AS token_name, CASE WHEN k % 4 < 2 THEN k ELSE -1 END AS quota FROM e, range(1, 3) r(ver)""")
def reindexed(spark, sf_dir):
    """Every version with what its bill says derived again; those without one keep what they had."""
    bill = F.when(F.col("k") % 4 == 0, said('{"quota":<k>,"token_name":"t<k>","other":{"stream_status":{"status":"error","end_reason":"cut"}}}')).when(F.col("k") % 4 == 1, said('{"quota":<k>,"token_name":"t<k>"}'))
    rows = events(spark, sf_dir).select(
        "event_id", F.explode(F.array(F.lit(1), F.lit(2)).cast("array<bigint>")).alias("append_seq"), F.lit(None).cast("int").alias("status"), F.lit("?").alias("outcome"), F.lit("?").alias("outcome_reason"), F.lit("kept").alias("token_name"), F.lit(-1).cast("bigint").alias("quota"),
        F.lit(None).cast("int").alias("channel_id"), F.lit(None).cast("bigint").alias("frt_ms"), F.lit(0).alias("error_count"), bill.alias("billing"), F.lit(False).alias("billed"), F.lit(False).alias("stalled"), F.array().cast("array<string>").alias("errors"),
    )
    return maintain.reindex(rows).select("event_id", "append_seq", "outcome", "outcome_reason", "token_name", "quota")


@_events("recounted", "SELECT event_id::VARCHAR AS request_id, 2 AS msg_count, 1 AS turns, 1 AS tool_count FROM e WHERE k % 3 > 0")
def recounted(spark, sf_dir):
    """Counts derived again from the request; calls whose counts were right already aren't written anew."""
    e = events(spark, sf_dir)
    right = F.col("k") % 3 == 0
    counts = [F.when(right, n).otherwise(n + 90).alias(c) for c, n in (("msg_count", 2), ("turns", 1), ("tool_count", 1))]
    request = said('{"messages":[{"role":"user","content":"<k>"},{"role":"assistant","content":"x"}],"tools":[{"name":"f"}]}')
    rows = e.select(F.date_format("ts", "yyyyMMdd").alias("day"), F.col("event_id").cast("string").alias("request_id"), F.lit(1).cast("bigint").alias("append_seq"), request.alias("request"), F.lit(False).alias("is_stream"), F.array().cast(P.CALLS).alias("stream_tool_calls"), F.array().cast("array<string>").alias("called_tools"), *counts)
    return maintain.repair(rows).select("request_id", "msg_count", "turns", "tool_count")


@_query("allowed_pods", f"WITH {CTE} SELECT request_id, append_seq FROM versions WHERE CAST(right(request_id, 1) AS INT) % 4 IN (1, 2)")
def allowed_pods(spark, sf_dir):
    rows = calls(spark, sf_dir).withColumn("pod", F.concat(F.lit("pod-"), F.right("request_id", F.lit(1)).cast("int") % 4))
    return C.allowed(C.allowed(rows, "pod", ["pod-1", "pod-2"]), "pod", []).select("request_id", "append_seq")


@_query("search_window", f"WITH {CTE} SELECT request_id FROM latest WHERE contains(preview, 'User7') AND day_key >= '20240120' AND (epoch_s <= 0 OR epoch_s >= 1705708800)")
def search_window(spark, sf_dir):
    """A search looks back ten days from now at most, whatever older bound was asked for."""
    bodies = {c: F.lit(None).cast("string") for c in ("stream_content", "request", "response")}
    since = listing.search_since(1704240000, 10, now=1706572800)
    return C.matching(calls(spark, sf_dir).withColumns(bodies), C.CallFilter(search="user7", since=since)).select("request_id")


# --- time ranges

_NOW = 1773144000  # 2026-03-10 12:00:00 UTC
_ZONE = "America/New_York"


@_query("time_ranges", """SELECT * FROM (VALUES ('today', epoch(TIMESTAMP '2026-03-10 04:00:00')::BIGINT, epoch(TIMESTAMP '2026-03-11 03:59:59')::BIGINT, 'hour'), ('7d', epoch(TIMESTAMP '2026-03-04 05:00:00')::BIGINT, epoch(TIMESTAMP '2026-03-11 03:59:59')::BIGINT, 'day'),
    ('30d', epoch(TIMESTAMP '2026-02-09 05:00:00')::BIGINT, epoch(TIMESTAMP '2026-03-11 03:59:59')::BIGINT, 'day'), ('ytd', epoch(TIMESTAMP '2026-01-01 05:00:00')::BIGINT, epoch(TIMESTAMP '2026-03-11 03:59:59')::BIGINT, 'day'),
    ('custom', 1700000000::BIGINT, epoch(TIMESTAMP '2026-03-10 12:00:00')::BIGINT, 'week'), ('bad', 0::BIGINT, 0::BIGINT, 'error')) t(name, since, until, granularity)""")
def time_ranges(spark, sf_dir):
    """Named and custom ranges in a zone whose clock changed between, and one that ends before it begins."""
    rows = []
    for name in ("today", "7d", "30d", "ytd"):
        since, until = ranges.resolve_range(name, _ZONE, _NOW)
        rows.append((name, since, until, ranges.granularity(since, until)))
    since, until = ranges.custom_range(ranges.parse_epoch(""), ranges.parse_epoch(""), 1700000000, _NOW)
    rows.append(("custom", since, until, ranges.granularity(since, until)))
    try:
        ranges.custom_range(10, 5, 0)
    except ValueError:
        rows.append(("bad", 0, 0, "error"))
    return spark.createDataFrame(rows, "name string, since bigint, until bigint, granularity string")
