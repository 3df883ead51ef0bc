"""Queries of the log side (parsing, folding, store, maintenance) over derived tables, and their reference SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.functions import providers as P
from logloom.functions.scalars import clip_bytes, record_size
from logloom.functions.udfs import trim_reread
from logloom.operators import calls as C
from logloom.operators import maintain
from logloom.operators.fold import fold, gathered, with_chunks
from logloom.operators.lines import classify
from logloom.plans.sample_calls import CTE, calls, dealt_events
from logloom.sources.store import fresh, join_requests, split_requests

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def _query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dealt_events(spark, sf_dir).withColumn("k", F.get_json_object("props", "$.k").cast("bigint"))


_K = "CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT)"


# --- a whole log, written from conversations


def conversation_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries (value, file, ord): for each conversation a request, a chunk for each answer, a bill and an access line."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    rid = F.concat(F.lit("Conv"), F.lpad(F.col("conv_id").cast("string"), 24, "0"))
    head = lambda level: F.concat(F.lit(f"[{level}] 2026/01/15 - 10:00:"), F.lpad((F.col("conv_id") % 60).cast("string"), 2, "0"), F.lit(" | "))
    messages = turns.groupBy("conv_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))), lambda m: F.struct(m["role"].alias("role"), m["text"].alias("content"))).alias("messages"))
    line = lambda nth, level, text: F.struct(F.lit(nth).cast("bigint").alias("nth"), F.concat(head(level), text).alias("value"))
    model = F.concat(F.lit("m"), F.col("conv_id") % 3)
    request = F.to_json(F.struct(model.alias("model"), F.lit(True).alias("stream"), "messages"))
    bill = F.to_json(F.struct(model.alias("model_name"), F.col("conv_id").alias("quota"), F.size("messages").alias("prompt_tokens")))
    status = F.when(F.col("conv_id") % 5 == 0, "500").otherwise("200")
    frame = messages.withColumn("rid", rid).select(
        "conv_id",
        F.explode(
            F.array(
                line(-1, "DEBUG", F.concat("rid", F.lit(" | text request body: "), request)),
                line(1 << 20, "INFO", F.concat("rid", F.lit(" | record consume log: userId=1, params="), bill)),
                line((1 << 20) + 1, "GIN", F.concat(F.lit("relay | "), "rid", F.lit(" | "), status, F.lit(" | 1.5s | 10.0.0.1 | POST /v1/x"))),
            )
        ).alias("l"),
    )
    delta = F.to_json(F.struct(F.array(F.struct(F.struct(F.col("text").alias("content")).alias("delta"))).alias("choices")))
    answers = turns.where("role = 'assistant'").withColumn("rid", rid).select("conv_id", F.struct(F.col("turn").alias("nth"), F.concat(head("DEBUG"), "rid", F.lit(" | stream scanner data: data: "), delta).alias("value")).alias("l"))
    return frame.unionByName(answers).select("l.value", F.lit("conversations").alias("file"), F.struct(F.col("conv_id"), F.col("l.nth")).alias("ord"))


_CONV = """WITH c AS (SELECT conv_id, count(*) AS msg_count, count(*) FILTER (role = 'assistant') AS turns,
    left(COALESCE(arg_max(text, turn) FILTER (role = 'user'), ''), 200) AS preview,
    COALESCE(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '') AS answer, count(*) FILTER (role = 'assistant') AS chunks FROM conversations GROUP BY 1)"""


FOLDED = _CONV + """ SELECT 'Conv' || lpad(conv_id::VARCHAR, 24, '0') AS request_id, '20260115' AS day_key, 'm' || conv_id % 3 AS model, msg_count::INT AS msg_count, turns::INT AS turns,
    preview, answer AS stream_content, chunks::INT AS chunk_count, conv_id AS quota, msg_count AS prompt_tokens,
    CASE WHEN conv_id % 5 = 0 THEN 'error' ELSE 'ok' END AS outcome, CASE WHEN conv_id % 5 = 0 THEN 'http_500' ELSE 'http_200' END AS outcome_reason FROM c"""


def folded_columns(calls: DataFrame) -> DataFrame:
    return calls.select("request_id", F.col("day").alias("day_key"), "model", "msg_count", "turns", "preview", "stream_content", "chunk_count", "quota", "prompt_tokens", "outcome", "outcome_reason")


@_query("fold_log", FOLDED)
def fold_log(spark, sf_dir):
    return folded_columns(fold(classify(conversation_log(spark, sf_dir))))


@_query("stream_concat", "SELECT conv_id, COALESCE(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '') AS content FROM conversations GROUP BY 1")
def stream_concat(spark, sf_dir):
    """Answers as a stream's chunks, put together again in their order."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    answer = F.when(F.col("role") == "assistant", F.struct("turn", "text"))
    return turns.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(answer)), lambda x: x["text"]), "").alias("content"))


@_query("parse_log", """SELECT kind, level, count(*) AS n FROM (SELECT DISTINCT conv_id, 'request' AS kind, 'DEBUG' AS level FROM conversations UNION ALL SELECT conv_id, 'chunk', 'DEBUG' FROM conversations WHERE role = 'assistant'
    UNION ALL SELECT DISTINCT conv_id, 'billing', 'INFO' FROM conversations UNION ALL SELECT DISTINCT conv_id, 'access', 'GIN' FROM conversations) GROUP BY 1, 2""")
def parse_log(spark, sf_dir):
    return classify(conversation_log(spark, sf_dir)).groupBy("kind", "level").agg(F.count("*").alias("n"))


@_query("conversation_counts", _CONV + " SELECT conv_id, msg_count::INT AS msg_count, turns::INT AS turns, preview FROM c")
def conversation_counts(spark, sf_dir):
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    bodies = turns.groupBy("conv_id").agg(F.to_json(F.struct(F.transform(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))), lambda m: F.struct(m["role"].alias("role"), m["text"].alias("content"))).alias("messages"))).alias("request"))
    q = bodies.select("conv_id", F.from_json("request", P.REQUEST).alias("q"))
    messages = P.messages_of(F.col("q"))
    return q.select("conv_id", F.size(messages).alias("msg_count"), F.size(F.filter(messages, lambda m: m["role"] == "assistant")).alias("turns"), P.preview_of(F.col("q")).alias("preview"))


@_query("content_flatten", "SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN text ELSE text || ' ' || role END AS content FROM conversations")
def content_flatten(spark, sf_dir):
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    part = lambda kind, c: F.struct(F.lit(kind).alias("type"), c.alias("text"))
    listed = F.to_json(F.array(part("text", F.col("text")), part("image_url", F.lit(None).cast("string")), part("text", F.col("role"))))
    return turns.select("conv_id", "turn", P.content_text(F.when(F.col("turn") % 2 == 0, F.col("text")).otherwise(listed)).alias("content"))


# --- stream chunks, written from events


def _chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir)
    tool = F.struct((F.col("event_id") % 3).alias("index"), F.when(F.col("k") % 2 == 0, F.concat(F.lit("id"), "k")).alias("id"), F.struct(F.when(F.col("k") % 3 == 0, F.concat(F.lit("f"), "k")).alias("name"), F.concat("k", F.lit(";")).alias("arguments")).alias("function"))
    choice = F.struct(F.struct(F.concat("event_type", F.lit(" ")).alias("content"), F.concat("k", F.lit(",")).alias("reasoning_content"), F.array(tool).alias("tool_calls")).alias("delta"))
    usage = F.struct(F.col("k").alias("prompt_tokens"), F.when(F.col("event_id") % 4 > 0, F.col("k")).alias("completion_tokens"))
    none = [F.lit(None).cast(t).alias(n) for n, t in (("status", "int"), *[(c, "string") for c in ("access_kind", "latency", "ip", "method", "path", "stream_end", "error")])]
    body = F.concat(F.lit("data: "), F.to_json(F.struct(F.array(choice).alias("choices"), usage.alias("usage"))))
    return e.select(F.struct("event_id").alias("ord"), F.date_format("ts", "yyyy/MM/dd HH:mm:ss").alias("ts"), F.concat(F.lit("u"), "user_id").alias("rid"), F.lit("chunk").alias("kind"), body.alias("body"), *none)


@_query("usage_merge", f"""WITH e AS (SELECT *, {_K} AS k FROM events) SELECT 'u' || user_id AS rid, string_agg(event_type || ' ', '' ORDER BY event_id) AS stream_content,
    string_agg(k || ',', '' ORDER BY event_id) AS stream_reasoning, count(*)::INT AS chunk_count, max(k) AS prompt, arg_max(k, event_id) FILTER (event_id % 4 > 0) AS completion FROM e GROUP BY 1""")
def usage_merge(spark, sf_dir):
    return gathered(with_chunks(_chunks(spark, sf_dir))).select("rid", "stream_content", "stream_reasoning", "chunk_count", F.col("chunk_usage.prompt").alias("prompt"), F.col("chunk_usage.completion").alias("completion"))


@_query("tool_join", f"""WITH e AS (SELECT *, {_K} AS k, event_id % 3 AS i FROM events), g AS (SELECT user_id, i, min(event_id) AS first, string_agg(k || ';', '' ORDER BY event_id) AS arguments,
    COALESCE(arg_max('id' || k, event_id) FILTER (k % 2 = 0), '') AS id, COALESCE(arg_max('f' || k, event_id) FILTER (k % 3 = 0), '') AS name FROM e GROUP BY 1, 2)
    SELECT 'u' || user_id AS rid, (row_number() OVER (PARTITION BY user_id ORDER BY first) - 1)::INT AS position, i::INT AS call_index, id, name, arguments FROM g""")
def tool_join(spark, sf_dir):
    joined = gathered(with_chunks(_chunks(spark, sf_dir))).select("rid", F.posexplode(P.join_calls(F.col("fragments"))).alias("position", "c"))
    return joined.select("rid", "position", F.col("c.index").alias("call_index"), "c.id", "c.name", "c.arguments")


def _usage(name: str, ddl: str, made: dict[str, str], f: Callable[[Column], Column], sql: str) -> None:
    @_query(name, f"WITH e AS (SELECT *, {_K} AS k FROM events) SELECT event_id, {sql}" + ("" if " FROM (" in sql else " FROM e"))
    def run(spark, sf_dir):
        body = F.to_json(F.struct(*[F.expr(c).alias(n) for n, c in made.items()]))
        u = f(F.from_json(body, ddl))
        return _events(spark, sf_dir).select("event_id", *[u[n].alias(n) for n in ("prompt", "completion", "total", "cached", "reasoning")])


_if = "CASE WHEN event_id % {} > 0 THEN {} END".format
_usage(
    "usage_anthropic", P._OPENAI,
    {"input_tokens": "k", "output_tokens": _if(3, "k * 2"), "cache_read_input_tokens": _if(2, "k * 5"), "cache_creation_input_tokens": _if(5, "user_id")},
    P.usage_anthropic,
    """k + c AS prompt, o AS completion, k + c + o AS total, CASE WHEN c > 0 THEN c END AS cached, NULL::BIGINT AS reasoning FROM (SELECT *, CASE WHEN event_id % 3 > 0 THEN k * 2 END AS o,
    CASE WHEN event_id % 2 > 0 THEN k * 5 ELSE 0 END + CASE WHEN event_id % 5 > 0 THEN user_id ELSE 0 END AS c FROM e)""",
)
_usage(
    "usage_gemini", P._GEMINI,
    {"promptTokenCount": "k", "toolUsePromptTokenCount": _if(2, "user_id"), "candidatesTokenCount": _if(3, "k * 2"), "thoughtsTokenCount": _if(4, "k * 3"), "totalTokenCount": "k * 9", "cachedContentTokenCount": _if(5, "k")},
    P.usage_gemini,
    """k + CASE WHEN event_id % 2 > 0 THEN user_id ELSE 0 END AS prompt, CASE WHEN event_id % 3 > 0 OR event_id % 4 > 0 THEN CASE WHEN event_id % 3 > 0 THEN k * 2 ELSE 0 END + CASE WHEN event_id % 4 > 0 THEN k * 3 ELSE 0 END END AS completion,
    k * 9 AS total, CASE WHEN event_id % 5 > 0 THEN k END AS cached, CASE WHEN event_id % 4 > 0 THEN k * 3 END AS reasoning""",
)


@_query("outcome_ladder", f"""WITH e AS (SELECT *, {_K} AS k FROM events), s AS (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 199 + (k % 4) * 100 END AS status,
    CASE WHEN event_id % 5 = 0 THEN CASE k % 3 WHEN 0 THEN 'ok' WHEN 1 THEN 'error' ELSE 'odd' END END AS stream, k % 2 = 0 AS cut, event_id % 7 = 0 AS billed, event_id % 11 = 0 AS stalled, event_id % 13 = 0 AS failed FROM e)
    SELECT event_id, CASE WHEN status IS NOT NULL THEN CASE WHEN status < 400 THEN 'ok' ELSE 'error' END WHEN stream IN ('ok', 'error') THEN stream WHEN billed THEN 'ok' WHEN stalled OR failed THEN 'error' ELSE '' END AS outcome,
    CASE WHEN status IS NOT NULL THEN 'http_' || status WHEN stream IN ('ok', 'error') THEN CASE WHEN cut THEN 'end: eof' ELSE 'end' END WHEN billed THEN 'billed' WHEN stalled THEN 'stalled' WHEN failed THEN 'logged_error' ELSE '' END AS outcome_reason FROM s""")
def outcome_ladder(spark, sf_dir):
    on = lambda n: F.col("event_id") % n == 0
    stream = F.when(on(5), F.struct(F.when(F.col("k") % 3 == 0, "ok").when(F.col("k") % 3 == 1, "error").otherwise("odd").alias("status"), F.lit("end").alias("end_reason"), F.when(F.col("k") % 2 == 0, "eof").alias("end_error")))
    bill = F.from_json(F.to_json(F.struct(F.struct(stream.alias("stream_status")).alias("other"))), P.BILL)
    errors = F.when(on(13), F.array(F.lit("x"))).otherwise(F.array().cast("array<string>"))
    said = P.outcome(F.when(on(3), 199 + F.col("k") % 4 * 100).cast("int"), bill, on(7), on(11), errors)
    return _events(spark, sf_dir).select("event_id", said["outcome"].alias("outcome"), said["reason"].alias("outcome_reason"))


# --- store and maintenance


#: What JSON would escape.
_ESCAPED = r'["\\\x00-\x1f]'


def _requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    text = F.regexp_replace("text", _ESCAPED, " ")
    return docs.select(F.col("lang").alias("day"), F.col("doc_id").cast("string").alias("request_id"), F.lit(1).cast("bigint").alias("append_seq"), F.concat(F.lit('{"model":"m","system":"'), text, F.lit('"}')).alias("request"))


_PLAIN = f"'\"' || regexp_replace(text, '{_ESCAPED}', ' ', 'g') || '\"'"


@_query("blob_pool", f"SELECT DISTINCT lang AS day_key, substr(sha256({_PLAIN}), 1, 32) AS h, length({_PLAIN}) AS n FROM documents WHERE octet_length(encode({_PLAIN})) >= 64")
def blob_pool(spark, sf_dir):
    _, blobs = split_requests(_requests(spark, sf_dir))
    return blobs.dropDuplicates(["day", "h"]).select(F.col("day").alias("day_key"), "h", F.length("content").cast("bigint").alias("n"))


@_query("blob_roundtrip", f"SELECT doc_id::VARCHAR AS request_id, '{{\"model\":\"m\",\"system\":' || {_PLAIN} || '}}' AS request FROM documents")
def blob_roundtrip(spark, sf_dir):
    split, blobs = split_requests(_requests(spark, sf_dir))
    return join_requests(split, blobs.dropDuplicates(["day", "h"])).select("request_id", "request")


@_query("append_new", f"WITH {CTE} SELECT request_id, append_seq FROM versions WHERE substr(request_id, 10, 1) IN ('1', '3', '5', '7', '9') QUALIFY row_number() OVER (PARTITION BY day_key, request_id ORDER BY append_seq) = 1")
def append_new(spark, sf_dir):
    rows = calls(spark, sf_dir)
    return fresh(rows, rows.where(F.substring("request_id", 10, 1).isin(*"02468"))).select("request_id", "append_seq")


@_query("import_merge", f"WITH {CTE} SELECT request_id, append_seq, quota, 'pod-1' AS pod FROM latest WHERE substr(request_id, 10, 1) NOT IN ('0', '5')")
def import_merge(spark, sf_dir):
    rows = calls(spark, sf_dir)
    return maintain.import_merge(rows, rows.where(F.substring("request_id", 10, 1).isin("0", "5")), "pod-1").select("request_id", "append_seq", "quota", "pod")


@_query("reingest", f"WITH {CTE} SELECT request_id, append_seq + 100000 AS append_seq FROM latest WHERE request_id IN ('r000000009', 'r000000010')")
def reingest(spark, sf_dir):
    return maintain.reingest(calls(spark, sf_dir), 100_000, ["r000000009", "r000000010"]).select("request_id", "append_seq")


@_query("receive_counts", f"""WITH {CTE}, b AS (SELECT *, 'pod-' || CAST(right(request_id, 1) AS INT) % 3 AS pod, request_id LIKE '%77' AS bad, request_id LIKE '%2' AS known FROM versions)
    SELECT pod, count(DISTINCT day_key || request_id) FILTER (NOT bad AND NOT known) AS stored, count(*) FILTER (NOT bad) - count(DISTINCT day_key || request_id) FILTER (NOT bad AND NOT known) AS duplicate, count(*) FILTER (bad) AS rejected FROM b GROUP BY 1""")
def receive_counts(spark, sf_dir):
    rows = calls(spark, sf_dir)
    batch = rows.select("day", "request_id", "append_seq", F.concat(F.lit("pod-"), F.right("request_id", F.lit(1)).cast("int") % 3).alias("pod"), F.endswith("request_id", F.lit("77")).alias("bad"))
    return maintain.receive_counts(batch, rows.where(F.endswith("request_id", F.lit("2"))))


@_query("admission", f"WITH e AS (SELECT *, {_K} AS k FROM events) SELECT event_id FROM e WHERE event_type = 'error' OR k % 4 = 0 OR k % 5 = 0 OR (event_id % 2 = 0 AND k % 7 = 0)")
def admission(spark, sf_dir):
    rows = _events(spark, sf_dir).select(
        "event_id",
        F.when(F.col("event_type") == "error", F.array(F.lit("x"))).otherwise(F.array().cast("array<string>")).alias("errors"),
        F.when(F.col("k") % 4 == 0, "{}").alias("request"),
        F.when(F.col("k") % 5 == 0, "{}").alias("billing"),
        F.when(F.col("event_id") % 2 == 0, F.when(F.col("k") % 7 == 0, 502).otherwise(200)).alias("status"),
    )
    return C.worth_keeping(rows).select("event_id")


@_query("clip_and_size", "SELECT doc_id, CASE WHEN octet_length(encode(text)) > 2000 THEN 2000 ELSE octet_length(encode(text)) END AS clipped, octet_length(encode(text)) + 512 AS size FROM documents")
def clip_and_size(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.select("doc_id", F.length(F.substring(F.col("text").cast("binary"), 1, 2000)).cast("bigint").alias("clipped"), record_size(F.col("text")).alias("size")).where(clip_bytes(F.col("text"), 2000).isNotNull())


@_query("trim_reread", f"""WITH e AS (SELECT event_id, {_K} AS k FROM events) SELECT event_id, '{{"k":' || k || '}}' AS arguments FROM e""")
def trim_twice(spark, sf_dir):
    """Arguments written once, twice, or begun and written again."""
    e = _events(spark, sf_dir)
    whole = F.concat(F.lit('{"k":'), "k", F.lit("}"))
    damaged = F.when(F.col("event_id") % 3 == 0, whole).when(F.col("event_id") % 3 == 1, F.concat(whole, whole)).otherwise(F.concat(F.lit('{"k"'), whole))
    return e.select("event_id", trim_reread(damaged).alias("arguments"))


@_query("repair_calls", f"WITH e AS (SELECT event_id, {_K} AS k FROM events) SELECT event_id::VARCHAR AS request_id, '{{\"a\":' || k || '}}' AS arguments, 'f' AS name FROM e WHERE k % 2 = 0")
def repair_calls(spark, sf_dir):
    """Calls whose fragments were stored apart; every other one is whole already."""
    e = _events(spark, sf_dir)
    call = lambda name, text: F.struct(F.lit(0).alias("index"), F.lit("c").alias("id"), F.lit("function").alias("type"), F.lit(name).alias("name"), text.alias("arguments"))
    whole = F.array(call("f", F.concat(F.lit('{"a":'), "k", F.lit("}"))))
    apart = F.array(call("f", F.lit('{"a":')), call("", F.concat("k", F.lit("}"))))
    rows = e.select(F.date_format("ts", "yyyyMMdd").alias("day"), F.col("event_id").cast("string").alias("request_id"), F.lit(1).cast("bigint").alias("append_seq"), F.lit(None).cast("string").alias("request"), F.lit(True).alias("is_stream"), F.when(F.col("k") % 2 == 0, apart).otherwise(whole).cast(P.CALLS).alias("stream_tool_calls"), F.array(F.lit("f")).alias("called_tools"), *[F.lit(0).alias(c) for c in ("msg_count", "turns", "tool_count")])
    return maintain.repair(rows).select("request_id", F.explode("stream_tool_calls").alias("c")).select("request_id", "c.arguments", "c.name")
