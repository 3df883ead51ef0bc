"""Queries over log lines of every provider format, written from the events table, and their reference SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.functions import detail, scalars
from logloom.functions import providers as P
from logloom.operators.fold import fold
from logloom.operators.lines import CHUNK, REQUEST, RESPONSE, admitted, classify, valid_json
from logloom.plans.sample_calls import dealt_events

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

K = "CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT)"
_RID = "'Call' || lpad(event_id::VARCHAR, 24, '0')"


def _query(name: str, sql: str) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        ORACLES[name] = f"WITH e AS (SELECT *, {K} AS k FROM events) {sql}"
        return f

    return add


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dealt_events(spark, sf_dir).withColumn("k", F.get_json_object("props", "$.k").cast("bigint")).withColumn("rid", F.concat(F.lit("Call"), F.lpad(F.col("event_id").cast("string"), 24, "0")))


def said(template: str) -> Column:
    """A text with columns' values in place of names in angle brackets."""
    parts = template.replace(">", "<").split("<")
    return F.concat(*[F.col(p).cast("string") if i % 2 else F.lit(p) for i, p in enumerate(parts) if p])


def entries(e: DataFrame, *messages: str | Column, level: str = "DEBUG", last: Column | None = None, carried: tuple[str, ...] = ()) -> DataFrame:
    """Log entries: for each row of e its messages in turn, one second apart (null: none); then an access line with the status in last."""
    at = lambda lv, n: F.concat(F.lit(f"[{lv}] 2026/01/15 - 10:00:{n:02d} | "))
    values = [F.concat(at(level, n), F.col("rid"), F.lit(" | "), said(m) if isinstance(m, str) else m) for n, m in enumerate(messages)]
    if last is not None:
        values.append(F.concat(at("GIN", len(messages)), F.lit("relay | "), F.col("rid"), F.lit(" | "), last, F.lit(" | 2.5s | 10.0.0.1 | POST /v1/x")))
    lines = F.filter(F.array(*[F.struct(F.lit(n).alias("n"), v.alias("value")) for n, v in enumerate(values)]), lambda x: x["value"].isNotNull())
    return e.select("event_id", *carried, F.explode(lines).alias("l")).select("l.value", F.lit("events").alias("file"), F.struct("event_id", "l.n").alias("ord"), *carried)


def chunk(template: str) -> str:
    return f"{CHUNK} data: {template}"


def folded(spark: SparkSession, sf_dir: str, *messages: str | Column, **more) -> DataFrame:
    return fold(classify(entries(events(spark, sf_dir), *messages, **more)))


def _names(calls: Column) -> Column:
    return F.array_join(F.transform(calls, lambda c: F.concat_ws(":", c["index"], c["id"], c["name"], c["arguments"])), "|")


# --- lines


@_query("markers", "SELECT event_id, CASE WHEN event_id % 10 < 4 THEN 'request' ELSE 'response' END AS kind, '{\"n\":' || k || '}' AS body FROM e")
def markers(spark, sf_dir):
    e = events(spark, sf_dir)
    mark = F.lit(None)
    for i, m in enumerate((*REQUEST, *RESPONSE)):
        mark = F.when(F.col("event_id") % 10 == i, F.lit(m)).otherwise(mark)
    return classify(entries(e, F.concat(mark, said(' {"n":<k>} ')))).select(F.col("ord.event_id").alias("event_id"), "kind", "body")


_BODIES = {
    0: ('{"k":<k>}', True, '{"k":<k>}'),
    1: ('{"k":<k>} garbage', False, None),
    2: ("<k>],[2", False, None),
    3: ("{'k':<k>}", False, None),
    4: ('{"k":"<k>\t"}', False, None),
    5: ('{\n  "k": <k>,\n  "l": [\n    1\n  ]\n}', True, '{"k": <k>,"l": [1]}'),
    6: ("null", True, None),
    7: ('{"k":<k>', False, None),
    8: ('{"k":<k>}{"k":<k>}', False, None),
    9: ('{"k":<k>,"k":[]}', True, '{"k":<k>,"k":[]}'),
    10: ('[<k>,{"x":"}],\\"{"}]', True, '[<k>,{"x":"}],\\"{"}]'),
    11: ("NaN", False, None),
    12: ('{"k":0<k>}', False, None),
}


def _sql_text(template: str | None) -> str:
    if template is None:
        return "NULL"
    quoted = template.replace("'", "''").replace("\n", "' || chr(10) || '").replace("\t", "' || chr(9) || '")
    return "'" + quoted.replace("<k>", "' || k || '") + "'"


@_query("body_admission", f"SELECT event_id, CASE event_id % 13 {' '.join(f'WHEN {i} THEN {str(v[1]).upper()}' for i, v in _BODIES.items())} END AS valid, CASE event_id % 13 {' '.join(f'WHEN {i} THEN {_sql_text(v[2])}' for i, v in _BODIES.items())} END AS kept FROM e")
def body_admission(spark, sf_dir):
    """Bodies that are one JSON value, and others that lenient parsers take for one."""
    body = F.lit(None)
    for i, (text, _, _) in _BODIES.items():
        body = F.when(F.col("event_id") % 13 == i, said(text)).otherwise(body)
    return events(spark, sf_dir).select("event_id", body.alias("b")).select("event_id", valid_json(F.col("b")).alias("valid"), admitted(F.col("b")).alias("kept"))


@_query("last_body_wins", f"""SELECT {_RID} AS request_id, CASE WHEN event_id % 2 = 0 THEN 'm' || k END AS own, CASE WHEN event_id % 2 = 0 THEN 'm' || k ELSE 'billed' END AS model,
    event_id % 2 <> 0 AS incomplete, k AS prompt_tokens, 'ok' AS outcome, 'billed' AS outcome_reason FROM e""")
def last_body_wins(spark, sf_dir):
    broken = F.when(F.col("event_id") % 2 == 0, said('{"model":"m<k>"}')).otherwise(said('{"model":"m<k>"'))
    calls = folded(spark, sf_dir, 'requestBody: {"model":"first"}', F.concat(F.lit("requestBody: "), broken), 'record consume log: userId=1, params={"model_name":"billed","prompt_tokens":<k>}', level="INFO")
    return calls.select("request_id", F.get_json_object("request", "$.model").alias("own"), "model", "incomplete", "prompt_tokens", "outcome", "outcome_reason")


@_query("line_ends", f"SELECT {_RID} AS request_id, CASE WHEN event_id % 2 = 0 THEN 'done' || k ELSE 'stream ended by ' || k END AS stream_end, 2000::BIGINT AS error_bytes, 'logged_error' AS outcome_reason FROM e")
def line_ends(spark, sf_dir):
    end = F.when(F.col("event_id") % 2 == 0, said("stream ended, reason=x reason=done<k> ")).otherwise(said("stream ended by <k>"))
    calls = folded(spark, sf_dir, end, F.concat(F.lit("upstream ERROR "), F.repeat(F.lit("no "), 900)), "fullRequestURL: https://h.example/v1")
    return calls.select("request_id", "stream_end", F.octet_length(F.element_at("errors", 1)["msg"]).cast("bigint").alias("error_bytes"), "outcome_reason")


@_query("chunk_triage", f"""SELECT {_RID} AS request_id, 2 AS chunk_count, 2000 AS first_chunk_ms, 24 AS unknown_count, 20 AS samples, '{{"odd":' || k || '}}' AS first_sample,
    '{{"choices":[{{' AS second_sample, 'A' || k || 'B' AS stream_content FROM e""")
def chunk_triage(spark, sf_dir):
    """Chunks with text, known events without any, comments, ends, and what is neither."""
    text = '{"choices":[{"delta":{"content":"%s"}}]}'
    known = [chunk('{"type":"ping"}'), chunk("[DONE]"), f"{CHUNK} : comment", f"{CHUNK} data:", chunk('{"type":"response.created"}')]
    odd = [chunk('{"odd":<k>}'), chunk('{"choices":[{')] + [chunk('{"type":"new"}')] * 22
    calls = folded(spark, sf_dir, known[0], odd[0], chunk(text % "A<k>"), *known[1:], chunk(text % "B"), *odd[1:])
    return calls.select("request_id", "chunk_count", "first_chunk_ms", "unknown_count", F.size("unknown_chunks").alias("samples"), F.col("unknown_chunks")[0].alias("first_sample"), F.col("unknown_chunks")[1].alias("second_sample"), "stream_content")


@_query("wall_clock", "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 0 ELSE CAST(floor(epoch(ts)) AS BIGINT) END AS epoch, strftime(ts, '%Y%m%d') AS day_key FROM e")
def wall_clock(spark, sf_dir):
    text = F.date_format("ts", "yyyy/MM/dd HH:mm:ss")
    bad = F.when(F.col("event_id") % 3 == 0, F.concat(F.substring(text, 1, 10), F.lit(" 25:61:00"))).otherwise(text)
    return events(spark, sf_dir).select("event_id", scalars.epoch_of(bad).alias("epoch"), scalars.day_of(bad).alias("day_key"))


# --- streams of each format


@_query("stream_blocks", f"""SELECT {_RID} AS request_id, 'Hi ' || k AS stream_content, 'hm' || k AS stream_reasoning, '2:t1:Sh:{{"a":' || k || '}}' AS calls, 'Sh' AS called, 6 * k + 3 AS prompt_tokens, k + 1 AS completion_tokens,
    7 * k + 4 AS total_tokens, 5 * k + 3 AS cached_tokens, TRUE AS is_stream FROM e""")
def stream_blocks(spark, sf_dir):
    """Opened, reopened and continued blocks; usage split over two events."""
    delta = lambda i, kind, field, value: chunk(f'{{"type":"content_block_delta","index":{i},"delta":{{"type":"{kind}","{field}":"{value}"}}}}')
    opened = lambda i, name: chunk(f'{{"type":"content_block_start","index":2,"content_block":{{"type":"tool_use","id":"{i}","name":"{name}"}}}}')
    calls = fold(classify(entries(
        events(spark, sf_dir).withColumns({"n_read": F.col("k") * 5, "n_out": F.col("k") + 1}),
        chunk('{"type":"message_start","message":{"usage":{"input_tokens":<k>,"cache_read_input_tokens":<n_read>,"cache_creation_input_tokens":3,"output_tokens":1}}}'),
        delta(0, "thinking_delta", "thinking", "hm<k>"), delta(1, "text_delta", "text", "Hi "), delta(1, "text_delta", "text", "<k>"),
        opened("t0", "Old"), delta(2, "input_json_delta", "partial_json", "gone"), opened("t1", "Sh"), delta(2, "input_json_delta", "partial_json", '{\\"a\\":'), delta(2, "input_json_delta", "partial_json", "<k>}"),
        chunk('{"choices":[{"delta":{"tool_calls":[{"index":0,"function":{"name":"lost","arguments":"{}"}}]}}]}'),
        chunk('{"type":"message_delta","usage":{"output_tokens":<n_out>}}'),
    )))
    return calls.select("request_id", "stream_content", "stream_reasoning", _names(F.col("stream_tool_calls")).alias("calls"), F.array_join("called_tools", ",").alias("called"), "prompt_tokens", "completion_tokens", "total_tokens", "cached_tokens", "is_stream")


@_query("stream_parts", f"""SELECT {_RID} AS request_id, 'x' || k || 'y' AS stream_content, 'why' AS stream_reasoning, '0::f:{{"n":' || k || '}}|1::f:{{"n":2}}' AS calls, k + 2 AS prompt_tokens, 8::BIGINT AS completion_tokens,
    k + 10 AS total_tokens, 5::BIGINT AS reasoning_tokens FROM e""")
def stream_parts(spark, sf_dir):
    """Parts with text, thoughts and whole tool calls."""
    part = lambda p: chunk('{"candidates":[{"content":{"parts":[' + p + "]}}]}")
    call = lambda n: '{"functionCall":{"name":"f","args":{"n":' + n + "}}}"
    usage = chunk('{"usageMetadata":{"promptTokenCount":<k>,"toolUsePromptTokenCount":2,"candidatesTokenCount":3,"thoughtsTokenCount":5,"totalTokenCount":14}}')
    calls = folded(spark, sf_dir, part('{"text":"x<k>"},{"text":"why","thought":true}'), part(call("<k>")), part('{"text":"y"},' + call("2")), usage)
    return calls.select("request_id", "stream_content", "stream_reasoning", _names(F.col("stream_tool_calls")).alias("calls"), "prompt_tokens", "completion_tokens", "total_tokens", "reasoning_tokens")


@_query("stream_events", f"""SELECT {_RID} AS request_id, 'Hel' || k || 'no' AS stream_content, 'deepsum' AS stream_reasoning, '1:c:look:{{"q":' || k || '}}' AS calls, k AS prompt_tokens, 3::BIGINT AS completion_tokens, k + 3 AS total_tokens,
    2::BIGINT AS cached_tokens, 1::BIGINT AS reasoning_tokens, 8 AS chunk_count, 0 AS unknown_count FROM e""")
def stream_events(spark, sf_dir):
    """Typed events with deltas; those that repeat a whole text add nothing."""
    event = lambda kind, more="": chunk(f'{{"type":"response.{kind}"{more}}}')
    text = lambda kind, value: event(kind, f',"delta":"{value}"')
    calls = folded(
        spark, sf_dir, event("created"), text("output_text.delta", "Hel<k>"), text("refusal.delta", "no"), text("reasoning_text.delta", "deep"), text("reasoning_summary_text.delta", "sum"), event("output_text.done", ',"text":"Hel<k>"'),
        event("output_item.added", ',"output_index":0,"item":{"type":"message"}'), event("output_item.added", ',"output_index":1,"item":{"type":"function_call","call_id":"c","name":"look"}'),
        event("function_call_arguments.delta", ',"output_index":1,"delta":"{\\"q\\":"'), event("function_call_arguments.delta", ',"output_index":1,"delta":"<k>}"'),
        event("completed", ',"response":{"usage":{"input_tokens":<k>,"output_tokens":3,"total_tokens":0,"input_tokens_details":{"cached_tokens":2},"output_tokens_details":{"reasoning_tokens":1}}}'),
    )
    return calls.select("request_id", "stream_content", "stream_reasoning", _names(F.col("stream_tool_calls")).alias("calls"), "prompt_tokens", "completion_tokens", "total_tokens", "cached_tokens", "reasoning_tokens", "chunk_count", "unknown_count")


@_query("loose_fragments", f"SELECT {_RID} AS request_id, '0::one:{{' || k || '}}|1::two:[]' AS calls, 'one,two' AS called FROM e")
def loose_fragments(spark, sf_dir):
    """Fragments without an index: another name begins the next call."""
    part = lambda f: chunk('{"choices":[{"delta":{"tool_calls":[{"function":' + f + "}]}}]}")
    calls = folded(spark, sf_dir, part('{"name":"one","arguments":"{"}'), part('{"arguments":"<k>}"}'), part('{"name":"two","arguments":"["}'), part('{"name":"two","arguments":"]"}'))
    return calls.select("request_id", _names(F.col("stream_tool_calls")).alias("calls"), F.array_join("called_tools", ",").alias("called"))


# --- whole bodies of each format

_ANSWERS = {
    0: '{"choices":[{"message":{"content":"t<k>","reasoning_content":"r","tool_calls":[{"id":"i","function":{"name":"f<k>","arguments":"{}"}},{"function":{"name":"f<k>"}},{"function":{"name":"g"}}]}}],"usage":{"prompt_tokens":<k>,"completion_tokens":2,"total_tokens":9}}',
    1: '{"candidates":[{"content":{"parts":[{"text":"plan","thought":true},{"text":"t<k>"},{"functionCall":{"name":"f<k>","args":{"n":1}}}]}}],"usageMetadata":{"promptTokenCount":<k>,"candidatesTokenCount":2,"totalTokenCount":9}}',
    2: '{"type":"message","content":[{"type":"thinking","thinking":"why"},{"type":"text","text":"t<k>"},{"type":"tool_use","name":"f<k>","input":{"t":2}}],"usage":{"input_tokens":<k>,"output_tokens":2}}',
}


def _answer() -> Column:
    body = F.lit(None)
    for i, text in _ANSWERS.items():
        body = F.when(F.col("event_id") % 3 == i, said(text)).otherwise(body)
    return body


@_query("whole_answers", f"""SELECT {_RID} AS request_id, CASE WHEN event_id % 3 = 0 THEN 'f' || k || ',g' ELSE 'f' || k END AS called, k AS prompt_tokens, 2::BIGINT AS completion_tokens,
    CASE WHEN event_id % 3 = 2 THEN k + 2 ELSE 9 END AS total_tokens, FALSE AS is_stream, 'http_' || CASE WHEN event_id % 2 = 0 THEN '200' ELSE '404' END AS outcome_reason FROM e""")
def whole_answers(spark, sf_dir):
    calls = folded(spark, sf_dir, 'requestBody: {"model":"m"}', F.concat(F.lit("responseBody: "), _answer()), last=F.when(F.col("event_id") % 2 == 0, "200").otherwise("404"))
    return calls.select("request_id", F.array_join("called_tools", ",").alias("called"), "prompt_tokens", "completion_tokens", "total_tokens", "is_stream", "outcome_reason")


@_query("detail_answers", """SELECT event_id, 't' || k AS content, CASE event_id % 3 WHEN 0 THEN 'r' WHEN 1 THEN 'plan' ELSE 'why' END AS reasoning,
    CASE event_id % 3 WHEN 0 THEN 'i:f' || k || ':{}|:f' || k || ':|:g:' WHEN 1 THEN ':f' || k || ':{"n":1}' ELSE ':f' || k || ':{"t":2}' END AS calls FROM e""")
def detail_answers(spark, sf_dir):
    a = events(spark, sf_dir).select("event_id", detail.answer(_answer()).alias("a"))
    return a.select("event_id", "a.content", "a.reasoning", F.array_join(F.transform("a.calls", lambda c: F.concat_ws(":", c["id"], c["name"], c["arguments"])), "|").alias("calls"))


_ASKED = '{"systemInstruction":{"parts":[{"text":"short"}]},"contents":[{"role":"user","parts":[{"text":"one"},{"text":"secret","thought":true},{"text":"two<k>"},{"inlineData":{"mimeType":"image/png"}}]},{"role":"model","parts":[{"functionCall":{"name":"w","args":{"c":<k>}}}]},{"role":"user","parts":[{"functionResponse":{"name":"w","response":{"c":2}}}]}],"tools":[{"functionDeclarations":[{"name":"w"},{"name":"v<k>"}]}],"config":{"t":1}}'


@_query("parts_requests", f"SELECT {_RID} AS request_id, 3 AS msg_count, 1 AS turns, 2 AS tool_count, 'w,v' || k AS tools, 'one two' || k AS preview, TRUE AS has_tools, FALSE AS is_stream FROM e")
def parts_requests(spark, sf_dir):
    calls = folded(spark, sf_dir, "Gemini request body: " + _ASKED)
    return calls.select("request_id", "msg_count", "turns", "tool_count", F.array_join("tool_names", ",").alias("tools"), "preview", "has_tools", "is_stream")


@_query("request_flags", f"""SELECT {_RID} AS request_id, event_id % 2 = 0 AS is_stream, event_id % 3 < 2 AS has_tools, CASE event_id % 3 WHEN 0 THEN 'a' || k || ',b,b' ELSE '' END AS tools, 'ask ' || k AS preview, 2 AS turns FROM e""")
def request_flags(spark, sf_dir):
    """Tools with names of either kind, without names, and none."""
    tools = F.when(F.col("event_id") % 3 == 0, said('[{"type":"function","function":{"name":"a<k>"}},{"name":"b"},{"name":"b"}]')).when(F.col("event_id") % 3 == 1, F.lit('[{"type":"search"}]')).otherwise(F.lit("[]"))
    talk = '"messages":[{"role":"user","content":"hi"},{"role":"assistant","content":null},{"role":"user","content":[{"type":"text","text":"ask"},{"type":"image_url"},{"type":"text","text":"<k>"}]},{"role":"assistant","content":"x"}]'
    body = F.concat(F.lit('requestBody: {"stream":'), (F.col("event_id") % 2 == 0).cast("string"), F.lit(',"tools":'), tools, said("," + talk + "}"))
    return folded(spark, sf_dir, body).select("request_id", "is_stream", "has_tools", F.array_join("tool_names", ",").alias("tools"), "preview", "turns")


@_query("detail_requests", """SELECT event_id, 'system:short:|user:one' || chr(10) || 'two' || k || chr(10) || '[image/png]:|assistant::w{"c":' || k || '}|tool:{"c":2}:' AS messages, '{"name":"w"},{"name":"v' || k || '"}' AS tools, '{"t":1}' AS config FROM e""")
def detail_requests(spark, sf_dir):
    a = events(spark, sf_dir).select("event_id", detail.asked(said(_ASKED)).alias("a"))
    message = lambda m: F.concat_ws(":", m["role"], m["content"], F.array_join(F.transform(m["calls"], lambda c: F.concat(c["name"], c["arguments"])), "+"))
    return a.select("event_id", F.array_join(F.transform("a.messages", message), "|").alias("messages"), F.array_join("a.tools", ",").alias("tools"), F.col("a.rest")["config"].alias("config"))


_RANKED = '{"model":"m","query":"find <k>","documents":["zero",{"text":"one<k>"}]}', '{"results":[{"index":1,"relevance_score":0.9},{"index":0,"relevance_score":0.12345}],"usage":{"prompt_tokens":30,"total_tokens":30}}'


@_query("rerank_calls", f"SELECT {_RID} AS request_id, 'ranker' AS model, 'find ' || k AS preview, 30::BIGINT AS prompt_tokens, '1:1:0.9000:one' || k || '|2:0:0.1235:zero' AS ranking FROM e")
def rerank_calls(spark, sf_dir):
    calls = folded(spark, sf_dir, f"Rerank request body: {_RANKED[0]}", f"reranker response body: {_RANKED[1]}", 'record consume log: params={"model_name":"ranker"}')
    rank = F.transform(detail.ranked(F.col("request"), F.col("response")), lambda r: F.concat_ws(":", r["rank"], r["index"], r["score"], r["document"]))
    return calls.select("request_id", "model", "preview", "prompt_tokens", F.array_join(rank, "|").alias("ranking"))


@_query("usage_responses", "SELECT event_id, k AS prompt, CASE WHEN event_id % 2 = 0 THEN k * 2 END AS completion, k * 3 AS total, CASE WHEN event_id % 3 = 0 THEN k END AS cached, 4::BIGINT AS reasoning FROM e")
def usage_responses(spark, sf_dir):
    body = F.concat(said('{"response":{"usage":{"input_tokens":<k>,"output_tokens":'), F.when(F.col("event_id") % 2 == 0, (F.col("k") * 2).cast("string")).otherwise("null"), F.lit(',"total_tokens":'), (F.col("k") * 3).cast("string"), F.lit(',"input_tokens_details":'), F.when(F.col("event_id") % 3 == 0, said('{"cached_tokens":<k>}')).otherwise("{}"), F.lit(',"output_tokens_details":{"reasoning_tokens":4}}}}'))
    u = P.chunk_usage(F.from_json(body, P.CHUNK))
    return events(spark, sf_dir).select("event_id", *[u[n].alias(n) for n in ("prompt", "completion", "total", "cached", "reasoning")])


@_query("bill_fields", f"SELECT {_RID} AS request_id, k AS quota, 3 AS channel_id, 't' || k AS token_name, 1.5::DOUBLE AS model_ratio, k * 100 AS frt_ms, CASE WHEN event_id % 2 = 0 THEN 'error' ELSE 'ok' END AS outcome, CASE WHEN event_id % 2 = 0 THEN 'cut: eof' ELSE 'end' END AS outcome_reason, 'h.example:8443' AS upstream_host FROM e")
def bill_fields(spark, sf_dir):
    e = events(spark, sf_dir).withColumn("wait", F.col("k") / 10)
    state = F.when(F.col("event_id") % 2 == 0, F.lit('"error","end_reason":"cut","end_error":"eof"')).otherwise(F.lit('"ok","end_reason":"end"'))
    bill = F.concat(said('record consume log: x, params={"quota":<k>,"channel_id":3,"token_name":"t<k>","other":{"model_ratio":1.5,"frt":<wait>,"stream_status":{"status":'), state, F.lit("}}}"))
    calls = fold(classify(entries(e, "fullRequestURL: https://user@h.example:8443/v1/x", bill, level="INFO")))
    return calls.select("request_id", "quota", "channel_id", "token_name", "model_ratio", "frt_ms", "outcome", "outcome_reason", "upstream_host")


@_query("escaped", "SELECT page_id, replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&#34;'), '''', '&#39;') AS shown FROM pages")
def escaped(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", scalars.html_escape(F.col("html")).alias("shown"))
