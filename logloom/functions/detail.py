"""What the detail view of a call shows: answers, requests and rankings of all formats in one shape."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from logloom.functions import providers as P

_SHOWN = "array<struct<id:string,name:string,arguments:string>>"
_REQUEST_PART = "struct<text:string,thought:boolean,inlineData:struct<mimeType:string>,functionCall:struct<id:string,name:string,args:string>,functionResponse:struct<name:string,response:string>>"
_REQUEST = f"systemInstruction struct<parts:array<{_REQUEST_PART}>>, contents array<struct<role:string,parts:array<{_REQUEST_PART}>>>, messages array<struct<role:string,content:string,tool_calls:array<{P._TOOL}>>>, tools array<string>"
_TAKEN = ("messages", "tools", "contents", "systemInstruction")


def _call(id_: Column, name: Column, arguments: Column) -> Column:
    return F.struct(P._text(id_).alias("id"), P._text(name).alias("name"), P._text(arguments).alias("arguments"))


def answer(response: Column) -> Column:
    """struct<content, reasoning, calls> of a response body; empty where there is none."""
    r = F.from_json(response, P.RESPONSE)
    m = F.get(r["choices"], F.lit(0))["message"]
    parts = P._list(F.get(r["candidates"], F.lit(0))["content"]["parts"], f"array<{P._PART}>")
    blocks = P._list(r["content"], P._field(P.RESPONSE, "content"))
    thought = lambda p: F.coalesce(p["thought"], F.lit(False))
    joined = lambda items, keep, value: F.array_join(F.transform(F.filter(items, keep), value), "")
    content = F.concat(P._text(m["content"]), joined(parts, lambda p: ~thought(p), lambda p: P._text(p["text"])), joined(blocks, lambda b: b["type"] == "text", lambda b: P._text(b["text"])))
    reasoning = F.concat(P._text(m["reasoning_content"]), joined(parts, thought, lambda p: P._text(p["text"])), joined(blocks, lambda b: b["type"] == "thinking", lambda b: P._text(b["thinking"])))
    calls = F.concat(
        F.transform(P._list(m["tool_calls"], f"array<{P._TOOL}>"), lambda t: _call(t["id"], t["function"]["name"], t["function"]["arguments"])).cast(_SHOWN),
        F.transform(F.filter(parts, lambda p: p["functionCall"].isNotNull()), lambda p: _call(p["functionCall"]["id"], p["functionCall"]["name"], p["functionCall"]["args"])).cast(_SHOWN),
        F.transform(F.filter(blocks, lambda b: b["type"] == "tool_use"), lambda b: _call(F.lit(""), b["name"], b["input"])).cast(_SHOWN),
    )
    return F.struct(content.alias("content"), reasoning.alias("reasoning"), calls.alias("calls"))


def asked(request: Column) -> Column:
    """struct<messages, tools, rest> of a request body: messages with role, content and calls, tools as JSON, and what else it held."""
    q = F.from_json(request, _REQUEST)
    kind = f"array<struct<role:string,content:string,calls:{_SHOWN}>>"
    own = F.transform(P._list(q["messages"], P._field(_REQUEST, "messages")), lambda m: F.struct(m["role"].alias("role"), P.content_text(m["content"]).alias("content"), F.transform(P._list(m["tool_calls"], f"array<{P._TOOL}>"), lambda t: _call(t["id"], t["function"]["name"], t["function"]["arguments"])).alias("calls"))).cast(kind)

    def said(parts: Column) -> Column:
        shown = F.transform(parts, lambda p: F.when(F.coalesce(p["thought"], F.lit(False)), F.lit(None)).when(P._text(p["text"]) != "", p["text"]).when(p["inlineData"].isNotNull(), F.concat(F.lit("["), P._text(p["inlineData"]["mimeType"]), F.lit("]"))).when(p["functionResponse"].isNotNull(), p["functionResponse"]["response"]))
        return F.array_join(F.filter(shown, lambda t: t.isNotNull()), "\n")

    def turned(c: Column) -> Column:
        parts = P._list(c["parts"], f"array<{_REQUEST_PART}>")
        result = F.exists(parts, lambda p: p["functionResponse"].isNotNull())
        role = F.when(c["role"] == "model", "assistant").when(result, "tool").otherwise(P._text(c["role"]))
        calls = F.transform(F.filter(parts, lambda p: p["functionCall"].isNotNull()), lambda p: _call(p["functionCall"]["id"], p["functionCall"]["name"], p["functionCall"]["args"]))
        return F.struct(role.alias("role"), said(parts).alias("content"), calls.alias("calls"))

    system = F.when(q["systemInstruction"].isNotNull(), F.array(F.struct(F.lit("system").alias("role"), said(P._list(q["systemInstruction"]["parts"], f"array<{_REQUEST_PART}>")).alias("content"), F.array().cast(_SHOWN).alias("calls"))).cast(kind)).otherwise(F.array().cast(kind))
    other = F.concat(system, F.transform(P._list(q["contents"], P._field(_REQUEST, "contents")), turned).cast(kind))
    declared = lambda t: F.from_json(t, "functionDeclarations array<string>")["functionDeclarations"]
    grouped = F.exists(P._list(q["contents"], P._field(_REQUEST, "contents")), lambda c: F.lit(True))
    tools = P._list(q["tools"], "array<string>")
    tools = F.when(grouped, F.flatten(F.transform(tools, lambda t: P._list(declared(t), "array<string>")))).otherwise(tools)
    rest = F.map_filter(F.from_json(request, "map<string,string>"), lambda k, v: ~k.isin(*_TAKEN))
    return F.struct(F.when(F.size(own) > 0, own).otherwise(other).alias("messages"), tools.alias("tools"), rest.alias("rest"))


def ranked(request: Column, response: Column) -> Column:
    """array<struct<rank, index, score, document>> of a rerank call; a document is looked up in the request by its index."""
    docs = F.from_json(request, "documents array<string>")["documents"]
    results = F.from_json(response, "results array<struct<index:int,relevance_score:double>>")["results"]
    text = lambda d: F.coalesce(F.get_json_object(F.when(F.startswith(d, F.lit("{")), d), "$.text"), d)
    return F.transform(results, lambda r, i: F.struct((i + 1).alias("rank"), r["index"].alias("index"), F.format_string("%.4f", r["relevance_score"]).alias("score"), text(F.get(docs, r["index"])).alias("document")))
