"""Classifying log entries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom.functions.scalars import clip_bytes

# The log format's line grammar and message markers.
_BAR, _ID, _STAMP = r"\s+\|\s+", r"[A-Za-z0-9]{24,}", r"\]\s+\d{4}/\d{2}/\d{2}\s+-\s+\d{2}:\d{2}:\d{2}\s+\|\s+"
_ACCESS = _BAR.join([r"^(relay|api)", f"({_ID})", r"(\d{3})", r"(\S+)", r"(\S+)", r"([A-Z]+)\s+(\S+)"])
#: The start of a line that belongs to a request: an access line's, or any other's up to its message.
_LINE = rf"^\[(?:GIN{_STAMP}{_ACCESS[1:]}|[A-Z]+{_STAMP}{_ID}\s+\|\s)"
#: What \s stands for.
SPACE = " \t\n\x0b\f\r"
REQUEST = ("text request body:", "requestBody:", "Gemini request body:", "Rerank request body:")
RESPONSE = ("upstream response body:", "Gemini response body:", "Gemini native response body:", "Gemini responses response body:", "responseBody:", "reranker response body:")
CHUNK, URL, BILL = "stream scanner data:", "fullRequestURL:", "record consume log:"

ERROR_BYTES = 2000
#: The JSON parser's leniencies, off.
STRICT = {"allowSingleQuotes": "false", "allowNonNumericNumbers": "false"}


def held_strictly(text: Column, kind: str = "") -> tuple[Column, Column]:
    """A text parsed inside an object (struct<value, end>; value if a kind, a DDL type, is asked for), and whether it is one item of a list.

    Spark's parsers stop at the end of a value, whatever follows. So the text is put into an
    object before a closing member, which is found only if the text neither ends the object nor is
    damaged; and into a list, which has one item only if it brings no members of its own.
    """
    held = F.from_json(F.concat(F.lit('{"value":'), text, F.lit(',"end":1}')), f"value {kind}, end int" if kind else "end int", STRICT)
    return held, F.json_array_length(F.concat(F.lit("["), text, F.lit("]"))) == 1


def parsed_strictly(text: Column, kind: str = "") -> tuple[Column, Column]:
    """Whether a text is exactly one JSON value by the strict grammar, and that value if it is of the kind asked for."""
    held, alone = held_strictly(text, kind)
    return F.coalesce(alone & held["end"].isNotNull(), F.lit(False)), held["value"] if kind else held["end"]


def valid_json(text: Column) -> Column:
    """Whether a text is exactly one JSON value by the strict grammar (nested no more than 1,000 deep); false for null."""
    return parsed_strictly(text)[0]


def admitted(body: Column) -> Column:
    """A body as it is kept: null unless valid, line breaks between its parts removed.

    In valid JSON a line break stands between parts only.
    """
    text = F.trim(body)
    return F.when(valid_json(text) & (text != "null"), F.when(F.contains(text, F.lit("\n")), F.regexp_replace(text, r"\s*\n\s*", "")).otherwise(text))


def classify(entries: DataFrame) -> DataFrame:
    """Events: level, ts, rid, kind, msg, body and the access fields of entries that belong to a request.

    The first kind that fits wins: access, request, response, chunk, url, billing, end, error, other.
    """
    space, rest_of = F.lit(SPACE), (1 << 31) - 1
    # A line that fits is cut at its first two bars; all else is told from those short pieces.
    cut = entries.where(F.rlike("value", F.lit(_LINE))).select("*", F.split("value", r"\|", 3).alias("p"))
    head, name, tail = (F.get("p", F.lit(i)) for i in range(3))
    level = F.substring_index(F.substring(head, 2, rest_of), "]", 1)
    date = F.substring(F.ltrim(F.substring_index(head, "]", -1), space), 1, 10)
    lines = cut.select("ord", "file", level.alias("level"), F.concat_ws(" ", date, F.right(F.rtrim(head, space), F.lit(8))).alias("ts"), F.trim(name, space).alias("name"), tail.alias("tail"), name.alias("_name"))
    is_access = (F.col("level") == "GIN") & F.col("name").isin("relay", "api")
    rows = lines.select(
        "ord", "file", "level", "ts", is_access.alias("is_access"), F.when(is_access, F.trim(F.substring_index("tail", "|", 1), space)).otherwise(F.col("name")).alias("rid"),
        F.when(is_access, F.ltrim(F.concat("_name", F.lit("|"), "tail"), space)).otherwise(F.ltrim("tail", space)).alias("msg"),
    )
    msg, is_access = F.col("msg"), F.col("is_access")
    kind, mark = F.when(is_access, "access"), F.lit(None).cast("int")
    for name, markers in (("request", REQUEST), ("response", RESPONSE), ("chunk", (CHUNK,)), ("url", (URL,))):
        for m in markers:
            kind = kind.when(F.startswith(msg, F.lit(m)), name)
            mark = F.when(F.startswith(msg, F.lit(m)), len(m)).otherwise(mark)
    kind = kind.when(F.startswith(msg, F.lit(BILL)), "billing").when(F.contains(msg, F.lit("stream ended")), "end")
    kind = kind.when((F.col("level") == "ERR") | F.contains(F.lower(msg), F.lit("error")), "error").otherwise("other")
    rows = rows.select("*", kind.alias("kind"), mark.alias("mark"))
    kind, params = F.col("kind"), F.instr(msg, "params=")
    access = {n: F.when(is_access, F.regexp_extract(msg, _ACCESS, i)) for n, i in (("access_kind", 1), ("latency", 4), ("ip", 5), ("method", 6), ("path", 7))}
    body = F.when(F.col("mark").isNotNull(), F.trim(F.substring(msg, F.col("mark") + 1, F.lit(rest_of)))).when(kind == "billing", F.when(params > 0, F.trim(F.substring(msg, params + 7, F.lit(rest_of)))))
    return rows.select(
        "ord", "file", "level", "ts", "rid", "msg", "kind", body.alias("body"),
        F.when(is_access, F.regexp_extract(msg, _ACCESS, 3).try_cast("int")).alias("status"),
        *[c.alias(n) for n, c in access.items()],
        F.when(kind == "end", F.trim(F.substring_index(msg, "reason=", -1))).alias("stream_end"),
        F.when(kind == "error", clip_bytes(msg, ERROR_BYTES)).alias("error"),
    )
