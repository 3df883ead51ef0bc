"""Building log lines for tests."""

import json

T = "2026/02/03 - 10:00:"


def event(rid, second, message, level="DEBUG"):
    return f"[{level}] {T}{second:02d} | {rid} | {message}"


def chunk(rid, second, value):
    return event(rid, second, "stream scanner data: data: " + (value if isinstance(value, str) else json.dumps(value, separators=(",", ":"))))


def access(rid, second, status=200, latency="1.5s"):
    return f"[GIN]   {T}{second:02d} | relay | {rid} | {status} | {latency} | 10.1.1.1 | POST /v1/chat"


def bill(rid, second, **params):
    return event(rid, second, "record consume log: userId=7, params=" + json.dumps(params), "INFO")


def body(rid, second, value, marker="text request body:"):
    return event(rid, second, f"{marker} " + (value if isinstance(value, str) else json.dumps(value)))


def rid(name):
    return (name + "0" * 24)[:24]
