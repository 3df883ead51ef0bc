"""Time ranges of requests, resolved on the driver."""

from __future__ import annotations

import time
from datetime import datetime, timedelta
from zoneinfo import ZoneInfo


def resolve_range(name: str, tz: str = "UTC", now: float | None = None) -> tuple[int, int]:
    """(since, until) of today, 7d, 30d or ytd in local days."""
    end = datetime.fromtimestamp(time.time() if now is None else now, ZoneInfo(tz)).replace(hour=23, minute=59, second=59, microsecond=0)
    start = end.replace(hour=0, minute=0, second=0)
    if name == "ytd":
        start = start.replace(month=1, day=1)
    elif name in ("today", "7d", "30d"):
        start -= timedelta(days={"today": 0, "7d": 6, "30d": 29}[name])
    else:
        raise ValueError(f"unknown range {name!r}")
    return int(start.timestamp()), int(end.timestamp())


def parse_epoch(text: str) -> int:
    """Seconds, '' for none; milliseconds and negative numbers are refused."""
    if text == "":
        return 0
    value = int(text)
    if not 0 <= value <= 1 << 34:
        raise ValueError("not a time in seconds")
    return value


def number_or(text: str, default: int) -> int:
    """A number that fits 31 bits, else the default."""
    try:
        value = int(text)
    except ValueError:
        return default
    return value if 0 <= value < 1 << 31 else default


def custom_range(since: int, until: int, earliest: int, now: float | None = None) -> tuple[int, int]:
    until = until or int(time.time() if now is None else now)
    since = since or earliest
    if until < since:
        raise ValueError("until is before since")
    return since, until


def granularity(since: int, until: int) -> str:
    days = (until - since + 86399) // 86400
    return "hour" if days <= 2 else "day" if days <= 120 else "week"
