"""Scalar column functions: hosts, durations, clips, time slices."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_DURATION = r"^(?:[0-9]+(?:\.[0-9]*)?|\.[0-9]+)(?:ns|us|µs|μs|ms|s|m|h)(?:(?:[0-9]+(?:\.[0-9]*)?|\.[0-9]+)(?:ns|us|µs|μs|ms|s|m|h))*$"
_PART = r"([0-9]*\.?[0-9]*)(ns|us|µs|μs|ms|s|m|h)"
_SCALE = {"ns": "0.000001", "us": "0.001", "µs": "0.001", "μs": "0.001", "ms": "1", "s": "1000", "m": "60000", "h": "3600000"}


def host_of(url: Column) -> Column:
    """Host and port of a URL, scheme optional; '' where there is none."""
    u = F.trim(F.coalesce(url, F.lit("")))
    full = F.when(F.contains(u, F.lit("://")), u).otherwise(F.concat(F.lit("//"), u))
    authority = F.coalesce(F.try_parse_url(full, F.lit("AUTHORITY")), F.lit(""))
    return F.regexp_replace(authority, r"^.*@", "")


def _many_units(text: Column) -> Column:
    values = F.regexp_extract_all(text, F.lit(_PART), F.lit(1))
    units = F.regexp_extract_all(text, F.lit(_PART), F.lit(2))
    factor = F.create_map(*[x for k, v in _SCALE.items() for x in (F.lit(k), F.lit(v).cast("decimal(16,6)"))])
    terms = F.zip_with(values, units, lambda v, u: (F.coalesce(F.nullif(v, F.lit("")), F.lit("0")).try_cast("decimal(18,9)") * factor[u]).cast("decimal(38,12)"))
    total = F.aggregate(terms, F.lit(0).cast("decimal(38,12)"), lambda a, b: (a + b).cast("decimal(38,12)"))
    return F.when(F.rlike(text, F.lit(_DURATION)), F.floor(total).cast("bigint"))


def duration_ms(text: Column) -> Column:
    """Whole milliseconds of a duration such as 1m2.5s, cut off; null if it isn't one.

    Most have one unit: a number and a suffix. Only others are taken apart.
    """
    out = _many_units(text)
    for unit in ("s", "ns", "us", "µs", "μs", "ms"):  # the last that fits is asked first
        number = F.left(text, F.length(text) - len(unit))
        plain = F.endswith(text, F.lit(unit)) & F.rlike(number, F.lit(r"^(?:[0-9]{1,9}(?:\.[0-9]{0,9})?|\.[0-9]{1,9})$"))
        out = F.when(plain, F.floor(number.try_cast("decimal(18,9)") * F.lit(_SCALE[unit]).cast("decimal(10,6)")).cast("bigint")).otherwise(out)
    return F.when(text != "", out)


def clip_bytes(text: Column, n: int) -> Column:
    """The first n bytes of a text; a character cut in half is replaced."""
    return F.when(F.octet_length(text) <= n, text).otherwise(F.make_valid_utf8(F.substring(text.cast("binary"), 1, n).cast("string")))


def clip_chars(text: Column, n: int) -> Column:
    return F.left(text, F.lit(n))


def day_of(ts: Column, today: Column | None = None) -> Column:
    """yyyymmdd of a 'yyyy/MM/dd ...' text; today where it is too short."""
    d = F.concat(F.substring(ts, 1, 4), F.substring(ts, 6, 2), F.substring(ts, 9, 2))
    return F.when(F.length(ts) >= 10, d).otherwise(today if today is not None else F.date_format(F.current_timestamp(), "yyyyMMdd"))


def date_of(ts: Column) -> Column:
    """The date that a 'yyyy/MM/dd ...' text begins with; null if it isn't one."""
    return F.when(F.substring(ts, 5, 1) == "/", F.translate(F.substring(ts, 1, 10), "/", "-").try_cast("date"))


def epoch_of(ts: Column) -> Column:
    """Seconds of a local wall-clock text; 0 if it isn't one."""
    return F.coalesce(F.unix_timestamp(F.try_to_timestamp(ts, F.lit("yyyy/MM/dd HH:mm:ss"))), F.lit(0)).cast("bigint")


def html_escape(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&#34;"), ("'", "&#39;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def outcome_of(outcome: Column, status: Column) -> Column:
    """Recorded outcome, else what the status says, else '' for unknown."""
    return F.coalesce(F.nullif(outcome, F.lit("")), F.when(status >= 400, "error").when(status.isNotNull(), "ok"), F.lit(""))


def frt_ms(frt: Column, scale: float = 1000.0) -> Column:
    """First-response time as whole milliseconds; negative ones are gaps."""
    return F.when(frt >= 0, F.floor(frt * scale + 0.5).cast("bigint"))


def record_size(*bodies: Column) -> Column:
    return sum((F.coalesce(F.octet_length(b), F.lit(0)) for b in bodies), F.lit(512)).cast("bigint")
