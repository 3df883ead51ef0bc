"""Dashboard aggregates.

All measures are sums and maxima over calls, so every breakdown is one aggregate that combines
before it shuffles, and all of them together are one aggregate over grouping sets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from logloom.functions.scalars import date_of, duration_ms, outcome_of

NO_MODEL, NO_TOKEN, NO_CHANNEL, OTHER = "(unknown)", "(未命名)", "(无渠道)", "other"
DIMENSIONS = ("bucket", "dow", "hour", "model", "token", "channel")
SUMS = (
    "requests", "ok", "err", "unknown", "quota", "quota_count", "tokens", "prompt_tokens", "completion_tokens", "token_count",
    "cached", "cached_count", "reasoning", "reasoning_count", "lat_sum", "lat_count", "frt_sum", "frt_count", "streamed",
    "with_tools", "tool_defs", "token_name_count",
)
MAXIMA = ("lat_max", "frt_max")
#: Parts in which the values of a dimension are ranked.
PARTS = 32


def bucket_key(ts: Column, granularity: str) -> Column:
    """Key of a call's bucket, from the text of its time alone."""
    day = F.concat(F.substring(ts, 1, 4), F.substring(ts, 6, 2), F.substring(ts, 9, 2))
    if granularity == "hour":
        return F.concat(day, F.substring(ts, 12, 2))
    if granularity == "day":
        return day
    return F.date_format(F.date_trunc("week", date_of(ts)), "yyyyMMdd")


def bucket_label(key: Column) -> Column:
    day = F.concat_ws("-", F.substring(key, 5, 2), F.substring(key, 7, 2))
    return F.when(F.length(key) == 10, F.concat(day, F.lit(" "), F.substring(key, 9, 2), F.lit(":00"))).otherwise(day)


def channel_of() -> Column:
    """Resolved name, else #id, else host, of a row joined with channels."""
    return F.coalesce(F.nullif(F.col("channel_name"), F.lit("")), F.concat(F.lit("#"), F.col("channel_id").cast("string")), F.nullif(F.col("upstream_host"), F.lit("")), F.lit(NO_CHANNEL))


def timed(calls: DataFrame) -> DataFrame:
    return calls.where("epoch > 0")


def unknown_time(calls: DataFrame) -> DataFrame:
    return calls.agg(F.count_if(F.col("epoch") <= 0).alias("unknown_time"))


def cells(calls: DataFrame, granularity: str = "day") -> DataFrame:
    """All dimensions and measures of each of the latest calls (with channel_name) that has a time.

    This is a projection: each breakdown adds the measures up by its own keys, before it
    shuffles anything.
    """
    known = outcome_of(F.col("outcome"), F.col("status"))
    rows = timed(calls).select("*", known.alias("_known"), duration_ms(F.col("latency")).alias("_latency"))
    hour = F.substring("ts", 12, 2).try_cast("int")
    counted = lambda c: f"CAST(COALESCE({c}, FALSE) AS BIGINT)"
    added = lambda c: f"CAST(COALESCE({c}, 0) AS BIGINT)"
    values = {
        "requests": "1L",
        "ok": counted("_known = 'ok'"),
        "err": counted("_known = 'error'"),
        "unknown": counted("_known = ''"),
        "quota": added("quota"),
        "quota_count": counted("quota IS NOT NULL"),
        "tokens": added("COALESCE(prompt_tokens, 0) + COALESCE(completion_tokens, 0)"),
        "prompt_tokens": added("prompt_tokens"),
        "completion_tokens": added("completion_tokens"),
        "token_count": counted("prompt_tokens IS NOT NULL OR completion_tokens IS NOT NULL"),
        "cached": added("cached_tokens"),
        "cached_count": counted("cached_tokens IS NOT NULL"),
        "reasoning": added("reasoning_tokens"),
        "reasoning_count": counted("reasoning_tokens IS NOT NULL"),
        "lat_sum": added("_latency"),
        "lat_count": counted("_latency IS NOT NULL"),
        "frt_sum": added("frt_ms"),
        "frt_count": counted("frt_ms IS NOT NULL"),
        "streamed": counted("is_stream"),
        "with_tools": counted("has_tools"),
        "tool_defs": added("CASE WHEN has_tools THEN tool_count END"),
        "token_name_count": counted("token_name <> ''"),
        "lat_max": added("_latency"),
        "frt_max": added("frt_ms"),
    }
    return rows.select(
        bucket_key(F.col("ts"), granularity).alias("bucket"),
        F.weekday(date_of(F.col("ts"))).alias("dow"),
        F.when(hour.between(0, 23), hour).alias("hour"),
        F.coalesce(F.nullif("model", F.lit("")), F.lit(NO_MODEL)).alias("model"),
        F.coalesce(F.nullif("token_name", F.lit("")), F.lit(NO_TOKEN)).alias("token"),
        channel_of().alias("channel"),
        *[F.expr(f"{v} AS {n}") for n, v in values.items()],
    )


def _added() -> list[Column]:
    """The measures of rows added up."""
    adds = [(c, "sum") for c in SUMS] + [(c, "max") for c in MAXIMA]
    return [F.expr(f"CAST(COALESCE({f}({c}), 0) AS BIGINT) AS {c}") for c, f in adds]


def rolled(table: DataFrame, *keys: str | Column) -> DataFrame:
    """Measures of cells by fewer dimensions."""
    return table.groupBy(*keys).agg(*_added())


def kpi(table: DataFrame) -> DataFrame:
    """One row of totals."""
    return rolled(table)


def fold(table: DataFrame, dimension: str, top: int, order: list[str]) -> DataFrame:
    """The first `top` values of a dimension by the measures of order, the greatest first, then by name; the rest as one row `other`.

    position tells the two kinds apart if a value itself is called other. Values are ranked in
    PARTS parts first, and what no part has among its first is summed there; so the last
    ranking, in one task, is over `top` values of each part and a rest.
    """
    keys = [*[F.desc(c) for c in order], F.asc(dimension)]
    part = F.pmod(F.xxhash64(dimension), F.lit(PARTS))
    near = F.row_number().over(Window.partitionBy("_part").orderBy(*keys))
    sums = rolled(table, dimension).withColumn("_part", part).withColumn("_near", near)
    few = rolled(sums, F.when(F.col("_near") <= top, F.col(dimension)).alias(dimension))
    ranked = few.withColumn("_nth", F.row_number().over(Window.orderBy(F.col(dimension).isNull(), *keys)))
    own = F.when(F.col("_nth") <= top, F.col(dimension)).otherwise(F.lit(OTHER)).alias(dimension)
    return rolled(ranked, F.least(F.col("_nth"), F.lit(top + 1)).alias("position"), own)


def fold_models(table: DataFrame, top: int = 7) -> DataFrame:
    return fold(table, "model", top, ["requests"])


def fold_channels(table: DataFrame, top: int = 10) -> DataFrame:
    return fold(table, "channel", top, ["requests"])


def fold_tokens(table: DataFrame, top: int = 12) -> DataFrame:
    return fold(table, "token", top, ["quota", "requests"])


def _axis(since: int, until: int, granularity: str) -> Column:
    """Keys of all buckets from since to until; days and weeks step by the calendar, hours by 3600 seconds."""
    unit, step, pattern = {"hour": ("hour", "interval 1 hour", "yyyyMMddHH"), "day": ("day", "interval 1 day", "yyyyMMdd"), "week": ("week", "interval 7 days", "yyyyMMdd")}[granularity]
    cut = lambda s: F.date_trunc(unit, F.timestamp_seconds(F.lit(s)))
    return F.array_distinct(F.transform(F.sequence(cut(since), cut(until), F.expr(step)), lambda t: F.date_format(t, pattern)))


def axis(spark: SparkSession, since: int, until: int, granularity: str) -> DataFrame:
    return spark.range(1).select(F.explode(_axis(since, until, granularity)).alias("bucket"))


def series(table: DataFrame, since: int, until: int, granularity: str) -> DataFrame:
    """A row for each bucket of the axis, zeros where nothing was; calls off the axis count in totals only.

    Without valid bounds the buckets that exist are taken.
    """
    buckets = rolled(table, "bucket")
    if not 0 < since <= until:
        return buckets.select("bucket", bucket_label(F.col("bucket")).alias("label"), *SUMS, *MAXIMA)
    full = axis(table.sparkSession, since, until, granularity).join(buckets, "bucket", "left")
    return full.select("bucket", bucket_label(F.col("bucket")).alias("label"), *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in (*SUMS, *MAXIMA)])


def hours(table: DataFrame) -> DataFrame:
    """Requests of each of the 24 hours."""
    grid = table.sparkSession.range(24).select(F.col("id").cast("int").alias("hour"))
    found = table.where("hour is not null").groupBy("hour").agg(F.sum("requests").alias("requests"))
    return grid.join(found, "hour", "left").select("hour", F.coalesce("requests", F.lit(0)).cast("bigint").alias("requests"))


def weekday_hours(table: DataFrame) -> DataFrame:
    """Requests of each weekday (Monday 0) and hour."""
    grid = table.sparkSession.range(168).select(F.expr("cast(id div 24 as int)").alias("dow"), F.expr("cast(id % 24 as int)").alias("hour"))
    found = table.where("hour is not null and dow is not null").groupBy("dow", "hour").agg(F.sum("requests").alias("requests"))
    return grid.join(found, ["dow", "hour"], "left").select("dow", "hour", F.coalesce("requests", F.lit(0)).cast("bigint").alias("requests"))


#: Breakdowns of a dashboard: their keys, and for top lists how many rows and by which measures.
_BREAKDOWNS: dict[str, tuple[tuple[str, ...], int, tuple[str, ...]]] = {
    "total": ((), 0, ()),
    "series": (("bucket",), 0, ()),
    "hours": (("hour",), 0, ()),
    "dow_hours": (("dow", "hour"), 0, ()),
    "by_model": (("model",), 7, ("requests", "requests")),
    "by_channel": (("channel",), 10, ("requests", "requests")),
    "by_token": (("token",), 12, ("quota", "requests")),
}


def dashboard(table: DataFrame, since: int, until: int, granularity: str) -> DataFrame:
    """One row with the totals and all breakdowns as arrays.

    The calls are read once and added up by all breakdowns' keys in one aggregate. What
    follows works on its few rows: values of top lists are ranked in parts first, as in fold(), all lists at
    once; the last step fills the empty places of axes.
    """
    measures = (*SUMS, *MAXIMA)
    number = {d: 1 << (len(DIMENSIONS) - 1 - i) for i, d in enumerate(DIMENSIONS)}
    level = {sum(number.values()) - sum(number[d] for d in keys): name for name, (keys, _, _) in _BREAKDOWNS.items()}
    sums = table.groupingSets([list(keys) for keys, _, _ in _BREAKDOWNS.values()], *DIMENSIONS).agg(F.grouping_id().alias("_level"), *_added())
    case = lambda values: F.expr("CASE _level " + " ".join(f"WHEN {n} THEN {v}" for n, v in values.items()) + " END")
    lists = {n: _BREAKDOWNS[k] for n, k in level.items() if _BREAKDOWNS[k][1]}
    listed = sums.select(
        case({n: f"'{k}'" for n, k in level.items()}).alias("kind"),
        case({n: keys[0] for n, (keys, _, _) in lists.items()}).alias("name"),
        case({n: most for n, (_, most, _) in lists.items()}).alias("top"),
        case({n: order[0] for n, (_, _, order) in lists.items()}).alias("_first"),
        case({n: order[1] for n, (_, _, order) in lists.items()}).alias("_second"),
        "bucket", "dow", "hour", *measures,
    )
    best = [F.desc("_first"), F.desc("_second"), F.asc("name")]
    near = F.row_number().over(Window.partitionBy("kind", F.pmod(F.xxhash64("name"), F.lit(PARTS))).orderBy(*best))
    ranked = listed.withColumn("_rest", F.col("name").isNotNull() & (near > F.col("top")))
    own = lambda c: F.expr(f"CASE WHEN NOT _rest THEN {c} END AS {c}")
    few = rolled(ranked, "kind", "top", "bucket", "dow", "hour", "_rest", own("name"), own("_first"), own("_second"))
    nth = F.row_number().over(Window.partitionBy("kind").orderBy("_rest", *best))
    placed = few.withColumn("position", F.when(F.col("top").isNotNull(), F.least(nth, F.col("top") + 1)))
    called = F.expr(f"CASE WHEN position > top THEN '{OTHER}' ELSE name END AS name")
    rows = rolled(placed, "kind", "bucket", "dow", "hour", "position", called)
    all_ = ", ".join(measures)
    array = lambda k, name: f"array_sort(collect_list(CASE WHEN kind = '{k}' THEN struct(position, name AS {name}, {all_}) END)) AS {k}"
    cell = lambda k, key, value: f"map_from_entries(collect_list(CASE WHEN kind = '{k}' AND {key} IS NOT NULL THEN struct({key} AS k, {value} AS v) END)) AS _{k}"
    one = rows.agg(*map(F.expr, [
        *[f"COALESCE(max(CASE WHEN kind = 'total' THEN {c} END), 0) AS {c}" for c in measures],
        *[array(f"by_{k[0][0]}", k[0][0]) for k in lists.values()],
        cell("series", "bucket", f"struct({all_})"), cell("hours", "hour", "requests"), cell("dow_hours", "CAST(dow * 24 + hour AS INT)", "requests"),
    ]))
    keys = _axis(since, until, granularity) if 0 < since <= until else F.array_sort(F.map_keys("_series"))
    zeros = "named_struct(" + ", ".join(f"'{c}', 0L" for c in measures) + ")"
    shown = one.withColumn("_cells", F.transform(keys, lambda k: F.struct(k.alias("key"), bucket_label(k).alias("label"))))
    return shown.selectExpr(
        *measures,
        f"transform(transform(_cells, c -> struct(c AS c, coalesce(try_element_at(_series, c.key), {zeros}) AS v)), x -> struct(x.c.key AS bucket, x.c.label AS label, {', '.join(f'x.v.{c} AS {c}' for c in measures)})) AS series",
        *[f"by_{k[0][0]}" for k in lists.values()],
        "transform(sequence(0, 23), i -> struct(i AS hour, coalesce(try_element_at(_hours, i), 0L) AS requests)) AS hours",
        "transform(sequence(0, 167), i -> struct(CAST(i div 24 AS INT) AS dow, i % 24 AS hour, coalesce(try_element_at(_dow_hours, i), 0L) AS requests)) AS dow_hours",
    )
