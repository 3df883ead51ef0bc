"""A calls table derived from the events table, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHANNELS = [(i, "" if i == 5 else f"chan-{i}", f"https://up{i}.example:8443/v1") for i in range(10)]

_NAMES = ", ".join(f"({i}, '{name or url.split('//')[1].split('/')[0]}')" for i, name, url in CHANNELS)

COLUMNS = {
    "status": ("CASE event_type WHEN 'signup' THEN NULL WHEN 'error' THEN 500 ELSE 200 END", "int"),
    "outcome": ("CASE event_type WHEN 'error' THEN 'error' WHEN 'signup' THEN '' WHEN 'view' THEN '' ELSE 'ok' END", "string"),
    "model": ("CASE WHEN k % 29 = 0 THEN '' ELSE concat('m', user_id % 11) END", "string"),
    "token_name": ("CASE WHEN event_type = 'view' THEN '' ELSE concat('tok-', user_id % 17) END", "string"),
    "channel_id": ("CASE WHEN event_id % 7 = 0 THEN NULL ELSE user_id % 13 END", "int"),
    "upstream_host": ("CASE WHEN event_id % 14 = 0 THEN '' ELSE concat('host', user_id % 3, '.example') END", "string"),
    "is_stream": ("event_id % 3 = 0", "boolean"),
    "has_tools": ("user_id % 4 = 0", "boolean"),
    "tool_count": ("k % 5", "int"),
    "prompt_tokens": ("CASE WHEN event_type = 'view' THEN NULL ELSE k * 10 END", "bigint"),
    "completion_tokens": ("CASE WHEN event_type IN ('view', 'error') THEN NULL ELSE k * 3 END", "bigint"),
    "cached_tokens": ("CASE WHEN event_id % 2 = 0 THEN k ELSE NULL END", "bigint"),
    "reasoning_tokens": ("CASE WHEN event_type = 'purchase' THEN k % 17 ELSE NULL END", "bigint"),
    "quota": ("CASE WHEN event_type = 'view' THEN NULL ELSE floor(value * 100 + 0.5) * ver END", "bigint"),
    "frt_ms": ("CASE WHEN event_type = 'purchase' THEN floor(value * 1000 + 0.5) ELSE NULL END", "bigint"),
    "latency": ("CASE event_id % 5 WHEN 0 THEN concat(k, 'ms') WHEN 1 THEN concat('1m', k, '.5s') WHEN 2 THEN concat(k, '.25s') WHEN 3 THEN '' ELSE concat(k, 'µs') END", "string"),
    "error_count": ("CASE WHEN event_type = 'error' THEN 1 + k % 3 ELSE 0 END", "int"),
    "preview": ("concat('call ', event_type, ' by User', user_id)", "string"),
}


def dealt_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table dealt out over all cores: its files are small, and each row becomes many lines or long ones.

    The number is set, so that Spark doesn't put the parts together again for their size.
    """
    return spark.read.parquet(f"{sf_dir}/events.parquet").repartition(4 * spark.sparkContext.defaultParallelism, "event_id")


def calls(spark: SparkSession, sf_dir: str, also: tuple[str, ...] = ()) -> DataFrame:
    """Two versions of every ninth event, one of the others; every 97th has no time. also: columns of the events to keep."""
    e = dealt_events(spark, sf_dir)
    e = e.select("*", F.get_json_object("props", "$.k").cast("bigint").alias("k"), F.explode(F.expr("CASE WHEN event_id % 9 = 0 THEN array(1, 2) ELSE array(1) END")).alias("ver"))
    timed = F.col("event_id") % 97 != 0
    base = e.select(
        F.date_format("ts", "yyyyMMdd").alias("day"),
        F.concat(F.lit("r"), F.lpad(F.col("event_id").cast("string"), 9, "0")).alias("request_id"),
        (F.col("event_id") * 2 + F.col("ver")).alias("append_seq"),
        F.when(timed, F.date_format("ts", "yyyy/MM/dd HH:mm:ss")).otherwise("").alias("ts"),
        F.when(timed, F.unix_timestamp(F.col("ts").cast("timestamp"))).otherwise(0).cast("bigint").alias("epoch"),
        *[F.expr(sql).cast(kind).alias(name) for name, (sql, kind) in COLUMNS.items()],
        F.expr("transform(sequence(0, cast(k % 3 as int)), i -> concat('tool-', i + user_id % 5))").alias("tool_names"),
        *also,
    )
    return base


def channels(spark: SparkSession) -> DataFrame:
    """The channel dimension as a table whose size Spark knows."""
    return spark.sql(f"SELECT * FROM VALUES {_NAMES} AS t(id, name)")


def _duck(sql: str, kind: str) -> str:
    return f"CAST({sql} AS {({'string': 'VARCHAR'}.get(kind, kind)).upper()})"


CTE = f"""
ev AS (SELECT *, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k,
              unnest(CASE WHEN event_id % 9 = 0 THEN [1, 2] ELSE [1] END) AS ver FROM events),
versions AS (SELECT strftime(ts, '%Y%m%d') AS day_key, 'r' || lpad(CAST(event_id AS VARCHAR), 9, '0') AS request_id,
    event_id * 2 + ver AS append_seq,
    CASE WHEN event_id % 97 <> 0 THEN strftime(ts, '%Y/%m/%d %H:%M:%S') ELSE '' END AS tst,
    CASE WHEN event_id % 97 <> 0 THEN CAST(floor(epoch(ts)) AS BIGINT) ELSE 0 END AS epoch_s,
    {', '.join(f'{_duck(sql, kind)} AS {name}' for name, (sql, kind) in COLUMNS.items())},
    list_transform(range(0, CAST(k % 3 AS INT) + 1), lambda i: 'tool-' || CAST(i + user_id % 5 AS VARCHAR)) AS tool_names, event_type, user_id, event_id, k FROM ev),
latest AS (SELECT * FROM versions QUALIFY row_number() OVER (PARTITION BY day_key, request_id ORDER BY append_seq DESC) = 1),
chan(id, name) AS (VALUES {_NAMES}),
known AS (SELECT l.*, COALESCE(NULLIF(outcome, ''), CASE WHEN status >= 400 THEN 'error' WHEN status IS NOT NULL THEN 'ok' END, '') AS known,
    COALESCE(NULLIF(c.name, ''), '#' || channel_id, NULLIF(upstream_host, ''), '(无渠道)') AS channel,
    CASE WHEN latency LIKE '%µs' THEN 0 WHEN latency LIKE '%ms' THEN CAST(replace(latency, 'ms', '') AS BIGINT)
         WHEN latency LIKE '1m%' THEN 60000 + CAST(floor(CAST(regexp_extract(latency, '1m(.*)s', 1) AS DOUBLE) * 1000 + 0.5) AS BIGINT)
         WHEN latency LIKE '%s' THEN CAST(floor(CAST(replace(latency, 's', '') AS DOUBLE) * 1000 + 0.5) AS BIGINT) END AS lat
    FROM latest l LEFT JOIN chan c ON c.id = l.channel_id),
timed AS (SELECT *, COALESCE(NULLIF(model, ''), '(unknown)') AS model_key, COALESCE(NULLIF(token_name, ''), '(未命名)') AS token_key,
    substr(tst, 1, 4) || substr(tst, 6, 2) || substr(tst, 9, 2) AS dkey, CAST(substr(tst, 12, 2) AS INT) AS hr FROM known WHERE epoch_s > 0)"""

MEASURES = {
    "requests": "count(*)", "ok": "count(*) FILTER (known = 'ok')", "err": "count(*) FILTER (known = 'error')", "unknown": "count(*) FILTER (known = '')",
    "quota": "sum(quota)", "quota_count": "count(quota)", "tokens": "sum(COALESCE(prompt_tokens, 0) + COALESCE(completion_tokens, 0))",
    "prompt_tokens": "sum(prompt_tokens)", "completion_tokens": "sum(completion_tokens)",
    "token_count": "count(*) FILTER (prompt_tokens IS NOT NULL OR completion_tokens IS NOT NULL)",
    "cached": "sum(cached_tokens)", "cached_count": "count(cached_tokens)", "reasoning": "sum(reasoning_tokens)", "reasoning_count": "count(reasoning_tokens)",
    "lat_sum": "sum(lat)", "lat_count": "count(lat)", "frt_sum": "sum(frt_ms)", "frt_count": "count(frt_ms)", "streamed": "count(*) FILTER (is_stream)",
    "with_tools": "count(*) FILTER (has_tools)", "tool_defs": "sum(tool_count) FILTER (has_tools)", "token_name_count": "count(*) FILTER (token_name <> '')",
    "lat_max": "max(lat)", "frt_max": "max(frt_ms)",
}
AGGREGATES = ", ".join(f"CAST(COALESCE({sql}, 0) AS BIGINT) AS {name}" for name, sql in MEASURES.items())
