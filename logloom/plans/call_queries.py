"""Queries over the derived calls table and their reference SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.functions import scalars
from logloom.operators import calls as C
from logloom.operators import listing, stats
from logloom.plans.sample_calls import AGGREGATES, CTE, MEASURES, calls, channels

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

#: 2024-01-03 00:00:00 to 2024-01-24 23:59:59, UTC.
SINCE, UNTIL = 1704240000, 1706140799
_LISTED = ["request_id", "ts", "model", "token_name", "status"]


def _query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = f"WITH {CTE} {sql}"
        return f

    return add


def _cells(spark: SparkSession, sf_dir: str, granularity: str = "day") -> DataFrame:
    return stats.cells(listing.with_channels(C.latest(calls(spark, sf_dir)), channels(spark)), granularity)


@_query("stats_kpi", f"SELECT {AGGREGATES} FROM timed")
def stats_kpi(spark, sf_dir):
    return stats.kpi(_cells(spark, sf_dir))


@_query("stats_unknown_time", "SELECT count(*) FILTER (epoch_s <= 0) AS unknown_time FROM latest")
def stats_unknown_time(spark, sf_dir):
    return stats.unknown_time(C.latest(calls(spark, sf_dir)))


@_query("stats_filtered", f"SELECT {AGGREGATES} FROM timed WHERE model = 'm3' AND is_stream AND epoch_s BETWEEN {SINCE} AND {UNTIL}")
def stats_filtered(spark, sf_dir):
    f = C.CallFilter(model="m3", stream="1", since=SINCE, until=UNTIL)
    return stats.kpi(stats.cells(listing.with_channels(C.matching(calls(spark, sf_dir), f), channels(spark))))


@_query("dedupe_latest", "SELECT day_key, request_id, append_seq, quota FROM latest")
def dedupe_latest(spark, sf_dir):
    return C.latest(calls(spark, sf_dir)).select(F.col("day").alias("day_key"), "request_id", "append_seq", "quota")


@_query("dedupe_wide", "SELECT request_id, append_seq, preview FROM latest")
def dedupe_wide(spark, sf_dir):
    return C.latest_wide(calls(spark, sf_dir)).select("request_id", "append_seq", "preview")


@_query("dedupe_first", "SELECT request_id, append_seq FROM versions QUALIFY row_number() OVER (PARTITION BY day_key, request_id ORDER BY append_seq) = 1")
def dedupe_first(spark, sf_dir):
    return C.first_in_batch(calls(spark, sf_dir)).select("request_id", "append_seq")


@_query("dedupe_then_filter", "SELECT request_id, quota FROM latest WHERE quota > 20000")
def dedupe_then_filter(spark, sf_dir):
    return C.latest(calls(spark, sf_dir)).where("quota > 20000").select("request_id", "quota")


@_query("all_versions", "SELECT request_id, append_seq, frt_ms, error_count FROM versions")
def all_versions(spark, sf_dir):
    return calls(spark, sf_dir).select("request_id", "append_seq", "frt_ms", "error_count")


_ZEROED = ", ".join(f"COALESCE(b.{m}, 0) AS {m}" for m in MEASURES)
_AXES = {
    "hour": ("strftime(t, '%Y%m%d%H')", "INTERVAL 1 HOUR", "dkey || substr(tst, 12, 2)", "substr(key, 5, 2) || '-' || substr(key, 7, 2) || ' ' || substr(key, 9, 2) || ':00'"),
    "day": ("strftime(t, '%Y%m%d')", "INTERVAL 1 DAY", "dkey", "substr(key, 5, 2) || '-' || substr(key, 7, 2)"),
    "week": ("strftime(t, '%Y%m%d')", "INTERVAL 7 DAY", "strftime(date_trunc('week', strptime(dkey, '%Y%m%d')), '%Y%m%d')", "substr(key, 5, 2) || '-' || substr(key, 7, 2)"),
}


def _series(granularity: str) -> None:
    key, step, own, label = _AXES[granularity]
    sql = f""", axis AS (SELECT {key} AS key FROM generate_series(date_trunc('{granularity}', make_timestamp({SINCE}::BIGINT * 1000000)), date_trunc('{granularity}', make_timestamp({UNTIL}::BIGINT * 1000000)), {step}) g(t)),
    b AS (SELECT {own} AS bkey, {AGGREGATES} FROM timed GROUP BY 1)
    SELECT key AS bucket, {label} AS label, {_ZEROED} FROM axis LEFT JOIN b ON b.bkey = axis.key"""

    @_query(f"series_{granularity}", sql)
    def run(spark, sf_dir):
        return stats.series(_cells(spark, sf_dir, granularity), SINCE, UNTIL, granularity)


for _g in _AXES:
    _series(_g)


def _fold(name: str, dimension: str, key: str, top: int, order: str, f: Callable[[DataFrame], DataFrame]) -> None:
    sums = ", ".join(f"CAST({'max' if m.endswith('_max') else 'sum'}({m}) AS BIGINT) AS {m}" for m in MEASURES)
    sql = f""", g AS (SELECT {key} AS v, {AGGREGATES} FROM timed GROUP BY 1),
    r AS (SELECT *, row_number() OVER (ORDER BY {order}, v) AS nth FROM g)
    SELECT CAST(LEAST(nth, {top + 1}) AS INT) AS position, CASE WHEN nth <= {top} THEN v ELSE 'other' END AS {dimension}, {sums} FROM r GROUP BY 1, 2"""

    @_query(name, sql)
    def run(spark, sf_dir):
        return f(_cells(spark, sf_dir))


_fold("models_fold", "model", "model_key", 7, "requests DESC", stats.fold_models)
_fold("channels_fold", "channel", "channel", 10, "requests DESC", stats.fold_channels)
_fold("tokens_fold", "token", "token_key", 12, "quota DESC, requests DESC", stats.fold_tokens)


@_query("hour_histogram", "SELECT CAST(h AS INT) AS hour, count(hr) AS requests FROM range(24) t(h) LEFT JOIN timed ON hr = h GROUP BY 1")
def hour_histogram(spark, sf_dir):
    return stats.hours(_cells(spark, sf_dir))


@_query("dow_hour_heatmap", "SELECT CAST(i // 24 AS INT) AS dow, CAST(i % 24 AS INT) AS hour, count(hr) AS requests FROM range(168) t(i) LEFT JOIN timed ON hr = i % 24 AND isodow(strptime(dkey, '%Y%m%d')) - 1 = i // 24 GROUP BY 1, 2")
def dow_hour_heatmap(spark, sf_dir):
    return stats.weekday_hours(_cells(spark, sf_dir))


@_query("latency_parse", "SELECT request_id, latency, CAST(lat AS BIGINT) AS latency_ms FROM known")
def latency_parse(spark, sf_dir):
    return C.latest(calls(spark, sf_dir)).select("request_id", "latency", scalars.duration_ms(F.col("latency")).alias("latency_ms"))


@_query("frt_index", "SELECT event_id, CASE WHEN value >= 0 THEN CAST(floor(value * 1000 + 0.5) AS BIGINT) END AS frt_ms FROM events")
def frt_index(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", scalars.frt_ms(F.col("value")).alias("frt_ms"))


def _filtered(name: str, where: str, **what) -> None:
    @_query(name, f"SELECT request_id, tst AS ts, model, token_name, status FROM known WHERE {where}")
    def run(spark, sf_dir):
        return C.matching(calls(spark, sf_dir), C.CallFilter(**what)).select(*_LISTED)


_filtered("filter_model", "model = 'm3'", model="m3")
_filtered("filter_token", "token_name = 'tok-5'", token="tok-5")
_filtered("filter_status_ok", "known = 'ok'", status="ok")
_filtered("filter_status_err", "known = 'error'", status="err")
_filtered("filter_stream", "is_stream", stream="1")
_filtered("filter_not_stream", "NOT is_stream", stream="0")
_filtered("filter_tools", "has_tools", tools="1")
_filtered("filter_errors", "error_count > 0", errors=True)
# a bounded range also prunes days, which timeless calls are filed under
_filtered("filter_range", f"(epoch_s <= 0 OR epoch_s BETWEEN {SINCE} AND {UNTIL}) AND day_key BETWEEN '20240103' AND '20240124'", since=SINCE, until=UNTIL)
_filtered("filter_combined", "model = 'm3' AND known = 'ok' AND has_tools AND is_stream", model="m3", status="ok", tools="1", stream="1")
_filtered("tool_membership", "list_contains(tool_names, 'tool-2')", tool_name="tool-2")


@_query("search_calls", """SELECT request_id, preview FROM latest WHERE contains(lower(preview), 'by user7') OR contains(request_id, 'by user7') OR event_type = 'signup' AND user_id % 10 = 7
    OR event_type = 'click' AND k % 20 = 7 OR event_type = 'error' AND event_id % 9 = 0""")
def search_calls(spark, sf_dir):
    """A text that may stand in any of the five searched columns; the others are never looked at."""
    rows = calls(spark, sf_dir, ("event_type", "user_id", "event_id", "k"))
    found = lambda when, text: F.when(F.expr(when), F.lit(text))
    bodies = {
        "request": found("event_type = 'signup' AND user_id % 10 = 7", '{"q":"made By USER7"}'),
        "response": found("event_type = 'click' AND k % 20 = 7", '{"by user7":1}'),
        "stream_content": found("event_type = 'error' AND event_id % 9 = 0", "x by user7"),
        "billing": F.lit("by user7"),
    }
    return C.matching(rows.withColumns(bodies), C.CallFilter(search="BY User7")).select("request_id", "preview")


@_query("search_text", "SELECT doc_id FROM documents WHERE contains(lower(text), 'tion the')")
def search_text(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").where(F.contains(F.lower("text"), F.lit("tion the"))).select("doc_id")


@_query("day_prune", "SELECT day_key, count(*) AS n FROM versions WHERE day_key BETWEEN '20240103' AND '20240124' GROUP BY 1")
def day_prune(spark, sf_dir):
    return C.prune_days(calls(spark, sf_dir), SINCE, UNTIL).groupBy(F.col("day").alias("day_key")).agg(F.count("*").alias("n"))


@_query("list_page", "SELECT request_id, tst AS ts, model, token_name, status FROM latest ORDER BY tst DESC, request_id DESC LIMIT 20 OFFSET 20")
def list_page(spark, sf_dir):
    return listing.page(C.latest(calls(spark, sf_dir)), 2, 20).select(*_LISTED)


@_query("list_total", "SELECT count(*) AS total FROM known WHERE model = 'm3'")
def list_total(spark, sf_dir):
    return listing.total(C.matching(calls(spark, sf_dir), C.CallFilter(model="m3")))


@_query("option_sets", """SELECT DISTINCT 'model' AS kind, model AS value FROM latest WHERE model <> '' UNION SELECT DISTINCT 'token', token_name FROM latest WHERE token_name <> ''
    UNION SELECT DISTINCT 'tool', unnest(tool_names) FROM latest""")
def option_sets(spark, sf_dir):
    return listing.options(C.latest(calls(spark, sf_dir)), tools=True)


@_query("earliest_day", "SELECT min(day_key) AS earliest FROM versions")
def earliest_day(spark, sf_dir):
    return listing.earliest_day(calls(spark, sf_dir))


@_query("day_listing", "SELECT DISTINCT day_key FROM versions")
def day_listing(spark, sf_dir):
    return listing.days(calls(spark, sf_dir)).select(F.col("day").alias("day_key"))


@_query("point_lookup", "SELECT request_id, append_seq, quota FROM latest WHERE request_id = 'r000000018'")
def point_lookup(spark, sf_dir):
    return listing.get_call(calls(spark, sf_dir), "r000000018").select("request_id", "append_seq", "quota")


@_query("channel_labels", "SELECT request_id, COALESCE(NULLIF(c.name, ''), NULLIF(upstream_host, ''), '#' || channel_id) AS label FROM latest l LEFT JOIN chan c ON c.id = l.channel_id")
def channel_labels(spark, sf_dir):
    return listing.with_channels(C.latest(calls(spark, sf_dir)), channels(spark)).select("request_id", listing.channel_label().alias("label"))


@_query("push_order", "SELECT request_id, epoch_s AS epoch FROM latest ORDER BY epoch_s, request_id")
def push_order(spark, sf_dir):
    return listing.push_order(calls(spark, sf_dir)).select("request_id", "epoch")


@_query("outcome_known", "SELECT known AS outcome, count(*) AS n FROM known GROUP BY 1")
def outcome_known(spark, sf_dir):
    return C.latest(calls(spark, sf_dir)).groupBy(scalars.outcome_of(F.col("outcome"), F.col("status")).alias("outcome")).agg(F.count("*").alias("n"))


@_query("host_of", "SELECT page_id, regexp_extract(url, '^[a-z]+://(?:[^/@?#]*@)?([^/?#]*)', 1) AS host FROM pages")
def host_of(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", scalars.host_of(F.col("url")).alias("host"))


def dashboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals and all breakdowns of a range in one row."""
    return stats.dashboard(_cells(spark, sf_dir), SINCE, UNTIL, "day")


def _array(fields: str, source: str, order: str) -> str:
    return f"(SELECT CAST(to_json(list(struct_pack({fields}) ORDER BY {order})) AS VARCHAR) FROM {source})"


def _dashboard_sql() -> str:
    own = ", ".join(f"{m} := {m}" for m in MEASURES)
    sums = ", ".join(f"CAST({'max' if m.endswith('_max') else 'sum'}({m}) AS BIGINT) AS {m}" for m in MEASURES)
    key, step, bucket, label = _AXES["day"]
    ctes, arrays = [], []
    for name, dim, value, top, order in (("by_model", "model", "model_key", 7, "requests DESC"), ("by_channel", "channel", "channel", 10, "requests DESC"), ("by_token", "token", "token_key", 12, "quota DESC, requests DESC")):
        ctes += [f"{name}_g AS (SELECT {value} AS v, {AGGREGATES} FROM timed GROUP BY 1)", f"{name}_r AS (SELECT *, row_number() OVER (ORDER BY {order}, v) AS nth FROM {name}_g)"]
        ctes += [f"{name}_f AS (SELECT CAST(LEAST(nth, {top + 1}) AS INT) AS position, CASE WHEN nth <= {top} THEN v ELSE 'other' END AS name, {sums} FROM {name}_r GROUP BY 1, 2)"]
        arrays.append(f"{_array(f'position := position, {dim} := name, {own}', f'{name}_f', 'position')} AS {name}")
    ctes += [f"axis AS (SELECT {key} AS key FROM generate_series(date_trunc('day', make_timestamp({SINCE}::BIGINT * 1000000)), date_trunc('day', make_timestamp({UNTIL}::BIGINT * 1000000)), {step}) g(t))"]
    ctes += [f"b AS (SELECT {bucket} AS bkey, {AGGREGATES} FROM timed GROUP BY 1)", f"s AS (SELECT key AS bucket, {label} AS label, {_ZEROED} FROM axis LEFT JOIN b ON b.bkey = axis.key)"]
    ctes += ["h AS (SELECT CAST(h AS INT) AS hour, count(hr) AS requests FROM range(24) t(h) LEFT JOIN timed ON hr = h GROUP BY 1)"]
    ctes += ["w AS (SELECT CAST(i // 24 AS INT) AS dow, CAST(i % 24 AS INT) AS hour, count(hr) AS requests FROM range(168) t(i) LEFT JOIN timed ON hr = i % 24 AND isodow(strptime(dkey, '%Y%m%d')) - 1 = i // 24 GROUP BY 1, 2)"]
    arrays.append(f"{_array(f'bucket := bucket, label := label, {own}', 's', 'bucket')} AS series")
    arrays.append(f"{_array('hour := hour, requests := requests', 'h', 'hour')} AS hours")
    arrays.append(f"{_array('dow := dow, hour := hour, requests := requests', 'w', 'dow, hour')} AS dow_hours")
    return f", {', '.join(ctes)}, k AS (SELECT {AGGREGATES} FROM timed) SELECT *, {', '.join(arrays)} FROM k"


@_query("dashboard", _dashboard_sql())
def dashboard_as_text(spark, sf_dir):
    """dashboard() with its arrays as JSON text."""
    row = dashboard(spark, sf_dir)
    return row.select(*[F.to_json(n).alias(n) if t.startswith("array") else F.col(n) for n, t in row.dtypes])
