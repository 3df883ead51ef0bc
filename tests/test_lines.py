"""Line classification: what is kept of each kind of line, and how often a line's texts are looked at."""

import pytest
from pyspark.sql import functions as F
from tests.helpers import rid

from logloom.operators.fold import with_chunks
from logloom.operators.lines import classify
from logloom.plans.sample_calls import dealt_events

A = rid("Aa")
AT = "2026/02/03 - 10:00:01"
LINES = {
    f"[DEBUG] {AT} | {A} | plain | with bars | x": ("DEBUG", "other", "plain | with bars | x", None),
    f"[DEBUG]\t{AT}  |  {A}\t|   requestBody:   {{}} ": ("DEBUG", "request", "requestBody:   {} ", "{}"),
    f"[DEBUG] {AT} | {A} | two\nlines | ": ("DEBUG", "other", "two\nlines | ", None),
    f"[DEBUG] {AT} | {A} | ": ("DEBUG", "other", "", None),
    f"[INFO] {AT} | {A} | record consume log: x, params= {{}}": ("INFO", "billing", "record consume log: x, params= {}", "{}"),
    f"[INFO] {AT} | {A} | record consume log: x": ("INFO", "billing", "record consume log: x", None),
    f"[ERR] {AT} | {A} | x": ("ERR", "error", "x", None),
    f"[GIN] {AT} | relay | {A} | 200 | 1s | ip | POST /v1": ("GIN", "access", f"relay | {A} | 200 | 1s | ip | POST /v1", None),
    f"[GIN] {AT} | {A} | odd": ("GIN", "other", "odd", None),
    f"[GIN] {AT} | relay | {A} | 2000 | 1s | ip | POST /v1": None,
    f"[DEBUG] {AT} | relay | {A} | 200 | 1s | ip | POST /v1": None,
    f"[DEBUG] {AT} | {A[:23]} | x": None,
    f"[DEBUG] {AT} |{A} | x": None,
    f"[DEBUG] {AT} | {A} |x": None,
    f"[DEBUG] {AT} | {A}": None,
    f" [DEBUG] {AT} | {A} | x": None,
    f"[DEBUG] {AT} | SYSTEM | x": None,
}


def test_lines_are_cut_at_bars(spark):
    rows = [(line, "f", i) for i, line in enumerate(LINES)]
    got = {r["ord"]: r for r in classify(spark.createDataFrame(rows, "value string, file string, ord int")).collect()}
    for i, (line, want) in enumerate(LINES.items()):
        assert (i in got) == (want is not None), line
        if want:
            r = got[i]
            assert (r["level"], r["kind"], r["msg"], r["body"]) == want and r["rid"] == A and r["ts"] == "2026/02/03 10:00:01"
            assert (r["status"], r["path"]) == ((200, "/v1") if want[1] == "access" else (None, None))


def planned(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("kind", ["classify", "chunks"])
def test_a_line_is_parsed_once(spark, kind):
    """One pattern over the whole line, and one parse of a chunk into its fields and of a block's delta."""
    entries = spark.createDataFrame([(f"[DEBUG] {AT} | {A} | x", "f", 1)], "value string, file string, ord int").repartition(2)
    events = classify(entries)
    assert planned(events).count("regexp_extract(value") == 0 and planned(events).count("RLIKE(value") == 1
    if kind == "chunks":
        plan = planned(with_chunks(events))
        assert plan.count("from_json(") == 2 and plan.count('from_json(StructField(value') == 1 and plan.count("regexp_extract(body") == 0


def test_events_are_dealt_over_all_cores(spark, tmp_path):
    spark.range(50).select(F.col("id").alias("event_id")).coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    rows = dealt_events(spark, str(tmp_path))
    assert rows.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism and rows.count() == 50
