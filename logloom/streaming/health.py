"""What a running fold reports about itself."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

#: Seconds a batch may take, on average over those kept, before the fold counts as behind.
SLOW_BATCH = 60.0


def health(query: StreamingQuery, slow_batch: float = SLOW_BATCH, folder: str | None = None, waiting: DataFrame | None = None) -> dict:
    """Counts of the recent batches and the reasons, if any, for which the fold is degraded.

    pending: requests held in state; pending_bytes: what state takes; entries: log entries
    read; appends: batches that let calls go; rate: entries a second; batches: batches kept in the report;
    degraded: failed, stopped, slow. With a folder also spool_bytes, the size of its log files, and
    with calls that wait to be sent also backlog, their number.
    """
    seen = query.recentProgress
    last = seen[-1] if seen else None
    took = [p["batchDuration"] / 1000 for p in seen]
    degraded = []
    if query.exception() is not None:
        degraded.append("failed")
    elif not query.isActive:
        degraded.append("stopped")
    if took and sum(took) / len(took) > slow_batch:
        degraded.append("slow")
    states = last["stateOperators"] if last else []
    out = {
        "pending": sum(s["numRowsTotal"] for s in states),
        "pending_bytes": sum(s["memoryUsedBytes"] for s in states),
        "entries": sum(p["numInputRows"] for p in seen),
        "appends": sum(any(s["numRowsRemoved"] or s["numRowsUpdated"] for s in p["stateOperators"]) for p in seen),
        "rate": last["processedRowsPerSecond"] if last else 0.0,
        "batches": len(seen),
        "degraded": degraded,
    }
    if folder is not None:
        from logloom.sources.tail import log_files

        out["spool_bytes"] = sum(f.size for f in log_files(folder))
    if waiting is not None:
        out["backlog"] = waiting.agg(F.count("*")).first()[0]
    return out
