"""Sharding by a permutation-filled lookup table.

Every shard has its own preference order over a prime number of slots; taking turns, each
shard claims its next free slot until the table is full. Slot counts differ by one at most,
and a change in the shard list moves few keys. The table has a fixed number of rows, so it
is broadcast, and a key is placed by one hash and one lookup.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SHARDS = [f"shard-{i:02d}" for i in range(32)]
SLOTS = 4099
#: Largest table that is broadcast.
MOST_SLOTS = 1 << 20


def _hash60(text: str) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[:15], 16)


def lookup_table(shards: list[str] = SHARDS, slots: int = SLOTS) -> list[int]:
    """For each slot the position of its shard in shards."""
    if not shards or slots < len(shards) or any(slots % d == 0 for d in range(2, int(slots**0.5) + 1)):
        raise ValueError("slots must be a prime of at least the number of shards")
    start = [_hash60(f"{s}:offset") % slots for s in shards]
    skip = [_hash60(f"{s}:skip") % (slots - 1) + 1 for s in shards]
    table, at, filled = [-1] * slots, list(start), 0
    while True:
        for i in range(len(shards)):
            while table[at[i]] >= 0:
                at[i] = (at[i] + skip[i]) % slots
            table[at[i]] = i
            filled += 1
            if filled == slots:
                return table


def place(df: DataFrame, key: str = "doc_id", shards: list[str] = SHARDS, slots: int = SLOTS) -> DataFrame:
    """df with slot (bigint) and shard (string) added; columns of those names, in any case, are replaced.

    Rows with equal keys share a shard. A null key is placed like the empty string; texts are
    not looked at, so null, empty and long ones are placed alike; an empty table stays empty.
    """
    if slots > MOST_SLOTS:
        raise ValueError(f"at most {MOST_SLOTS} slots are broadcast")
    table = df.sparkSession.createDataFrame([(i, shards[k]) for i, k in enumerate(lookup_table(shards, slots))], "slot bigint, shard string")
    slot = F.conv(F.substring(F.md5(F.coalesce(F.col(key).cast("string"), F.lit(""))), 1, 15), 16, 10).cast("bigint") % slots
    keep = [c for c in df.columns if c.lower() not in ("slot", "shard")]
    keyed = df.select(*[F.col(f"`{c}`") for c in keep], slot.alias("slot"))
    return keyed.join(F.broadcast(table), "slot").select(*[F.col(f"`{c}`") for c in keep], "slot", "shard")


def oracle(shards: int = len(SHARDS), slots: int = SLOTS) -> str:
    h = lambda e: f"('0x' || substr(md5({e}), 1, 15))::BIGINT"
    return f"""
WITH RECURSIVE s AS (
  SELECT i, {h("format('shard-{:02d}', i) || ':offset'")} % {slots} AS o, {h("format('shard-{:02d}', i) || ':skip'")} % {slots - 1} + 1 AS k
  FROM range({shards}) t(i)),
fill(step, claimed, slot, shard) AS (
  SELECT 0::BIGINT, list_resize([]::BIGINT[], {slots}, 0), -1::BIGINT, -1::BIGINT
  UNION ALL
  SELECT step + 1, list_concat(list_concat(claimed[1:pick], [1::BIGINT]), claimed[pick + 2:]), pick, i
  FROM (SELECT f.step, f.claimed, s.i,
               (s.o + s.k * list_first(list_filter(range({slots}), lambda j: f.claimed[(s.o + s.k * j) % {slots} + 1] = 0))) % {slots} AS pick
        FROM fill f JOIN s ON s.i = f.step % {shards} WHERE f.step < {slots}))
SELECT d.doc_id, fill.slot, format('shard-{{:02d}}', fill.shard) AS shard
FROM documents d JOIN fill ON fill.slot = {h("d.doc_id::VARCHAR")} % {slots}"""
