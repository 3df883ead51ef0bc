"""Mixing sources to target weights by Poisson replication.

Each document gets its own uniform number from a seeded hash of its id; inverting the
Poisson distribution whose mean is the source's repetition rate turns it into a copy
count, so the expected share of every source meets its target without any coordination
between documents. A high rate is split into equal parts, each with a number of its own: their
counts add up to a Poisson count of the whole. The copies are then ordered by a hash and
dealt out by it.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Target weights by source; a source that is not listed shares OTHER with the rest.
WEIGHTS = {"src0": 2.0, "src1": 3.0, "src2": 3.0, "src3": 2.0, "src4": 1.0}
OTHER = 9.0
SEED = 17
REST = "*"
#: Highest rate that is inverted at once.
MOST_RATE = 16.0
#: Columns that the mix adds.
ADDED = ("rate", "copy", "shuffle_key")


def _hash60(*parts: Column) -> Column:
    """First 15 hex digits of the md5 of the parts joined by colons, as a number below 2**60."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])), 1, 15), 16, 10).cast("bigint")


def thresholds(rate: float) -> list[float]:
    """Cumulative Poisson probabilities, as far as they differ: a document has as many copies as entries that are at most its number."""
    if rate <= 0:
        return [2.0]
    out, total, k = [], 0.0, 0
    while True:
        term = math.exp(-rate + k * math.log(rate) - math.lgamma(k + 1))
        total += term
        out.append(total)
        k += 1
        if k > rate and term < 2.0**-62:
            return out


def poisson_mix(docs: DataFrame, weights: dict[str, float] = WEIGHTS, other: float = OTHER, epochs: float = 1.0, seed: int = SEED) -> DataFrame:
    """docs replicated so that the expected share of each source is its weight, in random order.

    weights: by source; other: for all remaining sources and null together. Weights of sources
    that the table lacks don't count. epochs: expected rows out per row in. Adds rate (double),
    copy (int, from 1) and shuffle_key (bigint); columns of these names are replaced, all others
    are kept as they are (names beginning with two underscores are ours). A document whose count
    is 0 is absent. Null and empty texts count like any other; a null doc_id hashes as the empty
    string; rows that repeat an id get the same count each; an empty table gives an empty table.
    Only len(weights) + 1 counts reach the driver, and a table of as many rows is broadcast.
    """
    spark = docs.sparkSession
    group = F.when(F.col("source").isin(list(weights)), F.col("source")).otherwise(F.lit(REST))
    sizes = {r[0]: r[1] for r in docs.groupBy(group.alias("g")).count().collect()}
    weight = {g: weights.get(g, other) for g in sizes}
    whole = sum(sorted(weight.values())) or 1.0
    rates = {g: weight[g] / whole * (sum(sizes.values()) * epochs) / n for g, n in sizes.items()}
    plans = []
    for g, r in rates.items():
        parts = max(1, math.ceil(r / MOST_RATE))
        plans.append((g, round(r, 6), parts, thresholds(r / parts)))
    plan = spark.createDataFrame(plans, "__g string, rate double, __parts int, __cdf array<double>")
    keep = [c for c in docs.columns if c.lower() not in ADDED]
    drawn = docs.select(*keep, group.alias("__g")).join(F.broadcast(plan), "__g")
    below = lambda u: F.size(F.filter("__cdf", lambda t: t <= u / F.lit(float(1 << 60))))
    first = below(_hash60(F.lit(seed), F.col("doc_id")))
    further = F.aggregate(F.sequence(F.lit(1), F.col("__parts") - 1), F.lit(0), lambda a, k: a + below(_hash60(F.lit(seed), F.col("doc_id"), k)))
    count = F.when(F.col("__parts") == 1, first).otherwise(first + further)
    drawn = drawn.withColumn("__n", count).where("__n > 0")
    spread = drawn.select(*keep, "rate", F.explode(F.sequence(F.lit(1), F.col("__n"))).alias("copy"))
    spread = spread.withColumn("shuffle_key", _hash60(F.lit(f"{seed}s"), F.col("doc_id"), F.col("copy")))
    return spread.repartition("shuffle_key").sortWithinPartitions("shuffle_key", "doc_id", "copy")


def oracle(weights: dict[str, float] = WEIGHTS, other: float = OTHER, seed: int = SEED) -> str:
    cases = " ".join(f"WHEN '{s}' THEN {w!r}::DOUBLE" for s, w in weights.items())
    names = ", ".join(f"'{s}'" for s in weights)
    hashed = lambda e: f"('0x' || substr(md5({e}), 1, 15))::BIGINT"
    return f"""
WITH g AS (SELECT *, CASE WHEN source IN ({names}) THEN source ELSE '*' END AS grp FROM documents),
w AS (SELECT grp, count(*) AS n, CASE grp {cases} ELSE {other!r}::DOUBLE END AS weight FROM g GROUP BY grp),
r AS (SELECT grp, weight / (SELECT sum(weight ORDER BY weight) FROM w) * (SELECT sum(n) FROM w)::DOUBLE / n AS r FROM w),
p AS (SELECT grp, r, greatest(1, ceil(r / {MOST_RATE!r}))::INT AS parts FROM r),
t AS (SELECT grp, r, parts, list_transform(range(0, (r / parts + 12 * sqrt(r / parts) + 41)::INT), lambda k: list_sum(list_transform(range(0, k + 1),
             lambda i: exp(-r / parts + i * ln(r / parts) - lgamma(i + 1))))) AS cdf FROM p),
n AS (SELECT g.*, round(t.r, 6) AS rate, list_sum(list_transform(range(0, t.parts), lambda j: len(list_filter(t.cdf,
             lambda x: x <= {hashed(f"'{seed}:' || g.doc_id || CASE WHEN j > 0 THEN ':' || j ELSE '' END")} / 1152921504606846976.0)))) AS n
      FROM g JOIN t USING (grp)),
e AS (SELECT doc_id, text, lang, source, n_chars, rate, unnest(range(1, n::BIGINT + 1))::INT AS copy FROM n)
SELECT *, {hashed(f"'{seed}s:' || doc_id || ':' || copy")} AS shuffle_key FROM e"""
