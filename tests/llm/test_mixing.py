"""Poisson replication against counts drawn by hand, and the queries that SQL can express against it."""

import hashlib
import math
from collections import Counter

import duckdb
import pytest

from logloom.llm import mixing, queries
from tests.llm.conftest import SF


def sixty(text):
    return int(hashlib.md5(text.encode()).hexdigest()[:15], 16)


def drawn(doc_id, rate, seed):
    """Copies of a document: the Poisson distribution with mean rate, inverted at the document's number; high rates in equal parts."""
    parts, own, out = max(1, math.ceil(rate / 16)), "" if doc_id is None else doc_id, 0
    for j in range(parts):
        u, k, p = sixty(f"{seed}:{own}:{j}" if j else f"{seed}:{own}") / 2**60, 0, math.exp(-rate / parts)
        total = p
        while total <= u:
            k += 1
            p *= rate / parts / k
            total += p
        out += k
    return out


def test_copies(odd):
    weights, other, seed = {"src0": 3.0, "src7": 1.0, "absent": 50.0}, 2.0, 5
    got = mixing.poisson_mix(odd, weights, other, 1.5, seed).collect()
    rows = odd.collect()
    sizes = Counter(r.source if r.source in weights else None for r in rows)
    rate = {g: (weights[g] if g else other) / 6 * len(rows) * 1.5 / n for g, n in sizes.items()}
    want = Counter()
    for r in rows:
        for k in range(drawn(r.doc_id, rate[r.source if r.source in weights else None], seed)):
            want[r.doc_id, r.text, k + 1] += 1
    assert Counter((r.doc_id, r.text, r.copy) for r in got) == want
    own = {(r.doc_id, r.text, r._n) for r in rows}
    assert all(r.score == "mine" and (r.doc_id, r.text, r._n) in own for r in got)
    keys = [sixty(f"{seed}s:{'' if r.doc_id is None else r.doc_id}:{r.copy}") for r in got]
    assert [r.shuffle_key for r in got] == keys


def test_shares_meet_their_targets(spark):
    docs = spark.range(20_000).selectExpr("id as doc_id", "case when id % 3 = 0 then 'a' when id % 50 = 1 then 'b' else 'c' end as source")
    got = Counter(r.source for r in mixing.poisson_mix(docs, {"a": 1.0, "b": 1.0}, 2.0, 1.0, 9).select("source").collect())
    total = sum(got.values())
    assert abs(total - 20_000) < 600
    for source, share in (("a", 0.25), ("b", 0.25), ("c", 0.5)):
        assert abs(got[source] / total - share) < 0.03


def test_a_rare_source_is_split(spark):
    docs = spark.range(4000).selectExpr("id as doc_id", "case when id = 7 then 'rare' else 'c' end as source")
    got = Counter(r.source for r in mixing.poisson_mix(docs, {"rare": 1.0}, 1.0, 1.0, 3).select("source").collect())
    assert got["rare"] == drawn(7, 2000.0, 3) and abs(got["rare"] - 2000) < 250 and abs(got["c"] - 2000) < 250
    assert len(mixing.thresholds(16.0)) < 120


def test_absent_sources_take_no_share(spark):
    docs = spark.range(20_000).selectExpr("id as doc_id", "'a' as source")
    assert abs(mixing.poisson_mix(docs, {"a": 1.0, "b": 5.0}, 3.0, 1.0, 4).count() - 20_000) < 600


def test_no_rows_and_lone_sources(spark, empty):
    assert mixing.poisson_mix(empty).count() == 0
    lone = spark.createDataFrame([(1, None, None)], "doc_id bigint, text string, source string")
    assert mixing.poisson_mix(lone, {"x": 1.0}, 0.0).count() == 0


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = con.sql(queries.ORACLES[name]).to_arrow_table()
    got = queries.QUERIES[name](spark, SF).toArrow()
    columns = sorted(want.column_names)
    assert sorted(got.column_names) == columns
    flat = lambda t: Counter(zip(*[t[c].to_pylist() for c in columns], strict=True))
    assert flat(got) == flat(want)
