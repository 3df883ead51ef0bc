"""The corpus pipeline, stage by stage and as a whole."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from logloom.llm import mixing, pii, scan, simhash, tokens
from tests.llm.conftest import SF, prose
from tests.llm.test_exact import Forest

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text, k=5):
    w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def jaccard(a, b):
    return 1.0 if a == b else len(a & b) / len(a | b)


def edited(rng, text, n):
    w = text.split()
    for i in rng.sample(range(len(w)), n):
        w[i] = f"new{rng.randrange(10**6)}"
    return " ".join(w)


@pytest.fixture(scope="module")
def copies():
    """Texts with near copies of every degree, and texts that share a passage only."""
    rng = random.Random(8)
    texts = []
    for _ in range(60):
        base = prose(rng, rng.choice([40, 90, 250, 700]), [f"w{i}" for i in range(900)])
        n = len(base.split())
        texts += [base, base, base.upper(), edited(rng, base, max(1, n // 80)), edited(rng, base, max(1, n // 50)), edited(rng, base, max(1, n // 44)), edited(rng, base, n // 10)]
    passage = prose(rng, 50, [f"p{i}" for i in range(400)])
    texts += [f"{prose(rng, 120, [f'q{i}' for i in range(900)])} {passage}" for _ in range(40)]
    order = list(range(len(texts)))
    rng.shuffle(order)
    return [texts[i] for i in order]


@pytest.mark.parametrize("alike", [2000, 20])
def test_near_groups_against_all_pairs(spark, copies, monkeypatch, alike):
    """Recall of all pairs from 0.8 on, also where a shared passage makes subsets crowded; no link below."""
    monkeypatch.setattr(simhash, "ALIKE", alike)
    df = spark.createDataFrame(list(enumerate(copies)), "doc_id bigint, text string").repartition(5)
    got = {r.doc_id: r.component_id for r in simhash.similar_groups(df).collect()}
    sets = [shingles(t) for t in copies]
    found = wanted = 0
    joined = Forest(len(copies))
    for i in range(len(copies)):
        for j in range(i):
            s = jaccard(sets[i], sets[j])
            if s >= 0.8:
                wanted += 1
                found += got[i] == got[j]
                joined.join(i, j)
            if sets[i] == sets[j]:
                assert got[i] == got[j]
    print(f'{found} of {wanted} pairs found')
    assert wanted > 500 and found / wanted > 0.97
    # no group reaches beyond what links of similar texts reach
    assert all(joined.root(i) == joined.root(c) for i, c in got.items())
    assert all(got[c] == c for c in got.values())


@pytest.mark.parametrize(("few", "alike", "rate"), [(32, 2000, 16), (1, 5, 1), (1, 5, 1 << 40)])
def test_near_groups_lose_no_link(spark, copies, monkeypatch, few, alike, rate):
    """Exactly the groups of all pairs from 0.8 on, also where all shingles count as crowded, in parts, and none as common."""
    for name, value in (("FEW", few), ("ALIKE", alike), ("COMMON_RATE", rate)):
        monkeypatch.setattr(simhash, name, value, raising=False)
    rng = random.Random(5)
    texts = list(copies)
    for _ in range(700):
        base = prose(rng, 100, [f"b{i}" for i in range(5000)]).split()
        near = list(base)
        near[30], near[70] = "one", "other"
        texts += [" ".join(base), " ".join(near)]
    # one frame, other words in it: similar to it, hardly to each other
    frame = prose(rng, 60, [f"f{i}" for i in range(900)]).split()
    texts += [" ".join([*frame, *(f"own{k}" for k in rng.sample(range(10**6), rng.randrange(2, 16)))]) for _ in range(60)]
    sets, having = [shingles(t) for t in texts], {}
    for i, own in enumerate(sets):
        for g in own:
            having.setdefault(g, []).append(i)
    meet = {(i, j) for rows in having.values() for i in rows for j in rows if i < j}
    joined = Forest(len(texts))
    for i, j in meet:
        if jaccard(sets[i], sets[j]) >= 0.8:
            joined.join(i, j)
    least = {}
    for i in range(len(texts)):
        least.setdefault(joined.root(i), i)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(5)
    got = {r.doc_id: r.component_id for r in simhash.similar_groups(df).collect()}
    assert got == {i: least[joined.root(i)] for i in range(len(texts))}


def test_one_of_each_group_stays(odd, odd_rows, empty):
    kept = simhash.keep_one(odd).collect()
    groups = {r.doc_id: r.component_id for r in simhash.similar_groups(odd).collect()}
    ids = [r.doc_id for r in kept if r.doc_id is not None]
    assert sorted(ids) == sorted({c for c in groups.values()})
    assert sum(r.doc_id is None for r in kept) == sum(i is None for i, _ in odd_rows)
    assert simhash.keep_one(empty).count() == 0 and kept[0].asDict().keys() == set(odd.columns)


def test_stages(spark):
    """run() is the stages one after the other; what each lets through is checked against what it was given."""
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "personal_data", "mixing", "packing"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    at, seen = docs, {"documents": docs.collect()}
    for name, stage in corpus_pipeline.STAGES:
        at = stage(spark, at, SF)
        seen[name] = at.collect()
        if name != "packing":
            assert at.columns == docs.columns
            at = spark.createDataFrame(seen[name], docs.schema)
    text = {r.doc_id: r.text for r in seen["documents"]}
    ids = {n: [r.doc_id for r in rows] for n, rows in seen.items()}
    # quality: some go, none changes
    assert 0.5 * len(text) < len(ids["quality"]) < len(text) and all(text[r.doc_id] == r.text for r in seen["quality"])
    # near duplicates: what is left has no similar pair, and what went has one
    sets = {i: shingles(text[i]) for i in ids["quality"]}
    left = set(ids["near_duplicates"])
    assert len(left) == len(ids["near_duplicates"])
    for i in left:
        assert not any(j < i and jaccard(sets[i], sets[j]) >= 0.85 for j in left)
    for i in set(ids["quality"]) - left:
        assert any(j != i and jaccard(sets[i], sets[j]) > 0.6 for j in ids["quality"])
    # personal data: nothing goes, no pattern is left
    assert sorted(ids["personal_data"]) == sorted(left)
    again = pii.report(pii.find(spark.createDataFrame(seen["personal_data"], docs.schema))).collect()
    assert all(r.n_email + r.n_ip + r.n_card + r.n_phone == 0 for r in again)
    assert all(r.n_chars == len(r.text) for r in seen["personal_data"])
    # mixing: as many copies as drawn
    sizes = Counter(r.source if r.source in mixing.WEIGHTS else None for r in seen["personal_data"])
    whole = sum(mixing.WEIGHTS.values()) + mixing.OTHER
    for source, n in sizes.items():
        mean = (mixing.WEIGHTS[source] if source else mixing.OTHER) / whole * len(left)
        drawn = sum((r.source if r.source in mixing.WEIGHTS else None) == source for r in seen["mixing"])
        assert abs(drawn - mean) < 5 * math.sqrt(max(mean * max(1, mean / n), 1))
    # packing: every token of every copy has its place
    tokenizer = tokens.word_tokenizer()
    want = sum(len(tokenizer.encode(r.text, add_special_tokens=False).ids) + 1 for r in seen["mixing"])
    assert sum(r.length for r in seen["packing"]) == want
    fill = {}
    for r in sorted(seen["packing"], key=lambda r: r.offset):
        assert fill.get(r.sequence_id, 0) == r.offset
        fill[r.sequence_id] = r.offset + r.length
    assert len(fill) <= math.ceil(want / 4096) * 1.05 + 2
    assert Counter(map(tuple, seen["packing"])).keys() and corpus_pipeline.run(spark, SF).count() == len(seen["packing"])


def test_odd_and_empty_tables(spark, odd, empty):
    for docs in (odd, empty):
        at = docs
        for name, stage in corpus_pipeline.STAGES:
            at = stage(spark, at, SF)
            if name != "packing":
                assert at.columns == docs.columns
                own = {(r.score, r.copy) for r in at.select("score", "copy").distinct().collect()}
                assert own <= {("mine", -1.0)}
        assert (at.count() > 0) == (docs is odd)


def test_near_groups_write_few_small_files(spark, copies, monkeypatch):
    """Checkpoints of few rows have about as many parts as there are cores, whatever the number of shuffle partitions."""
    parts, own = [], type(spark.range(1)).checkpoint

    def counted(df, *args):
        out = own(df, *args)
        parts.append(out.rdd.getNumPartitions())
        return out

    monkeypatch.setattr(type(spark.range(1)), "checkpoint", counted)
    df = spark.createDataFrame(list(enumerate(copies[:150])), "doc_id bigint, text string").repartition(30)
    options = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in options}
    try:
        for k, v in options.items():
            spark.conf.set(k, v)
        simhash.similar_groups(df).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert len(parts) > 8 and sum(n > spark.sparkContext.defaultParallelism for n in parts) <= 1


def test_unlike_texts_with_a_common_line_make_no_pairs(spark, monkeypatch):
    """The second comparison is given no pairs that the bins rule out."""
    rng, given, own = random.Random(14), [], simhash._told

    def counted(pairs, *args):
        given.append(pairs.count())
        return own(pairs, *args)

    monkeypatch.setattr(simhash, "_told", counted)
    monkeypatch.setattr(simhash, "_common", lambda *_: (np.zeros(0, np.uint64), np.zeros(0, np.int64)))
    line = prose(rng, 34, [f"p{i}" for i in range(400)])
    texts = [f"{line} {prose(rng, 6, [f'q{i}' for i in range(900)])}" for _ in range(120)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3)
    assert all(r.doc_id == r.component_id for r in simhash.similar_groups(df).collect())
    assert len(given) == 2 and given[1] < 120


def test_workers_give_memory_back():
    """When a task's batches end, what its step had allocated isn't kept for the next."""

    def held():
        return sum(int(x) for x in re.findall(r"Rss:\s+(\d+)", open("/proc/self/smaps_rollup").read())) / 1024

    peak, pins = [], []

    def run(batches):
        for batch in batches:
            rows = [np.ones(4000) for _ in range(5000)]
            pins.append(rows[-1])
            peak.append(held())
            del rows
            yield batch

    assert list(scan.freeing(run)(iter([1, 2]))) == [1, 2] and len(pins) == 2
    assert held() < max(peak) - 100


def test_majority_bits():
    rng = np.random.default_rng(9)
    h, edge = rng.integers(0, 1 << 63, 50, dtype=np.uint64), np.array([0, 1, 2, 9, 50])
    got = simhash.majority(h, edge, 2)
    for i in range(4):
        own = h[edge[i] : edge[i + 1]]
        for k in range(2):
            m = [int(x) for x in simhash.mix(own + np.uint64(k + 1))]
            assert int(got[i, k]) == sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in m) > len(m))
