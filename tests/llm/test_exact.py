"""Operators with one right answer, against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash

from logloom.llm import components, digest, fmindex, packing, pii, queries, rules, sharding, simhash, substrings, tokens
from tests.llm.conftest import SF, prose

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LAST = 2**63 - 1


def brute_dedup(rows):
    docs = [(LAST if i is None else i, WORD.findall(t or "")) for i, t in rows]
    first = {}
    for i, w in docs:
        for s in range(len(w) - 19):
            k = tuple(w[s : s + 20])
            first[k] = min(first.get(k, (i, s)), (i, s))
    out = []
    for i, w in docs:
        gone = [False] * len(w)
        for s in range(len(w) - 19):
            if first[tuple(w[s : s + 20])] < (i, s):
                gone[s : s + 20] = [True] * 20
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((i, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("common", [2, 10**9])
def test_substrings(odd, odd_rows, empty, monkeypatch, common):
    monkeypatch.setattr(substrings, "SAMPLE", 2)
    monkeypatch.setattr(substrings, "COMMON", common)
    got = substrings.dedup(odd, with_text=True).collect()
    assert sorted((LAST if r.doc_id is None else r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got) == brute_dedup(odd_rows)
    assert all(hashlib.sha256(r.kept_text.encode()).hexdigest() == r.kept_sha256 for r in got)
    assert substrings.dedup(empty).count() == 0


def test_substrings_in_many_indexes(spark, monkeypatch):
    """Few different windows in many combinations, more than one index holds; every report comes out of a search."""
    rng = random.Random(12)
    parts = [prose(rng, 12, [f"w{i}" for i in range(50)]) for _ in range(6)]
    rows = [(i, " ".join(rng.choice(parts) for _ in range(rng.randrange(1, 9)))) for i in range(150)]
    rows += [(None, rows[3][1]), (None, rows[4][1]), (None, f"{rows[4][1]} {rows[3][1]}"), (7, rows[7][1])]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    found = []
    for shard in (4, 1 << 15):
        monkeypatch.setattr(substrings, "SHARD", shard)
        found.append(sorted((LAST if r.doc_id is None else r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in substrings.dedup(df).collect()))
    low = [r for r in brute_dedup(rows) if r[0] != LAST]
    assert found[0] == found[1] and [r for r in found[0] if r[0] != LAST] == low
    assert all(r[2] > 0.8 * r[1] for r in found[0] if r[0] == LAST)


def test_words_that_look_alike_to_a_weak_hash(spark, twins):
    """Long words that a polynomial hash takes for equal are different words, lines and tokens."""
    lead = " ".join(f"w{i}" for i in range(19))
    rows = [(i, f"{lead} {x}") for i, x in enumerate(twins)] + [(2, f"{twins[0]}\n{twins[1]}\n{twins[0]}")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(1)
    assert [r.n_removed for r in substrings.dedup(df).orderBy("doc_id").collect()] == [0, 0, 0]
    assert [r.n_dup_lines for r in rules.apply_rules(df, None).orderBy("doc_id").collect()] == [0, 0, 1]
    tokenizer = tokens.word_tokenizer()
    got = {r.doc_id: r.ids for r in packing.pieces(df, keep_ids=True).collect()}
    assert got == {i: [*tokenizer.encode(t, add_special_tokens=False).ids, 1] for i, t in rows}


def test_fm_index():
    """Backward search of a streamed text against all substrings of the indexed one."""
    rng = np.random.default_rng(3)
    text = np.concatenate(([0], rng.zipf(1.5, 400) % 5 + 1, [0], rng.integers(1, 4, 300), [0]))
    index, raw = fmindex.FMIndex(text, 8), text.tolist()
    streams = [text, np.concatenate((text[40:60], rng.integers(1, 9, 200), text[10:30]))]
    for stream, others in zip(streams, (1, 0), strict=True):
        ends = np.arange(8, len(stream) + 1)
        reached, lo, hi = index.matches(stream, ends, others)
        for e, r, a, b in zip(ends.tolist(), reached.tolist(), lo.tolist(), hi.tolist(), strict=True):
            want = places = 0
            for k in range(1, 9):
                p = stream[e - k : e].tolist()
                at = [i for i in range(len(raw) - k + 1) if raw[i : i + k] == p]
                if 0 in p or len(at) <= others:
                    break
                want, places = k, at
            assert r == want
            if r:
                assert b - a == len(places)
            if r == 8:
                assert index.earliest(np.array([a])).tolist() == [places[0]]


def test_whole_patterns_begin_at_long_runs(monkeypatch):
    """Patterns of full reach are found as by the search number by number, in a few steps of it."""
    rng = np.random.default_rng(4)
    text = np.concatenate(([0], rng.zipf(1.5, 400) % 5 + 1, [0], np.tile(rng.integers(1, 4, 60), 3), [0]))
    stream = np.concatenate((text[300:], rng.integers(0, 9, 100), text[5:60], text[420:500]))
    steps, own = [], fmindex.WaveletTree.rank
    monkeypatch.setattr(fmindex.WaveletTree, "rank", lambda tree, c, i: steps.append(len(c)) or own(tree, c, i))
    for reach in (1, 2, 3, 8, 20):
        index, ends = fmindex.FMIndex(text, reach), np.arange(reach, len(stream) + 1)
        for others in (0, 1):
            reached, lo, _ = index.matches(stream, ends, others)
            steps.clear()
            full, at = index.whole(stream, ends, others)
            assert len(steps) <= max(1, reach // 2) and (reach < 20 or len(steps) <= 4)
            assert full.tolist() == np.flatnonzero(reached == reach).tolist() and len(full)
            assert at.tolist() == lo[full].tolist()


def test_index_is_compressed():
    """Of a skewed text that repeats, the index takes less than half of plain numbers and suffixes."""
    rng = np.random.default_rng(8)
    text = np.tile(rng.zipf(1.4, 5000) % 3000 + 1, 40)
    assert fmindex.FMIndex(text, 20).nbytes() * 8 < 0.5 * len(text) * (12 + 18)


def brute_print(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = WORD.findall(text)
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]).encode(), seed=42) for i in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


class Forest:
    """Union-find over 0..n-1, the smallest first."""

    def __init__(self, n):
        self.up = list(range(n))

    def root(self, i):
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, a, b):
        a, b = self.root(a), self.root(b)
        self.up[max(a, b)] = min(a, b)


def reachable(prints, radius):
    f = np.array(prints, np.uint64)
    joined = Forest(len(f))
    for i in range(len(f)):
        for j in np.flatnonzero(np.bitwise_count(f ^ f[i]) <= radius).tolist():
            joined.join(i, j)
    return [joined.root(i) for i in range(len(f))]


def test_simhash(odd, odd_rows, empty):
    got = simhash.near_groups(odd).collect()
    prints = [brute_print(t) for _, t in odd_rows]
    roots = reachable(prints, 2)
    low = {}
    for (i, _), r in zip(odd_rows, roots, strict=True):
        if i is not None:
            low[r] = min(low.get(r, i), i)
    key = lambda x: (LAST if x[0] is None else x[0], *x[1:])
    want = [(i, f"{p:016x}", low.get(r)) for (i, _), p, r in zip(odd_rows, prints, roots, strict=True)]
    assert Counter(map(key, want)) == Counter(key((r.doc_id, r.fingerprint, r.component_id)) for r in got)
    assert simhash.near_groups(empty).count() == 0


@pytest.mark.parametrize(("parts", "radius"), [(1, 2), (25, 2), (140, 1), (25, 0)])
def test_links_of_random_fingerprints(spark, monkeypatch, parts, radius):
    monkeypatch.setattr(simhash, "LEAST_PARTS", parts)
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 64, 60, dtype=np.uint64)
    x = base[rng.integers(0, 60, 900)]
    for _ in range(3):
        x = x ^ (np.uint64(1) << rng.integers(0, 64, 900).astype(np.uint64))
    x = np.unique(np.concatenate((x, [np.uint64(0), ~np.uint64(0)])))
    df = spark.createDataFrame([(i, int(v)) for i, v in enumerate(x.view(np.int64).tolist())], "node bigint, fp bigint").repartition(3)
    joined = Forest(len(x))
    for r in simhash.links(df, radius).collect():
        joined.join(r.a, r.b)
    assert [joined.root(i) for i in range(len(x))] == reachable(x, radius)


def test_index_drops_groups():
    """The search finds every pair, and looks at few of them: whole groups go at their upper nodes."""
    rng = np.random.default_rng(15)
    x = rng.integers(0, 1 << 64, 20_000, dtype=np.uint64)
    x[::10] = x[1::10] ^ (np.uint64(1) << rng.integers(0, 64, 2000).astype(np.uint64)) ^ np.uint64(1)
    x = x[np.argsort(simhash.gray_rank(x), kind="stable")]
    index = simhash.Index(x)
    q = x[rng.permutation(len(x))[:500]]
    a, b = index.search(q, 2)
    got = set(zip(a.tolist(), b.tolist(), strict=True))
    assert len(got) == len(a) and got == {(i, j) for i, v in enumerate(q) for j in np.flatnonzero(np.bitwise_count(x ^ v) <= 2).tolist()}
    assert index.visits < 0.1 * len(q) * len(x)


def test_upper_nodes_hold_what_all_below_share():
    rng = np.random.default_rng(16)
    x = np.sort(rng.integers(0, 1 << 20, 300, dtype=np.uint64))
    parts = np.array_split(x, 37)
    every, some = (np.array([f.reduce(p) for p in parts], np.uint64) for f in (np.bitwise_and, np.bitwise_or))
    a, b = simhash.Index(every, ~(every ^ some)).search(x, 2)
    sent = set(zip(a.tolist(), b.tolist(), strict=True))
    for i, v in enumerate(x):
        for k, p in enumerate(parts):
            assert (i, k) in sent or not (np.bitwise_count(p ^ v) <= 2).any()


def test_joined_members():
    rng = np.random.default_rng(17)
    for n, m in ((1, 0), (50, 30), (400, 380)):
        a, b = rng.integers(0, n, m), rng.integers(0, n, m)
        forest = Forest(n)
        for i, j in zip(a.tolist(), b.tolist(), strict=True):
            forest.join(i, j)
        up = simhash.joined(np.arange(n), a[: m // 2], b[: m // 2])
        assert simhash.joined(up, a, b).tolist() == [forest.root(i) for i in range(n)]


def test_spanning_forests():
    """As many links as a forest of all pairs has, of the same lengths, each within the limit."""
    rng = np.random.default_rng(6)
    base = rng.integers(0, 1 << 63, (5, simhash.WIDE), dtype=np.uint64)
    x = base[rng.integers(0, 5, 120)]
    for _ in range(40):
        x[np.arange(120), rng.integers(0, simhash.WIDE, 120)] ^= np.uint64(1) << rng.integers(0, 64, 120).astype(np.uint64)
    far = np.bitwise_count(x[:, None] ^ x[None]).sum(2)
    for limit in (0, 30, 60, 70, 80, 512):
        forest, want = Forest(120), []
        for d, i, j in sorted((int(far[i, j]), i, j) for i in range(120) for j in range(i)):
            if d <= limit and forest.root(i) != forest.root(j):
                forest.join(i, j)
                want.append(d)
        a, b = simhash.spanning(x, limit)
        assert sorted(far[a, b].tolist()) == want
        own = Forest(120)
        for i, j in zip(a.tolist(), b.tolist(), strict=True):
            own.join(i, j)
        assert [own.root(i) for i in range(120)] == [forest.root(i) for i in range(120)]
    assert all(not len(v) for v in simhash.spanning(x[:1], 512))


def test_similarity_of_sets():
    rng = random.Random(18)
    texts = [prose(rng, rng.randrange(0, 60)) for _ in range(30)] + ["", " ", "A b", "a B"]
    other = [" ".join(t.split()[1:]) if i % 3 else t.upper() for i, t in enumerate(texts)]
    sets = [[{" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set() for t in x if (w := t.lower().split()) or True] for x in (texts, other)]
    want = [1.0 if a == b else len(a & b) / len(a | b) for a, b in zip(*sets, strict=True)]
    got = simhash.jaccard(simhash.Chunk.of(texts), simhash.Chunk.of(other), 5)
    assert got.tolist() == pytest.approx(want)


def test_components(spark):
    """A chain, hubs, repeated and empty links."""
    rng = random.Random(19)
    chain = [(i, i + 1) for i in range(1000, 1200)]
    rng.shuffle(chain)
    pairs = chain + [(5, i) for i in range(2000, 2600)] + [(2100, 7), (7, 2100), (7, 7), (None, 7), (3, None), (40, 40)]
    pairs += [(rng.randrange(5000, 5300), rng.randrange(5000, 5300)) for _ in range(200)]
    forest = Forest(6000)
    nodes = {i for a, b in pairs if a is not None and b is not None and a != b for i in (a, b)}
    for a, b in pairs:
        if a is not None and b is not None:
            forest.join(a, b)
    got = {r.node: r.component for r in components.components(spark.createDataFrame(pairs, "a bigint, b bigint")).collect()}
    assert got == {i: forest.root(i) for i in nodes}
    assert components.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_packing(odd, odd_rows, empty):
    got = packing.assign(packing.pieces(odd, keep_ids=True)).collect()
    tokenizer = tokens.word_tokenizer()
    want = Counter()
    for i, t in odd_rows:
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [1]
        for p in range(0, len(ids), 4096):
            part = ids[p : p + 4096]
            want[i, p // 4096, p, len(part), zlib.crc32(np.array(part, "<u4").tobytes()), tuple(part)] += 1
    assert want == Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32, tuple(r.ids)) for r in got)
    fill = {}
    for r in sorted(got, key=lambda r: r.offset):
        assert fill.get(r.sequence_id, 0) == r.offset
        fill[r.sequence_id] = r.offset + r.length
    assert max(fill.values()) <= 4096
    assert packing.assign(packing.pieces(empty)).count() == 0


def test_sequences_hold_their_pieces(odd):
    placed = packing.assign(packing.pieces(odd, keep_ids=True))
    assert {r.sequence_id: len(r.ids) for r in packing.sequences(placed).collect()} == {r[0]: r[1] for r in placed.groupBy("sequence_id").sum("length").collect()}


def test_plan_against_rules():
    rng = random.Random(7)
    for _ in range(300):
        capacity, counts = rng.choice([6, 9, 30, 64]), {}
        for _ in range(rng.randrange(40)):
            n = rng.randrange(1, capacity + 1)
            counts[n] = counts.get(n, 0) + rng.randrange(1, 6)
        slots, bins, used = packing.plan(counts, capacity), {}, {}
        for length, lo, hi, first, each, at in slots:
            assert used.get(length, 0) == lo
            used[length] = hi
            for r in range(hi - lo):
                bins.setdefault(first + r // each, []).append((at + r % each * length, length))
        assert used == {k: v for k, v in counts.items() if v}
        for b in bins.values():
            end = 0
            for at, length in sorted(b):
                assert at == end
                end += length
            assert end <= capacity and sum(n > capacity // 3 for _, n in b) <= 2


def brute_digest(text):
    """Quartiles of triplet counts and the length step, counted one by one."""
    raw, counts = (text or "").encode(), [0] * 1024
    for i in range(len(raw)):
        h = sum(v << 8 * k for k, j in enumerate((0, 3, 7)) if i + j < len(raw) for v in [raw[i + j]]) + 1
        h = ((h ^ h >> 30) * 0xBF58476D1CE4E5B9) % 2**64
        h = ((h ^ h >> 27) * 0x94D049BB133111EB) % 2**64
        counts[((h ^ h >> 31) >> 20) % 1024] += 1
    cuts = [sorted(counts)[k] for k in (255, 511, 767)]
    return [sum(c > q for q in cuts) for c in counts], round(8 * math.log1p(len(raw)))


def brute_likeness(a, b):
    steps = sum((0, 1, 2, 6)[abs(x - y)] for x, y in zip(a[0], b[0], strict=True)) + 16 * min(abs(a[1] - b[1]), 24)
    return max(0.0, 1 - steps / (1.4 * 1024))


def hexed(d):
    bits = "".join(f"{v:02b}" for v in d[0])
    return f"{d[1]:03x}" + "".join(f"{int(bits[i : i + 8], 2):02x}" for i in range(0, 2048, 8))


def test_digests(odd_rows, spark, empty):
    """Repeated and null ids and all texts; equal ids follow each other in some order, which the edited text shows."""
    df = spark.createDataFrame(odd_rows, "doc_id bigint, text string").repartition(3)
    marks = {(r.doc_id, r.text): r.m for r in df.selectExpr("doc_id", "text", "xxhash64(text) AS m").collect()}
    got = digest.neighbours(df).collect()
    ordered = sorted(odd_rows, key=lambda r: (r[0] is None, -(r[0] or 0), -marks[r]))
    made = {t: brute_digest(t) for t in {r[1] for r in odd_rows}}
    want = Counter()
    for (i, t), (_, n) in zip(ordered, ordered[1:] + ordered[:1], strict=True):
        raw, k = t or "", len(t or "") // 3
        edited = raw[: len(raw) - k] + (n or "")[:k]
        e = brute_digest(edited)
        want[i, len(raw), hashlib.sha256(edited.encode()).hexdigest(), hexed(made[t]), hexed(e), round(brute_likeness(made[t], e), 6), round(brute_likeness(made[t], made[n]), 6)] += 1
    assert want == Counter((r.doc_id, r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, r.near_edited, r.near_next) for r in got)
    assert digest.compare(digest.digest("a b c"), digest.digest("a b c")) == 1.0
    assert digest.neighbours(empty).count() == 0


def test_edited_texts_are_nearer_than_others(spark):
    rng = random.Random(20)
    rows = [(i, prose(rng, rng.choice([40, 150, 600, 4000]), [f"w{j * 7919 % 3000:x}" for j in range(rng.randrange(400), 900)])) for i in range(300)]
    got = digest.neighbours(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)).collect()
    assert sum(r.near_edited > r.near_next for r in got) > 0.98 * len(got)
    assert np.median([r.near_edited for r in got]) > np.median([r.near_next for r in got]) + 0.2


def test_digests_keep_odd_rows(odd, odd_rows):
    assert digest.neighbours(odd).count() == len(odd_rows)
    for lone in (odd.where("doc_id = 303"), odd.where("doc_id is null and text is null")):
        assert [r.near_next for r in digest.neighbours(lone).collect()] == [1.0]


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (1 + i % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def brute_spans(t):
    out = [(m.start(), 0, m.end(), "email") for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(m.start(), 1, m.end(), "ip") for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[^0-9]", "", m[0])
        out += [(m.start(), 2, m.end(), "card")] * (12 <= len(d) <= 19 and luhn(d))
    out += [(m.start(), 3, m.end(), "phone") for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return [f"{k}:{s}:{e}" for s, _, e, k in sorted(out)]


def test_personal_data(spark, odd, odd_rows, empty):
    rng = random.Random(3)
    texts = [None, "", "a@b.c+d@e.f x", "x@y a@b.c.d@e.f.g", "1.2.3.4.5.6.7.8", "000255.1.1.256 256.1.1.1 99999999999.1.1.1", "4111 1111 1111 1111", "é 4111111111111111é+1 (017) 555-7713.", "1" * 30_000, "a" * 40_000 + "@" + "b." * 4000, "1 " * 9000, "a@b.c " * 200, "a@b.c d " * 257, "1.2.3.4 " * 700, "x" + "y@z.w " * 512]
    texts += ["".join(rng.choice("aé.@+-19 0()") for _ in range(rng.randrange(150))) for _ in range(500)]
    named = [f"{prose(rng, 9)} Zorblatt {prose(rng, 3)} zed@corp.example {prose(rng, 9)}" for _ in range(5)]
    plain = [prose(rng, 60) for _ in range(200)] + [f"Zorb {prose(rng, 10)} u{i}@x.example" for i in range(30)]
    texts += named + plain
    found = pii.find(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"))
    got = {r.doc_id: r for r in pii.report(found).collect()}
    for i, t in enumerate(texts):
        base, r = brute_spans(t or ""), got[i]
        assert r.base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(b.startswith(k) for b in base) for k in pii.KINDS]
        spans = [s for s in r.spans.split(",") if s]
        assert [s for s in spans if not s.startswith("term")] == base
        told = {(t or "")[slice(*map(int, s.split(":")[1:]))] for s in spans if s.startswith("term")}
        assert told == ({"Zorblatt"} if "Zorblatt" in (t or "") else set())
    clean = {r.doc_id: r for r in pii.sanitized(found).collect()}
    assert clean[7].text == "é [CARD]é[PHONE]." and "Zorblatt" not in clean[texts.index(named[0])].text
    assert clean[0].text is None and clean[1].text == ""
    assert pii.find(odd).count() == len(odd_rows) and pii.find(empty).count() == 0


def brute_told(texts, disclosure, contexts):
    """entity -> terms, from a table of all contexts and documents written out by hand."""
    entity = lambda t, k, a, b: f"{k}:" + (t[a:b].lower() if k == "email" else t[a:b] if k == "ip" else re.sub("[^0-9]", "", t[a:b]))
    words = lambda t: {w for w in re.split(r"[^\w]+|_", t.lower()) if len(w) >= 3 and w.isalpha()}
    beside, joint, holders, with_term = {}, Counter(), {}, Counter()
    for i, t in enumerate(texts):
        with_term.update(words(t))
        for s in brute_spans(t):
            kind, a, b = s.split(":")[0], *map(int, s.split(":")[1:])
            left, right = t[max(0, a - pii.REACH) : a], t[b : b + pii.REACH]
            left = re.sub(r"^\S*", "", left) if a > pii.REACH else left
            right = re.sub(r"\S*$", "", right) if len(right) == pii.REACH else right
            near = re.sub(r"\S*@\S*", " ", f"{left} {right}")
            e = entity(t, kind, a, b)
            holders.setdefault(e, Counter())[i] += 1
            for w in words(near):
                beside.setdefault((e, w), set()).add(near)
                joint[e, w] += 1
    n, out = len(texts), {}
    for (e, w), where in beside.items():
        p_e, p_w = min(sum(holders[e].values()), n) / n, min(with_term[w], n) / n
        p = min(joint[e, w], with_term[w], sum(holders[e].values())) / n
        if len(where) >= contexts and p_e < 1 and math.log(p / (p_e * p_w)) >= disclosure * -math.log(p_e):
            out.setdefault(e, set()).add(w)
    return out


def test_disclosing_terms(spark):
    rng = random.Random(30)
    people = [(f"u{i}@corp.example", f"name{chr(97 + i)}x", f"+49 30 55501{i:02d}") for i in range(12)]
    texts = []
    for i in range(260):
        mail, name, phone = rng.choice(people)
        told = f"{name} " if rng.random() < 0.8 else ""
        texts.append(rng.choice([prose(rng, 30), f"{prose(rng, 12)} {told}{mail} {prose(rng, 9)}", f"{prose(rng, 20)} {told}{prose(rng, 2)} {phone} {prose(rng, 20)} {mail}"]))
    texts = list(dict.fromkeys(texts))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    holders = docs.withColumn("__base", pii.base_spans()).where("size(__base) > 0")
    for disclosure in (0.9, 0.5):
        got = {}
        for r in pii.disclosing(holders, docs, disclosure, 3).collect():
            got.setdefault(r.entity, set()).add(r.term)
        assert got == brute_told(texts, disclosure, 3) and any(w.startswith("name") for v in got.values() for w in v)


def brute_counts(t):
    t = t or ""
    w, seen, twice = WORD.findall(t), set(), 0
    for line in t.split("\n"):
        if WORD.search(line):
            twice += line in seen
            seen.add(line)
    grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    many, cover = Counter(grams), set()
    for i, g in enumerate(grams):
        if many[g] > 1:
            cover |= set(range(i, i + 5))
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), twice, len(cover)


def test_forest_is_the_same_for_any_order(spark):
    rng = random.Random(21)
    rows = [(i % 40, prose(rng, rng.randrange(15, 90)) + " #" * (i % 7)) for i in range(160)]
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(40)], "doc_id bigint, quality int")
    found = []
    for turn in (rows, rows[::-1]):
        forest = rules.fitted(spark.createDataFrame(turn, "doc_id bigint, text string").coalesce(1), labels)
        found.append((forest.cut, [t[1].tolist() for t in forest.trees]))
    assert found[0] == found[1]


def test_rules(odd, odd_rows, empty):
    got = rules.apply_rules(odd, None).collect()
    want = Counter()
    for i, t in odd_rows:
        n = brute_counts(t)
        failed = n[0] < 10 or 100 * n[4] > 20 * n[0]
        want[i, *n, failed, not failed] += 1
    assert want == Counter((r.doc_id, *[r[c] for c in rules.COUNTS], r.base_failed, r.kept) for r in got)
    assert rules.apply_rules(empty, None).count() == 0


def test_lookup_table():
    for shards, slots in ((1, 7), (5, 101), (32, 4099)):
        names = [f"s{i}" for i in range(shards)]
        table = sharding.lookup_table(names, slots)
        sizes = Counter(table)
        assert max(sizes.values()) - min(sizes.values()) <= 1 and len(sizes) == shards
        # by hand: shards take turns, each at its first free slot in its own order
        own = [[(sharding._hash60(f"{s}:offset") % slots + j * (sharding._hash60(f"{s}:skip") % (slots - 1) + 1)) % slots for j in range(slots)] for s in names] if slots < 1000 else None
        if own:
            want, k = [None] * slots, 0
            while None in want:
                want[next(p for p in own[k % shards] if want[p] is None)] = k % shards
                k += 1
            assert table == want
    before, after = sharding.lookup_table(sharding.SHARDS), sharding.lookup_table(sharding.SHARDS[:-1])
    assert sum(a != b for a, b in zip(before, after, strict=True)) < 0.25 * len(before)
    with pytest.raises(ValueError):
        sharding.lookup_table(["a"], 8)


def test_placement(odd, odd_rows, empty):
    got = sharding.place(odd).collect()
    assert len(got) == len(odd_rows) and len({r.shard for r in got if r.doc_id is None}) == 1
    clash = sharding.place(odd.withColumnsRenamed({"score": "Slot", "copy": "SHARD", "lang": "a.b"}))
    assert clash.columns == ["doc_id", "text", "a.b", "source", "n_chars", "_n", "slot", "shard"]
    assert sorted(map(str, (r[-2:] for r in clash.collect()))) == sorted(map(str, (r[-2:] for r in got)))
    assert sharding.place(empty).count() == 0


def test_queries_cover_their_tables(spark):
    n = spark.read.parquet(f"{SF}/documents.parquet").count()
    for name in ("op1_substrings", "op3_sharding", "op4_simhash", "op7_digest", "op9_pii"):
        df = queries.QUERIES[name](spark, SF)
        assert df.count() == n and df.select("doc_id").distinct().count() == n, name
