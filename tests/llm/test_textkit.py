"""Chunks, words and hashes against plain Python."""

import random
import re

import numpy as np
import pyarrow as pa
import xxhash

from logloom.llm.textkit import Chunk, chunks, gram_hashes, run_hashes, xxh64

SPLIT = re.compile(rb"[^\x20\x09-\x0d]+")


def test_words_and_normalized(odd_rows):
    texts = [t for _, t in odd_rows]
    want = [SPLIT.findall((t or "").encode()) for t in texts]
    for limit in (1, 500, 1 << 21):
        got, joined = [], []
        for c in chunks(pa.array(texts, pa.string()), limit):
            w = c.words()
            buf, s, e = w.normalized()
            got += [[c.buf[w.starts[j] : w.ends[j]].tobytes() for j in range(w.first[i], w.first[i + 1])] for i in range(c.n)]
            joined += [buf[a:b].tobytes() for a, b in zip(s, e, strict=True)]
        assert got == want and joined == sum(want, [])


def test_slices_and_large_strings():
    column = pa.array(["no", "a b", None, "c", "no"]).slice(1, 3)
    for col in (column, column.cast(pa.large_string())):
        assert [c.text(i) for c in chunks(col) for i in range(c.n)] == [b"a b", b"", b"c"]
    assert list(chunks(pa.array([], pa.string()))) == []


def test_equal_words_have_equal_hashes(twins):
    rng, seen = random.Random(1), {}
    for longest in [9] * 20 + [40, 1200]:
        words = ["".join(rng.choice("ab") for _ in range(rng.randrange(1, longest))) for _ in range(300)]
        c = Chunk.of([" ".join([*words, *twins, *words[::-1]])])
        w = c.words()
        for j, h in enumerate(w.hashes().tolist()):
            assert seen.setdefault(c.buf[w.starts[j] : w.ends[j]].tobytes(), h) == h
    assert len(set(seen.values())) == len(seen)


def test_grams_and_runs():
    rng = np.random.default_rng(4)
    h = rng.integers(0, 3, 400, dtype=np.uint64)
    for k in (1, 2, 3, 5, 8, 13, 20):
        seen, got = {}, gram_hashes(h, k)
        for i in range(400 - k + 1):
            assert seen.setdefault(h[i : i + k].tobytes(), int(got[i])) == got[i]
        assert len(got) == 400 - k + 1 and len(set(seen.values())) == len(seen)
    assert not len(gram_hashes(h[:4], 5)) and not len(run_hashes(h, h[:0].astype(int), h[:0].astype(int)))
    starts, counts = rng.integers(0, 300, 2000), rng.integers(1, 100, 2000)
    seen = {}
    for s, n, x in zip(starts.tolist(), counts.tolist(), run_hashes(h, starts, counts).tolist(), strict=True):
        assert seen.setdefault(h[s : s + n].tobytes(), x) == x
    assert len(set(seen.values())) == len(seen)
    # a sequence of which a sum of powers of any odd number, modulo 2**64, can't tell the complement
    order = np.array([bin(i).count("1") % 2 for i in range(4096)], np.uint64)
    both = np.concatenate((order, 1 - order))
    assert len(set(run_hashes(both, np.array([0, 4096]), np.array([4096, 4096])).tolist())) == 2


def test_xxh64():
    rng = np.random.default_rng(2)
    buf = rng.integers(0, 256, 4000, dtype=np.uint8)
    starts = rng.integers(0, 3800, 3000)
    ends = starts + rng.integers(0, 200, 3000)
    ends[:9] = starts[:9] = 5
    ends[1:9] = [1028, 1029, 1030, 1061, 3000, 3999, 4000, 37]
    for seed in (0, 42):
        assert [int(x) for x in xxh64(buf, starts, ends, seed)] == [xxhash.xxh64_intdigest(buf[a:b].tobytes(), seed=seed) for a, b in zip(starts, ends, strict=True)]
