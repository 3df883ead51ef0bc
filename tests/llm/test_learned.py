"""Operators that learn: their parts against slow versions, their answers against held-out labels."""

import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from logloom.llm import langid, quality, queries, rules
from logloom.llm.textkit import Chunk
from tests.llm.conftest import WORDS, prose

HELD = "/root/testdata/sf0.01"


def crc(doc_id):
    return zlib.crc32(str(doc_id).encode())


# --- quality


def test_pooling_is_a_softmax():
    rng = np.random.default_rng(1)
    h, e, first = rng.normal(size=(30, 4)), 20 * rng.normal(size=30), np.array([0, 1, 5, 29, 30])
    z, a = quality.pooled(h, e, first)
    for i in range(4):
        own = slice(first[i], first[i + 1])
        w = np.exp(e[own] - e[own].max())
        w /= w.sum()
        assert np.allclose(a[own], w) and np.allclose(z[i], w @ h[own])


def test_passages(odd_rows):
    texts = [t or "" for _, t in odd_rows][:60]
    x, first = quality.passages(Chunk.of(texts))
    words = [t.encode().split() for t in texts]  # the same white space for these texts
    assert np.diff(first).tolist() == [max(1, -(-len(w) // quality.PASSAGE)) for w in words]
    for i, w in enumerate(words):
        for k, at in enumerate(range(first[i], first[i + 1])):
            own = w[k * quality.PASSAGE : (k + 1) * quality.PASSAGE]
            if not own:
                assert not x[at].any()
                continue
            assert x[at, 6] == pytest.approx(sum(map(len, own)) / len(own) / 10, rel=1e-5)
            assert x[at, 8] == pytest.approx(sum(a == b for a, b in zip(own, own[1:], strict=False)) / len(own), abs=1e-6)
            assert x[at, 10] == pytest.approx(len(set(own)) / len(own), rel=1e-5)
            assert x[at, 13] == pytest.approx(len(own) / quality.PASSAGE, rel=1e-5)


def test_one_bad_passage_decides():
    """The label depends on a single passage of many: what the attention is for."""
    rng = random.Random(2)
    texts, y = [], []
    for i in range(600):
        parts = [prose(rng, quality.PASSAGE) for _ in range(rng.randrange(2, 9))]
        if i % 2:
            parts[rng.randrange(len(parts))] = " ".join("#$%&" + str(rng.randrange(99)) for _ in range(quality.PASSAGE))
        texts.append(" ".join(parts))
        y.append(1 - i % 2)
    x, first = quality.passages(Chunk.of(texts))
    cut = 400
    model = quality.learn(x[: first[cut]], first[: cut + 1], np.array(y[:cut]))
    score = model.score(x[first[cut] :], first[cut:] - first[cut])
    assert np.mean((score >= 0.5) == np.array(y[cut:])) > 0.97
    _, a = quality.pooled(*[v for j, v in enumerate(model.encode(x)) if j in (0, 3)], first)
    bad = [i for i in range(600) if not y[i]]
    dirty = [np.argmax([p.count("#") for p in [" ".join(texts[i].split()[k : k + quality.PASSAGE]) for k in range(0, len(texts[i].split()), quality.PASSAGE)]]) for i in bad]
    assert np.mean([np.argmax(a[first[i] : first[i + 1]]) == d for i, d in zip(bad, dirty, strict=True)]) > 0.9


def test_learning_needs_both_labels():
    x, first = quality.passages(Chunk.of(["a b", "c d"]))
    assert quality.learn(x, first, np.array([1, 1])) is None and quality.learn(x[:0], np.array([0]), np.array([])) is None


def test_quality_of_held_out_documents(spark):
    got = queries.op2_quality(spark, HELD).toPandas()
    assert (got["held_out"] == [crc(i) % 5 == 0 for i in got["doc_id"]]).all()
    assert got["score"].between(0, 1).all() and ((got["score"] >= 0.3).astype(int) == got["predicted"]).all()
    labels = spark.read.parquet(f"{HELD}/labels.parquet").toPandas()
    both = got[got["held_out"]].merge(labels, on="doc_id")
    assert (both["predicted"] == both["quality"]).mean() > 0.9
    good, bad = both[both["quality"] == 1]["score"].to_numpy(), both[both["quality"] == 0]["score"].to_numpy()
    assert (good[:, None] > bad[None, :]).mean() > 0.95


def test_labels_of_held_out_documents_teach_nothing(spark):
    docs = spark.read.parquet(f"{HELD}/documents.parquet").withColumn("held_out", quality.held_out())
    labels = spark.read.parquet(f"{HELD}/labels.parquet")
    turned = labels.withColumn("quality", F.when(quality.held_out(), 1 - F.col("quality")).otherwise(F.col("quality")))
    scores = [{r.doc_id: r.score for r in quality.predict(docs, quality.fitted(docs, x.where(~quality.held_out())), ["doc_id"]).collect()} for x in (labels, turned)]
    assert scores[0] == scores[1]


def test_quality_of_odd_rows(spark, odd, odd_rows, empty):
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)] + [(None, 1), (3, None)], "doc_id bigint, quality int")
    model = quality.fitted(odd, labels)
    got = quality.predict(odd, model, ["doc_id", "text", "score"]).collect()
    assert len(got) == len(odd_rows)
    by_text = {}
    for r in got:
        by_text.setdefault(r.text, set()).add(r.score)
    assert all(len(v) == 1 for v in by_text.values()) and by_text[None] == by_text[""] == by_text[" \n\t "]
    assert quality.predict(empty, model, ["doc_id"]).count() == 0
    assert quality.fitted(empty, labels) is None and quality.fitted(odd, labels.where("false")) is None
    assert {r.score for r in quality.predict(odd, None, ["doc_id"]).collect()} == {1.0}


# --- languages


def test_filters_hold_what_was_put_in():
    rng = np.random.default_rng(3)
    names = [f"l{i:02d}" for i in range(11)]
    counts = {n: (np.unique(rng.integers(0, 1 << 63, 9000, dtype=np.uint64)), None) for n in names}
    counts = {n: (h, np.full(len(h), 9)) for n, (h, _) in counts.items()}
    model = langid.build(counts)
    held = lambda h, i: np.logical_and.reduce([model.masks[i // 8, s] & (1 << i % 8) > 0 for s in langid.slots(h)])
    strange = rng.integers(0, 1 << 63, 200_000, dtype=np.uint64)
    for i, n in enumerate(names):
        assert held(counts[n][0], i).all()
        assert abs(held(strange, i).mean() - model.false_rate[i]) < 3 * np.sqrt(model.false_rate[i] / len(strange)) + 2e-5


def test_more_languages_than_a_mask_of_64(spark):
    rng = random.Random(22)
    alphabets = [[f"{a}{b}{c}" for c in "aeiou" for b in rng.sample("bcdfghjklmnpqrstvwxz", 3) for a in rng.sample("bcdfghjklmnpqrstvwxz", 2)] for _ in range(70)]
    rows = [(i, prose(rng, 60, alphabets[i % 70]), f"l{i % 70:02d}") for i in range(700)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    model = langid.fitted(df)
    got = langid.predict(df, model, ("doc_id", "lang")).collect()
    assert len(model.names) == 70 and sum(r.lang == r.lang_pred for r in got) > 0.98 * len(got)


def slow_grams(text):
    """Letters in lower case and one edge between words, by three and four bytes; hashed one by one."""
    raw, out = [b if chr(b).isalpha() and b < 128 or b >= 128 else None for b in text.lower().encode()], []
    kept = []
    for i, b in enumerate(raw):
        if b is not None:
            kept.append(b)
        elif i == 0 or raw[i - 1] is not None:
            kept.append(0x5F)
    for k in langid.SIZES:
        for i in range(len(kept) - k + 1):
            h = (int.from_bytes(bytes(kept[i : i + k]), "big") + (k << 56)) % 2**64
            h = ((h ^ h >> 30) * 0xBF58476D1CE4E5B9) % 2**64
            h = ((h ^ h >> 27) * 0x94D049BB133111EB) % 2**64
            out.append(h ^ h >> 31)
    return out


def test_scores_against_sets():
    """Masks, shares and their correction, from plain sets of filter positions."""
    rng = random.Random(23)
    names = [f"l{i}" for i in range(11)]
    words = {n: [a + b for a in rng.sample(["ba", "ki", "lo", "mur", "ten", "sy", "quo"], 4) for b in rng.sample(["da", "fe", "gon", "hil", "ü", "rux"], 3)] for n in names}
    learned = {n: [prose(rng, 40, words[n]) for _ in range(6)] for n in names}
    counts = {n: Counter(h for t in ts for h in slow_grams(t)) for n, ts in learned.items()}
    model = langid.build({n: (np.array(sorted(c), np.uint64), np.array([c[h] for h in sorted(c)])) for n, c in counts.items()})
    share = {n: {h: v / sum(c.values()) for h, v in c.items()} for n, c in counts.items()}
    best = {h: max(share[n].get(h, 0) for n in names) for n in names for h in share[n]}
    at = lambda h: [h >> 20 * i & langid.SLOTS - 1 for i in range(langid.HASHES)]
    bits = {n: {s for h, v in counts[n].items() if v >= langid.LEAST and share[n][h] >= langid.SHARE * best[h] for s in at(h)} for n in names}
    texts = [prose(rng, 30, words[n]) for n in names] + ["", "12 34", "Ba DA, ki-fe!", "  lonely "]
    got = langid.scores(Chunk.of([t.lower() for t in texts]), model)
    for t, row in zip(texts, got, strict=True):
        grams = slow_grams(t)
        for n, value in zip(model.names, row, strict=True):
            rate = (len(bits[n]) / langid.SLOTS) ** langid.HASHES
            hits = sum(all(s in bits[n] for s in at(h)) for h in grams)
            want = min(1, max(0, (hits - rate * len(grams)) / max((1 - rate) * len(grams), 1e-9)))
            assert value == pytest.approx(want, abs=1e-9)


def test_languages_of_held_out_documents(spark):
    got = queries.op8_langid(spark, HELD).toPandas()
    assert (got["held_out"] == [crc(i) % 4 == 2 for i in got["doc_id"]]).all() and got["score"].between(0, 1).all()
    docs = spark.read.parquet(f"{HELD}/documents.parquet").toPandas()
    both = got[got["held_out"]].merge(docs, on="doc_id")
    both = both[both["lang"].notna() & (both["lang_pred"] != "und") & (both["n_chars"] >= 60)]
    assert len(both) > 100 and (both["lang_pred"] == both["lang"]).mean() > 0.95


def test_languages_of_odd_rows(odd, odd_rows, empty):
    model = langid.fitted(odd)
    got = {}
    for r in langid.predict(odd, model, ("doc_id", "text", "score")).collect():
        got.setdefault(r.text, set()).add((r.lang_pred, r.score))
    assert all(len(v) == 1 for v in got.values())
    for t, v in got.items():
        lang, score = next(iter(v))
        assert (lang == "und") == (t is None or not any(ch.isalpha() for ch in t)) and 0 <= score <= 1
        assert lang in ("und", "en", "de")
    nothing = langid.fitted(empty)
    assert not nothing.names and {r.lang_pred for r in langid.predict(odd, nothing).collect()} == {"und"}
    assert langid.predict(empty, model).count() == 0


# --- rules


def naive_path(tree, x):
    column, cut, left, length = tree
    i = 0
    while left[i] >= 0:
        i = left[i] + (x[column[i]] >= cut[i])
    return length[i]


def test_path_lengths():
    rng = random.Random(4)
    texts = [prose(rng, rng.randrange(20, 200)) for _ in range(120)] + ["# " * 30 + prose(rng, 20)]
    s = rules.statistics(Chunk.of(texts))
    mean = rules.averages(s)
    x = rules.features(s, mean)
    forest = rules.Forest(x[:120], x.min(0), x.max(0), mean, trees=20)
    want = [round(2.0 ** (-sum(naive_path(t, v) for t in forest.trees) / (20 * forest.norm)), 6) for v in x]
    assert forest.score(s).tolist() == pytest.approx(want, abs=2e-6)
    assert forest.score(s).argmax() == 120


def test_threshold_keeps_good_rows():
    rng = random.Random(5)
    odd_one = lambda: " ".join(rng.choice(["#$%", "<|>", "&&", rng.choice(WORDS)]) for _ in range(60))
    texts = [prose(rng, 120) for _ in range(300)] + [odd_one() for _ in range(60)]
    good = np.array([1] * 300 + [0] * 60)
    s = rules.statistics(Chunk.of(texts))
    forest = rules.fit(s, good)
    score = forest.score(s)
    assert (score[:300] < forest.cut).all() and (score[300:] >= forest.cut).mean() > 0.9
    assert rules.fit(s, np.zeros(360)) is None


def test_rules_are_fitted_on_all_labelled_documents(spark):
    """Averages, ranges and the cut of 12,000 documents, one of which is extreme; each tree draws from all good ones."""
    rng = random.Random(4)
    texts = [" ".join(f"w{rng.randrange(300)}" + rng.choice(["", "1", "#"]) for _ in range(rng.randrange(12, 30))) for _ in range(11_999)] + ["#$%& " * 4 + " ".join(f"w{i}" for i in range(20))]
    good = np.array([rng.random() < 0.8 for _ in texts])
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(4)
    labels = spark.createDataFrame([(i, int(g)) for i, g in enumerate(good)], "doc_id bigint, quality int")
    forest = rules.fitted(docs, labels)
    parts = [rules.statistics(Chunk.of(texts[i : i + 4000])) for i in range(0, 12_000, 4000)]
    s = {k: np.concatenate([p[k] for p in parts]) for k in parts[0]}
    use = ~rules.base_failed(s)
    s, good = {k: v[use] for k, v in s.items()}, good[use]
    assert np.allclose(forest.mean, rules.averages(s), rtol=1e-12)
    score = forest.score(s)
    limit = np.sort(score[good])[::-1][int(rules.LOSS * good.sum())]
    above = score[~good & (score > limit)]
    assert forest.cut == pytest.approx((limit + above.min()) / 2 if len(above) else limit + 1e-6)
    assert len(forest.trees) == rules.TREES and forest.norm == rules._mean_path(rules.LEAF)
    assert len({tree[1].tobytes() for tree in forest.trees}) == rules.TREES
    assert rules.fitted(docs, labels.withColumn("quality", labels.quality * 0)) is None


def test_rules_of_documents_that_were_held_out(spark):
    """The forest learns from four fifths of the labels; the rest is judged."""
    docs, labels = (spark.read.parquet(f"{HELD}/{n}.parquet") for n in ("documents", "labels"))
    forest = rules.fitted(docs, labels.where(~quality.held_out()))
    got = rules.apply_rules(docs, forest).join(labels.where(quality.held_out()), "doc_id").toPandas()
    good, bad = got[got["quality"] == 1], got[got["quality"] == 0]
    assert len(good) > 50 and len(bad) > 9 and good["kept"].mean() > 0.95 and bad["kept"].mean() < 0.5
    assert not (got["kept"] & got["base_failed"]).any()
