"""Small document tables with every odd case."""

import random

import pytest

SF = "/root/testdata/sf0.001"
WORDS = [a + b for a in ("ba", "ki", "lo", "mur", "ten", "sy") for b in ("da", "fe", "gon", "hil", "pas", "rux", "ve")]


def prose(rng, n, words=WORDS):
    return " ".join(rng.choice(words) for _ in range(n))


@pytest.fixture(scope="session")
def twins():
    """Two different words of 1,024 letters that polynomial hashes modulo 2**64 take for equal."""
    order = [bin(i).count("1") % 2 for i in range(1024)]
    return "".join("ab"[b] for b in order), "".join("ba"[b] for b in order)


@pytest.fixture(scope="session")
def odd_rows():
    """(doc_id, text): null and repeated ids, null, empty, blank and very long texts, copies, non-Latin text."""
    rng = random.Random(11)
    passage = prose(rng, 60)
    rows = [(i, prose(rng, rng.randrange(0, 200))) for i in range(60)]
    rows += [(100 + i, f"{prose(rng, 30)} {passage} {prose(rng, 25)}") for i in range(12)]
    rows += [(200 + i, passage) for i in range(8)]
    rows += [(300, None), (301, ""), (302, " \n\t "), (303, "word"), (304, "é 日本語　テスト 🙂\n\x0bz"), (305, "go " * 5000), (306, prose(rng, 40_000)), (307, "x" * 200_000), (308, "<|endoftext|> a<|startoftext|>b"), (309, "A\nA\n\nb\nA")]
    rows += [(5, rows[5][1]), (5, passage), (None, passage), (None, None), (None, "lonely " * 3)]
    rng.shuffle(rows)
    return rows


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    """The rows with lang, source and n_chars, all null here and there, and columns whose names operators make."""
    full = [(i, t, ["en", None, "de"][k % 3], [None, "src0", "src7"][k % 3], None if t is None else len(t), "mine", -1.0, k) for k, (i, t) in enumerate(odd_rows)]
    return spark.createDataFrame(full, "doc_id bigint, text string, lang string, source string, n_chars bigint, score string, copy double, _n int").repartition(3)


@pytest.fixture(scope="session")
def empty(odd):
    return odd.where("false")
