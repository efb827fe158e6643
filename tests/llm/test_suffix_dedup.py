"""Exact substring dedup against brute force."""

import random
from collections import Counter

import numpy as np
import pytest

from pagemint.llm import suffix_dedup as S


def brute(texts, length):
    raws = [(t or "").encode() for t in texts]
    counts = Counter(r[i : i + length] for r in raws for i in range(len(r) - length + 1))
    out = []
    for r in raws:
        covered = np.zeros(len(r), bool)
        for i in range(len(r) - length + 1):
            if counts[r[i : i + length]] > 1:
                covered[i : i + length] = True
        out.append((len(r), [tuple(x) for x in (S.runs(covered) + [0, 1]).tolist()], bytes(np.frombuffer(r, np.uint8)[~covered])))
    return out


def make(seed, length):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdé ", k=rng.randint(1, 9)))
    prose = lambda n: " ".join(word() for _ in range(n))
    passages = [prose(rng.randint(10, 80)) for _ in range(6)]
    texts = [None, "", "x" * (length - 1), "y" * (3 * length), "ab" * length, "short"]
    for _ in range(60):
        parts = [prose(rng.randint(1, 60))]
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(passages)
            cut = rng.randrange(len(p))
            parts += [rng.choice([p, p[cut:], p[:cut]]), prose(rng.randint(0, 20))]
        texts.append("".join(parts))
    base = prose(200)
    for _ in range(12):
        at = rng.randrange(len(base))
        texts.append(base[:at] + "#" + base[at + 1 :])
    return texts + [base, base, texts[10], passages[0] * 4, "Orre " * 400]


@pytest.mark.parametrize("most_regions", [768, 3, 1])
def test_against_brute_force(spark, most_regions):
    length = 100
    texts = make(1, length)
    rows = [(i if i % 9 else None, t, "s") for i, t in enumerate(texts)] + [(1, texts[1], "s"), (30, texts[30], "s")]
    df = spark.createDataFrame(rows, "doc_id long, text string, key string").repartition(3)
    want = Counter((r[0], n, tuple(s), k) for r, (n, s, k) in zip(rows, brute([r[1] for r in rows], length)))
    got = S.dedup(df, length=length, most_regions=most_regions).collect()
    assert Counter((r.doc_id, r.n_bytes, tuple(map(tuple, r.removed)), bytes(r.kept)) for r in got) == want


def test_blocks(monkeypatch):
    text = random.Random(2).randbytes(5000)
    one = list(S.regions(text, 100))
    monkeypatch.setattr(S, "BLOCK", 700)
    many = list(S.regions(text, 100))
    spread = lambda parts: [a for p in parts for h, n in zip(p[0].tolist(), p[3].tolist()) for a in [h] * n]
    assert len(many) > 1 and spread(one) == spread(many)


def test_deep_shallow_sort():
    rng = random.Random(3)
    for _ in range(30):
        text = np.frombuffer(bytes(rng.choices(b"ab", k=rng.randint(150, 600))) + bytes(8), np.uint8)
        place = np.arange(len(text) - 8 - 100)
        group = np.array([rng.randrange(2) for _ in place])
        got = S.repeated(text, place, group, 100)
        seen = Counter((g, text[p : p + 100].tobytes()) for p, g in zip(place, group))
        assert got.tolist() == [seen[g, text[p : p + 100].tobytes()] > 1 for p, g in zip(place, group)]
    flat = np.frombuffer(b"a" * 400 + bytes(8), np.uint8)
    assert S.repeated(flat, np.arange(300), np.zeros(300, int), 100).all()


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert S.dedup(df).count() == 0
    few = spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string")
    assert sorted((r.doc_id, r.n_bytes, bytes(r.kept)) for r in S.dedup(few).collect()) == [(1, 1, b"a"), (2, 0, b"")]
