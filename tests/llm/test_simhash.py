"""SimHash fingerprints and components against brute force; near copies of five-word shingles."""

import random
import re

import numpy as np
import pytest
import xxhash

from pagemint.llm import simhash
from pagemint.llm.components import components


def brute_print(text, size=3):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    parts = [" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))]
    counts = [0] * 64
    for p in parts:
        h = xxhash.xxh64_intdigest(p.encode(), 42)
        for b in range(64):
            counts[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * counts[b] > len(parts))


def brute_components(prints):
    keys = sorted(prints)
    root = {k: k for k in keys}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in keys:
        for j in keys:
            if j > i and bin(prints[i] ^ prints[j]).count("1") <= 2:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {k: find(k) for k in keys}


def test_dedup(spark):
    rng = random.Random(3)
    vocabulary = [f"W{i}é" for i in range(300)]
    texts = [None, "", " \t", "one", "One", "a b c d e"]
    for _ in range(30):
        base = rng.choices(vocabulary, k=rng.randint(1, 400))
        texts.append(" ".join(base))
        for _ in range(rng.randint(0, 6)):
            copy = list(base)
            copy[rng.randrange(len(copy))] = "changed"
            texts.append("\n".join(copy))
            base = copy if rng.random() < 0.5 else base
    texts += texts[:20] + ["many words " * 20000]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, fingerprint string")
    got = {r.doc_id: r for r in simhash.dedup(df).collect()}
    prints = {i: brute_print(t) for i, t in enumerate(texts)}
    assert {i: r.fingerprint % (1 << 64) for i, r in got.items()} == prints
    assert {i: r.component for i, r in got.items()} == brute_components(prints)


@pytest.mark.parametrize("most", [64, 1])
def test_ball_links_are_exact(spark, most):
    rng = random.Random(5)
    values = [rng.getrandbits(64) for _ in range(40)]
    for v in values[:20]:
        for d in (1, 2, 3):
            w = v
            for b in rng.sample(range(64), d):
                w ^= 1 << b
            values.append(w)
    crowd = values[0]  # many that share a segment
    values = list(dict.fromkeys(values + [crowd ^ 1 << a ^ 1 << b for a in range(12) for b in range(a + 1, 60, 7)]))
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    df = spark.createDataFrame([(v,) for v in signed], "fingerprint long")
    got = {r.node: r.root for r in components(simhash.close_pairs(df, most)).collect()}
    want = brute_components({s: v for s, v in zip(signed, values)})
    assert {s: got.get(s, s) for s in signed} == want


def test_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(100)] + [(500, 501), (7, 7)], "a long, b long")
    got = {r.node: r.root for r in components(links).collect()}
    assert got == {**{i: 0 for i in range(1, 101)}, 501: 500}


def test_keep_one(spark):
    rng = random.Random(11)
    vocabulary = [f"w{i}" for i in range(2000)]
    rows, groups, doc = [], {}, 0
    for g in range(60):
        base = rng.choices(vocabulary, k=300)
        for c in range(rng.randint(1, 4)):
            copy = list(base)
            for _ in range(min(c, 2)):  # at most 10 of some 296 shingles of five words differ
                copy[rng.randrange(300)] = "new" + str(rng.random())
            rows.append((doc, " ".join(copy), "en"))
            groups[doc] = g
            doc += 1
    rows += [rows[0], (None, None, None), (None, "", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, kept_id string")
    kept = [r.doc_id for r in simhash.keep_one(df).collect()]
    assert sorted(k for k in kept if k is not None) == sorted({min(d for d in groups if groups[d] == g) for g in groups.values()})
    assert kept.count(None) == 1
    assert simhash.keep_one(df.limit(0)).count() == 0 and simhash.dedup(df.limit(0)).count() == 0


def test_long_text_blocks():
    text = " ".join(str(i % 977) for i in range(3 * simhash.BLOCK))
    got = int(np.packbits(simhash.signature(text, 3, 64)).view(">u8")[0])
    assert got == brute_print(text)


def brute_groups(texts, similarity):
    sets = {}
    for i, t in texts.items():
        w = t.split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}
    root = {i: i for i in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in texts:
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both >= similarity * (len(sets[i]) + len(sets[j]) - both) - 1e-9:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return sorted({find(i) for i in texts})


def test_keep_one_in_template_group(spark):
    rng = random.Random(21)
    new = lambda n: [f"u{rng.getrandbits(40)}" for _ in range(n)]
    template, texts = new(160), []
    for i in range(300):  # mutual similarity about 0.67
        own = template + new(40)
        texts.append(own)
        if i < 120:  # a partner at 0.78 to 0.9
            texts.append(own[: 200 - (n := rng.randint(10, 24))] + new(n))
    for i in range(40):  # edits in several places, and chains
        base = new(rng.randint(3, 120))
        for _ in range(4):
            base = list(base)
            base[rng.randrange(len(base))] = "changed"
            texts.append(base)
    rng.shuffle(texts)
    texts = {i: " ".join(t) for i, t in enumerate(texts)}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert sorted(r.doc_id for r in simhash.keep_one(df).collect()) == brute_groups(texts, 0.8)


def test_keep_one_repeated_line(spark):
    rng = random.Random(22)
    line = " ".join(f"line{i}" for i in range(14))
    texts = [" ".join([f"a{rng.getrandbits(40)}" for _ in range(100)] + [line] * 20) for _ in range(2)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert simhash.keep_one(df).count() == 2


def test_parity_bounds_the_difference():
    rng = random.Random(5)
    for _ in range(300):
        x = np.unique(np.array([rng.getrandbits(64) for _ in range(rng.randint(0, 300))], np.uint64))
        y = np.unique(np.concatenate((x[rng.randint(0, 40) :], np.array([rng.getrandbits(64) for _ in range(rng.randint(0, 90))], np.uint64))))
        differ = len(np.setxor1d(x, y))
        assert simhash.least_difference(simhash.parity(x), simhash.parity(y)) <= differ
        assert simhash.least_difference(simhash.parity(x), simhash.parity(x)) == 0


def test_hubs_join_a_group_of_edited_copies(spark, monkeypatch):
    """Copies with edits of their own, alike to the text they come from more than to each other: few pairs are compared."""
    rng = random.Random(31)
    base, texts = [f"t{rng.getrandbits(40)}" for _ in range(150)], []
    for _ in range(300):
        copy = list(base)
        for _ in range(rng.randint(0, 4)):
            copy[rng.randrange(150)] = f"e{rng.getrandbits(40)}"
        texts.append(copy)
    texts = {i: " ".join(t) for i, t in enumerate(texts)}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    asked, links = [], simhash.Verifier.links

    def counted(self, pairs):
        asked.append(pairs.count())
        return links(self, pairs)

    monkeypatch.setattr(simhash.Verifier, "links", counted)
    assert sorted(r.doc_id for r in simhash.keep_one(df).collect()) == brute_groups(texts, 0.8)
    assert sum(asked) <= 5 * len(texts), asked
