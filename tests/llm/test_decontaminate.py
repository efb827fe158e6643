"""Decontamination against brute force; cutting."""

import random

import pytest

from pagemint.llm import decontaminate as D
from pagemint.llm.common import words


def brute(text, items, window):
    ws, hit, found = words(text), set(), set()
    for i, t in items:
        its = words(t)
        size = min(window, len(its))
        for k in range(len(its) - size + 1 if size else 0):
            for j in range(len(ws) - size + 1):
                if ws[j : j + size] == its[k : k + size]:
                    hit |= set(range(j, j + size))
                    found.add(i)
    return len(ws), hit, found


@pytest.mark.parametrize("block_words", [200_000, 15])
def test_scan(spark, block_words):
    rng = random.Random(3)
    vocabulary = ["a", "B", "É", "d.", "e-f"]
    items = [(str(i), " ".join(rng.choices(vocabulary, k=rng.randint(0, 12)))) for i in range(8)] + [("9", None), ("0", "zz")]
    texts = [" ".join(rng.choices([*vocabulary, "zz", "q"], k=rng.randint(0, 60))) for _ in range(60)] + [None, "", "..."]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, item_id string")
    bench = spark.createDataFrame(items, "item_id string, text string")
    for r in D.scan(docs, bench, window=4, block_words=block_words).collect():
        n, hit, found = brute(texts[r.doc_id], [x for x in items if x[1]], 4)
        assert r.n_words == n and set(r.hit_items) == found
        assert {k for s in r.hit_spans for k in range(s["start"], s["end"])} == hit


def test_remove(spark):
    items = spark.createDataFrame([(1, "the Quick brown fox jumps over one lazy dog")], "item_id long, text string")
    rows = [
        (1, "Before, THE quick brown fox, jumps over one lazy DOG. After that comes a long tail of other words", "k"),
        (2, "the quick brown fox jumps over one lazy dog", "k"),
        (3, "Nothing here É", "k"),
        (4, None, None),
        (5, "", None),
    ]
    out = {r.doc_id: r for r in D.remove(spark.createDataFrame(rows, "doc_id long, text string, hit_items string"), items).collect()}
    assert set(out) == {1, 3, 4, 5}
    assert out[1].text == "Before,  . After that comes a long tail of other words"
    assert out[3].text == rows[2][1] and out[4].text is None and out[5].text == ""
    assert D.remove(spark.createDataFrame(rows, "doc_id long, text string, k string").limit(0), items).count() == 0
    none = items.limit(0)
    assert D.remove(spark.createDataFrame(rows, "doc_id long, text string, k string"), none).count() == 5


@pytest.mark.parametrize("block_words", [200_000, 10])
def test_remove_does_not_depend_on_blocks(spark, block_words):
    a, b, c = ("a1 a2 a3 a4 a5 a6 a7 a8", "b1 b2 b3 b4 b5 b6 b7 b8", "a5 a6 a7 a8 c1 c2 c3 c4")
    texts = {
        1: f"{a} x1 x2 x3 x4 {b} y1 y2 y3 y4",  # two thirds hit, by items of two blocks
        2: f"{a} c1 c2 c3 c4 " + " ".join(f"z{i}" for i in range(30)),  # hits that overlap
        3: f"b1 b2 b3 b4 {a} b5 b6 b7 b8 " + " ".join(f"z{i}" for i in range(30)),  # a cut that brings a window together
        4: "z1 z2",
    }
    for order in ([a, b, c], [b, c, a]):
        items = spark.createDataFrame(list(enumerate(order)), "item_id long, text string").coalesce(1)
        docs = spark.createDataFrame([(i, t, "s") for i, t in texts.items()], "doc_id long, text string, hit_spans string")
        got = {r.doc_id: words(r.text) for r in D.remove(docs, items, block_words=block_words).collect()}
        z = [f"z{i}".encode() for i in range(30)]
        assert got == {2: z, 3: z, 4: [b"z1", b"z2"]}
