"""Toxicity: automata against edit distances, held-out accuracy, context, awkward inputs."""

import random

import pytest
from pyspark.sql import functions as F

from pagemint.llm import toxicity as X


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_automaton_finds_what_edit_distance_finds():
    rng = random.Random(4)
    terms = ["idiot", "moron", "stupid", "worthless", "disgusting"]
    lexicon = X.Lexicon({t: 5.0 for t in terms}, frozenset(terms), frozenset())
    for _ in range(3000):
        word = list(rng.choice(terms))
        for _ in range(rng.randint(0, 3)):
            at = rng.randrange(len(word) + 1)
            kind = rng.randrange(3)
            if kind == 0:
                word.insert(at, rng.choice("abi1"))
            elif word:
                at = min(at, len(word) - 1)
                word[at : at + 1] = [] if kind == 1 else [rng.choice("abi1")]
        word = "".join(word)
        fits = [edits(t, word) for t in terms if edits(t, word) <= X.edits_allowed(t)]
        weight, d = lexicon.look_up(word)
        assert (weight > 0) == bool(fits), word
        if fits:
            assert d == min(fits)


def test_context():
    scorer = X.Scorer(X.Lexicon({"idiot": 5.0}))
    plain, quoted, aimed = (scorer.features(t)[0] for t in ("an idiot here", 'the word "idiot" here', "you idiot"))
    assert quoted < plain < aimed


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(9)
    clean = [f"word{i}" for i in range(400)]
    bad = ["blorgus", "snarfle", "gribbler"]
    rows, labels = [], []
    for i in range(900):
        words = rng.choices(clean, k=rng.randint(5, 80))
        toxic = i % 5 == 0
        if toxic:
            for _ in range(3):
                words.insert(rng.randrange(len(words)), rng.choice(bad))
        rows.append((i, " ".join(words).capitalize() + ".", "en"))
        labels.append((i, int(toxic), 1))
    rows += [(900, None, None), (901, "", "en"), (902, "what a snarffle", "en"), (903, "word1 " * 50000, None), (None, "blorgus", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    return docs, spark.createDataFrame([*labels, (900, 1, 1), (None, 1, 1), (3, None, None)], "doc_id long, toxic int, quality int")


def test_held_out(corpus):
    docs, labels = corpus
    model = X.learn(docs, labels.where("doc_id % 3 <> 0 or doc_id is null"))
    got = {r.doc_id: r for r in X.score(docs, model).collect()}
    wrong = [i for i in range(0, 900, 3) if got[i].predicted != int(i % 5 == 0)]
    assert len(wrong) <= 6, wrong
    assert got[902].predicted == 1 and got[None].predicted == 1
    assert got[900].predicted == got[901].predicted == got[903].predicted == 0
    assert all(0 <= r.score <= 1 for r in got.values())


def test_without_labels(corpus):
    docs, labels = corpus
    model = X.learn(docs, labels.where(F.lit(False)))
    assert X.score(docs, model).agg(F.max("score")).first()[0] == 0.0
    assert X.score(docs.limit(0), X.learn(docs.limit(0), labels)).count() == 0


def test_automaton_earns_its_place(spark, corpus):
    docs, labels = corpus
    model = X.learn(docs, labels)
    assert set(model.lexicon.weights) >= {"blorgus", "snarfle", "gribbler"} and len(model.lexicon.weights) <= 12
    without = X.Model(X.Lexicon(model.lexicon.weights, frozenset(), model.lexicon.known), model.slope, model.offset)
    planted = [(2000 + i, f"word1 {w} word2 word3 {v}", "en") for i, (w, v) in enumerate([("blorgs", "blorgus"), ("snarffle", "snarfle"), ("gribblr", "gribbler")])]
    alone = [(3000 + i, f"word1 {w} word2 {w}", "en") for i, w in enumerate(["blorgs", "bloorgus", "snarffle", "gribblr", "gribbleer"])]
    more = docs.unionByName(spark.createDataFrame(planted + alone, docs.schema))
    predicted = lambda m: {r.doc_id: r.predicted for r in X.score(more, m).collect()}
    a, b = predicted(model), predicted(without)
    clean = [i for i in range(900) if i % 5]
    assert all(a[i] == b[i] for i in clean)
    assert all(a[i] == 1 and b[i] == 0 for i, _, _ in alone) and all(a[i] == b[i] == 1 for i, _, _ in planted)


def test_near_copies_are_one_witness(spark):
    rng = random.Random(4)
    rows, labels = [], []
    noise = [f"noise{i}" for i in range(40)]
    for i in range(600):
        text = " ".join(rng.choices([f"w{k}" for k in range(300)], k=40))
        toxic = i % 6 == 0
        if toxic:
            text += " blorgus " + rng.choice(["x", "y"])
        if i % 60 == 0:  # near copies of one toxic text
            text = " ".join(noise) + f" blorgus {i}"
        rows.append((i, text))
        labels.append((i, int(toxic)))
    model = X.learn(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert "blorgus" in model.lexicon.weights and not any(t.startswith("noise") and not t.endswith("*") for t in model.lexicon.weights)


def test_words_of_any_length():
    long = "b" * 500 + "lorgus"
    lexicon = X.Lexicon({long: 5.0}, frozenset([long]))
    assert lexicon.look_up(long) == (5.0, 0) and lexicon.look_up(long[:-1])[1] == 1
    assert X.Scorer(lexicon).features(f"a {long} here")[0] == 5.0
