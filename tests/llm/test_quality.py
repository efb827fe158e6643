"""Quality: held-out accuracy, exact cosines, awkward inputs."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagemint.llm import quality as Q


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(1)
    rows, labels = [], []
    for i in range(600):
        words = ["".join(rng.choices("abcdeéi", k=rng.randint(1, 9))) for _ in range(rng.randint(8, 200))]
        kind = rng.choice(["good"] * 5 + ["caps", "junk", "same"])
        if kind == "caps":
            words = [w.upper() + "!!" for w in words]
        elif kind == "junk":
            words = [w + rng.choice(["%%%", "$$$", "&&&"]) for w in words]
        elif kind == "same":
            words = [w for w in words for _ in range(10)]
        rows.append((i, " ".join(words).capitalize() + ".", "en"))
        labels.append((i, int(kind == "good")))
    rows += [(600, None, None), (601, "", "x"), (602, "...", "x"), (603, "WORD!! " * 40000, None), (None, "a b", None), (0, rows[0][1], "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, v string")
    return docs, spark.createDataFrame([*labels, (5, None), (None, 1)], "doc_id long, quality int")


def test_held_out(corpus):
    docs, labels = corpus
    model = Q.learn(docs, labels.where("doc_id % 3 <> 0 or doc_id is null"))
    rows = Q.score(docs, model).collect()
    got, truth = {r.doc_id: r for r in rows}, {r.doc_id: r.quality for r in labels.where("quality is not null").collect()}
    wrong = [i for i in range(0, 600, 3) if got[i].predicted != truth[i]]
    assert len(wrong) <= 4, wrong
    assert got[603].predicted == 0
    assert got[600].score == got[601].score == got[602].score == round(model.mean, 9)
    assert len(rows) == 606 and all(0 <= r.score <= 1 for r in rows)


def test_votes_are_exact(corpus):
    docs, labels = corpus
    model = Q.learn(docs, labels, neighbours=7)
    texts = [r.text for r in docs.where("doc_id < 40").collect()]
    vectors = np.stack([Q.vector(t) for t in texts])
    got = model.vote(vectors)
    z = model.latent(vectors)
    for i in range(len(texts)):
        near = sorted((j for j in range(len(model.labels)) if float(z[i] @ model.known[j]) <= 1 - Q.SAME), key=lambda j: -float(z[i] @ model.known[j]))[:7]
        w = np.array([max(0.0, float(z[i] @ model.known[j])) ** model.power + 1e-9 for j in near])
        assert abs(got[i] - (w * model.labels[near]).sum() / w.sum()) < 1e-3


def test_without_labels(corpus):
    docs, labels = corpus
    assert {r.score for r in Q.score(docs, Q.learn(docs, labels.where(F.lit(False)))).collect()} == {0.5}
    assert Q.score(docs.limit(0), Q.learn(docs, labels)).count() == 0


def test_own_label_has_no_vote(corpus):
    docs, labels = corpus
    model = Q.learn(docs, labels, neighbours=7)
    v = np.stack([Q.vector(r.text) for r in docs.where("doc_id = 3").collect()])
    before = model.vote(v)
    own = (model.latent(v) @ model.known.T > 1 - Q.SAME).any(axis=0)
    assert own.any()
    model.labels = np.where(own, 1 - model.labels, model.labels)
    assert abs(model.vote(v) - before).max() < 1e-9
