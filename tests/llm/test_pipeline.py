"""The pipeline's stages against plain Python on a planted corpus."""

import random
import re
import struct

import public_tokenizers
import pytest
import tiktoken

import corpus_pipeline as P
from pagemint.llm import bpe


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(6)
    vocabulary = [f"lor{i}em" for i in range(3000)]
    prose = lambda n: " ".join(rng.choices(vocabulary, k=n))
    items = [(i, prose(30)) for i in range(5)]
    rows, labels, want = [], [], {}
    for i in range(400):
        text = prose(rng.randint(150, 250))
        want[i] = "keep"
        if i % 8 == 0:
            text, want[i] = f"{text} {rng.choice(['blorgus', 'snarfler'])} {prose(3)} blorgus", "toxic"
        elif i % 8 == 1:
            text, want[i] = f"{text} {items[i % 5][1]} {prose(20)}", "cut"
        elif i % 8 == 2:
            text, want[i] = f"{text} mail me: a.b{i}@c.org {prose(4)}", "pii"
        elif i % 8 == 3:
            text, want[i] = items[i % 5][1] + " tail", "mostly benchmark"
        rows.append((i, text, "en", "s", len(text)))
        labels.append((i, 1, int(want[i] == "toxic")))
    for i in range(400, 420):
        source = rows[(i - 400) * 8 + 4]
        words = source[1].split()
        words[3] = "changed"
        rows.append((i, source[1] if i % 2 else " ".join(words), "en", "s", 1))
        want[i] = "copy"
    rows += [(420, None, None, None, None), (421, "", "en", "s", 0)]
    path = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, {r[0]: r[1] for r in rows}, want, items


def test_run(spark, folder):
    path, texts, want, items = folder
    out = {r.doc_id: r for r in P.run(spark, path).collect()}
    copies_of_short = {i for i in want if want[i] == "mostly benchmark"}
    assert not set(out) & {i for i in want if want[i] in ("toxic", "copy")}
    assert not set(out) & copies_of_short
    assert {i for i in want if want[i] in ("keep", "cut", "pii")} <= set(out)
    assert len(set(out) & {420, 421}) == 1
    encoding = tiktoken.Encoding(
        "own", pat_str=public_tokenizers.PATTERN, special_tokens={},
        mergeable_ranks={t: i for i, t in enumerate(bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")))},
    )
    windows = {tuple(t.split()[k : k + 8]) for _, t in items for k in range(len(t.split()) - 7)}
    for i, r in out.items():
        if i >= 420:
            continue
        words = r.text.split()
        assert not any(tuple(words[k : k + 8]) in windows for k in range(len(words)))
        if want[i] == "keep":
            assert r.text == texts[i]
        elif want[i] == "pii":
            assert r.text == re.sub(r"\S+@\S+", "[email]", texts[i])
        assert r.n_chars == len(r.text)
        ids = encoding.encode_ordinary(r.text)
        assert r.n_tokens == len(ids) and bytes(r.ids) == struct.pack(f"<{len(ids)}I", *ids)


def test_extra_columns(spark, folder, tmp_path):
    path = folder[0]
    names = ["score", "predicted", "pii", "ids", "kept_id", "hit_spans", "count", "label", "features"]
    docs = spark.read.parquet(f"{path}/documents.parquet").limit(40).selectExpr("*", *(f"concat('own ', doc_id) as {n}" for n in names))
    for name, stage in P.STAGES:
        docs.write.parquet(f"{tmp_path}/{name}")
        docs = stage(spark, spark.read.parquet(f"{tmp_path}/{name}"), path)
    for r in docs.collect():
        own = {n: getattr(r, n) for n in names if n not in ("ids", "count")}
        assert set(own.values()) == ({f"own {r.doc_id}"} if r.doc_id is not None else {None})


def test_stage_columns(spark, folder):
    path = folder[0]
    docs = spark.read.parquet(f"{path}/documents.parquet")
    for name, stage in P.STAGES[:-1]:
        assert stage(spark, docs, path).columns == docs.columns, name
    assert len(P.STAGES) == 5
