"""The registered queries over a small folder of tables, each against plain Python or a second engine."""

import hashlib
import random
import re
import struct
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
import tiktoken

from pagemint.llm import bpe, oracles, queries

WORDS = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(12)
    vocabulary = [f"w{i}é" if i % 5 == 0 else f"word{i}" for i in range(400)]
    prose = lambda n: " ".join(rng.choices(vocabulary, k=n))
    items = [("a1", prose(20)), ("b2", prose(9)), ("c3", "three short words"), ("d4", None), ("e5", prose(30))]
    passage, texts = prose(60), [None, "", " ", "short", "x" * 400]
    for i in range(120):
        text = prose(rng.randint(5, 120))
        if i % 10 == 0:
            text = f"{text} {passage} {prose(5)}"
        if i % 12 == 1:
            text += f" {items[i % 5][1]} {items[0][1]}"
        if i % 15 == 2:
            text += "\nReleased under the MIT License. mail me: a@b.org, token=abcdef1234"
        if i % 6 == 0:
            text += " what a snarfle blorgus"
        texts += [text] if i % 20 else [text, text]
    rows = [(i, t, ("en", "de", None)[i % 3], f"s{i % 4}", 0) for i, t in enumerate(texts)]
    labels = [(i, int("snarfle" not in (t or "")), int("snarfle" in (t or ""))) for i, t in enumerate(texts) if i % 3]
    path = str(tmp_path_factory.mktemp("tables"))
    write = lambda name, rows, schema: spark.createDataFrame(rows, schema).repartition(3).write.parquet(f"{path}/{name}.parquet")
    write("documents", rows, "doc_id long, text string, lang string, source string, n_chars long")
    write("labels", labels, "doc_id long, quality int, toxic int")
    write("benchmark", items, "item_id string, text string")
    return path, dict(enumerate(texts)), items


def run(spark, corpus, name):
    got = queries.QUERIES[name](spark, corpus[0]).collect()
    assert sorted(r.doc_id for r in got) == sorted(corpus[1])
    return {r.doc_id: r for r in got}


def test_op1(spark, corpus):
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, special_tokens={}, mergeable_ranks={t: i for i, t in enumerate(bpe.read_ranks(ranks))})
    for i, r in run(spark, corpus, "op1_bpe_round_trip").items():
        ids = encoding.encode_ordinary(corpus[1][i] or "")
        assert (r.n_tokens, r.ids_sha256) == (len(ids), sha(struct.pack(f"<{len(ids)}I", *ids)))
        assert r.decoded_sha256 == sha(corpus[1][i] or "")


def test_op4(spark, corpus):
    words = lambda t: WORDS.findall((t or "").encode().lower())
    windows = {}
    for item, t in corpus[2]:
        ws = words(t)
        size = min(8, len(ws))
        for k in range(len(ws) - size + 1 if size else 0):
            windows.setdefault(tuple(ws[k : k + size]), set()).add(item)
    for i, r in run(spark, corpus, "op4_decontaminate").items():
        ws = words(corpus[1][i])
        hit, found = set(), set()
        for size in {len(w) for w in windows}:
            for k in range(len(ws) - size + 1):
                if tuple(ws[k : k + size]) in windows:
                    hit.update(range(k, k + size))
                    found |= windows[tuple(ws[k : k + size])]
        want = (len(ws), len(hit), len(found), sha(",".join(sorted(found))), len(found) >= 2)
        assert (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) == want


def test_op6(spark, corpus):
    from collections import Counter

    raws = {i: (t or "").encode() for i, t in corpus[1].items()}
    counts = Counter(r[k : k + 200] for r in raws.values() for k in range(len(r) - 199))
    for i, r in run(spark, corpus, "op6_suffix_dedup").items():
        raw = raws[i]
        gone = np.zeros(len(raw) + 2, bool)
        for k in range(len(raw) - 199):
            if counts[raw[k : k + 200]] > 1:
                gone[k + 1 : k + 201] = True
        kept = bytes(b for b, g in zip(raw, gone[1:]) if not g)
        spans = int((np.diff(gone.astype(np.int8)) == 1).sum())
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == (len(raw), len(raw) - len(kept), spans, sha(kept))


def test_op7(spark, corpus):
    from test_simhash import brute_components, brute_print

    prints = {i: brute_print(t) for i, t in corpus[1].items()}
    want = brute_components(prints)
    for i, r in run(spark, corpus, "op7_simhash_dedup").items():
        assert (r.fingerprint, r.component_id) == (f"{prints[i]:016x}", want[i])


@pytest.mark.parametrize("name", sorted(oracles.ORACLES))
def test_sql(spark, corpus, name):
    con = duckdb.connect()
    for table in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{corpus[0]}/{table}.parquet/*.parquet')")
    got = queries.QUERIES[name](spark, corpus[0])
    rows = con.execute(f"SELECT {', '.join(got.columns)} FROM ({oracles.ORACLES[name]})").fetchall()
    assert sorted(map(str, rows)) == sorted(str(tuple(r)) for r in got.collect())


@pytest.mark.parametrize("name, label, modulus, rest", [("op9_toxicity", "toxic", 4, 2), ("op10_quality", "quality", 5, 0)])
def test_learned(spark, corpus, name, label, modulus, rest):
    known = {r.doc_id: r[label] for r in spark.read.parquet(f"{corpus[0]}/labels.parquet").collect()}
    got = run(spark, corpus, name)
    for i, r in got.items():
        assert r.held_out == (zlib.crc32(str(i).encode()) % modulus == rest)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
    if label == "toxic":
        wrong = [i for i, r in got.items() if r.held_out and i in known and r.predicted != known[i]]
        assert len(wrong) <= 1
    same = {}
    for i, t in corpus[1].items():
        assert same.setdefault(t or "", got[i].score) == got[i].score
