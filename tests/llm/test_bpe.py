"""Byte-level BPE against tiktoken, and round trips."""

import random
import struct

import public_tokenizers as P
import pytest
import tiktoken

from pagemint.llm import bpe

RANKS = P.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def tokens():
    return bpe.read_ranks(RANKS)


def texts():
    rng = random.Random(1)
    odd = lambda: rng.choice([rng.randrange(1, 0xD7FF), rng.randrange(0xE000, 0x3FFFF), rng.randrange(32, 127), 32, 10])
    made = ["".join([chr(odd()) for _ in range(60)]) for _ in range(300)]
    fixed = ["", " ", "<|endoftext|>", "I'm we'll 　日本語 🎉", "a" * 5000, "zé" * 500, "¡¢­\xad" * 20, "<unk><s></s>▁▁", "x\x00y"]
    return fixed + made


def test_equals_tiktoken(tokens):
    codec = bpe.Codec(tokens, P.PATTERN)
    theirs = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks={t: i for i, t in enumerate(tokens)}, special_tokens={})
    for text in texts():
        want = theirs.encode_ordinary(text)
        assert codec.encode(text) == struct.pack(f"<{len(want)}I", *want), text
        assert codec.decode(codec.encode(text)) == text.encode()


def test_dataframes(spark):
    rows = [(i, t, "x") for i, t in enumerate(texts()[:40])] + [(None, None, None), (1, " ", "x"), (1, " ", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    one = bpe.decode(bpe.encode(df, RANKS, P.PATTERN), RANKS).drop("text").collect()
    two = bpe.round_trip(df, RANKS, P.PATTERN).collect()
    assert sorted(map(str, ((r.doc_id, r.ids, r.decoded) for r in one))) == sorted(map(str, ((r.doc_id, r.ids, r.decoded) for r in two)))
    want = {(i, (t or "").encode()) for i, t, _ in rows}
    assert {(r.doc_id, bytes(r.decoded)) for r in two} == want
    assert bpe.round_trip(df.limit(0), RANKS, P.PATTERN).count() == 0
