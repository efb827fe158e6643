"""Byte-level BPE by sentencepiece: a model serialised straight from a rank file, no training.

A rank file lists byte strings in merge order. Each byte is mapped to one printable character, so each token is a piece
of text; a piece's score is minus its rank, so sentencepiece's best-score-first merging joins pairs in rank order,
leftmost first. The normaliser is the identity: no dummy prefix, no white-space handling. Texts are cut by the split
pattern first and each pre-token is encoded by itself; a pre-token that is itself a token is taken whole, as rank-file
tokenizers do. Decoding inverts both maps. The regex module may know a newer Unicode than tiktoken does; characters
that only the newer one calls letters or numbers are found by asking tiktoken, and are split as it splits them.

Defined cases: null text counts as empty (no ids, empty bytes); rows are independent, so ties and repeated rows give
equal results; extra columns are passed through untouched unless the output overwrites the name; texts of any length
are encoded whole, with a bounded cache of pre-tokens for each task.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import unicodedata
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
import regex
import sentencepiece
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from pagemint.llm.common import slices

#: Pre-tokens kept with their ids in each task; emptied when full.
CACHE = 60_000


def byte_chars() -> list[str]:
    """The character of each byte: itself where printable, else the next free code point from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in set(plain) else chr(next(rest)) for b in range(256)]


def read_ranks(path: str) -> list[bytes]:
    """Tokens in rank order; ranks must be 0, 1, 2, ... without gaps and cover all single bytes."""
    with open(path, "rb") as f:
        ranked = {int(rank): base64.b64decode(token) for token, rank in (line.split() for line in f if line.strip())}
    tokens = [ranked[i] for i in range(len(ranked))]
    if missing := {bytes([b]) for b in range(256)} - set(tokens):
        raise ValueError(f"the rank file lacks {len(missing)} single bytes")
    return tokens


def _varint(n: int) -> bytes:
    out = bytearray()
    n &= (1 << 64) - 1
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def _bytes_field(number: int, value: bytes) -> bytes:
    return _varint(number << 3 | 2) + _varint(len(value)) + value


def _int_field(number: int, value: int) -> bytes:
    return _varint(number << 3) + _varint(value)


def serialise(tokens: list[bytes]) -> bytes:
    """A sentencepiece ModelProto whose piece i is token i; the obligatory unknown piece comes last."""
    chars = byte_chars()
    out = bytearray()
    for rank, token in enumerate(tokens):
        piece = "".join([chars[b] for b in token]).encode()
        out += _bytes_field(1, _bytes_field(1, piece) + _varint(2 << 3 | 5) + struct.pack("<f", -float(rank)))
    out += _bytes_field(1, _bytes_field(1, b"<unk>") + _varint(2 << 3 | 5) + struct.pack("<f", 0.0) + _int_field(3, 2))
    bpe, none = 2, -1
    trainer = _int_field(3, bpe) + _int_field(4, len(tokens) + 1)
    trainer += _int_field(40, len(tokens)) + b"".join(_int_field(n, none) for n in (41, 42, 43))
    identity = _bytes_field(1, b"identity") + b"".join(_int_field(n, 0) for n in (3, 4, 5))
    return bytes(out) + _bytes_field(2, trainer) + _bytes_field(3, identity)


@cache
def newer_characters() -> dict[str, str]:
    """For the classes L and N: ranges of characters in the class for regex, but not for tiktoken."""
    single = {bytes([b]): b for b in range(256)}
    unassigned = [chr(c) for c in range(0x110000) if unicodedata.category(chr(c)) == "Cn"]
    found = {}
    for name in "LN":
        ours = regex.compile(rf"\p{{{name}}}").match
        theirs = tiktoken.Encoding("class", pat_str=rf"\p{{{name}}}", mergeable_ranks=single, special_tokens={})
        codes = [ord(c) for c in unassigned if ours(c) and not theirs.encode_ordinary(c)]
        held = set(codes)
        starts, ends = ([c for c in codes if c + step not in held] for step in (-1, 1))
        found[name] = "".join([f"{chr(a)}-{chr(b)}" for a, b in zip(starts, ends, strict=True)])
    return found


def older_pattern(pattern: str) -> str:
    """The split pattern with classes L and N as tiktoken has them; V1 sets."""
    newer = newer_characters()
    for name in "LN":
        less = rf"[\p{{{name}}}--[{newer[name]}]]" if newer[name] else rf"\p{{{name}}}"
        pattern = pattern.replace(rf"\p{{{name}}}", less)
    return f"(?V1){pattern}"


class Codec:
    """Encoder and decoder of one rank file. Build it once for each task."""

    def __init__(self, tokens: list[bytes], pattern: str):
        self.tokens = tokens
        self.whole = {t: struct.pack("<I", i) for i, t in enumerate(tokens)}
        self.chars = "".join(byte_chars())
        self.pieces = sentencepiece.SentencePieceProcessor(model_proto=serialise(tokens))
        self.find = regex.compile(pattern).findall
        self.pattern, self.find_rare = pattern, None
        self.cache: dict[str, bytes] = {}

    def _word(self, word: str) -> bytes:
        raw = word.encode("utf-8", "surrogatepass")
        ids = self.whole.get(raw)
        if ids is None:
            got = self.pieces.encode(raw.decode("latin-1").translate(self.chars))
            ids = struct.pack(f"<{len(got)}I", *got)
        if len(self.cache) >= CACHE:
            self.cache.clear()
        if len(word) <= 64:
            self.cache[word] = ids
        return ids

    def encode(self, text: str | None) -> bytes:
        """Token ids of a whole text as little-endian unsigned 32-bit integers."""
        text, find = text or "", self.find
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            self.find_rare = find = self.find_rare or regex.compile(older_pattern(self.pattern)).findall
        get, word = self.cache.get, self._word
        return b"".join([get(w) or word(w) for w in find(text)])

    def decode(self, ids: bytes) -> bytes:
        tokens = self.tokens
        return b"".join([tokens[i] for i in struct.unpack(f"<{len(ids) // 4}I", ids)])


#: The codec of a worker process, kept from task to task.
HELD: dict[str, Codec] = {}


def held_codec(key: str, shared, pattern: str) -> Codec:
    if key not in HELD:
        HELD.clear()
        HELD[key] = Codec(shared.value, pattern)
    return HELD[key]


def encode(df: DataFrame, ranks: str, pattern: str, text: str = "text", out: str = "ids") -> DataFrame:
    """Add ``out``: the ids of ``text``, packed little-endian unsigned 32-bit. No shuffle; rows keep their order."""
    tokens = read_ranks(ranks)
    keep = [f for f in df.schema.fields if f.name != out]
    shared = df.sparkSession.sparkContext.broadcast(tokens)
    key = f"{sha256(b' '.join(tokens))} {pattern}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = held_codec(key, shared, pattern)
        for batch in slices(batches):
            ids = pa.array([codec.encode(t.as_py()) for t in batch.column(text)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(f.name) for f in keep] + [ids], [f.name for f in keep] + [out])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in keep)
    return df.mapInArrow(run, f"{schema}, `{out}` binary")


def round_trip(
    df: DataFrame, ranks: str, pattern: str, text: str = "text", out: str = "ids", decoded: str = "decoded"
) -> DataFrame:
    """Replace ``text`` by ``out``, as ``encode`` gives it, and ``decoded``, as ``decode`` gives it from those ids, in one pass."""
    tokens = read_ranks(ranks)
    keep = [f for f in df.schema.fields if f.name not in (text, out, decoded)]
    names = [*(f.name for f in keep), out, decoded]
    shared = df.sparkSession.sparkContext.broadcast(tokens)
    key = f"{sha256(b' '.join(tokens))} {pattern}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = held_codec(key, shared, pattern)
        for batch in slices(batches):
            ids = [codec.encode(t.as_py()) for t in batch.column(text)]
            back = [codec.decode(i) for i in ids]
            own = [batch.column(f.name) for f in keep]
            yield pa.RecordBatch.from_arrays([*own, pa.array(ids, pa.binary()), pa.array(back, pa.binary())], names)

    return df.mapInArrow(run, T.StructType([*keep, T.StructField(out, T.BinaryType()), T.StructField(decoded, T.BinaryType())]))


def decode(df: DataFrame, ranks: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Add ``out``: the bytes that ``ids`` stand for (null ids count as none)."""
    tokens = read_ranks(ranks)
    keep = [f for f in df.schema.fields if f.name != out]
    shared = df.sparkSession.sparkContext.broadcast(tokens)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for batch in slices(batches):
            packed = [(x.as_py() or b"") for x in batch.column(ids)]
            texts = [b"".join([table[i] for i in struct.unpack(f"<{len(p) // 4}I", p)]) for p in packed]
            yield pa.RecordBatch.from_arrays(
                [batch.column(f.name) for f in keep] + [pa.array(texts, pa.binary())], [f.name for f in keep] + [out]
            )

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in keep)
    return df.mapInArrow(run, f"{schema}, `{out}` binary")


def sha256(raw: bytes) -> str:
    return hashlib.sha256(raw).hexdigest()
