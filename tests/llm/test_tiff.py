"""TIFF: codings, pages of both byte orders, broken files."""

import random
import struct
import zlib

import numpy as np

from pagemint.llm import tiff


def test_codings():
    rng = random.Random(1)
    for n in [0, 1, 2, 127, 128, 129, 255, 256, 257, 510, 511, 512, 3000, 4093, 4094, 9000, 40000]:
        for raw in (rng.randbytes(n), b"a" * n, bytes(rng.choices(b"ab", k=n))):
            assert tiff.unlzw(tiff.lzw(raw)) == raw and tiff.unpackbits(tiff.packbits(raw)) == raw


def test_known_bytes():
    # the examples of the TIFF 6.0 text: PackBits of section 9, LZW codes of section 13
    packed = bytes.fromhex("fe aa 02 80 00 2a fd aa 03 80 00 2a 22 f7 aa".replace(" ", ""))
    assert tiff.unpackbits(packed) == bytes.fromhex("aaaaaa80002aaaaaaaaa80002a22" + "aa" * 10)
    raw = bytes([7, 7, 7, 8, 8, 7, 7, 6, 6])
    codes = [256, 7, 258, 8, 8, 258, 6, 6, 257]
    bits = "".join(f"{c:09b}" for c in codes)
    assert tiff.lzw(raw) == int(bits.ljust(-(-len(bits) // 8) * 8, "0"), 2).to_bytes(-(-len(bits) // 8), "big")
    assert tiff.unlzw(tiff.lzw(raw)) == raw


def test_round_trip():
    rng = random.Random(2)
    for n in (0, 1, 575, 576, 577, 40000, 36864 * 5 + 3):
        payload = tiff.pad(rng.randbytes(n))
        assert len(payload) % 576 == 0 and payload
        assert b"".join(p[4] for p in tiff.read(tiff.write(payload))) == payload


def big_endian(width=5, height=3, each=3, bits=16):
    """A one-strip file of 16-bit samples with predictor, high byte first."""
    samples = np.random.default_rng(1).integers(0, 1 << bits, (height, width, each), dtype=np.uint16)
    coded = np.diff(samples, axis=1, prepend=np.zeros((height, 1, each), np.uint16)).astype(">u2").tobytes()
    data = zlib.compress(coded)
    fields = [(256, 3, width), (257, 3, height), (258, 3, bits), (259, 3, 8), (273, 4, 8), (277, 3, each), (278, 3, height), (279, 4, len(data)), (317, 3, 2)]
    ifd = struct.pack(">H", len(fields))
    for tag, kind, value in fields:
        ifd += struct.pack(">HHI", tag, kind, 1) + (struct.pack(">HH", value, 0) if kind == 3 else struct.pack(">I", value))
    return b"MM\0*" + struct.pack(">I", 8 + len(data)) + data + ifd + b"\0\0\0\0", samples


def test_big_endian():
    blob, samples = big_endian()
    ((width, height, each, bits, raw),) = tiff.read(blob)
    assert (width, height, each, bits) == (5, 3, 3, 16)
    assert np.array_equal(np.frombuffer(raw, ">u2").reshape(samples.shape), samples)


def test_pages(spark):
    rows = [(1, "x" * 40000, "a"), (2, None, None), (3, "é\n" * 300, "b"), (3, "é\n" * 300, "b")]
    media = tiff.store(spark.createDataFrame(rows, "doc_id long, text string, media string").drop("media"))
    whole = {r.doc_id: bytes(r.payload) for r in tiff.features(media).collect()}
    assert whole == {i: tiff.pad((t or "").encode()) for i, t, _ in rows}
    got = {}
    for r in tiff.pages(media).orderBy("doc_id", "page").collect():
        assert r.error is None
        got.setdefault(r.doc_id, []).append((r.page, bytes(r.samples)))
    assert b"".join(s for _, s in got[1]) == whole[1] and [p for p, _ in got[1]] == [0, 1]
    assert tiff.pages(media.limit(0)).count() == 0


def test_broken_files(spark):
    good = tiff.write(tiff.pad(b"abc"))
    rows = [(1, good[:40]), (2, b"GIF89a"), (3, b""), (4, None), (5, good)]
    got = {r.id: r.error for r in tiff.pages(spark.createDataFrame(rows, "id long, media binary")).collect()}
    assert set(got) == {1, 2, 3, 5} and got[5] is None and all(got[i] for i in (1, 2, 3))


def one_strip(fields, data, order="<", big=False):
    """A file of one page: fields (tag, kind, value) and one strip."""
    out = {"<": b"II", ">": b"MM"}[order] + struct.pack(order + ("HHHQ" if big else "HI"), *((43, 8, 0, 0) if big else (42, 0)))
    at = len(out)
    out += data
    fields = sorted([*fields, (273, 4, at), (279, 4, len(data))])
    entry = order + ("HHQ" if big else "HHI")
    ifd = struct.pack(order + ("Q" if big else "H"), len(fields))
    for tag, kind, value in fields:
        ifd += struct.pack(entry, tag, kind, 1) + struct.pack(order + {3: "H", 4: "I"}[kind], value).ljust(8 if big else 4, b"\0")
    link = struct.pack(order + ("Q" if big else "I"), len(out))
    first = 8 if big else 4
    return out[:first] + link + out[first + len(link) :] + ifd + bytes(8)


def test_few_bits_big_files_and_turned_bytes():
    rng = np.random.default_rng(2)
    for bits in (1, 2, 4):
        want = rng.integers(0, 1 << bits, (7, 13), dtype=np.uint8)
        rows = ["".join(f"{v:0{bits}b}" for v in r) for r in want]
        raw = b"".join(int(r.ljust(-(-len(r) // 8) * 8, "0"), 2).to_bytes(-(-len(r) // 8), "big") for r in rows)
        for turned in (False, True):
            for coding, coded in ((1, raw), (32773, tiff.packbits(raw)), (8, zlib.compress(raw))):
                data = coded.translate(tiff.TURNED_BYTES) if turned else coded
                fields = [(256, 3, 13), (257, 3, 7), (258, 3, bits), (259, 3, coding), (278, 3, 7), *([(266, 3, 2)] if turned else [])]
                for order in "<>":
                    for big in (False, True):
                        ((width, height, each, deep, got),) = tiff.read(one_strip(fields, data, order, big))
                        assert (width, height, each, deep) == (13, 7, 1, bits) and got == want.tobytes()


def test_planes():
    want = np.random.default_rng(3).integers(0, 256, (2, 4, 3), dtype=np.uint8)
    planes = [want[:, :, k].tobytes() for k in range(3)]
    # offsets and counts of the planes lie behind the strips
    blob = b"II*\0" + bytes(4) + b"".join(planes) + struct.pack("<6I", 8, 16, 24, 8, 8, 8)
    fields = [(256, 3, 1, 4), (257, 3, 1, 2), (258, 3, 1, 8), (273, 4, 3, 32), (277, 3, 1, 3), (278, 3, 1, 2), (279, 4, 3, 44), (284, 3, 1, 2)]
    ifd = struct.pack("<H", len(fields)) + b"".join(struct.pack("<HHII", *f) for f in fields) + bytes(4)
    blob = blob[:4] + struct.pack("<I", len(blob)) + blob[8:] + ifd
    assert next(tiff.read(blob))[4] == want.tobytes()


def test_hostile_files(spark):
    page = lambda w, h, more=(), data=bytes(64): one_strip([(256, 4, w), (257, 4, h), (258, 3, 8), (278, 4, h), *more], data)
    bomb = zlib.compress(bytes(10**8))
    tiles = [(322, 3, 0), (323, 3, 0), (324, 4, 8), (325, 4, 64)]
    rows = [
        page(0, 8), page(8, 0), page(1 << 20, 1 << 20), page(8, 8, tiles), page((1 << 32) - 1, (1 << 32) - 1),
        page(9, 8), page(8, 8, [(317, 3, 9)]), b"II*\0" + struct.pack("<I", 8) + b"\xff\xff", b"II+\0" + b"\xff" * 12,
    ]
    good = page(8, 8, [(259, 3, 8)], bomb)  # more than the page needs is not decoded
    df = spark.createDataFrame([(i, b) for i, b in enumerate([*rows, good])], "id long, media binary")
    got = {r.id: (r.error, r.samples and len(r.samples)) for r in tiff.pages(df).collect()}
    assert len(got) == 10 and all(got[i][0] and got[i][1] is None for i in range(9)) and got[9] == (None, 64)
    assert {r.id for r in tiff.features(df).where("error is not null").collect()} == set(range(9))


def test_query(spark, tmp_path):
    import hashlib

    from pagemint.llm import queries

    texts = [None, "", "a" * 577, "é" * 100_000, "x" * 575, "dup", "dup"]
    rows = [(i, t) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(2).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in queries.QUERIES["op5_tiff_media"](spark, str(tmp_path)).collect()}
    assert len(got) == len(texts)
    for i, t in rows:
        raw = (t or "").encode()
        payload, r = tiff.pad(raw), got[i]
        media = tiff.write(payload)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest())
        assert (r.tail_crc32, r.media_bytes, r.media_sha256) == (zlib.crc32(payload[-32:]), len(media), hashlib.sha256(media).hexdigest())
    assert got[5].feature == got[6].feature
