"""Media columns: TIFF. A reader that emits one row per page, and a writer for lossless 8-bit samples.

The reader walks the image directories (both byte orders, plain and big files; a directory offset seen before ends the walk),
reads strips or tiles, decodes none, PackBits, LZW or deflate, turns bytes round where the file fills them from the low bit,
undoes the horizontal predictor of 8- and 16-bit samples, and gives chunky samples row by row, planes put together. Samples
of 1, 2 and 4 bits come as one byte each. The writer lays a payload out as grey 8-bit pages of 576 columns and at most
``PAGE_ROWS`` rows and goes through the codings and layouts by page and size, so stored forms of all kinds are read back.

``by_file`` folds the page rows of each file as they come, page by page: digests, histogram and last bytes of all samples.

Defined cases: null and empty payloads are padded like any other (one row of 255s); equal payloads give equal files; a
truncated, foreign or hostile blob gives one row with ``error`` set and no samples, not a failure: sizes are held against
strips or tiles and ``most_bytes`` before anything is laid out, and no part is decoded beyond its size; a null blob gives no
row; other columns are repeated on each page row, those named like an output are replaced. A file is decoded page by page.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from pagemint.llm.common import slices

WIDTH = 576
PAGE_ROWS = 64
NONE, LZW, DEFLATE, PACKBITS, OLD_DEFLATE = 1, 5, 8, 32773, 32946
#: Bytes of each field type of a directory entry, by number.
SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8, 16: 8}
CODES = {1: "B", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i", 16: "Q"}
#: Samples of one page that are laid out; a page of more is an error row.
MOST_BYTES = 1 << 28
TURNED_BYTES = bytes(int(f"{b:08b}"[::-1], 2) for b in range(256))
#: What reading a bad file may raise.
BAD_FILE = (ValueError, struct.error, zlib.error, LookupError, ArithmeticError, MemoryError)


def pad(raw: bytes) -> bytes:
    """The payload: ``raw`` and bytes 255 up to a positive multiple of WIDTH."""
    return raw + b"\xff" * (-len(raw) % WIDTH or (0 if raw else WIDTH))


# --- codings -----------------------------------------------------------------------------------------------------


def packbits(raw: bytes) -> bytes:
    """Runs of three or more equal bytes as runs, the rest as literals, at most 128 each."""
    if not raw:
        return b""
    a = np.frombuffer(raw, np.uint8)
    edges = np.flatnonzero(np.diff(a)) + 1
    starts = np.concatenate(([0], edges))
    sizes = np.diff(np.concatenate((starts, [len(a)])))
    out, at = bytearray(), 0

    def literal(end: int) -> None:
        for i in range(at, end, 128):
            part = raw[i : min(i + 128, end)]
            out.append(len(part) - 1)
            out.extend(part)

    for s, n in zip(starts[sizes > 2].tolist(), sizes[sizes > 2].tolist()):
        literal(s)
        for i in range(0, n, 128):
            if (k := min(128, n - i)) == 1:
                out.extend((0, raw[s]))
            else:
                out.extend((257 - k, raw[s]))
        at = s + n
    literal(len(raw))
    return bytes(out)


def unpackbits(data: bytes, most: int = MOST_BYTES) -> bytes:
    out, at, size = [], 0, 0
    while at < len(data) and size < most:
        n = data[at]
        size += n + 1 if n < 128 else 257 - n
        if n < 128:
            out.append(data[at + 1 : at + 2 + n])
            at += 2 + n
        elif n > 128:
            out.append(data[at + 1 : at + 2] * (257 - n))
            at += 2
        else:
            at += 1
    return b"".join(out)


SINGLE = [bytes([b]) for b in range(256)]


def lzw(raw: bytes) -> bytes:
    """Codes of 9 to 12 bits, high bit first; a clear code at the start and when the table is full."""
    fresh = {s: i for i, s in enumerate(SINGLE)}
    known, width, codes, prefix = dict(fresh), 9, [(256, 9)], b""
    for one in map(SINGLE.__getitem__, raw):
        longer = prefix + one
        if longer in known:
            prefix = longer
            continue
        codes.append((known[prefix], width))
        known[longer] = n = len(known) + 2
        if n == 4093:
            codes.append((256, width))
            known, width = dict(fresh), 9
        elif n >= (1 << width) - 1:
            width += 1
        prefix = one
    if prefix:
        codes.append((known[prefix], width))
        if len(known) + 2 >= (1 << width) - 1 and width < 12:
            width += 1
    codes.append((257, width))
    c = np.array(codes, np.int64)
    bits = ((c[:, :1] >> np.arange(11, -1, -1)) & 1).astype(np.uint8)
    return np.packbits(bits[np.arange(12) >= 12 - c[:, 1:]]).tobytes()


def unlzw(data: bytes, most: int = MOST_BYTES) -> bytes:
    out: list[bytes] = []
    size = 0
    held, bits, width, last = 0, 0, 9, b""
    table = [*SINGLE, b"", b""]
    for byte in data:
        held = (held << 8 | byte) & 0xFFFFFF
        bits += 8
        if bits < width:
            continue
        bits -= width
        code = held >> bits & (1 << width) - 1
        if code == 257:
            break
        if code == 256:
            table, width, last = [*SINGLE, b"", b""], 9, b""
            continue
        if code < len(table):
            entry = table[code]
        elif code == len(table) and last:
            entry = last + last[:1]
        else:
            raise ValueError("a code beyond the LZW table")
        out.append(entry)
        size += len(entry)
        if size >= most:
            break
        if last and len(table) < 4096:
            table.append(last + entry[:1])
            if len(table) >= (1 << width) - 1 and width < 12:
                width += 1
        last = entry
    return b"".join(out)


def unpack(data: bytes, coding: int, most: int) -> bytes:
    """At least the first ``most`` bytes that are coded, if there are as many, and not many more."""
    if coding == NONE:
        return data
    if coding == LZW:
        return unlzw(data, most)
    if coding in (DEFLATE, OLD_DEFLATE):
        return zlib.decompressobj().decompress(data, max(1, most))
    if coding == PACKBITS:
        return unpackbits(data, most)
    raise ValueError(f"coding {coding} is not known")


def pack(raw: bytes, coding: int) -> bytes:
    return {NONE: bytes, LZW: lzw, DEFLATE: lambda r: zlib.compress(r, 1), PACKBITS: packbits}[coding](raw)


# --- writing -----------------------------------------------------------------------------------------------------


def write(payload: bytes) -> bytes:
    """A little-endian file of grey pages that hold the payload; coding and layout go round by page and size."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    out, link = bytearray(b"II*\0\0\0\0\0"), 4
    for n, top in enumerate(range(0, len(rows), PAGE_ROWS)):
        page = rows[top : top + PAGE_ROWS]
        kind = (n + len(rows)) % 4
        coding = (DEFLATE, LZW, PACKBITS, DEFLATE)[kind]
        predictor = 2 if kind == 0 else 1
        if kind == 3:  # tiles, the last ones filled with zeros
            size = 64
            full = np.zeros((-(-len(page) // size) * size, WIDTH), np.uint8)
            full[: len(page)] = page
            parts = [full[y : y + size, x : x + size] for y in range(0, len(full), size) for x in range(0, WIDTH, size)]
        else:
            size = 16
            parts = [page[y : y + size] for y in range(0, len(page), size)]
        offsets, counts = [], []
        for part in parts:
            if predictor == 2:
                part = np.diff(part, axis=1, prepend=np.uint8(0))
            data = pack(part.tobytes(), coding)
            offsets.append(len(out))
            counts.append(len(data))
            out += data
        fields = [(256, 3, [WIDTH]), (257, 3, [len(page)]), (258, 3, [8]), (259, 3, [coding]), (262, 3, [1])]
        if kind != 3:
            fields.append((273, 4, offsets))
        fields.append((277, 3, [1]))
        if kind != 3:
            fields += [(278, 3, [size]), (279, 4, counts)]
        fields.append((317, 3, [predictor]))
        if kind == 3:
            fields += [(322, 3, [size]), (323, 3, [size]), (324, 4, offsets), (325, 4, counts)]
        out += b"\0" * (len(out) % 2)
        entries = b""
        for tag, kind_of, values in fields:
            data = struct.pack(f"<{len(values)}{CODES[kind_of]}", *values)
            if len(data) > 4:
                at = len(out)
                out += data
                data = struct.pack("<I", at)
            entries += struct.pack("<HHI", tag, kind_of, len(values)) + data.ljust(4, b"\0")
        out[link : link + 4] = struct.pack("<I", len(out))
        out += struct.pack("<H", len(fields)) + entries
        link = len(out)
        out += b"\0\0\0\0"
    return bytes(out)


# --- reading -----------------------------------------------------------------------------------------------------


def directories(blob: bytes) -> Iterator[dict[int, list[int]]]:
    """Whole-number fields of each image directory, in file order."""
    order = {b"II": "<", b"MM": ">"}.get(blob[:2])
    version = struct.unpack(order + "H", blob[2:4])[0] if order else 0
    if version not in (42, 43):
        raise ValueError("no TIFF header")
    # forms of an offset, of the number of entries and of an entry up to its value, and the bytes of a value in place
    offset, number, entry, first = ("I", "H", "HHI", 4) if version == 42 else ("Q", "Q", "HHQ", 8)
    room, size = struct.calcsize("=" + offset), struct.calcsize("=" + entry)
    (at,) = struct.unpack_from(order + offset, blob, first)
    seen = set()
    while at and at not in seen:
        seen.add(at)
        (n,) = struct.unpack_from(order + number, blob, at)
        start = at + struct.calcsize("=" + number)
        if start + n * (size + room) > len(blob):
            raise ValueError("a directory lies beyond the file")
        fields = {}
        for k in range(n):
            where = start + k * (size + room)
            tag, kind, count = struct.unpack_from(order + entry, blob, where)
            where += size
            if kind not in CODES:
                continue
            if count * SIZES[kind] > room:
                (where,) = struct.unpack_from(order + offset, blob, where)
            if where + count * SIZES[kind] > len(blob):
                raise ValueError("a field lies beyond the file")
            fields[tag] = list(struct.unpack_from(f"{order}{count}{CODES[kind]}", blob, where))
        yield fields | {0: [ord(order)]}
        (at,) = struct.unpack_from(order + offset, blob, start + n * (size + room))


def samples(blob: bytes, fields: dict[int, list[int]], most_bytes: int = MOST_BYTES) -> tuple[int, int, int, int, bytes]:
    """Width, height, samples a pixel, bits a sample and the samples of one page."""
    one = lambda tag, default: fields.get(tag, [default])[0]
    width, height, each, bits = fields[256][0], fields[257][0], one(277, 1), one(258, 1)
    coding, predictor, turned = one(259, NONE), one(317, 1), one(266, 1) == 2
    if bits not in (1, 2, 4, 8, 16) or len(set(fields.get(258, [bits]))) > 1:
        raise ValueError(f"{fields.get(258)} bits a sample are not read")
    if predictor not in (1, 2) or predictor == 2 and bits < 8:
        raise ValueError(f"predictor {predictor} is not known for {bits} bits")
    planes, chunk = (each, 1) if one(284, 1) == 2 else (1, each)
    order = chr(fields[0][0])
    kind = np.dtype(f"{order}u2") if bits == 16 else np.dtype("u1")
    tiled = 322 in fields
    across, down = (fields[322][0], fields[323][0]) if tiled else (width, min(one(278, height), height))
    offsets, counts = (fields[324], fields[325]) if tiled else (fields[273], fields[279])
    if min(width, height, each, across, down) < 1:
        raise ValueError("a size is zero")
    columns = -(-width // across)
    parts = columns * -(-height // down)
    if len(offsets) != parts * planes or len(counts) != len(offsets):
        raise ValueError(f"{len(offsets)} strips or tiles, {parts * planes} wanted")
    if max(width * height * each, across * down * chunk) * kind.itemsize > most_bytes:
        raise ValueError(f"a page of more than {most_bytes} bytes")
    if any(at + n > len(blob) for at, n in zip(offsets, counts)):
        raise ValueError("a strip or tile lies beyond the file")
    page = np.zeros((height, width, each), kind)
    row_bytes = -(-across * chunk * bits // 8)
    for k, (at, n) in enumerate(zip(offsets, counts)):
        plane, k = divmod(k, parts)
        y, x = k // columns * down, k % columns * across
        tall = down if tiled else min(down, height - y)
        data = blob[at : at + n]
        raw = unpack(data.translate(TURNED_BYTES) if turned else data, coding, tall * row_bytes)
        if bits < 8:
            set_bits = np.unpackbits(np.frombuffer(raw, np.uint8, tall * row_bytes).reshape(tall, row_bytes), axis=1)
            weights = 1 << np.arange(bits - 1, -1, -1, dtype=np.uint8)
            part = (set_bits[:, : across * chunk * bits].reshape(tall, across, chunk, bits) * weights).sum(axis=3, dtype=np.uint8)
        else:
            part = np.frombuffer(raw, kind, tall * across * chunk).reshape(tall, across, chunk)
        if predictor == 2:
            part = np.cumsum(part, axis=1, dtype=kind.newbyteorder("="))
        fit = page[y : y + tall, x : x + across, plane * chunk : (plane + 1) * chunk] if planes > 1 else page[y : y + tall, x : x + across]
        fit[:] = part[: fit.shape[0], : fit.shape[1]]
    return width, height, each, bits, page.tobytes()


def read(blob: bytes) -> Iterator[tuple[int, int, int, int, bytes]]:
    for fields in directories(blob):
        yield samples(blob, fields)


# --- DataFrames --------------------------------------------------------------------------------------------------

PAGE = T.StructType(
    [
        *(T.StructField(n, T.LongType()) for n in ("page", "width", "height", "samples_per_pixel", "bits")),
        T.StructField("samples", T.BinaryType()),
        T.StructField("error", T.StringType()),
    ]
)


def store(docs: DataFrame, text: str = "text", out: str = "media") -> DataFrame:
    """Replace ``text`` by ``out``: the TIFF file of its padded UTF-8 bytes."""
    keep = [f for f in docs.schema.fields if f.name not in (text, out)]
    names = [*(f.name for f in keep), out]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            files = [write(pad((t.as_py() or "").encode("utf-8", "surrogatepass"))) for t in part.column(text)]
            yield pa.RecordBatch.from_arrays([*(part.column(f.name) for f in keep), pa.array(files, pa.binary())], names)

    return docs.mapInArrow(run, T.StructType([*keep, T.StructField(out, T.BinaryType())]))


def pages(media: DataFrame, column: str = "media") -> DataFrame:
    """One row for each page of each file: the other columns, page (from 0), its size, samples, and error if unreadable."""
    keep = [f for f in media.schema.fields if f.name != column and f.name not in PAGE.names]
    names, kinds = [*(f.name for f in keep), *PAGE.names], [pa.int64()] * 5 + [pa.binary(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [batch.column(f.name) for f in keep]
            rows, of, held = [], [], 0

            def done(own=own, rows=rows, of=of) -> pa.RecordBatch:
                columns = list(zip(*rows)) or [()] * len(kinds)
                out = [c.take(pa.array(of, pa.int64())) for c in own] + [pa.array(c, t) for c, t in zip(columns, kinds)]
                return pa.RecordBatch.from_arrays(out, names)

            for i, blob in enumerate(batch.column(column)):
                n = -1
                try:
                    for n, page in enumerate(read(blob.as_py()) if blob.is_valid else ()):
                        rows.append((n, *page, None))
                        of.append(i)
                        held += len(page[-1])
                        if held > HELD:
                            yield done()
                            rows.clear()
                            of.clear()
                            held = 0
                except BAD_FILE as e:
                    rows.append((n + 1, None, None, None, None, None, f"{type(e).__name__}: {e}"))
                    of.append(i)
            if rows:
                yield done()

    return media.mapInArrow(run, T.StructType([*keep, *PAGE.fields]))


#: Bytes of samples that are handed on together.
HELD = 8_000_000
FILE = T.StructType(
    [
        T.StructField("payload_bytes", T.LongType()),
        T.StructField("payload_sha256", T.StringType()),
        T.StructField("tail_crc32", T.LongType()),
        T.StructField("feature", T.StringType()),
        T.StructField("error", T.StringType()),
    ]
)


class _File:
    """What is known of a file's samples while its pages pass."""

    def __init__(self, whole: bool) -> None:
        self.held: list[bytes] | None = [] if whole else None
        self.pages, self.bytes, self.digest, self.tail, self.error = 0, 0, hashlib.sha256(), b"", None
        self.counts = np.zeros(256, np.int64)

    def add(self, samples: bytes | None, error: str | None) -> None:
        self.error = self.error or error
        if samples is not None:
            self.pages, self.bytes = self.pages + 1, self.bytes + len(samples)
            self.digest.update(samples)
            if self.held is not None:
                self.held.append(samples)
            self.tail = (self.tail + samples)[-32:] if len(samples) < 32 else samples[-32:]
            self.counts += np.bincount(np.frombuffer(samples, np.uint8), minlength=256)

    def row(self) -> tuple:
        n, values = max(1, self.bytes), np.arange(256)
        mean = float(self.counts @ values) / n
        spread = float(self.counts @ (values - mean) ** 2) / n
        bins = ",".join(map(str, self.counts.reshape(8, 32).sum(1).tolist()))
        said = f"pages={self.pages};bytes={self.bytes};mean={mean:.4f};deviation={spread**0.5:.4f};histogram={bins}"
        whole = () if self.held is None else (b"".join(self.held),)
        return self.bytes, self.digest.hexdigest(), zlib.crc32(self.tail), said, self.error, *whole


def by_file(found: DataFrame, payload: bool = False) -> DataFrame:
    """One row for each file of ``pages``: the other columns, payload_bytes, payload_sha256 and tail_crc32 (of the last 32
    bytes) of all its samples, feature (pages, bytes, mean, deviation, 8-bin histogram), error; with ``payload`` the samples.

    The pages of a file come one after the other, as ``pages`` gives them; nothing is shuffled, and without ``payload`` no file
    is put together.
    """
    more = [T.StructField("payload", T.BinaryType())] if payload else []
    made = [*FILE.fields, *more]
    keep = [f for f in found.schema.fields if f.name not in PAGE.names and f.name not in [m.name for m in made]]
    out = T.StructType([*keep, *made])
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_file, own = None, None

        def done(files: list[_File], columns: list) -> pa.RecordBatch:
            cells = [pa.array(c, t) for c, t in zip(zip(*(f.row() for f in files)), kinds)]
            return pa.RecordBatch.from_arrays([*columns, *cells], out.names)

        for batch in batches:
            closed, last = [], []
            said = (batch.column(c).to_pylist() for c in ("page", "samples", "error"))
            for i, (page, samples, error) in enumerate(zip(*said)):
                if page == 0:  # the file before it is complete
                    if open_file is not None:
                        if i:
                            closed.append(open_file)
                            last.append(i - 1)
                        else:
                            yield done([open_file], own)
                    open_file = _File(payload)
                open_file.add(samples, error)
            if closed:
                rows = pa.array(last, pa.int64())
                yield done(closed, [batch.column(f.name).take(rows) for f in keep])
            if len(batch):
                own = [batch.column(f.name).slice(len(batch) - 1, 1) for f in keep]
        if open_file is not None:
            yield done([open_file], own)

    return found.mapInArrow(run, out)


def features(media: DataFrame, column: str = "media") -> DataFrame:
    """What ``by_file`` gives for the pages of each file, with the payload."""
    return by_file(pages(media, column), payload=True)
