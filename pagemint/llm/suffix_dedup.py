"""Exact substring dedup by suffix sorting: remove every byte covered by a long string that also starts elsewhere.

One suffix array of a whole corpus does not spread over a cluster, so suffixes are first dealt into buckets that can be
sorted by themselves. Of all k-grams in a window (the string of ``length`` bytes at a position) the one of least hash, the
leftmost of equals, is its anchor: equal windows have equal anchors at equal distances, so equal windows always meet in the
bucket of their anchor. Consecutive windows with one anchor form a region, the unit of all shuffles (one for some 80 bytes).

1. Anchors that occur once in the corpus have no equal windows; they are counted (combined before the shuffle) and dropped.
2. Equal regions (by 128 bits of XXH3 of their bytes) are counted. All windows of a repeated region are repeated; its text is
   not needed.
3. In buckets of several different regions one copy of each region is fetched from the texts, and the bucket's suffixes are
   put in order by deep-shallow sorting: multikey quicksort, eight bytes to a key and all groups at once, to a shallow
   depth; groups still together there are ordered by blind tries, built breadth first: each member is compared with the
   group's first one, and goes on with those that branch off it at the same place by the same byte. Suffixes found equal
   over the whole length are the repeated windows. Bytes are compared, not hashes.
4. A bucket of more than ``most_regions`` different regions is dealt into smaller ones and these are sorted in the same way:
   its regions are cut into pieces by distance to the anchor, and pieces at one distance go by the bytes that all their
   windows share; equal windows share them. Of pieces equal byte for byte one goes on. Where a bucket is still too large, its
   pieces are cut narrower, down to single windows, of which no two different ones share a bucket. The result is the same
   for any ``most_regions``, and no rows of a large bucket come together.

Spans of repeated windows meet at their document by id, where the text is read again. Both uses of the texts share one
shuffle. Narrow tables between the steps are written to the shared folder.

Defined cases: a null text is empty; texts shorter than ``length`` keep all bytes; rows that repeat an id and a text are
copies of each other; null ids are allowed; an empty table gives an empty result; texts of any length are worked through in
blocks; only the id and text columns are read, whatever others there are.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagemint.llm.common import slices, stored

GRAM = 32
#: Windows of one text that are worked through at once.
BLOCK = 1 << 19
LOW = np.uint64((1 << 20) - 1)
#: Depth in bytes to which multikey quicksort goes, and bytes of regions that are sorted at once (whole buckets).
SHALLOW = 32
SORTED_AT_ONCE = 2_000_000
#: A bucket of so many different regions (some 200 KB) is sorted as it is; larger ones are dealt into smaller ones first.
MOST_REGIONS = 768
#: Widths of the pieces into which regions of larger buckets are cut, in windows; those that leave windows nothing in common
#: are left out.
PIECE_WIDTHS = (32, 8, 2, 1)
BASE = 0x9E3779B97F4A7C15


@cache
def tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A number for each byte, and powers and inverse powers of the base, mod 2^64."""
    z = np.arange(1, 257, dtype=np.uint64) * np.uint64(BASE)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    powers = []
    for b in (BASE, pow(BASE, -1, 1 << 64)):
        p = np.full(BLOCK + 4096, b, np.uint64)
        p[0] = 1
        powers.append(np.multiply.accumulate(p))
    return z ^ (z >> np.uint64(31)), *powers


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A hash of each GRAM bytes: differences of prefix sums, divided by a power. They choose anchors and decide nothing."""
    numbers, powers, inverse = tables()
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(numbers[data] * powers[: len(data)], out=sums[1:])
    return mix((sums[GRAM:] - sums[:-GRAM]) * inverse[: len(data) - GRAM + 1])


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def sliding_least(keys: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` consecutive keys (block-wise running minima from both sides)."""
    n = len(keys)
    filled = np.concatenate((keys, np.full(-n % width, ~np.uint64(0)))).reshape(-1, width)
    ahead = np.minimum.accumulate(filled, axis=1).reshape(-1)
    back = np.minimum.accumulate(filled[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(back[: n - width + 1], ahead[width - 1 : n])


def regions(raw: bytes, length: int) -> Iterator[tuple[np.ndarray | list, ...]]:
    """Blocks of (anchor hash, region digest, first window, windows, distance from first window to anchor)."""
    data = np.frombuffer(raw, np.uint8)
    digest = xxhash.xxh3_128_digest
    for at in range(0, len(data) - length + 1, BLOCK):
        part = data[at : at + BLOCK + length - 1]
        h = gram_hashes(part)
        keys = (h & ~LOW) | np.arange(len(h), dtype=np.uint64)
        anchor = (sliding_least(keys, length - GRAM + 1) & LOW).astype(np.int64)
        first = np.flatnonzero(np.concatenate(([True], anchor[1:] != anchor[:-1])))
        count = np.diff(np.append(first, len(anchor)))
        away = anchor[first] - first
        # of one anchor, bytes and distance make a region
        own = [digest(raw[i : i + n + length - 1], d) for i, n, d in zip((first + at).tolist(), count.tolist(), away.tolist())]
        yield h[anchor[first]].view(np.int64), own, first + at, count, away


# --- deep-shallow sorting ------------------------------------------------------------------------------------------


def _grouped(order: np.ndarray, *keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entries in ``order`` whose keys some other entry has too, and the numbers of their groups."""
    new = np.zeros(len(order), bool)
    new[:1] = True
    for k in keys:
        k = k[order]
        new[1:] |= k[1:] != k[:-1]
    group = np.cumsum(new) - 1
    several = np.bincount(group)[group] > 1
    return order[several], group[several]


def repeated(text: np.ndarray, place: np.ndarray, group: np.ndarray, length: int) -> np.ndarray:
    """Which of the suffixes at ``place`` equal another of their group over ``length`` bytes."""
    out = np.zeros(len(place), bool)
    entry, g = _grouped(np.argsort(group, kind="stable"), group)
    # multikey quicksort, all groups at once: the key is the next eight bytes
    eights = np.lib.stride_tricks.sliding_window_view(text, 8)
    for depth in range(0, SHALLOW, 8):
        if not len(entry):
            return out
        key = eights[place[entry] + depth].copy().view(">u8").reshape(-1).astype(np.uint64)
        kept, g = _grouped(np.lexsort((key, g)), g, key)
        entry = entry[kept]
    # blind tries of the groups that are left, breadth first
    rest = length - SHALLOW
    tails = np.lib.stride_tricks.sliding_window_view(text, rest)
    while len(entry):
        starts = np.flatnonzero(np.concatenate(([True], g[1:] != g[:-1])))
        pivot = entry[np.repeat(starts, np.diff(np.append(starts, len(g))))]
        branch, byte = np.full(len(entry), rest, np.int64), np.zeros(len(entry), np.int64)
        for at in range(0, len(entry), 20_000):
            some = slice(at, at + 20_000)
            mine = tails[place[entry[some]] + SHALLOW]
            differs = mine != tails[place[pivot[some]] + SHALLOW]
            where = differs.argmax(axis=1)
            rows = np.arange(len(where))
            other = differs[rows, where]
            branch[some] = np.where(other, where, rest)
            byte[some] = np.where(other, mine[rows, where], 0)
        same = branch == rest  # the pivot itself and its equals
        equals = np.bincount(g[same], minlength=g[-1] + 1)
        out[entry[same]] = equals[g[same]] > 1
        entry, g, branch, byte = entry[~same], g[~same], branch[~same], byte[~same]
        kept, g = _grouped(np.lexsort((byte, branch, g)), g, branch, byte)
        entry = entry[kept]
    return out


def runs(flags: np.ndarray) -> np.ndarray:
    """(first, last) of each run of set flags."""
    edge = np.diff(np.concatenate(([0], flags.astype(np.int8), [0])))
    return np.column_stack((np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) - 1))


def sorted_bucket_spans(rows: list[tuple], length: int) -> Iterator[tuple]:
    """(key, start, end) of the repeated bytes in rows (bucket, key, first, count, away, bytes) of whole buckets."""
    text = np.frombuffer(b"".join([r[5] for r in rows]) + bytes(8), np.uint8)
    at = np.concatenate(([0], np.cumsum([len(r[5]) for r in rows])))[:-1]
    counts = np.array([r[3] for r in rows])
    within = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    numbers: dict = {}
    bucket = np.array([numbers.setdefault(r[0], len(numbers)) for r in rows])
    distance = np.repeat([r[4] for r in rows], counts) - within  # equal windows have their anchor at one distance
    group = np.repeat(bucket, counts) * (1 << 20) + distance
    found = repeated(text, np.repeat(at, counts) + within, group, length)
    ends = np.cumsum(counts)
    for r, end, n in zip(rows, ends.tolist(), counts.tolist()):
        for i, j in runs(found[end - n : end]).tolist():
            yield r[1], r[2] + i, r[2] + j + length


# --- DataFrames ----------------------------------------------------------------------------------------------------


def spans(docs: DataFrame, texts: DataFrame, length: int, most_regions: int) -> DataFrame:
    """(key, start, end) of repeated bytes; ``docs`` and ``texts`` are (key, text), the second dealt out by key."""
    key_field = docs.schema["key"]
    long = T.LongType()
    fields = [("anchor", long), ("region", T.BinaryType()), ("first", long), ("count", long), ("away", long)]
    record = T.StructType([key_field, *(T.StructField(n, t) for n, t in fields)])
    names = record.names

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            keys, parts = [], []
            for i, t in enumerate(batch.column("text").to_pylist()):
                for part in regions((t or "").encode("utf-8", "surrogatepass"), length):
                    keys.append(np.full(len(part[0]), i))
                    parts.append(part)
            if parts:
                columns = [pa.array(np.concatenate([p[k] for p in parts])) for k in (0, 2, 3, 4)]
                columns.insert(1, pa.array([d for p in parts for d in p[1]], pa.binary()))
                yield pa.RecordBatch.from_arrays([batch.column("key").take(pa.array(np.concatenate(keys))), *columns], names)

    # first, count (at most length) and away (less than length) in one number
    records = docs.mapInArrow(cut, record).select(
        "key", "anchor", "region", F.expr("first * 16777216 + count * 4096 + away").alias("place")
    )
    several = stored(records.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1").select("anchor"), "anchors")
    again = stored(records.join(several, "anchor"), "regions")
    kinds = stored(
        again.groupBy("anchor", "region").agg(F.count("*").alias("n"), F.min(F.struct("key", "place")).alias("one")), "kinds"
    )
    split = {
        "first": "place div 16777216",
        "count": "cast(place div 4096 as long) & 4095",
        "away": "place & 4095",
    }
    whole = again.join(kinds.where("n > 1").select("anchor", "region"), ["anchor", "region"]).select(
        "key", F.expr(split["first"]).alias("start"), F.expr(f"{split['first']} + ({split['count']}) - 1 + {length}").alias("end")
    )
    sizes = stored(kinds.groupBy("anchor").agg(F.count("*").alias("kinds")).where("kinds > 1"), "buckets")
    # one copy of each region of a bucket with several, its repeated regions too: they may share windows with others
    wanted = kinds.join(sizes, "anchor").select(
        F.col("one.key").alias("key"), "anchor", F.col("one.place").alias("place"), (F.col("kinds") > most_regions).alias("large")
    )
    wanted = wanted.select("key", F.struct("anchor", "large", *(F.expr(e).alias(n) for n, e in split.items())).alias("w"))
    by_text = wanted.groupBy("key").agg(F.collect_list("w").alias("wanted"))
    region = T.StructType(
        [
            T.StructField("anchor", long),
            key_field,
            *(T.StructField(n, long) for n in ("first", "count", "away")),
            T.StructField("bytes", T.BinaryType()),
            T.StructField("large", T.BooleanType()),
        ]
    )
    region_names = region.names

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 50):
            rows, keys = [], []
            for i, (t, ws) in enumerate(zip(batch.column("text").to_pylist(), batch.column("wanted").to_pylist())):
                raw = t.encode("utf-8", "surrogatepass")
                keys += [i] * len(ws)
                rows += [
                    (w["anchor"], w["first"], w["count"], w["away"], raw[w["first"] : w["first"] + w["count"] - 1 + length], w["large"])
                    for w in ws
                ]
            if rows:
                c = list(zip(*rows))
                own = batch.column("key").take(pa.array(keys, pa.int64()))
                cells = [pa.array(c[k], pa.int64()) for k in range(4)]
                yield pa.RecordBatch.from_arrays(
                    [cells[0], own, *cells[1:], pa.array(c[4], pa.binary()), pa.array(c[5], pa.bool_())], region_names
                )

    copies = stored(texts.join(by_text, "key").select("key", "text", "wanted").mapInArrow(fetch, region), "copies")
    small = sorted_spans(copies.where("not large").drop("large"), ["anchor"], length)
    return whole.unionByName(small).unionByName(dealt_spans(copies.where("large").drop("large"), length, most_regions))


def sorted_spans(copies: DataFrame, bucket: list[str], length: int) -> DataFrame:
    """(key, start, end) of repeated bytes, from (anchor, key, first, count, away, bytes) and the columns that name a bucket:
    buckets are sorted one by one, several small ones at once."""
    long = T.LongType()
    span = T.StructType([copies.schema["key"], T.StructField("start", long), T.StructField("end", long)])
    names = span.names

    def order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0
        kind = None

        def done() -> pa.RecordBatch:
            found = list(zip(*sorted_bucket_spans(held, length))) or [(), (), ()]
            return pa.RecordBatch.from_arrays([pa.array(found[0], kind), pa.array(found[1], pa.int64()), pa.array(found[2], pa.int64())], names)

        for batch in batches:
            kind = batch.schema.field("key").type
            own = list(zip(*(batch.column(c).to_pylist() for c in bucket)))
            for name, *row in zip(own, *(batch.column(c).to_pylist() for c in ("key", "first", "count", "away", "bytes"))):
                if size >= SORTED_AT_ONCE and name != held[-1][0]:
                    yield done()
                    held, size = [], 0
                held.append((name, *row))
                size += len(row[4])
        if held:
            yield done()

    return copies.repartition(*bucket).sortWithinPartitions(*bucket).mapInArrow(order, span)


def dealt_spans(copies: DataFrame, length: int, most: int) -> DataFrame:
    """(key, start, end) of repeated bytes in buckets of any size: regions are cut into pieces, and these sorted.

    A piece holds the windows at so many neighbouring distances to the anchor. All windows of a place in this grid share its
    middle bytes, so equal windows meet in the bucket of anchor, place and middle. Equal pieces (byte for byte) are repeated
    throughout, and one of them stands for all.
    """
    long = T.LongType()
    piece = T.StructType([*copies.schema.fields, T.StructField("node", long), T.StructField("middle", long)])
    names, own = piece.names, [c for c in copies.columns if c not in ("first", "count", "away", "bytes")]
    found, rest = [], copies
    for width in [w for w in PIECE_WIDTHS if w <= length - GRAM]:

        def cut(batches: Iterator[pa.RecordBatch], width=width) -> Iterator[pa.RecordBatch]:
            digest = xxhash.xxh3_64_intdigest
            for batch in slices(batches):
                take, rows = [], []
                cells = (batch.column(c).to_pylist() for c in ("first", "count", "away", "bytes"))
                for i, (first, count, away, raw) in enumerate(zip(*cells)):
                    for node in range((away - count + 1) // width, away // width + 1):
                        # first and last window of the whole place, and of what the region has of it
                        low, high = away - (node + 1) * width + 1, away - node * width
                        a, b = max(low, 0), min(high, count - 1)
                        middle = digest(raw[high : low + length])  # within the bytes of the region, whatever part of the place it has
                        take.append(i)
                        rows.append((first + a, b - a + 1, away - a, raw[a : b + length], node, middle - (1 << 63)))
                if rows:
                    columns = list(zip(*rows))
                    out = {c: batch.column(c).take(pa.array(take)) for c in own}
                    kinds = zip(("first", "count", "away", "bytes", "node", "middle"), columns)
                    out |= {c: pa.array(x, pa.binary() if c == "bytes" else pa.int64()) for c, x in kinds}
                    yield pa.RecordBatch.from_arrays([out[c] for c in names], names)

        pieces = stored(rest.select(*copies.columns).mapInArrow(cut, piece), "pieces")
        same = ["anchor", "node", "away", "count", "bytes"]
        equal = pieces.groupBy(*same).agg(F.count("*").alias("n"), F.min(F.struct("key", "first")).alias("one")).where("n > 1")
        equal = stored(equal, "equal-pieces")
        whole = F.col("first") + F.col("count") - 1 + length
        found.append(pieces.join(equal, same).select("key", F.col("first").alias("start"), whole.alias("end")))
        left = pieces.join(equal, same, "left").where("one is null or one = struct(key, first)")
        left = stored(left.select(*names), "different-pieces")
        bucket = ["anchor", "node", "middle"]
        sizes = stored(left.groupBy(*bucket).agg(F.count("*").alias("n")).where("n > 1"), "piece-buckets")
        sized = left.join(sizes, bucket)
        found.append(sorted_spans(sized.where(F.col("n") <= most).drop("n"), bucket, length))
        rest = sized.where(F.col("n") > most)
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out.select("key", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"))


def dedup(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = 200, most_regions: int = MOST_REGIONS
) -> DataFrame:
    """One row for each row of ``docs``: the id, n_bytes, removed (array of byte spans [start, end)), kept (bytes that stay).

    ``length`` is the length in bytes (more than GRAM + SHALLOW, less than 4096) from which a repeated string is removed.
    """
    if not GRAM + SHALLOW < length < 4096:
        raise ValueError("length must lie between 65 and 4095")
    column, whole = F.col(f"`{doc_id}`"), F.coalesce(F.col(f"`{text}`"), F.lit(""))
    # 128 bits that tell rows apart: rows with one key have one id and one text
    key = F.concat(F.to_binary(F.lpad(F.hex(F.xxhash64(column.cast("string"), whole)), 16, "0"), F.lit("hex")), F.to_binary(F.lpad(F.hex(F.xxhash64(whole, column.cast("string"), F.lit(1))), 16, "0"), F.lit("hex")))
    keyed = docs.select(key.alias("key"), column.alias("id"), whole.alias("text"))
    dealt = keyed.repartition("key")
    found = spans(keyed.select("key", "text"), dealt.select("key", "text"), length, most_regions)
    by_text = found.groupBy("key").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    joined = dealt.join(by_text, "key", "left").select("id", "text", "spans")
    span_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    out = T.StructType(
        [
            joined.schema["id"],
            T.StructField("n_bytes", T.LongType()),
            T.StructField("removed", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))),
            T.StructField("kept", T.BinaryType()),
        ]
    )
    names = out.names

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sizes, cuts, kept = [], [], []
            for t, found in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist()):
                raw, merged = t.encode("utf-8", "surrogatepass"), []
                for s in sorted((x["start"], x["end"]) for x in found or []):
                    if merged and s[0] <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], s[1])
                    else:
                        merged.append([*s])
                ends = [0, *(e for _, e in merged)]
                starts = [*(s for s, _ in merged), len(raw)]
                sizes.append(len(raw))
                cuts.append([{"start": s, "end": e} for s, e in merged])
                kept.append(b"".join([raw[a:b] for a, b in zip(ends, starts)]))
            cells = [pa.array(sizes, pa.int64()), pa.array(cuts, span_type), pa.array(kept, pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column("id"), *cells], names)

    return joined.mapInArrow(remove, out).withColumnRenamed("id", doc_id)
