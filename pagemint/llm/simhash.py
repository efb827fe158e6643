"""SimHash near-dedup by multi-index hashing, and near copies verified by the similarity of their shingle sets.

A fingerprint bit is set where over half of a text's word shingles have it set in their hash. Equal fingerprints are one
entry, whatever the number of their documents.

``close_pairs`` (64 bits, distance 2 at most): multi-index hashing with a table for each of two segments of 32 bits, which
  has one row for each fingerprint. Of two fingerprints at distance 2 or less either the first segments differ by 1 bit at
  most or the second ones are equal; so each asks the first table for the ball of radius 1 around its segment, the second
  for its segment alone, and what is fetched is verified by the complete distance. A bucket of many entries (a large group
  of near copies) is split by balls around the other segment, so that no pairs of the whole group are made; links are exact.
``keep_one`` (Jaccard similarity of shingle sets): fingerprints only estimate similarity, so close fingerprints are one
  source of candidates and an exact set-similarity join is the other, which finds what the fingerprints miss. All shingles
  have one order, rarest first; two sets of Jaccard J or more share a shingle of their prefixes, the first few in that
  order. What a large group shares (a template) is frequent and comes last, so it fills no prefix bucket. Candidates pass
  length and positional filters and an exact bound from parities, and are verified by the sets themselves; no bucket is
  cut. Each entry is compared first with hubs: of the most central entries of its buckets, those whose shingles many texts
  hold, the one that it shares most buckets with. Copies of one text with edits of their own are less alike than each is to
  the one with the fewest edits, so hubs join a large group by a few pairs for each entry. Only entries that verified links
  have not joined are paired.
  Equal sets (a digest of 64 bits) are one entry.

Defined cases: a null, empty or blank text has no shingles and fingerprint zero, which links like any other; fewer words
than a shingle give one shingle of them all; repeated rows are copies; null ids are kept and are never the least id of a
component unless it has no other; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagemint.llm.common import LOWER, UPPER, slices, stored
from pagemint.llm.components import components

LOWERED = bytes.maketrans(UPPER.encode(), LOWER.encode())
LOW_HALF = (1 << 32) - 1
#: Entries of one segment bucket that are compared one by one.
HOT = 64
#: Shingles are counted in so many cells, to order them by how many texts hold them.
CELLS = 1 << 17
EPSILON = 1e-6
#: Cells of the brief parity that joins compare.
BITS = 1024
#: Times that entries are compared with a hub before those not joined yet are paired; links join the same for any value.
TURNS = 3
#: A text's hashes are worked through in blocks of this many: bounded memory for texts of any length.
BLOCK = 255 * 64


def shingle_hashes(text: str | None, size: int) -> Iterator[np.ndarray]:
    """XXH64 (seed 42) of the space-joined word shingles, repeats included, in blocks."""
    found = (text or "").encode("utf-8", "surrogatepass").translate(LOWERED).split()
    if not found:
        return
    joined = b" ".join(found)
    ends = np.cumsum([len(w) + 1 for w in found]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    count = max(1, len(found) - size + 1)
    first, last = starts[:count].tolist(), ends[min(size, len(found)) - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    for at in range(0, count, BLOCK):
        yield np.array([digest(joined[a:b], 42) for a, b in zip(first[at : at + BLOCK], last[at : at + BLOCK])], np.uint64)


def mixed(h: np.ndarray, turn: int) -> np.ndarray:
    """The hashes themselves for turn 0, else independent ones (splitmix64 of hash and turn)."""
    if not turn:
        return h
    with np.errstate(over="ignore"):
        z = h + np.uint64(0x9E3779B97F4A7C15) * np.uint64(turn)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


def bit_counts(h: np.ndarray) -> np.ndarray:
    """How many of the hashes have each of the 64 bits set, highest bit first."""
    bits = np.unpackbits(h.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
    whole = len(bits) // 255 * 255
    counts = bits[:whole].reshape(-1, 255, 64).sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)
    return counts + bits[whole:].sum(axis=0, dtype=np.uint8)


def signature(text: str | None, size: int, bits: int) -> np.ndarray:
    """The fingerprint as 0s and 1s, highest bit of the first word first."""
    turns = -(-bits // 64)
    counts, total = np.zeros((turns, 64), np.int64), 0
    for h in shingle_hashes(text, size):
        total += len(h)
        for t in range(turns):
            counts[t] += bit_counts(mixed(h, t))
    return (2 * counts > total).astype(np.uint8).reshape(-1)[:bits]


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 3) -> DataFrame:
    """(id, fingerprint long) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            got = [np.packbits(signature(t.as_py(), shingle, 64)).view(">i8")[0] for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([int(g) for g in got], pa.int64())], names)

    bare = docs.select(F.col(f"`{doc_id}`").alias("id"), F.col(f"`{text}`").alias("text"))
    schema = T.StructType([bare.schema["id"], T.StructField("fingerprint", T.LongType())])
    names = schema.names
    return bare.mapInArrow(run, schema)


def segment(number: int) -> Column:
    """The bucket of a fingerprint in the table of a segment: its high (0) or low (1) 32 bits, with the segment's number."""
    value = F.col("fingerprint")
    return F.shiftrightunsigned(value, 32) if number == 0 else value.bitwiseAND(F.lit(LOW_HALF)) + F.lit(1 << 32)


def close_pairs(distinct: DataFrame, most: int = HOT) -> DataFrame:
    """Links (a, b) that join all fingerprints within distance 2; ``distinct`` has one row for each fingerprint.

    ``most``: a bucket of more entries is split by the other segment; links are the same for any value.
    """
    value = F.col("fingerprint")
    high, low = segment(0), segment(1)
    table = stored(distinct.select(value.alias("entry"), F.explode(F.array(high, low)).alias("bucket")), "segments")
    hot = stored(table.groupBy("bucket").agg(F.count("*").alias("n")).where(F.col("n") > most).select("bucket"), "hot-segments")
    # of two that differ in one bit of the segment, the one that has it set asks for the other's bucket
    ball = F.array_compact(F.array(*[F.when(high.bitwiseAND(F.lit(1 << b)) != 0, high.bitwiseXOR(F.lit(1 << b))) for b in range(32)]))
    probes = distinct.select(value.alias("probe"), F.explode(F.concat(F.array(high, low), ball)).alias("bucket"))
    asked = probes.join(table, "bucket")
    close = F.bit_count(F.col("probe").bitwiseXOR(F.col("entry"))).between(1, 2)
    if hot.isEmpty():
        pairs = asked.where(close).select(F.col("probe").alias("a"), F.col("entry").alias("b"))
    else:
        cold = probes.join(hot, "bucket", "left_anti").join(table, "bucket")
        pairs = cold.where(close).select(F.col("probe").alias("a"), F.col("entry").alias("b")).unionByName(hot_pairs(table, probes, hot))
    return ordered_pairs(pairs).distinct()


def hot_pairs(table: DataFrame, probes: DataFrame, hot: DataFrame) -> DataFrame:
    """Links (a, b) within buckets of any size: each member is filed under the ball of radius 1 around its other segment.

    Members of a bucket whose other segments differ by 2 or less share such a place, which holds 33 of them at most; so does
    what asks from 1 bit off and differs by 1 or less in the other segment.
    """

    def other(entry: Column) -> Column:
        low = entry.bitwiseAND(F.lit(LOW_HALF))
        return F.when(F.col("bucket") < F.lit(1 << 32), low).otherwise(F.shiftrightunsigned(entry, 32))

    members = table.join(hot, "bucket").select("bucket", "entry", other(F.col("entry")).alias("rest"))
    ball = F.array(F.col("rest"), *[F.col("rest").bitwiseXOR(F.lit(1 << b)) for b in range(32)])
    filed = stored(members.select("bucket", "entry", F.explode(ball).alias("place")), "hot-places")
    gathered = filed.groupBy("bucket", "place").agg(F.collect_set("entry").alias("entries")).where(F.size("entries") > 1)
    within = gathered.select(F.array_min("entries").alias("a"), F.explode("entries").alias("b"))
    outside = probes.join(hot, "bucket").select("bucket", "probe", other(F.col("probe")).alias("place"))
    across = outside.join(filed, ["bucket", "place"]).select(F.col("probe").alias("a"), F.col("entry").alias("b"))
    return within.unionByName(across).where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))).between(1, 2))


def dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 3) -> DataFrame:
    """(id, fingerprint, component) of each row: component is the least id reachable by links of distance 2 or less."""
    prints = stored(fingerprints(docs, doc_id, text, shingle), "fingerprints")
    distinct = stored(prints.groupBy("fingerprint").agg(F.min("id").alias("least")), "entries")
    roots = components(close_pairs(distinct.select("fingerprint")))
    placed = distinct.join(roots, distinct.fingerprint == roots.node, "left").select(
        "fingerprint", "least", F.coalesce("root", "fingerprint").alias("root")
    )
    placed = stored(placed, "placed")
    least = stored(placed.groupBy("root").agg(F.min("least").alias("component")), "least")
    named = placed.join(least, "root").select("fingerprint", "component")
    return prints.join(named, "fingerprint").select(F.col("id").alias(doc_id), "fingerprint", "component")


def shingle_set(text: str | None, size: int) -> np.ndarray:
    """The distinct hashes of a text's word shingles, in order."""
    parts = list(shingle_hashes(text, size))
    return np.unique(np.concatenate(parts)) if parts else np.zeros(0, np.uint64)


def digest(hashes: np.ndarray) -> int:
    """64 bits that stand for a set of shingles."""
    return int(np.uint64(xxhash.xxh3_64_intdigest(hashes.tobytes(), 7)).view(np.int64))


def entry_prints(docs: DataFrame, doc_id: str, text: str, shingle: int) -> DataFrame:
    """(id, text_hash, entry, fingerprint, cell, n): a row for each of ``docs``; and, with a cell, how many shingles fell into it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.zeros(CELLS, np.int64)
        id_type = None
        for batch in slices(batches):
            entries, prints, id_type = [], [], batch.column("id").type
            for t in batch.column("text"):
                hashes = shingle_set(t.as_py(), shingle)
                entries.append(digest(hashes))
                prints.append(int(np.packbits(2 * bit_counts(hashes) > len(hashes)).view(">i8")[0]))
                np.add.at(cells, (hashes % np.uint64(CELLS)).astype(np.int64), 1)
            empty = [pa.nulls(len(batch), t) for t in (pa.int32(), pa.int64())]
            cells_of = pa.array(entries, pa.int64()), pa.array(prints, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("text_hash"), *cells_of, *empty], names)
        held = np.flatnonzero(cells)
        for at in range(0, len(held), 10_000):
            part = held[at : at + 10_000]
            empty = [pa.nulls(len(part), t) for t in (id_type, pa.int64(), pa.int64(), pa.int64())]
            yield pa.RecordBatch.from_arrays([*empty, pa.array(part, pa.int32()), pa.array(cells[part], pa.int64())], names)

    bare = docs.select(
        F.col(f"`{doc_id}`").alias("id"), F.xxhash64(F.col(f"`{text}`")).alias("text_hash"), F.col(f"`{text}`").alias("text")
    )
    kinds = [("text_hash", T.LongType()), ("entry", T.LongType()), ("fingerprint", T.LongType()), ("cell", T.IntegerType()), ("n", T.LongType())]
    schema = T.StructType([T.StructField("id", bare.schema["id"].dataType), *(T.StructField(k, t) for k, t in kinds)])
    names = schema.names
    return bare.mapInArrow(run, schema)


def parity(hashes: np.ndarray, cells: int = 0) -> bytes:
    """Whether an odd number of the hashes falls into each of a power of two of cells, as many as hashes or more, or ``cells``.

    Two sets differ in at least as many members as their parities differ in cells. Halves laid over each other (xor) are the
    parity of half as many cells, so parities of any two sizes compare.
    """
    cells = cells or max(64, 1 << max(len(hashes) - 1, 0).bit_length())
    odd = np.bincount((hashes >> np.uint64(17)).astype(np.int64) & (cells - 1), minlength=cells) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def least_difference(x: bytes, y: bytes) -> int:
    """A lower bound of the members that only one of two sets has, from their parities."""
    x, y = (x, y) if len(x) <= len(y) else (y, x)
    a, b, bits = int.from_bytes(x, "little"), int.from_bytes(y, "little"), 8 * len(y)
    while bits > 8 * len(x):
        bits //= 2
        b = (b >> bits) ^ (b & ((1 << bits) - 1))
    return (a ^ b).bit_count()


def prefixes(docs: DataFrame, text: str, shingle: int, similarity: float, cells: np.ndarray) -> DataFrame:
    """(entry, size, weight, parity, brief, tokens): one row for each set; weight is how often its shingles are counted on
    average, brief is its parity in few cells, tokens are those of its shingles that come first in the order of all.

    Any one order of all shingles gives the same links; that of ``cells`` puts those first that few texts hold.
    """
    shared = docs.sparkSession.sparkContext.broadcast(cells)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = shared.value
        for batch in slices(batches):
            rows = []
            for t in batch.column("text"):
                hashes = shingle_set(t.as_py(), shingle)
                n = len(hashes)
                held = counts[(hashes % np.uint64(CELLS)).astype(np.int64)]
                order, weight = np.lexsort((hashes, held)), float(held.mean()) if n else 0.0
                first = hashes[order[: n - int(np.ceil(similarity * n - EPSILON)) + 1]].view(np.int64)
                rows.append((digest(hashes), n, weight, parity(hashes), np.frombuffer(parity(hashes, BITS), "<i8"), first))
            columns = list(zip(*rows))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)

    longs = pa.list_(pa.int64())
    types = [pa.int64(), pa.int32(), pa.float64(), pa.binary(), longs, longs]
    names = ["entry", "size", "weight", "parity", "brief", "tokens"]
    schema = "entry long, size int, weight double, parity binary, brief array<long>, tokens array<long>"
    found = docs.select(F.col(f"`{text}`").alias("text")).mapInArrow(run, schema)
    return found.groupBy("entry").agg(*(F.first(c).alias(c) for c in names[1:]))


def may_link(x: str, y: str, similarity: float) -> Column:
    """Whether two texts (x not the smaller one) whose first common shingle is this one can reach the similarity."""
    sizes = F.col(f"{x}.size") + F.col(f"{y}.size")
    least = sizes * F.lit(similarity / (1 + similarity)) - EPSILON
    rest = F.least(F.col(f"{x}.size") - F.col(f"{x}.place"), F.col(f"{y}.size") - F.col(f"{y}.place"))
    indexed = F.col(f"{y}.size") - F.ceil(F.col(f"{y}.size") * F.lit(2 * similarity / (1 + similarity)) - EPSILON) + 1
    differ = [F.bit_count(F.col(f"{x}.brief")[k].bitwiseXOR(F.col(f"{y}.brief")[k])) for k in range(BITS // 64)]
    alike = sum(differ[1:], differ[0]) <= sizes * F.lit((1 - similarity) / (1 + similarity)) + EPSILON
    return (F.col(f"{y}.place") < indexed) & (rest >= least) & alike


class Verifier:
    """Tells which pairs of entries have the similarity: sizes and parities first, then the sets of shingles themselves."""

    def __init__(self, docs: DataFrame, best: DataFrame, sizes: DataFrame, doc_id: str, text: str, shingle: int, similarity: float):
        self.docs = docs.select(F.col(f"`{doc_id}`").alias("__id"), F.col(f"`{text}`").alias("text"))
        self.best, self.sizes, self.shingle, self.similarity = best, sizes, shingle, similarity

    def possible(self, pairs: DataFrame) -> DataFrame:
        """Those of ``pairs`` (a, b) whose sizes and parities allow the similarity."""
        share = (1 - self.similarity) / (1 + self.similarity)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches, 1000):
                sizes, x, y = (batch.column(c).to_pylist() for c in ("sizes", "x", "y"))
                fits = [least_difference(p, q) <= share * n + EPSILON for n, p, q in zip(sizes, x, y)]
                yield batch.filter(pa.array(fits, pa.bool_())).select(["a", "b"])

        side = lambda name, p: self.sizes.select(F.col("entry").alias(name), F.col("size").alias(f"{p}_size"), F.col("parity").alias(p))
        both = pairs.join(side("a", "x"), "a").join(side("b", "y"), "b")
        both = both.where(F.least("x_size", "y_size") >= F.greatest("x_size", "y_size") * F.lit(self.similarity) - EPSILON)
        return both.select("a", "b", (F.col("x_size") + F.col("y_size")).alias("sizes"), "x", "y").mapInArrow(run, "a long, b long")

    def links(self, pairs: DataFrame) -> DataFrame:
        """Those of ``pairs`` (a, b) that have the similarity."""
        shingle, least = self.shingle, self.similarity / (1 + self.similarity)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches):
                sets = [shingle_set(t.as_py(), shingle).tobytes() for t in batch.column("text")]
                yield pa.RecordBatch.from_arrays([batch.column("entry"), pa.array(sets, pa.binary())], ["entry", "hashes"])

        def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches):
                x, y = (map(partial(np.frombuffer, dtype=np.uint64), batch.column(c).to_pylist()) for c in ("x", "y"))
                fits = [len(np.intersect1d(p, q, assume_unique=True)) >= least * (len(p) + len(q)) - EPSILON for p, q in zip(x, y)]
                yield batch.filter(pa.array(fits, pa.bool_())).select(["a", "b"])

        pairs = stored(self.possible(pairs), "pairs")
        named = pairs.select(F.col("a").alias("entry")).union(pairs.select("b")).distinct().join(self.best, "entry")
        same = F.col("__id").eqNullSafe(F.col("best.id")) & (F.xxhash64("text") == F.col("best.text_hash"))
        # a repeated row gives its set twice
        sets = self.docs.join(named, same).select("entry", "text").mapInArrow(run, "entry long, hashes binary")
        sets = stored(sets, "sets")
        left = sets.select(F.col("entry").alias("a"), F.col("hashes").alias("x"))
        right = sets.select(F.col("entry").alias("b"), F.col("hashes").alias("y"))
        met = pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(compare, "a long, b long")
        return stored(met.distinct(), "met")


def ordered_pairs(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b")


def with_roots(shared: DataFrame, roots: DataFrame) -> DataFrame:
    """``shared`` with the root of each entry, itself where nothing has joined it."""
    return shared.join(roots.withColumnRenamed("node", "entry"), "entry", "left").withColumn("root", F.coalesce("root", "entry"))


def hub_pairs(placed: DataFrame, tried: DataFrame) -> DataFrame:
    """Pairs (a, b), one at most for each entry: with the hub of its buckets, not joined with it or ``tried`` yet, that it
    shares most of them with. ``placed`` is (token, entry, weight, root); the entry of the greatest weight is a bucket's hub."""
    placed = stored(placed.select("token", "entry", "weight", "root"), "placed")
    hubs = placed.groupBy("token").agg(F.max(F.struct("weight", "entry", "root")).alias("hub")).select("token", "hub")
    met = placed.join(stored(hubs, "hubs"), "token").where("root <> hub.root")
    often = met.groupBy("entry", F.col("hub.entry").alias("end")).agg(F.count("*").alias("n"), F.first("hub.weight").alias("weight"))
    new = often.withColumn("a", F.least("entry", "end")).withColumn("b", F.greatest("entry", "end")).join(tried, ["a", "b"], "left_anti")
    best = new.groupBy("entry").agg(F.max(F.struct("n", "weight", "end")).alias("most"))
    return ordered_pairs(best.select(F.col("entry").alias("a"), F.col("most.end").alias("b"))).distinct()


def similar_links(entries: DataFrame, sets: DataFrame, verifier: Verifier) -> DataFrame:
    """Links (a, b) that join all entries that chains of pairs of at least the similarity join.

    ``entries`` is (entry, best, fingerprint), ``sets`` what ``prefixes`` gives.
    """
    # close fingerprints by the multi-index, entries of equal ones included
    heads = stored(entries.groupBy("fingerprint").agg(F.min("entry").alias("head")), "heads")
    close = close_pairs(heads.select("fingerprint"))
    named = lambda old, new: heads.select(F.col("fingerprint").alias(old), F.col("head").alias(new))
    close = close.join(named("a", "x"), "a").join(named("b", "y"), "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
    equal = entries.join(heads, "fingerprint").select(F.col("head").alias("a"), F.col("entry").alias("b"))
    # stars to hubs of prefix buckets: what they join needs no pairs among itself
    rows = sets.select("entry", "weight", F.posexplode("tokens").alias("place", "token"))
    several = stored(rows.groupBy("token").agg(F.count("*").alias("n")).where("n > 1").select("token"), "tokens")
    shared = stored(rows.join(several, "token"), "shared")
    tried = stored(ordered_pairs(close.union(equal)).distinct(), "tried")
    links = verifier.links(tried)
    for _ in range(TURNS):
        roots = stored(components(links), "roots")
        stars = stored(hub_pairs(with_roots(shared, roots), tried), "stars")
        found = verifier.links(stars)
        links = roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(found)
        if found.isEmpty():
            break
        tried = tried.unionByName(stars)
    # what is left: entries of one bucket that are not joined yet
    roots = stored(components(links), "roots")
    placed = stored(with_roots(shared, roots).select("token", "entry", "place", "root"), "placed")
    apart = stored(placed.groupBy("token").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x <> y").select("token"), "apart")
    placed = placed.join(apart, "token").join(sets.select("entry", "size", "brief"), "entry")
    placed = stored(placed, "placed-apart")
    x, y = placed.alias("x"), placed.alias("y")
    ordered = F.struct("x.size", "x.entry") > F.struct("y.size", "y.entry")
    fits = F.col("y.size") >= F.col("x.size") * F.lit(verifier.similarity) - EPSILON
    met = x.join(
        y,
        (F.col("x.token") == F.col("y.token")) & (F.col("x.root") != F.col("y.root")) & ordered & fits & may_link("x", "y", verifier.similarity),
    )
    pairs = met.select(F.col("x.entry").alias("a"), F.col("y.entry").alias("b"))
    return links.unionByName(verifier.links(ordered_pairs(pairs).distinct()))


def keep_one(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    shingle: int = 5,
    similarity: float = 0.8,
) -> DataFrame:
    """``docs`` less near copies: of each group one row stays, that of the least id.

    A group is what chains of pairs join whose sets of hashed word shingles have at least this Jaccard similarity.
    """
    prints = stored(entry_prints(docs, doc_id, text, shingle), "prints")
    cells = np.zeros(CELLS, np.int64)
    for r in prints.where("cell is not null").groupBy("cell").agg(F.sum("n").alias("n")).collect():
        cells[r["cell"]] = r["n"]
    signed = prints.where("cell is null").select("id", "text_hash", "entry", "fingerprint")
    # the least id of each set stands for it; rows without an id stand after those with one
    least = F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "text_hash"))
    entries = stored(signed.groupBy("entry").agg(least.alias("best"), F.min("fingerprint").alias("fingerprint")), "entries")
    sets = stored(prefixes(docs, text, shingle, similarity, cells), "sets")
    verifier = Verifier(docs, entries.select("entry", "best"), sets.select("entry", "size", "parity"), doc_id, text, shingle, similarity)
    roots = components(similar_links(entries, sets, verifier))
    kept = (
        entries.join(roots, entries.entry == roots.node, "left")
        .groupBy(F.coalesce("root", "entry").alias("root"))
        .agg(F.min("best").alias("best"))
        .select(F.col("best.id").alias("kept_id"), F.col("best.text_hash").alias("kept_hash"))
    )
    repeated = signed.groupBy("id", "text_hash").count().where("count > 1").limit(1).count()
    hashed = docs.withColumn("__hash", F.xxhash64(F.col(f"`{text}`")))
    same = hashed[doc_id].eqNullSafe(kept.kept_id) & (hashed["__hash"] == kept.kept_hash)
    left = hashed.join(kept, same, "left_semi")
    if repeated:  # rows that repeat an id and its text: one of them
        left = left.dropDuplicates([doc_id, "__hash"])
    return left.drop("__hash")
