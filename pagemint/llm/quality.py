"""Quality classifier: nearest-neighbour voting among labelled latent-semantic vectors.

A text becomes a vector of log counts: hashed words, hashed trigrams of its character shapes (letter runs, capitals, digits
and spaces collapse, punctuation stays), and soft bins of a few whole-text ratios. At most ``sample`` labelled rows (those of
least hash of the id) give idf weights and, by a truncated singular value decomposition, the latent space; their latent
vectors are broadcast. Every document is projected, its exact cosines with all labelled vectors are worked out in blocks, and
its nearest neighbours vote with their labels, weighted by a power of similarity. Labelled vectors that are the document's own
(of the row itself or of a copy) have no vote, so a labelled document's own label is no input of its score; a score is a
function of the text and the model alone.

Labels, language, source and id are no inputs of a score. The broadcast holds ``sample`` x ``rank`` numbers whatever the
corpus; texts are read once for the fit (labelled rows only) and once for the score, and not shuffled.

Defined cases: null, empty and wordless texts have a zero vector and score the mean label of the sample, as do texts that
no other vector votes on; without labels
every score is 0.5; null labels are not learned from; an id with two labels takes the greater; repeated rows score equally,
whatever rows stand beside them (cosines are compared to 10 digits); of neighbours equally near at the last place those first
in the sample vote; other columns pass through, those named like an output are replaced; texts are read whole.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagemint.llm.common import WORD_BYTES, slices
from pagemint.llm.toxicity import sampled

SHAPES, WORDS, BINS = 512, 1024, 8
RATIOS = 8
SIZE = SHAPES + WORDS + RATIOS * BINS
#: A labelled vector whose cosine is within this of 1 has no vote: it is the scored text, or as good as a copy of it.
SAME = 1e-5
#: Digits to which cosines are compared: sums of products in another order differ beyond them.
DIGITS = 10
#: Share of each block in a vector's squared length.
BLOCKS = ((0, SHAPES, 0.3), (SHAPES, SHAPES + WORDS, 0.4), (SHAPES + WORDS, SIZE, 0.3))


def _classes() -> tuple[bytes, int]:
    """Shape classes of bytes: 0 space, 1 line end, 2 small or non-ASCII letter, 3 capital, 4 digit, others by themselves."""
    table = bytearray(256)
    for c in range(256):
        if c >= 128 or 97 <= c <= 122:
            table[c] = 2
        elif 65 <= c <= 90:
            table[c] = 3
        elif 48 <= c <= 57:
            table[c] = 4
        elif c == 10:
            table[c] = 1
        elif c in (9, 13, 32):
            table[c] = 0
        else:
            table[c] = 5 + c % 40
    return bytes(table), 45


CLASSES, CLASS_COUNT = _classes()


def _bins(values: list[float]) -> np.ndarray:
    """Each value in 0..1 shared out between the two bins it lies between."""
    out = np.zeros((len(values), BINS), np.float32)
    for i, v in enumerate(values):
        at = min(max(v, 0.0), 1.0) * (BINS - 1)
        low = min(int(at), BINS - 2)
        out[i, low], out[i, low + 1] = 1 - (at - low), at - low
    return out.reshape(-1)


def vector(text: str | None) -> np.ndarray:
    """Log counts of a text, before weighting; zeros without words."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    found = raw.translate(WORD_BYTES).split()
    out = np.zeros(SIZE, np.float32)
    if not found:
        return out
    a = np.frombuffer(raw.translate(CLASSES), np.uint8)
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (a[1:] > 4)
    s = a[new].astype(np.int64)
    if len(s) > 2:
        code = (s[:-2] * CLASS_COUNT + s[1:-1]) * CLASS_COUNT + s[2:]
        out[:SHAPES] = np.bincount((code * 2654435761 >> 12) % SHAPES, minlength=SHAPES)
    codes = np.fromiter(map(zlib.crc32, found), np.int64, len(found))
    out[SHAPES : SHAPES + WORDS] = np.bincount(codes % WORDS, minlength=WORDS)
    np.log1p(out, out)
    counts = np.bincount(a, minlength=CLASS_COUNT)
    letters = max(1, int(counts[2] + counts[3]))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    n = len(found)
    distinct = len(np.unique(codes))
    pairs = codes[:-1] * 31 + codes[1:]
    out[SHAPES + WORDS :] = _bins(
        [
            float((codes[1:] == codes[:-1]).mean()) if n > 1 else 0.0,
            distinct / n,
            len(np.unique(pairs)) / max(1, n - 1),
            len(set(lines)) / max(1, len(lines)),
            int(counts[3]) / letters,
            min(1.0, 4 * int(counts[5:].sum()) / len(a)),
            min(1.0, letters / n / 16),
            min(1.0, np.log1p(n) / 10),
        ]
    )
    return out


@dataclass
class Model:
    """idf weights, the latent basis, and the labelled rows' unit vectors, and labels."""

    idf: np.ndarray
    basis: np.ndarray
    known: np.ndarray
    labels: np.ndarray
    mean: float
    neighbours: int
    power: float

    def latent(self, vectors: np.ndarray) -> np.ndarray:
        z = weighted(vectors, self.idf) @ self.basis
        return z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-12)

    def vote(self, vectors: np.ndarray) -> np.ndarray:
        """Scores of a block of documents: exact cosines with all labelled vectors, the nearest of them vote."""
        if not len(self.labels):
            return np.full(len(vectors), self.mean)
        near = np.round(self.latent(vectors) @ self.known.T, DIGITS)
        near[near > 1 - SAME] = -2.0
        k = min(self.neighbours, near.shape[1])
        last = -np.partition(-near, k - 1, axis=1)[:, k - 1 : k]
        level = near == last
        left = k - (near > last).sum(axis=1, keepdims=True)
        top = (near > last) | level & (np.cumsum(level, axis=1) <= left)
        top &= near > -2.0
        weight = (np.maximum(near, 0.0) ** self.power + 1e-9) * top
        score = (weight * self.labels).sum(1) / np.maximum(weight.sum(1), 1e-300)
        return np.where(vectors.any(axis=1) & top.any(axis=1), score, self.mean)


def weighted(vectors: np.ndarray, idf: np.ndarray) -> np.ndarray:
    v = vectors.astype(np.float64) * idf
    for a, b, share in BLOCKS:
        norms = np.linalg.norm(v[:, a:b], axis=1, keepdims=True)
        v[:, a:b] *= share**0.5 / np.maximum(norms, 1e-12)
    return v


def learn(
    docs: DataFrame,
    labels: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    label: str = "quality",
    sample: int = 4_000,
    rank: int = 48,
    neighbours: int = 25,
    power: float = 8.0,
) -> Model:
    """Fit on at most ``sample`` rows of ``labels`` and their documents."""
    few = F.broadcast(sampled(labels, doc_id, label, sample).select("__id", label))
    rows = docs.select(F.col(f"`{doc_id}`").alias("__id"), F.col(f"`{text}`").alias("text")).join(few, "__id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            got = [vector(t.as_py()).tobytes() for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("__id"), batch.column(label), pa.array(got, pa.binary())], names)

    schema = T.StructType([rows.schema["__id"], T.StructField(label, T.IntegerType()), T.StructField("v", T.BinaryType())])
    names = schema.names
    got = sorted(map(tuple, rows.mapInArrow(run, schema).collect()), key=lambda r: (str(r[0]), r[1], r[2]))
    if not got:
        return Model(np.ones(SIZE), np.zeros((SIZE, 1)), np.zeros((0, 1)), np.zeros(0), 0.5, neighbours, power)
    v = np.frombuffer(b"".join([r[2] for r in got]), np.float32).reshape(len(got), SIZE)
    y = np.array([r[1] for r in got], float)
    used = (v > 0).sum(axis=0)
    idf = np.log((1 + len(v)) / (1 + used)) + 1
    x = weighted(v, idf)
    _, vectors = np.linalg.eigh(x.T @ x)  # the right singular vectors of x
    model = Model(idf, vectors[:, ::-1][:, :rank].copy(), v[:0], y, float(y.mean()), neighbours, power)
    model.known = model.latent(v)
    return model


def score(
    docs: DataFrame, model: Model, text: str = "text", threshold: float = 0.3, score_as: str = "score", predicted_as: str = "predicted"
) -> DataFrame:
    """Add score (0 to 1) and predicted (1 if score >= threshold), under these or other names."""
    keep = [f for f in docs.schema.fields if f.name not in (score_as, predicted_as)]
    schema = T.StructType([*keep, T.StructField(score_as, T.DoubleType()), T.StructField(predicted_as, T.IntegerType())])
    own, names = [f.name for f in keep], schema.names
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in slices(batches):
            vectors = np.stack([vector(t.as_py()) for t in batch.column(text)])
            got = np.round(model.vote(vectors), 9)
            cells = [pa.array(got, pa.float64()), pa.array((got >= threshold).astype(np.int32))]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in own), *cells], names)

    return docs.mapInArrow(run, schema)
