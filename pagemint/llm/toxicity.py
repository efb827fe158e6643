"""Toxicity by a learned lexicon, matched through Levenshtein automata, with context windows.

Learning takes a bounded sample of labelled rows (``sample`` rows, those of least hash of the id): words and word stems are
counted by label on the executors. Those that speak for the label, by a cautious log-odds, and by more than chance would
give among so many words (a likelihood ratio, its bound raised with their number), become the lexicon, a trie. Scoring looks
each new word up once for each task: as a term, as a word with a term's stem, and, for terms of five letters or more, as a
misspelling, by walking the automaton of the word and the trie together.

A word of clean rows is no misspelling. Whether other words close to a term are is asked of the sample: words that only one
half of it holds stand for those still unseen, and a term whose new neighbours do not speak for the label as a term must may not be misspelled.

A match's weight is lowered for each edit, lowered where a context window shows quotation (quote marks around it, or a word
of reporting before it), and raised where the window addresses someone. A document's score is a logistic function of its
strongest matches. It is fitted across two halves of the sample: each half is scored by the lexicon of the other.

Labels, language, source and id are no inputs of a score. Only the sample's ids and labels are broadcast, and the model.

Defined cases: null, empty and wordless texts score like a text without matches; null labels are not learned from; an id
with two labels counts as toxic; without toxic or without clean rows there is no lexicon and every score is 0; repeated
rows score equally; other columns pass through, those named like an output are replaced; texts are read whole.
"""

from __future__ import annotations

import heapq
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagemint.llm.common import slices, stored, words

STEMS = (4, 5, 6)
#: Edits allowed in a term of at least so many letters; terms that may be misspelled need so much weight.
EDITS = {5: 1, 9: 2}
FUZZY_WEIGHT = 3.0
#: How many of all terms counted may enter the lexicon by chance alone, by the bound on the likelihood ratio.
BY_CHANCE = 5
#: A stem counts if so many times as many rows have it as have any one word with it.
STEM_SUPPORT = 1.5
EDIT_FACTOR, QUOTE_FACTOR, ADDRESS_FACTOR = 0.8, 0.5, 1.1
#: Bytes on either side of a match that count as its context.
WINDOW = 60
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
QUOTES = re.compile("[\"“”„«»]")
REPORTING = re.compile(r"\b(?:said|says|wrote|called|quoted?|quoting|the word|cited|dijo|a dit|sagte)\b[^.!?\n]*$", re.I)
ADDRESS = re.compile(r"\b(?:you|your|you're|u|tu|vous|toi|du|dich|ihr|usted|eres)\b", re.I)
#: Partitions of the sample and of its terms: both are small, but each row of them is some work.
PARTS = 32
#: Counters of one task are handed on when they hold this many terms.
FLUSH = 60_000


class Automaton:
    """Levenshtein automaton of a word: states are rows of edit distances, cut off beyond ``most``."""

    def __init__(self, word: str, most: int):
        self.word, self.most = word, most

    def start(self) -> tuple[int, ...]:
        return tuple(range(len(self.word) + 1))

    def step(self, row: tuple[int, ...], c: str) -> tuple[int, ...]:
        new = [row[0] + 1]
        for i, w in enumerate(self.word):
            new.append(min(new[i] + 1, row[i + 1] + 1, row[i] + (w != c)))
        return tuple(min(x, self.most + 1) for x in new)

    def alive(self, row: tuple[int, ...]) -> bool:
        return min(row) <= self.most

    def distance(self, row: tuple[int, ...]) -> int | None:
        return row[-1] if row[-1] <= self.most else None


class Node:
    __slots__ = ("after", "edits", "stem", "term")

    def __init__(self) -> None:
        self.after: dict[str, Node] = {}
        self.term, self.stem, self.edits = 0.0, 0.0, 0

    def at(self, term: str) -> Node:
        node = self
        for c in term:
            node = node.after.setdefault(c, Node())
        return node


def edits_allowed(term: str) -> int:
    return max([k for n, k in EDITS.items() if len(term) >= n], default=0)


@dataclass
class Lexicon:
    """Weighted terms; a stem is a term that ends in *. ``fuzzy``: terms that may be misspelled; ``known``: clean words."""

    weights: dict[str, float]
    fuzzy: frozenset[str] = frozenset()
    known: frozenset[str] = frozenset()
    root: Node = field(default_factory=Node, repr=False)
    fuzzy_root: Node = field(default_factory=Node, repr=False)

    def __post_init__(self) -> None:
        for term, weight in self.weights.items():
            node = self.root.at(term.rstrip("*"))
            if term.endswith("*"):
                node.stem = weight
            else:
                node.term = weight
        # a word within k edits of a term keeps one of the term's k + 1 pieces, moved by at most k: a cheap test before a walk
        # (place and length of a piece to the piece to the lengths of words that may be such a misspelling)
        self.pieces: dict[tuple[int, int], dict[str, set[int]]] = {}
        for term in self.fuzzy:
            k = edits_allowed(term)
            node = self.fuzzy_root.at(term)
            node.term, node.edits = self.weights[term], k
            cuts = [len(term) * i // (k + 1) for i in range(k + 2)]
            for at, end in zip(cuts, cuts[1:]):
                for moved in range(-k, k + 1):
                    held = self.pieces.setdefault((max(0, at + moved), end - at), {}).setdefault(term[at:end], set())
                    held.update(range(len(term) - k, len(term) + k + 1))
        self.longest = max(map(len, self.fuzzy), default=0) + max(EDITS.values())

    def look_up(self, word: str) -> tuple[float, int]:
        """Weight and edits of the best match of a word; (0, 0) without one."""
        node, best = self.root, 0.0
        for c in word:
            best = max(best, node.stem)
            node = node.after.get(c)
            if node is None:
                break
        else:
            best = max(best, node.term)
        if best or word in self.known:
            return best, 0
        return max(((self.weights[term] * EDIT_FACTOR**d, d) for term, d in self.misspelled(word)), default=(0.0, 0))

    def plain(self, word: str) -> bool:
        """Whether a word is a term or has a term's stem."""
        return word in self.weights or any(f"{word[:k]}*" in self.weights for k in STEMS if len(word) > k)

    def misspelled(self, word: str) -> Iterator[tuple[str, int]]:
        """Terms a word may be a misspelling of, with their distance: the automaton of the word and the trie of terms are
        walked together, and branches the automaton gives up are left."""
        size = len(word)
        if size > self.longest or not any(size in s.get(word[at : at + n], ()) for (at, n), s in self.pieces.items()):
            return
        automaton = Automaton(word, max(EDITS.values()))
        todo = [("", self.fuzzy_root, automaton.start())]
        while todo:
            term, node, row = todo.pop()
            d = automaton.distance(row)
            if d and d <= node.edits:
                yield term, d
            for c, after in node.after.items():
                if automaton.alive(step := automaton.step(row, c)):
                    todo.append((term + c, after, step))


class Scorer:
    """Features of texts: the strongest match, the second strongest of another word, and log(1 + sum of weights)."""

    def __init__(self, lexicon: Lexicon):
        self.lexicon, self.cache = lexicon, {}

    def hits(self, text: str | None) -> dict[bytes, tuple[float, int]]:
        ws, cache, found = set(words(text)), self.cache, {}
        if len(cache) > 60_000:
            cache.clear()
        for w in ws:
            hit = cache.get(w)
            if hit is None:
                hit = cache[w] = self.lexicon.look_up(w.decode("utf-8", "replace"))
            if hit[0]:
                found[w] = hit
        return found

    def features(self, text: str | None) -> tuple[float, float, float]:
        found = self.hits(text)
        if not found:
            return 0.0, 0.0, 0.0
        raw, best, total = text.encode("utf-8", "surrogatepass"), dict.fromkeys(found, 0.0), 0.0
        for m in WORD.finditer(raw.lower()):
            if m[0] in best:
                worth = found[m[0]][0] * self.context(raw, *m.span())
                best[m[0]] = max(best[m[0]], worth)
                total += worth
        strongest = [*heapq.nlargest(2, best.values()), 0.0]
        return strongest[0], strongest[1], math.log1p(total)

    @staticmethod
    def context(raw: bytes, start: int, end: int) -> float:
        """Below 1 for quotation, above it for address."""
        before, after = (x.decode("utf-8", "ignore") for x in (raw[max(0, start - WINDOW) : start], raw[end : end + WINDOW]))
        opened = len(QUOTES.findall(before)) % 2 == 1 and QUOTES.search(after)
        if opened or REPORTING.search(before):
            return QUOTE_FACTOR
        return ADDRESS_FACTOR if ADDRESS.search(before) or ADDRESS.search(after) else 1.0


@dataclass
class Model:
    lexicon: Lexicon
    slope: tuple[float, ...] = (0.0, 0.0, 0.0)
    offset: float = -99.0

    def score(self, features: tuple[float, ...]) -> float:
        z = self.offset + sum(a * b for a, b in zip(self.slope, features))
        return 1 / (1 + math.exp(-max(-40.0, min(40.0, z)))) if z > -99 else 0.0


def terms_of(text: str | None) -> set[str]:
    found = {w.decode("utf-8", "replace") for w in set(words(text))}
    return found | {f"{w[:k]}*" for w in found for k in STEMS if len(w) > k}


def count_terms(rows: DataFrame) -> DataFrame:
    """(term, fold, toxic, clean): in how many of the rows (text, toxic, fold) each term is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def flushed() -> pa.RecordBatch:
            cells = [(*k, n) for k, n in counts.items()]
            counts.clear()
            toxic = [n if y else 0 for _, _, y, n in cells]
            clean = [0 if y else n for _, _, y, n in cells]
            columns = [pa.array([c[0] for c in cells], pa.string()), pa.array([c[1] for c in cells], pa.int32())]
            return pa.RecordBatch.from_arrays([*columns, pa.array(toxic, pa.int64()), pa.array(clean, pa.int64())], names)

        for batch in slices(batches):
            for t, y, f in zip(*(batch.column(c).to_pylist() for c in ("text", "toxic", "fold"))):
                counts.update([(term, f, y) for term in terms_of(t)])
                if len(counts) >= FLUSH:
                    yield flushed()
        yield flushed()

    names = ["term", "fold", "toxic", "clean"]
    parts = rows.select("text", "toxic", "fold").mapInArrow(run, "term string, fold int, toxic long, clean long")
    return parts.groupBy("term").agg(*(F.sum(F.when(F.col("fold") == f, F.col(y)).otherwise(0)).alias(f"{y}{f}") for f in (0, 1) for y in ("toxic", "clean")))


def weight(toxic: float, clean: float, all_toxic: int, all_clean: int) -> float:
    """Log-odds of a term for the label, less one standard error."""
    odds = math.log((toxic + 0.5) / (all_toxic + 1)) - math.log((clean + 0.5) / (all_clean + 1))
    return odds - math.sqrt(1 / (toxic + 0.5) + 1 / (clean + 0.5))


def telling(toxic: Column, clean: Column, all_toxic: int, all_clean: int, terms: int) -> Column:
    """Whether a term is in more toxic rows than chance would give among so many terms, by the likelihood ratio of its rows."""
    rows, share = toxic + clean, all_toxic / max(1, all_toxic + all_clean)
    part = lambda n, expected: F.when(n > 0, n * F.ln(n / expected)).otherwise(0.0)
    ratio = 2 * (part(toxic, rows * share) + part(clean, rows * (1 - share)))
    odds = max(2.0, 2 * math.log(max(1, terms) / BY_CHANCE))
    return (toxic >= 3) & (toxic > rows * share) & (ratio >= odds - math.log(odds))


def rated(counts: list[tuple[str, int, int]], all_toxic: int, all_clean: int, least: float) -> dict[str, float]:
    """Of (term, toxic, clean): weights of those of at least ``least``. A stem is a term of its own only if it has clearly
    more support than any one word with it."""
    if not all_toxic or not all_clean:
        return {}
    by_stem: dict[str, int] = {}
    for term, t, _ in counts:
        if not term.endswith("*"):
            for k in STEMS:
                stem = f"{term[:k]}*"
                by_stem[stem] = max(by_stem.get(stem, 0), t)
    weights = {
        term: weight(t, c, all_toxic, all_clean)
        for term, t, c in counts
        if t >= 2 and (not term.endswith("*") or t >= STEM_SUPPORT * by_stem.get(term, 0))
    }
    return {term: w for term, w in sorted(weights.items()) if w >= least}


def eligible(weights: dict[str, float], support: dict[str, int]) -> frozenset[str]:
    """Terms that may be misspelled, as far as their weight says: words without a stem in the lexicon, and of those with one
    stem the best-supported, which stands for its inflections."""
    heads: dict[str, tuple[int, str]] = {}
    for term, w in weights.items():
        if w >= FUZZY_WEIGHT and not term.endswith("*") and edits_allowed(term):
            head = next((f"{term[:k]}*" for k in STEMS if f"{term[:k]}*" in weights), term)
            heads[head] = max(heads.get(head, (0, "")), (support[term], term))
    return frozenset(term for _, term in heads.values())


def neighbours(counts: DataFrame, weights: dict[str, float], terms: frozenset[str]) -> DataFrame:
    """(near, one of ``terms``, a word and its counts) of words that could be misspellings of them, in any row of the sample."""
    shared = counts.sparkSession.sparkContext.broadcast(Lexicon(weights, terms))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = shared.value
        for batch in slices(batches, 1000):
            rows = [
                (term, i)
                for i, w in enumerate(batch.column("term").to_pylist())
                if not w.endswith("*") and not terms.plain(w)
                for term, _ in terms.misspelled(w)
            ]
            taken = batch.take(pa.array([i for _, i in rows], pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array([t for t, _ in rows], pa.string()), *taken.columns], ["near", *batch.schema.names])

    return counts.mapInArrow(run, T.StructType([T.StructField("near", T.StringType()), *counts.schema.fields]))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> tuple[tuple[float, ...], float]:
    """Slopes and offset by Newton's steps, with a ridge on the slopes."""
    a = np.column_stack((x, np.ones(len(x))))
    pull = np.diag([ridge] * x.shape[1] + [1e-6])
    b = np.zeros(a.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(a @ b, -30, 30)))
        step = np.linalg.solve(a.T @ (a * (p * (1 - p))[:, None]) + pull, a.T @ (y - p) - pull @ b)
        b += step
        if np.abs(step).max() < 1e-8:
            break
    return tuple(b[:-1].tolist()), float(b[-1])


def sampled(labels: DataFrame, doc_id: str, label: str, sample: int) -> DataFrame:
    """At most ``sample`` (id, label, fold) rows: those of least hash of the id."""
    one = labels.where(F.col(label).isNotNull() & F.col(doc_id).isNotNull()).select(F.col(doc_id).alias("__id"), F.col(label).cast("int").alias(label))
    first = one.orderBy(F.xxhash64("__id"), "__id", F.col(label).desc()).limit(sample)
    fold = F.pmod(F.hash("__id"), F.lit(2)).cast("int")
    return first.groupBy("__id").agg(F.max(label).alias(label)).withColumn("fold", fold)


def witness(text: Column) -> Column:
    """The least hash of three neighbouring words of a text; near copies mostly share it, others hardly ever."""
    ws = F.split(F.coalesce(text, F.lit("")), r"\s+")
    triple = lambda w: F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - 2, F.lit(1))), lambda i: F.xxhash64(F.slice(w, i, F.lit(3))))
    return F.array_min(F.transform(F.array(ws), triple)[0])


def learn(
    docs: DataFrame,
    labels: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    label: str = "toxic",
    sample: int = 20_000,
    least_weight: float = 1.5,
) -> Model:
    """Learn from at most ``sample`` rows of ``labels`` and their documents.

    What comes to the driver is what the lexicon holds, and the features of the sample's rows.
    """
    few = F.broadcast(sampled(labels, doc_id, label, sample))
    rows = docs.select(F.col(f"`{doc_id}`").alias("__id"), F.col(f"`{text}`").alias("text")).join(few, "__id")
    # copies are one witness, near copies mostly: rows with one least hash of three words. Read by all steps of the fit
    rows = rows.withColumn("witness", witness(F.col("text"))).groupBy("witness")
    rows = rows.agg(F.max(label).alias("toxic"), F.min(F.struct("__id", "text", "fold")).alias("one"))
    rows = stored(rows.select("toxic", "one.text", "one.fold").repartition(PARTS), "toxicity-sample")
    sizes = {(r["fold"], r["toxic"]): r["count"] for r in rows.groupBy("fold", "toxic").count().collect()}
    size = lambda fold, y: sizes.get((fold, y), 0)
    both_sizes = size(0, 1) + size(1, 1), size(0, 0) + size(1, 0)
    counts = stored(count_terms(rows).repartition(PARTS), "toxicity-terms")
    terms = counts.count()
    toxic, clean = F.col("toxic0") + F.col("toxic1"), F.col("clean0") + F.col("clean1")
    told = [tuple(r) for r in counts.where(telling(toxic, clean, *both_sizes, terms)).collect()]
    weights = rated([(t, a + c, b + d) for t, a, b, c, d in told], *both_sizes, least_weight)
    # words that one half of the sample alone holds stand for unseen ones
    terms_of_use = eligible(weights, {t: a + c for t, a, _, c, _ in told})
    near = stored(neighbours(counts, weights, terms_of_use), "toxicity-neighbours")
    new = near.where("(toxic0 + clean0 = 0) or (toxic1 + clean1 = 0)").groupBy("near")
    new = {r["near"]: (r["t"], r["c"]) for r in new.agg(F.sum(toxic).alias("t"), F.sum(clean).alias("c")).collect()}
    safe = {t for t in terms_of_use if not new.get(t, (0, 0))[1] or weight(*new[t], *both_sizes) >= least_weight}
    heads = F.col("near").isin(*safe) if safe else F.lit(False)
    known = near.where(heads & (clean > 0)).select("term", "clean0", "clean1").distinct().collect()
    whole = Lexicon(weights, frozenset(safe), frozenset(r["term"] for r in known))
    by_fold = []
    for f in (0, 1):
        own = rated([(r[0], r[1 + 2 * f], r[2 + 2 * f]) for r in told], size(f, 1), size(f, 0), least_weight)
        by_fold.append(Lexicon(own, frozenset(safe & set(own)), frozenset(r["term"] for r in known if r[f"clean{f}"])))
    if not whole.weights:
        return Model(whole)
    shared = docs.sparkSession.sparkContext.broadcast(by_fold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorers = [Scorer(x) for x in shared.value]
        for batch in slices(batches):
            folds, labels_of = batch.column("fold").to_pylist(), batch.column("toxic")
            got = [scorers[1 - f].features(t) for f, t in zip(folds, batch.column("text").to_pylist())]
            cells = [pa.array([g[k] for g in got], pa.float64()) for k in range(3)]
            yield pa.RecordBatch.from_arrays([labels_of, *cells], ["toxic", "a", "b", "c"])

    fitted = np.array([tuple(r) for r in rows.mapInArrow(run, "toxic int, a double, b double, c double").collect()], float)
    fitted = fitted[np.lexsort(fitted.T)]
    slope, offset = logistic(fitted[:, 1:], fitted[:, 0])
    return Model(whole, slope, offset)


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
        scorer = Scorer(model.lexicon)
        for batch in slices(batches):
            got = [model.score(scorer.features(t.as_py())) for t in batch.column(text)]
            flags = pa.array([int(g >= threshold) for g in got], pa.int32())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in own), pa.array(got, pa.float64()), flags], names)

    return docs.mapInArrow(run, schema)
