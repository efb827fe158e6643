"""Benchmark decontamination: a generalised suffix automaton of test items, streamed over training words.

All items go into one suffix automaton over word numbers (one walk of all their substrings). Each document is streamed
through it word by word, keeping the length of the longest item substring that ends at the word. Whenever a window (a
given number of consecutive item words, or the whole of a shorter item) ends there, its words are hit and the items that
hold it are known from the automaton's state. Spans of hit words can then be removed, and documents whose share of hit
words passes a limit dropped.

Words are runs of anything but ASCII punctuation, controls and spaces, with A-Z lower-cased. Items are a stated, small set,
but no bound is assumed: they are read in blocks of at most ``block_words`` words, one automaton each (some 300 bytes a
word in each task), and a document passes all blocks, so the result does not depend on the blocks. No shuffle.

Defined cases: null or wordless texts have no words and no hits; wordless items have no window; items with equal ids
count once; repeated documents give equal rows; other columns pass through, those named like an output are replaced;
texts are streamed whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagemint.llm.common import slices, stored, words

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


class Automaton:
    """Generalised suffix automaton of word lists, with the windows of its items."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int):
        self.window = window
        self.numbers: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        spelled = [(i, [self.numbers.setdefault(w, len(self.numbers)) for w in ws]) for i, ws in items if ws]
        for _, codes in spelled:
            last = 0
            for c in codes:
                last = self._extend(last, c)
        #: The least number of words that any window has: shorter runs of known words need no walk.
        self.least = min((min(window, len(codes)) for _, codes in spelled), default=1)
        held: list[dict[int, set[str]]] = [{} for _ in self.next]
        for i, codes in spelled:
            size = min(window, len(codes))
            state, length = 0, 0
            for c in codes:
                state, length = self.step(state, length, c)
                if length >= size:
                    at = state
                    while self.length[self.link[at]] >= size:
                        at = self.link[at]
                    held[at].setdefault(size, set()).add(i)
        # windows that end in a state: its own, and those of its suffixes
        self.ends: list[tuple[tuple[int, frozenset[str]], ...]] = [()] * len(self.next)
        for s in sorted(range(1, len(self.next)), key=self.length.__getitem__):
            own = tuple((size, frozenset(ids)) for size, ids in held[s].items())
            self.ends[s] = own + self.ends[self.link[s]]

    def _new(self, length: int, link: int, following: dict[int, int]) -> int:
        self.length.append(length)
        self.link.append(link)
        self.next.append(following)
        return len(self.next) - 1

    def _split(self, p: int, c: int, q: int) -> int:
        """The state for the suffix of ``q`` that follows ``p`` by ``c``: q itself or a copy of it."""
        if self.length[p] + 1 == self.length[q]:
            return q
        copy = self._new(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = copy
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = copy
            p = self.link[p]
        return copy

    def _extend(self, last: int, c: int) -> int:
        if c in self.next[last]:
            return self._split(last, c, self.next[last][c])
        state = self._new(self.length[last] + 1, 0, {})
        p = last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = state
            p = self.link[p]
        if p >= 0:
            self.link[state] = self._split(p, c, self.next[p][c])
        return state

    def step(self, state: int, length: int, c: int) -> tuple[int, int]:
        """The longest suffix of what was read, and ``c``, that is in some item: its state and length."""
        to = self.next[state].get(c)
        while to is None and state:
            state = self.link[state]
            length = self.length[state]
            to = self.next[state].get(c)
        return (0, 0) if to is None else (to, length + 1)

    def scan(self, ws: list[bytes]) -> tuple[list[tuple[int, int]], set[str], int]:
        """Maximal spans of hit words (start, end), the items with windows here, the longest match in words."""
        known = self.numbers
        flags = bytes([w in known for w in ws])
        run, spans, items, longest = b"\x01" * self.least, [], set(), 0
        at = flags.find(run)
        while at >= 0:
            end = flags.find(b"\x00", at)
            end = len(ws) if end < 0 else end
            state = length = 0
            for i in range(at, end):
                state, length = self.step(state, length, known[ws[i]])
                longest = max(longest, length)
                for size, ids in self.ends[state]:
                    if length >= size:
                        items |= ids
                        start = i + 1 - size
                        while spans and spans[-1][1] >= start:
                            start = min(start, spans.pop()[0])
                        spans.append((start, i + 1))
            at = flags.find(run, end)
        return spans, items, longest


def blocks(items: DataFrame, item_id: str, text: str, window: int, block_words: int) -> list[Automaton]:
    """Automata of all items, each of at most ``block_words`` words (or of one longer item)."""
    found, block, size = [], [], 0
    for row in items.select(F.col(item_id).cast("string"), F.col(text)).toLocalIterator(prefetchPartitions=True):
        ws = words(row[1])
        if block and size + len(ws) > block_words:
            found.append(Automaton(block, window))
            block, size = [], 0
        block.append((row[0] if row[0] is not None else "", ws))
        size += len(ws)
    return [*found, Automaton(block, window)]


def scan(
    docs: DataFrame,
    items: DataFrame,
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    window: int = 8,
    block_words: int = 200_000,
) -> DataFrame:
    """Add n_words, hit_spans (array of word spans [start, end)), hit_items (sorted ids), longest_match."""
    docs = docs.drop("n_words", "hit_spans", "hit_items", "longest_match")
    span = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
    schema = T.StructType(
        [
            *docs.schema.fields,
            T.StructField("n_words", T.LongType()),
            T.StructField("hit_spans", span),
            T.StructField("hit_items", T.ArrayType(T.StringType())),
            T.StructField("longest_match", T.LongType()),
        ]
    )
    spans_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    out, own, names = docs, docs.columns, schema.names
    for k, automaton in enumerate(blocks(items, item_id, item_text, window, block_words)):
        shared = docs.sparkSession.sparkContext.broadcast(automaton)

        def run(batches: Iterator[pa.RecordBatch], shared=shared, first=k == 0) -> Iterator[pa.RecordBatch]:
            find = shared.value.scan
            for batch in slices(batches):
                ws = [words(t.as_py()) for t in batch.column(text)]
                got = [find(w) for w in ws]
                spans, ids, longest = [g[0] for g in got], [g[1] for g in got], [g[2] for g in got]
                if not first:
                    before = [batch.column(c).to_pylist() for c in ("hit_spans", "hit_items", "longest_match")]
                    spans = [merged([*a, *((x["start"], x["end"]) for x in b)]) for a, b in zip(spans, before[0])]
                    ids = [{*a, *b} for a, b in zip(ids, before[1])]
                    longest = [max(a, b) for a, b in zip(longest, before[2])]
                yield pa.RecordBatch.from_arrays(
                    [
                        *(batch.column(c) for c in own),
                        pa.array([len(w) for w in ws], pa.int64()),
                        pa.array([[{"start": a, "end": b} for a, b in s] for s in spans], spans_type),
                        pa.array([sorted(i) for i in ids], pa.list_(pa.string())),
                        pa.array(longest, pa.int64()),
                    ],
                    names,
                )

        out = out.mapInArrow(run, schema)
    return out


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def without(text: str, spans: list[tuple[int, int]]) -> str:
    """The text less its words of ``spans`` and what stands between them; a space takes the place of each span."""
    raw = text.encode("utf-8", "surrogatepass")
    places = [m.span() for m in WORD.finditer(raw.lower())]
    out, at = [], 0
    for a, b in spans:
        out += [raw[at : places[a][0]], b" "]
        at = places[b - 1][1]
    return b"".join([*out, raw[at:]]).decode("utf-8", "surrogatepass")


def remove(
    docs: DataFrame,
    items: DataFrame,
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    window: int = 8,
    max_coverage: float = 0.5,
    block_words: int = 200_000,
) -> DataFrame:
    """Documents with hit spans cut out of ``text``; those with more than ``max_coverage`` of their words hit are dropped.

    Coverage is that of the whole text by the items of all blocks. A cut that brings words of another window together is cut
    again, so no window is left; results do not depend on the blocks.
    """
    automata = blocks(items, item_id, item_text, window, block_words)
    if len(automata) > 1:
        return removed_by_rounds(docs, automata, text, max_coverage)
    shared = docs.sparkSession.sparkContext.broadcast(automata[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = shared.value.scan
        for batch in slices(batches):
            texts, keep = batch.column(text).to_pylist(), []
            for i, t in enumerate(texts):
                ws = words(t)
                spans = find(ws)[0]
                keep.append(not ws or sum(b - a for a, b in spans) <= max_coverage * len(ws))
                while spans:
                    texts[i] = t = without(t, spans)
                    spans = find(words(t))[0]
            k = batch.schema.get_field_index(text)
            yield batch.set_column(k, batch.schema.field(k), pa.array(texts, batch.schema.field(k).type)).filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def removed_by_rounds(docs: DataFrame, automata: list[Automaton], text: str, max_coverage: float) -> DataFrame:
    """``remove`` for items of several blocks: each round gathers the spans of all blocks, one automaton at a time, and cuts once."""
    span = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
    spans_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    own, marked_names, cut_names = docs.columns, [*docs.columns, "__spans"], [*docs.columns, "__cut"]
    marked = T.StructType([*docs.schema.fields, T.StructField("__spans", span)])
    cut = T.StructType([*docs.schema.fields, T.StructField("__cut", T.BooleanType())])
    shared = [docs.sparkSession.sparkContext.broadcast(a) for a in automata]

    def cut_once(rows: DataFrame, limit: float) -> DataFrame:
        for k, one in enumerate(shared):

            def mark(batches: Iterator[pa.RecordBatch], one=one, first=k == 0) -> Iterator[pa.RecordBatch]:
                for batch in slices(batches):
                    got = [one.value.scan(words(t.as_py()))[0] for t in batch.column(text)]
                    if not first:
                        before = batch.column("__spans").to_pylist()
                        got = [merged([*a, *((x["start"], x["end"]) for x in b)]) for a, b in zip(got, before)]
                    got = pa.array([[{"start": a, "end": b} for a, b in s] for s in got], spans_type)
                    yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in own), got], marked_names)

            rows = rows.mapInArrow(mark, marked)

        def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches):
                texts, keep, was_cut = batch.column(text).to_pylist(), [], []
                for i, spans in enumerate(batch.column("__spans").to_pylist()):
                    spans = [(x["start"], x["end"]) for x in spans]
                    keep.append(not spans or sum(b - a for a, b in spans) <= limit * len(words(texts[i])))
                    was_cut.append(bool(spans))
                    if spans:
                        texts[i] = without(texts[i], spans)
                k = batch.schema.get_field_index(text)
                new = batch.set_column(k, batch.schema.field(k), pa.array(texts, batch.schema.field(k).type))
                columns = [*(new.column(c) for c in own), pa.array(was_cut, pa.bool_())]
                yield pa.RecordBatch.from_arrays(columns, cut_names).filter(pa.array(keep, pa.bool_()))

        return stored(rows.mapInArrow(apply, cut), "cut")

    found, limit, done = docs, max_coverage, []
    while True:
        rows = cut_once(found, limit)
        done.append(rows.where("not __cut").drop("__cut"))
        found, limit = rows.where("__cut").drop("__cut"), 1.0
        if not found.limit(1).count():
            break
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out
