"""License scans, native: an exact set-similarity join of text blocks with license templates.

A block is a line, or (so that notices wrapped over lines are met) any run of consecutive words one and a half times as long
as the template, across lines; it meets a template when it holds at least a share of the template's distinct words
(containment). Runs are tried around each prefix word only. The join is that of prefix filtering: the words of all templates are ordered by how often they occur in the whole corpus,
rarest first; a block that meets a template must hold one of the template's few rarest words (its prefix). Blocks are
looked up by those words in an inverted index of the prefixes; the length filter drops blocks with too few template words,
the positional filter those whose first shared prefix word stands so late, in the template or in the block, that too few
words can follow; the rest are verified. Template words are a fixed, small list, so the index is part of the query and no
block leaves its row: the corpus is read twice (word counts, then the join) and neither pass shuffles text.

Base phrases are counted besides: places where the words of a phrase stand consecutively.

Defined cases: null, empty and wordless texts have no words, places or labels and score 0; repeated rows give equal
results; no text is cut; other columns pass through, those named like an output are replaced; without documents all
template words count zero and the order falls back to the alphabet.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemint.llm.common import ascii_lower
from pagemint.llm.spans import let

#: Phrases whose places are counted, and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: Notices as words, and their labels. The usual wording of each license's own notice.
TEMPLATES = [
    ("released under the mit license", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software", "mit"),
    ("licensed under the apache license version 2 0", "apache"),
    ("this work is licensed under the gnu general public license version 3", "gpl"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu", "gpl"),
    ("redistribution and use in source and binary forms with or without modification are permitted", "bsd"),
    ("this work is licensed under a creative commons attribution 4 0 international license", "cc-by"),
    ("subject to the terms of the mozilla public license v 2 0", "mpl"),
    ("permission to use copy modify and or distribute this software for any purpose", "isc"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
    ("all rights reserved unauthorized copying of this file is strictly prohibited", "proprietary"),
]
#: Words of a run, for each word of the template: notices are worded with insertions.
SLACK = 1.5
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def normal(text: Column) -> Column:
    """The words of a text, each between two single spaces; one space without words."""
    bare = F.trim(F.regexp_replace(ascii_lower(F.coalesce(text, F.lit(""))), GAP, " "))
    return F.when(bare == "", " ").otherwise(F.concat(F.lit(" "), bare, F.lit(" ")))


def spaces(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))


def places(norm: Column, phrase: str) -> Column:
    """struct<n, first, last> of the word positions where a phrase stands; first and last are null without one."""
    size = len(phrase.split())
    gaps = F.split(norm, f" {phrase}(?= )", -1)

    def of(g: Column) -> Column:
        n = F.size(g) - 1
        before = F.aggregate(F.slice(g, 1, n), F.lit(0), lambda a, x: a + spaces(x))
        return F.struct(
            n.cast("long").alias("n"),
            F.when(n > 0, spaces(g[0]).cast("long")).alias("first"),
            F.when(n > 0, (before + (n - 1) * size).cast("long")).alias("last"),
        )

    none = F.struct(F.lit(0).cast("long").alias("n"), F.lit(None).cast("long").alias("first"), F.lit(None).cast("long").alias("last"))
    return F.when(F.contains(norm, F.lit(f" {phrase} ")), let(gaps, of)).otherwise(none)


def word_order(docs: DataFrame, text: str, templates: list[tuple[str, str]]) -> list[str]:
    """Template words by their count in all of ``docs``, rarest first, then by alphabet. One row a word is collected."""
    vocabulary = sorted({w for t, _ in templates for w in t.split()})
    each = docs.select(F.explode(F.split(normal(F.col(f"`{text}`")), " ")).alias("word")).where(F.col("word").isin(vocabulary))
    counts = {r["word"]: r["count"] for r in each.groupBy("word").count().collect()}
    return sorted(vocabulary, key=lambda w: (counts.get(w, 0), w))


def ints(values) -> Column:
    return F.array(*[F.lit(v) for v in values]) if values else F.expr("cast(array() as array<int>)")


def scan(
    docs: DataFrame,
    text: str = "text",
    containment: float = 0.8,
    templates: list[tuple[str, str]] = TEMPLATES,
    phrases: dict[str, str] = PHRASES,
) -> DataFrame:
    """Add n_words, n_base, first_word, last_word, base_labels, labels (sorted arrays), score.

    score: the largest containment of a template that is met; without one, 0.5 for a base phrase, else 0.
    """
    added = {"n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"}
    order = {w: i for i, w in enumerate(word_order(docs, text, templates))}
    sets = [sorted({order[w] for w in t.split()}) for t, _ in templates]
    need = [math.ceil(containment * len(s)) for s in sets]
    prefixes = [s[: len(s) - n + 1] for s, n in zip(sets, need)]
    index: dict[int, list[int]] = {}
    for i, p in enumerate(prefixes):
        for rank in p:
            index.setdefault(rank, []).append(i)
    by_rank = list(order)
    rare = "|".join(by_rank[r] for r in sorted(index))
    holds_rare = f" (?:{rare})(?= )"
    ranks = F.create_map(*[x for w, i in order.items() for x in (F.lit(w), F.lit(i))])
    lookup = F.create_map(*[x for r, ts in sorted(index.items()) for x in (F.lit(r), ints(ts))])
    reach = [math.ceil(SLACK * len(t.split())) for t, _ in templates]
    widest = max(reach, default=1)
    table = F.array(
        *[
            F.struct(
                ints(s).alias("words"), ints(p).alias("prefix"), F.lit(n).alias("need"), F.lit(label).alias("label"), F.lit(r).alias("reach")
            )
            for s, p, n, (_, label), r in zip(sets, prefixes, need, templates, reach)
        ]
    )

    def known(ws: Column) -> Column:
        return F.transform(ws, lambda w: F.try_element_at(ranks, w))

    def block(line: Column) -> Column:
        return F.array_sort(F.array_distinct(F.filter(known(F.split(F.trim(line), " ")), lambda r: r.isNotNull())))

    def candidates(b: Column) -> Column:
        """Templates that share a prefix word with the block."""
        found = F.transform(b, lambda r: F.coalesce(F.try_element_at(lookup, r), ints([])))
        return F.transform(F.array_distinct(F.flatten(found)), lambda i: F.element_at(table, i + 1))

    def may_meet(b: Column, t: Column) -> Column:
        shared = F.array_min(F.array_intersect(t["prefix"], b))
        after_t = F.size(t["words"]) - F.array_position(t["words"], shared)
        after_b = F.size(b) - F.array_position(b, shared)
        return (F.size(b) >= t["need"]) & (F.least(after_t, after_b) + 1 >= t["need"])

    def met(b: Column) -> Column:
        """struct<label, share> of the templates a block meets."""
        passing = F.filter(candidates(b), lambda t: may_meet(b, t))
        verified = F.filter(passing, lambda t: F.size(F.array_intersect(t["words"], b)) >= t["need"])
        return F.transform(
            verified,
            lambda t: F.struct(t["label"].alias("label"), (F.size(F.array_intersect(t["words"], b)) / F.size(t["words"])).alias("share")),
        )

    def around(near: Column, at: Column) -> Column:
        """struct<label, share> of the templates met by a run of words that holds the prefix word at ``at`` of ``near``."""
        own = F.transform(F.coalesce(F.try_element_at(lookup, near[at]), ints([])), lambda i: F.element_at(table, i + 1))

        def best(t: Column) -> Column:
            starts = F.sequence(F.greatest(at - t["reach"] + 1, F.lit(0)), at)
            return F.array_max(F.transform(starts, lambda s: F.size(F.array_intersect(t["words"], F.slice(near, s + 1, t["reach"])))))

        passing = F.filter(own, lambda t: F.size(F.array_intersect(t["words"], near)) >= t["need"])
        rated = F.transform(passing, lambda t: F.struct(t["label"].alias("label"), best(t).alias("n"), F.size(t["words"]).alias("of"), t["need"].alias("need")))
        return F.transform(
            F.filter(rated, lambda m: m["n"] >= m["need"]), lambda m: F.struct(m["label"].alias("label"), (m["n"] / m["of"]).alias("share"))
        )

    def runs(n: Column) -> Column:
        """What runs of words meet, across lines."""

        def of(ws: Column) -> Column:
            places_of = F.filter(F.transform(ws, lambda w, i: F.when(w.isin([by_rank[r] for r in sorted(index)]), i)), lambda i: i.isNotNull())

            def at(i: Column) -> Column:
                first = F.greatest(i - widest + 1, F.lit(0))
                return let(known(F.slice(ws, first + 1, i - first + widest)), lambda near: around(near, i - first))

            return F.flatten(F.transform(places_of, at))

        return let(F.split(F.trim(n), " "), of)

    column = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    lines = F.filter(F.transform(F.split(column, "\n", -1), normal), lambda s: F.rlike(s, F.lit(holds_rare)))
    nothing = F.expr("cast(array() as array<struct<label:string,share:double>>)")

    def whole(n: Column) -> Column:
        by_line = F.flatten(F.transform(lines, lambda s: let(block(s), met)))
        wrapped = F.when(F.contains(column, F.lit("\n")), runs(n)).otherwise(nothing)
        found = F.when(F.rlike(n, F.lit(holds_rare)), F.concat(by_line, wrapped)).otherwise(nothing)
        return F.struct(
            F.when(n == " ", 0).otherwise(spaces(n) - 1).cast("long").alias("n_words"),
            F.array(*[places(n, p) for p in phrases]).alias("places"),
            found.alias("met"),
        )

    labels = F.array(*[F.lit(v) for v in phrases.values()])
    base = F.array_sort(
        F.array_distinct(
            F.filter(F.transform("__l.places", lambda p, i: F.when(p["n"] > 0, labels[i])), lambda x: x.isNotNull())
        )
    )
    own = F.transform("__l.met", lambda m: m["label"])
    n_base = F.aggregate("__l.places", F.lit(0).cast("long"), lambda a, p: a + p["n"])
    best = F.array_max(F.transform("__l.met", lambda m: m["share"]))
    worked = docs.withColumn("__l", let(normal(column), whole))
    return worked.select(
        *(F.col(f"`{c}`") for c in docs.columns if c not in added),
        F.col("__l.n_words").alias("n_words"),
        n_base.alias("n_base"),
        F.array_min(F.transform("__l.places", lambda p: p["first"])).alias("first_word"),
        F.array_max(F.transform("__l.places", lambda p: p["last"])).alias("last_word"),
        base.alias("base_labels"),
        F.array_sort(F.array_distinct(F.concat(base, own))).alias("labels"),
        F.coalesce(best, F.when(n_base > 0, 0.5), F.lit(0.0)).alias("score"),
    )
