"""License scans against plain Python: phrase places, and every line against every template."""

import random
import re

from pagemint.llm import license_join as L

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(t):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))


def brute(t, share=0.8):
    ws, starts, base = words(t), [], set()
    for phrase, label in L.PHRASES.items():
        p = phrase.split()
        found = [i for i in range(len(ws)) if ws[i : i + len(p)] == p]
        starts += found
        base |= {label} if found else set()
    met = []
    for line in (t or "").split("\n"):
        have = set(words(line))
        for template, label in L.TEMPLATES:
            want = set(template.split())
            if len(want & have) >= share * len(want) - 1e-9:
                met.append((label, len(want & have) / len(want)))
    labels = sorted(base | {m[0] for m in met})
    score = max((m[1] for m in met), default=0.5 if starts else 0.0)
    return len(ws), len(starts), min(starts, default=None), max(starts, default=None), sorted(base), labels, score


def texts():
    rng = random.Random(2)
    vocabulary = sorted({w for t, _ in L.TEMPLATES for w in t.split()}) + ["é", "MIT", "License.", "x"]
    out = ["", " .,", "MIT License", "mit license mit-license MIT  LICENSE", "mit licenses", "general public license\nApache License"]
    for t, _ in L.TEMPLATES:
        w = t.split()
        for _ in range(12):
            kept = [x for x in w if rng.random() < 0.9]
            rng.shuffle(kept)
            out.append("lorem\n" + " ".join(kept + rng.choices(vocabulary, k=rng.randint(0, 6))).upper() + "\nipsum dolor")
    out += [" ".join(rng.choices(vocabulary, k=rng.randint(1, 60))) for _ in range(200)]
    return [*out, "mit license " * 20000]


def test_scan(spark):
    rows = [(i, t, "s") for i, t in enumerate(texts())] + [(-1, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r.doc_id: r for r in L.scan(df).collect()}
    for i, t, _ in rows:
        r = got[i]
        mine = (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, r.score)
        assert mine == brute(t), (i, (t or "")[:200])


def test_empty(spark):
    assert L.scan(spark.createDataFrame([], "doc_id long, text string")).count() == 0


WRAPPED = {
    "x y\n# Redistribution and use in source and binary forms, with or without\n# modification, are permitted provided": "bsd",
    "lorem\nThis program is free software: you can redistribute it and/or modify\n * it under the terms of the GNU\n": "gpl",
    "All rights reserved. Unauthorized copying of this file, via any medium\nis strictly prohibited": "proprietary",
    "\n".join("Permission is hereby granted, free of charge, to any person obtaining a copy of this software".split()): "mit",
    "All rights reserved.\n" + "ipsum\n" * 40 + "Unauthorized copying of this file": None,
}


def brute_runs(t, share=0.8):
    ws, met = words(t), []
    for template, label in L.TEMPLATES:
        want, reach = set(template.split()), -(-3 * len(template.split()) // 2)
        best = max((len(want & set(ws[i : i + reach])) for i in range(max(1, len(ws) - reach + 1))), default=0)
        if best >= share * len(want) - 1e-9:
            met.append((label, best / len(want)))
    return met


def test_wrapped(spark):
    rng = random.Random(8)
    made = ["\n".join(" ".join(rng.choices(t.split() + ["x"], k=rng.randint(1, 9))) for _ in range(9)) for t, _ in L.TEMPLATES for _ in range(8)]
    rows = list(enumerate([*WRAPPED, *made]))
    got = {r.doc_id: r for r in L.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for (i, t), label in zip(rows, WRAPPED.values()):
        assert got[i].labels == ([label] if label else []), t
    for i, t in rows:
        by_line, runs = brute(t), brute_runs(t)
        assert got[i].labels == sorted({*by_line[5], *(m[0] for m in runs)}), t
        assert got[i].score == max([by_line[6], *(m[1] for m in runs)]), t
