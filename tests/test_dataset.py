"""Readers, checks, summaries and statistics."""

import hashlib
import json
import math
import random

import pytest
from pyspark.sql import functions as F

from pagemint.operators import statistics, summary
from pagemint.sources import dataset, replies
from pagemint.streaming.grading import grade_stream

GOOD = {"id": "a", "test_type": "present", "output_type": "html", "derivation": "authored", "tags": ["eng"], "args": {"content": {"text": "Total", "max_diffs": 1}}, "settings": {}}


@pytest.mark.parametrize(
    "change",
    [
        {"id": " "}, {"test_type": "x"}, {"output_type": "blocks"}, {"derivation": "x"}, {"tags": ["English"]}, {"args": {}}, {"settings": {"kind": "text"}}, {"more": 1},
        {"args": {"content": {"text": "Total", "max_diffs": 5}}}, {"args": {"content": {"text": " ", "max_diffs": 0}}}, {"args": {"content": {"number": "16,17"}}},
        {"args": {"content": {"latex": "{"}}}, {"args": {"content": {"text": "Total", "max_diffs": True}}}, {"args": {"content": {"text": "12", "max_diffs": 0, "exact_case": True}}},
        {"test_type": "repeat", "settings": {"expected_count": 0}, "args": {"content": {"text": "a", "max_diffs": 0}}},
        {"test_type": "order", "args": {"before": {"text": "abc", "max_diffs": 0}, "after": {"text": "abc", "max_diffs": 1}}},
        {"test_type": "format", "settings": {"marks": ["sup", "sub"]}, "args": {"span": {"text": "total", "max_diffs": 0}}},
        {"test_type": "format", "settings": {"marks": ["bold"]}, "args": {"span": {"text": "ab", "max_diffs": 0}}},
        {"test_type": "layout_kind", "output_type": "blocks", "settings": {"kind": "text"}, "args": {"content": {"text": "a", "max_diffs": 0}}},
        {"test_type": "page_near_empty", "args": {}, "settings": {"max_chars": -1}},
    ],
)
def test_broken_tests(change):
    assert not dataset.test_errors(GOOD) and dataset.test_errors(GOOD | change)


def test_folder(spark, tmp_path):
    (tmp_path / "gold").mkdir()
    (tmp_path / "gold" / "p1.json").write_text(json.dumps({"tests": [GOOD, GOOD | {"id": "b", "tags": []}]}))
    (tmp_path / "gold" / "p2.json").write_text("[]")
    rows = [("p1", "d", None, "pages/p1.pdf", "gold/p1.json", ["html"], 7), ("p2", "d", " ", "pages/p2.pdf", "gold/p2.json", ["blocks"], 8)]
    columns = "page_id string, document string, suite string, doc_path string, gt_path string, outputs array<string>, more int"
    spark.createDataFrame(rows, columns).write.parquet(str(tmp_path / "manifest.parquet"))
    pages, tests = dataset.read_manifest(spark, str(tmp_path)), dataset.read_gold(spark, str(tmp_path))
    assert {r.suite for r in pages.collect()} == {"other"} and json.loads(pages.first().extra) in ({"more": 7}, {"more": 8})
    assert dataset.manifest_errors(pages).count() == 0
    got = {(r.page_id, r.test_id): r.errors for r in tests.collect()}
    assert got == {("p1", "a"): [], ("p1", "b"): [], ("p2", None): ["gold is no object of tests alone"]}
    good = tests.where("test_id is not null")
    assert {(r.page_id, r.rule) for r in dataset.dataset_errors(pages, good).collect()} == {("p2", "the page has no tests")}
    with pytest.raises(ValueError, match="p2 the page has no tests"):
        dataset.refuse(dataset.dataset_errors(pages, good))
    assert dataset.flat_tests(pages, good).count() == 2


def test_predictions(spark):
    rows = [("a", '{"pages": [{"html": "x", "blocks": [{"label": "text", "bbox": [0, 0, 1, 1]}]}]}'), ("b", '{"pages": []}'), ("c", "no"), ("d", '{"pages": [{}, {}]}')]
    got = {r.page_id: (r.html, r.error) for r in dataset.predictions(spark.createDataFrame(rows, "page_id string, content string")).collect()}
    assert got == {"a": ("x", None), "b": (None, "unusable"), "c": (None, "unusable"), "d": (None, "unusable")}


def test_replies():
    assert replies.reply("<think>hm</think>Here is the page:\n```html\n<p>x</p>\n```") == "<p>x</p>"
    got = replies.blocks('{"bbox_2d": [0, 100, 500, 2000], "type": "section header", "text": "x"}\n{"box_2d": [1, 2, 3, 4], "type": "text", "text": "a "b""}\nnothing')
    assert got == [{"label": "heading", "bbox": [0.1, 0.0, 1.0, 0.5], "text": "x"}, {"label": "text", "bbox": [0.002, 0.001, 0.004, 0.003], "text": 'a "b"'}]
    assert replies.blocks("nothing") is None and replies.unturned([0.1, 0.2, 0.3, 0.4], 90) == [0.2, 0.7, 0.4, 0.9]


def lines(spark, n=200, documents=12):
    rng = random.Random(1)
    types = ["present", "table_cell", "layout_kind", "format"]
    rows = [
        (f"t{i}", f"p{i // 4}", f"d{i // 4 % documents}", "s", rng.choice(types), "authored", ["table", "eng"] if i % 2 else ["math"], ["text"], rng.random() < 0.7)
        for i in range(n)
    ]
    schema = "test_id string, page_id string, document string, suite string, test_type string, derivation string, tags array<string>, arg_kinds array<string>, passed boolean"
    return rows, spark.createDataFrame(rows, schema)


def test_summary(spark):
    rows, df = lines(spark)
    out = summary.as_json(summary.summary(df))
    assert list(out["families"]) == ["text", "tables", "layout", "format"]
    want = [r for r in rows if r[4] == "table_cell"]
    entry = out["families"]["tables"]
    sizes = [sum(r[2] == d for r in want) for d in {r[2] for r in want}]
    assert entry["tests"] == len(want) and entry["documents"] == len(sizes)
    assert math.isclose(entry["score"], sum(r[-1] for r in want) / len(want))
    assert entry["effective_documents"] == round(sum(sizes) ** 2 / sum(s * s for s in sizes), 1)
    assert math.isclose(out["score"], sum(out["families"][f]["score"] for f in ("text", "tables", "layout")) / 3)
    assert out["per_tag"]["table"]["same_tests_as"] == ["eng"] and "same_tests_as" not in out["per_tag"]["math"]
    assert sum(e["tests"] for e in out["per_suite"].values()) == len(rows)
    assert summary.headline(summary.summary(df.limit(0))).first().score is None


def test_intervals(spark):
    rows, df = lines(spark)
    counts = summary.document_counts(summary.page_counts(df))
    got = {(r.slice, r.key): r for r in statistics.intervals(counts, resamples=100, seed=3).collect()}
    documents = sorted({r[2] for r in rows})
    bounds = [sum(math.exp(-1) / math.factorial(i) for i in range(k + 1)) for k in range(11)]
    u = lambda d, draw: int(hashlib.md5(f"{d}:{draw}:3".encode()).hexdigest()[:13], 16) / 2**52
    of, draws = {d: [(r[-1]) for r in rows if r[2] == d and r[4] == "present"] for d in documents}, []
    for draw in range(100):  # Poisson weights of documents
        marks = [m for d in documents for m in of[d] * sum(u(d, draw) >= b for b in bounds)]
        if marks:
            draws.append(sum(marks) / len(marks))
    draws.sort()
    entry = got["per_test_type", "present"]
    at = (len(draws) - 1) * 0.025
    low = draws[int(at)] + (draws[int(at) + 1] - draws[int(at)]) * (at - int(at))
    assert entry.draws == len(draws) and math.isclose(entry.low, low)
    assert entry.low <= entry.score <= entry.high and got["headline", ""].draws == 100
    for bad in (dict(resamples=99), dict(level=1.0)):
        with pytest.raises(ValueError):
            statistics.intervals(counts, **bad)


def test_paired_and_hashed(spark):
    _, df = lines(spark)
    counts = summary.document_counts(summary.page_counts(df))
    worse = counts.withColumn("passed", F.lit(0).cast("long"))
    got = {(r.slice, r.key): r for r in statistics.paired(counts, worse, resamples=100).collect()}
    entry = got["headline", ""]
    assert entry.gap > 0 and entry.excludes_zero and entry.documents == 12
    assert statistics.pairing(counts, worse).first().documents_mismatched == 0
    with pytest.raises(ValueError, match="no document in both"):
        statistics.paired(counts, counts.withColumn("document", F.concat(F.lit("x"), "document")))
    weights = statistics.draws_for(counts, 500, 1)
    mean = weights.agg(F.sum("weight")).first()[0] / (12 * 500)
    assert 0.95 < mean < 1.05


def test_reliability(spark):
    rng = random.Random(2)
    counts, totals = [], []
    for s in range(6):
        for d in range(40):
            good = sum(rng.random() < 0.3 + 0.1 * s for _ in range(5))
            noise = sum(rng.random() < 0.5 for _ in range(5))
            counts += [(f"s{s}", "per_tag", "skill", f"d{d:02}", 5, good), (f"s{s}", "per_tag", "noise", f"d{d:02}", 5, noise)]
            totals.append((f"s{s}", f"d{d:02}", 10, good + noise))
    c = spark.createDataFrame(counts, "system string, slice string, key string, document string, tests long, passed long")
    t = spark.createDataFrame(totals, "system string, document string, tests long, passed long")
    got = {r.key: r for r in statistics.reliability(c, t, splits=20).collect()}
    assert got["skill"].agreement > 0.8 and got["noise"].agreement < got["skill"].agreement
    assert got["noise"].documents == 40 and got["noise"].agreement_splits == 20
    with pytest.raises(ValueError):
        statistics.reliability(c.where("system <> 's0'").where("system <> 's1'"), t.where("system > 's1'"))
    sizes = spark.createDataFrame([(f"d{i}", i // 4) for i in range(11)], "document string, tests long")
    for balanced in (True, False):
        halves = statistics.halves(sizes, 8, 0, balanced).toPandas()
        assert len(halves) == 88 and set(halves.groupby("split").half.apply(lambda h: (h == "A").sum())) <= {5, 6}


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    write = lambda name, *rows: (tmp_path / "in" / name).write_text("\n".join(json.dumps({"page_id": p, "html": h}) for p, h in rows))
    args = json.dumps({"content": {"text": "hello", "max_diffs": 0}})
    tests = spark.createDataFrame(
        [(f"t{p}", p, "present", "html", "authored", ["eng"], args, "{}") for p in ("a", "b")],
        "test_id string, page_id string, test_type string, output_type string, derivation string, tags array<string>, args string, settings string",
    )
    pages = spark.createDataFrame([("a", "d", "s"), ("b", "d", "s")], "page_id string, document string, suite string")
    go = lambda: grade_stream(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "state"), tests, pages).awaitTermination()
    write("1.json", ("a", "hello"))
    go()
    write("2.json", ("a", "bye"), ("b", "bye"))
    go()
    assert {(r.page_id, r.passed) for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {("a", True), ("b", False)}
