"""Grading: tests of pages against a system's predictions.

Tests come as rows; those of a page are gathered (a page has tens, and its gold file bounds them) and joined to its one
prediction, so each page is read once, whatever the number of its tests: views, folds, tables and marks are made on first
use and shared. Layout tests are native expressions and never reach Python.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagemint.functions import equations, marks
from pagemint.operators import layout
from pagemint.operators.predicates import CellTest, Page, near_empty, number_found, order, repeat, text_found

#: A test as a row: arguments and settings as JSON text, as their file states them.
TESTS = "test_id string, page_id string, test_type string, output_type string, derivation string, tags array<string>, args string, settings string"


Judge = Callable[[Page, dict, dict], tuple[bool, str]]
#: What judges an html test, by test type: a page, the test's arguments and its settings to a verdict.
JUDGES: dict[str, Judge] = {}


def judge(test_type: str) -> Callable[[Judge], Judge]:
    """Register a function as the judge of a test type; grading ships it to the executors."""

    def add(f: Judge) -> Judge:
        JUDGES[test_type] = f
        return f

    return add


def allowed(argument: dict) -> int:
    return argument.get("max_diffs", 0)


@judge("present")
def present(page: Page, args: dict, settings: dict) -> tuple[bool, str]:
    content = args["content"]
    if "number" in content:
        return number_found(page, content["number"])
    if "latex" in content:
        return equations.found(page, content["latex"])
    return text_found(page, content["text"], allowed(content), bool(content.get("exact_case")))


@judge("order")
def ordered(page: Page, args: dict, settings: dict) -> tuple[bool, str]:
    return order(page, args["before"]["text"], args["after"]["text"], allowed(args["before"]))


@judge("repeat")
def repeated(page: Page, args: dict, settings: dict) -> tuple[bool, str]:
    ((kind, text),) = [(k, v) for k, v in args["content"].items() if k in ("text", "number")]
    return repeat(page, kind, text, settings["expected_count"])


@judge("page_near_empty")
def emptied(page: Page, args: dict, settings: dict) -> tuple[bool, str]:
    return near_empty(page, settings["max_chars"])


@judge("table_cell")
def celled(page: Page, args: dict, settings: dict) -> tuple[bool, str]:
    relations = {k: v["text"] for k, v in args.items() if k not in ("cell", "section", "headings", "row_groups")}
    listed = lambda k: [x["text"] for x in args.get(k, [])]
    section = args["section"]["text"] if "section" in args else None
    return CellTest(args["cell"]["text"], relations, allowed(args["cell"]), listed("headings"), section, listed("row_groups")).verdict(page)


@judge("format")
def formatted(page: Page, args: dict, settings: dict) -> tuple[bool, str]:
    context = [args[k]["text"] if k in args else "" for k in ("before", "span", "after")]
    return marks.check(page.marked, *context, settings.get("marks", []), settings.get("absent", []))


def verdict(page: Page, test_type: str, args: dict, settings: dict, judges: dict[str, Judge] = JUDGES) -> tuple[bool, str]:
    """One html test on a page."""
    if test_type not in judges:
        raise ValueError(f"test type {test_type!r} is not known")
    return judges[test_type](page, args, settings)


OUTCOME = [T.StructField("passed", T.BooleanType()), T.StructField("why", T.StringType())]


def page_verdicts(html: str | None, tests: list[dict], judges: dict[str, Judge]) -> list[tuple[bool, str]]:
    """All html tests of a page, which is read once; no output fails them."""
    if html is None:
        return [(False, "no html output")] * len(tests)
    page = Page(html)
    return [verdict(page, t["test_type"], json.loads(t["args"]), json.loads(t["settings"]), judges) for t in tests]


def judged(rows: DataFrame) -> DataFrame:
    """Rows that hold a page (html) and its tests (an array of structs with test_type, args and settings), with these two
    replaced by ``verdicts``, an array of passed and why in the order of the tests.

    Row by row: nothing is shuffled, sorted or gathered, so a task's memory does not depend on its number of rows.
    """
    kept = [c for c in rows.columns if c not in ("html", "tests")]
    out, judges = T.StructType([*rows.select(kept).schema.fields, T.StructField("verdicts", T.ArrayType(T.StructType(OUTCOME)))]), dict(JUDGES)
    kind = pa.list_(pa.struct([("passed", pa.bool_()), ("why", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pages = zip(batch.column("html").to_pylist(), batch.column("tests").to_pylist())
            got = [[{"passed": p, "why": w} for p, w in page_verdicts(html, of, judges)] for html, of in pages]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(got, kind)], out.names)

    return rows.select(*kept, "html", "tests").mapInArrow(run, out)


def html_lines(tests: DataFrame, predictions: DataFrame) -> DataFrame:
    """Html tests with passed and why; predictions are (page_id, html). No output fails a page's tests.

    A test goes to its page with all its columns, so nothing is joined back to the verdicts.
    """
    gathered = tests.groupBy("page_id").agg(F.collect_list(F.struct(*[F.col(c) for c in tests.columns])).alias("tests"))
    joined = gathered.join(predictions.select("page_id", "html"), "page_id", "left").select("html", "tests")
    out, judges = T.StructType([*tests.schema.fields, *OUTCOME]), dict(JUDGES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pages = zip(batch.column("html").to_pylist(), batch.column("tests").to_pylist())
            got = [v for html, of in pages for v in page_verdicts(html, of, judges)]
            own = batch.column("tests").flatten().flatten()
            passed, why = (pa.array([g[k] for g in got], t) for k, t in enumerate((pa.bool_(), pa.string())))
            yield pa.RecordBatch.from_arrays([*own, passed, why], out.names)

    return joined.mapInArrow(run, out)


BLOCKS = "array<struct<label:string,bbox:array<double>,text:string>>"


def layout_lines(tests: DataFrame, predictions: DataFrame) -> DataFrame:
    """The same of layout tests; predictions are (page_id, blocks). Malformed blocks fail their page's layout tests."""
    typed = tests.withColumns(
        {
            "__place": F.from_json(F.get_json_object("args", "$.content.place"), "array<array<double>>"),
            "__kind": F.get_json_object("settings", "$.kind"),
        }
    )
    placed = typed.join(predictions.select("page_id", F.col("blocks").alias("__blocks")), "page_id", "left")
    judged = layout.layout_kind(placed, "__place", "__kind", "__blocks")
    well_formed = layout.valid_blocks(F.col("__blocks"))
    return judged.select(
        *tests.columns,
        (F.col("passed") & well_formed).alias("passed"),
        F.when(F.col("__blocks").isNull(), "no blocks output").when(~well_formed, "malformed blocks output").otherwise(F.col("why")).alias("why"),
    )


def grade(tests: DataFrame, predictions: DataFrame, pages: DataFrame) -> DataFrame:
    """Test lines: every test with its page's document and suite, passed and why.

    ``predictions`` has page_id, html and blocks (either may be null), one row a page; pages without one fail. Everything
    is keyed by page, so tests, pages and predictions are shuffled by it once.
    """
    # by page before anything is gathered: gathering ahead of the shuffle would sort all tests that a task has read
    placed = tests.repartition("page_id").join(pages.select("page_id", "document", "suite"), "page_id")
    blocks = F.col("output_type") == "blocks"
    lined = html_lines(placed.where(~blocks), predictions).unionByName(layout_lines(placed.where(blocks), predictions))
    return lined.withColumn("arg_kinds", arg_kinds(F.col("test_type"), F.col("args")))


def arg_kinds(test_type, args):
    """Kinds of a test's arguments, in fixed order; none for layout tests, whose text only labels a place."""
    has = lambda k: F.when(F.rlike(args, F.lit(rf'"{k}"\s*:')), k)
    kinds = F.filter(F.array(has("text"), has("number"), has("latex")), lambda k: k.isNotNull())
    return F.when(test_type == "layout_kind", F.expr("cast(array() as array<string>)")).otherwise(kinds)
