"""Verdicts of single tests, tables, marks and layout; the grader over DataFrames."""

import json
import time

import pytest

from pagemint.functions import marks, tables
from pagemint.operators import layout
from pagemint.operators.grade import grade
from pagemint.operators.predicates import CellTest, Page, near_empty, number_copies, number_found, order, repeat, text_found


@pytest.mark.parametrize(
    ("text", "most", "html", "passed"),
    [
        ("Total due", 0, "<p>TOTAL <b>due</b>: 40</p>", True), ("Total", 1, "totel", True), ("Total", 0, "totel", False), ("Total", 1, "toatl", True),
        ("Total: 40", 0, "Total: 400", False), ("4.8", 0, "14.8", False), ("4.8", 0, "-4.8", False), ("4.8", 0, "A-4.8", True), ("4.8", 0, "34.8 and 4.8", True),
        ("Total: 40", 1, "Total: 400", False), ("Smith and Jones", 0, "Smith<sup>1</sup> and Jones", True), ("Smith and Jones", 0, "Smith[1] and Jones", True),
        ("Probiotic1", 0, "Probiotic 1", True), ("self-aware", 0, "self-<br>aware", True), ("x1", 0, "x12", False), ("pic", 0, '<img alt="a pic">', True),
        ("lorem ipsum dolor sit amet", 2, "lorem izpsum dolqor sit amet", True), ("lorem ipsum dolor sit amet", 1, "lorem izpsum dolqor sit amet", False),
    ],
)
def test_text(text, most, html, passed):
    assert text_found(Page(html), text, most)[0] is passed


def test_exact_case():
    assert text_found(Page("NASA"), "NASA", 0, True)[0] and not text_found(Page("nasa"), "NASA", 0, True)[0]


@pytest.mark.parametrize(
    ("number", "html", "passed"),
    [("-4.8%", "fell −4.8 %", True), ("4.8", "-4.8", False), ("-4.8", "4.8", False), ("4.8%", "4.8", False), ("1,240", "1240", False), ("1,240", "$1,240.", True),
     ("12.5", "12.5<!-- -->7", False), ("19", "COVID-19", True), ("1,240", "(1,240)", True)],
)
def test_number(number, html, passed):
    assert number_found(Page(html), number)[0] is passed


def test_order_and_repeat():
    page = Page("<p>Alpha</p><p>Beta</p><p>Alpha</p>")
    assert order(page, "Alpha", "Beta", 0)[0] and order(page, "Beta", "Alpha", 0)[0]
    assert not order(Page("Beta Alpha"), "Alpha", "Beta", 0)[0] and not order(Page("Beta"), "Alpha", "Beta", 0)[0]
    assert repeat(page, "text", "alpha", 2)[0] and not repeat(page, "text", "alpha", 1)[0] and repeat(Page("Alphas"), "text", "Alpha", 0)[0]
    assert repeat(Page("well-<br>known and wellknown"), "text", "wellknown", 2)[0]
    assert number_copies(Page("<ol><li>12</li></ol>12 500 and 500"), "500") == 1
    assert number_copies(Page("<td>12</td><td>500</td>"), "500") == 1
    assert number_copies(Page("12 500<sup>1</sup>"), "12 500") == 1


def test_near_empty():
    assert near_empty(Page("<p> 1 </p><math></math><li></li>​"), 1)[0] and not near_empty(Page("text"), 3)[0]
    assert near_empty(Page('<img alt="long description"><input type="hidden" value="v">'), 0)[0]


TABLE = (
    "<table><thead><tr><td>Year</td><td colspan=2>Sales</td></tr><tr><td></td><td>Net</td><td>Gross</td></tr></thead>"
    "<tr><td>North</td><td></td><td></td></tr><tr><td rowspan=2>2024</td><td>1</td><td>2<br>3</td></tr><tr><td>4</td><td>5</td></tr></table>"
)


def test_grid():
    (g,) = tables.parse(TABLE)
    assert g.slots[4] == [(3, 0), (4, 1), (4, 2)] and g.text[3, 2] == "2\n3" and g.headings == {(0, 0), (0, 1), (1, 0), (1, 1), (1, 2)}
    assert g.next["left"][4, 1] == {(3, 0)} and g.next["up"][4, 1] == {(3, 1)}
    assert [g.text[x] for x in g.above((3, 1))] == ["Sales", "Net", "North"]
    assert [g.text[x] for x in g.beside((4, 2))] == ["2024", "4"]
    assert g.section((4, 1)) == ["North"]
    assert tables.span("0") == 1 and tables.span("9999") == 1000 and tables.span("x") == 1
    assert tables.parse("<table></table>") == [] and len(tables.parse("<table><tr><td><table><tr><td>x</td></tr></table></td></tr></table>")) == 2


def test_table_cell():
    page = Page(TABLE)
    ok = lambda *a, **k: CellTest(*a, **k).verdict(page)[0]
    assert ok("5", {"left": "4", "up": "2\n3", "left_heading": "2024"}, 0, headings=["Sales", "Gross"], section="North", row_groups=["2024"])
    assert ok("3", {}, 0) and not ok("5", {"left": "9"}, 0) and not ok("5", {}, 0, headings=["Net"]) and not ok("5", {}, 0, section="South")
    assert ok("1", {"top_heading": "Net"}, 0) and CellTest("1", {}, 0).verdict(Page("no table")) == (False, "no tables found")


@pytest.mark.parametrize(
    ("html", "wanted", "absent", "passed"),
    [
        ("a <b>total</b> due", ["bold"], [], True), ("<b>a total</b> due", ["bold"], [], False), ("a total due", ["bold"], [], False),
        ('a <span style="font-weight:700">total</span> due', ["bold"], [], True), ('<b>a <i style="font-weight:normal">total</i> due</b>', [], ["bold"], True),
        ("a <b><i>total</b></i> due", ["bold", "italic"], [], True), ("a total due", [], ["bold"], False), ("a total <i>due</i>", [], ["bold"], True),
        ('a <u style="text-decoration:none">total</u> <b>due</b>', [], ["underline"], True), ("a <math><b>total</b></math> due", ["bold"], [], False),
        ('a <sup style="vertical-align:sub">total</sup> due', ["sub"], [], True), ("a <strong>to</strong><strong>tal</strong> due", ["bold"], [], True),
    ],
)
def test_marks(html, wanted, absent, passed):
    assert marks.check(marks.read(html), "a ", "total", " due", wanted, absent)[0] is passed


def test_marks_of_crossing_tags_and_deep_pages():
    page = marks.read("<b><i>a</b> b</i>")
    assert [sorted(m) for m in page.marks] == [["bold", "italic"], ["italic"]]
    began = time.time()
    marks.read("<b>" * 30000 + "x" + "</i>" * 1000)
    assert time.time() - began < 5


def test_style():
    effect = marks.style_effect("font: italic 12px serif; font-weight: bold !important; font-weight: normal")
    assert effect.adds == {"italic", "bold"}


def test_holder(spark):
    block = lambda label, *box: (label, [float(x) for x in box], "")
    rows = [
        ("smallest", [[0.1, 0.1, 0.2, 0.2]], "list", [block("table", 0, 0, 1, 1), block("list", 0, 0, 0.5, 0.5)], True),
        ("half", [[0.0, 0.0, 1.0, 1.0]], "text", [block("text", 0, 0, 0.5, 1)], True),
        ("less", [[0.0, 0.0, 1.0, 1.0]], "text", [block("text", 0, 0, 0.499, 1)], False),
        ("tie", [[0.2, 0.2, 0.3, 0.22]], "code", [block("code", 0.2, 0.15, 0.4, 0.25), block("form", 0.2, 0.2, 0.6, 0.25)], True),
        ("as text", [[0.1, 0.1, 0.2, 0.2]], "text", [block("form", 0, 0, 1, 1)], True),
        ("none", [[0.1, 0.1, 0.2, 0.2]], "text", [], False),
        ("null", [[0.1, 0.1, 0.2, 0.2]], "text", None, False),
    ]
    schema = "name string, place array<array<double>>, kind string, blocks array<struct<label:string,bbox:array<double>,text:string>>, want boolean"
    for r in layout.layout_kind(spark.createDataFrame(rows, schema)).collect():
        assert r.passed == r.want, r.name


def test_grade(spark):
    test = lambda i, page, kind, args, settings="{}", output="html": (i, page, kind, output, "authored", ["table"], json.dumps(args), settings)
    text = lambda s: {"text": s, "max_diffs": 0}
    tests = [
        test("t1", "p1", "present", {"content": text("hello")}),
        test("t2", "p1", "present", {"content": {"number": "12.5"}}),
        test("t3", "p1", "present", {"content": {"latex": "x^2"}}),
        test("t4", "p1", "layout_kind", {"content": {**text("hello"), "place": [[0.1, 0.1, 0.2, 0.2]]}}, '{"kind": "text"}', "blocks"),
        test("t5", "p2", "present", {"content": text("hello")}),
        test("t6", "p3", "layout_kind", {"content": {**text("hello"), "place": [[0.1, 0.1, 0.2, 0.2]]}}, '{"kind": "text"}', "blocks"),
    ]
    predictions = [("p1", "<p>Hello 12.5 $x^{2}$</p>", [("text", [0.0, 0.0, 1.0, 1.0], None)]), ("p3", None, [("nonsense", [0.0, 0.0, 1.0, 1.0], None)])]
    pages = [(p, "d", "s") for p in ("p1", "p2", "p3")]
    lines = grade(
        spark.createDataFrame(tests, "test_id string, page_id string, test_type string, output_type string, derivation string, tags array<string>, args string, settings string"),
        spark.createDataFrame(predictions, "page_id string, html string, blocks array<struct<label:string,bbox:array<double>,text:string>>"),
        spark.createDataFrame(pages, "page_id string, document string, suite string"),
    )
    got = {r.test_id: (r.passed, r.why, r.arg_kinds) for r in lines.collect()}
    assert {i: v[0] for i, v in got.items()} == {"t1": True, "t2": True, "t3": True, "t4": True, "t5": False, "t6": False}
    assert got["t5"][1] == "no html output" and got["t6"][1] == "malformed blocks output"
    assert got["t2"][2] == ["number"] and got["t4"][2] == []
