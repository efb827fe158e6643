"""Views, folds, math, numbers, edits, wrapped hyphens: rules by example and by brute force."""

import random
import re
import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pagemint.functions import edits, equations, fold, mathtext, numbers, views


@pytest.mark.parametrize(
    ("html", "text"),
    [
        ("<p>a</p><p>b</p>", "a b"),
        ("12<!-- x -->5", "125"),
        ("<ol start=3><li>x</li><li>y<ul><li>z</li></ul></li></ol>", "3. x 4. y z"),
        ("P < 0.05 and <name@example.com>", "P < 0.05 and <name@example.com>"),
        ("<p>p <q</p><p>r> s</p>", "p <q r> s"),
        ('<span title="a>b">x</span>', "x"),
        ("1,240<sup>1</sup>", "1,240 1"),
        ("<sup>1</sup>1,240", "1 1,240"),
        ("<head><title>t</title></head>x<script>y</script>", "x"),
        ('<input type="checkbox" checked> yes <input type="radio"> no', "☒ yes ☐ no"),
        ('<input value="v"> <img alt="pic"> ![cap](u.png)', "v pic cap"),
        ("<checked> a <unchecked/> b", "☒ a ☐ b"),
        ('<math display="block">x^2</math>', "$$x^2$$"),
        ('<math><mi>x</mi><annotation encoding="application/x-tex">a &lt; b</annotation></math>', "$a < b$"),
        ("<math><mi>x</mi><mo>+</mo></math>", "x+"),
        ("&lt;b&gt; &amp;amp;", "<b> &amp;"),
        ("<o:p></o:p>total", "total"),
    ],
)
def test_visible(html, text):
    assert " ".join(views.visible(html).split()) == text


def test_located():
    page = '<p>A&amp;B <img alt="pic"></p><ol><li>x</li></ol><b>end</b><sup>1</sup>'
    text, places = views.located(page)
    assert text == views.visible(page) and len(places) == len(text)
    at = lambda s: page[slice(*places[text.index(s)])]
    assert at("A") == "A" and at("&") == "&amp;" and at("pic") == '<img alt="pic">' and at("end") == "e"
    for html in ("", "plain", "<b>", "a<br>b", "&nosuch;", "<math>x</math>"):
        assert views.located(html)[0] == views.visible(html)


def test_views_without_alt_and_notes():
    assert views.visible('a<img alt="pic">b', alt=False).split() == ["a", "b"]
    assert views.visible("Smith<sup>1</sup> and 10<sup>5</sup>", notes=False).split() == ["Smith", "and", "10", "5"]


def test_native_views_equal_the_plain_function(spark):
    pages = [
        "<p>a &amp; b</p>", "<table><tr><td>1</td></tr></table>", "x<!-- y -->z", '<img alt="a"> <img alt=\'b\'>', "P < 0.05 <q",
        '<input type="checkbox" checked>', "<input type=radio>", "<script>x</script>y<head>z</head>", "![a](b) <br/> c", '<input value="v">',
        '<span title="a>b">x</span>', "</sup>5", "<!DOCTYPE html><P CLASS='x'>Y</P>", "<ol><li>a</li></ol>", "a<sup>1</sup>", "<math>x</math>", None, "",
    ]
    df = spark.createDataFrame([(i, p) for i, p in enumerate(pages)], "page_id int, html string")
    for r in views.page_views(df).collect():
        page = pages[r.page_id]
        assert r.text == (None if page is None else views.visible(page))
        assert r.seen == (None if page is None else views.visible(page, alt=False))


@pytest.mark.parametrize(
    ("given", "folded"),
    [
        ("$c_{\\text{MC}}$", "cmc"), ("$U$", "u"), ("$$2 . 5 5$$", "2.55"), ("develop-\ners", "developers"), ("Anglo- Saxon", "anglo- saxon"),
        ("DEVELOP- ERS", "developers"), ("1,240¹", "1,240 1"), ("ﬁne", "fine"), ("Smith[1] x", "smith 1 x"), ("• item", "item"),
        ("目次。。。。5", "目次 5"), ("Name ――― 5", "name 5"), ("....... -4.8%", "-4.8%"), ("“x” ‘y’", "\"x\" 'y'"), ("``x''", '"x"'),
        ("Cuo´", "cuó"), ("it´s", "it's"), ("☑ [x] [ ] □", "☒ ☒ ☐ ☐"), ("$5.00 and $6.00", "$5.00 and $6.00"), ("Cost $ and $ x $", "cost $ and x"),
        ("\\(a_2\\)", "a2"), ("$\\frac{1}{2}$", "1/2"), ("3・11", "3・11"), ("a・b", "a·b"), ("2·5", "2.5"), ("Ac​me", "acme"),
        ("ş ţ", "ș ț"), ("⇒ ➡", "→ →"), ("≦ ♢", "≤ ◊"), ("（a）", "(a)"), ("a  b\n c", "a b c"), ("____ x ====", "x"),
    ],
)
def test_fold(given, folded):
    assert fold.fold(given) == folded


def test_fold_variants():
    assert fold.fold_cased("NASA “x”") == 'NASA "x"'
    assert fold.unmarked("Smith[1] and 12[3] 4") == "smith and 12 3 4"
    assert fold.squeeze("a b  c") == "abc"
    assert fold.continuations("self-\naware co-op") == ("self-awareco-op", frozenset({4}))


words = st.lists(st.sampled_from(["lorem", "Ipsum", "AT&T", "é", "1,240", "x-y", "(a)", "50%"]), min_size=1, max_size=8).map(" ".join)


@settings(max_examples=100, deadline=None)
@given(words)
def test_case_space_and_composition_do_not_matter(text):
    assert fold.fold(text) == fold.fold(text.upper()) == fold.fold(text.replace(" ", " \n\t")) == fold.fold(unicodedata.normalize("NFD", text))


def test_native_fold_equals_the_plain_one(spark):
    texts = ["A b  C", "x ... y", "é ____ z", "a\t\nb = = = c", "* * * d", "", "no$", "a.b..c", "'' x", "“x”", "N°"]
    df = spark.createDataFrame([(t,) for t in texts], "text string").selectExpr("text")
    rows = df.where(fold.is_plain(df.text)).select("text", fold.fold_column(df.text).alias("f"), fold.fold_udf("text").alias("g")).collect()
    assert len(rows) == 7 and all(r.f == r.g == fold.fold(r.text) for r in rows)


def test_math_spans():
    body = lambda s: [x.body for x in mathtext.spans(s)]
    assert body("$a$ and $b$") == ["a", "b"]
    assert body("$5.00 to $6.00") == []
    assert body("$92,000; Net +$60,000") == []
    assert body("cost $5 for $x_1$") == ["x_1"]
    assert body("$$x$$ and $y$") == ["x", "y"]
    assert body("\\$5 $z$") == ["z"]
    assert body("$a$$b$") == ["a", "b"]
    assert body("line $a\nb$ c") == []


def test_equations():
    assert equations.symbols("\\frac{a}{b}") == equations.symbols("\\dfrac ab")
    assert equations.symbols("x^{2}") == equations.symbols("x^2") != equations.symbols("x_2")
    assert equations.symbols("{") is None and equations.symbols("\\nosuch") is None
    assert equations.plain("\\alpha = 0.05") and not equations.plain("\\frac12") and not equations.plain("x")


@pytest.mark.parametrize(
    ("token", "core"),
    [("12.5", "12.5"), ("1,240", "1240"), ("1.240", "1.240"), ("0,250", "0.250"), ("16,17", None), ("1,240.50", "1240.50"), ("1.240,5", "1240.5"),
     ("-4.8%", "4.8"), ("($5.00)", "5.00"), ("12 500", "12500"), ("x", None), ("1,2345", "1.2345"), ("1,234,567", "1234567")],
)
def test_numbers(spark, token, core):
    n = numbers.read(token)
    assert (n.core if n else None) == core


def test_native_numbers(spark):
    tokens = ["12.5", "1,240", "1.240", "0,250", "16,17", "1,240.50", "1.240,5", "-4.8%", "($5.00)", "12 500", "x", "1,2345", "1,234,567", "–3", "5."]
    df = spark.createDataFrame([(t,) for t in tokens], "t string")
    for r in df.select("t", numbers.number_column(df.t).alias("n")).collect():
        n = numbers.read(r.t)
        assert (tuple(r.n) if r.n else None) == (n[:3] if n else None), r.t


def test_number_pattern():
    holds = lambda n, t: re.search(numbers.pattern(n), numbers.clean(t)) is not None
    assert holds("12.5", "is 12.5. Next") and not holds("12.5", "12.5.7") and not holds("123", "1234") and holds("12345", "No.12345")
    assert not holds("1,240", "1240") and not holds("12", "12,5")


def osa_search(needle, hay):
    n, m = len(needle), len(hay)
    d = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(1, n + 1):
        d[i][0] = i
        for j in range(1, m + 1):
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (needle[i - 1] != hay[j - 1]))
            if i > 1 and j > 1 and needle[i - 1] == hay[j - 2] and needle[i - 2] == hay[j - 1]:
                d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
    return min(d[n])


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(new[-1], row[j + 1]))
        row = new
    return row[-1]


def test_edits_against_tables():
    rng = random.Random(1)
    for _ in range(1500):
        a, b = ("".join(rng.choices("abc", k=rng.randint(0, k))) for k in (12, 25))
        d = osa_search(a, b)
        assert edits.search_distance(a, b) == d
        k = rng.randint(0, 2)
        assert (edits.search_distance(a, b, k) <= k) == (d <= k)
        if a and b:
            assert edits.likeness(a, b) == 2 * lcs(a, b) / (len(a) + len(b))


def test_near_copies():
    assert [(c.start, c.end) for c in edits.near_copies("aa", "aaa", 0)] == [(0, 2), (1, 3)]
    assert any(c.edits == 1 for c in edits.near_copies("alpha", "an alpa", 1))
    small = {(c.start, c.end) for c in edits.near_copies("abc", "abxabc", 1)}
    assert small <= {(c.start, c.end) for c in edits.near_copies("abc", "abxabc", 2)}


def test_wrapped_hyphens():
    assert edits.wraps_to("self-aware", "is self-\naware now") and edits.wraps_to("selfaware", "self-\naware")
    assert not edits.wraps_to("self-aware", "self aware")
