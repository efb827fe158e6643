"""Markdown pages, and functions by name."""

import pytest

from pagemint.functions import markdown, sql, views


@pytest.mark.parametrize(
    ("text", "shown"),
    [
        ("# Title\n\n29. Item\n- bullet", "Title 29. Item - bullet"),
        ("**bold** *it* ~~del~~ `co*de`", "bold it del co*de"),
        ("```markdown\n# A\nb\n```", "A b"),
        ("---\ntitle: x\n---\nbody", "body"),
        ("| A | B |\n|---|---|\n| 1 | 2 |\n| x |", "A B 1 2 x"),
        ("write <name@host.org>, P < 0.05 & more", "write <name@host.org>, P < 0.05 & more"),
        ("![chart of sales](a.png) [text](b)", "chart of sales text"),
        ("$\\{x\\}$ and $a_1$ and \\$5", "$\\{x\\}$ and $a_1$ and $5"),
        ("> quote\n> more", "quote more"),
        ("<table><tr><td>1</td></tr>\n\n<tr><td>2</td></tr></table>\nx", "1 2 x"),
        ("Head\n====\ntext", "Head text"),
        ("a_b_c and 2*3*4", "a_b_c and 234"),
        ("    indented\n    page", "indented page"),
    ],
)
def test_to_html(text, shown):
    assert " ".join(views.visible(markdown.to_html(text)).split()) == shown


def test_tables():
    assert "<table>" not in markdown.to_html("| A | B |\n| 1 | 2 |")
    assert markdown.cells("| $5 | $x_1 | y$ | $2.5 | ($27.8) |") == ["$5", "$x_1 | y$", "$2.5", "($27.8)"]


def test_description():
    assert markdown.description('a "b" <i>c</i>') == '<img alt="a &quot;b&quot; c">' and markdown.description(" ") == "<img>"
    assert markdown.reply_html("Here:\n\n```html\n<p>**x**</p>\n```") == "<p>**x**</p>"
    assert markdown.reply_html("# T") == "<h1>T</h1>\n"


def test_registered(spark):
    sql.register(spark)
    row = spark.sql(
        "SELECT page_fold(page_text('<b>A</b>&amp;')) AS a, number_core('1,240') AS b, search_distance('abc', 'xabd') AS c, "
        "likeness('ab', 'ab') AS d, markdown_html('# x') AS e"
    ).first()
    assert tuple(row) == ("a&", "1240", 1, 1.0, "<h1>x</h1>\n")
    assert [r.body for r in spark.sql("SELECT body FROM math_spans('$a$ and $5')").collect()] == ["a"]
    assert spark.sql("SELECT text FROM html_table_cells('<table><tr><td>q</td></tr></table>')").first().text == "q"
