"""Equations: what renders alike, what a page holds, what plain text writes."""

import pytest

from pagemint.functions.equations import found
from pagemint.operators.predicates import Page


@pytest.mark.parametrize(
    ("latex", "html", "passed"),
    [
        ("x^2", "$$x^{2}$$", True), ("x = 1", r"\(x=1\)", True), (r"\frac{a}{b}", r"$\dfrac ab$", True), (r"\mathbf{x}+y", "$x + y$", True),
        (r"\sin x", "$sin x$", True), (r"\epsilon", r"$\varepsilon$", True), (r"\hat{x}", r"$\widehat{x}$", True), ("a+b=c", r"\begin{align}a+b=c\tag{1}\end{align}", True),
        ("a=1, b=2", "<p>$a=1,$</p><p>$b=2$</p>", True), (r"\alpha = 0.05", "p at α = 0.05.", True), (r"x+y", r"$x+y\unknowna$", True), ("x^2", "<p>x^2</p>", True),
        ("x^2", "$X^2$", False), ("E=mc", "$E=mc^2$", False), ("x+1=0", "$-x+1=0$", False), ("x=1", "$x=10$", False), (r"\alpha=0.05", "α = 0.050", False),
        (r"\frac12", "1/2", False), ("x^2", "so x^2 grows here", False), ("x", "no math", False),
    ],
)
def test_found(latex, html, passed):
    assert found(Page(html), latex)[0] is passed
