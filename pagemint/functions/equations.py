"""Equations of a page, compared by the symbols they render.

An equation becomes a flat list of symbols (letters, numbers, operators, and brackets for scripts, fractions and roots);
it is found where a math span of the output holds the same symbols as an unbroken whole expression.
"""

from __future__ import annotations

import re
from functools import lru_cache

from pagemint.functions import fold, mathtext, views

# Commands whose rendering plain text writes exactly.
PLAIN = frozenset(
    """alpha beta gamma delta epsilon varepsilon zeta eta theta vartheta iota kappa lambda mu nu xi pi varpi rho varrho sigma
    varsigma tau upsilon phi varphi chi psi omega Gamma Delta Theta Lambda Xi Pi Sigma Upsilon Phi Psi Omega pm mp times cdot
    div ast star circ bullet le leq ge geq neq ne approx sim simeq equiv propto ll gg in notin subset subseteq supset supseteq
    cup cap infty partial nabla prime degree ldots cdots dots to rightarrow leftarrow leftrightarrow Rightarrow Leftarrow mid
    left right big Big bigl bigr Bigl Bigr quad qquad mathrm text textrm operatorname""".split()
)
IGNORED = frozenset("left right big Big bigl bigr Bigl Bigr displaystyle textstyle limits nolimits quad qquad nonumber notag".split())
STYLES = frozenset("mathrm text textrm operatorname mathbf mathit mathsf boldsymbol bm mbox textbf textit hbox rm".split())
ENVIRONMENT = re.compile(r"\\begin\{([a-z]+\*?)\}(.*?)\\end\{\1\}", re.S)


def plain(latex: str) -> bool:
    """Whether plain text writes the equation without loss, and it is more than a bare word or number."""
    if set(re.findall(r"\\([A-Za-z]+)", latex)) - PLAIN or re.search(r"[\^_]\{[^{}]*[\\{^_]", latex):
        return False
    return re.search(r"[\\^_=<>+±×·−]", latex) is not None and len(fold.squeeze(f"${latex}$")) >= 2


#: Commands that render alike, and symbols read as one. Fixed values.
ALIASES = {"widehat": "hat", "widetilde": "tilde", "overrightarrow": "vec", "dfrac": "frac", "tfrac": "frac", "cfrac": "frac"}
ALIKE = {"ϵ": "ε", "ϕ": "φ", "ϑ": "θ", "ϱ": "ρ", "-": "−", "*": "∗"}
#: Distinct commands nobody knows that are dropped from an output's math, at most.
MOST_UNKNOWN = 4
TOKEN = re.compile(r"\\([A-Za-z]+)\*?|\\(.)|(\d+(?:\s*(?:\.|\\cdot)\s*\d+)?)|(\s+)|(.)", re.S)
FUNCTION = re.compile(r"sin|cos|tan|log|ln|exp|lim|max|min|sup|inf|det|dim|ker|arg|deg|gcd|Pr")


def _symbols(tex: str, unknown: set[str]) -> list[str]:
    out: list[str] = []
    at = 0
    while at < len(tex):
        m = TOKEN.match(tex, at)
        at = m.end()
        command, escaped, number, space, other = m.groups()
        command = ALIASES.get(command, command)
        if command == "frac":
            top, at = mathtext._group(tex, at)
            low, at = mathtext._group(tex, at)
            out += ["frac(", *_symbols(top, unknown), ",", *_symbols(low, unknown), ")"]
        elif command == "sqrt" or command in mathtext.ACCENTS or command in STYLES:
            body, at = mathtext._group(tex, at)
            inner = _symbols(body, unknown)
            out += inner if command in STYLES else [f"{command}(", *inner, ")"]
        elif command in ("begin", "end", "label", "tag"):
            at = mathtext._group(tex, at)[1]
        elif command in IGNORED or space:
            continue
        elif command in mathtext.SYMBOLS:
            out += [ALIKE.get(c, c) for c in mathtext.SYMBOLS[command] if not c.isspace()]
        elif command is not None:
            if FUNCTION.fullmatch(command):
                out += command
            else:
                unknown.add(command)
        elif escaped is not None:
            out += [] if escaped in ",;:! \\" else [escaped]
        elif other in ("_", "^"):
            body, at = mathtext._group(tex, at)
            out += [f"{other}(", *_symbols(body, unknown), ")"]
        elif other in ("{", "}", "&"):
            continue
        elif number is not None:
            out.append(re.sub(r"\s*(?:\.|\\cdot)\s*", ".", number))
        else:
            out.append(ALIKE.get(other, other))
    return out


@lru_cache(100_000)
def symbols(tex: str, most_unknown: int = 0) -> tuple[str, ...] | None:
    """The symbols an equation renders; None where it is not understood (unbalanced, or too many unknown commands)."""
    unknown: set[str] = set()
    if not mathtext.balanced(tex):
        return None
    out = tuple(_symbols(tex, unknown))
    return out if len(unknown) <= most_unknown else None


WORDS = re.compile(r"(?<![\\\w])[^\W\d_]{2,}")
DELIMITED = re.compile(r"\\\[(.+?)\\\]|\\\((.+?)\\\)", re.S)


@lru_cache(256)
def _read(html: str) -> tuple[tuple[tuple[str, ...], ...], str]:
    """Symbols of every math span of a page, and the page's text without them."""
    text = views.visible(html)
    bodies = [m[2] for m in ENVIRONMENT.finditer(text)]
    text = ENVIRONMENT.sub(" ", text)
    bodies += [m[1] or m[2] for m in DELIMITED.finditer(text)]
    text = DELIMITED.sub(" ", text)
    found = mathtext.spans(text)
    bodies += [s.body for s in found]
    run = found[:1]
    for s in found[1:]:  # spans with nothing between them may hold one equation
        run = [*run, s] if not text[run[-1].end : s.start].strip() else [s]
        if len(run) > 1:
            bodies.append(" ".join([x.body for x in run]))
    for s in reversed(found):
        text = f"{text[: s.start]} \0 {text[s.end :]}"
    for line in re.split(rf"[\n{views.BREAK}]", text):  # a line that is LaTeX without its delimiters
        if "\0" not in line and mathtext.has_markup(line) and mathtext.balanced(line) and not WORDS.search(line):
            bodies.append(line)
    return tuple(s for s in (symbols(b, MOST_UNKNOWN) for b in bodies) if s), text


def math_of(html: str) -> tuple[tuple[str, ...], ...]:
    return _read(html)[0]


def in_text(latex: str, text: str) -> bool:
    """Whether a text writes an equation plainly: its characters in order, spaces aside, not cut out of a longer expression."""
    want = "".join(fold.fold_cased(f"${latex}$").split())
    if not want:
        return False
    body = r"\s*".join(map(re.escape, want))
    return re.search(rf"(?<![\w.+−-])(?<![+−-]\s){body}(?![\w^])(?![.,]\d)", fold.fold_cased(text)) is not None


def found(page, latex: str) -> tuple[bool, str]:
    """Whether the output's math holds the equation as a whole expression, or, for plain ones, its text does."""
    want = symbols(latex)
    have, rest = _read(page.html)
    if want and any(_holds(want, s) for s in have):
        return True, ""
    if plain(latex) and in_text(latex, rest):
        return True, ""
    if not have:
        return False, "no math in the output"
    return False, f"equation not found ({len(want or ())} symbols; the output's math has {max(map(len, have))})"


def _holds(want: tuple[str, ...], have: tuple[str, ...]) -> bool:
    n = len(want)
    for i in range(len(have) - n + 1):
        if have[i : i + n] != want:
            continue
        before, after = have[i - 1] if i else "", have[i + n] if i + n < len(have) else ""
        if not (before in ("+", "−", "_(", "^(") or after in ("_(", "^(") or want[-1][:1].isdigit() and after[:1].isdigit()):
            return True
    return False
