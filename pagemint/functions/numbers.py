"""Numbers as printed: what one token writes, and where a text holds it digit for digit."""

from __future__ import annotations

import re
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

# The shape of a printed number.
SHAPE = r"^(\()?([-−–])?([$€£¥])?(\d{1,3}(?:[,.  ]\d{3})*(?:[.,]\d+)?|\d+(?:[.,]\d+)?)(%)?(\))?[.,;:]?$"
CLEAN = {" ": " ", " ": " ", "−": "-", "–": "-", "—": "-"}
_SHAPE, _CLEAN = re.compile(SHAPE), str.maketrans(CLEAN)


class Number(NamedTuple):
    core: str  # digits, and a point before decimals
    negative: bool
    percent: bool
    written: str  # as printed, without sign, currency and percent


def read(text: str) -> Number | None:
    """The number a token writes; None when it is none or its separators can be read two ways."""
    m = _SHAPE.match(text.strip())
    if m is None:
        return None
    digits = re.sub(r"[  ]", "", m[4])
    marks = re.findall(r"[.,]", digits)
    at = max(digits.rfind("."), digits.rfind(","))
    whole, tail = digits[: max(at, 0)], digits[at + 1 :]
    if not marks:
        core = digits
    elif len(marks) == 1:
        if marks[0] == "," and len(tail) == 3 and whole != "0":
            core = whole + tail
        elif marks[0] == "," and len(tail) < 3:
            return None
        else:
            core = f"{whole}.{tail}"
    else:
        bare = re.sub("[.,]", "", whole)
        decimal = marks[-1] not in marks[:-1] or len(tail) in (1, 2)
        core = f"{bare}.{tail}" if decimal else bare + tail
    return Number(core, bool(m[2]), bool(m[5]), m[4])


def pattern(written: str, escape=re.escape) -> str:
    """Where a text holds a number as written: bounded by non-digits; group 1 is what stands before, group 2 a percent sign."""
    body = escape(written.translate(_CLEAN))
    return rf"(?<!\d)(?<!\d[.,])((?<!\w)-(?=[\d$€£¥])|\(\s?)?(?:[$€£¥]\s?)?{body}(?![.,]\d)(\s?%)?\)?(?!\d)"


def clean(text: str) -> str:
    return text.translate(_CLEAN)


class Printed(NamedTuple):
    """The signs around a number's digits at one place of a text."""

    negative: bool
    percent: bool

    @classmethod
    def of(cls, m: re.Match[str]) -> Printed:
        return cls((m[1] or "").strip() == "-", m[2] is not None)

    def writes(self, number: Number) -> bool:
        """Whether it has the number's sign and, if the number has one, its percent sign."""
        return self.negative == number.negative and self.percent >= number.percent


def number_column(text: Column) -> Column:
    """``read`` as native expressions: struct<core, negative, percent>, null where a token is no clear number."""
    part = lambda i: F.regexp_extract(F.trim(text), SHAPE, i)
    digits = F.regexp_replace(part(4), "[  ]", "")
    bare = lambda c: F.regexp_replace(c, "[.,]", "")
    marks = F.length(digits) - F.length(bare(digits))
    whole, mark, tail = (F.regexp_extract(digits, r"^(.*)([.,])(\d+)$", i) for i in (1, 2, 3))
    pointed = F.concat(bare(whole), F.lit("."), tail)
    one = (
        F.when((mark == ",") & (F.length(tail) == 3) & (whole != "0"), F.concat(whole, tail))
        .when((mark == ",") & (F.length(tail) < 3), F.lit(None).cast("string"))
        .otherwise(F.concat(whole, F.lit("."), tail))
    )
    several = F.when(~F.contains(whole, mark) | F.length(tail).isin(1, 2), pointed).otherwise(bare(digits))
    core = F.when(marks == 0, digits).when(marks == 1, one).otherwise(several)
    fits = F.rlike(F.trim(text), F.lit(SHAPE)) & core.isNotNull()
    return F.when(fits, F.struct(core.alias("core"), (part(2) != "").alias("negative"), (part(5) != "").alias("percent")))
