"""Places of regular-expression matches as DataFrame expressions, in code points.

SQL functions give the matches of a pattern and the gaps between them, but not where they are. The places are running
sums of the lengths of gaps and matches; the sums are made by doubling steps, so they cost n log n for n matches.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Doubling steps: running sums over up to 2^STEPS matches in one text; each is skipped where a text has fewer.
STEPS = 24


def let(value: Column, body) -> Column:
    """``body`` of a column that is worked out once for each row."""
    return F.transform(F.array(value), body)[0]


def running_sums(sizes: Column) -> Column:
    """array<int> of sums up to and with each element."""

    def step(sums: Column, width: int) -> Column:
        added = lambda a: F.transform(a, lambda x, i: x + F.when(i >= width, a[i - width]).otherwise(0))
        return let(sums, lambda a: F.when(F.size(a) > width, added(a)).otherwise(a))

    for k in range(STEPS):
        sizes = step(sizes, 1 << k)
    return sizes


def matches(text: Column, pattern: str, kind: int, value_group: int = 0) -> Column:
    """array<struct<kind, start, end, value>> of the leftmost non-overlapping matches, in order; end is exclusive."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(value_group)) if value_group else found
    gaps = F.transform(F.split(text, pattern, -1), F.length)

    def placed(s: Column) -> Column:
        sizes = F.zip_with(s["gaps"], s["found"], lambda g, m: F.coalesce(g, F.lit(0)) + F.coalesce(F.length(m), F.lit(0)))
        return let(
            F.struct(running_sums(sizes).alias("ends"), s["found"].alias("found"), s["values"].alias("values")),
            lambda p: F.transform(
                p["found"],
                lambda m, i: F.struct(
                    F.lit(kind).alias("kind"),
                    (p["ends"][i] - F.length(m)).cast("int").alias("start"),
                    p["ends"][i].cast("int").alias("end"),
                    p["values"][i].alias("value"),
                ),
            ),
        )

    return let(F.struct(gaps.alias("gaps"), found.alias("found"), values.alias("values")), placed)


def none() -> Column:
    return F.expr("cast(array() as array<struct<kind:int,start:int,end:int,value:string>>)")


def joined(spans: Column, names: list[str]) -> Column:
    """kind:start:end of each, comma-joined."""
    kinds = F.array(*[F.lit(n) for n in names])
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", F.element_at(kinds, s["kind"] + 1), s["start"], s["end"])), ","
    )


def by_start(spans: Column) -> Column:
    order = F.transform(spans, lambda s: F.struct(s["start"], s["kind"], s["end"], s["value"]))
    return F.transform(F.array_sort(order), lambda s: F.struct(s["kind"], s["start"], s["end"], s["value"]))


def count(spans: Column, kind: int) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")
