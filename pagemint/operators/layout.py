"""Layout verdicts: the block that holds a place, by area, and whether its label is the one asked for.

All of it is expressions over arrays of boxes ([x0, y0, x1, y1], shares of the page), so a page's blocks are never
exploded: no shuffle beyond the join that brings tests and predictions together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemint import vocab

MIN_COVER, SLACK = 0.5, 1e-9
#: Labels that pass for text.
AS_TEXT = ("text", "list", "form")


def area(box: Column) -> Column:
    zero = F.lit(0.0)
    return F.greatest(zero, box[2] - box[0]) * F.greatest(zero, box[3] - box[1])


def intersection(a: Column, b: Column) -> Column:
    return F.array(F.greatest(a[0], b[0]), F.greatest(a[1], b[1]), F.least(a[2], b[2]), F.least(a[3], b[3]))


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)


def holder(place: Column, blocks: Column) -> Column:
    """The smallest block that covers at least half of the place's area, the first of about equal ones; null without one.

    ``place`` is an array of boxes, ``blocks`` an array of structs with bbox. A block replaces an earlier one only if it is
    smaller by more than a relative slack, so the fold runs in list order.
    """
    whole = total(F.transform(place, area))
    covered = lambda b: total(F.transform(place, lambda p: area(intersection(p, b["bbox"])))) / F.nullif(whole, F.lit(0.0))
    fitting = F.filter(blocks, lambda b: covered(b) >= MIN_COVER - SLACK)
    first = F.when(F.size(fitting) > 0, F.get(fitting, F.lit(0)))
    smaller = lambda best, b: F.when(area(b["bbox"]) < area(best["bbox"]) * (1 - SLACK), b).otherwise(best)
    return F.when(whole > 0, F.aggregate(fitting, first, smaller))


def valid_blocks(blocks: Column) -> Column:
    """Whether every block has a known label and a box of four numbers from 0 to 1."""
    inside = lambda x: F.coalesce((x >= 0) & (x <= 1), F.lit(False))
    whole = lambda b: b["label"].isin(*vocab.LABELS) & (F.size(b["bbox"]) == 4) & F.forall(b["bbox"], inside)
    return F.coalesce(F.forall(blocks, lambda b: F.coalesce(whole(b), F.lit(False))), F.lit(False))


def layout_kind(rows: DataFrame, place: str = "place", kind: str = "kind", blocks: str = "blocks") -> DataFrame:
    """Add held_by (label of the holder, null without one), passed and why."""
    held = rows.withColumn("held_by", holder(F.col(place), F.col(blocks))["label"])
    asked, label = F.col(kind), F.col("held_by")
    passed = F.coalesce(F.when(asked == "text", label.isin(*AS_TEXT)).otherwise(label == asked), F.lit(False))
    why = (
        F.when(passed, "")
        .when(label.isNull(), F.lit("no block covers 50% of its place"))
        .otherwise(F.concat(F.lit("its block is labelled '"), label, F.lit("', not '"), asked, F.lit("'")))
    )
    return held.withColumn("passed", passed).withColumn("why", why)
