"""Connected components of a link table, by alternating large-star and small-star rounds (Kiveris et al., 2014).

Each round is a grouped minimum (combined before the shuffle) and an equi-join whose hot keys Spark splits, written to the
shared folder, so lineage stays short and no links are collected anywhere.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemint.llm.common import forget, stored

#: More rounds than any real table needs: rounds grow with the logarithm of the longest path.
MOST_ROUNDS = 60


# The minima are stored before they are joined back: Spark splits the hot keys of a join only where neither side is an
# aggregate on the same key, and a star's centre may be such a key.


def _settled(links: DataFrame) -> bool:
    """Whether the links are stars: every node has one link, and no centre is a node of another star."""
    several = links.groupBy("a").agg(F.count("*").alias("n")).where("n > 1")
    inner = links.select(F.col("b").alias("a")).join(links, "a", "left_semi")
    return several.isEmpty() and inner.isEmpty()


def _large_star(links: DataFrame, used: list[DataFrame]) -> DataFrame:
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = stored(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "minima")
    used.append(least)
    return both.join(least, "a").where("b > a and b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(links: DataFrame, used: list[DataFrame]) -> DataFrame:
    down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = stored(down.groupBy("a").agg(F.min("b").alias("m")), "minima")
    used.append(least)
    moved = down.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b of one orderable type, a <> b) but the roots; a root is the least node."""
    links = stored(links.select("a", "b").where("a <> b").distinct(), "links")
    for _ in range(MOST_ROUNDS):
        used = [links]
        links = stored(_small_star(_large_star(links, used), used), "links")
        forget(*used)  # the round is written: nothing reads what it was made from
        if _settled(links):
            return links.select(F.col("a").alias("node"), F.col("b").alias("root"))
    raise RuntimeError("the components did not settle")
