"""Connected components of a link table by alternating large-star and small-star steps.

Every step is a minimum per node (partial aggregation) and a join back, so no
node's neighbours meet in one row and nothing is collected to the driver.
Lineage is cut by ``checkpoint()`` in the session's shared checkpoint folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _starred(links: DataFrame, larger: bool) -> DataFrame:
    """One star step over links (a > b): large-star moves a node's larger neighbours, small-star its smaller ones."""
    if larger:
        both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        both = links
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    joined = both.join(least, "a")
    if larger:
        moved = joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        moved = (joined.select(F.col("b").alias("a"), F.col("m").alias("b"))
                 .unionByName(joined.select("a", F.col("m").alias("b"))))
    return moved.where("a > b").distinct()


def _mark(links: DataFrame) -> tuple:
    row = links.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x"),
                    F.max("b").alias("top")).first()
    return tuple(row)


def component_roots(pairs: DataFrame, left: str, right: str, rounds: int = 100) -> DataFrame:
    """(node, root) for every node of the undirected pairs; root is the smallest node of its component.

    Ends when a double step changes nothing.  ``rounds`` bounds a run that would
    not converge (the step count grows with the logarithm of the longest path);
    reaching it is an error, never a partial result.  No pairs give no rows;
    repeated pairs and pairs of a node with itself change nothing; a pair with a
    null end is no link.
    """
    a, b = F.col(left), F.col(right)
    links = pairs.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).where(a.isNotNull() & b.isNotNull())
    links = links.where("a > b").distinct().checkpoint()
    mark = _mark(links)
    for _ in range(rounds):
        links = _starred(_starred(links, True), False).checkpoint()
        now = _mark(links)
        if now == mark:
            roots = links.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("root"))
            return links.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)
        mark = now
    raise RuntimeError(f"components did not settle in {rounds} rounds")
