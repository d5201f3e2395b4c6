"""Connected components of a table of links, without gathering them.

Each round every node points at the smallest of itself and its neighbours (a
grouped minimum, combined before the shuffle, so hubs don't gather rows), the
pointers are followed once, and the links are drawn anew between the nodes
pointed at. Links inside one node vanish, so later rounds hold only what is
not joined yet. Rounds end when no link is left; then the pointers of the
rounds are composed from the last to the first.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from presence.llm.textkit import stored


def components(links: DataFrame, purpose: str = "components") -> DataFrame:
    """(a, b) links, ids of any integer type -> (node, label): the smallest
    id reachable. Only nodes with links are returned; null ends and loops
    link nothing; repeated links count once; no links give no rows."""

    def drawn(pairs: DataFrame) -> DataFrame:
        ordered = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        return stored(ordered.filter("a != b").distinct(), purpose)

    links = drawn(links.select("a", "b").filter("a is not null and b is not null"))
    rounds = []
    while not links.isEmpty():
        ends = links.union(links.select("b", "a"))
        near = ends.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("near")).select("node", F.least("node", "near").alias("mid"))
        jump = near.select(F.col("node").alias("mid"), F.col("mid").alias("far"))
        # every node with links has a row, so the one pointed at has one too
        to = stored(near.join(jump, "mid").select("node", F.col("far").alias("label")), purpose)
        rounds.append(to)
        at = lambda x: to.select(F.col("node").alias(x), F.col("label").alias(f"to_{x}"))  # noqa: B023, E731
        links = drawn(links.join(at("b"), "b").join(at("a"), "a").select(F.col("to_a").alias("a"), F.col("to_b").alias("b")))
    if not rounds:
        return links.select(F.col("a").alias("node"), F.col("b").alias("label"))
    labels = rounds.pop()
    while rounds:
        later = labels.select(F.col("node").alias("label"), F.col("label").alias("last"))
        labels = rounds.pop().join(later, "label", "left").select("node", F.coalesce("last", "label").alias("label"))
        labels = stored(labels, purpose)
    return labels
