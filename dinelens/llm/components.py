"""Connected components by repeated contraction, for links of any number.

Each round orders the nodes at random (a hash of node and round), maps every
node to the first among itself and its neighbours (a grouped minimum, combined
before the shuffle) and replaces the ends of all links by these; links inside
one node vanish. A constant share of the nodes goes each round, chains
included. The tables are written, so that no lineage grows; the maps are
composed afterwards. Nothing but the answer "any links left?" reaches the
driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dinelens.llm.common import materialise


def connected_components(links: DataFrame) -> DataFrame:
    """``node, component`` for every node of ``links`` (columns ``a, b``).

    ``component`` is the smallest node reachable, itself included. NULL ends
    and links of a node to itself are ignored; repeated links count once.
    """
    maps: list[DataFrame] = []
    links = materialise(links.select("a", "b").filter("a <> b").distinct(), "links")
    while not links.isEmpty():
        order = F.lit(len(maps))
        both = F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("x")
        ends = links.select(both).select(F.col("x.a").alias("node"), F.struct(F.xxhash64("x.b", order).alias("h"), F.col("x.b").alias("to")).alias("n"))
        first = ends.groupBy("node").agg(F.min("n").alias("n"))
        own = F.struct(F.xxhash64("node", order).alias("h"), F.col("node").alias("to"))
        step = materialise(first.select("node", F.least("n", own)["to"].alias("to")), "map")
        maps.append(step)
        of_a = step.select(F.col("node").alias("a"), F.col("to").alias("ta"))
        of_b = step.select(F.col("node").alias("b"), F.col("to").alias("tb"))
        moved = links.join(of_a, "a").join(of_b, "b").filter("ta <> tb")
        links = materialise(moved.select(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b")).distinct(), "links")
    if not maps:
        return links.select(F.col("a").alias("node"), F.col("b").alias("component"))
    found = maps.pop()
    while maps:
        later = found.select(F.col("node").alias("to"), F.col("to").alias("last"))
        found = maps.pop().join(later, "to", "left").select("node", F.coalesce("last", "to").alias("to"))
        found = materialise(found, "composed")
    smallest = found.groupBy("to").agg(F.min("node").alias("component"))
    return found.join(smallest, "to").select("node", "component")
