"""Trees kept as parent links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import durable

MAX_DEPTH = 64


def closure(nodes: DataFrame, node: str = "id", parent: str = "parent_id") -> DataFrame:
    """Every (``ancestor``, ``descendant``, ``distance``), each node being its own at distance 0.

    Links are followed level by level until a level adds nothing; a node reached again, as in a cycle, isn't followed.
    Raises if the tree is deeper than ``MAX_DEPTH``.
    """
    links = nodes.select(F.col(node).alias("descendant"), F.col(parent).alias("parent")).filter("descendant IS NOT NULL")
    known = links.select(F.col("descendant").alias("ancestor"), "descendant", F.lit(0).alias("distance")).distinct()
    level = known
    for distance in range(1, MAX_DEPTH):
        step = links.select(F.col("descendant").alias("ancestor"), F.col("parent")).filter("parent IS NOT NULL")
        level = level.join(step, "ancestor").select(F.col("parent").alias("ancestor"), "descendant", F.lit(distance).alias("distance"))
        level = durable(level.join(known.select("ancestor", "descendant"), ["ancestor", "descendant"], "left_anti").distinct())
        if level.isEmpty():
            return known
        known = durable(known.unionByName(level))
    raise ValueError(f"the tree is deeper than {MAX_DEPTH} levels")
