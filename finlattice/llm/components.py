"""Connected components of an edge table by rounds of hooking and pointer jumping, all in DataFrame operations.

Each round hooks a node to its smallest neighbour, jumps pointers to the roots and contracts the edges, so at least half
of the nodes with edges go. Every step is written to the shared folder; nothing is collected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def _some(df: DataFrame) -> bool:
    return bool(df.take(1))


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, root for every node of an edge (root: the smallest node of its component); null and looping edges are ignored."""
    left = written(edges.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).where("a < b").distinct(), "edges")
    total = None
    while _some(left):
        both = left.select(F.col("a").alias("node"), F.col("b").alias("near")).unionByName(left.select(F.col("b").alias("node"), F.col("a").alias("near")))
        hooked = written(both.groupBy("node").agg(F.least(F.first("node"), F.min("near")).alias("root")), "hooks")
        while True:
            up = hooked.select(F.col("node").alias("root"), F.col("root").alias("top"))
            hooked = written(hooked.select("node", "root").join(up, "root").select("node", F.col("top").alias("root"), (F.col("top") != F.col("root")).alias("moved")), "jumps")
            if not _some(hooked.where("moved")):
                break
        roots = hooked.select("node", "root")
        if total is None:
            total = roots
        else:
            up = roots.select(F.col("node").alias("root"), F.col("root").alias("top"))
            total = written(total.join(up, "root", "left").select("node", F.coalesce("top", "root").alias("root")), "roots")
        new = left.join(roots.select(F.col("node").alias("a"), F.col("root").alias("ra")), "a").join(roots.select(F.col("node").alias("b"), F.col("root").alias("rb")), "b")
        left = written(new.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).where("a < b").distinct(), "edges")
    if total is None:
        return left.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return total
