"""Connected components of an edge table, by contraction to least neighbours."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

#: Doublings of the pointers to least neighbours in a round.
JUMPS = 3
MAX_ROUNDS = 60


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the least node reachable, for every node of ``edges`` (u, v); self-loops and repeats may occur.

    In each round every node points to its least neighbour, pointers are followed a few steps, and edges
    are moved to where their ends point; those within one node vanish, so a dense group shrinks at once.
    Rounds go on until no edge is left. Their tables are written to the shared folder; unlike a checkpoint,
    a table read again has its true size, where estimates would multiply with each round's joins.
    """
    ordered = [F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")]
    now = written(edges.select(*ordered).where("u <> v").distinct(), "edges")
    labels = now.selectExpr("u AS node", "u AS component").limit(0)
    for turn in range(MAX_ROUNDS):
        if now.isEmpty():
            return labels
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        point = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("p"))
        for _ in range(JUMPS):
            point = point.join(point.selectExpr("u AS p", "p AS q"), "p").selectExpr("u", "q AS p")
        point = written(point, "points")
        if turn == 0:
            labels = point.selectExpr("u AS node", "p AS component")
        else:
            moved = labels.join(point.selectExpr("u AS component", "p"), "component", "left")
            labels = written(moved.select("node", F.coalesce("p", "component").alias("component")), "labels")
        from_u = now.hint("merge").join(point.hint("merge"), "u").selectExpr("p AS u", "v")
        from_v = from_u.hint("merge").join(point.selectExpr("u AS v", "p").hint("merge"), "v").selectExpr("u", "p AS v")
        now = written(from_v.select(*ordered).where("u <> v").distinct(), "edges")
    raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
