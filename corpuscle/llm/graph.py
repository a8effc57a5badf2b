"""Connected components over an edge table, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuscle.session import written


def components(edges: DataFrame) -> DataFrame:
    """(id, root) for every vertex of ``edges`` (a, b); vertices of one component share the root.

    Each round every vertex moves to its smallest neighbour and the edges between the new vertices
    remain; the vertices shrink by a factor a round, and a star is done in one.  Later rounds order
    vertices by a hash so that a chain of rising ids does not take as many rounds as it has links.
    Each round's map and edges are written to the shared folder, so a lost executor costs one
    round's tasks.  Only the emptiness of the edge table reaches the driver.
    """
    left = edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).filter("a <> b").distinct()
    left = written(left, "edges")
    maps, turn = [], 0
    while not left.isEmpty():
        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # Natural order first: ids of representatives are often the smallest of their group.
        h = (lambda c: F.lit(0)) if turn < 2 else (lambda c, t=turn: F.xxhash64(c, F.lit(t)))
        rank = lambda c, h=h: F.struct(h(c).alias("h"), F.col(c).alias("v"))
        least = both.groupBy("a").agg(F.min(rank("b")).alias("m"))
        move = written(least.select(F.col("a").alias("id"), F.least("m", rank("a"))["v"].alias("to")), "moves")
        maps.append(move)
        ends = left.join(move.toDF("a", "ta"), "a").join(move.toDF("b", "tb"), "b")
        left = written(ends.filter("ta <> tb").select(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b")).distinct(), "edges")
        turn += 1
    if not maps:
        return left.select(F.col("a").alias("id"), F.col("b").alias("root"))
    out = maps[0].toDF("id", "root")
    for m in maps[1:]:
        out = out.join(m.toDF("root", "next"), "root", "left").select("id", F.coalesce("next", "root").alias("root"))
    return out if len(maps) == 1 else written(out, "roots")
