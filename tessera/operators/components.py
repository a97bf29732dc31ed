"""Connected components of a link table, by contraction in DataFrames."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.store import dropped, stored


def components(links: DataFrame) -> DataFrame:
    """links(a long, b long) -> (node, root) for each node with a link to another.

    In each round a node moves to the node of the least seeded weight within
    two steps, links are rewritten to the new nodes, and those within one node
    vanish. All sums run over least values, so hubs cost no task more than its
    share. The expected number of rounds is logarithmic. Links with a null end
    and links of a node to itself count for nothing; repeated ones count once.
    """
    edges = stored(links.filter("a <> b").select("a", "b"))
    moves: list[DataFrame] = []
    while not edges.isEmpty():
        weight = lambda c: F.struct(F.xxhash64(c, F.lit(len(moves))).alias("w"), F.col(c).alias("v"))
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        near = both.groupBy("a").agg(F.least(F.min(weight("b")), F.min(weight("a"))).alias("m"))
        near = stored(near)
        reach = both.join(near.select(F.col("a").alias("b"), F.col("m").alias("mb")), "b").groupBy("a").agg(F.min("mb").alias("mb"))
        move = stored(near.join(reach, "a").select(F.col("a").alias("node"), F.least("m", "mb")["v"].alias("root")))
        moves.append(move)
        left = move.select(F.col("node").alias("a"), F.col("root").alias("ra"))
        right = move.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        before = edges
        edges = stored(edges.join(left, "a").join(right, "b").filter("ra <> rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct())
        dropped(before, near)
    if not moves:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    labels = moves[0]
    for move in moves[1:]:
        nxt = move.select(F.col("node").alias("root"), F.col("root").alias("next"))
        labels = labels.join(nxt, "root", "left").select("node", F.coalesce("next", "root").alias("root"))
    labels = stored(labels)
    dropped(edges, *moves)
    return labels
