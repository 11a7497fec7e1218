"""Connected components of a link table, by contraction in joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayline.llm.common import pin, unpin


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (u, v); nodes have the same root if and only if links connect them.

    Each round every node moves to the neighbour (or itself) with the smallest hash,
    salted by the round; links between moved nodes are the next, smaller graph.  A
    long chain shrinks by a constant part per round as well as a star does.  Each
    round is written down, so a lost executor costs at most one round.  Null ends and
    loops link nothing; no links give no rows.
    """
    links = pin(links.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).where("u <> v").distinct())
    moves: list[DataFrame] = []
    while not links.isEmpty():
        ranked = lambda c: F.struct(F.xxhash64(F.col(c), F.lit(len(moves))).alias("h"), F.col(c).alias("id"))  # noqa: B023, E731
        both = links.select("u", "v").union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        near = both.groupBy("u").agg(F.min(ranked("v")).alias("near"))
        move = pin(near.select(F.col("u").alias("node"), F.least("near", ranked("u"))["id"].alias("root")))
        moves.append(move)
        moved = links.join(move.select(F.col("node").alias("u"), F.col("root").alias("p")), "u").join(move.select(F.col("node").alias("v"), F.col("root").alias("q")), "v")
        left, links = links, pin(moved.select(F.least("p", "q").alias("u"), F.greatest("p", "q").alias("v")).where("u <> v").distinct())
        unpin(left)
    if not moves:
        return links.select(F.col("u").alias("node"), F.col("v").alias("root"))
    where = moves[0]
    for move in moves[1:]:
        step = move.select(F.col("node").alias("root"), F.col("root").alias("_next"))
        before, where = where, pin(where.join(step, "root", "left").select("node", F.coalesce("_next", "root").alias("root")))
        unpin(before, move)
    return where
