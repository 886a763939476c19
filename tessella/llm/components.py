"""Connected components of a table of links by repeated contraction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm._shared import materialise


def ranked(node: str, turn: int) -> Column:
    """What nodes are ordered by in a round; the node is its last field."""
    rank = F.lit(0).cast("long") if turn == 0 else F.xxhash64(node, F.lit(turn))
    return F.struct(rank.alias("rank"), F.col(node).alias("node"))


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of links (a, b): nodes have equal roots if and only if links connect them.

    In each round every node moves to the neighbour that comes first, in the order of the nodes in the first round
    (so stars around their smallest node end at once) and in a new random order after that, so that any graph, a long
    chain as well, shrinks by a constant factor a round. Minima are taken before the shuffle, so a node with very many
    links isn't gathered anywhere; links and moves are tables and never reach the driver. Links may repeat, stand in
    either direction or join a node to itself; nulls are left out."""
    links = materialise(links.select("a", "b").where("a is not null and b is not null").distinct(), "links", small=True)
    nodes = links.select(F.col("a").alias("node")).union(links.select("b")).distinct()
    moved = materialise(nodes.select("node", F.col("node").alias("root")), "roots", small=True)
    links, turn = links.where("a != b"), 0
    while not links.isEmpty():
        both = links.select("a", "b").union(links.select("b", "a"))
        first = both.groupBy("a").agg(F.min(ranked("b", turn)).alias("other"))
        moves = materialise(first.select(F.col("a").alias("node"), F.least("other", ranked("a", turn))["node"].alias("to")), "moves", small=True)
        to_a, to_b = (moves.select(F.col("node").alias(c), F.col("to").alias(f"to_{c}")) for c in "ab")
        again = links.join(to_a, "a").join(to_b, "b").where("to_a != to_b")
        links = materialise(again.select(F.least("to_a", "to_b").alias("a"), F.greatest("to_a", "to_b").alias("b")).distinct(), "links", small=True)
        moved = materialise(moved.join(moves.withColumnRenamed("node", "root"), "root", "left").select("node", F.coalesce("to", "root").alias("root")), "roots", small=True)
        turn += 1
    return moved
