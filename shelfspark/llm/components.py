"""Connected components of a graph in a DataFrame, by alternating large-star and small-star steps (Kiveris et al., 2014).

Each step replaces the edges of a node by edges to the smallest neighbour; the number of rounds grows with the
logarithm of the size.  Smallest neighbours are combined before the shuffle.  Edges are written
each round, so lineage stays short; nothing is collected but two numbers a round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def _pointed(edges: DataFrame) -> DataFrame:
    """a > b, distinct."""
    e = edges.where("a is not null and b is not null and a <> b")
    return e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m"))
    return both.join(least, both["a"] == least["u"]).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), "m")
    moved = edges.join(least, edges["a"] == least["u"]).select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))


def _mark(edges: DataFrame):
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())


def components(edges: DataFrame) -> DataFrame:
    """edges: a, b of one ordered type.  Returns node, component (its smallest node) for each node with an edge
    to another one; null ends, loops and repeated edges say nothing."""
    now = common.written(_pointed(edges), "edges")
    before, mark = None, _mark(now)
    while mark[0] and mark != before:
        star = common.written(_pointed(_large_star(now)), "edges")
        common.discard(now)
        now = common.written(_pointed(_small_star(star)), "edges")
        common.discard(star)
        before, mark = mark, _mark(now)
    ends = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return ends.unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
