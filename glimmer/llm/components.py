"""Connected components of an edge table by alternating large-star and small-star steps.

Each step needs a node's least neighbour only; the edges of a node with many neighbours are
dealt to many tasks, so neither a component nor a hub is ever in one. The number of rounds is
logarithmic in the longest path. Every round is cut to the shared folder. Nothing of the graph
reaches the driver but one checksum per round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import beside, cut


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """large: every larger neighbour of u is linked with the least of u's neighbourhood.
    small: u and its smaller neighbours are linked with the least of them."""
    if large:
        seen = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select("b", "a"))
    else:
        seen = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    linked = beside(seen, "u", "v", F.min("v"), F.min, "m").withColumn("m", F.least("u", "m"))
    if large:
        out = linked.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        out = linked.select(F.explode(F.array(F.struct(F.col("v").alias("a"), F.col("m").alias("b")), F.struct(F.col("u").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*")
    return out.where("a <> b").distinct()


def components(edges: DataFrame, src: str, dst: str, rounds: int = 40) -> DataFrame:
    """(node, component): the smallest node that each node of ``edges`` reaches.
    Self-loops, repeated edges and null ends are ignored; nodes without an edge do not appear."""
    now = cut(
        edges.select(F.least(src, dst).alias("b"), F.greatest(src, dst).alias("a"))
        .where(F.col(src).isNotNull() & F.col(dst).isNotNull() & (F.col(src) != F.col(dst)))
        .select("a", "b").distinct(),
        "edges",
    )
    before = None
    for _ in range(rounds):
        now = cut(_star(_star(now, large=True), large=False), "stars")
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(mark) == before:
            break
        before = tuple(mark)
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
        now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )
