"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, write_once

_ROUNDS = 60


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One step: the neighbours of each node (of a small star: the smaller ones and itself) are tied to the least of them."""
    if large:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        both = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    tied = both.join(least, "a")
    out = tied.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")) if large else tied.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return out.where("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of ``edges`` (a, b): root is the least node of its component. Nothing is collected but counts."""
    current = write_once(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "graph")
    mark = F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))
    seen = current.agg(F.count("*"), mark).first()
    for _ in range(_ROUNDS):
        before, current = current, write_once(_star(_star(current, True), False), "graph")
        discard(before)
        now = current.agg(F.count("*"), mark).first()
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError("components did not settle")
    roots = current.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return current.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)
