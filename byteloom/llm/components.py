"""Connected components of an edge table by alternating large-star and small-star steps.

Every step is a minimum per node and an equi-join that adaptive execution can split,
so no component is ever brought into one task; edges are cut from their lineage by checkpoints.
Equal edges, loops and edges in both directions count once; without edges there are no rows; null ends are no edges.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def _pairs(edges: DataFrame, *pairs: tuple[str, str]) -> DataFrame:
    """Both given pairs of columns of each row, as rows, in one pass."""
    return edges.select(F.explode(F.array(*[F.struct(F.col(x).alias("u"), F.col(y).alias("v")) for x, y in pairs])).alias("e")).select("e.u", "e.v")


def _large(edges: DataFrame) -> DataFrame:
    both = _pairs(edges, ("a", "b"), ("b", "a"))
    # the minima are stored: the join then reads no aggregate, and adaptive execution can split a star's root
    least = common.stored(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m")), edges.sparkSession)
    return both.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    return _pairs(down.join(least, "u"), ("v", "m"), ("u", "m")).toDF("a", "b").where("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of an edge, root the smallest node of its component; edges have long columns a, b."""
    spark = edges.sparkSession
    edges = common.stored(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), spark)
    mark = None
    while True:
        seen = edges.agg(F.count("*"), F.sum(F.pmod(F.xxhash64("a", "b"), F.lit(1 << 31)))).first()
        if tuple(seen) == mark:
            break
        mark = tuple(seen)
        edges = common.stored(_small(_large(edges)), spark)
    roots = edges.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("root"))
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots)
