"""Connected components of an edge table by alternating large-star and small-star steps.

Every step is a grouped minimum (combined before the shuffle) joined back to the edges,
so a node with very many neighbours only makes a skewed join, which Spark splits.
Nothing is collected; each round is cut by a checkpoint in the shared folder. The edges, counted
as they are written, lie in as few partitions as they need, so that small graphs cost few tasks and files. The rounds end
when every node has one smaller neighbour or only larger ones: then each component is a star around its least node.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut_few, few


def _least(edges: DataFrame) -> DataFrame:
    return edges.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("g"), F.least("u", "m").alias("m"))


def _stars(both: DataFrame) -> bool:
    """Whether the edges, each in both directions, are stars around their least nodes."""
    ends = both.groupBy("u").agg(F.count_if(F.col("v") < F.col("u")).alias("below"), F.count(F.lit(1)).alias("n"))
    return not ends.agg(F.count_if((F.col("below") > 1) | (F.col("below") == 1) & (F.col("n") > 1))).first()[0]


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """edges (u, v) -> node, root: the least node of the component, for nodes with an edge."""
    now, rows = cut_few(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    for _ in range(rounds):
        both = few(now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v"))), rows)
        if _stars(both):
            break
        met = both.join(_least(both), F.col("u") == F.col("g")).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        large = few(few(met, rows).distinct(), rows)
        small = (
            large.join(_least(large), F.col("u") == F.col("g"))
            .select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("e"))
            .select(F.col("e.v").alias("u"), F.col("e.m").alias("v"))
            .where("u <> v")
        )
        now, rows = cut_few(few(few(small, rows).distinct(), rows))
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(few(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct(), rows))
