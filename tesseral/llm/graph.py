"""Connected components as alternating star contractions over shared-folder tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, stored


def _star(pairs: DataFrame) -> DataFrame:
    """(u, v) with m, the least of u and its neighbours. The minima are a stored table, so that a hub's rows can be split in the join."""
    least = pairs.groupBy("u").agg(F.min("v").alias("w")).select("u", F.least("u", "w").alias("m"))
    return pairs.join(materialize(least, "least"), "u")


def _settled(star: DataFrame) -> bool:
    """Whether every node has one root and no root hangs below another node."""
    ends = star.where("u != v").select(F.explode(F.array(F.struct(F.col("u").alias("x"), F.lit(1).alias("below")), F.struct(F.col("v").alias("x"), F.lit(0).alias("below")))).alias("e"))
    seen = ends.groupBy("e.x").agg(F.sum("e.below").alias("below"), F.min("e.below").alias("root")).where("below > 1 or (below > 0 and root = 0)")
    return not seen.head(1)


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Labels (node, comp) of every node in edges(src, dst), both long; comp is the least node of the component.

    Large-star and small-star steps alternate until every edge points at a root;
    no neighbour list is ever gathered, a hub only meets a partial minimum. An edge
    from a node to itself gives that node; null ends are ignored; no edges, no rows.
    """
    edges = edges.select(F.col("src").cast("long").alias("u"), F.col("dst").cast("long").alias("v")).dropna()
    loops = edges.select(F.explode(F.array("u", "v")).alias("u")).select("u", F.col("u").alias("v"))
    now = materialize(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).unionByName(loops).distinct(), "star")
    for _ in range(rounds):
        if _settled(now):
            return materialize(now.groupBy("u").agg(F.min("v").alias("v")).select(F.col("u").alias("node"), F.col("v").alias("comp")), "components")
        with stored(edges.sparkSession) as keep:
            both = now.unionByName(now.where("u != v").select(F.col("v").alias("u"), F.col("u").alias("v")))
            large = materialize(_star(both).where("v >= u").select(F.col("v").alias("u"), F.col("m").alias("v")), "large")
            small = _star(large).select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.u", "e.v")
            now = materialize(small.distinct(), "star")
            keep(now)
    raise RuntimeError("components did not settle")
