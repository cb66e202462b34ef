"""Connected components by alternating star contraction; no step gathers a component in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import kept

SALTS = 16


def salted(many: DataFrame, few: DataFrame, keys: list[str], spread: Column, how: str = "inner", salts: int = SALTS) -> DataFrame:
    """Join with one row per key in `few`: a key with many rows is dealt to `salts` tasks by `spread`.

    Both sides are sorted and merged: `few` grows with the input, so it is never sent to all tasks by way of the driver."""
    few = few.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))).hint("merge")
    return many.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int")).join(few, [*keys, "_salt"], how).drop("_salt")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of each node of the undirected edges (a, b): root is the least node of its component.

    Large stars and small stars alternate until every node that isn't a root has one parent, a root. That takes about
    the logarithm of the longest chain, and no round at all for stars around their least node."""
    now = kept(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    while True:
        ends = now.select(F.col("a").alias("n"), F.lit(1).alias("child"), F.lit(0).alias("root")).union(now.select("b", F.lit(0), F.lit(1)))
        unsettled = ends.groupBy("n").agg(F.sum("child").alias("parents"), F.max("root").alias("root")).where("parents > 1 or parents > 0 and root > 0")
        if not unsettled.count():
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        both = now.select("a", "b").union(now.select(F.col("b"), F.col("a")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = salted(both, least, ["a"], F.col("b")).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = salted(large, least, ["a"], F.col("b")).select(F.explode(F.array(F.struct("b", "m"), F.struct(F.col("a").alias("b"), "m"))).alias("x")).select(F.col("x.b").alias("a"), F.col("x.m").alias("b"))
        now = kept(small.where("a != b").distinct())
