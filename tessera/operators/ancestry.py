"""Ancestors in trees of any size by doubling, tree(cluster, parent) with -1 above a root: rounds in the logarithm of the depth.

Nothing is collected: a jump table of 2**k levels is a frame of one row a cluster, written, so that a lost executor costs a re-read.
A forest has several roots; its trees do not meet.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.errors import InvalidConfigError
from tessera.tables import Steps


@dataclass
class Jumps:
    """depths(cluster, depth); levels[k](cluster, up): the cluster 2**k levels above, -1 where there is none."""

    depths: DataFrame
    levels: list[DataFrame]
    kept: Steps


def jumps(tree: DataFrame, most: int = 62) -> Jumps:
    """A cluster above itself is refused, after ``most`` rounds; so is a parent that is no cluster."""
    kept = Steps(tree.sparkSession)
    base = tree.select(F.col("cluster").cast("long").alias("cluster"), F.col("parent").cast("long").alias("up"), (F.col("parent") >= 0).cast("long").alias("depth"))
    base = kept.keep(base, "tree")
    if not base.where("up >= 0").join(base.select(F.col("cluster").alias("up")), "up", "left_anti").isEmpty():
        raise InvalidConfigError("a parent is no cluster")
    size, levels, now = base.count(), [], base
    while not now.where("up >= 0").isEmpty():
        if len(levels) >= most or 2 ** len(levels) > 2 * size:
            raise InvalidConfigError("a cluster lies above itself")
        levels.append(now.select("cluster", "up"))
        far = now.select(F.col("cluster").alias("up"), F.col("up").alias("to"), F.col("depth").alias("more"))
        now = now.join(far, "up", "left").select("cluster", F.coalesce("to", F.lit(-1)).cast("long").alias("up"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"))
        now = kept.keep(now, f"jump{len(levels)}")
    return Jumps(now.select("cluster", "depth"), levels, kept)


def _lifted(df: DataFrame, column: str, level: DataFrame, name: str) -> DataFrame:
    return df.join(level.select(F.col("cluster").alias(column), F.col("up").alias(name)), column, "left").withColumn(name, F.coalesce(name, F.lit(-1).cast("long")))


def meeting(pairs: DataFrame, tree: DataFrame) -> DataFrame:
    """a, b, at, up_a, up_b of the different pairs asked: where both meet and how many levels that is above each; null where they do not
    meet.  Pairs that name no cluster have no row."""
    known = jumps(tree)
    out = pairs.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).distinct()
    for x in "ab":
        out = out.join(known.depths.select(F.col("cluster").alias(x), F.col("depth").alias(f"d{x}")), x)
    out = out.withColumn("x", F.col("a")).withColumn("y", F.col("b")).withColumn("more", F.col("da") - F.col("db"))
    for k in reversed(range(len(known.levels))):  # the deeper one goes up to the other's depth
        step = 2**k
        deeper = F.when(F.col("more") >= step, F.col("x")).when(F.col("more") <= -step, F.col("y"))
        out = _lifted(out.withColumn("deep", deeper), "deep", known.levels[k], "to")
        out = out.withColumn("x", F.when(F.col("more") >= step, F.col("to")).otherwise(F.col("x"))).withColumn("y", F.when(F.col("more") <= -step, F.col("to")).otherwise(F.col("y")))
        out = out.withColumn("more", F.when(F.col("more") >= step, F.col("more") - step).when(F.col("more") <= -step, F.col("more") + step).otherwise(F.col("more"))).drop("deep", "to")
    for k in reversed(range(len(known.levels))):  # both go up while that keeps them apart
        out = _lifted(_lifted(out, "x", known.levels[k], "to_x"), "y", known.levels[k], "to_y")
        apart = F.col("to_x") != F.col("to_y")
        out = out.withColumn("x", F.when(apart, F.col("to_x")).otherwise(F.col("x"))).withColumn("y", F.when(apart, F.col("to_y")).otherwise(F.col("y"))).drop("to_x", "to_y")
    if known.levels:
        out = _lifted(out, "x", known.levels[0], "above")
    else:
        out = out.withColumn("above", F.lit(-1).cast("long"))
    at = F.when(F.col("x") == F.col("y"), F.col("x")).when(F.col("above") >= 0, F.col("above"))
    out = out.withColumn("at", at).join(known.depths.select(F.col("cluster").alias("at"), F.col("depth").alias("d")), "at", "left")
    return out.select("a", "b", "at", (F.col("da") - F.col("d")).alias("up_a"), (F.col("db") - F.col("d")).alias("up_b"))


def totals(tree: DataFrame, own: DataFrame, value: str) -> DataFrame:
    """cluster, value: the sum of own(cluster, value) over each cluster and all below it; clusters without a value count as 0."""
    known = jumps(tree)
    out = tree.select(F.col("cluster").cast("long").alias("cluster")).join(own.groupBy(F.col("cluster").cast("long").alias("cluster")).agg(F.sum(value).alias("v")), "cluster", "left").na.fill(0, ["v"])
    for k, level in enumerate(known.levels):  # below a cluster within 2**(k+1) levels: those within 2**k, and below those just 2**k away
        far = level.where("up >= 0").join(out, "cluster").groupBy(F.col("up").alias("cluster")).agg(F.sum("v").alias("more"))
        out = known.kept.keep(out.join(far, "cluster", "left").select("cluster", (F.col("v") + F.coalesce("more", F.lit(0))).alias("v")), f"totals{k}")
    return out.withColumnRenamed("v", value)


def members(tree: DataFrame, labels: DataFrame) -> DataFrame:
    """cluster, neuron: every cluster with each neuron that it or a cluster below it holds; a row each, as large as the result."""
    known = jumps(tree)
    out = tree.select(F.col("cluster").cast("long").alias("below"), F.col("cluster").cast("long").alias("cluster"))
    for k, level in enumerate(known.levels):
        far = out.join(level.where("up >= 0"), "cluster").select("below", F.col("up").alias("cluster"))
        out = known.kept.keep(out.union(far), f"members{k}")
    return out.join(labels.select(F.col("cluster").cast("long").alias("below"), "neuron"), "below").select("cluster", "neuron")
