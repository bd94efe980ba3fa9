"""What pictures of a mapping are drawn from: points, lines and places as frames; drawing itself is left to whoever has a library for it."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.hw import HardwareConfig
from tessera.operators.metrics import adjacency_order


def adjacency_points(valid: DataFrame, placement: DataFrame) -> DataFrame:
    """x, y, distance, valid: a point for each edge that ``slices.valid_edges`` marked, both ends in order of core and address."""
    order = adjacency_order(placement)
    out = valid.join(order.toDF("src", "x"), "src").join(order.toDF("tgt", "y"), "tgt")
    return out.select("x", "y", F.col("distance").cast("long").alias("distance"), "valid")


def circle(labels: DataFrame) -> DataFrame:
    """cluster, neurons, x, y: clusters in their order on a circle of radius 1, each at the middle of its share of the neurons."""
    from tessera.graph import ranked

    sizes = ranked(labels, F.col("cluster"), ["neuron"], "at").groupBy("cluster").agg(F.count("*").alias("neurons"), F.min("at").alias("first"))
    total = labels.agg(F.count("*").alias("total"))
    angle = 2 * math.pi * (F.col("first") + F.col("neurons") / 2) / F.col("total")
    return sizes.crossJoin(total).select("cluster", "neurons", F.round(F.cos(angle), 9).alias("x"), F.round(F.sin(angle), 9).alias("y"))


def routing_tree(neurons: DataFrame, hw: HardwareConfig) -> DataFrame:
    """level, router, parent, x: every core (level 0) and router above it, at the mean place of the cores below; the root has parent -1."""
    levels = F.explode(F.sequence(F.lit(0), F.lit(hw.l))).alias("level")
    each = neurons.sparkSession.range(hw.cores).select(F.col("id").alias("core"), levels)
    router = F.expr(f"core DIV CAST(pow({hw.r}, level) AS BIGINT)")
    own = each.groupBy(F.col("level").cast("long").alias("level"), router.alias("router")).agg(F.avg("core").alias("x"))
    return own.select("level", "router", F.when(F.col("level") == hw.l, -1).otherwise(F.expr(f"router DIV {hw.r}")).cast("long").alias("parent"), "x")


def hardware_map(placement: DataFrame, hw: HardwareConfig) -> DataFrame:
    """core, x, y, neurons, share: cores on a square grid, row by row, with how full they are."""
    side = math.ceil(math.sqrt(hw.cores))
    held = placement.groupBy("core").agg(F.count("*").alias("k"))
    grid = placement.sparkSession.range(hw.cores).select(F.col("id").alias("core"), (F.col("id") % side).alias("x"), F.expr(f"id DIV {side}").alias("y"))
    k = F.coalesce("k", F.lit(0)).cast("long")
    return grid.join(held, "core", "left").select("core", "x", "y", k.alias("neurons"), (k / hw.n).alias("share"))
