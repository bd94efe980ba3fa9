"""Trees of clusters, tree(cluster, parent) with -1 above the root, and the hardware that holds them.

A tree has a row for each cluster, not for each neuron; walks go a level a round in SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.hw import HardwareConfig
from tessera.operators.searches import levels_for


def walked(tree: DataFrame, branches: int = 0) -> DataFrame:
    """cluster, depth, core of each cluster: core is its path of child ranks in base ``branches``."""
    ranked = tree.select("cluster", "parent", (F.row_number().over(Window.partitionBy("parent").orderBy("cluster")) - 1).cast("long").alias("k"))
    return tree.sparkSession.sql(
        f"""WITH RECURSIVE walk AS (
              SELECT cluster, CAST(0 AS BIGINT) AS depth, CAST(0 AS BIGINT) AS core FROM {{t}} WHERE parent = -1
              UNION ALL SELECT t.cluster, w.depth + 1, w.core * {int(branches)} + t.k FROM {{t}} t JOIN walk w ON t.parent = w.cluster)
            SELECT cluster, depth, core FROM walk""",
        t=ranked,
    )


def children(tree: DataFrame) -> DataFrame:
    """cluster, children of the clusters that have some."""
    return tree.where("parent >= 0").groupBy(F.col("parent").alias("cluster")).agg(F.count("*").alias("children"))


def leaves(tree: DataFrame) -> DataFrame:
    return tree.select("cluster").join(children(tree), "cluster", "left_anti")


def described(tree: DataFrame) -> DataFrame:
    """cluster, depth, children."""
    return walked(tree).select("cluster", "depth").join(children(tree), "cluster", "left").select(F.col("cluster").cast("long").alias("cluster"), "depth", F.coalesce("children", F.lit(0)).cast("long").alias("children"))


def sizes(labels: DataFrame) -> DataFrame:
    return labels.groupBy("cluster").agg(F.count("*").alias("neurons"))


def with_neurons(tree: DataFrame, labels: DataFrame) -> DataFrame:
    """cluster, children, neurons, both as sorted arrays: a tree as adjacency lists with what its leaves hold."""
    kids = tree.where("parent >= 0").groupBy(F.col("parent").alias("cluster")).agg(F.array_sort(F.collect_list("cluster")).alias("children"))
    held = labels.groupBy("cluster").agg(F.array_sort(F.collect_list("neuron")).alias("neurons"))
    none = F.array().cast("array<long>")
    return tree.select("cluster").join(kids, "cluster", "left").join(held, "cluster", "left").select("cluster", F.coalesce("children", none).alias("children"), F.coalesce("neurons", none).alias("neurons"))


def leaf_distance(tree: DataFrame) -> DataFrame:
    """a, b, distance of all pairs of leaves: levels from a up to where both meet."""
    up = tree.sparkSession.sql(
        """WITH RECURSIVE up AS (
             SELECT cluster AS leaf, cluster AS at, CAST(0 AS BIGINT) AS k FROM {leaf}
             UNION ALL SELECT u.leaf, t.parent, u.k + 1 FROM up u JOIN {t} t ON t.cluster = u.at WHERE t.parent >= 0)
           SELECT leaf, at, k FROM up""",
        leaf=leaves(tree),
        t=tree,
    )
    both = up.select(F.col("leaf").alias("a"), "at", "k").join(up.select(F.col("leaf").alias("b"), "at"), "at")
    return both.groupBy(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).agg(F.min("k").alias("distance"))


def flat_rebuild(tree: DataFrame, labels: DataFrame, f: int = 2) -> HardwareConfig:
    """Hardware for labels as they are: cores of the largest size, routers of the mean number of children rounded up, and as many
    levels as the leaves need, by whole numbers.  Four small aggregates come to the driver."""
    size, clusters = sizes(labels).agg(F.max("neurons"), F.count("*")).first()
    kids, routers = children(tree).agg(F.sum("children"), F.count("*")).first()
    r = 1 if clusters <= 1 or not routers else max(2, -(-kids // routers))
    return HardwareConfig(r, max(1, size or 1), levels_for(clusters, r) if clusters > 1 else 0, min(f, max(1, size or 1)))


def padded(tree: DataFrame, labels: DataFrame, f: int = 2) -> tuple[HardwareConfig, DataFrame]:
    """(hardware, cluster and core of each leaf): a leaf's core is its path from the root in base r, the largest number of children;
    levels are the depth of the first leaf, and cores between paths stay empty."""
    size = max(1, sizes(labels).agg(F.max("neurons")).first()[0] or 1)
    r = children(tree).agg(F.max("children")).first()[0] or 1
    at = walked(tree, r).join(leaves(tree), "cluster")
    depth = at.orderBy("cluster").first()["depth"]
    return HardwareConfig(r, size, depth, min(f, size)), at.select(F.col("cluster").cast("long").alias("cluster"), "core")


def on_cores(labels: DataFrame, cores: DataFrame) -> DataFrame:
    """neuron, core of neurons whose clusters have cores."""
    return labels.join(cores, "cluster").select("neuron", "core")


def expanded(labels: DataFrame, levels: list[DataFrame]) -> DataFrame:
    """neuron, level0, level1, ...: labels carried up through tables level(cluster, parent), the finest first."""
    out = labels.select("neuron", F.col("cluster").alias("level0"))
    for k, level in enumerate(levels):
        out = out.join(level.toDF(f"level{k}", f"level{k + 1}"), f"level{k}")
    return out.select("neuron", *(f"level{k}" for k in range(len(levels) + 1)))


def active_level(level: DataFrame, active: DataFrame) -> DataFrame:
    """cluster, parent for active(cluster) alone, parents numbered 0, 1, ... in their order."""
    from tessera.graph import dense_labels

    kept = level.join(active, "cluster", "left_semi").distinct()
    return dense_labels(kept.withColumnRenamed("parent", "old"), "old", "parent").select("cluster", "parent")


def legacy_slices(edges: DataFrame, labels: DataFrame, local: DataFrame, distances: DataFrame, core_sizes: DataFrame, neurons: DataFrame, below: int) -> DataFrame:
    """neuron, distance, slice by an older rule: halving slices on leaf distances below ``below`` alone (the last level is left out, and
    distance 0 is not); ties and none go to slice 0 or the lowest.  Superseded by ``slices.optimal_slices``."""
    at = edges.join(labels.toDF("src", "a"), "src").join(labels.toDF("tgt", "b"), "tgt").join(distances, ["a", "b"]).join(local.toDF("src", "x"), "src").join(core_sizes.toDF("a", "size"), "a")
    hits = at.where(F.col("distance") < below).groupBy("tgt", "distance", F.expr("CAST(x * CAST(pow(2, distance) AS BIGINT) DIV size AS BIGINT)").alias("slice")).agg(F.count("*").alias("hits"))
    best = hits.groupBy("tgt", "distance").agg(F.max(F.struct("hits", (-F.col("slice")).alias("s"))).alias("m")).select(F.col("tgt").alias("neuron"), "distance", (-F.col("m.s")).alias("slice"))
    grid = neurons.select(F.col("id").alias("neuron"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(below - 1).cast("long"))).alias("distance"))
    return grid.join(best, ["neuron", "distance"], "left").select("neuron", "distance", F.coalesce("slice", F.lit(0)).cast("long").alias("slice"))


def round_robin(neurons: DataFrame, cores: int) -> DataFrame:
    """What is left where neurons have no links: dealt out in turn."""
    return neurons.select(F.col("id").alias("neuron"), (F.col("id") % cores).alias("core"))


def hyperedges(neurons: DataFrame, edges: DataFrame, labels: DataFrame) -> DataFrame:
    """net, pin: a neuron and its sources within its cluster."""
    from tessera.operators.metrics import induced

    inside = induced(edges, labels).select(F.col("tgt").alias("net"), F.col("src").alias("pin"))
    return inside.union(neurons.select("id", "id")).distinct()
