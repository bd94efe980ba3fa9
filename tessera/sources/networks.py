"""Networks drawn from a seed: edges(src, tgt), alike in every engine and run, whatever the partitions.

Candidate pairs come from exploded ranges, not from joins, and where the hardware leaves only a slice of a core to listen to,
only that slice is spelled out.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera import graph
from tessera.functions import scalars
from tessera.hw import HardwareConfig


@dataclass
class Network:
    """A network to map: what an experiment takes.  truth: placement and slices that break nothing, where they are known."""

    id: str
    n: int
    edges: DataFrame
    hw: HardwareConfig | None = None
    descriptions: dict[str, str] = field(default_factory=dict)
    truth: tuple[DataFrame, DataFrame] | None = None

    def __post_init__(self):
        if self.hw is not None and self.n > self.hw.slots:
            raise ValueError("Hardware overflow")


def _pairs(spark: SparkSession, n: int) -> DataFrame:
    others = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    return spark.range(n).withColumnRenamed("id", "src").select("src", others.alias("tgt")).where("src <> tgt")


def drawn(p: Column | float, seed: int, *keys: str) -> Column:
    """Whether the pair named by keys is drawn, with probability p."""
    return graph.uniform(F.concat_ws(":", *keys), seed) < (p if isinstance(p, Column) else F.lit(float(p))) * F.lit(float(2**32))


def erdos_renyi(spark: SparkSession, n: int, p: float, seed: int = 42) -> DataFrame:
    return _pairs(spark, n).where(drawn(p, seed, "src", "tgt"))


def feasible(spark: SparkSession, hw: HardwareConfig, p: float, seed: int = 42, slice_seed: int = 7) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(edges, placement, slices): every neuron listens to one drawn slice at each distance, and links come from there alone, so the
    placement with those slices breaks nothing.  All slots hold a neuron."""
    neurons = spark.range(hw.slots)
    cores = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(hw.cores - 1).cast("long")))
    heard = neurons.select(F.col("id").alias("tgt"), F.expr(f"id DIV {hw.n}").alias("tgt_core"), cores.alias("src_core")).withColumn("distance", hw.distance("src_core", "tgt_core"))
    heard = heard.withColumn("slice", graph.uniform(F.concat_ws(":", "tgt", "distance"), slice_seed) % hw.slices("distance"))
    local = F.explode(F.sequence(hw.low("distance", "slice"), hw.high("distance", "slice") - 1))
    edges = heard.select("tgt", "src_core", local.alias("local")).select((F.col("src_core") * hw.n + F.col("local")).alias("src"), "tgt").where("src <> tgt")
    return edges.where(drawn(p, seed, "src", "tgt")), graph.spread(neurons, hw), graph.random_slices(neurons, hw, slice_seed)


def soft_wta(spark: SparkSession, excitatory: int, inhibitory: int, size: int, neighbour: float = 0.2, e_to_i: float = 0.1, i_to_e: float = 0.8, seed: int = 42) -> DataFrame:
    """Clusters of excitatory neurons with some inhibitory ones: all links within a cluster, others by the types of both ends."""
    source, target = scalars.cluster_of(F.col("src"), size), scalars.cluster_of(F.col("tgt"), size)
    p = scalars.connection_probability(source, target, excitatory, neighbour, e_to_i, i_to_e)
    return _pairs(spark, (excitatory + inhibitory) * size).where(drawn(p, seed, "src", "tgt"))


def wta(spark: SparkSession, n: int, p: float, seed: int = 42) -> DataFrame:
    """A hub, the last neuron, and n - 1 others, each linked to and from it by chance."""
    if n < 2:
        raise ValueError("a hub needs another neuron")
    both = F.explode(F.array(F.struct(F.col("id").alias("src"), F.lit(n - 1).cast("long").alias("tgt")), F.struct(F.lit(n - 1).cast("long").alias("src"), F.col("id").alias("tgt"))))
    return spark.range(n - 1).select(both.alias("e")).select("e.src", "e.tgt").where(drawn(p, seed, "src", "tgt"))


def block_hierarchy(spark: SparkSession, n0: int, b: int, h: int, p0: float, active: float = 1.0, shuffled: bool = False, seed: int = 42) -> DataFrame:
    """src, tgt, height: leaves of n0, b to a branch, h levels; links with probability p0 halved at each level up to where two neurons
    meet.  Neurons that are not active have no links; shuffled neurons get other numbers."""
    pairs = _pairs(spark, n0 * b**h)
    if active < 1:
        pairs = pairs.where(drawn(active, seed + 1, "src")).where(drawn(active, seed + 1, "tgt"))
    height = " + ".join(f"CAST(src DIV {n0 * b**k} <> tgt DIV {n0 * b**k} AS BIGINT)" for k in range(h)) or "CAST(0 AS BIGINT)"
    edges = pairs.withColumn("height", F.expr(height)).where(drawn(F.lit(float(p0)) * F.pow(F.lit(0.5), "height"), seed, "src", "tgt"))
    if shuffled:
        key = graph.uniform(F.col("id").cast("string"), seed + 2)
        names = graph.ranked(spark.range(n0 * b**h).withColumn("h", key), F.shiftright("h", 20), ["h", "id"], "to").select("id", "to")
        edges = edges.join(names.toDF("src", "s"), "src").join(names.toDF("tgt", "t"), "tgt").select(F.col("s").alias("src"), F.col("t").alias("tgt"), "height")
    return edges


def complete(spark: SparkSession, n: int) -> DataFrame:
    return _pairs(spark, n)


def two_components(spark: SparkSession, each: int, joined: int = 0) -> DataFrame:
    """Two complete halves; and, if joined, links from that many neurons of the second to the first neuron of the first."""
    out = _pairs(spark, 2 * each).where(f"src DIV {each} = tgt DIV {each}")
    more = spark.range(each, each + joined).select(F.col("id").alias("src"), F.lit(0).cast("long").alias("tgt"))
    return out.unionByName(more) if joined else out


def network(spark: SparkSession, kind: str, hw: HardwareConfig, seed: int = 42, **options) -> Network:
    """A network by the name of its source, with what describes it: ``erdos_renyi`` (n, p), ``feasible`` (p), ``soft_wta``, ``wta`` (n, p)."""
    truth = None
    if kind == "feasible":
        edges, *truth = feasible(spark, hw, options["p"], seed)
        n, name = hw.slots, f"Feasible_R={hw.r}_l={hw.l}_N={hw.n}_p={options['p']}_seed={seed}"
    elif kind == "erdos_renyi":
        n, edges, name = options["n"], erdos_renyi(spark, options["n"], options["p"], seed), f"ER_{options['n']}n_p{options['p']}"
    elif kind == "soft_wta":
        n = (options["excitatory"] + options["inhibitory"]) * options["size"]
        edges, name = soft_wta(spark, seed=seed, **options), f"sWTA_{options['excitatory']}+{options['inhibitory']}x{options['size']}"
    elif kind == "wta":
        n, edges, name = options["n"], wta(spark, options["n"], options["p"], seed), f"WTA_{options['n']}n_p{options['p']}"
    else:
        raise ValueError(f"no source {kind}")
    return Network(name, n, edges, hw, {"graph_type": kind, "nodes": str(n)} | {k: str(v) for k, v in options.items()}, tuple(truth) if truth else None)
