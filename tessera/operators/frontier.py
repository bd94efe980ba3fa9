"""A greedy placement of a whole network in rounds: what is placed draws in what it is linked to.

The neurons of most links start a core each.  In each round every neuron not placed, of those with links to placed ones, proposes itself
to the core that holds most of them and has places left (ties: a hash); a core takes the proposals of most links (ties: a hash), as many
as its places and the round's quota allow, which doubles, so a core of n places is filled in about log2(n) rounds.  Links lie in cells
(``link_cells``): a round sends each neuron's core to them, their sums come back, and no link is moved; no task orders more than a core's proposals of one strength and one part of the hashes.  Neurons that no round placed
take the places left, in order of the core that they are linked to most.  Every round is a stored table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera import graph
from tessera.hw import HardwareConfig
from tessera.operators.link_cells import LinkCells
from tessera.tables import Steps

#: Rounds after the quota has reached a core's size, in which neurons whose core was full go to their next best.
MORE = 4


def _votes(links: LinkCells, state: DataFrame, cores: int, seed: int) -> DataFrame:
    """neuron, core, v, h: links of each neuron not placed (core -1) into each core, and the pair's hash."""
    votes = links.votes(state.select(F.col("neuron").alias("id"), F.col("core").alias("part")), cores).toDF("neuron", "core", "v")
    return votes.withColumn("h", graph.uniform(F.concat_ws(":", "neuron", "core"), seed))


def _best(votes: DataFrame) -> DataFrame:
    """One core for each neuron: the most links, then the larger hash, then the larger number."""
    best = votes.groupBy("neuron").agg(F.max(F.struct("v", "h", "core")).alias("m"))
    return best.select("neuron", "m.core", "m.v", "m.h")


def _free(cores: DataFrame, placed: DataFrame, n: int) -> DataFrame:
    """core, places: of the cores that have some."""
    used = placed.groupBy("core").agg(F.count("*").alias("used"))
    return cores.join(used, "core", "left").select("core", (F.lit(n) - F.coalesce("used", F.lit(0))).alias("places")).where("places > 0")


def greedy_cores(neurons: DataFrame, edges: DataFrame, hw: HardwareConfig, seed: int = 42) -> DataFrame:
    """neuron, core of every neuron; ids that repeat are one neuron, links to unknown ones and loops do not count.  The same on reruns."""
    spark = neurons.sparkSession
    kept = Steps(spark)
    nodes = kept.keep(neurons.select(F.col("id").cast("long").alias("neuron")).distinct(), "neurons")
    if nodes.count() > hw.slots:
        raise ValueError("Hardware overflow")
    links = LinkCells.of_edges(nodes.withColumnRenamed("neuron", "id"), edges, kept)
    degree = kept.keep(nodes.join(links.degrees(nodes.withColumnRenamed("neuron", "id")).toDF("neuron", "v"), "neuron", "left").na.fill(0, ["v"]), "degrees")
    first = graph.ranked(degree, F.struct((-F.col("v")).alias("v"), F.shiftright("neuron", 16).alias("part")), ["neuron"], "r")
    state = kept.keep(first.select("neuron", F.when(F.col("r") < hw.cores, F.col("r")).otherwise(-1).alias("core")), "placed")
    cores = spark.range(hw.cores).withColumnRenamed("id", "core")
    rounds = max(0, hw.n - 1).bit_length() + MORE
    for k in range(rounds):
        free = _free(cores, state.where("core >= 0"), hw.n)
        asked = kept.keep(_best(_votes(links, state, hw.cores, seed).join(free, "core")), "asked")
        part = F.struct((-F.col("v")).alias("v"), F.shiftright("h", 20).alias("part"))
        order = graph.ranked_within(asked, ["core"], part, ["h", "neuron"], "r").join(free, "core")
        taken = kept.keep(order.where(F.col("r") < F.least(F.col("places"), F.lit(2**k))).select("neuron", "core"), "taken")
        if taken.isEmpty():
            break
        after = state.join(taken.withColumnRenamed("core", "new"), "neuron", "left")
        state = kept.keep(after.select("neuron", F.coalesce("new", "core").alias("core")), "placed")
        kept.drop(links.table, state)
    placed, rest = state.where("core >= 0"), state.where("core < 0").select("neuron")
    liked = rest.join(_best(_votes(links, state, hw.cores, seed)).select("neuron", "core"), "neuron", "left").na.fill(-1, ["core"])
    left = graph.ranked(liked, F.struct("core", F.shiftright("neuron", 16).alias("part")), ["neuron"], "r").select("neuron", "r")
    places = _free(cores, placed, hw.n).select("core", F.explode(F.sequence(F.lit(1), F.col("places").cast("int"))).alias("k"))
    return placed.union(left.join(graph.ranked(places, F.col("core"), ["k"], "r"), "r").select("neuron", "core"))


def greedy_placement(neurons: DataFrame, edges: DataFrame, hw: HardwareConfig, seed: int = 42) -> DataFrame:
    """neuron, core, local: addresses go by id."""
    cores = greedy_cores(neurons, edges, hw, seed)
    return graph.ranked_within(cores, ["core"], F.shiftright("neuron", 16), ["neuron"], "local").select("neuron", "core", "local")
