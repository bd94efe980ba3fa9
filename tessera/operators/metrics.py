"""Measures of placements, clusterings and networks.

Frames: neurons(id), edges(src, tgt), placed as ``slices.placed_edges`` gives it, labels(neuron, cluster).  What depends on sizes
alone is a Column or a number.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.hw import HardwareConfig

#: Distance between cores with at most one link (fixed value); others are 1 apart, a core and itself 0.
FAR = 21


# --- clusterings -----------------------------------------------------------------------------------------------


def contingency(labels: DataFrame, truth: str = "truth", predicted: str = "predicted") -> DataFrame:
    return labels.groupBy(F.col(truth).alias("truth"), F.col(predicted).alias("predicted")).agg(F.count("*").alias("k"))


def adjusted_rand(labels: DataFrame, truth: str = "truth", predicted: str = "predicted") -> DataFrame:
    """One row, ari: from the contingency table, whose margins are sums of its cells; null where both clusterings are trivial."""
    cells = contingency(labels, truth, predicted)
    pairs = lambda k: F.sum(F.col(k).cast("double") * (F.col(k) - 1) / 2)
    both = cells.agg(pairs("k").alias("x"), F.sum("k").alias("n"))
    rows = cells.groupBy("truth").agg(F.sum("k").alias("k")).agg(pairs("k").alias("a"))
    columns = cells.groupBy("predicted").agg(F.sum("k").alias("k")).agg(pairs("k").alias("b"))
    chance = F.col("a") * F.col("b") / (F.col("n").cast("double") * (F.col("n") - 1) / 2)
    return both.crossJoin(rows).crossJoin(columns).select(F.round(F.try_divide(F.col("x") - chance, (F.col("a") + F.col("b")) / 2 - chance), 9).alias("ari"))


def adjusted_rand_by(labels: DataFrame, group: str, truth: str = "truth", predicted: str = "predicted") -> DataFrame:
    """group, ari for every group of rows at once; 1 where both clusterings are trivial in one way."""
    cells = labels.groupBy(group, F.col(truth).alias("truth"), F.col(predicted).alias("predicted")).agg(F.count("*").alias("k"))
    pairs = lambda k: F.sum(F.col(k).cast("double") * (F.col(k) - 1) / 2)
    margin = lambda c, name: cells.groupBy(group, c).agg(F.sum("k").alias("k")).groupBy(group).agg(pairs("k").alias(name))
    both = cells.groupBy(group).agg(pairs("k").alias("x"), F.sum("k").alias("n")).join(margin("truth", "a"), group).join(margin("predicted", "b"), group)
    chance = F.try_divide(F.col("a") * F.col("b"), F.col("n").cast("double") * (F.col("n") - 1) / 2)
    return both.select(group, F.coalesce(F.try_divide(F.col("x") - chance, (F.col("a") + F.col("b")) / 2 - chance), F.lit(1.0)).alias("ari"))


def block_links(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """a, b, links, possible for every pair of clusters: the grid is clusters squared, as the result is."""
    size = labels.groupBy("cluster").agg(F.count("*").alias("k"))
    links = edges.join(labels.toDF("src", "a"), "src").join(labels.toDF("tgt", "b"), "tgt").groupBy("a", "b").agg(F.count("*").alias("links"))
    grid = size.toDF("a", "ka").crossJoin(size.toDF("b", "kb"))
    possible = F.col("ka") * F.col("kb") - F.when(F.col("a") == F.col("b"), F.col("ka")).otherwise(0)
    return grid.join(links, ["a", "b"], "left").select("a", "b", F.coalesce("links", F.lit(0)).cast("long").alias("links"), possible.cast("long").alias("possible"))


def induced(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """Edges with both ends in one cluster."""
    return edges.join(labels.toDF("src", "a"), "src").join(labels.toDF("tgt", "b"), "tgt").where("a = b").select("src", "tgt")


# --- networks --------------------------------------------------------------------------------------------------


def undirected(edges: DataFrame) -> DataFrame:
    """Both directions of every link once, without loops; pairs are made distinct before they are turned round."""
    low, high = F.least("src", "tgt").alias("x"), F.greatest("src", "tgt").alias("y")
    one = edges.where("src <> tgt").select(low, high).distinct()
    both = F.array(*(F.struct(F.col(s).alias("src"), F.col(t).alias("tgt")) for s, t in ("xy", "yx")))
    return one.select(F.explode(both).alias("e")).select("e.src", "e.tgt")


def degrees(neurons: DataFrame, edges: DataFrame) -> DataFrame:
    ends = edges.select(F.explode(F.array(F.struct(F.col("src").alias("id"), F.lit(0).alias("into")), F.struct(F.col("tgt").alias("id"), F.lit(1).alias("into")))).alias("e")).select("e.*")
    counted = ends.groupBy("id").agg(F.sum("into").alias("in_degree"), F.count("*").alias("degree"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return neurons.join(counted, "id", "left").select("id", zero(F.col("in_degree")).alias("in_degree"), zero(F.col("degree") - F.col("in_degree")).alias("out_degree"), zero(F.col("degree")).alias("degree"))


def triangles(edges: DataFrame) -> DataFrame:
    """One row, t: triangles of the undirected skeleton.  Links go from the end with fewer links to the other (then by id), so a hub
    has few links going out and its list of them stays within sqrt(2m).  Each list goes to each of its members once, without what
    stands before the member, and is met there with the member's own list."""
    both = undirected(edges)
    degree = both.groupBy("src").agg(F.count("*").alias("k"))
    one = both.where("src < tgt").join(degree.toDF("src", "ks"), "src").join(degree.toDF("tgt", "kt"), "tgt")
    up = F.col("ks") <= F.col("kt")
    e = one.select(F.when(up, F.col("src")).otherwise(F.col("tgt")).alias("a"), F.struct(F.greatest("ks", "kt").alias("k"), F.when(up, F.col("tgt")).otherwise(F.col("src")).alias("id")).alias("b"))
    lists = e.groupBy("a").agg(F.transform(F.sort_array(F.collect_list("b")), lambda b: b["id"]).alias("own"))
    sent = lists.where(F.size("own") > 1).select("own", F.posexplode("own").alias("at", "a"))
    sent = sent.select("a", F.slice("own", F.col("at") + 2, F.size("own")).alias("others")).where(F.size("others") > 0)
    return sent.join(lists, "a").agg(F.coalesce(F.sum(F.size(F.array_intersect("others", "own"))), F.lit(0)).cast("long").alias("t"))


def moments(neurons: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: mean and sample variance of the total degree, mean triangles of a neuron."""
    d = degrees(neurons, edges).agg(F.avg("degree").alias("m"), F.var_samp("degree").alias("v"), F.count("*").alias("n"))
    return d.crossJoin(triangles(edges)).select(F.round("m", 9).alias("mean_degree"), F.round("v", 6).alias("var_degree"), F.round(3.0 * F.col("t") / F.col("n"), 9).alias("mean_triangles"))


def density(neurons: DataFrame, edges: DataFrame) -> DataFrame:
    n, m = neurons.agg(F.count("*").alias("n")), edges.agg(F.count("*").alias("m"))
    return n.crossJoin(m).select(F.round(F.try_divide(F.col("m").cast("double"), F.col("n") * (F.col("n") - 1)), 12).alias("density"))


def laplacian(neurons: DataFrame, edges: DataFrame) -> DataFrame:
    """i, j, laplacian, walk: the entries of D - A and of I - (D - A) / d_max that are not 0, and the diagonals."""
    u = undirected(edges)
    k = u.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("deg"))
    most = k.agg(F.max("deg").alias("most"))
    off = u.select(F.col("src").alias("i"), F.col("tgt").alias("j"), F.lit(-1).cast("long").alias("laplacian"))
    own = neurons.join(k, "id", "left").select(F.col("id").alias("i"), F.col("id").alias("j"), F.coalesce("deg", F.lit(0)).cast("long").alias("laplacian"))
    walk = F.when(F.col("i") == F.col("j"), F.lit(1.0)).otherwise(F.lit(0.0)) - F.col("laplacian") / F.col("most").cast("double")
    return off.unionByName(own).crossJoin(most).select("i", "j", "laplacian", F.round(walk, 12).alias("walk"))


def bethe_hessian(neurons: DataFrame, edges: DataFrame, sign: int = 1) -> DataFrame:
    """i, j, x: entries of (r^2 - 1) I - r A + D, where r is the root of the mean degree, or minus that."""
    u = undirected(edges)
    k = u.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("deg"))
    every = neurons.join(k, "id", "left").select("id", F.coalesce("deg", F.lit(0)).alias("deg"))
    r = every.agg((F.sqrt(F.sum("deg").cast("double") / F.count("*")) * sign).alias("r"))
    off = u.crossJoin(r).select(F.col("src").alias("i"), F.col("tgt").alias("j"), F.round(-F.col("r"), 8).alias("x"))
    return off.unionByName(every.crossJoin(r).select(F.col("id").alias("i"), F.col("id").alias("j"), F.round(F.col("r") * F.col("r") - 1 + F.col("deg"), 8).alias("x")))


# --- placements ------------------------------------------------------------------------------------------------


def occupancy(placement: DataFrame) -> DataFrame:
    return placement.groupBy(F.col("core").cast("long").alias("core")).agg(F.count("*").alias("neurons"))


def core_links(placed: DataFrame) -> DataFrame:
    """Links between two different cores, by direction."""
    return placed.where("tgt_core <> src_core").groupBy(F.col("tgt_core").cast("long").alias("tgt_core"), F.col("src_core").cast("long").alias("src_core")).agg(F.count("*").alias("links"))


def link_distance(placed: DataFrame, cores: int) -> DataFrame:
    """a, b, distance over all pairs of cores: FAR with at most one link, else 1, the nearer of both directions; 0 on the diagonal."""
    links = core_links(placed)
    either = links.select(F.col("tgt_core").alias("a"), F.col("src_core").alias("b"), "links").unionByName(links.select(F.col("src_core").alias("a"), F.col("tgt_core").alias("b"), "links"))
    near = either.groupBy("a", "b").agg(F.max("links").alias("most"))
    grid = placed.sparkSession.range(cores).select(F.col("id").alias("a"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(cores - 1).cast("long"))).alias("b"))
    distance = F.when(F.col("a") == F.col("b"), 0).when(F.coalesce("most", F.lit(0)) <= 1, FAR).otherwise(1)
    return grid.join(near, ["a", "b"], "left").select("a", "b", distance.cast("long").alias("distance"))


def free_slots(placement: DataFrame, hw: HardwareConfig) -> DataFrame:
    grid = placement.sparkSession.range(hw.slots).select(F.expr(f"id DIV {hw.n}").alias("core"), F.expr(f"id % {hw.n}").alias("local"))
    return grid.join(placement.select("core", "local"), ["core", "local"], "left_anti")


def adjacency_order(placement: DataFrame) -> DataFrame:
    """neuron, place: the order by core and address, without ordering all neurons in one task."""
    from tessera.graph import ranked

    return ranked(placement, F.col("core"), ["local", "neuron"], "place").select("neuron", "place")


def range_candidates(placement: DataFrame, wanted: DataFrame) -> DataFrame:
    """neuron, source: the neurons at addresses low to high - 1 of a core, for wanted(neuron, core, low, high); an equality once the
    addresses are spelled out."""
    each = wanted.where("low < high").select("neuron", "core", F.explode(F.sequence(F.col("low"), F.col("high") - 1)).alias("local"))
    return each.join(placement.select(F.col("neuron").alias("source"), "core", "local"), ["core", "local"]).select("neuron", "source")


def range_counts(placement: DataFrame, wanted: DataFrame) -> DataFrame:
    """neuron, candidates: how many ``range_candidates`` would give, from running counts within each core and nothing spelled out."""
    upto = F.sum("k").over(Window.partitionBy("core").orderBy("local"))
    counts = placement.groupBy("core", "local").agg(F.count("*").alias("k")).select("core", "local", upto.alias("upto"))
    ends = wanted.select("neuron", "core", F.explode(F.array(F.struct(F.lit(1).alias("sign"), (F.col("high") - 1).alias("last")), F.struct(F.lit(-1).alias("sign"), (F.col("low") - 1).alias("last")))).alias("e")).select("neuron", "core", "e.sign", "e.last")
    asked = ends.select("core", "last").distinct()
    marks = counts.select("core", F.col("local").alias("last"), "upto").unionByName(asked.select("core", "last", F.lit(None).cast("long").alias("upto")))
    known = F.last("upto", ignorenulls=True).over(Window.partitionBy("core").orderBy("last").rangeBetween(Window.unboundedPreceding, Window.currentRow))
    found = marks.withColumn("known", known).where("upto is null").select("core", "last", F.coalesce("known", F.lit(0)).alias("known"))
    return ends.join(found, ["core", "last"]).groupBy("neuron").agg(F.sum(F.col("sign") * F.col("known")).alias("candidates"))


# --- costs -----------------------------------------------------------------------------------------------------


def hardware_cost(hw: HardwareConfig, n: Column, core: float = 1.5, router: float = 2.0, waste: float = 0.5) -> Column:
    """Areas of cores and routers and unused slots; routers cost nothing where there is one core."""
    routers = router * hw.n * (hw.r - 1) / (hw.cores - 1) if hw.cores > 1 else 0.0
    return F.lit(core * hw.cores * hw.n**2 + routers) + waste * F.greatest(F.lit(0), F.lit(hw.slots) - n)


def joint_cost(hw: HardwareConfig, n: Column, core: float = 1.0, router: float = 2.0, waste: float = 0.5) -> Column:
    return F.lit(core * hw.slots + router * hw.cores * hw.l * hw.r) + waste * F.greatest(F.lit(0), F.lit(hw.slots) - n)


def description_length(hw: HardwareConfig, n: Column) -> Column:
    """Nats of n neurons' cores, addresses and slices."""
    return n * F.lit(math.log(hw.cores) + math.log(hw.n) + sum(math.log(hw.slices_at(d)) for d in range(1, hw.l + 1)))


def search_energy(hw: HardwareConfig, missed: Column, miss: float = 1.0, core: float = 0.01, router: float = 0.1) -> Column:
    """What a search over hardware lowers: missed links and areas."""
    routers = router * hw.n * (hw.r - 1) / (hw.cores - 1) if hw.cores > 1 else 0.0
    return miss * missed + F.lit(core * hw.cores * hw.n**2 + routers)
