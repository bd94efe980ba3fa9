"""Experiments: networks through mappers, scored, against baselines.

One frame holds all networks of one hardware; a mapper runs once over it, a task a network, so networks run side by side, and
scores are one plan over all of them.  What a mapper takes is timed in the task that runs it.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera import graph
from tessera.hw import HardwareConfig
from tessera.operators import checks, kernels, metrics, partition, reports, searches
from tessera.operators.addresses import principal_addresses
from tessera.sources.networks import Network
from tessera.tables import Steps

TIME, ARI, ACCURACY = "Time (s)", "ARI (Clustering)", "Accuracy (Clustering)"


@dataclass(frozen=True)
class Metric:
    """A measure of a scored mapping: a Column over m, kept, n and the hardware's numbers; and how it stands to a baseline's."""

    name: str
    value: Callable[[HardwareConfig], Column]
    relative: str = "difference"
    at_zero: float | None = None

    def against(self, own: Column, base: Column) -> Column:
        if self.relative == "same":
            return own
        if self.relative == "difference":
            return own - base
        return F.when(base > 0, own / base).otherwise(F.lit(float("inf") if self.at_zero is None else self.at_zero))


def _likelihood(hw: HardwareConfig) -> Column:
    p = (F.col("kept") + 1) / (F.col("n") * hw.n + 2)
    return -(F.col("kept") * F.log(p) + (F.col("m") - F.col("kept")) * F.log(F.lit(searches.MISS_PROBABILITY)))


def _of_missed(scale: float):
    return lambda hw: F.when(F.col("m") > 0, scale * (F.col("m") - F.col("kept")) / F.col("m")).otherwise(0.0)


#: The measures by name (fixed values: the names that results are compared at).  The log-likelihood is negated, less is better.
METRICS = {
    m.name: m
    for m in (
        Metric("Valid Edges", lambda hw: F.col("kept").cast("double")),
        Metric("Inconsistencies", lambda hw: (F.col("m") - F.col("kept")).cast("double")),
        Metric("Inconsistencies (Fraction)", _of_missed(1.0), "ratio", 1.0),
        Metric("Inconsistencies (%)", _of_missed(100.0), "ratio", 100.0),
        Metric("Log-Likelihood", _likelihood),
        Metric("Hardware Size", lambda hw: F.lit(float(hw.slots)), "ratio"),
        Metric("Unused Connections", lambda hw: (F.lit(hw.total_connections()) - F.col("kept")).cast("double"), "ratio"),
        Metric(ARI, lambda hw: F.col("ari"), "same"),
        Metric(ACCURACY, lambda hw: F.col("accuracy"), "same"),
    )
}


def scored(edges: DataFrame, sizes: DataFrame, placement: DataFrame, chosen: DataFrame | None, hw: HardwareConfig) -> DataFrame:
    """graph_id, n, m, kept of every network: links heard at the slices chosen, or at the best ones where none are given.  Networks
    without links have a row too."""
    s = placement.select("graph_id", F.col("neuron").alias("src"), F.col("core").alias("src_core"), F.col("local").alias("src_local"))
    t = placement.select("graph_id", F.col("neuron").alias("tgt"), F.col("core").alias("tgt_core"))
    at = edges.join(s, ["graph_id", "src"]).join(t, ["graph_id", "tgt"]).withColumn("distance", hw.distance("src_core", "tgt_core"))
    hits = at.groupBy("graph_id", "tgt", "distance", hw.slice_of("distance", "src_local").alias("slice")).agg(F.count("*").alias("hits"))
    if chosen is None:
        per = hits.groupBy("graph_id", "tgt", "distance").agg(F.when(F.col("distance") == 0, F.sum("hits")).otherwise(F.max("hits")).alias("kept"), F.sum("hits").alias("k"))
    else:
        own = chosen.select("graph_id", F.col("neuron").alias("tgt"), "distance", F.col("slice").alias("own"))
        per = hits.join(own, ["graph_id", "tgt", "distance"], "left").select("graph_id", F.when((F.col("distance") == 0) | (F.col("slice") == F.col("own")), F.col("hits")).otherwise(0).alias("kept"), F.col("hits").alias("k"))
    total = per.groupBy("graph_id").agg(F.sum("k").alias("m"), F.sum("kept").alias("kept"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return sizes.join(total, "graph_id", "left").select("graph_id", F.col("n").cast("long").alias("n"), zero(F.col("m")).alias("m"), zero(F.col("kept")).alias("kept"))


def clustered(placement: DataFrame, networks: list[Network], names: tuple[str, ...]) -> DataFrame | None:
    """graph_id, ari, accuracy, those of them that are named: cores as clusters against the cores of the ground truth, of the networks
    that have one; None where that is nothing."""
    true = [net.truth[0].select(F.lit(net.id).alias("graph_id"), "neuron", F.col("core").alias("truth")) for net in networks if net.truth is not None]
    if not true or not {ARI, ACCURACY} & set(names):
        return None
    both = reduce(DataFrame.unionByName, true).join(placement.select("graph_id", "neuron", F.col("core").alias("predicted")), ["graph_id", "neuron"])
    parts = [metrics.adjusted_rand_by(both, "graph_id")] if ARI in names else []
    parts += [kernels.accuracy(both, "graph_id")] if ACCURACY in names else []
    return reduce(lambda a, b: a.join(b, "graph_id"), parts)


def _with_clusters(out: DataFrame, found: DataFrame | None) -> DataFrame:
    """Scores with ari and accuracy, not a number where there is no ground truth or nobody asks."""
    out = out if found is None else out.join(found, "graph_id", "left")
    nan = F.lit(float("nan"))
    return out.select("graph_id", "n", "m", "kept", *((F.coalesce(F.col(c), nan) if c in out.columns else nan).alias(c) for c in ("ari", "accuracy")))


def together(networks: list[Network]) -> tuple[DataFrame, DataFrame]:
    """(edges, sizes) of all networks, by graph_id."""
    spark = networks[0].edges.sparkSession
    edges = reduce(DataFrame.unionByName, (n.edges.select(F.lit(n.id).alias("graph_id"), "src", "tgt") for n in networks))
    return edges, spark.createDataFrame([(n.id, n.n) for n in networks], "graph_id string, n long")


def drawn(networks: list[Network], hw: HardwareConfig, seed: int) -> tuple[DataFrame, DataFrame]:
    """(placement, slices) by chance, for each network."""
    spark = networks[0].edges.sparkSession
    placed, chosen = [], []
    for net in networks:
        neurons, own = spark.range(net.n), F.lit(net.id).alias("graph_id")
        placed.append(graph.random_placement(neurons, hw, seed).select(own, "*"))
        chosen.append(graph.random_slices(neurons, hw, seed).select(own, "*"))
    return reduce(DataFrame.unionByName, placed), reduce(DataFrame.unionByName, chosen)


def known(networks: list[Network], hw: HardwareConfig, seed: int) -> tuple[DataFrame, DataFrame]:
    """(placement, slices) that the source made the network from; by chance where it tells none."""
    parts = []
    for net in networks:
        own = F.lit(net.id).alias("graph_id")
        parts.append(drawn([net], hw, seed) if net.truth is None else (net.truth[0].select(own, "*"), net.truth[1].select(own, "*")))
    return tuple(reduce(DataFrame.unionByName, (p[k] for p in parts)) for k in (0, 1))


def mapped_by(mapper: str, networks: list[Network], hw: HardwareConfig, seed: int = 42) -> tuple[DataFrame, DataFrame | None, DataFrame | None]:
    """(placement, slices or None for the best, seconds and error by graph_id or None) of a mapper by name: ``random``, ``truth``, and the
    methods of ``kernels`` and ``searches`` that take hardware as given.  A mapper runs once for each network: what it gives is
    written, and its seconds are of that run."""
    if mapper in ("random", "truth"):
        return *(drawn if mapper == "random" else known)(networks, hw, seed), None
    if mapper in FRAMES:
        own = [FRAMES[mapper](net.edges.sparkSession.range(net.n), net.edges, hw, seed).select(F.lit(net.id).alias("graph_id"), "neuron", "core", "local") for net in networks]
        return Steps(networks[0].edges.sparkSession).keep(reduce(DataFrame.unionByName, own), f"placements-{mapper}"), None, None
    edges, sizes = together(networks)

    def run(pdf):
        began, own = time.perf_counter(), pdf["graph_id"].iloc[0]
        try:
            n, src, tgt = kernels.unpacked(pdf)
            if n > hw.slots:
                raise ValueError("Hardware overflow")
            core, local = METHODS[mapper](n, src, tgt, hw, seed)
        except Exception as e:  # one network's failure is a row of its own
            return pd.DataFrame({"graph_id": [own], "neuron": [None], "core": [None], "local": [None], "seconds": [None], "error": [str(e) or type(e).__name__]})
        return pd.DataFrame({"graph_id": own, "neuron": range(n), "core": core, "local": local, "seconds": time.perf_counter() - began, "error": None})

    if mapper not in METHODS:
        raise ValueError(f"no mapper {mapper}")
    found = kernels.as_rows(edges, sizes).groupBy("graph_id").applyInPandas(run, "graph_id string, neuron long, core long, local long, seconds double, error string")
    found = Steps(edges.sparkSession).keep(found, f"placements-{mapper}")
    told = found.groupBy("graph_id").agg(F.max("seconds").alias("seconds"), F.max("error").alias("error"))
    return found.where("neuron is not null").drop("seconds", "error"), None, told


def _greedy(n, src, tgt, hw, seed):
    core = kernels.greedy_cores(n, src, tgt, hw)
    return core, kernels.addresses(core)


def _three_step(parts):
    def run(n, src, tgt, hw, seed):
        core = parts(n, src, tgt, hw)
        return core, kernels.pca_addresses(n, src, tgt, core)

    return run


def _assigned(n, src, tgt, hw, seed):
    slots = searches.assigned_slots(n, src, tgt, hw)
    return slots // hw.n, slots % hw.n


#: Mappers that run in a task, by name: (n, src, tgt, hardware, seed) to cores and addresses.  Own ones may be added.
METHODS: dict[str, Callable] = {
    "greedy": _greedy,
    "anneal": lambda n, src, tgt, hw, seed: kernels.annealed(n, src, tgt, hw, seed)[:2],
    "three_step": _three_step(lambda n, src, tgt, hw: kernels.balanced_parts(n, src, tgt, hw.cores, hw.n)),
    "three_step_recursive": _three_step(kernels.recursive_cores),
    "three_step_hyperedges": _three_step(lambda n, src, tgt, hw: kernels.recursive_cores(n, src, tgt, hw, "hyperedges")),
    "three_step_assigned": _three_step(lambda n, src, tgt, hw: searches.assigned_slots(n, src, tgt, hw) // hw.n),
    "assigned": _assigned,
    "blocks": lambda n, src, tgt, hw, seed: searches.clusters_on(n, src, tgt, hw, "blocks", seed),
    "spectral": lambda n, src, tgt, hw, seed: searches.clusters_on(n, src, tgt, hw, "spectral", seed),
}


def _parts(neurons: DataFrame, edges: DataFrame, hw: HardwareConfig, seed: int) -> DataFrame:
    labels = partition.balanced_parts(neurons, edges, partition.PartSettings(hw.cores, branches=hw.r))
    return graph.ranked_within(labels, ["part"], F.shiftright("neuron", 16), ["neuron"], "local").select("neuron", F.col("part").alias("core"), "local")


def _parts_in_three_steps(neurons: DataFrame, edges: DataFrame, hw: HardwareConfig, seed: int) -> DataFrame:
    parts = partition.balanced_parts(neurons, edges, partition.PartSettings(hw.cores, branches=hw.r))
    return principal_addresses(parts.withColumnRenamed("part", "core"), edges, seed=seed)


#: Mappers whose work is frames, for networks of any size, one after the other: (neurons, edges, hardware, seed) to a placement.  They
#: have no seconds; a failure is raised.
FRAMES: dict[str, Callable] = {"parts": _parts, "parts_three_step": _parts_in_three_steps}


@dataclass(frozen=True)
class Bundle:
    """What a run of a mapper is held against: metrics by name, and the mapper of the baseline (none: relative values are MISSING)."""

    metrics: tuple[str, ...] = ("Inconsistencies", "Inconsistencies (Fraction)", "Hardware Size", "Unused Connections")
    baseline: str | None = "random"


def grid(inputs: list[str], mappers: list[str], bundles: list[str], spark: SparkSession) -> DataFrame:
    """input_id, mapper, bundle: every run of an experiment."""
    rows = spark.createDataFrame([(i,) for i in inputs], "input_id string")
    each = F.explode(F.array(*(F.struct(F.lit(m).alias("mapper"), F.lit(b).alias("bundle")) for m in mappers for b in bundles)))
    return rows.select("input_id", each.alias("x")).select("input_id", "x.mapper", "x.bundle")


def evaluated(networks: list[Network], mapper: str, bundle: Bundle, seed: int = 42, hook: Callable[[DataFrame], None] | None = None) -> DataFrame:
    """mapper, input_id, metric, raw, relative, error of one mapper on networks of any hardware; a network on which the mapper fails has
    one row, with the error and without a metric, and the others have theirs.

    A hook gets the violations of every mapping first, as a frame; what it does with them is its own affair.
    """
    by: dict[HardwareConfig, list[Network]] = {}
    for net in networks:
        by.setdefault(net.hw, []).append(net)
    parts = []
    for hw, own in by.items():
        edges, sizes = together(own)
        placement, chosen, told = mapped_by(mapper, own, hw, seed)
        if hook is not None:
            for net in own:
                of = placement.where(F.col("graph_id") == net.id)
                best = chosen.where(F.col("graph_id") == net.id) if chosen is not None else None
                neurons = placement.sparkSession.range(net.n)
                hook(checks.whole(neurons, of, best if best is not None else graph.random_slices(neurons, hw).select("neuron", "distance", "slice"), hw))
        fine = sizes if told is None else sizes.join(told.where("error is null"), "graph_id", "left_semi")
        out = _with_clusters(scored(edges, fine, placement, chosen, hw), clustered(placement, own, bundle.metrics))
        if bundle.baseline is not None:
            b_placement, b_chosen, _ = (placement, chosen, told) if bundle.baseline == mapper else mapped_by(bundle.baseline, own, hw, seed)
            base = _with_clusters(scored(edges, sizes, b_placement, b_chosen, hw), None)  # a measure of clusters stands for itself
        measures = [METRICS[m] for m in bundle.metrics]
        values = lambda df, name: df.select("graph_id", *(m.value(hw).alias(f"{name}{k}") for k, m in enumerate(measures)))
        both = values(out, "own")
        both = both.join(values(base, "base"), "graph_id") if bundle.baseline is not None else both
        rows = [F.struct(F.lit(m.name).alias("metric"), F.col(f"own{k}").alias("raw"), (m.against(F.col(f"own{k}"), F.col(f"base{k}")) if bundle.baseline is not None else F.lit(reports.MISSING)).cast("double").alias("relative")) for k, m in enumerate(measures)]
        none = F.lit(None).cast("string").alias("error")
        parts.append(both.select("graph_id", F.explode(F.array(*rows)).alias("x")).select(F.lit(mapper).alias("mapper"), F.col("graph_id").alias("input_id"), "x.metric", "x.raw", "x.relative", none))
        if told is not None:
            time_ = F.when(F.col("error").isNull(), F.lit(TIME)).alias("metric")
            parts.append(told.select(F.lit(mapper).alias("mapper"), F.col("graph_id").alias("input_id"), time_, F.col("seconds").alias("raw"), F.lit(None).cast("double").alias("relative"), "error"))
    return reduce(DataFrame.unionByName, parts)


def run(networks: list[Network], mappers: list[str], bundle: Bundle = Bundle(), seed: int = 42) -> DataFrame:
    """The long frame of an experiment: every mapper on every network.  Failures are rows with an error."""
    return reduce(DataFrame.unionByName, (evaluated(networks, m, bundle, seed) for m in mappers))


def summary(long: DataFrame, networks: list[Network]) -> DataFrame:
    """mapper, input_id, metadata, metrics, raw_metrics, error: a row a run, as ``results.write_summary`` takes it."""
    spark = long.sparkSession
    about = spark.createDataFrame([(n.id, n.descriptions) for n in networks], "input_id string, metadata map<string,string>")
    entry = lambda c: F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col(c).isNotNull() & F.col("metric").isNotNull(), F.struct("metric", c)))))
    rows = long.groupBy("mapper", "input_id").agg(entry("relative").alias("metrics"), entry("raw").alias("raw_metrics"), F.max("error").alias("error"))
    return rows.join(about, "input_id").select("mapper", "input_id", "metadata", "metrics", "raw_metrics", "error")


def bundle_of_tasks(tasks: list[tuple[list[Network], list[str], Bundle]], consumers: list[Callable[[DataFrame], None]] = (), seed: int = 42) -> tuple[DataFrame, float]:
    """(long frame of all tasks, seconds); the frame is made once, given to each consumer, and returned."""
    began = time.time()
    long = reduce(DataFrame.unionByName, (run(*t, seed=seed) for t in tasks)).persist()
    long.count()
    took = time.time() - began
    for consume in consumers:
        consume(long)
    return long, took
