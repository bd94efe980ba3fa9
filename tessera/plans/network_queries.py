"""The registered queries of single operators: each calls the library's functions on whole tables or on a grid.

The SQL they are held against (``catalog``) is written apart from them, over the same tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera import graph
from tessera.functions import scalars
from tessera.hw import HardwareConfig
from tessera.operators import checks, estimators, hierarchy, metrics, reports, slices, views
from tessera.plans import runner
from tessera.plans.catalog import GRID, PARENTS
from tessera.sources import networks

SMALL = HardwareConfig(2, 15, 2, 2)


def hardware(neurons: DataFrame) -> HardwareConfig:
    """Four children, three levels, slices double; the core size follows from the number of neurons."""
    return HardwareConfig(4, max(2, -(-neurons.count() // 64)), 3, 2)


def tables(spark: SparkSession, sf_dir: str):
    neurons, edges = graph.from_tables(spark, sf_dir)
    return neurons, edges, hardware(neurons)


def spread(spark: SparkSession, sf_dir: str):
    neurons, edges, hw = tables(spark, sf_dir)
    placement = graph.spread(neurons, hw)
    return neurons, edges, hw, placement, slices.placed_edges(edges, placement, hw)


def brands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """neuron, truth, predicted, cluster: brands as clusters 0, 1, ... in their order."""
    parts = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").cast("long").alias("neuron"), F.col("p_brand").alias("truth"), F.col("p_size").alias("predicted"))
    return graph.dense_labels(parts, "truth")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return brands(spark, sf_dir).select("neuron", "cluster")


def tree(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(PARENTS, "cluster long, parent long")


def results_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return o.select(
        F.concat(F.lit("mapper"), (F.col("o_orderkey") % 3).cast("string")).alias("mapper"),
        F.concat(F.lit("net"), (F.col("o_custkey") % 5).cast("string")).alias("input_id"),
        F.when(F.col("o_orderkey") % 2 == 0, "Inconsistencies").otherwise("Hardware Size").alias("metric"),
        (F.col("o_orderkey") % 1000).cast("double").alias("value"),
        (F.col("o_orderkey") % 17 == 0).alias("failed"),
    )


def _count(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("c"))


def _grid(spark: SparkSession, **sizes: int) -> DataFrame:
    """All combinations of whole numbers 0 to size - 1."""
    out = spark.range(1)
    for name, size in sizes.items():
        out = out.withColumn(name, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(size - 1).cast("long"))))
    return out.drop("id")


def _one(spark: SparkSession, **values) -> DataFrame:
    return spark.range(1).select(*(v.alias(k) if isinstance(v, Column) else F.lit(v).alias(k) for k, v in values.items()))


# --- scalar functions ------------------------------------------------------------------------------------------


def s1_hardware_totals(spark, sf_dir):
    hw = tables(spark, sf_dir)[2]
    return _one(spark, total_cores=F.lit(hw.cores).cast("long"), total_neurons=F.lit(hw.slots).cast("long"), max_distance=F.lit(hw.max_distance).cast("long"))


def s4_slot_addresses(spark, sf_dir):
    grid = _grid(spark, core=GRID.cores, local=GRID.n).select(GRID.slot("core", "local").alias("slot"))
    return grid.withColumn("back", GRID.core_and_local("slot")).select("slot", F.col("back.core").alias("core_back"), F.col("back.local").alias("local_back"))


def s6_core_distance(spark, sf_dir):
    return _grid(spark, a=GRID.cores, b=GRID.cores).select("a", "b", GRID.distance("a", "b").cast("long").alias("distance"))


def s7_slice_bounds(spark, sf_dir):
    grid = _grid(spark, distance=GRID.l + 1, slice=GRID.n).where(F.col("slice") < GRID.slices("distance"))
    return grid.select("distance", "slice", GRID.low("distance", "slice").alias("low"), GRID.high("distance", "slice").alias("high"))


def s9_slice_index(spark, sf_dir):
    return _grid(spark, distance=GRID.l + 1, x=GRID.n).select("distance", "x", GRID.slice_index("distance", "x").alias("slice"))


def s10_valid_connection(spark, sf_dir):
    grid = _grid(spark, distance=GRID.l + 1, x=GRID.n, k=8).where(F.col("k") < GRID.slices("distance"))
    return grid.select("distance", "x", "k", GRID.valid_connection("distance", "x", "k").alias("valid"))


def s11_halving_slices(spark, sf_dir):
    return _grid(spark, distance=GRID.l + 1, x=GRID.n).select("distance", "x", GRID.halving_slice("distance", "x").alias("slice"))


def s12_log_star(spark, sf_dir):
    return spark.range(1, 1001).select(F.col("id").alias("n"), F.round(scalars.log_star(F.col("id")), 9).alias("log_star"))


def s13_degree_scale(spark, sf_dir):
    return _grid(spark, b=6, h=5).where("b >= 2").select("b", "h", F.round(scalars.degree_scale(F.col("b"), F.col("h")), 8).alias("scale"))


def s15_connection_probability(spark, sf_dir):
    return _grid(spark, cs=5, ct=5).select("cs", "ct", scalars.connection_probability(F.col("cs"), F.col("ct"), 3).alias("p"))


def s16_strings(spark, sf_dir):
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    return p.select(scalars.shortened(F.col("p_name"), 12).alias("short"), scalars.safe_name(F.col("p_brand")).alias("safe")).distinct()


# --- sources ---------------------------------------------------------------------------------------------------


def g1_erdos_renyi(spark, sf_dir):
    return networks.erdos_renyi(spark, 60, 0.1)


def g2_feasible_slices(spark, sf_dir):
    return networks.feasible(spark, SMALL, 0.5)[0]


def g2_ground_truth(spark, sf_dir):
    """Links of a feasible network, and those that the placement and slices it was made from miss: none."""
    net = networks.network(spark, "feasible", SMALL, p=0.5)
    edges, sizes = runner.together([net])
    scored = runner.scored(edges, sizes, *runner.known([net], SMALL, 42), SMALL)
    return scored.select("m", (F.col("m") - F.col("kept")).alias("inconsistencies"))


def g3_soft_wta(spark, sf_dir):
    return networks.soft_wta(spark, 3, 2, 12)


def g4_wta(spark, sf_dir):
    return networks.wta(spark, 60, 0.5)


def g5_block_hierarchy(spark, sf_dir):
    return networks.block_hierarchy(spark, 15, 2, 2, 0.3)


def g7_two_components(spark, sf_dir):
    return networks.two_components(spark, 8)


# --- constraints -----------------------------------------------------------------------------------------------


def p4_assignment_violations(spark, sf_dir):
    neurons, _, hw, placement, placed = spread(spark, sf_dir)
    return slices.violations(placement, slices.optimal_slices(neurons, placed, hw), hw)


def faulty(spark, sf_dir):
    """Neurons, a placement that has some of each fault (a neuron left out, one twice, an unknown one, a null core), slices with some missing."""
    neurons, _, hw, placement, placed = spread(spark, sf_dir)
    last = neurons.agg(F.max("id")).first()[0] or 0
    bad = placement.where("neuron % 7 <> 3").unionByName(placement.where("neuron % 7 = 5"))
    bad = bad.unionByName(placement.where("neuron % 11 = 1").select((F.col("neuron") + last + 1).alias("neuron"), F.lit(None).cast("long").alias("core"), "local"))
    chosen = slices.optimal_slices(neurons, placed, hw).where("not (neuron % 5 = 2 and distance = 2)")
    return neurons, bad, chosen, hw


def p3_shape_violations(spark, sf_dir):
    """Every rule of shape over faulty rows."""
    return checks.shape(*faulty(spark, sf_dir))


def p8_clustering_check(spark, sf_dir):
    return checks.clustering(labels(spark, sf_dir), 64).select("dense", "fits_cores", "largest")


def p10_result_filter(spark, sf_dir):
    return reports.matching(results_of(spark, sf_dir), "Inconsistencies", "net1", ["mapper0", "mapper2"]).select("mapper", "input_id", "value")


# --- joins -----------------------------------------------------------------------------------------------------


def j1_placed_edges(spark, sf_dir):
    placed = spread(spark, sf_dir)[4]
    return placed.select("src", "tgt", *(F.col(c).cast("long").alias(c) for c in ("src_local", "src_core", "tgt_core", "distance")))


def j5_slice_range_join(spark, sf_dir):
    """For every neuron the sources in one half of the next core."""
    _, _, hw, placement, _ = spread(spark, sf_dir)
    half = F.col("neuron") % 2
    low, high = F.expr(f"(neuron % 2) * {hw.n} DIV 2"), F.expr(f"(neuron % 2 + 1) * {hw.n} DIV 2")
    wanted = placement.select("neuron", ((F.col("core") + 1) % hw.cores).alias("core"), low.alias("low"), high.alias("high"), half.alias("half"))
    return metrics.range_counts(placement, wanted).where("candidates > 0").select(F.col("neuron").alias("tgt"), "candidates")


def j6_induced_subgraph(spark, sf_dir):
    return metrics.induced(tables(spark, sf_dir)[1], labels(spark, sf_dir))


def j7_free_slots(spark, sf_dir):
    _, _, hw, placement, _ = spread(spark, sf_dir)
    return metrics.free_slots(placement, hw)


def j8_hierarchy_neurons(spark, sf_dir):
    """Clusters of a tree with their children, and how many neurons its leaves hold, and their sum; every brand is in one of four leaves."""
    at = hierarchy.with_neurons(tree(spark), labels(spark, sf_dir).withColumn("cluster", F.col("cluster") % 4))
    return at.select("cluster", F.size("children").cast("long").alias("children"), F.size("neurons").cast("long").alias("neurons"), F.aggregate("neurons", F.lit(0).cast("long"), lambda s, x: s + x).alias("neuron_sum"))


def j10_contingency(spark, sf_dir):
    return metrics.contingency(brands(spark, sf_dir))


# --- measures --------------------------------------------------------------------------------------------------


def a7_hardware_cost(spark, sf_dir):
    neurons, _, hw = tables(spark, sf_dir)
    return _count(neurons).select(F.round(metrics.hardware_cost(hw, F.col("c")), 6).alias("cost"), metrics.joint_cost(hw, F.col("c")).cast("double").alias("joint_cost"))


def a8_total_connections(spark, sf_dir):
    return _one(spark, connections=F.lit(tables(spark, sf_dir)[2].total_connections()).cast("long"))


def a10_adjusted_rand(spark, sf_dir):
    return metrics.adjusted_rand(brands(spark, sf_dir))


def a13_description_length(spark, sf_dir):
    neurons, _, hw = tables(spark, sf_dir)
    return _count(neurons).select(F.round(metrics.description_length(hw, F.col("c")), 4).alias("nats"))


def a14_search_energy(spark, sf_dir):
    neurons, _, hw, _, placed = spread(spark, sf_dir)
    valid = slices.valid_edges(placed, slices.optimal_slices(neurons, placed, hw), hw)
    return valid.agg(F.count_if(~F.col("valid")).alias("v")).select(F.round(metrics.search_energy(hw, F.col("v").cast("double")), 6).alias("energy"))


def a15_degrees(spark, sf_dir):
    neurons, edges, _ = tables(spark, sf_dir)
    return metrics.degrees(neurons, edges)


def a16_core_occupancy(spark, sf_dir):
    return metrics.occupancy(spread(spark, sf_dir)[3])


def a17_core_links(spark, sf_dir):
    return metrics.core_links(spread(spark, sf_dir)[4])


def a18_link_distance(spark, sf_dir):
    _, _, hw, _, placed = spread(spark, sf_dir)
    return metrics.link_distance(placed, hw.cores)


def a19_block_links(spark, sf_dir):
    return metrics.block_links(tables(spark, sf_dir)[1], labels(spark, sf_dir))


def a20_hierarchy(spark, sf_dir):
    return hierarchy.described(tree(spark))


def a21_graph_moments(spark, sf_dir):
    neurons, edges, _ = tables(spark, sf_dir)
    return metrics.moments(neurons, edges)


def a22_mean_times(spark, sf_dir):
    return reports.mean_times(results_of(spark, sf_dir), "Hardware Size").select("mapper", F.round("seconds", 9).alias("seconds"))


def a23_replicate_means(spark, sf_dir):
    means = reports.replicate_means(results_of(spark, sf_dir))
    return means.select("input_id", "metric", "mapper", F.round("value", 9).alias("value"))


def a24_density(spark, sf_dir):
    neurons, edges, _ = tables(spark, sf_dir)
    return metrics.density(neurons, edges)


# --- ranks and sets --------------------------------------------------------------------------------------------


def w6_spread(spark, sf_dir):
    return spread(spark, sf_dir)[3].select("neuron", F.col("core").cast("long").alias("core"), F.col("local").cast("long").alias("local"))


def w7_random_slices(spark, sf_dir):
    neurons, _, hw = tables(spark, sf_dir)
    return graph.random_slices(neurons, hw).select("neuron", F.col("distance").cast("long").alias("distance"), "slice")


def w9_adjacency_order(spark, sf_dir):
    return metrics.adjacency_order(spread(spark, sf_dir)[3])


def w10_report_order(spark, sf_dir):
    """Lines of a report by input and mapper, numbered."""
    long = results_of(spark, sf_dir)
    kind = long.select("input_id").distinct().select("input_id", F.col("input_id").alias("graph_type"))
    table = reports.report(long, ["Hardware Size", "Inconsistencies"]).join(kind, "input_id")
    return graph.ranked(table, F.col("graph_type"), ["mapper", "input_id"], "line").select("line", "mapper", "input_id", "hardware_size", "inconsistencies")


def w11_log_gaps(spark, sf_dir):
    sizes = spark.read.parquet(f"{sf_dir}/part.parquet").groupBy(F.col("p_size").cast("long").alias("k")).agg((F.count("*").cast("double") + F.col("k") / 1000.0).alias("v"))
    return estimators.log_gaps(sizes)


def w12_dense_labels(spark, sf_dir):
    return labels(spark, sf_dir)


def w13_active_levels(spark, sf_dir):
    own = labels(spark, sf_dir).select("cluster").distinct()
    level = own.select("cluster", F.expr("cluster DIV 3").alias("parent"))
    return hierarchy.active_level(level, own.where("cluster % 4 <> 1"))


def set_undirected(spark, sf_dir):
    return metrics.undirected(tables(spark, sf_dir)[1])


def c3_bethe_hessian(spark, sf_dir):
    neurons, edges, _ = tables(spark, sf_dir)
    return metrics.bethe_hessian(neurons, edges)


def c5_laplacian(spark, sf_dir):
    neurons, edges, _ = tables(spark, sf_dir)
    return metrics.laplacian(neurons, edges)


def c9_expanded_hierarchy(spark, sf_dir):
    own = labels(spark, sf_dir)
    first = own.select("cluster").distinct().select("cluster", F.expr("cluster DIV 4").alias("up"))
    second = first.select("up").distinct().select("up", F.expr("up DIV 2").alias("top"))
    return hierarchy.expanded(own, [first, second])


def c10_round_robin(spark, sf_dir):
    return hierarchy.round_robin(tables(spark, sf_dir)[0], 64)


def c11_hyperedges(spark, sf_dir):
    neurons, edges, _ = tables(spark, sf_dir)
    pins = hierarchy.hyperedges(neurons, edges, labels(spark, sf_dir))
    return pins.groupBy("net").agg(F.count("*").alias("pins"), F.sum("pin").cast("long").alias("pin_sum"))


# --- hardware from clusters ------------------------------------------------------------------------------------


def h2_flat_rebuild(spark, sf_dir):
    hw = hierarchy.flat_rebuild(tree(spark), labels(spark, sf_dir))
    return _one(spark, n=F.lit(hw.n).cast("long"), r=F.lit(hw.r).cast("long"), l=F.lit(hw.l).cast("long"))


def h3_padding(spark, sf_dir):
    own = labels(spark, sf_dir).withColumn("cluster", F.col("cluster") % 4)
    return hierarchy.padded(tree(spark), own)[1]


def h4_leaf_distance(spark, sf_dir):
    return hierarchy.leaf_distance(tree(spark))


def h5_legacy_slices(spark, sf_dir):
    """The older slices of every neuron, brands as leaves of a tree of fives of fives."""
    neurons, edges, _ = tables(spark, sf_dir)
    own = graph.ranked(labels(spark, sf_dir), F.col("cluster"), ["neuron"], "at")
    first = own.groupBy("cluster").agg(F.min("at").alias("first"), F.count("*").alias("size"))
    local = own.join(first, "cluster").select("neuron", (F.col("at") - F.col("first")).alias("local"))
    ids = first.select("cluster")
    level = F.expr("CAST(a <> b AS BIGINT) + CAST(a DIV 5 <> b DIV 5 AS BIGINT)")
    distances = ids.toDF("a").crossJoin(ids.toDF("b")).select("a", "b", level.alias("distance"))
    return hierarchy.legacy_slices(edges, labels(spark, sf_dir), local, distances, first.select("cluster", "size"), neurons, 2)


# --- estimators ------------------------------------------------------------------------------------------------


def q1_block_moments(spark, sf_dir):
    mean, variance, _ = estimators.moments(60.0, 2.0, 0.3, 4)
    return _one(spark, mean_degree=round(float(mean), 8), var_degree=round(float(variance), 8))


def q3_spectral_threshold(spark, sf_dir):
    neurons, edges, _ = tables(spark, sf_dir)
    both = _count(neurons).toDF("n").crossJoin(_count(edges).toDF("m"))
    return both.select(F.round(estimators.threshold(F.col("n"), F.col("m")), 9).alias("threshold"))


def q5_tie_break(spark, sf_dir):
    return spark.range(1, 7).select(F.col("id").alias("h"), F.round(estimators.branching_gap(F.lit(81.0), F.col("id")), 6).alias("score"))


def q6_levels_for_base(spark, sf_dir):
    return spark.range(1, 101).select(F.col("id").alias("blocks"), estimators.levels_of(F.col("id"), 3.0).alias("h"))


# --- experiments -----------------------------------------------------------------------------------------------


def x1_experiment_grid(spark, sf_dir):
    return runner.grid(["ER_60n_p0.1", "Feasible_R=2_l=2_N=15_p=0.5_seed=42"], ["Greedy", "QAP", "SA"], ["relative", "raw"], spark)


def _two_networks(spark):
    return [networks.network(spark, "erdos_renyi", SMALL, n=60, p=0.1), networks.network(spark, "feasible", SMALL, p=0.5)]


MAPPERS = ["random", "truth", "greedy", "three_step", "three_step_recursive", "three_step_hyperedges"]


def x2_experiment(spark, sf_dir):
    """Real runs: two networks through six mappers, measures raw and against a random placement; times are left out, as they differ."""
    return runner.run(_two_networks(spark), MAPPERS).where(~F.col("metric").eqNullSafe(runner.TIME))


def x3_truth_run(spark, sf_dir):
    """Of those runs the ground truth of the feasible network against itself."""
    bundle = runner.Bundle(("Inconsistencies", "Hardware Size", "Inconsistencies (Fraction)"), "truth")
    return runner.evaluated(_two_networks(spark)[1:], "truth", bundle).select("mapper", "metric", "raw", "relative")


def x3_random_run(spark, sf_dir):
    """A random placement of both networks, scored at random slices."""
    return runner.evaluated(_two_networks(spark), "random", runner.Bundle(("Inconsistencies", "Valid Edges"), None)).select("input_id", "metric", "raw")


def x6_mean_over_networks(spark, sf_dir):
    """The run as a whole, as a summary of maps; then its maps unfolded again."""
    nets = _two_networks(spark)
    long = runner.run(nets, ["truth", "greedy"], runner.Bundle(("Hardware Size",), "random")).where(F.col("metric") != runner.TIME)
    return reports.unmapped(runner.summary(long, nets))


def x4_against_baseline(spark, sf_dir):
    out = reports.against(results_of(spark, sf_dir), "mapper0", ["Hardware Size"])
    return out.select("input_id", "metric", "mapper", F.round("relative", 9).alias("relative"))


def x7_unpivot(spark, sf_dir):
    long = results_of(spark, sf_dir)
    wide = reports.wide(long, F.max("value"), metrics=["Hardware Size", "Inconsistencies"])
    return reports.unpivot(wide, {"inconsistencies": "Inconsistencies", "hardware_size": "Hardware Size"})


def x8_pivot(spark, sf_dir):
    return reports.archive(results_of(spark, sf_dir))


def x9_report(spark, sf_dir):
    return reports.report(results_of(spark, sf_dir)).select("input_id", "mapper", "hardware_size", "inconsistencies")


def x10_bars(spark, sf_dir):
    return reports.bars(results_of(spark, sf_dir)).select("input_id", "mapper0", "mapper1", "mapper2")


def x11_network_key(spark, sf_dir):
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    about = F.create_map(F.lit("size"), F.col("p_size").cast("string"), F.lit("brand"), F.col("p_brand"))
    return p.select(scalars.joined_map(about).alias("network")).groupBy("network").agg(F.count("*").alias("k"))


def x12_adjacency_points(spark, sf_dir):
    neurons, _, hw, placement, placed = spread(spark, sf_dir)
    return views.adjacency_points(slices.valid_edges(placed, slices.optimal_slices(neurons, placed, hw), hw), placement)


def x12_cluster_circle(spark, sf_dir):
    return views.circle(labels(spark, sf_dir))


def x12_routing_tree(spark, sf_dir):
    neurons, _, hw = tables(spark, sf_dir)
    return views.routing_tree(neurons, hw)


def x12_hardware_map(spark, sf_dir):
    _, _, hw, placement, _ = spread(spark, sf_dir)
    return views.hardware_map(placement, hw).withColumn("share", F.round("share", 9))


def x13_distinct_hardware(spark, sf_dir):
    return reports.distinct_hardware(spark.range(60).select((F.col("id") % 3 + 2).alias("r"), (F.col("id") % 2 + 1).alias("l")))


def queries() -> dict:
    import re

    return {k: f for k, f in globals().items() if re.match(r"[a-z]\d+_|set_", k) and callable(f)}
