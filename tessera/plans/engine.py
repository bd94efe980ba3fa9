"""Queries built with the DataFrame API and kernels, and the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera import graph
from tessera.hw import HardwareConfig
from tessera.operators import checks, estimators, kernels, searches, slices, spectral
from tessera.plans import network_queries, runner, whole_network
from tessera.plans.catalog import GRAPH, LABELS, PLACED, RESULTS, Dialect
from tessera.plans.network_queries import hardware
from tessera.sources import results


def _spread(spark: SparkSession, sf_dir: str):
    neurons, edges, hw, placement, placed = network_queries.spread(spark, sf_dir)
    return neurons, edges, hw, placement, placed


def w1_optimal_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    neurons, _, hw, _, placed = _spread(spark, sf_dir)
    return slices.optimal_slices(neurons, placed, hw)


def a1_mapping_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    neurons, _, hw, _, placed = _spread(spark, sf_dir)
    return slices.score_of(slices.best_counts(placed, hw), neurons, hw)


def a2_scored_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every edge with its distance and whether the best slices hear it."""
    neurons, _, hw, _, placed = _spread(spark, sf_dir)
    return slices.valid_edges(placed, slices.optimal_slices(neurons, placed, hw), hw).select("src", "tgt", F.col("distance").cast("long").alias("distance"), "valid")


def w2_delta_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first and the last neuron change places; the slices afterwards, from those before."""
    neurons, edges, hw, placement, placed = _spread(spark, sf_dir)
    before = slices.optimal_slices(neurons, placed, hw)
    last = neurons.agg(F.max("id")).first()[0]
    slot = F.when(F.col("neuron") == 0, last).when(F.col("neuron") == last, 0).otherwise(F.col("neuron"))
    after = placement.select("neuron", slot.alias("slot")).select("neuron", F.expr(f"slot DIV {hw.n}").alias("core"), F.expr(f"slot % {hw.n}").alias("local"))
    moved = neurons.where(F.col("id").isin(0, last)).select(F.col("id").alias("neuron"))
    return slices.delta_slices(neurons, edges, after, before, moved, hw)


def p6_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every rule of a mapping over rows that break some of each."""
    return checks.whole(*network_queries.faulty(spark, sf_dir))


def w5_core_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = spark.read.parquet(f"{sf_dir}/part.parquet")
    labels = parts.select(F.col("p_partkey").cast("long").alias("neuron"), F.col("p_brand").alias("cluster"))
    return graph.fill(labels, hardware(parts))


def w7_random_placement(spark: SparkSession, sf_dir: str) -> DataFrame:
    neurons, _ = graph.from_tables(spark, sf_dir)
    return graph.random_placement(neurons, hardware(neurons))


def a11_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = spark.read.parquet(f"{sf_dir}/part.parquet")
    return kernels.accuracy(parts.select(F.col("p_brand").alias("truth"), F.col("p_size").alias("predicted")))


def _small_graphs(spark: SparkSession):
    """Two networks: G(60, 0.1), and two complete halves of 8."""
    ids = spark.range(60).select(F.col("id").alias("src")).crossJoin(spark.range(60).select(F.col("id").alias("tgt"))).where("src <> tgt")
    er = ids.where(graph.uniform(F.concat_ws(":", "src", "tgt")) < 0.1 * 2**32).select(F.lit("er").alias("graph_id"), "src", "tgt")
    two = ids.where("src < 16 and tgt < 16 and src DIV 8 = tgt DIV 8").select(F.lit("two").alias("graph_id"), "src", "tgt")
    return er.unionByName(two), spark.createDataFrame([("er", 60), ("two", 16)], "graph_id string, n long")


def _missed(edges: DataFrame, sizes: DataFrame, placement: DataFrame, hw: HardwareConfig, chosen: DataFrame | None = None) -> DataFrame:
    """Links of each network, and those that the slices chosen, or the best ones, miss; a network without links has a row too."""
    scored = runner.scored(edges, sizes, placement, chosen, hw)
    return scored.select("graph_id", "m", (F.col("m") - F.col("kept")).alias("inconsistencies"))


def _mapper(method: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        edges, sizes = _small_graphs(spark)
        hw = HardwareConfig(2, 16, 2, 2)
        if method in kernels.METHODS:
            return _missed(edges, sizes, kernels.mapped(edges, sizes, hw, method), hw)
        found = searches.searched(edges, sizes, method, hw).persist()
        own = _missed(edges, sizes, found, hw, searches.found_slices(found))
        return own.join(found.groupBy("graph_id").agg(F.max("missed").alias("missed_by_search"), F.max("proved").alias("proved")), "graph_id")

    return query


def m3_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A ring of six, and two complete fours, on two cores of four: the least that any placement misses."""
    ids = spark.range(8).select(F.col("id").alias("src")).crossJoin(spark.range(8).select(F.col("id").alias("tgt")))
    ring = ids.where("src < 6 and tgt = (src + 1) % 6").select(F.lit("ring").alias("graph_id"), "src", "tgt")
    fours = ids.where("src <> tgt and src DIV 4 = tgt DIV 4").select(F.lit("fours").alias("graph_id"), "src", "tgt")
    edges, hw = ring.unionByName(fours), HardwareConfig(2, 4, 1, 2)
    sizes = spark.createDataFrame([("ring", 6), ("fours", 8)], "graph_id string, n long")
    found = searches.searched(edges, sizes, "exact", hw)
    return _missed(edges, sizes, found, hw).join(found.groupBy("graph_id").agg(F.min("proved").alias("proved")), "graph_id")


def _hardware_search(method: str):
    """Of the hardware that the search found: what the placement breaks; whether its slices miss what the search says; whether the search
    ended no dearer than it began; and whether it misses no more than the placement of the same number of cores in order of id would."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        edges, sizes = _small_graphs(spark)
        found = searches.searched(edges, sizes, method).persist()
        cores = F.pow("r", "l").cast("long")
        own = found.groupBy("graph_id").agg(
            F.count("*").alias("neurons"),
            F.count_if((F.col("core") < 0) | (F.col("core") >= cores) | (F.col("local") < 0) | (F.col("local") >= F.col("n"))).alias("out_of_range"),
            (F.count("*") - F.countDistinct("core", "local")).alias("slots_shared"),
            F.max("missed").alias("missed"),
            F.coalesce(F.max(F.col("cost") <= F.col("start_cost")), F.lit(True)).alias("no_dearer"),
            *(F.first(c).alias(c) for c in ("r", "n", "l", "f")),
        )
        scored = [runner.scored(edges.where(F.col("graph_id") == h.graph_id), sizes.where(F.col("graph_id") == h.graph_id), found, searches.found_slices(found), HardwareConfig(h.r, h.n, h.l, h.f)) for h in own.select("graph_id", "r", "n", "l", "f").collect()]
        both = own.join(scored[0].unionByName(scored[1]).select("graph_id", (F.col("m") - F.col("kept")).alias("counted"), "m"), "graph_id")
        return both.select("graph_id", "neurons", "out_of_range", "slots_shared", (F.col("counted") == F.col("missed")).alias("counts_agree"), "no_dearer", (F.col("missed") < F.col("m")).alias("hears"))

    return query


def _clusters(method: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        """Four complete tens in a row, joined by single links: the finest level of the hierarchy."""
        ids = spark.range(40).select(F.col("id").alias("src")).crossJoin(spark.range(40).select(F.col("id").alias("tgt")))
        edges = ids.where("src <> tgt and src DIV 10 = tgt DIV 10 or tgt = src + 1").select(F.lit("tens").alias("graph_id"), "src", "tgt")
        found = spectral.clustered(edges, spark.createDataFrame([("tens", 40)], "graph_id string, n long"), method)
        return found.where("level = 0").select("neuron", "cluster", "parent")

    return query


def c8_expected_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What chance gives for 1 to 24 groups when 1, 4, 12 and 24 are levels."""
    errors = spectral.expected_errors([1, 4, 12, 24])
    return spark.createDataFrame([(k + 1, round(float(x), 9)) for k, x in enumerate(errors)], "k long, expected double")


def c10_recursive_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Complete groups in a row, split two ways level by level: each on a core of its own."""
    ids = spark.range(16).select(F.col("id").alias("src"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(15).cast("long"))).alias("tgt"))
    edges = ids.where("src <> tgt and src DIV 4 = tgt DIV 4 or tgt = src + 1").select(F.lit("fours").alias("graph_id"), "src", "tgt")
    sizes = spark.createDataFrame([("fours", 16)], "graph_id string, n long")
    hw = HardwareConfig(2, 4, 2, 2)
    both = [kernels.mapped(edges, sizes, hw, m).select(F.lit(m).alias("nets"), "neuron", "core") for m in ("three_step_recursive", "three_step_hyperedges")]
    each = both[0].unionByName(both[1])
    return each.groupBy("nets", F.expr("neuron DIV 4").alias("fours")).agg(F.countDistinct("core").alias("cores"), F.count("*").alias("neurons"))


def q2_estimates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf size, branching, depth and probability of a planted network of eight leaves of 20, by each estimator."""
    ids = spark.range(160).select(F.col("id").alias("src")).crossJoin(spark.range(160).select(F.col("id").alias("tgt"))).where("src <> tgt")
    level = F.expr("CAST(src DIV 20 <> tgt DIV 20 AS INT) + CAST(src DIV 40 <> tgt DIV 40 AS INT) + CAST(src DIV 80 <> tgt DIV 80 AS INT)")
    linked = graph.uniform(F.concat_ws(":", "src", "tgt")) < F.lit(0.6 * 2**32) * F.pow(F.lit(0.5), level)
    edges = ids.where(linked).select(F.lit("tree").alias("graph_id"), "src", "tgt")
    return estimators.estimated(edges, spark.createDataFrame([("tree", 160)], "graph_id string, n long"), depth=3)


def k7_evaluation_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The results of all orders as an evaluation in a run folder, and back."""
    long = network_queries.results_of(spark, sf_dir).select("mapper", "input_id", "metric", "value")
    return results.read_evaluation(spark, results.write_csv(long, results.run_folder(spark), "evaluation"))


def k5_summary_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    summary = orders.select(
        F.concat(F.lit("mapper"), (F.col("o_orderkey") % 3).cast("string")).alias("mapper"),
        F.col("o_orderkey").cast("string").alias("input_id"),
        F.create_map(F.lit("Inconsistencies"), (F.col("o_orderkey") % 1000).cast("double")).alias("metrics"),
        F.when(F.col("o_orderkey") % 300 == 0, F.lit("failed")).alias("error"),
    )
    back = results.read_summary(spark, results.write_summary(summary))
    return back.select("mapper", "input_id", F.col("metrics")["Inconsistencies"].alias("value"), "error")


QUERIES = {
    "w1_optimal_slices": w1_optimal_slices,
    "a1_mapping_score": a1_mapping_score,
    "a2_scored_edges": a2_scored_edges,
    "w2_delta_slices": w2_delta_slices,
    "p6_violations": p6_violations,
    "w5_core_packing": w5_core_packing,
    "w7_random_placement": w7_random_placement,
    "a11_accuracy": a11_accuracy,
    "m2_greedy": _mapper("greedy"),
    "m5_three_step": _mapper("three_step"),
    "m8_annealing": _mapper("anneal"),
    "m3_exact": m3_exact,
    "m4_quadratic_assignment": _mapper("assigned"),
    "c13_assigned_cores": _mapper("assigned_parts"),
    "m12_slice_chain": _mapper("slice_chain"),
    "m15_parts_then_annealing": _mapper("parts_then_anneal"),
    "m10_hardware_chain": _hardware_search("hardware_chain"),
    "m13_joint_chain": _hardware_search("joint_chain"),
    "m15_parts_then_hardware": _hardware_search("parts_then_hardware"),
    "m15_clusters_then_hardware": _hardware_search("clusters_then_hardware"),
    "m6_blocks_flat": _hardware_search("blocks_flat"),
    "m6_blocks_padded": _hardware_search("blocks_padded"),
    "m6_spectral_padded": _hardware_search("spectral_padded"),
    "m7_blocks_on_given": _mapper("blocks_on_given"),
    "m7_spectral_on_given": _mapper("spectral_on_given"),
    "m15_clusters_then_annealing": _mapper("clusters_then_anneal"),
    "c10_recursive_parts": c10_recursive_parts,
    "k7_evaluation_round_trip": k7_evaluation_round_trip,
    "c1_nested_blocks": _clusters("nested_blocks"),
    "c2_spectral_hierarchy": _clusters("spectral"),
    "c8_expected_errors": c8_expected_errors,
    "q2_estimates": q2_estimates,
    "k5_summary_round_trip": k5_summary_round_trip,
    **whole_network.QUERIES,
}


def oracle() -> dict[str, str]:
    d = Dialect(False)
    last = "(SELECT max(id) FROM neurons)"
    swapped = PLACED.replace("SELECT id AS neuron, id DIV n AS core, id % n AS local FROM neurons CROSS JOIN hw", f"SELECT id AS neuron, slot DIV n AS core, slot % n AS local FROM (SELECT id, CASE WHEN id = 0 THEN {last} WHEN id = {last} THEN 0 ELSE id END AS slot FROM neurons) z CROSS JOIN hw")
    n8 = " + ".join(f"{3 * 4 ** (k - 1)} * (n DIV CAST(least({2**k}, n) AS BIGINT))" for k in (1, 2, 3))
    sql = {
        "w1_optimal_slices": f"WITH {PLACED} SELECT neuron, distance, slice, hits FROM slices",
        "a2_scored_edges": f"WITH {PLACED} SELECT src, tgt, CAST(distance AS BIGINT) AS distance, valid FROM valid",
        "w2_delta_slices": f"WITH {swapped} SELECT neuron, distance, slice, hits FROM slices",
        "a1_mapping_score": f"""WITH {PLACED}, c AS (SELECT count(*) AS m, count_if(valid) AS e FROM valid), k AS (SELECT count(*) AS k FROM neurons)
            SELECT m, CAST(e AS BIGINT) AS valid_edges, CAST(m - e AS BIGINT) AS inconsistencies, CAST((m - e) AS DOUBLE) / m AS fraction, 100.0::DOUBLE * (m - e) / m AS percent,
            round(e * ln((e + 1)::DOUBLE / (k * n + 2)) + (m - e) * ln(1e-10), 4) AS log_likelihood, 64 * n AS hardware_size,
            CAST(64 * n * (n + {n8}) - e AS BIGINT) AS unused_connections FROM c CROSS JOIN k CROSS JOIN hw""",
        "p6_violations": f"""WITH {PLACED}, bad AS (SELECT neuron, core, local FROM place WHERE neuron % 7 <> 3 UNION ALL SELECT neuron, core, local FROM place WHERE neuron % 7 = 5
              UNION ALL SELECT neuron + {last} + 1, NULL, local FROM place WHERE neuron % 11 = 1),
            chosen AS (SELECT * FROM slices WHERE NOT (neuron % 5 = 2 AND distance = 2)), times AS (SELECT neuron, count(*) AS k FROM bad GROUP BY neuron),
            own AS (SELECT id, coalesce(k, 0) AS k FROM neurons LEFT JOIN times ON neuron = id), grid AS (SELECT id, count(neuron) AS k FROM neurons LEFT JOIN chosen ON neuron = id GROUP BY id)
            SELECT 'more neurons than slots' AS rule, CAST(count(*) > 64 * any_value(n) AS BIGINT) AS violations FROM neurons CROSS JOIN hw
            UNION ALL SELECT 'neuron not placed once', (SELECT count(*) FROM own WHERE k <> 1) + (SELECT count(*) FROM times WHERE k <> 1 AND neuron NOT IN (SELECT id FROM neurons))
            UNION ALL SELECT 'placed neuron unknown', (SELECT count(*) FROM times WHERE neuron NOT IN (SELECT id FROM neurons))
            UNION ALL SELECT 'slices not one a distance', (SELECT count(*) FROM grid WHERE k <> 3)
            UNION ALL SELECT 'null in placement', (SELECT count(*) FROM bad WHERE neuron IS NULL OR core IS NULL OR local IS NULL)
            UNION ALL SELECT 'null in slices', (SELECT count(*) FROM chosen WHERE neuron IS NULL OR distance IS NULL OR slice IS NULL)
            UNION ALL SELECT 'core out of range', (SELECT count(*) FROM bad WHERE core < 0 OR core >= 64)
            UNION ALL SELECT 'local out of range', (SELECT count(*) FROM bad CROSS JOIN hw WHERE local < 0 OR local >= n)
            UNION ALL SELECT 'core over capacity', (SELECT count(*) FROM (SELECT core, count(*) AS k FROM bad GROUP BY core) c CROSS JOIN hw WHERE k > n)
            UNION ALL SELECT 'slot shared', (SELECT count(*) FROM (SELECT core, local, count(*) AS k FROM bad GROUP BY core, local) c WHERE k > 1)
            UNION ALL SELECT 'slice out of range', (SELECT count(*) FROM chosen CROSS JOIN hw WHERE slice < 0 OR slice >= least(pow(2, distance), n))""",
        "w5_core_packing": f"WITH {GRAPH}, {LABELS} SELECT neuron, CAST(k DIV n AS BIGINT) AS core, CAST(k % n AS BIGINT) AS local FROM (SELECT neuron, row_number() OVER (ORDER BY truth, neuron) - 1 AS k FROM labels_) t CROSS JOIN hw",
        "w7_random_placement": f"WITH {GRAPH}, slots AS (SELECT range AS slot, row_number() OVER (ORDER BY {d.uniform(42, 'range')}, range) AS k FROM range(64 * (SELECT n FROM hw))) SELECT id AS neuron, slot DIV n AS core, slot % n AS local FROM (SELECT id, row_number() OVER (ORDER BY id) AS k FROM neurons) a JOIN slots USING (k) CROSS JOIN hw",
        "k5_summary_round_trip": "SELECT concat('mapper', CAST(o_orderkey % 3 AS STRING)) AS mapper, CAST(o_orderkey AS STRING) AS input_id, CAST(o_orderkey % 1000 AS DOUBLE) AS value, CASE WHEN o_orderkey % 300 = 0 THEN 'failed' END AS error FROM orders",
    }
    # searches that SQL cannot run: planted networks have one right answer, found hardware must fit
    tens, fits = "SELECT range AS neuron, range DIV 10 AS cluster, CAST(4 AS BIGINT) AS parent FROM range(40)", "SELECT graph_id, CAST(k AS BIGINT) AS neurons, CAST(0 AS BIGINT) AS out_of_range, CAST(0 AS BIGINT) AS slots_shared, true AS counts_agree, true AS no_dearer, true AS hears FROM (VALUES ('er', 60), ('two', 16)) g(graph_id, k)"
    sql |= {"c1_nested_blocks": tens, "c2_spectral_hierarchy": tens} | dict.fromkeys(("m10_hardware_chain", "m13_joint_chain", "m15_parts_then_hardware", "m15_clusters_then_hardware", "m6_blocks_flat", "m6_blocks_padded", "m6_spectral_padded"), fits)
    sql["m3_exact"] = "SELECT graph_id, CAST(m AS BIGINT) AS m, CAST(0 AS BIGINT) AS inconsistencies, true AS proved FROM (VALUES ('ring', 6), ('fours', 24)) v(graph_id, m)"
    sql["c10_recursive_parts"] = "SELECT nets, range AS fours, CAST(1 AS BIGINT) AS cores, CAST(4 AS BIGINT) AS neurons FROM range(4) CROSS JOIN (VALUES ('three_step_recursive'), ('three_step_hyperedges')) v(nets)"
    sql["k7_evaluation_round_trip"] = f"WITH {RESULTS} SELECT mapper, input_id, metric, value FROM results"
    sql["c8_expected_errors"] = "WITH v(a, b) AS (VALUES (1, 4), (4, 12), (12, 24)) SELECT k, round(CAST((k - a) * (b - k) AS DOUBLE) / (b - a), 9) AS expected FROM (SELECT range AS k FROM range(1, 24)) t JOIN v ON k >= a AND k < b UNION ALL SELECT 24, 0.0"
    return {k: d.text(v) for k, v in sql.items()} | whole_network.oracle()
