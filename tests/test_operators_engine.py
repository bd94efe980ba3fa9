"""Golden values and properties of scalar functions, sources, checks, trees, hardware from clusters, recursive parts, experiments."""

import itertools
import math

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tessera import graph
from tessera.errors import MappingValidationError
from tessera.functions import scalars
from tessera.hw import HardwareConfig, log_star
from tessera.operators import checks, hierarchy, kernels, metrics, reports, searches, slices
from tessera.plans import runner
from tessera.sources import networks, results

HW = HardwareConfig(2, 8, 2, 2)
BALANCED, UNEVEN = [4, 4, 5, 5, 6, 6, -1], [3, 3, 4, 5, 5, -1]


def tree(spark, parents):
    return spark.createDataFrame(list(enumerate(parents)), "cluster long, parent long")


def labelled(spark, labels):
    return spark.createDataFrame(list(enumerate(labels)), "neuron long, cluster long")


def column(df, key, value):
    return {r[key]: r[value] for r in df.collect()}


# --- scalar functions ------------------------------------------------------------------------------------------


def test_slots_and_their_bounds(spark):
    got = spark.range(32).select(HW.core_and_local("id").alias("x")).select("x.*", HW.slot("x.core", "x.local").alias("slot")).collect()
    assert [(r.core, r.local, r.slot) for r in got] == [(k // 8, k % 8, k) for k in range(32)]
    for bad in (HW.slot("4", "0"), HW.slot("0", "8"), HW.slot("0", "-1"), HW.core_and_local("32").getField("core")):
        with pytest.raises(PySparkException, match="no such"):
            spark.range(1).select(bad.alias("x")).collect()


@pytest.mark.parametrize("d,k,x,valid", [(0, 0, 0, True), (0, 0, 7, True), (0, 0, 8, False), (1, 0, 0, True), (1, 0, 3, True), (1, 0, 4, False), (1, 1, 4, True), (1, 1, 3, False)])
def test_valid_connections(spark, d, k, x, valid):
    assert spark.range(1).select(HW.valid_connection(str(d), str(x), str(k)).alias("v")).first().v is valid


def test_slice_index_outside_the_core(spark):
    got = spark.createDataFrame([(-1,), (0,), (7,), (8,)], "x long").select(HW.slice_index("2", "x").alias("k")).collect()
    assert [r.k for r in got] == [-1, 0, 3, -1]


def test_log_star_of_columns(spark):
    n = [0, 1, 2, 3, 16, 1000, 10**9, 2**62]
    got = spark.createDataFrame([(x,) for x in n], "n long").select(scalars.log_star(F.col("n")).alias("x")).collect()
    assert all(math.isclose(r.x, log_star(x), abs_tol=1e-9) for r, x in zip(got, n))


def test_strings(spark):
    df = spark.createDataFrame([("a long network name", {"b": "2", "a": "1"})], "t string, m map<string,string>")
    got = df.select(scalars.shortened(F.col("t"), 10), scalars.safe_name(F.col("t")), scalars.joined_map(F.col("m"))).first()
    assert tuple(got) == ("a long ...", "a_long_network_name", "a:1, b:2")


# --- sources ---------------------------------------------------------------------------------------------------


def test_feasible_networks_listen_to_one_slice(spark):
    for hw in (HardwareConfig(2, 8, 1, 2), HardwareConfig(2, 8, 2, 2)):
        edges, placement, chosen = networks.feasible(spark, hw, 1.0)
        heard, own = {}, {(r.neuron, r.distance): r.slice for r in chosen.collect()}
        for r in edges.collect():
            heard.setdefault((r.tgt, r.src // 8), set()).add(r.src % 8)
        for t, c in itertools.product(range(hw.slots), range(hw.cores)):
            a, b = t // 8, c
            d = 0
            while a != b:
                a, b, d = a // 2, b // 2, d + 1
            k, size = own.get((t, d), 0), 8 // hw.slices_at(d)
            assert heard[t, c] == (set(range(k * size, (k + 1) * size)) - ({t % 8} if d == 0 else set()))
    one = networks.feasible(spark, HardwareConfig(1, 5, 1, 2), 1.0)[0]
    assert one.count() == 20


def test_planted_sources(spark):
    assert networks.complete(spark, 6).count() == 30
    assert networks.two_components(spark, 8, joined=4).count() == 2 * 56 + 4
    hub = networks.wta(spark, 10, 1.0).collect()
    assert len(hub) == 18 and all(9 in (r.src, r.tgt) for r in hub)
    soft = networks.soft_wta(spark, 2, 1, 5, neighbour=0.0, e_to_i=1.0, i_to_e=0.0).collect()
    assert {(r.src // 5, r.tgt // 5) for r in soft} == {(0, 0), (1, 1), (2, 2), (0, 2), (1, 2)} and len(soft) == 3 * 20 + 2 * 25
    plain, shuffled = networks.block_hierarchy(spark, 4, 2, 2, 1.0), networks.block_hierarchy(spark, 4, 2, 2, 1.0, shuffled=True)
    assert plain.where("height = 0").count() == 4 * 12
    degrees = lambda e: sorted(r[1] for r in e.groupBy("src").count().collect())
    assert degrees(plain) == degrees(shuffled) and set(map(tuple, plain.collect())) != set(map(tuple, shuffled.collect()))
    few = networks.block_hierarchy(spark, 10, 2, 2, 1.0, active=0.5)
    assert 5 < few.select("src").distinct().count() < 35
    with pytest.raises(ValueError):
        networks.network(spark, "erdos_renyi", HardwareConfig(2, 2, 1, 2), n=5, p=0.1)


# --- checks ----------------------------------------------------------------------------------------------------


def test_whole_check_names_what_is_wrong(spark):
    neurons, placement, chosen = spark.range(32), graph.spread(spark.range(32), HW), graph.random_slices(spark.range(32), HW)
    assert checks.told(checks.whole(neurons, placement, chosen, HW)) == "valid"
    broken = placement.where("neuron <> 3").unionByName(placement.where("neuron = 4")).withColumn("core", F.when(F.col("neuron") == 5, 9).otherwise(F.col("core")))
    found = column(checks.whole(neurons, broken, chosen.where("not (neuron = 2 and distance = 1)"), HW), "rule", "violations")
    assert {k: v for k, v in found.items() if v} == {"neuron not placed once": 2, "slices not one a distance": 1, "core out of range": 1, "slot shared": 1}
    with pytest.raises(MappingValidationError, match="slot shared: 1"):
        checks.required(checks.whole(neurons, broken, chosen, HW))
    assert "invalid" in checks.told(checks.network_input(spark.range(33), HW)) and "other hardware" in checks.told(checks.network_input(neurons, HW, HardwareConfig(2, 16, 1, 2)))
    assert checks.whole(neurons, broken, chosen, HW, checks.CRITICAL).count() == 1


def test_clustering_check(spark):
    good, sparse = checks.clustering(labelled(spark, [0, 0, 1, 2]), 3, 2).first(), checks.clustering(labelled(spark, [0, 0, 0, 5]), 1, 2).first()
    assert (good.dense, good.fits_cores, good.fits_size, good.largest) == (True, True, True, 2)
    assert (sparse.dense, sparse.fits_cores, sparse.fits_size) == (False, False, False)


# --- trees and hardware ----------------------------------------------------------------------------------------


@pytest.mark.parametrize(
    "parents,labels,r,l,n,cores",
    [
        (BALANCED, [0, 1, 2, 3], 2, 2, 1, [0, 1, 2, 3]),
        (UNEVEN, [0, 1, 2], 2, 2, 1, [0, 1, 2]),
        ([4, 4, 5, 6, 7, 7, 7, -1], [0, 1, 2, 3], 3, 2, 1, [0, 1, 3, 6]),
        ([2, 2, -1], [0, 0, 0, 1], 2, 1, 3, [0, 0, 0, 1]),
        ([4, 4, 4, 4, -1], [0, 1, 2, 3], 4, 1, 1, [0, 1, 2, 3]),
    ],
)
def test_padding(spark, parents, labels, r, l, n, cores):  # noqa: E741
    hw, at = hierarchy.padded(tree(spark, parents), labelled(spark, labels))
    assert (hw.r, hw.l, hw.n) == (r, l, n)
    got = column(hierarchy.on_cores(labelled(spark, labels), at), "neuron", "core")
    assert [got[i] for i in range(len(labels))] == cores


def test_flat_rebuild(spark):
    hw = hierarchy.flat_rebuild(tree(spark, BALANCED), labelled(spark, [0, 0, 1, 2, 3]))
    assert (hw.r, hw.n, hw.l, hw.cores) == (2, 2, 2, 4)
    mean = hierarchy.flat_rebuild(tree(spark, [5, 5, 5, 6, 6, 7, 7, -1]), labelled(spark, [0, 1, 2, 3, 4]))  # 3, 2 and 2 children
    assert (mean.r, mean.l, mean.cores) == (3, 2, 9)
    single = hierarchy.flat_rebuild(tree(spark, [-1]), labelled(spark, [0, 0, 0]))
    assert (single.r, single.l, single.n) == (1, 0, 3)


def test_tree_utilities(spark):
    assert max(column(hierarchy.described(tree(spark, BALANCED)), "cluster", "depth").values()) == 2
    assert column(hierarchy.described(tree(spark, [-1])), "cluster", "depth") == {0: 0}
    assert column(hierarchy.described(tree(spark, [1, 2, 3, -1])), "cluster", "children") == {0: 0, 1: 1, 2: 1, 3: 1}
    assert column(hierarchy.sizes(labelled(spark, [0, 0, 0, 1, 2, 2])), "cluster", "neurons") == {0: 3, 1: 1, 2: 2}
    far = {(r.a, r.b): r.distance for r in hierarchy.leaf_distance(tree(spark, BALANCED)).collect()}
    assert far[0, 0] == 0 and far[0, 1] == 1 and far[0, 2] == far[3, 0] == 2 and len(far) == 16
    held = {r.cluster: (r.children, r.neurons) for r in hierarchy.with_neurons(tree(spark, [2, 2, -1]), labelled(spark, [1, 0, 0])).collect()}
    assert held == {0: ([], [1, 2]), 1: ([], [0]), 2: ([0, 1], [])}


@pytest.mark.parametrize("levels,want", [([[0, 0, 1, 1], [0, 0]], [2, 2, -1]), ([[0, 1, 2, 3], [0, 0, 1, 1], [0, 0]], BALANCED), ([[0, 0, 1, 2], [0, 1, 1], [0, 0]], [3, 4, 4, 5, 5, -1])])
def test_hardware_of_levels(spark, levels, want):
    levels = [np.array(x) for x in levels]
    assert searches.parents(levels) == want
    for adapt, table in ((searches.padded_hardware, lambda t, x: hierarchy.padded(t, x)[0]), (searches.flat_hardware, hierarchy.flat_rebuild)):
        core, hw = adapt(levels)
        assert hw == table(tree(spark, want), labelled(spark, levels[0].tolist())) and core.max() < hw.cores and np.bincount(core).max() <= hw.n


def test_legacy_slices_leave_out_the_last_level(spark):
    edges = spark.createDataFrame([(1, 0), (2, 0), (3, 0)], "src long, tgt long")
    own, far = labelled(spark, [0, 1, 1, 1]), spark.createDataFrame([(1, 0, 1), (0, 1, 1)], "a long, b long, distance long")
    local, size = spark.createDataFrame([(0, 0), (1, 0), (2, 2), (3, 3)], "neuron long, local long"), spark.createDataFrame([(0, 4), (1, 4)], "cluster long, size long")
    got = lambda below: {(r.neuron, r.distance): r.slice for r in hierarchy.legacy_slices(edges, own, local, far, size, spark.range(4), below).collect()}
    assert got(2)[0, 1] == 1 and set(got(1)) == {(k, 0) for k in range(4)}


# --- parts and mappers -----------------------------------------------------------------------------------------


PLANTED = [
    (HardwareConfig(2, 2, 2, 2), [(0, 1), (2, 3), (4, 5), (6, 7)], [(0, 2), (4, 6), (2, 4)]),
    (HardwareConfig(2, 4, 2, 2), [tuple(range(k, k + 4)) for k in range(0, 16, 4)], [(3, 4), (11, 12), (7, 8)]),
    (HardwareConfig(3, 3, 2, 3), [tuple(range(k, k + 3)) for k in range(0, 27, 3)], [(2, 3), (5, 6), (11, 12), (14, 15), (20, 21), (23, 24), (8, 9), (17, 18)]),
]


@pytest.mark.parametrize("nets", ["edges", "hyperedges"])
@pytest.mark.parametrize("hw,groups,bridges", PLANTED)
def test_recursive_parts_keep_planted_groups(hw, groups, bridges, nets):
    pairs = [p for g in groups for p in itertools.permutations(g, 2)] + bridges + [(b, a) for a, b in bridges]
    src, tgt = np.array(pairs).T
    n = sum(map(len, groups))
    core = kernels.recursive_cores(n, src, tgt, hw, nets)
    assert np.bincount(core).max() <= hw.n and sorted(set(core.tolist())) == list(range(hw.cores))
    assert all(len({int(core[i]) for i in g}) == 1 for g in groups)


def test_recursive_parts_of_odd_networks():
    none = np.empty(0, dtype=np.int64)
    hw = HardwareConfig(2, 3, 2, 2)
    assert kernels.recursive_cores(0, none, none, hw).tolist() == []
    assert np.bincount(kernels.recursive_cores(12, none, none, hw)).tolist() == [3, 3, 3, 3]
    rng = np.random.default_rng(1)
    src, tgt = rng.integers(0, 11, (2, 60))
    assert np.bincount(kernels.recursive_cores(11, src, tgt, hw)).max() <= 3
    with pytest.raises(ValueError):
        kernels.fitted_cores(np.zeros(13, dtype=int), hw)
    with pytest.raises(ValueError, match="empty"):
        kernels.recursive_cores(2, np.array([0]), np.array([1]), HardwareConfig(3, 1, 1, 1), strict=True)


def test_balanced_parts_grow_along_weights():
    src, tgt = np.array([0, 1, 2, 3]), np.array([2, 3, 1, 0])
    part = kernels.balanced_parts(4, src, tgt, 2, 2, weight=np.array([5.0, 5.0, 1.0, 1.0]))
    assert part[0] == part[2] and part[1] == part[3]


def test_searches_return_slices_that_miss_what_they_say(spark):
    net = networks.network(spark, "erdos_renyi", HardwareConfig(2, 8, 1, 2), n=14, p=0.3)
    edges, sizes = runner.together([net])
    for method in ("slice_chain", "blocks_on_given", "drawn_on_given", "joint_chain", "spectral_padded"):
        found = searches.searched(edges, sizes, method, net.hw, most_steps=1000).persist()
        first = found.first()
        hw = HardwareConfig(first.r, first.n, first.l, first.f)
        scored = runner.scored(edges, sizes, found, searches.found_slices(found), hw).first()
        assert scored.m - scored.kept == first.missed
        assert checks.told(slices.violations(found, searches.found_slices(found), hw)) == "valid"
    assert searches.searched(edges, sizes, "exact", net.hw, most_steps=50).first().proved is False


# --- measures, reports, experiments ----------------------------------------------------------------------------


def test_triangles_around_a_hub(spark):
    e = spark.createDataFrame([(0, k) for k in range(1, 30)] + [(1, 2), (2, 1), (3, 4), (5, 5)], "src long, tgt long")
    assert metrics.triangles(e).first().t == 2


def test_range_counts_are_those_of_the_candidates(spark):
    placement = graph.spread(spark.range(29), HardwareConfig(2, 8, 2, 2)).where("neuron % 5 <> 2")
    wanted = spark.createDataFrame([(k, k % 4, k % 3, k % 3 + k % 6) for k in range(40)], "neuron long, core long, low long, high long")
    many = column(metrics.range_candidates(placement, wanted).groupBy("neuron").count(), "neuron", "count")
    assert column(metrics.range_counts(placement, wanted), "neuron", "candidates") == {k: many.get(k, 0) for k in range(40)}


def test_baseline_forms(spark):
    one = spark.createDataFrame([(3.0, 0.0), (3.0, 2.0)], "own double, base double")
    form = lambda m: [r.x for r in one.select(runner.METRICS[m].against(F.col("own"), F.col("base")).alias("x")).collect()]
    assert form("Inconsistencies") == [3.0, 1.0] and form("Hardware Size") == [math.inf, 1.5]
    assert form("Inconsistencies (Fraction)") == [1.0, 1.5] and form("Inconsistencies (%)") == [100.0, 1.5]


def test_experiment(spark, tmp_path):
    hw = HardwareConfig(2, 10, 1, 2)
    nets = [networks.network(spark, "feasible", hw, p=0.3), networks.network(spark, "wta", HardwareConfig(2, 6, 1, 2), n=12, p=0.9), networks.Network("empty", 5, networks.complete(spark, 2).limit(0), hw)]
    told = []
    bundle = runner.Bundle(("Inconsistencies", "Hardware Size", "Log-Likelihood"), "random")
    long, seconds = runner.bundle_of_tasks([(nets, ["truth", "greedy", "three_step_recursive"], bundle)], [lambda df: told.append(df.count())])
    rows = {(r.mapper, r.input_id, r.metric): r for r in long.collect()}
    assert seconds > 0 and told == [len(rows)] == [3 * 3 * 3 + 2 * 3]
    assert rows["truth", nets[0].id, "Inconsistencies"].raw == 0 and rows["truth", nets[0].id, "Inconsistencies"].relative < 0
    assert rows["truth", "WTA_12n_p0.9", "Inconsistencies"].relative == 0  # no truth is known: the random placement stands in
    assert rows["greedy", nets[0].id, "Log-Likelihood"].relative <= 0
    assert rows["greedy", "empty", "Inconsistencies"].raw == 0 and rows["greedy", nets[0].id, runner.TIME].raw > 0
    assert reports.mean_times(long.withColumnRenamed("raw", "value")).count() == 2
    folder = results.run_folder(spark, f"file://{tmp_path}")
    assert folder.endswith("run_001") and results.run_folder(spark, f"file://{tmp_path}").endswith("run_002")
    flat = long.select("mapper", "input_id", "metric", F.col("raw").alias("value"))
    back = results.read_evaluation(spark, results.write_csv(flat, folder, "evaluation"))
    assert sorted(map(str, back.collect())) == sorted(map(str, flat.collect()))
    kinds = spark.createDataFrame([(n.id, n.descriptions.get("graph_type", "none")) for n in nets], "input_id string, graph_type string")
    lines = spark.read.text(results.dump_text(reports.report_lines(flat, kinds), folder, "report")).count()
    assert lines == 9 and runner.summary(long, nets).where("size(raw_metrics) >= 3").count() == 9
    unmet = runner.evaluated(nets[:1], "greedy", runner.Bundle(("Inconsistencies",), None), hook=lambda f: told.append(checks.told(f)))
    assert told[-1] == "valid" and unmet.where("metric = 'Inconsistencies'").first().relative == reports.MISSING
    with pytest.raises(ValueError):
        runner.mapped_by("nothing", nets[:1], hw)


def test_more_columns_than_a_table_may_have_are_an_error(spark):
    from tessera.operators import reports

    long = spark.range(1001).select(F.lit("m").alias("mapper"), F.lit("n").alias("input_id"), F.concat(F.lit("x"), "id").alias("metric"), F.lit(1.0).alias("value"))
    with pytest.raises(ValueError, match="more than 1000"):
        reports.metric_names(long)
    assert len(reports.metric_names(long.limit(1000))) == 1000
    with pytest.raises(ValueError, match="more than 1000"):
        reports.bars(long.withColumn("mapper", F.col("metric")))


def test_a_mapper_runs_once_a_network_and_failures_are_rows(spark, tmp_path, monkeypatch):
    hw = HardwareConfig(2, 6, 1, 2)
    nets = [networks.Network(f"net{k}", n, networks.complete(spark, n), hw) for k, n in enumerate((5, 8, 12))]
    calls = str(tmp_path)

    def counted(n, src, tgt, hw, seed):
        import tempfile

        tempfile.mkstemp(dir=calls)
        if n == 8:
            raise RuntimeError("eight is too many")
        return [k // hw.n for k in range(n)], [k % hw.n for k in range(n)]

    monkeypatch.setitem(runner.METHODS, "counted", counted)
    long = runner.run(nets, ["counted"], runner.Bundle(("Inconsistencies", "Hardware Size"), None))
    rows = {(r.input_id, r.metric): r for r in long.collect()}
    assert rows["net1", None].error == "eight is too many" and rows["net2", "Hardware Size"].error is None
    assert rows["net0", "Inconsistencies"].raw == 0 and rows["net0", runner.TIME].raw >= 0 and len(rows) == 7
    summary = {r.input_id: r for r in runner.summary(long, nets).collect()}
    assert summary["net0"].error is None and summary["net1"].error == "eight is too many"
    long.count()
    assert len(list(tmp_path.iterdir())) == 3
