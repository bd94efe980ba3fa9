"""Partitions and counts of whole networks against planted groups and against slices computed anew."""

import random

import pytest
from pyspark.sql import functions as F

from tessera import graph
from tessera.errors import InvalidConfigError
from tessera.hw import HardwareConfig
from tessera.operators import partition, slices
from tessera.operators.counts import SliceCounts, exchanges
from tessera.operators.partition import PartSettings


@pytest.fixture(scope="module")
def planted(spark):
    """Eight complete groups of 12 in scrambled order, few links between them."""
    rng = random.Random(1)
    order = list(range(96))
    rng.shuffle(order)
    edges = [(order[i], order[j]) for i in range(96) for j in range(96) if i != j and (i // 12 == j // 12 or rng.random() < 0.01)]
    between = sum(order.index(a) // 12 != order.index(b) // 12 for a, b in edges)
    return spark.range(96), spark.createDataFrame(edges, "src long, tgt long").cache(), between


@pytest.mark.parametrize("settings", [PartSettings(8, branches=2), PartSettings(8, tolerance=0.1), PartSettings(8, objective="connectivity")])
def test_planted_groups_are_found_in_even_parts(planted, settings):
    neurons, edges, between = planted
    labels = partition.balanced_parts(neurons, edges, settings)
    sizes = {r.part: r["count"] for r in labels.groupBy("part").count().collect()}
    assert set(sizes) == set(range(8)) and max(sizes.values()) <= int(12 * (1 + settings.tolerance)) and sum(sizes.values()) == 96
    assert partition.cut_of(labels, partition.links_of(neurons, edges)).first().cut <= 1.1 * between


def test_merges_are_mutual_and_bounded(spark):
    nodes = spark.createDataFrame([(0, 1), (1, 1), (2, 3), (3, 1), (9, 1)], "id long, size long")
    one = [(0, 1, 5), (1, 2, 9), (2, 3, 1), (0, 3, 1)]
    links = spark.createDataFrame([x for a, b, w in one for x in ((a, b, w), (b, a, w))], "a long, b long, w long")
    assert {r.id: r.up for r in partition.merged(nodes, links, 2).collect()} == {0: 0, 1: 0, 2: 2, 3: 3, 9: 9}
    assert {r.id: r.up for r in partition.merged(nodes, links, 1).collect()} == {k: k for k in (0, 1, 2, 3, 9)}


def test_rounds_never_lessen_what_is_kept(spark):
    rng = random.Random(7)
    neurons, edges = spark.range(60), spark.createDataFrame(sorted({(rng.randrange(60), rng.randrange(70)) for _ in range(300)}), "src long, tgt long")
    links = partition.links_of(neurons, edges)
    cuts = [partition.cut_of(partition.balanced_parts(neurons, edges, PartSettings(4, rounds=k)), links).first().cut for k in (0, 2)]
    assert cuts[1] <= cuts[0]
    again = [sorted(map(tuple, partition.balanced_parts(neurons, edges, PartSettings(4, rounds=0)).collect())) for _ in range(2)]
    assert again[0] == again[1]


def test_networks_without_links_or_neurons(spark):
    none = spark.createDataFrame([], "src long, tgt long")
    labels = partition.balanced_parts(spark.range(10), none, PartSettings(4))
    assert sorted(r["count"] for r in labels.groupBy("part").count().collect()) == [2, 2, 3, 3]
    assert partition.balanced_parts(spark.range(0), none, PartSettings(4)).count() == 0
    with pytest.raises(ValueError, match="empty"):
        partition.balanced_parts(spark.range(2), none, PartSettings(4, strict=True))
    for bad in ({"parts": 0}, {"parts": 6, "branches": 4}, {"parts": 2, "tolerance": -1}, {"parts": 2, "objective": "x"}):
        with pytest.raises(InvalidConfigError):
            PartSettings(**bad)


def test_counts_follow_changes_and_undo(spark):
    rng = random.Random(3)
    hw, neurons = HardwareConfig(2, 8, 3, 2), spark.range(50)
    edges = spark.createDataFrame(sorted({(rng.randrange(50), rng.randrange(50)) for _ in range(400)}), "src long, tgt long").cache()
    counts = SliceCounts(neurons, edges, graph.random_placement(neurons, hw), hw, compact=2)

    def agree():
        placed = slices.placed_edges(edges, counts.placement(), hw)
        assert sorted(map(tuple, counts.slices().collect())) == sorted(map(tuple, slices.optimal_slices(neurons, placed, hw).collect()))
        assert counts.kept == slices.best_counts(placed, hw).first().valid_edges

    before = counts.kept
    agree()
    for k in range(4):
        a = rng.sample(range(50), 6)
        pairs = spark.createDataFrame(list(zip(a[:3], a[3:])), "a long, b long")
        was, held = counts.kept, sorted(map(tuple, counts.placement().collect()))
        assert counts.kept - was == 0 and counts.apply(exchanges(counts.placement(), pairs)) == counts.kept - was
        if k == 2:
            assert counts.undo() and counts.kept == was and sorted(map(tuple, counts.placement().collect())) == held
    assert len(counts.log) <= 2
    agree()
    used = {(r.core, r.local) for r in counts.placement().collect()}
    free = next((c, x) for c in range(hw.cores) for x in range(hw.n) if (c, x) not in used)
    counts.apply(spark.createDataFrame([(7, *free)], "neuron long, core long, local long"))
    agree()
    touched = spark.createDataFrame([(7,)], "tgt long")
    plan = counts.of(touched)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "at#" in plan.split("PartitionFilters: [")[1].split("]")[0]
    while counts.undo():
        pass
    assert before >= 0 and not counts.log


def test_addresses_are_those_of_the_singular_vectors(spark):
    import numpy as np

    from tessera.operators import kernels
    from tessera.operators.addresses import principal_addresses

    rng = random.Random(2)
    edges = sorted({(rng.randrange(40), rng.randrange(40)) for _ in range(300)})
    edges = [x for x in edges if x[0] != x[1] and x[1] not in (3, 37, 38)]
    edges += [(s, 3) for s, t in edges if t == 1]  # two equal rows; 37 and 38 have no sources, and 39 is alone
    core = np.array([k % 3 if k < 36 else 3 if k < 39 else 4 for k in range(40)])
    want = kernels.pca_addresses(40, *np.array(edges).T, core)
    cores = spark.createDataFrame([(k, int(c)) for k, c in enumerate(core)], "neuron long, core long")
    got = {r.neuron: (r.local, r.settled) for r in principal_addresses(cores, spark.createDataFrame(edges, "src long, tgt long"), restarts=1).collect()}
    assert all(s for _, s in got.values()) and [got[k][0] for k in range(40)] == want.tolist()


@pytest.mark.parametrize("worth, into_base", [(1, False), (10**9, True)])
def test_a_merged_log_costs_what_was_changed(spark, monkeypatch, worth, into_base):
    from tessera.operators import counts as module

    monkeypatch.setattr(module, "WORTH", worth)
    rng = random.Random(9)
    hw, neurons = HardwareConfig(2, 8, 3, 2), spark.range(60)
    edges = spark.createDataFrame(sorted({(rng.randrange(60), rng.randrange(60)) for _ in range(300)}), "src long, tgt long").cache()
    counts = SliceCounts(neurons, edges, graph.spread(neurons, hw), hw, compact=2)
    base = counts.base
    for k in range(3):
        counts.apply(exchanges(counts.placement(), spark.createDataFrame([(k, 59 - k)], "a long, b long")))
    assert (counts.base is not base, counts.merged is None) == (into_base, into_base) and len(counts.log) == 1
    assert counts.undo()
    placed = slices.placed_edges(edges, counts.placement(), hw)
    assert sorted(map(tuple, counts.slices().collect())) == sorted(map(tuple, slices.optimal_slices(neurons, placed, hw).collect()))
    assert counts.kept == slices.best_counts(placed, hw).first().valid_edges
