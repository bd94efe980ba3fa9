"""Greedy placement in rounds: valid, the same on reruns, better than chance, whole where links are few."""

import random

import pytest

from tessera import graph
from tessera.hw import HardwareConfig
from tessera.operators import frontier, slices


def misses(edges, placement, hw):
    row = slices.best_counts(slices.placed_edges(edges, placement, hw), hw).first()
    return row.m - row.valid_edges


def test_placement_is_whole_valid_and_better_than_chance(spark):
    rng = random.Random(8)
    order = list(range(64))
    rng.shuffle(order)
    links = [(order[i], order[j]) for i in range(60) for j in range(60) if i != j and rng.random() < (0.7 if i // 8 == j // 8 else 0.03)]
    hw, neurons, edges = HardwareConfig(2, 8, 3, 2), spark.range(64), spark.createDataFrame(links + [(3, 3), (5, 900)], "src long, tgt long").cache()
    rows = sorted(map(tuple, frontier.greedy_placement(neurons, edges, hw).collect()))
    assert [r[0] for r in rows] == list(range(64)) and len({r[1:] for r in rows}) == 64
    assert all(0 <= c < hw.cores and 0 <= x < hw.n for _, c, x in rows)
    again = frontier.greedy_placement(neurons.repartition(5), edges.repartition(3), hw)
    assert sorted(map(tuple, again.collect())) == rows
    placed = spark.createDataFrame(rows, "neuron long, core long, local long")
    assert misses(edges, placed, hw) < min(misses(edges, graph.random_placement(neurons, hw), hw), misses(edges, graph.spread(neurons, hw), hw))


def test_networks_without_links_too_many_neurons_or_none(spark):
    none, hw = spark.createDataFrame([], "src long, tgt long"), HardwareConfig(2, 3, 1, 2)
    rows = frontier.greedy_placement(spark.range(5).union(spark.range(2)), none, hw).collect()
    assert sorted(r.neuron for r in rows) == list(range(5)) and len({(r.core, r.local) for r in rows}) == 5
    assert frontier.greedy_cores(spark.range(0), none, hw).count() == 0
    with pytest.raises(ValueError):
        frontier.greedy_cores(spark.range(7), none, hw)


def test_placements_scored_together_are_those_scored_alone(spark):
    rng = random.Random(4)
    hw, neurons = HardwareConfig(2, 8, 3, 2), spark.range(60)
    edges = spark.createDataFrame(sorted({(rng.randrange(60), rng.randrange(62)) for _ in range(400)}), "src long, tgt long").cache()
    few = graph.random_placement(neurons, hw).where("neuron % 7 <> 0")  # a placement may lack neurons that another has
    all_ = {"spread": graph.spread(neurons, hw), "few": few, "none": few.limit(0)}
    row = slices.best_counts_each(edges, all_, hw).first()
    for name, placement in all_.items():
        alone = slices.best_counts(slices.placed_edges(edges, placement, hw), hw).first()
        assert (row[f"m_{name}"], row[f"valid_{name}"]) == (alone.m, alone.valid_edges)
    plan = slices.best_counts_each(edges, all_, hw)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ReusedExchange") or plan.count("Exchange hashpartitioning(tgt") == 1
