"""Spectra and clusters of whole networks against numpy and planted groups."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import metrics, spectra
from tessera.tables import Steps


def drawn(spark, n, p, groups=1, seed=1):
    rng = random.Random(seed)
    edges = [(a, b) for a in range(n) for b in range(n) if a != b and rng.random() < (p if a % groups == b % groups else p / 20)]
    return spark.range(n), spark.createDataFrame(edges, "src long, tgt long").cache()


def dense(entries, n):
    m = np.zeros((n, n))
    for r in entries.collect():
        m[r.i, r.j] = r[2]
    return m


def test_all_values_of_200_nodes_where_the_steps_fill_the_space(spark):
    neurons, edges = drawn(spark, 200, 0.12)
    entries = metrics.bethe_hessian(neurons, edges)
    want = np.linalg.eigvalsh(dense(entries, 200))
    got = spectra.lanczos(entries, steps=10, block=20)
    assert len(got.values) == 200 and np.abs(got.values - want).max() < 1e-6
    assert got.negative() == (int((want < 0).sum()), True)


def test_negative_values_of_200_nodes_from_few_steps(spark):
    neurons, edges = drawn(spark, 200, 0.4, 4)
    entries = metrics.bethe_hessian(neurons, edges)
    want = np.linalg.eigvalsh(dense(entries, 200))
    got = spectra.lanczos(entries, steps=12)
    below = int((want < 0).sum())
    assert got.negative() == (below, True) and below == 4
    assert np.abs(got.values[:below] - want[:below]).max() < 1e-6
    assert all(np.abs(want - v).min() <= e + 1e-7 for v, e in zip(got.values, got.errors))


def test_small_spaces_end_early_and_equal_values_are_found(spark):
    """Three complete groups of 5: each value of the walk occurs three times at least, so a block of four sees the first three."""
    neurons = spark.range(15)
    edges = spark.createDataFrame([(a, b) for a in range(15) for b in range(15) if a != b and a % 3 == b % 3], "src long, tgt long")
    found, vectors = spectra.leading_vectors(neurons, edges, 3)
    assert np.abs(found.values[-3:] - 1).max() < 1e-9 and len(found.values) <= 8 and found.settled().all()
    x = {r.id: np.array(r.x) for r in vectors.collect()}
    m = np.array([x[k] for k in range(15)])
    assert np.abs(m.T @ m - np.eye(3)).max() < 1e-9
    assert all(np.abs(x[k] - x[k % 3]).max() < 1e-9 for k in range(15))


def test_planted_groups_are_clusters(spark):
    neurons, edges = drawn(spark, 90, 0.5, 3)
    found, labels = spectra.bethe_hessian_clusters(neurons, edges, steps=10)
    assert found.negative() == (3, True)
    own = {r.neuron: r.cluster for r in labels.collect()}
    assert len(own) == 90 and len({(k % 3, c) for k, c in own.items()}) == 3
    again = {r.neuron: r.cluster for r in spectra.bethe_hessian_clusters(neurons, edges, steps=10)[1].collect()}
    assert again == own


def test_networks_without_links_or_nodes(spark):
    none = spark.createDataFrame([], "src long, tgt long")
    found, labels = spectra.bethe_hessian_clusters(spark.range(4), none)
    assert found.negative()[0] == 4  # of -I
    assert labels.count() == 4
    found, labels = spectra.bethe_hessian_clusters(spark.range(0), none)
    assert len(found.values) == 0 and labels.count() == 0
    points = spark.createDataFrame([(k, [1.0]) for k in range(5)], "id long, x array<double>")
    assert {r.cluster for r in spectra.k_means(points, 3).collect()} == {0}


@pytest.mark.parametrize("kinds", [5, 10**6])
def test_a_cell_is_packed_slab_by_slab(spark, monkeypatch, kinds):
    """One cell, but no task that packs holds more than about a slab of it, and an entry takes few bytes where values repeat."""
    monkeypatch.setattr(spectra, "CHUNK", 200)
    monkeypatch.setattr(spectra, "SLAB", 400)
    rng = random.Random(3)
    pairs = {(min(p), max(p)): rng.randrange(kinds) / 7 for p in ((rng.randrange(90), rng.randrange(90)) for _ in range(1200))} | {(k, k): 1.0 for k in range(90)}
    rows = [(i * 10, j * 10, x) for (i, j), x in pairs.items()] + [(j * 10, i * 10, x) for (i, j), x in pairs.items() if i != j]
    want = np.zeros((90, 90))
    for i, j, x in rows:
        want[i // 10, j // 10] = x
    kept = Steps(spark)
    grid = spectra.Grid(spark.createDataFrame(rows, "i long, j long, x double"), len(rows), 2, 1, kept)
    cells = grid.cells.collect()
    held = [int(np.frombuffer(r.counts, dtype=np.int32).sum()) for r in cells]
    assert grid.g == 1 and len(held) > 3 and sum(held) == len(rows) and max(held) < 2 * 400
    bytes_of = sum(len(r.j) + len(r.codes) + len(r["values"]) for r in cells)
    assert kinds > 5 or bytes_of < 6 * len(rows)
    own = {r.chunk: np.frombuffer(r.ids, dtype=np.int64) // 10 for r in grid.nodes.collect()}
    y, got = np.zeros((90, 2)), np.zeros((90, 2))
    for r in grid.nodes.collect():
        y[own[r.chunk]] = np.frombuffer(r.y).reshape(-1, 2)
    for r in grid.times(grid.nodes.select("chunk", F.col("y").alias("q")), 2).collect():
        got[own[r.chunk]] = np.frombuffer(r.y).reshape(-1, 2)
    assert np.abs(got - want @ y).max() < 1e-9 * max(1.0, np.abs(want).max())
    kept.drop()
