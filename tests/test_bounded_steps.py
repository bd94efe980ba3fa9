"""What a task holds and what a step sends stay bounded as tables grow."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera import graph
from tessera.operators import addresses, metrics, spectra
from tessera.sources import sparse
from tessera.tables import Steps

SF = "/root/testdata/sf0.001"


def executed(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_large_tables_are_dealt_to_more_tasks_than_the_session_has(spark, monkeypatch):
    few = sorted(map(tuple, graph.from_tables(spark, SF)[1].collect()))
    monkeypatch.setattr(graph, "TASK_ROWS", 500)
    edges = graph.from_tables(spark, SF)[1]
    assert edges.rdd.getNumPartitions() >= 12 and sorted(map(tuple, edges.collect())) == few


def test_pairs_are_not_held_twice(spark):
    edges = spark.createDataFrame([(1, 2), (2, 1), (3, 1), (3, 1), (4, 4)], "src long, tgt long")
    both = metrics.undirected(edges)
    assert sorted(map(tuple, both.collect())) == [(1, 2), (1, 3), (2, 1), (3, 1)] and "Union" not in executed(both)


@pytest.mark.parametrize("n, m", [(40, 300), (3, 6), (30, 20), (1, 0)])
def test_triangles_are_those_of_all_triples(spark, n, m):
    rng = random.Random(n)
    pairs = [(rng.randrange(n), rng.randrange(n)) for _ in range(m)] + [(0, k) for k in range(n)]
    have = {frozenset(p) for p in pairs if p[0] != p[1]}
    want = sum({frozenset(p) for p in itertools.combinations(t, 2)} <= have for t in itertools.combinations(range(n), 3))
    found = metrics.triangles(spark.createDataFrame(pairs, "src long, tgt long"))
    assert found.first().t == want


def test_wedges_are_not_rows(spark):
    plan = executed(metrics.triangles(spark.createDataFrame([(1, 2)], "src long, tgt long")).select(F.col("t")))
    assert "array_intersect" in plan and "NOT (x" not in plan


def test_spectra_of_a_matrix_in_many_cells_move_no_entry(spark, monkeypatch):
    monkeypatch.setattr(spectra, "CELL", 200)
    monkeypatch.setattr(spectra, "CHUNK", 300)
    monkeypatch.setattr(spectra, "SLAB", 50)
    rng = random.Random(4)
    pairs = sorted({(rng.randrange(60), rng.randrange(60)) for _ in range(600)})
    entries = metrics.bethe_hessian(spark.range(60), spark.createDataFrame(pairs, "src long, tgt long")).cache()
    dense = np.zeros((60, 60))
    for r in entries.collect():
        dense[r.i, r.j] = r.x
    want = np.linalg.eigvalsh(dense)
    found = spectra.lanczos(entries, steps=8, block=8)
    assert len(found.values) == 60 and np.abs(found.values - want).max() < 1e-7
    x = {r.id: np.array(r.x) for r in found.vectors([0]).collect()}
    v = np.array([x[k] for k in range(60)])[:, 0]
    assert np.abs(dense @ v - want[0] * v).max() < 1e-6
    kept = Steps(spark)
    grid = spectra.Grid(entries, entries.count(), 2, 1, kept)
    assert grid.g > 2
    plan = executed(grid.times(grid.nodes.select("chunk", F.col("y").alias("q")), 2))
    left = plan.split("FlatMapCoGroupsInArrow")[1].split("Sort [")[1]
    assert plan.count("Exchange") == 2 and "Exchange" not in left  # the vectors and the sums, not the cells


def test_a_block_draws_its_number_of_links_once(spark):
    plan = executed(sparse.erdos_renyi(spark.range(30), 30, 0.2))
    assert "filter(" not in plan and not any("md5" in line for line in plan.splitlines() if "Filter" in line)


def test_steps_of_addresses_move_no_link(spark, monkeypatch):
    monkeypatch.setattr(addresses, "CELL", 20)
    rng = random.Random(6)
    pairs = sorted({(rng.randrange(90), rng.randrange(40)) for _ in range(400)})
    rows = spark.createDataFrame([(k, k % 2 if k < 30 else 7, rng.random()) for k in range(42)], "id long, core long, x double").cache()
    cells = addresses.Cells(rows.select("id", "core"), spark.createDataFrame(pairs, "src long, id long"), Steps(spark))
    assert cells.pieces.agg(F.min("pieces")).first()[0] > 2
    dense = np.zeros((42, 90))
    for s, k in pairs:
        dense[k, s] = 1
    core, x = (np.array([r[c] for r in sorted(rows.collect())]) for c in (1, 2))
    want, sums = np.zeros(42), {}
    for c in (0, 1, 7):
        own = dense[core == c]
        sums[c] = own.T @ x[core == c]
        y = own @ sums[c]
        want[core == c] = y - y.mean()
    out = addresses.multiplied(rows, cells, "x", "z")
    assert np.abs([r.z for r in sorted(out.select("id", "z").collect())] - want).max() < 1e-9
    tops = {r.core: r for r in cells.loads(rows, "x").groupBy("core").agg(F.max(F.struct("t", "src")).alias("m")).select("core", "m.*").collect()}
    assert all(abs(tops[c].t - sums[c].max()) < 1e-9 and abs(sums[c][tops[c].src] - sums[c].max()) < 1e-9 for c in sums)
    left = executed(cells.times(rows, "x")).split("FlatMapCoGroupsInArrow")[1].split("Sort [")[1]
    assert "Exchange" not in left  # the cells
