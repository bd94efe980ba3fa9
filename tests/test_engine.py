"""Golden values for hardware, slices, placements, kernels; every catalog query against DuckDB on the smallest tables."""

import math
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera import graph
from tessera.errors import InvalidConfigError
from tessera.hw import HardwareConfig, log_star
from tessera.operators import kernels, slices
from tessera.sources import results

DATA = "/root/testdata/sf0.001"


def value(spark, sql):
    return spark.range(1).select(F.expr(sql).alias("x")).first().x


def test_hardware_sizes_and_rejections():
    hw = HardwareConfig(2, 8, 2, 2)
    assert (hw.cores, hw.slots, hw.max_distance) == (4, 32, 2) and [hw.slices_at(d) for d in range(3)] == [1, 2, 4]
    for bad in ((2, 4, 2, 8), (0, 4, 2, 2), (2, 4, -1, 2)):
        with pytest.raises(InvalidConfigError):
            HardwareConfig(*bad)


@pytest.mark.parametrize("a,b,d", [(0, 0, 0), (0, 1, 1), (2, 3, 1), (0, 2, 2), (3, 0, 2)])
def test_distances(spark, a, b, d):
    assert value(spark, HardwareConfig(2, 8, 2, 2).distance_sql(str(a), str(b))) == d


def test_slices_cover_and_hold_their_addresses(spark):
    for n, f in ((8, 2), (15, 2), (7, 3)):
        hw = HardwareConfig(2, n, 2, f)
        for d in range(3):
            at = 0
            for k in range(hw.slices_at(d)):
                lo, hi = value(spark, hw.low_sql(str(d), str(k))), value(spark, hw.high_sql(str(d), str(k)))
                assert lo == at and hi > lo
                at = hi
            assert at == n
        grid = spark.range(n).crossJoin(spark.range(1, 3).withColumnRenamed("id", "d")).select(F.col("id"), "d", hw.slice_of("d", "id").alias("k"))
        held = grid.select(F.expr(f"id >= {hw.low_sql('d', 'k')} AND id < {hw.high_sql('d', 'k')}").alias("ok"))
        assert held.where("not ok").count() == 0


CASES = [
    (1, [0, 1, 1, 1, 1], [(1, 0), (2, 0)], [0, 0, 1, 2, 3], {1: 0}),
    (1, [0, 1, 1, 1, 1], [(3, 0), (4, 0)], [0, 0, 1, 2, 3], {1: 1}),
    (2, [0, 1, 2], [(1, 0), (2, 0)], [0, 3, 2], {1: 1, 2: 2}),
    (1, [0, 1], [], [0, 0], {1: 0}),
]


@pytest.mark.parametrize("levels,cores,edges,local,want", CASES)
def test_optimal_slices(spark, levels, cores, edges, local, want):
    hw = HardwareConfig(2, 4, levels, 2)
    neurons = spark.range(len(cores))
    placement = spark.createDataFrame([(i, c, x) for i, (c, x) in enumerate(zip(cores, local))], "neuron long, core long, local long")
    placed = slices.placed_edges(spark.createDataFrame(edges, "src long, tgt long"), placement, hw)
    got = {r.distance: r.slice for r in slices.optimal_slices(neurons, placed, hw).where("neuron = 0").collect()}
    assert got == want


def test_violations_are_counted(spark):
    hw = HardwareConfig(2, 2, 1, 2)
    bad = spark.createDataFrame([(0, 0, 0), (1, 0, 0), (2, 0, 1), (3, 5, 0), (4, 1, -1)], "neuron long, core long, local long")
    s = spark.createDataFrame([(0, 1, 2), (1, 1, 1)], "neuron long, distance int, slice long")
    got = {r.rule: r.violations for r in slices.violations(bad, s, hw).collect()}
    assert got == {"core out of range": 1, "local out of range": 1, "core over capacity": 1, "slot shared": 1, "slice out of range": 1}


@pytest.mark.parametrize("clusters,want", [([0, 0, 1, 1], [0, 0, 1, 1]), ([0, 0, 0, 1], [0, 0, 1, 1]), ([1, 1, 0, 0], [1, 1, 0, 0])])
def test_fill(spark, clusters, want):
    labels = spark.createDataFrame(list(enumerate(clusters)), "neuron long, cluster long")
    got = {r.neuron: r.core for r in graph.fill(labels, HardwareConfig(2, 2, 1, 2)).collect()}
    assert [got[i] for i in range(4)] == want


def test_random_placement_uses_each_slot_once(spark):
    hw = HardwareConfig(2, 8, 2, 2)
    got = graph.random_placement(spark.range(30), hw).collect()
    assert len({(r.core, r.local) for r in got}) == 30 and all(0 <= r.core < 4 and 0 <= r.local < 8 for r in got)


def test_incremental_counts_equal_full_ones_and_undo():
    rng, hw = random.Random(1), HardwareConfig(2, 8, 2, 2)
    src, tgt = map(np.array, zip(*{(rng.randrange(16), rng.randrange(16)) for _ in range(50)}))
    keep = src != tgt
    src, tgt = src[keep], tgt[keep]
    slots = rng.sample(range(32), 16)
    core, local = np.array(slots) // 8, np.array(slots) % 8
    state = kernels.SliceCounts(16, src, tgt, core, local, hw)
    for _ in range(40):
        i, j = rng.sample(range(16), 2)
        before = (state.counts.copy(), state.energy)
        a, b = (state.core[i], state.local[i]), (state.core[j], state.local[j])
        state.place([(i, *b), (j, *a)])
        full = kernels.SliceCounts(16, src, tgt, state.core, state.local, hw)
        assert (full.counts == state.counts).all() and full.energy == state.energy
        if rng.random() < 0.5:
            state.place([(i, *a), (j, *b)])
            assert (state.counts == before[0]).all() and state.energy == before[1]


@pytest.mark.parametrize("method", kernels.METHODS)
def test_mappers_hold_the_hardware_rules(spark, method):
    hw = HardwareConfig(2, 8, 1, 2)
    halves = [(i, j) for i in range(16) for j in range(16) if i != j and i // 8 == j // 8]
    edges = spark.createDataFrame([("two", *e) for e in halves], "graph_id string, src long, tgt long")
    got = kernels.mapped(edges, spark.createDataFrame([("two", 16)], "graph_id string, n long"), hw, method).collect()
    assert len({(r.core, r.local) for r in got}) == 16 and all(0 <= r.core < 2 and 0 <= r.local < 8 for r in got)
    if method != "anneal":
        assert len({r.core for r in got if r.neuron < 8}) == 1 and len({r.core for r in got}) == 2


def test_assignment_is_optimal():
    from itertools import permutations

    rng = np.random.default_rng(2)
    for _ in range(30):
        cost = rng.integers(0, 20, (4, 5)).astype(float)
        got = kernels.assignment(cost)
        assert len(set(got)) == 4
        assert cost[np.arange(4), got].sum() == min(sum(cost[i, p[i]] for i in range(4)) for p in permutations(range(5), 4))


def test_pca_addresses_are_permutations():
    core = np.array([0, 0, 0, 0, 2, 2, 1])
    local = kernels.pca_addresses(7, np.array([4, 4, 5]), np.array([0, 1, 2]), core)
    assert sorted(local[:4]) == [0, 1, 2, 3] and sorted(local[4:6]) == [0, 1] and local[6] == 0
    same = kernels.pca_addresses(4, np.array([], dtype=int), np.array([], dtype=int), np.zeros(4, dtype=int))
    assert same.tolist() == [0, 1, 2, 3]


def test_log_star():
    assert log_star(0) == 0 and abs(log_star(1) - math.log(2.865064)) < 1e-12


def test_summary_round_trip(spark, tmp_path):
    rows = [("Greedy", "ER", {"a": "x,\"y\""}, {"Valid Edges": 3.0}, None), ("SA", "ER", {}, {"Valid Edges": 4.5}, "failed")]
    df = spark.createDataFrame(rows, "mapper string, input_id string, metadata map<string,string>, metrics map<string,double>, error string")
    back = results.read_summary(spark, results.write_summary(df, f"{tmp_path}/s"))
    assert sorted(map(tuple, back.collect()), key=str) == sorted(rows, key=str)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")
def test_queries_equal_their_sql(spark):
    import duckdb

    import __spark_entry__ as entry

    con = duckdb.connect()
    for t in os.listdir(DATA):
        con.sql(f"create view {t.removesuffix('.parquet')} as select * from '{DATA}/{t}'")

    def plain(df):
        cols = sorted(df.columns)
        cell = lambda x: None if x is None or x != x else round(float(x), 6) if isinstance(x, (int, float, np.number)) else str(x)
        return cols, sorted((tuple(map(cell, r)) for r in df[cols].astype(object).values.tolist()), key=str)

    sql = entry.oracle_sql()
    for name, query in entry.queries().items():
        if name in sql and not name.startswith("op"):
            assert plain(query(spark, DATA).toPandas()) == plain(con.sql(sql[name]).df()), name
    assert entry.entry(spark).count() == 1
