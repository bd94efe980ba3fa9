"""Links in many cells against all of them in Python; a step moves no link and sends no table of nodes through the driver."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tessera.operators import link_cells, partition
from tessera.operators.link_cells import LinkCells
from tessera.operators.net_cells import NetCells
from tessera.tables import Steps


def rows_of(cells):
    run = lambda cell, own, a, b, w: [own["id"][a], own["id"][b], w]
    return cells.met(rows_of.nodes, run, "a long, b long, w long").collect()


@pytest.fixture(scope="module")
def network(spark):
    rng = random.Random(5)
    ids = [k * (10**11 if k % 7 == 0 else 1) - 20 for k in range(60)]
    pairs = [(rng.choice(ids), rng.choice([*ids, 77777])) for _ in range(700)]
    want = Counter((min(p), max(p)) for p in pairs if p[0] != p[1] and 77777 not in p)
    nodes = spark.createDataFrame([(k,) for k in ids], "id long").cache()
    before = link_cells.CELL, link_cells.SLAB
    link_cells.CELL, link_cells.SLAB = 100, 16
    cells = LinkCells.of_edges(nodes, spark.createDataFrame(pairs, "src long, tgt long"), Steps(spark))
    yield spark, nodes, ids, want, cells
    link_cells.CELL, link_cells.SLAB = before


def test_cells_hold_every_link_once_and_merge(network):
    spark, nodes, ids, want, cells = network
    assert cells.g > 3
    rows_of.nodes = nodes
    assert sorted(map(tuple, rows_of(cells))) == sorted((a, b, w) for (a, b), w in want.items())
    up = {k: min(k, ids[j - j % 3]) for j, k in enumerate(ids)}
    made = Counter()
    for (a, b), w in want.items():
        if up[a] != up[b]:
            made[min(up[a], up[b]), max(up[a], up[b])] += w
    after = cells.merged(spark.createDataFrame(list(up.items()), "id long, up long"), Steps(spark))
    rows_of.nodes = nodes
    assert sorted(map(tuple, rows_of(after))) == sorted((a, b, w) for (a, b), w in made.items())


def test_answers_are_those_of_all_links(network):
    spark, nodes, ids, want, cells = network
    size = {k: 1 + j % 4 for j, k in enumerate(ids)}
    both = {**want, **{(b, a): w for (a, b), w in want.items()}}
    fit = {p: w / (size[p[0]] * size[p[1]]) for p, w in both.items() if size[p[0]] + size[p[1]] <= 6}
    top = {a: max(r for (x, _), r in fit.items() if x == a) for a, _ in fit}
    got = {r.a: r.b for r in cells.heaviest(spark.createDataFrame(list(size.items()), "id long, size long"), 6, 42).collect()}
    assert set(got) == set(top) and all(fit[a, b] == top[a] for a, b in got.items())
    part = {k: j % 16 for j, k in enumerate(ids)}
    labels = spark.createDataFrame(list(part.items()), "id long, part int")
    for width, branches in ((4, 4), (1, 4), (1, 16)):
        own = Counter()
        for (a, b), w in both.items():
            if part[a] // width // branches == part[b] // width // branches:
                own[a, part[a], part[b] // width] += w
        assert {tuple(r)[:3]: r.w for r in cells.among_siblings(labels, width, branches).collect()} == own
    assert cells.cut(labels).first().cut == sum(w for (a, b), w in want.items() if part[a] != part[b])


def test_a_step_moves_no_link(network):
    spark, nodes, _, _, cells = network
    plan = cells.cut(nodes.withColumn("part", F.col("id") % 3))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan.split("FlatMapCoGroupsInArrow")[1].split("Sort [")[1]


def test_tables_of_nodes_are_not_broadcast(network):
    spark, nodes, _, _, cells = network
    plan = partition.merged(nodes.select("id", F.lit(1).cast("long").alias("size")), cells, 4)._jdf.queryExecution().executedPlan().toString()
    wishes = spark.createDataFrame([(1, 0, 0, 1, 2, 1), (2, 1, 1, 1, 0, 1)], "id long, part long, p long, own long, to long, gain long")
    moved, _ = partition.changes(wishes, partition.PartSettings(4), 0)
    pairs = moved._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and "SortMergeJoin" in plan and "SortMergeJoin [x" in pairs


def test_votes_and_degrees_are_those_of_all_links(network):
    spark, nodes, ids, want, cells = network
    core = {k: j % 5 - 1 if j % 2 else -1 for j, k in enumerate(ids)}
    votes, degree = Counter(), Counter()
    for (a, b), w in want.items():
        for x, y in ((a, b), (b, a)):
            degree[x] += w
            if core[x] < 0 <= core[y]:
                votes[x, core[y]] += w
    labels = spark.createDataFrame(list(core.items()), "id long, part long")
    assert {(r.id, r.part): r.w for r in cells.votes(labels, 4).collect()} == votes
    assert {r.id: r.w for r in cells.degrees(nodes).collect()} == degree


def test_nodes_are_sent_packed_and_merged_links_are_not_shuffled_by_rows(network):
    spark, nodes, ids, want, cells = network
    sent = cells._sent(nodes)
    assert sent.count() == cells.g**2 and dict(sent.dtypes)["id"] == "binary"
    assert not cells.merged(nodes.withColumn("up", F.col("id")), Steps(spark)).once


@pytest.mark.parametrize("known", [False, True])
def test_nets_in_cells_are_those_of_all_pins(network, known):
    spark, nodes, ids, _, _ = network
    rng = random.Random(6)
    pins = [(rng.choice([*ids, 99999]), rng.choice([*ids, 77777])) for _ in range(600)]
    of = {}
    for net, pin in pins:
        if pin != 77777 and (net != 99999 or not known):
            of.setdefault(net, set()).add(pin)
    nets = NetCells.of(nodes, spark.createDataFrame(pins, "net long, pin long"), 600, Steps(spark), nets_known=known)
    assert nets.g > 2
    part = {k: j % 16 for j, k in enumerate(ids)}
    labels = spark.createDataFrame(list(part.items()), "id long, part int")
    assert nets.over(labels, 16).first().over == sum(len({part[p] for p in ps}) - 1 for ps in of.values())
    for width, branches in ((4, 4), (1, 4), (1, 16)):
        own = Counter()
        for ps in of.values():
            at = Counter(part[p] // width for p in ps)
            for pin in ps:
                p = part[pin] // width
                for to, k in at.items():
                    if to // branches == p // branches and (to != p or k > 1):
                        own[pin, part[pin], to] += 1
        got = {(r.id, r.part, to): w for r in nets.siblings(labels, width, branches, 16).collect() for to, w in zip(r.tos, r.ws)}
        assert got == own
