"""Sources in the size of their result against the binomial and planted ranges; ancestors against walks up the tree."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.errors import InvalidConfigError
from tessera.operators import ancestry
from tessera.sources import draws, networks, sparse


@pytest.mark.parametrize("p", [1.0, 0.9, 0.25, 0.01])
def test_sums_are_the_binomials(p):
    w = sparse.width_of(p)
    exact, total = [], 0.0
    for k in range(w):
        total += math.comb(w, k) * p**k * (1 - p) ** (w - k)
        exact.append(total * 2**32)
    got = sparse.sums(p)
    assert all(abs(a - b) <= 2 for a, b in zip(got, exact)) and (len(got) == w or exact[len(got)] >= 2**32 - 2)


def test_links_are_different_and_as_many_as_expected(spark):
    n, p = 3000, 0.004
    edges = sparse.erdos_renyi(spark.range(n), n, p)
    rows = [tuple(r) for r in edges.collect()]
    assert len(set(rows)) == len(rows) and all(a != b and 0 <= b < n for a, b in rows)
    sigma = math.sqrt(n * n * p * (1 - p))
    assert abs(len(rows) - n * (n - 1) * p) < 5 * sigma
    last = sum(b >= n - 500 for _, b in rows)  # a block's cut end is drawn like the rest
    assert abs(last - 500 * n * p) < 5 * math.sqrt(500 * n * p)
    assert sorted(rows) == sorted(tuple(r) for r in sparse.erdos_renyi(spark.range(n).repartition(3), n, p).collect())
    assert sparse.erdos_renyi(spark.range(6), 6, 1.0).count() == 30 and sparse.erdos_renyi(spark.range(6), 6, 0.0).count() == 0
    assert sparse.erdos_renyi(spark.range(0), 0, 0.5).count() == 0
    with pytest.raises(ValueError):
        sparse.erdos_renyi(spark.range(6), 6, 1.5)


def test_clusters_and_levels_are_those_of_the_pairwise_sources(spark):
    sure = dict(neighbour=1.0, e_to_i=1.0, i_to_e=0.0)
    assert sorted(sparse.soft_wta(spark, 4, 2, 5, **sure).collect()) == sorted(networks.soft_wta(spark, 4, 2, 5, **sure).collect())
    half, n = sparse.soft_wta(spark, 20, 5, 20, neighbour=0.2, e_to_i=0.1, i_to_e=0.8), 20 * 20
    across = half.where(f"src < {n} and tgt >= {n}").count()
    assert abs(across - n * 100 * 0.1) < 5 * math.sqrt(n * 100 * 0.09)
    want = networks.block_hierarchy(spark, 4, 2, 2, 1.0)
    got = sparse.block_forest(spark.range(16), 16, 4, 2, 2, 1.0)
    level = lambda df: {r.height: r["count"] for r in df.groupBy("height").count().collect()}
    assert level(got)[0] == level(want)[0] == 48 and got.select("src", "tgt").distinct().count() == got.count()
    forest = sparse.block_forest(spark.range(2000), 2000, 16, 4, 2, 0.5)
    assert forest.where("src DIV 256 <> tgt DIV 256 or tgt >= 2000").isEmpty() and forest.where("height = 1 and (src DIV 16 = tgt DIV 16 or src DIV 64 <> tgt DIV 64)").isEmpty()
    whole = 1792 * 192 * 0.125  # of the full trees
    assert abs(forest.where("height = 2 and src < 1792").count() - whole) < 5 * math.sqrt(whole)


@pytest.mark.parametrize("p", [1.0, 0.25, 0.003])
def test_a_batch_draws_what_each_name_draws(p):
    """Signs, changing lengths and messages longer than a block of md5, against hashlib a name."""
    rng, w, bounds = np.random.default_rng(1), sparse.width_of(p), sparse.sums(p)
    own = [rng.choice(c, 400) for c in ([-5, 0, 9, 10, 7199999, 10**12, -(10**17)], [0, 1], [0, 10**9 - 1, 10**9, 10**17], [9, 10, 11])]
    rows, x = draws.places(7, own, w, np.array(bounds))
    number = lambda *name: int(hashlib.md5(":".join(map(str, (7, *name))).encode()).hexdigest()[:8], 16)
    want = []
    for row, name in enumerate(zip(*own)):
        k, had = sum(s <= number(*name) for s in bounds), []
        for j in range(w - k, w):
            d = number(*name, j) % (j + 1)
            had.append(j if d in had else d)
        want += [(row, d) for d in had]
    assert sorted(zip(rows.tolist(), x.tolist())) == sorted(want)


def test_links_are_drawn_in_batches(spark):
    plan = sparse.erdos_renyi(spark.range(30), 30, 0.2)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "md5(" not in plan and "aggregate(" not in plan


def walk(parents, c):
    out = [c]
    while parents[out[-1]] >= 0:
        out.append(parents[out[-1]])
    return out


def test_ancestors_agree_with_walks(spark):
    rng = random.Random(4)
    parents = {0: -1, 1: -1, **{c: rng.randrange(max(0, c - 4), c) for c in range(2, 60)}}
    tree = spark.createDataFrame(list(parents.items()), "cluster long, parent long")
    pairs = [(rng.randrange(60), rng.randrange(60)) for _ in range(200)] + [(5, 5), (0, 1), (0, 0), (3, 999)]
    got = {(r.a, r.b): (r.at, r.up_a, r.up_b) for r in ancestry.meeting(spark.createDataFrame(pairs + pairs[:9], "a long, b long"), tree).collect()}
    want = {}
    for a, b in set(pairs) - {(3, 999)}:
        up, of = walk(parents, a), walk(parents, b)
        at = next((c for c in up if c in of), None)
        want[a, b] = (at, None, None) if at is None else (at, up.index(at), of.index(at))
    assert got == want
    labels = spark.createDataFrame([(k, rng.randrange(60)) for k in range(300)], "neuron long, cluster long")
    rows = sorted((c, r.neuron) for r in labels.collect() for c in walk(parents, r.cluster))
    assert sorted(map(tuple, ancestry.members(tree, labels).collect())) == rows
    held = {r.cluster: r.k for r in ancestry.totals(tree, labels.withColumn("k", F.lit(1)), "k").collect()}
    assert held == {c: sum(x == c for x, _ in rows) for c in parents}


def test_odd_trees(spark):
    one = spark.createDataFrame([(7, -1)], "cluster long, parent long")
    assert [tuple(r) for r in ancestry.meeting(one.select(F.col("cluster").alias("a"), F.col("cluster").alias("b")), one).collect()] == [(7, 7, 7, 0, 0)]
    none = one.limit(0)
    assert ancestry.meeting(spark.createDataFrame([(1, 2)], "a long, b long"), none).count() == 0
    with pytest.raises(InvalidConfigError):
        ancestry.jumps(spark.createDataFrame([(1, 2), (2, 1)], "cluster long, parent long"))
    with pytest.raises(InvalidConfigError):
        ancestry.jumps(spark.createDataFrame([(1, 2)], "cluster long, parent long"))
