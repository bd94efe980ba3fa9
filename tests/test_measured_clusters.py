"""Agreement of cores with the ground truth in experiments, and mappers whose work is frames."""

import math
import random

import pytest

from tessera.hw import HardwareConfig
from tessera.operators import kernels, metrics
from tessera.plans import runner
from tessera.sources import networks


def rand(a, b):
    """All pairs of places, counted one by one."""
    n, x, s, t = len(a), 0, 0, 0
    for i in range(n):
        for j in range(i):
            x, s, t = x + (a[i] == a[j] and b[i] == b[j]), s + (a[i] == a[j]), t + (b[i] == b[j])
    chance = s * t / (n * (n - 1) / 2) if n > 1 else 0
    return 1.0 if (s + t) / 2 == chance else (x - chance) / ((s + t) / 2 - chance)


def test_groups_have_their_own_index_and_matching(spark):
    rng = random.Random(6)
    sets = {"a": [(rng.randrange(3), rng.randrange(4)) for _ in range(30)], "one": [(0, 0)] * 5, "alone": [(1, 2)], "apart": [(k, 9 - k) for k in range(4)], "against": [(0, k) for k in range(4)]}
    rows = spark.createDataFrame([(g, *p) for g, own in sets.items() for p in own], "g string, truth long, predicted long")
    got = {r.g: r.ari for r in metrics.adjusted_rand_by(rows, "g").collect()}
    assert {g: round(v, 12) for g, v in got.items()} == {g: round(rand(*zip(*own)), 12) for g, own in sets.items()}
    right = {r.g: r.accuracy for r in kernels.accuracy(rows, "g").collect()}
    assert right["one"] == right["alone"] == right["apart"] == 1.0 and right["against"] == 0.25
    assert right["a"] == pytest.approx(kernels.accuracy(rows.where("g = 'a'")).first().accuracy)


def test_experiments_measure_clusters(spark):
    hw = HardwareConfig(2, 8, 2, 2)
    nets = [networks.network(spark, "feasible", hw, p=0.5), networks.network(spark, "erdos_renyi", hw, n=20, p=0.2)]
    bundle = runner.Bundle(("Inconsistencies", runner.ARI, runner.ACCURACY), "random")
    got = {(r.mapper, r.input_id, r.metric): (r.raw, r.relative) for r in runner.run(nets, ["truth", "random"], bundle).collect()}
    assert got["truth", nets[0].id, runner.ARI] == got["truth", nets[0].id, runner.ACCURACY] == (1.0, 1.0)
    assert got["random", nets[0].id, runner.ARI][0] < 0.5 and 0.25 <= got["random", nets[0].id, runner.ACCURACY][0] < 1
    assert all(math.isnan(x) for x in got["random", nets[1].id, runner.ARI]) and got["random", nets[1].id, "Inconsistencies"][0] > 0


def test_mappers_of_frames_are_run_like_others(spark):
    hw = HardwareConfig(2, 8, 2, 2)
    net = networks.network(spark, "feasible", hw, p=0.5)
    bundle = runner.Bundle(("Inconsistencies", "Hardware Size", runner.ARI), "random")
    got = {r.metric: (r.raw, r.relative) for r in runner.evaluated([net], "parts", bundle).collect()}
    assert set(got) == set(bundle.metrics) and got["Hardware Size"] == (32.0, 1.0) and got["Inconsistencies"][1] < 0
