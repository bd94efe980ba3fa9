"""Spectral clusterers, searches and estimators: brute force, planted networks, properties that every answer has."""

from itertools import permutations

import numpy as np
import pytest

from tessera.hw import HardwareConfig
from tessera.operators import estimators, kernels, searches, spectral


def network(n, p, seed):
    rng = np.random.default_rng(seed)
    a = rng.random((n, n)) < p
    np.fill_diagonal(a, 0)
    return np.nonzero(a)


@pytest.mark.parametrize("seed", range(4))
def test_exact_equals_all_placements(seed):
    hw, (src, tgt) = HardwareConfig(2, 2, 1, 2), network(4, 0.8, seed)
    core, local, missed, proved = searches.exact(4, src, tgt, hw)
    of = lambda s: kernels.SliceCounts(4, src, tgt, np.array(s) // 2, np.array(s) % 2, hw).energy
    assert proved and missed == of(core * 2 + local) == min(map(of, permutations(range(4))))


def test_exact_stops_at_its_deadline():
    src, tgt = network(16, 0.7, 1)
    assert searches.exact(16, src, tgt, HardwareConfig(2, 8, 1, 2), time_limit=0.05)[3] is False


HW = HardwareConfig(2, 8, 2, 2)


def fits(core, local, hw):
    assert len(set(zip(core.tolist(), local.tolist()))) == len(core)
    assert core.min() >= 0 and core.max() < hw.cores and local.min() >= 0 and local.max() < hw.n


def test_assigned_slots_are_no_worse_than_the_first_ones():
    src, tgt = network(24, 0.2, 2)
    slots = searches.assigned_slots(24, src, tgt, HW)
    fits(slots // 8, slots % 8, HW)


def test_slice_chain_counts_what_its_slices_miss():
    src, tgt = network(24, 0.2, 3)
    core, local, missed, chosen, _ = searches.slice_chain(24, src, tgt, HW, 5, sweeps=20)
    fits(core, local, HW)
    state = searches.ChosenSlices(24, src, tgt, core, local, HW, chosen)
    assert state.energy == missed >= kernels.SliceCounts(24, src, tgt, core, local, HW).energy


@pytest.mark.parametrize("joint", [False, True])
def test_hardware_chain_fits_its_hardware(joint):
    src, tgt = network(20, 0.2, 4)
    core, local, missed, hw, chosen, cost, first = searches.hardware_chain(20, src, tgt, 5, joint)
    assert cost <= first and chosen.shape == (20, hw.l + 1)
    fits(core, local, hw)
    best = kernels.SliceCounts(20, src, tgt, core, local, hw).energy
    assert missed >= best if joint else missed == best


@pytest.mark.parametrize("kind", [kernels.SliceCounts, searches.ChosenSlices])
def test_networks_without_links(kind):
    none = np.array([], dtype=np.int64)
    assert kind(3, none, none, np.arange(3), np.zeros(3, dtype=np.int64), HW).energy == 0


def test_first_hardware_and_levels():
    assert searches.levels_for(125, 5) == 3 and searches.levels_for(1, 1) == 0
    hw = searches.first_hardware(60, 400)
    assert (hw.r, hw.n) == (8, 20) and hw.slots >= 60
    with pytest.raises(ValueError):
        searches.levels_for(2, 1)


def test_eigenvalues_and_groups():
    a = np.kron(np.eye(3), np.ones((6, 6)))
    np.fill_diagonal(a, 0)
    rng = np.random.default_rng(0)
    assert len(set(spectral.bethe_hessian_groups(a, rng).reshape(3, 6).min(axis=1))) == 3
    assert spectral.bethe_hessian_groups(np.zeros((5, 5)), rng).tolist() == [0] * 5
    assert spectral.negative_vectors(np.diag([-1.0, 0.0, 2.0])).shape[1] == 1


def test_projection_error_is_the_distance_to_the_span():
    rng = np.random.default_rng(1)
    v, labels = rng.standard_normal((12, 3)), np.arange(12) % 4
    h = np.eye(4)[labels]
    assert abs(spectral.projection_error(v, labels) - ((v - h @ np.linalg.pinv(h) @ v) ** 2).sum()) < 1e-9


@pytest.mark.parametrize("method", ["kmeans", "diag", "spherical", "tied", "full"])
def test_partitions_find_clear_groups(method):
    rng = np.random.default_rng(2)
    x = np.vstack([rng.normal(c, 0.1, (15, 2)) for c in (0, 3, 6)])
    assert spectral.partition(x, 3, rng, method).tolist() == sorted([0, 1, 2] * 15)


@pytest.mark.parametrize("seed", range(2))
def test_hierarchy_of_pairs_of_blocks(seed):
    b = np.arange(96) // 16
    p = np.where(b[:, None] == b, 0.9, np.where(b[:, None] // 2 == b // 2, 0.3, 0.02))
    a = np.triu(np.random.default_rng(seed).random((96, 96)) < p, 1).astype(float)
    levels, full = spectral.spectral_hierarchy(a + a.T), np.arange(96)
    for part in levels:
        full = part[full]
    assert (full == b // 2).all()


def test_parents_of_levels():
    array = np.array
    assert spectral.parents([array([0, 0, 1, 1]), array([0, 0])]) == [2, 2, -1]
    assert spectral.parents([array([0, 1, 2, 3]), array([0, 0, 1, 1]), array([0, 0])]) == [4, 4, 5, 5, 6, 6, -1]
    assert spectral.parents([array([0, 0, 1, 2]), array([0, 1, 1]), array([0, 0])]) == [3, 4, 4, 5, 5, -1]
    assert spectral.parents([array([0, 1])]) == [2, 2, -1]


def test_noise_is_symmetric_and_small():
    rng = np.random.default_rng(3)
    for kind in ("uniform", "gaussian"):
        out = spectral.perturbed(np.eye(4), rng, 1e-3, kind)
        assert np.allclose(out, out.T) and np.abs(out - np.eye(4)).max() < 1e-2


def test_description_prefers_planted_blocks():
    src, tgt = np.nonzero(np.kron(np.eye(4), np.ones((10, 10))) - np.eye(40))
    assert spectral.nested_blocks(40, src, tgt)[0].tolist() == (np.arange(40) // 10).tolist()
    none = np.array([], dtype=np.int64)
    assert set(spectral.nested_blocks(5, none, none)[-1]) == {0}


def test_moments_are_those_of_the_planted_probabilities_and_invert():
    m = estimators.moments(20, 2, 0.5, 3)
    shells = [(19, 0.5), (20, 0.25), (40, 0.125), (80, 0.0625)]
    assert abs(m[0] - 2 * sum(k * p for k, p in shells)) < 1e-9 and abs(m[1] - 2 * sum(k * p * (1 - p) for k, p in shells)) < 1e-9
    got = estimators.inverted(160, m)
    assert got["h"] == 3 and abs(got["n0"] - 20) < 1e-3 and abs(got["b"] - 2) < 1e-3 and abs(got["p0"] - 0.5) < 1e-3


def test_estimates_from_a_spectrum():
    values = np.array([60.0, 30, 29, 12, 12, 12, 12, 11.9, *([1.0] * 150)])
    by = {m: estimators.from_spectrum(values, 160, 2400, m, depth=3) for m in estimators.METHODS[1:]}
    noise = 2 * np.sqrt(30 * (1 - 30 / 160))
    assert by["depth"]["blocks"] == int((values > noise).sum()) and by["depth"]["h"] == 3
    assert by["base"]["b"] == 2.0 and by["gaps"]["h"] == 2 if by["gaps"]["blocks"] > 3 else by["gaps"]["h"] == 1


def test_unknown_methods_and_missing_hardware(spark):
    empty = spark.createDataFrame([], "graph_id string, src long, tgt long")
    sizes = spark.createDataFrame([], "graph_id string, n long")
    for call in (lambda: searches.searched(empty, sizes, "none"), lambda: searches.searched(empty, sizes, "exact"), lambda: spectral.clustered(empty, sizes, "none")):
        with pytest.raises(ValueError):
            call()
    assert searches.searched(empty, sizes, "joint_chain").count() == 0 == estimators.estimated(empty, sizes).count()
