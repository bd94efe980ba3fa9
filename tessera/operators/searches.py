"""Searches beyond those of ``kernels``: exact for tiny networks, chains over slices, chains that also change the hardware.

Chains are sequential; chains, networks and start states run side by side, one task each (``searched``).  All stop by steps, so
a result depends on its seed and never on the machine; a time limit is an extra that is off unless asked for.
"""

from __future__ import annotations

import math
import time
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.hw import HardwareConfig
from tessera.operators.kernels import SliceCounts, addresses, annealed, as_rows, balanced_parts, fitted_cores, greedy_cores, grouped, pca_addresses, unpacked
from tessera.operators.spectral import nested_blocks, parents, quadratic_assignment, spectral_hierarchy, undirected

# Weights, schedules and move shares that results are compared at.
MISS_WEIGHT, CORE_AREA, ROUTER_AREA = 1.0, 0.01, 0.05
MOVES = {"swap": 0.55, "move": 0.20, "add": 0.03, "remove": 0.03, "wider": 0.04, "narrower": 0.04, "swap_cores": 0.06}
JOINT_MOVES = {"swap": 0.35, "slice": 0.35, "add": 0.07, "remove": 0.07, "size": 0.06, "children": 0.05, "none": 0.05}
JOINT_CORE, JOINT_ROUTER, JOINT_WASTE = 0.5, 0.1, 1.0
MISS_PROBABILITY = 1e-10
SWEEPS, FIRST_TEMPERATURE, COOLING = 200, 5.0, 1000.0


def levels_for(cores: int, r: int) -> int:
    """The least l with r ** l >= cores, by whole numbers."""
    l, reach = 0, 1  # noqa: E741
    while reach < cores:
        if r < 2:
            raise ValueError("one child a router reaches one core only")
        l, reach = l + 1, reach * r  # noqa: E741
    return l


def first_hardware(n: int, m: int, f: int = 2) -> HardwareConfig:
    """Cores of three times the mean degree (4 to 256), 4 or 8 children, as many levels as the neurons need."""
    mean = m / max(n, 1)
    size, r = min(256, max(4, math.ceil(3 * mean))), 4 if mean < 4 else 8
    return HardwareConfig(r, size, levels_for(-(-max(n, 1) // size), r), f)


def likelihood_cost(kept: int, m: int, slots: int) -> float:
    """Negative log-likelihood of m links of which ``kept`` are heard."""
    return -(kept * math.log((kept + 1) / (slots + 2)) + (m - kept) * math.log(MISS_PROBABILITY))


def mapping_cost(n: int, hw: HardwareConfig, cores: int) -> float:
    """Nats of cores, addresses and slices of all neurons."""
    return n * (math.log(cores) + math.log(hw.n) + sum(math.log(hw.slices_at(d)) for d in range(1, hw.l + 1)))


# --- exact -----------------------------------------------------------------------------------------------------


def exact(n: int, src: np.ndarray, tgt: np.ndarray, hw: HardwareConfig, most_steps: int = 2_000_000, time_limit: float = math.inf):
    """(core, local, missed, proved): branch and bound over slots.

    What placed sources miss at the best slices never falls as more are placed, which is the bound.  Of sibling routers or cores
    that are empty only the first is tried.  ``proved`` is false if most_steps placements came first; the placement is then the best seen.
    """
    into, out = grouped(n, tgt, src), grouped(n, src, tgt)
    order = sorted(range(n), key=lambda i: -(len(into[i]) + len(out[i])))
    core = greedy_cores(n, src, tgt, hw)
    local = addresses(core)
    best = [core.copy(), local.copy(), SliceCounts(n, src, tgt, core, local, hw).energy]
    at_core, at_local = np.full(n, -1), np.full(n, -1)
    taken, inside = set(), [np.zeros(hw.r ** (hw.l - k), dtype=int) for k in range(hw.l + 1)]
    counts: dict[tuple[int, int], dict[int, int]] = {}
    until, stopped, steps = time.monotonic() + time_limit, False, 0

    def distance(a, b):
        d = 0
        while a != b:
            a, b, d = a // hw.r, b // hw.r, d + 1
        return d

    def links(i):
        for s in into[i]:
            if at_core[s] >= 0 or s == i:
                yield int(s), i
        for t in out[i]:
            if at_core[t] >= 0 and t != i:
                yield i, int(t)

    def change(i, by):
        lost = 0
        for s, t in links(i):
            d = distance(at_core[s], at_core[t])
            if d:
                c = counts.setdefault((t, d), {})
                k = ((at_local[s] + 1) * hw.slices_at(d) - 1) // hw.n
                lost -= sum(c.values()) - max(c.values(), default=0)
                c[k] = c.get(k, 0) + by
                lost += sum(c.values()) - max(c.values(), default=0)
        return lost

    def allowed(c):
        for k in range(hw.l):
            node = c // hw.r**k
            if node % hw.r and inside[k][node] == 0 and inside[k][node - 1] == 0:
                return False
        return True

    def place(depth, missed):
        nonlocal stopped, steps
        if stopped or missed >= best[2]:
            return
        if depth == n:
            best[:] = [at_core.copy(), at_local.copy(), missed]
            return
        i = order[depth]
        for c in range(hw.cores):
            if not allowed(c):
                continue
            for x in range(hw.n):
                if (c, x) in taken:
                    continue
                steps += 1
                if steps > most_steps or time.monotonic() > until:
                    stopped = True
                    return
                at_core[i], at_local[i] = c, x
                taken.add((c, x))
                lost = change(i, 1)
                for k in range(hw.l + 1):
                    inside[k][c // hw.r**k] += 1
                place(depth + 1, missed + lost)
                for k in range(hw.l + 1):
                    inside[k][c // hw.r**k] -= 1
                change(i, -1)
                taken.discard((c, x))
                at_core[i] = at_local[i] = -1
                if best[2] == 0:
                    return

    place(0, 0)
    return best[0], best[1], best[2], not stopped


# --- quadratic assignment --------------------------------------------------------------------------------------


def assigned_slots(n: int, src: np.ndarray, tgt: np.ndarray, hw: HardwareConfig) -> np.ndarray:
    """Slot of each neuron: links near each other, where near means few slices at their distance."""
    a = np.zeros((hw.slots, hw.slots))
    a[src, tgt] = 1
    core = np.arange(hw.slots) // hw.n
    d = sum((core[:, None] // hw.r**k != core[None] // hw.r**k).astype(int) for k in range(hw.l))
    near = 1.0 / np.array([hw.slices_at(k) for k in range(hw.l + 1)])[d] if hw.l else np.ones_like(a)
    return quadratic_assignment(a, near)[:n]


# --- chains that change slices too -----------------------------------------------------------------------------


class ChosenSlices(SliceCounts):
    """Counts whose slices are part of the state: what the chosen slices miss, not what the best ones would."""

    def __init__(self, n, src, tgt, core, local, hw, chosen=None):
        self.chosen = np.zeros((n, hw.l + 1), dtype=np.int64) if chosen is None else chosen
        super().__init__(n, src, tgt, core, local, hw)

    def _kept(self, rows) -> int:
        rows = np.asarray(rows)
        return np.take_along_axis(self.counts[rows], self.chosen[rows][:, :, None], axis=2).sum()

    def choose(self, i: int, d: int, k: int) -> int:
        """Slice k for neuron i at distance d; returns the change of what is missed."""
        change = int(self.counts[i, d, self.chosen[i, d]] - self.counts[i, d, k])
        self.chosen[i, d] = k
        self.energy += change
        return change


def _swap(state, i: int, j: int) -> None:
    a, b = (state.core[i], state.local[i]), (state.core[j], state.local[j])
    state.place([(i, *b), (j, *a)])


def slice_chain(n, src, tgt, hw: HardwareConfig, seed: int, sweeps: int = SWEEPS, time_limit: float = math.inf):
    """(core, local, missed, slices, cost) of the likeliest state: sweeps of n attempts, half of them swaps, half new slices."""
    rng, m = np.random.default_rng(seed), len(src)
    slots = rng.permutation(hw.slots)[:n]
    chosen = np.stack([rng.integers(hw.slices_at(d), size=n) for d in range(hw.l + 1)], axis=1)
    state = ChosenSlices(n, src, tgt, slots // hw.n, slots % hw.n, hw, chosen)
    cost = lambda: likelihood_cost(m - state.energy, m, n * hw.n)
    now = cost()
    best, until = (now, state.core.copy(), state.local.copy(), state.energy, chosen.copy()), time.monotonic() + time_limit
    for beta in np.geomspace(1 / FIRST_TEMPERATURE, COOLING / FIRST_TEMPERATURE, sweeps):
        if time.monotonic() > until:
            break
        for _ in range(n):
            if hw.l == 0 or rng.random() < 0.5:
                i, j = (int(x) for x in rng.integers(n, size=2))
                _swap(state, i, j) if i != j else None
                undo = (lambda i=i, j=j: _swap(state, i, j)) if i != j else (lambda: None)
            else:
                i, d = int(rng.integers(n)), int(rng.integers(1, hw.l + 1))
                old = int(state.chosen[i, d])
                state.choose(i, d, int(rng.integers(hw.slices_at(d))))
                undo = lambda i=i, d=d, old=old: state.choose(i, d, old)
            new = cost()
            if new > now and rng.random() >= math.exp(-beta * (new - now)):
                undo()
                continue
            now = new
            if now < best[0]:
                best = (now, state.core.copy(), state.local.copy(), state.energy, state.chosen.copy())
    return *best[1:], best[0]


# --- chains that change the hardware ---------------------------------------------------------------------------


@dataclass
class Shape:
    """Hardware in a chain: children, core size, cores in use of r ** l."""

    r: int
    n: int
    cores: int
    f: int

    def hw(self) -> HardwareConfig:
        return HardwareConfig(self.r, self.n, levels_for(self.cores, self.r), self.f)


def _packed(core: np.ndarray, local: np.ndarray, shape: Shape, rng) -> tuple[np.ndarray, np.ndarray] | None:
    """Neurons outside the shape, or on a slot that another holds, go to free slots in random order; None if there are too few."""
    slot = np.where((core < shape.cores) & (local < shape.n), core * shape.n + local, -1)
    kept, first = np.unique(slot, return_index=True)
    stay = np.zeros(len(core), dtype=bool)
    stay[first[kept >= 0]] = True
    free = np.setdiff1d(np.arange(shape.cores * shape.n), slot[stay])
    if len(free) < (~stay).sum():
        return None
    slot[~stay] = rng.permutation(free)[: (~stay).sum()]
    return slot // shape.n, slot % shape.n


def _reshaped(move: str, core, local, shape: Shape, rng):
    """(core, local, shape) after a change of the hardware, or None where it is not possible."""
    if move == "add":
        new = Shape(shape.r, shape.n, shape.cores + 1, shape.f)
    elif move == "remove":
        empty = np.setdiff1d(np.arange(shape.cores), core)
        if shape.cores == 1 or not len(empty):
            return None
        gone = int(rng.choice(empty))
        core, new = core - (core > gone), Shape(shape.r, shape.n, shape.cores - 1, shape.f)
    elif move in ("wider", "narrower"):
        size = shape.n + (1 if move == "wider" else -1)
        if size < max(4, shape.f):
            return None
        new = Shape(shape.r, size, shape.cores, shape.f)
    else:
        r = shape.r + (1 if move == "more" else -1)
        if r < 2:
            return None
        new = Shape(r, shape.n, shape.cores, shape.f)
    placed = _packed(core, local, new, rng)
    return None if placed is None else (*placed, new)


def _free_slot(state, shape: Shape, rng, tries: int = 100):
    held = set(zip(state.core.tolist(), state.local.tolist()))
    for _ in range(tries):
        slot = int(rng.integers(shape.cores * shape.n))
        if (slot // shape.n, slot % shape.n) not in held:
            return slot // shape.n, slot % shape.n
    return None


def hardware_chain(n, src, tgt, seed: int, joint: bool = False, start_cores: np.ndarray | None = None, f: int = 2, time_limit: float = math.inf):
    """(core, local, missed, hardware, slices, cost, cost at the start) of the cheapest state of a chain that also changes cores, their size and, if joint, routers.

    Not joint: missed links at the best slices plus areas of cores and routers, cooled from 50 to 0.01.  Joint: likelihood at
    chosen slices, their description and the hardware's cost, in sweeps with rising weight.  Cores given at the start count
    as labels of cores; the best state is returned, not the last.
    """
    rng, m = np.random.default_rng(seed), len(src)
    first = first_hardware(n, m, f)
    shape = Shape(first.r, first.n, first.cores, f)
    if start_cores is None:
        slots = rng.permutation(shape.cores * shape.n)[:n]
        core, local = slots // shape.n, slots % shape.n
    else:
        core = np.unique(start_cores, return_inverse=True)[1].astype(np.int64)
        shape.n, shape.cores = max(shape.n, int(np.bincount(core).max())), max(shape.cores, int(core.max()) + 1)
        local = addresses(core)
    kind, names = (ChosenSlices, list(JOINT_MOVES)) if joint else (SliceCounts, list(MOVES))
    share = np.array(list((JOINT_MOVES if joint else MOVES).values()))
    share = share / share.sum()

    def cost(state, shape):
        hw = state.hw
        if joint:
            area = JOINT_CORE * shape.cores * hw.n + JOINT_ROUTER * shape.cores * hw.l * hw.r + JOINT_WASTE * max(0, shape.cores * hw.n - n)
            return likelihood_cost(m - state.energy, m, n * hw.n) + mapping_cost(n, hw, shape.cores) + area
        routers = hw.n * (hw.r - 1) / (hw.cores - 1) if hw.cores > 1 else 0.0
        return MISS_WEIGHT * state.energy + CORE_AREA * hw.cores * hw.n**2 + ROUTER_AREA * routers

    if joint:
        heat = [1 / b for b in np.geomspace(1 / FIRST_TEMPERATURE, COOLING / FIRST_TEMPERATURE, SWEEPS)]
        steps = n
    else:
        heat = [50 * 0.98**k for k in range(422)]
        steps = 10
    state = kind(n, src, tgt, core, local, shape.hw())
    now = first_cost = cost(state, shape)
    held_slices = lambda: state.chosen.copy() if joint else state.counts.argmax(axis=2)
    best, until = (now, state.core.copy(), state.local.copy(), state.energy, state.hw, held_slices()), time.monotonic() + time_limit
    for t in heat:
        if time.monotonic() > until:
            break
        for _ in range(steps):
            move = names[rng.choice(len(names), p=share)]
            if move == "size":
                move = "wider" if rng.random() < 0.5 else "narrower"
            elif move == "children":
                move = "more" if rng.random() < 0.5 else "fewer"
            held = (state, shape)
            i, j = (int(x) for x in rng.integers(n, size=2))
            if move == "swap" and i != j:
                _swap(state, i, j)
                undo = lambda: _swap(state, i, j)
            elif move == "move" and (to := _free_slot(state, shape, rng)):
                old = (i, int(state.core[i]), int(state.local[i]))
                state.place([(i, *to)])
                undo = lambda: state.place([old])
            elif move == "slice" and state.hw.l:
                d = int(rng.integers(1, state.hw.l + 1))
                old_slice = int(state.chosen[i, d])
                state.choose(i, d, int(rng.integers(state.hw.slices_at(d))))
                undo = lambda: state.choose(i, d, old_slice)
            elif move == "swap_cores" and shape.cores > 1:
                a, b = (int(x) for x in rng.choice(shape.cores, 2, replace=False))
                both = np.flatnonzero((state.core == a) | (state.core == b))
                turn = lambda: state.place([(int(x), a + b - int(state.core[x]), int(state.local[x])) for x in both])
                turn()
                undo = turn
            elif move in ("add", "remove", "wider", "narrower", "more", "fewer"):
                new = _reshaped(move, state.core, state.local, shape, rng)
                if new is None:
                    continue
                shape = new[2]
                hw = shape.hw()
                if joint:
                    chosen = np.zeros((n, hw.l + 1), dtype=np.int64)
                    for d in range(1, hw.l + 1):
                        chosen[:, d] = state.chosen[:, d] % hw.slices_at(d) if d <= state.hw.l else rng.integers(hw.slices_at(d), size=n)
                    state = ChosenSlices(n, src, tgt, new[0], new[1], hw, chosen)
                else:
                    state = SliceCounts(n, src, tgt, new[0], new[1], hw)
                undo = None
            else:
                continue
            after = cost(state, shape)
            if after > now and rng.random() >= math.exp(-(after - now) / t):
                if undo is None:
                    state, shape = held
                else:
                    undo()
                continue
            now = after
            if now < best[0]:
                best = (now, state.core.copy(), state.local.copy(), state.energy, state.hw, held_slices())
    return *best[1:], best[0], first_cost


# --- hardware from clusters ------------------------------------------------------------------------------------


def flat_hardware(levels: list[np.ndarray], f: int = 2) -> tuple[np.ndarray, HardwareConfig]:
    """Cores are the finest clusters as they are; the core size is the largest, children the mean of all routers rounded up."""
    up, finest = np.array(parents(levels)), levels[0]
    clusters = int(finest.max()) + 1
    inner = np.bincount(up[up >= 0]) if (up >= 0).any() else np.zeros(0, dtype=int)
    inner = inner[inner > 0]
    r = 1 if clusters == 1 or not len(inner) else max(2, math.ceil(inner.sum() / len(inner)))
    size = int(np.bincount(finest).max())
    return finest.copy(), HardwareConfig(r, size, levels_for(clusters, r) if clusters > 1 else 0, min(f, size))


def padded_hardware(levels: list[np.ndarray], f: int = 2) -> tuple[np.ndarray, HardwareConfig]:
    """Cores by the path of child ranks from the root; children and core size are the largest of all, so empty cores pad the rest."""
    up, finest = parents(levels), levels[0]
    kids: dict[int, list[int]] = {}
    for c, p in enumerate(up):
        kids.setdefault(p, []).append(c)
    r = max([len(k) for p, k in kids.items() if p >= 0], default=1)
    at, depth, row = {kids[-1][0]: 0}, {kids[-1][0]: 0}, [kids[-1][0]]
    for c in row:
        for k, child in enumerate(kids.get(c, ())):
            at[child], depth[child] = at[c] * r + k, depth[c] + 1
            row.append(child)
    size = int(np.bincount(finest).max())
    return np.array([at[int(c)] for c in finest], dtype=np.int64), HardwareConfig(r, size, depth[0], min(f, size))


CLUSTERERS = {"blocks": lambda n, src, tgt, seed: nested_blocks(n, src, tgt), "spectral": lambda n, src, tgt, seed: spectral_hierarchy(undirected(n, src, tgt), seed)}
ADAPTERS = {"flat": flat_hardware, "padded": padded_hardware}


def from_clusters(n: int, src: np.ndarray, tgt: np.ndarray, clusterer: str, adapter: str, seed: int = 42, f: int = 2):
    """(core, local, hardware): clusters, hardware that holds them, addresses by principal components."""
    core, hw = ADAPTERS[adapter](CLUSTERERS[clusterer](n, src, tgt, seed), f)
    return core, pca_addresses(n, src, tgt, core), hw


def clusters_on(n: int, src: np.ndarray, tgt: np.ndarray, hw: HardwareConfig, clusterer: str, seed: int = 42):
    """(core, local) on given hardware: clusters in order fill cores one after the other."""
    core = fitted_cores(CLUSTERERS[clusterer](n, src, tgt, seed)[0], hw)
    return core, pca_addresses(n, src, tgt, core)


#: Three steps by name: cores, addresses by principal components, best slices.  Of hardware that is inferred: clusterer and adapter.
PRESETS = {"blocks_flat": ("blocks", "flat"), "blocks_padded": ("blocks", "padded"), "spectral_flat": ("spectral", "flat"), "spectral_padded": ("spectral", "padded")}


FREE = ("hardware_chain", "joint_chain", "parts_then_hardware", "clusters_then_hardware", *PRESETS, "drawn_on_given")
SEARCHES = ("exact", "assigned", "assigned_parts", "slice_chain", "parts_then_anneal", "clusters_then_anneal", "blocks_on_given", "spectral_on_given", *FREE)
FOUND = "graph_id string, neuron long, core long, local long, slices array<long>, missed long, proved boolean, cost double, start_cost double, r int, n int, l int, f int"


def searched(edges: DataFrame, sizes: DataFrame, method: str, hw: HardwareConfig | None = None, seed: int = 42, most_steps: int = 2_000_000, time_limit: float = math.inf) -> DataFrame:
    """graph_id, neuron, core, local, the slices by distance, and for each network again the links missed at those slices, whether that
    was proved least, the search's cost at its end and start (null where it has none), and the hardware r, n, l, f.

    edges(graph_id, src, tgt), sizes(graph_id, n).  Hardware is given, or found by the methods in FREE (``drawn_on_given`` takes the
    given hardware as what is inferred, with a random placement).  One network is one task.
    """
    if method not in SEARCHES:
        raise ValueError(f"no method {method}")
    if hw is None and (method not in FREE or method == "drawn_on_given"):
        raise ValueError(f"{method} needs hardware")

    def run(pdf):
        n, src, tgt = unpacked(pdf)
        own, chosen, proved, cost, start_cost = hw, None, False, None, None
        if method not in FREE and n > hw.slots:
            raise ValueError("Hardware overflow")
        if method == "exact":
            core, local, _, proved = exact(n, src, tgt, hw, most_steps, time_limit)
        elif method == "assigned":
            slots = assigned_slots(n, src, tgt, hw)
            core, local = slots // hw.n, slots % hw.n
        elif method == "assigned_parts":
            core = assigned_slots(n, src, tgt, hw) // hw.n
            local = pca_addresses(n, src, tgt, core)
        elif method == "slice_chain":
            core, local, _, chosen, cost = slice_chain(n, src, tgt, hw, seed, time_limit=time_limit)
        elif method == "drawn_on_given":
            slots = np.random.default_rng(seed).permutation(hw.slots)[:n]
            core, local = slots // hw.n, slots % hw.n
        elif method.endswith("_on_given"):
            core, local = clusters_on(n, src, tgt, hw, method.removesuffix("_on_given"), seed)
        elif method.endswith("_then_anneal"):
            core = balanced_parts(n, src, tgt, hw.cores, hw.n) if method.startswith("parts") else clusters_on(n, src, tgt, hw, "blocks", seed)[0]
            core, local, _ = annealed(n, src, tgt, hw, seed, start_cores=core)
        elif method in PRESETS:
            core, local, own = from_clusters(n, src, tgt, *PRESETS[method], seed)
        else:
            start = None
            if method == "parts_then_hardware":
                first = first_hardware(n, len(src))
                start = balanced_parts(n, src, tgt, first.cores, first.n)
            elif method == "clusters_then_hardware":
                start = CLUSTERERS["blocks"](n, src, tgt, seed)[0]
            core, local, _, own, chosen, cost, start_cost = hardware_chain(n, src, tgt, seed, method == "joint_chain", start, time_limit=time_limit)
        counts = SliceCounts(n, src, tgt, np.asarray(core), np.asarray(local), own).counts
        chosen = counts.argmax(axis=2) if chosen is None else chosen
        missed = len(src) - int(np.take_along_axis(counts, chosen[:, :, None], axis=2).sum())
        rows = pd.DataFrame({"graph_id": pdf["graph_id"].iloc[0], "neuron": np.arange(n), "core": core, "local": local, "slices": list(chosen), "missed": missed, "proved": proved})
        return rows.assign(cost=np.nan if cost is None else cost, start_cost=np.nan if start_cost is None else start_cost, r=own.r, n=own.n, l=own.l, f=own.f)

    return as_rows(edges, sizes).groupBy("graph_id").applyInPandas(run, FOUND)


def found_slices(found: DataFrame) -> DataFrame:
    """graph_id, neuron, distance, slice of what ``searched`` found, from distance 1."""
    return found.select("graph_id", "neuron", F.posexplode("slices").alias("distance", "slice")).where("distance > 0")
