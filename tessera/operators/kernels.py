"""Sequential searches, one group a task: each takes a group's edges and returns a placement, which SQL then scores."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.hw import HardwareConfig


def grouped(n: int, by: np.ndarray, values: np.ndarray) -> list[np.ndarray]:
    """The values of each key 0 to n - 1, from one sort."""
    if not n:
        return []
    order = np.argsort(by, kind="stable")
    return np.split(values[order], np.searchsorted(by[order], np.arange(1, n)))


def _adjacent(n: int, src: np.ndarray, tgt: np.ndarray) -> list[np.ndarray]:
    return grouped(n, np.concatenate([src, tgt]), np.concatenate([tgt, src]))


def greedy_cores(n: int, src: np.ndarray, tgt: np.ndarray, hw: HardwareConfig) -> np.ndarray:
    """Cores by a frontier: next the neuron with most placed neighbours (then degree, then lowest id), on the core that
    holds most of them and has room (ties: the lowest core).  A reciprocal edge counts twice."""
    import heapq

    near = _adjacent(n, src, tgt)
    degree, pull = np.array([len(x) for x in near]), np.zeros(n, dtype=np.int64)
    core, room, first = np.full(n, -1), np.full(hw.cores, hw.n), 0
    heap = [(0, -int(degree[i]), i) for i in range(n)]
    heapq.heapify(heap)
    while heap:
        p, _, i = heapq.heappop(heap)
        if core[i] >= 0 or -p != pull[i]:
            continue
        held = core[near[i]]
        held = held[held >= 0]
        best = -1
        if len(held):
            cores, counts = np.unique(held, return_counts=True)
            open_ = room[cores] > 0
            if open_.any():
                best = int(cores[open_][np.argmax(counts[open_])])
        if best < 0:
            while room[first] == 0:
                first += 1
            best = first
        core[i] = best
        room[best] -= 1
        for j in near[i]:
            if core[j] < 0:
                pull[j] += 1
                heapq.heappush(heap, (-int(pull[j]), -int(degree[j]), int(j)))
    return core


def addresses(core: np.ndarray) -> np.ndarray:
    """Places within a core in order of id."""
    order = np.argsort(core, kind="stable")
    starts = np.searchsorted(core[order], core[order], "left")
    local = np.empty(len(core), dtype=np.int64)
    local[order] = np.arange(len(core)) - starts
    return local


class SliceCounts:
    """Sources of each neuron by distance and slice, kept up to date under moves; the energy is what the best slices miss."""

    def __init__(self, n: int, src: np.ndarray, tgt: np.ndarray, core: np.ndarray, local: np.ndarray, hw: HardwareConfig):
        self.hw, self.core, self.local = hw, core.copy(), local.copy()
        self.out, self.into = grouped(n, src, tgt), grouped(n, tgt, src)
        self.counts = np.zeros((n, hw.l + 1, max(hw.slices_at(d) for d in range(hw.l + 1))), dtype=np.int64)
        d = sum((self.core[src] // hw.r**k != self.core[tgt] // hw.r**k).astype(np.int64) for k in range(hw.l)) + np.zeros(len(src), dtype=np.int64)
        widths = np.array([hw.slices_at(k) for k in range(hw.l + 1)])
        np.add.at(self.counts, (tgt, d, ((self.local[src] + 1) * widths[d] - 1) // hw.n), 1)
        self.energy = len(src) - int(self._kept(np.arange(n)))

    def _distance(self, a: int, b: int) -> int:
        d = 0
        while a != b:
            a, b, d = a // self.hw.r, b // self.hw.r, d + 1
        return d

    def _add(self, s: int, t: int, by: int) -> None:
        d = self._distance(self.core[s], self.core[t])
        k = self.hw.slices_at(d)
        self.counts[t, d, ((self.local[s] + 1) * k - 1) // self.hw.n] += by

    def _kept(self, rows) -> int:
        return self.counts[rows].max(axis=2).sum()

    def place(self, changes: list[tuple[int, int, int]]) -> int:
        """Neurons to cores and addresses at once; returns the change of energy."""
        moved = {i for i, _, _ in changes}
        links = {(i, int(t)) for i in moved for t in self.out[i]} | {(int(s), i) for i in moved for s in self.into[i]}
        rows = np.array(sorted({t for _, t in links} | moved), dtype=np.int64)
        before = self._kept(rows)
        for s, t in links:
            self._add(s, t, -1)
        for i, c, x in changes:
            self.core[i], self.local[i] = c, x
        for s, t in links:
            self._add(s, t, 1)
        change = int(before - self._kept(rows))
        self.energy += change
        return change


def annealed(n: int, src, tgt, hw: HardwareConfig, seed: int, start: float = 50.0, stop: float = 0.01, alpha: float = 0.98, steps: int = 10, start_cores: np.ndarray | None = None):
    """(core, local, energy) of the best state of one chain: swaps and moves to free slots, Metropolis acceptance, cooling by alpha.
    It starts at random, or at given cores with addresses by id."""
    rng = np.random.default_rng(seed)
    slots = rng.permutation(hw.slots)
    if start_cores is not None:
        held = start_cores * hw.n + addresses(start_cores)
        slots = np.concatenate([held, rng.permutation(np.setdiff1d(np.arange(hw.slots), held))])
    free = slots[n:].tolist()
    state = SliceCounts(n, src, tgt, slots[:n] // hw.n, slots[:n] % hw.n, hw)
    best, t = (state.core.copy(), state.local.copy(), state.energy), start
    while t > stop:
        for _ in range(steps):
            i = int(rng.integers(n))
            old = (i, int(state.core[i]), int(state.local[i]))
            if free and rng.random() < 0.5:
                k = int(rng.integers(len(free)))
                change = [(i, free[k] // hw.n, free[k] % hw.n)]
                back = [old]
            else:
                j = int(rng.integers(n))
                other = (j, int(state.core[j]), int(state.local[j]))
                change, back, k = [(i, *other[1:]), (j, *old[1:])], [old, other], None
                if i == j:
                    continue
            delta = state.place(change)
            if delta > 0 and rng.random() >= np.exp(-delta / t):
                state.place(back)
                continue
            if k is not None:
                free[k] = old[1] * hw.n + old[2]
            if state.energy < best[2]:
                best = (state.core.copy(), state.local.copy(), state.energy)
        t *= alpha
    return best


def balanced_parts(n: int, src: np.ndarray, tgt: np.ndarray, parts: int, size: int, sweeps: int = 4, weight: np.ndarray | None = None) -> np.ndarray:
    """Parts of at most ``size`` neurons grown one after the other along edges, then improved by swaps that lower the cut.  The next
    neuron of a part is that with most weight into it, then the lowest id; a heap finds it."""
    import heapq

    weight = np.ones(len(src)) if weight is None else weight
    near = _adjacent(n, src, tgt)
    worth = grouped(n, np.concatenate([src, tgt]), np.concatenate([weight, weight]))
    part, pull, left, lowest = np.full(n, -1), np.zeros(n), n, 0
    for p in range(parts):
        heap: list[tuple[float, int]] = []
        pull[:] = 0
        for _ in range(min(size, -(-left // (parts - p)))):
            while heap and (part[heap[0][1]] >= 0 or -heap[0][0] != pull[heap[0][1]]):
                heapq.heappop(heap)
            if heap:
                i = heapq.heappop(heap)[1]
            else:
                while part[lowest] >= 0:
                    lowest += 1
                i = lowest
            part[i], left = p, left - 1
            for j, w in zip(near[i].tolist(), worth[i].tolist()):
                if part[j] < 0:
                    pull[j] += w
                    heapq.heappush(heap, (-pull[j], j))
    members = [set(np.flatnonzero(part == p).tolist()) for p in range(parts)]
    for _ in range(sweeps):
        better = False
        for i in range(n):
            if not len(near[i]):
                continue
            own = np.bincount(part[near[i]], worth[i], minlength=parts)
            p, at = int(own.argmax()), int(part[i])
            if own[p] <= own[at]:
                continue
            for j in sorted(members[p]):
                other = np.bincount(part[near[j]], worth[j], minlength=parts)
                if own[p] - own[at] + other[at] - other[p] - 2 * worth[i][near[i] == j].sum() > 1e-12:
                    part[i], part[j], better = p, at, True
                    members[p] ^= {i, j}
                    members[at] ^= {i, j}
                    break
        if not better:
            break
    return part


def hyperedge_pairs(n: int, src: np.ndarray, tgt: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Links between the pins of each net (a neuron and its sources), each net of k pins worth 1 / (k - 1) a pair with its own neuron
    and its neighbours in order of id, so a net of k pins makes 2k links and not its square."""
    a, b, w = [], [], []
    for t, sources in enumerate(grouped(n, tgt, src)):
        pins = np.unique(np.append(sources, t))
        if len(pins) > 1:
            ring = np.roll(pins, -1)
            a += [np.full(len(pins) - 1, t), pins]
            b += [pins[pins != t], ring]
            w += [np.full(2 * len(pins) - 1, 1 / (len(pins) - 1))]
    if not a:
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64), np.empty(0)
    return np.concatenate(a), np.concatenate(b), np.concatenate(w)


def recursive_cores(n: int, src: np.ndarray, tgt: np.ndarray, hw: HardwareConfig, nets: str = "edges", strict: bool = False) -> np.ndarray:
    """Cores by splitting all neurons into r parts, each part again, level by level until there are as many leaves as cores.

    Parts of one split differ by one neuron at most.  A part without links is dealt out in turn; single neurons stay.  Leaves are
    numbered depth first.  nets: ``edges`` (undirected, counted once) or ``hyperedges`` (a neuron and its sources).  strict: an
    error where a split leaves a part empty.
    """
    if not n:
        return np.empty(0, dtype=np.int64)
    low, high = np.minimum(src, tgt), np.maximum(src, tgt)
    keep = np.unique(low[low != high] * n + high[low != high])
    pairs = (keep // n, keep % n) if nets == "edges" else (src, tgt)
    leaves: list[tuple[tuple[int, ...], np.ndarray]] = [((), np.arange(n))]
    queue = [leaves[0]]
    while queue and len(leaves) < hw.cores:
        path, own = queue.pop(0)
        if len(own) <= 1 or hw.r < 2:
            continue
        place = np.full(n, -1)
        place[own] = np.arange(len(own))
        inside = (place[pairs[0]] >= 0) & (place[pairs[1]] >= 0)
        a, b = place[pairs[0][inside]], place[pairs[1][inside]]
        weight = None
        if nets != "edges":
            a, b, weight = hyperedge_pairs(len(own), a, b)
        part = balanced_parts(len(own), a, b, hw.r, -(-len(own) // hw.r), weight=weight) if len(a) else np.arange(len(own)) % hw.r
        made = [((*path, p), own[part == p]) for p in range(hw.r)]
        if strict and any(not len(m) for _, m in made):
            raise ValueError("a part of the split is empty")
        leaves = [x for x in leaves if x[0] != path] + made
        queue += made
    core = np.zeros(n, dtype=np.int64)
    for k, (_, own) in enumerate(sorted(leaves, key=lambda x: x[0])):
        core[own] = k
    if len(leaves) > hw.cores or np.bincount(core).max() > hw.n:
        return fitted_cores(core, hw)
    return core


def fitted_cores(core: np.ndarray, hw: HardwareConfig) -> np.ndarray:
    """Neurons in order of (core, id) on cores of n one after the other."""
    if len(core) > hw.slots:
        raise ValueError("Hardware overflow")
    out = np.empty(len(core), dtype=np.int64)
    out[np.lexsort((np.arange(len(core)), core))] = np.arange(len(core)) // hw.n
    return out


def pca_addresses(n: int, src: np.ndarray, tgt: np.ndarray, core: np.ndarray) -> np.ndarray:
    """Within each core, ranks of the first principal component of in-neighbour rows; its largest loading is positive, ties go by id."""
    local, into = np.zeros(n, dtype=np.int64), grouped(n, tgt, src)
    for own in grouped(int(core.max()) + 1 if n else 0, core, np.arange(n)):
        if len(own) < 2:
            continue
        sources, at = np.unique(np.concatenate([into[i] for i in own]), return_inverse=True)  # columns without a link add nothing
        rows = np.zeros((len(own), len(sources)))
        rows[np.repeat(np.arange(len(own)), [len(into[i]) for i in own]), at] = 1
        rows -= rows.mean(axis=0) if len(sources) else 0
        if not len(sources) or not np.abs(rows).max() > 1e-12:
            local[own] = np.arange(len(own))
            continue
        axis = np.linalg.svd(rows, full_matrices=False)[2][0]
        axis *= np.sign(axis[np.argmax(np.abs(axis))])
        local[own[np.lexsort((own, np.round(rows @ axis, 9)))]] = np.arange(len(own))
    return local


def assignment(cost: np.ndarray) -> np.ndarray:
    """The column of each row in the cheapest one-to-one matching of a matrix with no more rows than columns (shortest augmenting paths)."""
    n, m = cost.shape
    u, v, match = np.zeros(n + 1), np.zeros(m + 1), np.zeros(m + 1, dtype=int)
    for i in range(1, n + 1):
        match[0], j0 = i, 0
        least, used, way = np.full(m + 1, np.inf), np.zeros(m + 1, dtype=bool), np.zeros(m + 1, dtype=int)
        while True:
            used[j0] = True
            i0 = match[j0]
            cur = cost[i0 - 1] - u[i0] - v[1:]
            better = ~used[1:] & (cur < least[1:])
            least[1:][better], way[1:][better] = cur[better], j0
            j1 = int(np.argmin(np.where(used[1:], np.inf, least[1:]))) + 1
            delta = least[j1]
            u[match[used]] += delta
            v[used] -= delta
            least[~used] -= delta
            j0 = j1
            if match[j0] == 0:
                break
        while j0:
            match[j0] = match[way[j0]]
            j0 = way[j0]
    out = np.empty(n, dtype=int)
    for j in range(1, m + 1):
        if match[j]:
            out[match[j] - 1] = j - 1
    return out


METHODS = ("greedy", "anneal", "three_step", "three_step_recursive", "three_step_hyperedges")


def as_rows(edges: DataFrame, sizes: DataFrame) -> DataFrame:
    """Networks as one frame, a row for the size and one for each edge: what a task of one network gets."""
    none = F.lit(None).cast("long")
    return sizes.select("graph_id", F.col("n").cast("long"), none.alias("src"), none.alias("tgt")).unionByName(edges.select("graph_id", none.alias("n"), "src", "tgt"))


def unpacked(pdf: pd.DataFrame) -> tuple[int, np.ndarray, np.ndarray]:
    e = pdf[pdf["src"].notna()].sort_values(["src", "tgt"])
    return int(pdf["n"].max()), e["src"].to_numpy(dtype=np.int64), e["tgt"].to_numpy(dtype=np.int64)


def mapped(edges: DataFrame, sizes: DataFrame, hw: HardwareConfig, method: str, seed: int = 42) -> DataFrame:
    """graph_id, neuron, core, local for each graph: edges(graph_id, src, tgt) and sizes(graph_id, n), ids 0 to n - 1.

    One graph is one task; many graphs, chains or hardware sizes run side by side.  A graph must fit the hardware.
    """
    if method not in METHODS:
        raise ValueError(f"no method {method}")

    def run(pdf):
        n, src, tgt = unpacked(pdf)
        if n > hw.slots:
            raise ValueError("Hardware overflow")
        if method == "greedy":
            core = greedy_cores(n, src, tgt, hw)
            local = addresses(core)
        elif method == "anneal":
            core, local, _ = annealed(n, src, tgt, hw, seed)
        else:
            if method == "three_step":
                core = balanced_parts(n, src, tgt, hw.cores, hw.n)
            else:
                core = recursive_cores(n, src, tgt, hw, "hyperedges" if method.endswith("hyperedges") else "edges")
            local = pca_addresses(n, src, tgt, core)
        return pd.DataFrame({"graph_id": pdf["graph_id"].iloc[0], "neuron": np.arange(n), "core": core.astype(np.int64), "local": local})

    return as_rows(edges, sizes).groupBy("graph_id").applyInPandas(run, "graph_id string, neuron long, core long, local long")


def accuracy(pairs: DataFrame, by: str | None = None) -> DataFrame:
    """Clustering accuracy of rows (truth, predicted), of each group by: the best one-to-one match of labels.  The contingency tables
    are counted in Spark; a matching sees one cell for each pair of labels of its group."""
    cells = pairs.groupBy(*([by] if by else []), "truth", "predicted").agg(F.count("*").alias("k"))
    cells = cells.select(F.col(by) if by else F.lit(0).alias("g"), "truth", "predicted", "k")
    group, kind = cells.columns[0], cells.schema[0].dataType.simpleString()

    def run(pdf):
        t = pdf.pivot_table(index="truth", columns="predicted", values="k", fill_value=0).to_numpy(dtype=float)
        t = t if t.shape[0] <= t.shape[1] else t.T
        return pd.DataFrame({group: pdf[group].iloc[:1], "accuracy": [t[np.arange(len(t)), assignment(-t)].sum() / pdf["k"].sum()]})

    found = cells.groupBy(group).applyInPandas(run, f"{group} {kind}, accuracy double")
    return found if by else found.select("accuracy")
