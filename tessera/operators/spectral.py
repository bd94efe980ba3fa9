"""Clusterers of one network in numpy: spectral hierarchies, nested blocks by description length, quadratic assignment.

They run inside a task for each network (``clustered``); the hierarchies they return are tables of parents that SQL reads.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.kernels import assignment


def undirected(n: int, src: np.ndarray, tgt: np.ndarray) -> np.ndarray:
    """Symmetric 0/1 matrix without a diagonal."""
    a = np.zeros((n, n))
    a[src, tgt] = a[tgt, src] = 1
    np.fill_diagonal(a, 0)
    return a


# --- spectra ---------------------------------------------------------------------------------------------------


def bethe_hessian(a: np.ndarray, r: float) -> np.ndarray:
    return (r * r - 1) * np.eye(len(a)) - r * a + np.diag(a.sum(axis=1))


def negative_vectors(m: np.ndarray) -> np.ndarray:
    """Eigenvectors of all negative eigenvalues, the smallest first; a value within rounding of 0 is not negative."""
    values, vectors = np.linalg.eigh(m)
    return vectors[:, values < -1e-9 * max(1.0, np.abs(m).max())]


def walk_vectors(a: np.ndarray, k: int) -> np.ndarray:
    """The k leading eigenvectors of I - L / d_max; a matrix without links gives those of the identity."""
    degree = a.sum(axis=1)
    top = degree.max() if len(degree) and degree.max() > 0 else 1.0
    values, vectors = np.linalg.eigh(np.eye(len(a)) - (np.diag(degree) - a) / top)
    return vectors[:, np.argsort(-values, kind="stable")[:k]]


def perturbed(a: np.ndarray, rng: np.random.Generator, scale: float = 1e-2, kind: str = "uniform") -> np.ndarray:
    """A small matrix with symmetric noise, relative to its largest entry."""
    noise = rng.random(a.shape) if kind == "uniform" else rng.standard_normal(a.shape)
    return a + scale * (np.abs(a).max() or 1.0) * (noise + noise.T) / 2


# --- partitions of a spectral space ----------------------------------------------------------------------------


def dense(labels: np.ndarray) -> np.ndarray:
    """Labels 0, 1, ... in order of first appearance."""
    _, first, back = np.unique(labels, return_index=True, return_inverse=True)
    return np.argsort(np.argsort(first))[back]


def _seeded(x: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    centres = [x[rng.integers(len(x))]]
    for _ in range(k - 1):
        d = np.min([((x - c) ** 2).sum(axis=1) for c in centres], axis=0)
        centres.append(x[rng.choice(len(x), p=d / d.sum())] if d.sum() > 0 else x[rng.integers(len(x))])
    return np.array(centres)


def kmeans(x: np.ndarray, k: int, rng: np.random.Generator, starts: int = 20, rounds: int = 100) -> np.ndarray:
    """Lloyd's rounds from spread seeds; the best of several starts."""
    best, least = np.zeros(len(x), dtype=np.int64), np.inf
    for _ in range(starts):
        centres, labels = _seeded(x, k, rng), None
        for _ in range(rounds):
            d = ((x[:, None] - centres[None]) ** 2).sum(axis=2)
            new = d.argmin(axis=1)
            if labels is not None and (new == labels).all():
                break
            labels = new
            for c in np.unique(labels):
                centres[c] = x[labels == c].mean(axis=0)
        cost = d[np.arange(len(x)), labels].sum()
        if cost < least - 1e-12:
            best, least = labels, cost
    return dense(best)


def mixture_of_gaussians(x: np.ndarray, k: int, rng: np.random.Generator, shape: str = "diag", rounds: int = 100) -> np.ndarray:
    """Expectation maximisation from a k-means start; ``shape`` is diag, spherical, tied or full."""
    labels = kmeans(x, k, rng, 4)
    k, dim = int(labels.max()) + 1, x.shape[1]
    r = np.eye(k)[labels]
    floor = 1e-6 * max(float(x.var()), 1e-12)
    for _ in range(rounds):
        w = r.sum(axis=0) + 1e-12
        means = r.T @ x / w[:, None]
        covs = np.empty((k, dim, dim))
        for c in range(k):
            y = x - means[c]
            covs[c] = (r[:, c, None] * y).T @ y / w[c]
        if shape == "tied":
            covs[:] = (covs * (w / len(x))[:, None, None]).sum(axis=0)
        elif shape == "diag":
            covs *= np.eye(dim)
        elif shape == "spherical":
            covs = np.trace(covs, axis1=1, axis2=2)[:, None, None] / dim * np.eye(dim)
        covs = covs + floor * np.eye(dim)
        logs = np.empty((len(x), k))
        for c in range(k):
            y = x - means[c]
            logs[:, c] = np.log(w[c] / len(x)) - 0.5 * (np.linalg.slogdet(covs[c])[1] + (y * np.linalg.solve(covs[c], y.T).T).sum(axis=1))
        new = np.exp(logs - logs.max(axis=1, keepdims=True))
        new /= new.sum(axis=1, keepdims=True)
        if np.abs(new - r).max() < 1e-6:
            break
        r = new
    return dense(r.argmax(axis=1))


def partition(vectors: np.ndarray, k: int, rng: np.random.Generator, method: str = "kmeans", unit_rows: bool = False) -> np.ndarray:
    """k groups of rows: ``kmeans``, or a mixture of the shape that the method names."""
    x = vectors
    if unit_rows:
        x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    k = min(k, len(x))
    if k <= 1:
        return np.zeros(len(x), dtype=np.int64)
    return kmeans(x, k, rng) if method == "kmeans" else mixture_of_gaussians(x, k, rng, method)


def projection_error(vectors: np.ndarray, labels: np.ndarray) -> float:
    """Squared norm of what the vectors have outside the span of the groups' indicators: within-group spread."""
    sums = np.zeros((int(labels.max()) + 1, vectors.shape[1]))
    np.add.at(sums, labels, vectors)
    counts = np.bincount(labels)
    return float(max(0.0, (vectors**2).sum() - (sums**2 / np.maximum(counts, 1)[:, None]).sum()))


# --- spectral hierarchy ----------------------------------------------------------------------------------------


def bethe_hessian_groups(a: np.ndarray, rng: np.random.Generator, groups: int = -1, method: str = "kmeans", unit_rows: bool = False) -> np.ndarray:
    """Groups from the negative eigenspaces at r and -r, r the root of the mean degree; no links or no such space: one group."""
    if not len(a) or not a.any():
        return np.zeros(len(a), dtype=np.int64)
    r = np.sqrt(a.sum() / len(a))
    space = np.hstack([negative_vectors(bethe_hessian(a, r)), negative_vectors(bethe_hessian(a, -r))])
    k = space.shape[1] if groups < 0 else groups
    return partition(space, k, rng, method, unit_rows) if k and space.shape[1] else np.zeros(len(a), dtype=np.int64)


def expected_errors(levels: list[int]) -> np.ndarray:
    """Of a random space with the given group counts as exact levels (rising, from 1): (k - a)(b - k) / (b - a) between neighbours a < b."""
    k = np.arange(1, levels[-1] + 1)
    out = np.zeros(levels[-1])
    for a, b in zip(levels, levels[1:]):
        at = (k > a) & (k < b)
        out[at] = (k[at] - a) * (b - k[at]) / (b - a)
    return out


def candidates(a: np.ndarray, counts: list[int], rng: np.random.Generator) -> tuple[dict[int, np.ndarray], np.ndarray]:
    """One partition for each number of groups, from as many leading vectors, and its projection error."""
    vectors = walk_vectors(a, max(counts))
    parts = {k: partition(vectors[:, :k], k, rng) for k in counts}
    return parts, np.array([projection_error(vectors[:, :k], parts[k]) for k in counts])


def relevant_levels(errors: np.ndarray, share: float = 0.05) -> list[int]:
    """Group counts whose errors (of 1, 2, ... groups) are local minima and at most a share of what chance gives between the levels
    already found; in order of clarity, the clearest first."""
    n = len(errors)
    minima = [k for k in range(2, n) if errors[k - 1] <= min(errors[k - 2] if k > 2 else np.inf, errors[k] if k < n - 1 else np.inf)]
    levels, found = [1, n] if n > 1 else [1], []
    while minima:
        chance = expected_errors(levels)
        k = min(minima, key=lambda k: errors[k - 1] / chance[k - 1])
        if errors[k - 1] > share * chance[k - 1]:
            break
        levels = sorted([*levels, k])
        found.append(k)
        minima.remove(k)
    return found


def drawn_densities(links: np.ndarray, possible: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """A symmetric matrix of densities that the links allow: beta with one link and one gap added."""
    upper = np.triu(rng.beta(links + 1, np.maximum(possible - links, 0) + 1))
    return upper + np.triu(upper, 1).T


def spectral_hierarchy(a: np.ndarray, seed: int = 42, repeats: int = 20) -> list[np.ndarray]:
    """Levels from the finest: each gives every group of the level below (nodes, at first) its group.  The first comes from the
    Bethe-Hessian; coarser ones from the matrix of link densities between groups, its errors averaged over drawn densities, so that
    levels which chance alone could make don't count."""
    rng = np.random.default_rng(seed)
    first = bethe_hessian_groups(a, rng)
    levels, full = [first], first
    while (k := int(levels[-1].max()) + 1) > 2:
        h = np.eye(k)[full]
        size = h.sum(axis=0)
        links, possible = h.T @ a @ h, np.maximum(np.outer(size, size) - np.diag(size), 1)
        density = links / possible
        counts = list(range(1, k + 1))
        errors = np.mean([candidates(drawn_densities(links, possible, rng), counts, rng)[1] for _ in range(repeats)], axis=0)
        found = relevant_levels(errors)
        if not found:
            break
        part = candidates(density, found[:1], rng)[0][found[0]]
        if int(part.max()) + 1 >= k:
            break
        levels.append(part)
        full = part[full]
    return levels


# --- nested blocks ---------------------------------------------------------------------------------------------


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.where(x > 0, x, 1.0))


def _log_choose(n: float, k: float) -> float:
    from math import lgamma

    return lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1)


def description_length(e: np.ndarray, size: np.ndarray) -> float:
    """Nats of a directed block model: links given blocks, link counts, sizes and labels."""
    from math import lgamma, log

    b, n, m = len(size), float(size.sum()), float(e.sum())
    links = -_xlogx(e).sum() + ((e.sum(axis=0) + e.sum(axis=1)) * np.log(size)).sum()
    labels = lgamma(n + 1) - sum(lgamma(s + 1) for s in size) + _log_choose(n - 1, b - 1) + log(max(n, 1))
    return float(links + _log_choose(b * b + m - 1, m) + labels)


def _merge_costs(e: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Change of the link term when two blocks become one, for all pairs at once, one row after the other."""
    b, x = len(size), _xlogx(e)
    rows, cols, degree = x.sum(axis=1), x.sum(axis=0), e.sum(axis=0) + e.sum(axis=1)
    at, out = np.arange(b), np.full((b, b), np.inf)
    for r in range(b - 1):
        s = at[r + 1 :]
        together, across = _xlogx(e[r] + e[s]), _xlogx(e[:, [r]] + e[:, s])
        outer = together.sum(axis=1) - together[:, r] - together[np.arange(len(s)), s]
        outer += across.sum(axis=0) - across[r] - across[s, np.arange(len(s))]
        inner = _xlogx(e[r, r] + e[r, s] + e[s, r] + e[s, s])
        before = rows[r] + rows[s] + cols[r] + cols[s] - x[r, r] - x[s, s] - x[r, s] - x[s, r]
        sizes = (degree[r] + degree[s]) * np.log(size[r] + size[s]) - degree[r] * np.log(size[r]) - degree[s] * np.log(size[s])
        out[r, s] = before - outer - inner + sizes
    return out


def blocks(e: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The groups of least description length on the way from all apart to all in one; wide levels merge a fifth of the blocks at once."""
    label, best = np.arange(len(size)), (np.inf, None)
    while True:
        now = description_length(e, size)
        if now < best[0] - 1e-9:
            best = (now, label.copy())
        b = len(size)
        if b == 1:
            return dense(best[1])
        cost, used, to = _merge_costs(e, size), np.zeros(b, dtype=bool), np.arange(b)
        want = max(1, b // 5) if b > 32 else 1
        for pair in np.argsort(cost, axis=None, kind="stable")[: b * b]:
            r, s = divmod(int(pair), b)
            if not np.isfinite(cost[r, s]) or want == 0:
                break
            if not used[r] and not used[s]:
                used[r] = used[s] = True
                to[s], want = r, want - 1
        to = dense(to)
        h = np.eye(int(to.max()) + 1)[to]
        e, size, label = h.T @ e @ h, h.T @ size, to[label]


def nested_blocks(n: int, src: np.ndarray, tgt: np.ndarray) -> list[np.ndarray]:
    """Levels from the finest; each merges the blocks below for as long as that shortens the description."""
    e, size = np.zeros((n, n)), np.ones(n)
    np.add.at(e, (src, tgt), 1)
    levels: list[np.ndarray] = []
    while len(size) > 1:
        part = blocks(e, size)
        k = int(part.max()) + 1
        if k == len(size) and levels:
            break
        levels.append(part)
        h = np.eye(k)[part]
        e, size = h.T @ e @ h, np.ones(k)
    return levels or [np.zeros(n, dtype=np.int64)]


def parents(levels: list[np.ndarray]) -> list[int]:
    """Parent of each cluster of all levels, counted from the finest; a top of more than one group gets a root; a root has -1."""
    out, start = [], 0
    for below, part in zip(levels, levels[1:]):
        start += int(below.max()) + 1
        out += [start + int(p) for p in part]
    tops = int(levels[-1].max()) + 1
    return out + ([start + tops] * tops + [-1] if tops > 1 else [-1])


# --- quadratic assignment --------------------------------------------------------------------------------------


def quadratic_assignment(a: np.ndarray, b: np.ndarray, rounds: int = 30, starts: int = 4, seed: int = 42) -> np.ndarray:
    """Slot of each row of a that raises the sum of a[i, j] * b[slot i, slot j]: Frank-Wolfe on doubly stochastic matrices, each step
    a linear matching, the last iterate rounded by one.  The first start is flat, where regular matrices have no slope, the others
    are half a random order; the best result counts, and it is never worse than leaving rows where they are."""
    n, rng = len(a), np.random.default_rng(seed)
    value = lambda s: float((a * b[np.ix_(s, s)]).sum())
    found = [np.arange(n)]
    for k in range(starts):
        p = np.full((n, n), 1.0 / n)
        if k:
            p = (p + np.eye(n)[rng.permutation(n)]) / 2
        for _ in range(rounds):
            gradient = a @ p @ b.T + a.T @ p @ b
            step = np.eye(n)[assignment(-gradient)] - p
            curve, slope = np.sum((a @ step @ b.T) * step), np.sum(gradient * step)
            t = [1.0] + ([min(1.0, -slope / (2 * curve))] if curve < 0 < slope else [])
            gain, best = max((slope * x + curve * x * x, x) for x in t)
            if gain <= 1e-9:
                break
            p = p + best * step
        found.append(assignment(-p))
    return max(found, key=value)


def clustered(edges: DataFrame, sizes: DataFrame, method: str, seed: int = 42) -> DataFrame:
    """graph_id, level, cluster, parent and, for level 0 (the finest), the neurons: one row a neuron and level.

    edges(graph_id, src, tgt), sizes(graph_id, n); ``nested_blocks`` or ``spectral``.  A network is one task.  Clusters have the
    numbers of ``parents``, so the table is the hierarchy that the hardware adapters read.
    """
    if method not in ("nested_blocks", "spectral"):
        raise ValueError(f"no method {method}")
    none = F.lit(None).cast("long")
    rows = sizes.select("graph_id", "n", none.alias("src"), none.alias("tgt")).unionByName(edges.select("graph_id", none.alias("n"), "src", "tgt"))

    def run(pdf):
        n = int(pdf["n"].max())
        e = pdf[pdf["src"].notna()].sort_values(["src", "tgt"])
        src, tgt = e["src"].to_numpy(dtype=np.int64), e["tgt"].to_numpy(dtype=np.int64)
        levels = nested_blocks(n, src, tgt) if method == "nested_blocks" else spectral_hierarchy(undirected(n, src, tgt), seed)
        up, full, start, out = parents(levels), np.arange(n), 0, []
        for k, part in enumerate(levels):
            full = part[full]
            ids = start + full
            out.append(pd.DataFrame({"graph_id": pdf["graph_id"].iloc[0], "level": k, "neuron": np.arange(n), "cluster": ids, "parent": [up[c] for c in ids]}))
            start += int(part.max()) + 1
        return pd.concat(out)

    return rows.groupBy("graph_id").applyInPandas(run, "graph_id string, level int, neuron long, cluster long, parent long")
